"""Substring deduplication of word windows by difference-cover anchors.

With a difference cover D modulo v, any two positions have a shift below v that takes both
to a position in D. So two equal windows of ``width`` words share, at the same offset below
v, an anchor of ``width - v + 1`` words at a cover position of either document. Round one
hashes only these anchors and finds those that occur twice in the corpus. Round two extends
them: every window start from which some anchor is in reach of v is a candidate, and only
candidates' whole windows are hashed and counted. No occurrence is lost and no pair is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import blocks as B
from .text import covered, runs, window_hashes, word_hashes, word_spans

#: Perfect difference sets modulo 21, 13 and 7: each difference occurs once.
COVERS = {21: (3, 6, 7, 12, 14), 13: (0, 1, 3, 9), 7: (0, 1, 3), 1: (0,)}


def _period(width: int) -> int:
    return next(v for v in COVERS if width >= v + max(2, width // 4) or v == 1)


def _documents(block: B.Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches: first document, buffer, word starts and ends, word hashes, and word offsets of the documents."""
    for a, _, buf, offs in block.batches():
        s, e = word_spans(buf)
        yield a, buf, s, e, word_hashes(buf, s, e), np.searchsorted(s, offs)


def _fits(woffs: np.ndarray, n: int, width: int) -> np.ndarray:
    """Window starts of a batch whose ``width`` words lie in one document."""
    ok = np.ones(max(0, n - width + 1), dtype=bool)
    for end in woffs[1:-1]:
        ok[max(0, end - width + 1) : end] = False
    return ok


def _once(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, c = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
    return u[c == 1], u[c > 1]


def _anchors(h: np.ndarray, woffs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a batch."""
    v = _period(width)
    w = width - v + 1
    at = np.flatnonzero(_fits(woffs, len(h), w))
    local = at - woffs[np.searchsorted(woffs, at, side="right") - 1]
    table = np.zeros(v, dtype=bool)
    table[list(COVERS[v])] = True
    at = at[table[local % v]]
    return at, window_hashes(h, w)[at]


def _rounds(blocks: DataFrame, width: int, buckets: int) -> tuple:
    """The answers of round one (anchors that several blocks hold) and the question of round two."""
    v = _period(width)

    def first(block: B.Block) -> pd.DataFrame:
        return B.requests(*_once([_anchors(h, woffs, width)[1] for *_, h, woffs in _documents(block)]), block.block, buckets, np.uint32)

    def second(block: B.Block, pdf: pd.DataFrame) -> pd.DataFrame:
        once, more = _once([x[1] for x in _windows(block, pdf, width, v, buckets)])
        return B.requests(once, more, block.block, buckets, np.uint64)

    seen = B.repeated(B.ask(blocks, first), np.uint32)
    return seen, second


def _windows(block: B.Block, pdf: pd.DataFrame, width: int, v: int, buckets: int) -> Iterator[tuple]:
    """Of each batch: candidate window starts and their hashes, and the batch."""
    ans = B.Answer(pdf, buckets, np.uint32)
    parts = [(_anchors(d[4], d[5], width), d) for d in _documents(block)]
    u, inv, c = np.unique(np.concatenate([a[1] for a, _ in parts]) if parts else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    hit = (ans.holds(u) | (c > 1))[inv]
    k = 0
    for (at, _), d in parts:
        h, woffs = d[4], d[5]
        at = at[hit[k : k + len(at)]] if (n := len(at)) else at
        k += n
        size = max(0, len(h) - width + 1)
        flags = np.zeros(len(h) + v, dtype=bool)
        flags[at] = True
        near = np.zeros(size, dtype=bool)
        if size:
            cs = np.cumsum(np.concatenate([[0], flags.astype(np.int32)]))
            near = cs[v : v + size] > cs[:size]
        starts = np.flatnonzero(near & _fits(woffs, len(h), width))
        yield starts, window_hashes(h, width)[starts], d


def difference_cover_dedup(docs: DataFrame, width: int = 35) -> DataFrame:
    """Remove every word that a repeated window of ``width`` words covers.

    docs: doc_id, text; other columns are ignored. One row per input row: doc_id, n_words,
    n_removed, kept (the other words joined by one space), removed_spans (word positions,
    [start, end) as flat pairs). A null or empty text has no words and an empty kept text;
    repeated rows are copies of each other and lose all their words if they have ``width``;
    an empty table gives an empty result; null ids stay null.
    """
    v = _period(width)
    bl = B.pack(docs)
    buckets = B.bucket_count(bl)
    seen, second = _rounds(bl, width, buckets)
    twice = B.repeated(B.again(bl, seen.select("block", "bucket", "found"), second, B.REQUEST), np.uint64)
    both = seen.selectExpr("block", "bucket", "found", "false AS whole").unionByName(twice.selectExpr("block", "bucket", "found", "true AS whole"))

    def last(block: B.Block, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf["whole"].to_numpy(dtype=bool)
        ans = B.Answer(pdf[whole], buckets, np.uint64)
        parts = list(_windows(block, pdf[~whole], width, v, buckets))
        u, inv, c = np.unique(np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        hit = (ans.holds(u) | (c > 1))[inv]
        rows, k = [], 0
        for starts, _, (a, buf, s, e, h, woffs) in parts:
            flags = np.zeros(len(h), dtype=bool)
            flags[starts[hit[k : k + len(starts)]]] = True
            k += len(starts)
            gone = covered(flags, width, len(h))
            for j in range(len(woffs) - 1):
                x, y = woffs[j], woffs[j + 1]
                g = gone[x:y]
                spans = np.stack(runs(g), 1).ravel() if g.any() else np.zeros(0, np.int64)
                kept = b" ".join([bytes(buf[s[q] : e[q]]) for q in np.flatnonzero(~g) + x]) if len(spans) or y > x else b""
                rows.append((int(y - x), int(g.sum()), kept, spans))
        return pd.DataFrame(
            {
                "doc_id": pd.array(block.id_list(), dtype="Int64"),
                "n_words": np.array([r[0] for r in rows], np.int64),
                "n_removed": np.array([r[1] for r in rows], np.int64),
                "kept": [r[2].decode("utf-8", "replace") for r in rows],
                "kept_sha256": [hashlib.sha256(r[2]).hexdigest() for r in rows],
                "removed_spans": [r[3] for r in rows],
            }
        )

    return B.again(bl, both, last, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, removed_spans array<long>")
