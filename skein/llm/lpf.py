"""Byte-substring deduplication by longest-previous-factor arrays.

``suffix_ranks`` sorts suffixes by their first ``depth`` bytes (prefix doubling); equal
ranks are equal prefixes. In suffix order, with ties at that depth by position, the previous
smaller position of a suffix in a tie is its neighbour, so the factor that starts at i has an
earlier copy of ``depth`` bytes exactly if i isn't the first of its tie.

One suffix array over a corpus would be one task's work. So suffixes are sorted block by
block, and only where a repeat is possible: of each window of half the width the least gram (winnowing)
must be found twice in the corpus. Only whether a factor reaches the width, or half of it, is asked, so factor
lengths beyond aren't computed; ``lpf_array`` gives them and is what tests compare with. What several blocks share is found in buckets. Eight windows
whose least gram lies at neighbouring offsets make a *cell*: their common core goes as a
hash, what they differ in as 7 + 7 plain bytes, so one entry decides eight windows exactly.
A block sends equal cells once; a passage that a third of all documents hold costs a block
one entry a cell inside, and at its ends no more than there are 14-byte contexts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .text import BYTE64, U64, _P, _PINV, covered, isin_sorted, mix64, powers, runs, sliding


#: Bytes of documents whose windows are looked at together; a longer document is one batch.
BATCH_BYTES = 1 << 18


def _ranks(key: np.ndarray) -> np.ndarray:
    """Place of each value among the distinct values."""
    order = np.argsort(key)
    line = key[order]
    new = np.zeros(len(key), dtype=bool)
    np.not_equal(line[1:], line[:-1], out=new[1:])
    del line
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix of ``data`` by its first ``depth`` bytes; a shorter suffix sorts first."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = min(7, depth)
    x = np.concatenate([data.astype(np.int16) + np.int16(1), np.zeros(h, np.int16)])
    key = np.zeros(n, np.int64)
    for k in range(h):
        key *= 257
        key += x[k : k + n]
    rank = _ranks(key)
    while h < depth:
        step = min(h, depth - h)
        np.multiply(rank, n + 1, out=key)
        key[: max(0, n - step)] += rank[step:] + 1
        del rank
        rank = _ranks(key)
        h += step
    return rank


def lpf_array(data: np.ndarray) -> np.ndarray:
    """Longest previous factor of every position, by previous and next smaller values in suffix order."""
    n = len(data)
    order = np.argsort(suffix_ranks(data, max(1, n)), kind="stable")

    def lcp(i: int, j: int) -> int:
        k = 0
        while max(i, j) + k < n and data[i + k] == data[j + k]:
            k += 1
        return k

    out = np.zeros(n, np.int64)
    for seq in (order, order[::-1]):
        stack: list[int] = []
        for p in map(int, seq):
            while stack and stack[-1] > p:
                stack.pop()
            if stack:
                out[p] = max(out[p], lcp(stack[-1], p))
            stack.append(p)
    return out


def earlier_copies(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an earlier copy, has any copy) for ranks in order of position."""
    order = np.argsort(rank, kind="stable")
    later, shared = np.zeros(len(rank), dtype=bool), np.zeros(len(rank), dtype=bool)
    if len(rank):
        later[order[1:]] = rank[order[1:]] == rank[order[:-1]]
        shared |= later
        shared[order[:-1]] |= later[order[1:]]
    return later, shared


def previous_factors_of(data: np.ndarray, depth: int) -> np.ndarray:
    """Whether each position starts an earlier copy of ``depth`` bytes that fits in ``data``."""
    later, _ = earlier_copies(suffix_ranks(data, depth))
    later[max(0, len(data) - depth + 1) :] = False
    return later


def _sections(x: np.ndarray) -> np.ndarray:
    """Starts of the maximal sections of equal values."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class _Batch:
    """One batch of documents: winnowed grams, and prefix hashes.

    Grams are a quarter of the width long. The least gram of each half-width window is an anchor. A window of the
    whole width consists of half-width windows, so where it's repeated all their least grams are. Between its uses a
    batch holds only anchors and the sections of equal least grams, not eight bytes or more a position."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, width: int) -> None:
        self.buf, self.offs, self.width = buf, offs, width
        n = len(buf)
        g = width // 4
        self.half = 2 * g
        self.ok = np.ones(max(0, n - self.half + 1), dtype=bool)  # half-width windows inside one document
        for end in offs[1:]:
            self.ok[max(0, end - self.half) : end] = False
        self.at, self.gram = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.least, self.long = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # least grams of the windows, and how many in a row have one
        if self.ok.any():
            c = self.prefixes()
            h = c[g:] - c[: n - g + 1]
            h *= powers(_PINV, n)[: n - g + 1]
            h = mix64(h)
            h |= U64(1)
            low = sliding(h, g + 1, np.minimum)
            head = _sections(low)
            self.least, self.long = low[head], np.diff(np.concatenate([head, [len(low)]])).astype(np.int32)
            low[~self.ok] = 0
            edge = np.zeros(g, dtype=np.uint64)
            reach = sliding(np.concatenate([edge, low, edge]), g + 1, np.maximum)
            self.at = np.flatnonzero(reach == h)
            self.gram = h[self.at]

    def prefixes(self) -> np.ndarray:
        """Hashes of the prefixes of the buffer, for hash()."""
        c = np.empty(len(self.buf) + 1, dtype=np.uint64)
        c[0] = 0
        np.multiply(BYTE64[self.buf], powers(_P, len(self.buf)), out=c[1:])
        return np.cumsum(c, out=c)

    def hash(self, c: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        return mix64((c[at + width] - c[at]) * powers(_PINV, len(self.buf))[at])

    def told(self, grams: np.ndarray) -> np.ndarray:
        """Half-width windows whose least gram is in ``grams`` (sorted)."""
        return np.repeat(isin_sorted(self.least, grams), self.long) & self.ok

    def cells(self, grams: np.ndarray, told: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of windows of ``width`` of which all half-width windows are told: start, bit, cell; and the cells' core starts.
        low: the least gram of each half-width window."""
        span = width - self.half + 1
        x, y = runs(told)
        long = y - x >= span
        x, y = x[long], y[long] - span + 1
        if not len(x):
            z = np.zeros(0, np.int64)
            return z, z, z, z
        i = np.arange(int((y - x).sum())) - np.repeat(np.cumsum(y - x) - (y - x), y - x) + np.repeat(x, y - x)
        least = np.concatenate([sliding(low[a : b + span - 1], span, np.minimum) for a, b in zip(x, y, strict=True)])
        mine = isin_sorted(self.gram, grams)
        at, val = self.at[mine], np.searchsorted(grams, self.gram[mine])
        n = len(self.buf) + 1
        key = np.sort(val * n + at)
        head = _sections(least)
        rank = np.repeat(np.searchsorted(grams, least[head]), np.diff(np.concatenate([head, [len(least)]])))
        # the leftmost least gram: where the last one still is in the window and has no other before it, it stays
        head = np.flatnonzero(np.concatenate([[True], (rank[1:] != rank[:-1]) | (i[1:] != i[:-1] + 1)]))
        p = np.repeat(key[np.searchsorted(key, rank[head] * n + i[head])] % n, np.diff(np.concatenate([head, [len(i)]])))
        late = np.flatnonzero(p < i)  # it left the window, an equal one follows
        p[late] = key[np.searchsorted(key, rank[late] * n + i[late])] % n
        t = p - i
        at = p - (t & ~7)
        flags = np.zeros(n, dtype=bool)
        flags[at] = True
        core = np.flatnonzero(flags)
        return i, 7 - (t & 7), (np.cumsum(flags, dtype=np.int32) - 1)[at], core


def _dealt(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, gram, count) of the distinct grams by hash. Least grams are small numbers, nearly all of which would
    meet in the first bucket; their hashes are a one-to-one mixture, so buckets are alike."""
    g = np.concatenate(grams or [np.zeros(0, np.uint64)])
    h, first, count = np.unique(mix64(g), return_index=True, return_counts=True)
    return h, g[first], count


class _Cells:
    """The cells of a block, equal ones once, in the order in which they are sent; of windows of the width, and of half of it too."""

    def __init__(self, block: B.Block, answer: pd.DataFrame, width: int, buckets: int, both: bool) -> None:
        parts = [(a, _Batch(buf, offs, width)) for a, _, buf, offs in block.batches(BATCH_BYTES)]
        h, u, count = _dealt([b.gram for _, b in parts])
        grams = np.sort(u[B.Answer(answer, buckets, np.uint64).holds(h) | (count > 1)])
        core, ctx, doc = [], [], []
        self.parts = []  # batch, and of each width: start, bit and cell of its windows
        base = 0
        for a, b in parts:
            told, low, c = b.told(grams), np.repeat(b.least, b.long), None
            own = []
            for w in (width, b.half)[: 1 + both]:
                i, d, inv, x = b.cells(grams, told, low, w)
                rows = np.zeros((len(x), 15), np.uint8)
                if len(x):
                    c = b.prefixes() if c is None else c
                    side = np.concatenate([x[:, None] - 7 + np.arange(7), x[:, None] + w - 7 + np.arange(7)], axis=1)
                    rows[:, :14] = b.buf[side.clip(0, max(0, len(b.buf) - 1))]
                    core.append(mix64(b.hash(c, x, w - 7) + U64(w)))
                    doc.append(a + np.searchsorted(b.offs, x, side="right") - 1)
                np.bitwise_or.at(rows[:, 14], inv, np.left_shift(np.uint8(1), d.astype(np.uint8)))
                ctx.append(rows)
                own.append((i.astype(np.int32), d.astype(np.uint8), (inv + base).astype(np.int32)))
                base += len(x)
            self.parts.append((b, own))
        core = np.concatenate(core or [np.zeros(0, np.uint64)])
        ctx = np.concatenate(ctx or [np.zeros((0, 15), np.uint8)])
        doc = np.concatenate(doc or [np.zeros(0, np.int64)])
        words = np.zeros((len(core), 16), np.uint8)
        words[:, :15] = ctx
        w = words.view(np.uint64).reshape(-1, 2)
        _, first, same = np.unique(mix64(core + mix64(w[:, 0] + mix64(w[:, 1]))), return_index=True, return_inverse=True)
        order = np.argsort(core[first], kind="stable")
        first = first[order]
        sent = np.empty(len(order), np.int64)
        sent[order] = np.arange(len(order))
        self.sent = sent[same] if len(same) else same
        self.core, self.ctx = core[first], ctx[first]
        self.doc = block.ids[doc[first]] if len(first) else doc
        self.width, self.buckets = width, buckets

    def rows(self, block: int) -> pd.DataFrame:
        core, ctx = self.core, self.ctx
        z = zstandard.ZstdCompressor(level=3)
        edges = np.searchsorted(core, np.array([(k << 64) // self.buckets for k in range(self.buckets)], dtype=np.uint64)).tolist() + [len(core)]
        ks = [k for k in range(self.buckets) if edges[k + 1] > edges[k]]
        cut = [slice(edges[k], edges[k + 1]) for k in ks]
        return pd.DataFrame(
            {
                "bucket": np.array(ks, np.int32),
                "block": np.int64(block),
                "core": [core[s].tobytes() for s in cut],
                "ctx": [z.compress(np.ascontiguousarray(ctx[s].T).tobytes()) for s in cut],
                "doc": [z.compress(self.doc[s].tobytes()) for s in cut],
            }
        ).astype({"block": "int64"})

    def flags(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(another block holds it, an earlier document in another block holds it), a bit a window for each cell."""
        pdf = pdf.sort_values("bucket")
        n = len(self.core)
        out = [np.frombuffer(b"".join(pdf[c]), np.uint8) if len(pdf) else np.zeros(n, np.uint8) for c in ("found", "before")]
        assert len(out[0]) == n, "a block's answer doesn't fit its cells"
        return out[0][self.sent], out[1][self.sent]


#: Cells of a bucket that are compared at once; cells of one core stay together.
AT_ONCE = 150_000


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket: which windows several cells hold, and which an earlier document of another block holds."""
    z = zstandard.ZstdDecompressor()
    cores = [np.frombuffer(x, np.uint64) for x in pdf["core"]]
    sizes = [len(x) for x in cores]
    core = np.concatenate(cores)
    ctx = np.concatenate([np.frombuffer(z.decompress(x), np.uint8).reshape(15, -1).T for x in pdf["ctx"]])
    doc = np.concatenate([np.frombuffer(z.decompress(x), np.int64) for x in pdf["doc"]])
    block = np.repeat(pdf["block"].to_numpy(), sizes)
    order = np.lexsort((block, doc, core))
    del doc
    head = np.flatnonzero(np.concatenate([[True], core[order[1:]] != core[order[:-1]]])) if len(order) else order
    alone = np.diff(np.concatenate([head, [len(order)]])) == 1  # nothing to compare a lonely core with
    cuts, out = [0], np.zeros((2, len(core)), np.uint8)
    while cuts[-1] < len(order):
        k = np.searchsorted(head, cuts[-1] + AT_ONCE)
        cuts.append(int(head[k]) if k < len(head) else len(order))
    lonely = np.zeros(len(order), dtype=bool)
    lonely[head[alone]] = True
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b][~lonely[a:b]]  # by core, then the order of documents
        c, x = core[own], ctx[own]
        pad = np.zeros((len(own), 8), np.uint8)
        keys, who = [], []
        for d in range(8):
            on = np.flatnonzero(x[:, 14] >> d & 1)
            pad[:, : 7 - d] = x[:, d:7]
            pad[:, 7 - d : 7] = x[:, 7 : 7 + d]
            pad[:, 7] = d
            keys.append(mix64(c[on] + mix64(pad[on].view(np.uint64).ravel())))
            who.append((on * 8 + d).astype(np.int32))
        key, who = np.concatenate(keys), np.concatenate(who)
        by = np.argsort(key, kind="stable")  # of one window all cells have one bit, so they are in the order of documents
        k, who = key[by], who[by]
        again = np.zeros(len(k), bool)
        again[1:] = k[1:] == k[:-1]
        shared = again.copy()
        shared[:-1] |= again[1:]
        # earlier in another block; what is earlier in the same one, the block knows itself
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(k)))) if len(k) else by
        at = block[own][who >> 3]
        for row, flag in enumerate((shared, at != at[first])):
            bits = np.zeros(len(own) * 8, bool)
            bits[who[flag]] = True
            out[row, own] = np.packbits(bits.reshape(-1, 8), axis=1, bitorder="little").ravel()
    ends = np.cumsum(sizes)
    return pd.DataFrame(
        {
            "block": pdf["block"],
            "bucket": pdf["bucket"],
            "found": [out[0][e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)],
            "before": [out[1][e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)],
        }
    )


def _copies(s: _Cells) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of the width, in order: has an earlier copy in the block, has any; by suffix ranks of the regions of
    windows whose hash the block holds twice. Equal windows have equal hashes, so no copy is lost; the ranks decide."""
    hashes = [b.hash(b.prefixes(), own[0][0].astype(np.int64), s.width) for b, own in s.parts if len(own[0][0])]
    later, shared = earlier_copies(np.zeros(0, np.int64))
    if not hashes:
        return later, shared
    whole = np.concatenate(hashes)
    line = np.sort(whole)
    twice = isin_sorted(whole, np.unique(line[1:][line[1:] == line[:-1]]))
    del hashes, line
    later, shared = np.zeros(len(whole), dtype=bool), np.zeros(len(whole), dtype=bool)
    del whole
    texts, pos, at, k = [], [], 0, 0
    for b, own in s.parts:
        i = own[0][0].astype(np.int64)
        i, k = i[twice[k : k + len(i)]], k + len(i)
        if not len(i):
            continue
        flags = np.zeros(len(b.buf), dtype=bool)
        flags[i] = True
        x, y = runs(covered(flags, s.width, len(b.buf)))
        shift = at - x + np.concatenate([[0], np.cumsum(y - x)[:-1]])
        texts.extend(b.buf[p:q] for p, q in zip(x, y, strict=True))
        pos.append(i + shift[np.searchsorted(x, i, side="right") - 1])
        at += int((y - x).sum())
    if texts:
        later[twice], shared[twice] = earlier_copies(suffix_ranks(np.concatenate(texts), s.width)[np.concatenate(pos)])
    return later, shared


def _twice(s: _Cells) -> np.ndarray:
    """A bit a half-width window of each sent cell: the block holds it in two equal cells."""
    seen, again = np.zeros(len(s.core) * 8, bool), np.zeros(len(s.core) * 8, bool)
    at = np.zeros(len(seen), np.int32)
    for _, own in s.parts:
        _, d, cell = own[1]
        bit, i = s.sent[cell] * 8 + d, np.arange(len(d), dtype=np.int32)
        at[bit] = i  # of equal bits one place stays
        again[bit[seen[bit] | (at[bit] != i)]] = True
        seen[bit] = True
    return np.packbits(again.reshape(-1, 8), axis=1, bitorder="little").ravel()


OUTPUTS = {"longest_repeat": "long", "kept": "binary", "kept_text": "string", "kept_sha256": "string"}


def suffix_array_dedup(docs: DataFrame, width: int = 400, keep: str = "first", columns: tuple[str, ...] = (), outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """Remove the bytes that a repeated ``width``-byte string covers.

    docs: doc_id, text; ``columns`` are passed through, others ignored. keep "first": a string's first copy, by doc_id
    and position, stays; "none": every copy goes. One row per input row: doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), and of these the ``outputs`` that are asked for: longest_repeat (bytes of
    the longest run that strings of half the width cover which also start elsewhere), kept (the other bytes),
    kept_text (the same without broken characters), kept_sha256. Half the width is 2 * (width // 4).
    Null and empty texts have no bytes; repeated rows are copies; an empty table gives no row; a
    null id stays null and counts as 0 in the order; of equal ids the lower block comes first.
    Lengths are of UTF-8, and a cut may fall inside a character.
    """
    if width < 16 or keep not in ("first", "none"):
        raise ValueError("width is 16 at least; keep is 'first' or 'none'")
    names = [f"__{k}" for k in range(len(columns))]  # no column passed through can clash with a result
    passed = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)))
    both = "longest_repeat" in outputs
    bl = B.pack(passed, tuple(names))
    buckets = B.bucket_count(bl)

    def first(block: B.Block) -> pd.DataFrame:
        h, _, count = _dealt([_Batch(buf, offs, width).gram for _, _, buf, offs in block.batches(BATCH_BYTES)])
        return B.requests(h[count == 1], h[count > 1], block.block, buckets, np.uint64)

    def second(block: B.Block, pdf: pd.DataFrame) -> pd.DataFrame:
        return _Cells(block, pdf, width, buckets, both).rows(block.block)

    def last(block: B.Block, pdf: pd.DataFrame) -> pa.Table:
        grams = pdf["before"].isna().to_numpy()
        s = _Cells(block, pdf[grams], width, buckets, both)
        found, before = s.flags(pdf[~grams])
        later, shared = _copies(s)
        twice = _twice(s)[s.sent] if both else found
        ids = block.id_list()
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", *outputs)}
        at = 0
        for b, own in s.parts:
            hit = []
            for k, (i, d, cell) in enumerate(own):
                if k:
                    flag = (found[cell] | twice[cell]) >> d & 1 > 0
                else:
                    here = slice(at, at + len(i))
                    at += len(i)
                    flag = later[here] | (before[cell] >> d & 1 > 0) if keep == "first" else shared[here] | (found[cell] >> d & 1 > 0)
                flags = np.zeros(len(b.buf), dtype=bool)
                flags[i[flag]] = True
                hit.append(covered(flags, b.half if k else width, len(b.buf)))
            n = np.diff(b.offs) - 1
            gone = np.concatenate([[0], np.cumsum(hit[0])])
            x, y = runs(hit[0])
            spans = np.bincount(np.searchsorted(b.offs, x, side="right") - 1, minlength=len(n))
            out["n_bytes"].append(n)
            out["n_removed"].append(gone[b.offs[1:] - 1] - gone[b.offs[:-1]])
            out["n_spans"].append(spans)
            if both:
                longest = np.zeros(len(n), np.int64)
                x, y = runs(hit[1])
                np.maximum.at(longest, np.searchsorted(b.offs, x, side="right") - 1, y - x)
                out["longest_repeat"].append(longest)
            if len(outputs) > both:
                raw, whole = b.buf.tobytes(), out["n_removed"][-1] == 0
                for p, q, w in zip(b.offs[:-1].tolist(), (b.offs[1:] - 1).tolist(), whole.tolist(), strict=True):
                    kept = raw[p:q] if w else b.buf[p:q][~hit[0][p:q]].tobytes()
                    for c in outputs:
                        if c != "longest_repeat":
                            out[c].append(kept if c == "kept" else kept.decode("utf-8", "ignore") if c == "kept_text" else hashlib.sha256(kept).hexdigest())
        kinds = {"kept": pa.binary(), "kept_text": pa.string(), "kept_sha256": pa.string()}
        cols = {c: pa.array(v, kinds[c]) if c in kinds else pa.array(np.concatenate(v or [np.zeros(0, np.int64)]), pa.int64()) for c, v in out.items()}
        more = {c: block.extra.column(c) for c in names} if names else {}
        return pa.table({**more, "doc_id": pa.array(ids, pa.int64()), **cols})

    seen = B.repeated(B.ask(bl, first), np.uint64).selectExpr("block", "bucket", "found", "CAST(NULL AS binary) AS before")
    sent = B.again(bl, seen, second, "bucket int, block long, core binary, ctx binary, doc binary")
    told = sent.groupBy("bucket").applyInPandas(_answer, "block long, bucket int, found binary, before binary")
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, passed.schema.fields[2:], strict=True)])
    for c, kind in {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", **{c: OUTPUTS[c] for c in outputs}}.items():
        schema.add(c, kind)
    done = B.again_arrow(bl, seen.unionByName(told), last, schema)
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)), *done.columns[len(names) :])
