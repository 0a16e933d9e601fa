"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Words are runs of letters and digits in lower case. A text's window of as many words as an item
has is compared to that item by the weighted Jaccard similarity of their five-word shingles; a
shingle weighs as much as it has letters and digits, so a similarity depends on the two texts alone. Windows of which
less than the threshold's share of weight lies in shingles of any item can't reach it and are passed
over, from running sums. The others get 64-bit SimHashes. Items of the same length are indexed in
eight blocks of eight bits: fingerprints at most 15 bits apart are at most one bit apart in
some block, so probing every pattern within one bit of each block, 28 % of the items in all, finds them
all. What the exact Hamming distance leaves is verified by the exact similarity. Pairs at just the
threshold differ in about 10 bits, with a deviation of 3, so a few of a hundred of these are lost, and none further above.

Items go to the executors in groups of bounded number; texts are read where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, lean, mix64, window_hashes, word_hashes, word_spans

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 15
BLOCKS = 8
ITEMS_AT_ONCE = 20_000
NORMAL = np.full(256, 32, np.uint8)
NORMAL[10] = 10
NORMAL[48:58] = np.arange(48, 58)
NORMAL[65:91] = np.arange(97, 123)
NORMAL[97:123] = np.arange(97, 123)
NORMAL[128:] = np.arange(128, 256)
NEAR = [sum(x == 1 for x in map(int, bin(v)[2:])) for v in range(256)]
BITS = np.array(NEAR, np.uint8)
PROBES = np.flatnonzero(BITS <= RADIUS // BLOCKS)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and lengths in bytes of all words, and the word offsets of the texts."""
    buf = NORMAL[np.frombuffer(b"\n".join(t.replace(b"\n", b" ") for t in texts) + b"\n", np.uint8)]
    offs = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    s, e = word_spans(buf)
    return word_hashes(buf, s, e), e - s, np.searchsorted(s, offs)


def shingle_weights(lengths: np.ndarray, k: int) -> np.ndarray:
    """Bytes of the words of each k-word shingle."""
    c = np.concatenate([[0], np.cumsum(lengths)])
    return (c[k:] - c[:-k]).astype(float) if len(lengths) >= k else np.zeros(0)


def multiset(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, counts, weights."""
    u, at, c = np.unique(h, return_index=True, return_counts=True)
    return u, c, weight[at]


def simhash(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of 64 signed sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(U64).ravel()


def signed(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A shingle's contributions to the 64 sums."""
    bits = np.unpackbits(mix64(h ^ U64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.astype(np.float32) * 2 - 1) * weight[:, None].astype(np.float32)


class Index:
    """Items by length, their shingles and fingerprints."""

    def __init__(self, items: list[tuple[int | None, bytes]], threshold: float) -> None:
        self.threshold = threshold
        h, length, w = words([t for _, t in items]) if items else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(1, np.int64))
        self.groups: dict[int, dict] = {}
        sets, by = [], {}
        for k, (item, _) in enumerate(items):
            x = h[w[k] : w[k + 1]]
            if len(x):
                size = min(SHINGLE, len(x))
                sh = window_hashes(x, size)
                sets.append(np.unique(sh))
                by.setdefault(len(x), []).append((item, sh, shingle_weights(length[w[k] : w[k + 1]], size)))
        self.shingles = np.unique(np.concatenate(sets)) if sets else np.zeros(0, U64)
        self.map = np.zeros(1 << 20, dtype=bool)
        self.map[(self.shingles & U64((1 << 20) - 1)).astype(np.int64)] = True
        for size, own in by.items():
            prints = simhash(np.stack([signed(sh, weight).sum(0) for _, sh, weight in own]))
            tables = []
            for b in range(BLOCKS):
                v = (prints >> U64(8 * b) & U64(255)).astype(np.int64)
                pattern = (v[:, None] ^ PROBES[None, :]).ravel()
                who = np.repeat(np.arange(len(own)), len(PROBES))
                order = np.argsort(pattern, kind="stable")
                tables.append((np.searchsorted(pattern[order], np.arange(257)), who[order]))
            self.groups[size] = {"ids": [i for i, *_ in own], "sets": [multiset(sh, weight) for _, sh, weight in own], "prints": prints, "tables": tables}

    @staticmethod
    def similarity(a: tuple, b: tuple) -> float:
        """Weighted Jaccard of two shingle multisets."""
        _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        both = float((np.minimum(a[1][i], b[1][j]) * a[2][i]).sum())
        total = float((a[1] * a[2]).sum() + (b[1] * b[2]).sum()) - both
        return both / total if total else 0.0

    def candidates(self, group: dict, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) with fingerprints within the radius."""
        win, who = [], []
        for b, (start, items) in enumerate(group["tables"]):
            v = (prints >> U64(8 * b) & U64(255)).astype(np.int64)
            n = start[v + 1] - start[v]
            w = np.repeat(np.arange(len(prints)), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[v], n)
            i = items[k]
            x = prints[w] ^ group["prints"][i]
            near = BITS[x.view(np.uint8).reshape(-1, 8)].sum(1) <= RADIUS
            win.append(w[near])
            who.append(i[near])
        n = len(group["ids"])
        pair = np.unique(np.concatenate(win).astype(np.int64) * n + np.concatenate(who))
        return pair // n, pair % n

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity): the best window of each text and item, the first of equals."""
        h, length, w = words(texts)
        best: dict[tuple[int, int | None], tuple] = {}
        if not len(h) or not self.groups:
            return []
        by_width: dict[int, tuple] = {}
        for size, group in sorted(self.groups.items()):
            k = min(SHINGLE, size)
            if k not in by_width:
                sh = window_hashes(h, k)
                maybe = np.flatnonzero(self.map[(sh & U64((1 << 20) - 1)).astype(np.int64)])
                i = np.minimum(np.searchsorted(self.shingles, sh[maybe]), len(self.shingles) - 1)
                at = maybe[self.shingles[i] == sh[maybe]]
                weight = shingle_weights(length, k)
                inside = np.zeros(len(sh) + 1)
                inside[at + 1] = weight[at]
                by_width[k] = (sh, weight, np.cumsum(inside), np.concatenate([[0.0], np.cumsum(weight)]), at)
            sh, weight, inside, whole, at = by_width[k]
            n = size - k + 1
            if not len(at) or len(sh) < n:
                continue
            # starts near a shingle of an item
            near = np.zeros(len(sh) - n + 2, np.int32)
            np.add.at(near, np.maximum(at - n + 1, 0).clip(max=len(near) - 1), 1)
            np.add.at(near, np.minimum(at + 1, len(near) - 1), -1)
            x = np.flatnonzero(np.cumsum(near)[:-1] > 0)
            x = x[inside[x + n] - inside[x] >= self.threshold * (whole[x + n] - whole[x]) - 1e-6]
            doc = np.searchsorted(w, x, side="right") - 1
            fits = x + size <= w[doc + 1]
            x, doc = x[fits], doc[fits]
            for part in range(0, len(x), 20_000):
                xs, ds = x[part : part + 20_000], doc[part : part + 20_000]
                prints = np.empty(len(xs), U64)
                for q in range(0, len(xs), 512):
                    z = xs[q : q + 512, None] + np.arange(n)
                    flat, inv = np.unique(z, return_inverse=True)
                    s = signed(sh[flat], weight[flat])
                    c = np.concatenate([np.zeros((1, 64), np.float64), np.cumsum(s, axis=0, dtype=np.float64)])
                    first = inv.reshape(z.shape)[:, 0]
                    prints[q : q + 512] = simhash(c[first + n] - c[first])
                win, who = self.candidates(group, prints)
                for a, b in zip(win, who, strict=True):
                    key, p = (int(ds[a]), group["ids"][b]), int(xs[a])
                    if key in best and best[key][2] >= 1.0:
                        continue
                    sim = self.similarity(multiset(sh[p : p + n], weight[p : p + n]), group["sets"][b])
                    if sim >= self.threshold and (key not in best or sim > best[key][2]):
                        best[key] = (p - int(w[key[0]]), size, sim)
        return [(d, i, *v) for (d, i), v in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0))]


def _indexes(benchmark: DataFrame, threshold: float) -> Iterator[Index]:
    """Indexes of about ITEMS_AT_ONCE items each; their number is counted first."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).where("text IS NOT NULL")
    groups = -(-items.count() // ITEMS_AT_ONCE) or 1
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()
        yield Index(sorted(((r["item_id"], bytes(r["text"])) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1])), threshold)


def _matches(index: Index, texts: list) -> list[tuple]:
    """Index.matches in batches of about a megabyte."""
    texts, rows, a = [t or b"" for t in texts], [], 0
    while a < len(texts):
        size, z = 0, a
        while z < len(texts) and (z == a or size + len(texts[z]) <= 1 << 20):
            size += len(texts[z])
            z += 1
        rows += [(a + m[0], *m[1:]) for m in index.matches(texts[a:z])]
        a = z
    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Where a text holds a window that is like a benchmark item.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. One row per row of docs
    and item that match: doc_id, item_id, start (word), words, similarity (of the best window, the
    first of equals). Null and empty texts and items
    match nothing; items of 1 to 4 words must match whole; of repeated item ids, null ones among them, the best
    match counts; null ids stay null. Empty tables give no row.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    out = None
    for index in _indexes(benchmark, threshold):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = _matches(sent.value, b.column(1).to_pylist())
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.float64())],
                    names=["doc_id", "item_id", "start", "words", "similarity"],
                )

        found = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).mapInArrow(lean(run), "doc_id long, item_id long, start long, words long, similarity double")
        out = found if out is None else out.unionByName(found)
    return out


def without_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns; one pass over the texts a group of items."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    for index in _indexes(benchmark, threshold):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bad = {m[0] for m in _matches(sent.value, [None if t is None else t.encode("utf-8", "replace") for t in b.column("text").to_pylist()])}
                yield b.take(pa.array([k for k in range(b.num_rows) if k not in bad], pa.int64()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
