"""The best ``k`` of many rows for each of a batch of questions, kept in a task, so that no pair is shuffled.

Scores of a batch come from one matrix product in single precision. What can still be among the best by its
error bound is scored again in doubles, so the product decides nothing. Scores are rounded to nine
places, halves away from zero, as Spark's round() does.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PLACES = 10**9
#: Keys of scores that are no number: NaN is the greatest, as Spark sorts it, null the least.
NAN, NULL = np.iinfo(np.int64).max, np.iinfo(np.int64).min
PAIRS = 100_000


def rounded(x: np.ndarray) -> np.ndarray:
    """Scores as whole billionths; NaN as NAN."""
    bad = np.isnan(x)
    y = np.abs(np.where(bad, 0.0, x)) * PLACES
    low = np.floor(y)
    key = low + (y - low >= 0.5)
    for i in np.flatnonzero(np.abs(y - low - 0.5) < 1e-3):  # the product's own error could turn these
        key[i] = int((abs(Decimal(repr(float(x[i])))) * PLACES).to_integral_value(ROUND_HALF_UP))
    return np.where(bad, NAN, np.where(x < 0, -key, key).astype(np.int64))


def plain(key: np.ndarray) -> pa.Array:
    """Keys as scores again."""
    return pa.array(np.where(key == NAN, np.nan, key / PLACES), mask=key == NULL)


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as numbers if they are whole, else as objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def order_of(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids; null comes first."""
    if ids.dtype != object:
        return ids
    place = {x: i for i, x in enumerate(sorted(set(ids), key=lambda x: (False,) if x is None else (True, x)))}
    return np.fromiter((place[x] for x in ids), np.int64, len(ids))


def coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(distinct values, the number of each row's value)."""
    d = column.combine_chunks().dictionary_encode("encode")
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Best:
    """Up to ``k`` rows of each of ``n`` questions, by key (greatest first), then ``at``, then id."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.held: list[tuple[np.ndarray, ...]] = []
        self.more = 0
        self.least = np.full(n, -np.inf)  # what a score must reach to be among the best

    def add(self, q: np.ndarray, key: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
        if len(q):
            self.held.append((q, key, at, ids))
            self.more += len(q)
            if self.more > max(PAIRS, self.n * self.k // 2):
                self.settle()

    def settle(self) -> None:
        """Drop what isn't among the best."""
        if not self.more:
            return
        kinds = {h[3].dtype for h in self.held}
        ids = np.concatenate([h[3].astype(object) if len(kinds) > 1 else h[3] for h in self.held])
        q, key, at = (np.concatenate([h[j] for h in self.held]) for j in range(3))
        order = np.lexsort((order_of(ids), at, ~key, q))  # ~key falls as key rises
        q = q[order]
        first = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - first[q] < self.k
        order, q = order[keep], q[keep]
        self.held, self.more = [(q, key[order], at[order], ids[order])], 0
        n = np.bincount(q, minlength=self.n)
        full = np.flatnonzero(n == self.k)
        last = self.held[0][1][np.cumsum(n)[full] - 1]
        self.least[full] = np.where(last == NULL, -np.inf, np.where(last == NAN, np.inf, last / PLACES))

    def rows(self) -> tuple[np.ndarray, ...] | None:
        self.settle()
        return self.held[0] if self.held else None


def floor_of(best: Best, some: slice, approx: np.ndarray) -> np.ndarray:
    """What a score of a batch (row: row, column: question) must reach by now: the least held one, or the batch's own k-th."""
    least, k = best.least[some], best.k
    if len(approx) > k and not np.all(np.isfinite(least)):
        least = np.maximum(least, np.partition(approx, len(approx) - k, axis=0)[len(approx) - k])
    return least


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, size of each) of a list column; a null vector or one with a null has the size -1. Vectors have columns up to the longest."""
    size = np.array(column.value_lengths().fill_null(-1))
    values = column.flatten()
    holes = np.asarray(values.is_null())
    v = np.asarray(values.fill_null(0.0).to_numpy(zero_copy_only=False), np.float64)
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    ends = np.cumsum(np.maximum(size, 0))
    out = np.zeros((len(size), max(int(size.max(initial=0)), 0)))
    out[row, np.arange(len(v)) - (ends - np.maximum(size, 0))[row]] = v
    size[row[holes]] = -1
    return out, size


def exact_dots(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products of rows, added from the first column to the last."""
    s = np.zeros(len(p))
    for j in range(p.shape[1]):
        s += p[:, j] * q[:, j]
    return s


def nearest(batches: Iterator[pa.RecordBatch], asked: pa.Table, k: int, step: int = 2048, wide: int = 2048) -> Iterator[pa.RecordBatch]:
    """(qid, chunk_id, score) of the best points (chunk_id, p) of this task for the questions ``asked`` (qid, q).

    Vectors have length 1 or 0. Of points with the same vector only the ``k`` lowest ids can be among the best.
    Vectors of another size than the question's, and null ones, have a null score."""
    names = asked.column("qid").combine_chunks()
    vectors, size = matrix(asked.column("q").combine_chunks())
    groups = [(np.flatnonzero(size == s), int(s)) for s in np.unique(size)]
    groups = [(g, s, vectors[g, : max(s, 0)], Best(len(g), k)) for g, s in groups]
    singles = [np.asarray(v, np.float32) for _, _, v, _ in groups]
    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for start in range(0, len(batch), step):
            part = batch.slice(start, step)
            ids = ids_of(part.column(0))
            points, sizes = matrix(part.column(1))
            for (g, s, v, best), single in zip(groups, singles, strict=True):
                _one(ids, points, sizes, s, v, single, best, k, wide)
    for g, _, _, best in groups:
        rows = best.rows()
        for a in range(0, len(rows[0]) if rows else 0, PAIRS):
            q, key, _, ids = (x[a : a + PAIRS] for x in rows)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(g[q])), pa.array(ids.tolist() if ids.dtype == object else ids, kind), plain(key)], ["qid", "chunk_id", "score"])


def _one(ids: np.ndarray, points: np.ndarray, sizes: np.ndarray, s: int, v: np.ndarray, single: np.ndarray, best: Best, k: int, wide: int) -> None:
    """Add a batch of points for the questions ``v`` of size ``s``."""
    same = sizes == s if s >= 0 else np.zeros(len(ids), bool)
    mine = np.flatnonzero(same)
    p = points[mine, : max(s, 0)]
    number = np.isfinite(p).all(axis=1)
    asked = np.isfinite(v).all(axis=1)
    # pairs without a number: the lowest ids stand for all
    for rows, who, key in ((np.flatnonzero(~same), np.arange(len(v)), NULL), (mine[~number], np.arange(len(v)), NAN), (mine[number], np.flatnonzero(~asked), NAN)):
        low = rows[np.argsort(order_of(ids[rows]), kind="stable")[:k]]
        if len(low) and len(who):
            best.add(np.repeat(who, len(low)), np.full(len(who) * len(low), key), np.zeros(len(who) * len(low), np.int64), np.tile(ids[low], len(who)))
    mine, p = mine[number], p[number]
    if not len(mine) or not asked.any():
        return
    order = np.argsort(order_of(ids[mine]), kind="stable")
    mine, p = mine[order], np.ascontiguousarray(p[order])
    if len(mine) > k and s > 0:
        _, back = np.unique(p.view(np.dtype((np.void, p.shape[1] * 8))).ravel(), return_inverse=True)
        by = np.argsort(back, kind="stable")
        first = np.searchsorted(back[by], np.arange(back.max() + 1))
        keep = np.sort(by[np.arange(len(by)) - first[back[by]] < k])
        mine, p = mine[keep], p[keep]
    margin = 4.0 * (s + 8) * 2.0**-23 + 1e-8  # of a single-precision product of vectors of length 1
    few = np.asarray(p, np.float32)
    for a in range(0, len(v), wide):
        some = slice(a, a + wide)
        approx = few @ single[some].T
        approx[:, ~asked[some]] = -np.inf
        least = floor_of(best, some, approx)
        x, q = np.nonzero(approx >= (least - margin).astype(np.float32))
        good = asked[some][q]
        x, q = x[good], q[good]
        for b in range(0, len(x), PAIRS):
            i, j = x[b : b + PAIRS], q[b : b + PAIRS] + a
            best.add(j, rounded(exact_dots(p[i], v[j])), np.zeros(len(i), np.int64), ids[mine[i]])


#: Bytes of lower-case text as terms need them: all but a-z and 0-9 are blanks.
BREAKS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
ROWS, BYTES, VOCABULARY = 1024, 1 << 22, 200_000


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a column texts cut to few rows and bytes of text."""
    for batch in batches:
        texts = batch.column("texts")
        ends = np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False))
        size = np.append(0, np.cumsum(pc.binary_length(texts.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)))[ends]
        start = 0
        while start < len(batch):
            most = (size[start - 1] if start else 0) + BYTES
            end = min(start + ROWS, max(start + 1, int(np.searchsorted(size, most, "right"))))
            yield batch.slice(start, end - start)
            start = end


def split(part: pa.RecordBatch) -> tuple[list[list[bytes]], np.ndarray]:
    """(terms of each lower-case text; the row that each text is of)."""
    texts = part.column("texts")
    return [t.translate(BREAKS).split() for t in texts.flatten().to_pylist()], np.repeat(np.arange(len(part)), texts.value_lengths().to_numpy(zero_copy_only=False))


def counted(part: pa.RecordBatch, codes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text; row, code, tf, len of the asked terms). len: terms of the longest of the row's texts that hold the term."""
    terms, of = split(part)
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    flat = np.fromiter((codes.get(t, -1) for ts in terms for t in ts), np.int64, int(size.sum()))
    hit, n = flat >= 0, max(len(codes), 1)
    pair, where, tf = np.unique(np.repeat(of, size)[hit] * n + flat[hit], return_inverse=True, return_counts=True)
    length = np.zeros(len(pair), np.int64)
    np.maximum.at(length, where, np.repeat(size, size)[hit])
    return size, pair // n, pair % n, tf, length


def frequencies(batches: Iterator[pa.RecordBatch], codes: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(code, n, total) of this task's rows: the rows that hold each asked term; as code -1 all texts and their terms."""
    df, n, total = np.zeros(len(codes), np.int64), 0, 0
    for part in parts_of(batches):
        size, _, code, _, _ = counted(part, codes)
        df += np.bincount(code, minlength=len(codes))
        n, total = n + len(size), total + int(size.sum())
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1).astype(np.int32)), pa.array(np.append(df[held], n)), pa.array(np.append(0 * held, total))], ["code", "n", "total"])


def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, tf_total) of parts of this task's texts; a term comes once a part."""
    df, tf = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        names = list(tf)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array([df[t] for t in names], pa.int64()), pa.array([tf[t] for t in names], pa.int64())], ["term", "df", "tf_total"])

    for part in parts_of(batches):
        terms, of = split(part)
        for t in terms:
            tf.update(t)
        if len(of) == len(part):
            for t in terms:
                df.update(set(t))
        else:
            for i in np.unique(of):
                df.update({x for j in np.flatnonzero(of == i) for x in terms[j]})
        if len(tf) > VOCABULARY:
            yield flush()
            df.clear()
            tf.clear()
    yield flush()


class Asked:
    """A block of questions: its terms and their weights."""

    def __init__(self, question: np.ndarray, code: np.ndarray, weight: np.ndarray, at: np.ndarray, n: int, n_codes: int) -> None:
        used = np.unique(code)
        self.n, self.columns = n, len(used)
        self.local = np.full(n_codes, -1)
        self.local[used] = np.arange(len(used))
        order = np.lexsort((at, question))
        q, c = question[order], self.local[code[order]]
        slot = np.arange(len(q)) - np.searchsorted(q, np.arange(n))[q]
        shape = (n, int(slot.max(initial=-1)) + 1)
        # the last column of the counts is empty; unused slots point there
        self.codes, self.weights, self.at = np.full(shape, len(used)), np.zeros(shape), np.zeros(shape, np.int64)
        self.codes[q, slot], self.weights[q, slot], self.at[q, slot] = c, weight[order], at[order]
        self.single = np.zeros((len(used) + 1, n), np.float32)
        self.single[c, q] = weight[order]
        self.margin = 4.0 * (shape[1] + 8) * 2.0**-23

    def exact(self, gain: np.ndarray, row: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, first place of a term that hit) of pairs of a row and a question."""
        score, at = np.zeros(len(row)), np.full(len(row), NAN)
        for j in range(self.codes.shape[1]):
            g = gain[row, self.codes[q, j]]
            score += g * self.weights[q, j]
            at = np.where(g > 0, np.minimum(at, self.at[q, j]), at)
        return score, at


def lexical(batches: Iterator[pa.RecordBatch], codes: dict[bytes, int], names: pa.Array, asked: tuple[np.ndarray, ...], scale: tuple[float, float, float], k: int, block: int = 256) -> Iterator[pa.RecordBatch]:
    """(qid, chunk_id, score, at) of the best rows (chunk_id, texts) of this task by BM25.

    asked: question, code, weight (idf times repeats), at of each term of each question; scale: k1, b, mean number of terms."""
    k1, b, avg_len = scale
    question, code, weight, at = asked
    blocks = []
    for a in range(0, len(names), block):
        some = (question >= a) & (question < a + block)
        n = min(block, len(names) - a)
        blocks.append((a, Asked(question[some] - a, code[some], weight[some], at[some], n, len(codes)), Best(n, k)))
    kind = None
    for part in parts_of(batches):
        kind = part.column("chunk_id").type
        ids = ids_of(part.column("chunk_id"))
        _, row, c, tf, length = counted(part, codes)
        norm = 1.0 if avg_len == 0 else (1 - b) + b * length / avg_len
        gains = tf * (k1 + 1) / (tf + k1 * norm)
        for _, q, best in blocks:
            gain = np.zeros((len(ids), q.columns + 1))
            mine = q.local[c] >= 0
            gain[row[mine], q.local[c[mine]]] = gains[mine]
            approx = gain.astype(np.float32) @ q.single
            least = floor_of(best, slice(0, q.n), approx)
            least = np.where(np.isfinite(least), least - q.margin * np.abs(least) - 2e-9, least)
            x, y = np.nonzero((approx > 0) & (approx >= least.astype(np.float32)))
            for s in range(0, len(x), PAIRS):
                i, j = x[s : s + PAIRS], y[s : s + PAIRS]
                score, first = q.exact(gain, i, j)
                best.add(j, rounded(score), first, ids[i])
    for a, _, best in blocks:
        rows = best.rows()
        if rows:
            q, key, first, ids = rows
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q + a)), pa.array(ids.tolist() if ids.dtype == object else ids, kind), plain(key), pa.array(first)], ["qid", "chunk_id", "score", "at"])
