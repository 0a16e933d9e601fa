"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, each at a node (1 to 255) of a binary tree over bytes. For
every node there is a context tree over the ``depth`` bytes before: each context holds how
often the bit was 0 and 1 in training, its Krichevsky-Trofimov (KT) block probability Pe, and
the weighted probability Pw = (Pe + product of the children's Pw) / 2, at full depth Pe.
A bit's probability mixes the KT estimates of all depths: at a context, its own estimate with
the posterior weight Pe / (2 Pw) and the next deeper mixture with the rest. Where training has
not seen the deeper context, the deepest seen one stands for it. The model is then fixed.

Contexts are dealt by their last two bytes, so each tree below depth 2 is in one bucket; the
depths 0 and 1 have at most 256 * 255 + 255 nodes whatever the corpus and go through the driver.
Blocks send each distinct context-and-byte and each distinct word once, with counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .storage import materialize
from .text import U64, word_hashes, word_spans

LOG2 = float(np.log(2.0))
HALF = -LOG2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
END = 10


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0 (shifted Stirling series)."""
    y = x + 8.0
    p = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    r = 1.0 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - np.log(p)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the KT block probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def stream(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case words of each document, each with a space after it, then END; before each document ``depth`` ENDs.

    Returns the bytes and each document's first position (after its padding), and the total."""
    n = len(offs) - 1
    lens = ends - starts
    doc = np.searchsorted(offs, starts, side="right") - 1
    size = np.bincount(doc, weights=lens + 1, minlength=n).astype(np.int64) + 1 + depth
    base = np.concatenate([[0], np.cumsum(size)])
    out = np.full(base[-1], END, np.uint8)
    if len(starts):
        before = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
        firsts = np.searchsorted(doc, np.arange(n))
        to = base[doc] + depth + before - before[np.minimum(firsts, len(before) - 1)][doc]
        step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        out[np.repeat(to, lens) + step] = LOWER[buf[np.repeat(starts, lens) + step]]
        out[to + lens] = 32
    return out, base


def grams(text: np.ndarray, base: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (bytes before, the last first, then the byte) of all predicted bytes, and where each document's begin."""
    n = len(text) - depth
    key = np.zeros(max(0, n), U64)
    if n <= 0:
        return key, np.zeros(len(base), np.int64)
    for k in range(1, depth + 1):
        key |= text[depth - k : depth - k + n].astype(U64) << U64(8 * (depth + 1 - k))
    key |= text[depth:]
    keep = np.ones(n, dtype=bool)
    for k in range(depth):  # the padding of the next documents isn't predicted
        at = base[1:-1] + k - depth
        keep[at[at >= 0]] = False
    return key[keep], np.concatenate([[0], np.cumsum(np.diff(base) - depth)])


def bucket_of(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    return ((keys >> U64(8 * (depth - 1))) * U64(0x9E3779B1) >> U64(7)) % U64(buckets)


class Trees:
    """Nodes of depth ``low`` and deeper for sorted distinct keys with training counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, low: int) -> None:
        self.depth, self.low = depth, low
        seen = counts > 0
        key, n = keys[seen], counts[seen].astype(np.float64)
        self.nodes: dict[tuple[int, int], tuple] = {}
        below: list[tuple] = []
        for d in range(depth, low - 1, -1):
            if d < depth:  # one byte of context less
                key, inv = np.unique((key >> U64(16)) << U64(8) | key & U64(255), return_inverse=True)
                n = np.bincount(inv, weights=n, minlength=len(key))
            level_pw = []
            for level in range(8):
                node = key >> U64(8 - level)  # context, then the bits before this one
                head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
                u = node[head]
                one = (key >> U64(7 - level) & U64(1)).astype(np.float64)
                total = np.add.reduceat(n, head) if len(head) else n
                n1 = np.add.reduceat(n * one, head) if len(head) else n
                n0 = total - n1
                pe = pw = log_kt(n0, n1)
                w = np.ones(len(u))
                if below:
                    deep, deep_pw = below[level]
                    low_bits = U64((1 << level) - 1)
                    up = (deep >> U64(8 + level)) << U64(level) | deep & low_bits
                    pw = HALF + np.logaddexp(pe, np.bincount(np.searchsorted(u, up), weights=deep_pw, minlength=len(u)))
                    w = np.exp(np.minimum(0.0, HALF + pe - pw))
                self.nodes[d, level] = (u, n0, n1, w)
                level_pw.append((u, pw))
            below = level_pw
        self.top = below

    def top_nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the shallowest depth: parent context and node (heap order), n0, n1, log Pw."""
        out = []
        for level, (u, pw) in enumerate(self.top):
            heap = u & U64((1 << level) - 1) | U64(1 << level)
            parent = (u >> U64(level + 8)) & U64(0xFFFFFFFFFFFF)
            out.append(((parent << U64(8) | heap).astype(np.int64), *self.nodes[self.low, level][1:3], pw))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def mixture(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For keys and the eight bits of their byte: the mixture of the depths here, and whether any was seen."""
        out, got = np.zeros((8, len(keys))), np.zeros((8, len(keys)), dtype=bool)
        ctx, sym = keys >> U64(8), keys & U64(255)
        for level in range(8):
            bits = sym >> U64(8 - level)
            bit = sym >> U64(7 - level) & U64(1) > 0
            for d in range(self.depth, self.low - 1, -1):
                u, n0, n1, w = self.nodes[d, level]
                if not len(u):
                    continue
                k = ctx >> U64(8 * (self.depth - d)) << U64(level) | bits
                i = np.minimum(np.searchsorted(u, k), len(u) - 1)
                hit = u[i] == k
                a, b = n0[i], n1[i]
                kt = (np.where(bit, b, a) + 0.5) / (a + b + 1.0)
                out[level] = np.where(hit, np.where(got[level], w[i] * kt + (1 - w[i]) * out[level], kt), out[level])
                got[level] |= hit
        return out, got


def top_weights(rows: pd.DataFrame) -> np.ndarray:
    """(257, 256, 3): of each depth-1 context (256: depth 0) and node: n0, n1, weight; n0 = -1 where unseen."""
    t = np.full((257, 256, 3), -1.0)
    if len(rows):
        k = rows["node"].to_numpy(np.int64)
        n0, n1, kids = (rows[c].to_numpy(float) for c in ("n0", "n1", "kids"))
        pe = log_kt(n0, n1)
        pw = HALF + np.logaddexp(pe, kids)
        t[k >> 8, k & 255] = np.stack([n0, n1, np.exp(np.minimum(0, HALF + pe - pw))], 1)
        m0, m1, deep = (np.bincount(k & 255, weights=x, minlength=256) for x in (n0, n1, pw))
        seen = np.bincount(k & 255, minlength=256) > 0
        pe = log_kt(m0, m1)
        w = np.exp(np.minimum(0, HALF + pe - (HALF + np.logaddexp(pe, deep))))
        t[256][seen] = np.stack([m0, m1, w], 1)[seen]
    return t


def log_probability(trees: Trees, top: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """log2 of the probability of the last byte of each key after its context."""
    q, got = trees.mixture(keys)
    c1, sym = (keys >> U64(8 * trees.depth)).astype(np.int64), (keys & U64(255)).astype(np.int64)
    total = np.zeros(len(keys))
    for level in range(8):
        node = (1 << level) | (sym >> (8 - level))
        bit = sym >> (7 - level) & 1
        x, seen = q[level], got[level]
        for row in (top[c1, node], top[np.full(len(keys), 256), node]):
            n0, n1, w = row.T
            here = n0 >= 0
            kt = (np.where(bit > 0, n1, n0) + 0.5) / (n0 + n1 + 1.0)
            x = np.where(here, np.where(seen, w * kt + (1 - w) * x, kt), x)
            seen = seen | here
        total += np.log2(np.where(seen, x, 0.5))
    return total


def _held(block: B.Block, held_out: tuple[int, int] | None) -> np.ndarray:
    ids = block.id_list()
    if held_out is None:
        return np.zeros(len(ids), dtype=bool)
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % held_out[0] == held_out[1] for i in ids], dtype=bool)


def _keys(block: B.Block, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a block and where each document's begin."""
    keys, at = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for _, _, buf, offs in block.batches():
        k, o = grams(*stream(buf, offs, *word_spans(buf), depth), depth)
        keys.append(k)
        at.append(o[1:] + at[-1][-1])
    return np.concatenate(keys), np.concatenate(at)


def _words(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of a block and where each document's begin."""
    words, at = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for _, _, buf, offs in block.batches():
        s, e = word_spans(buf)
        words.append(word_hashes(LOWER[buf], s, e))
        at.append(np.searchsorted(s, offs)[1:] + at[-1][-1])
    return np.concatenate(words), np.concatenate(at)


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted distinct values, those), by hashing; only the distinct values are sorted."""
    code, u = pd.factorize(values)
    order = np.argsort(u)
    place = np.empty(len(u), np.int32)
    place[order] = np.arange(len(u), dtype=np.int32)
    return place[code], u[order]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    u, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return u, np.bincount(inv, weights=np.concatenate([p[1] for p in parts]), minlength=len(u)).astype(np.int64)


def _pack(a: np.ndarray, z: zstandard.ZstdCompressor) -> bytes:
    if a.dtype == U64:
        a = np.diff(a, prepend=U64(0))
    return z.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())


def _unpack(x: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    a = np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()
    return np.cumsum(a, dtype=U64) if np.dtype(dtype) == U64 else a


def ctw_score(docs: DataFrame, depth: int = 6, held_out: tuple[int, int] | None = (7, 2)) -> DataFrame:
    """Score every text under the context trees of the training texts, beside a unigram base.

    docs: doc_id, text; other columns are ignored. held_out (m, r): rows with crc32(doc_id as
    text) mod m = r are scored only; None: all rows train. One row per input row: doc_id,
    held_out, n_tokens (words and one end), n_known, train_tokens, base_score and score (log10
    probabilities of the token sequence), n_bytes (predicted bytes: the words, a space after
    each, the end) and bits_per_byte (code length). Null and empty texts are one end. Repeated
    rows count as often as they stand there. An empty table gives no row; a null id hashes as ''.
    """
    bl = B.pack(docs)
    buckets = B.bucket_count(bl)

    def send(block: B.Block) -> pd.DataFrame:
        keys, at = _keys(block, depth)
        train = np.repeat(~_held(block, held_out), np.diff(at))
        code, key = _coded(keys)
        n = np.bincount(code, weights=train, minlength=len(key)).astype(np.int64)
        z = zstandard.ZstdCompressor(level=3)
        to = bucket_of(key, depth, buckets)
        rows = [(k, block.block, _pack(key[x], z), _pack(n[x], z)) for k in range(buckets) if (x := to == k).any()]
        return pd.DataFrame(rows, columns=["bucket", "block", "key", "n"]).astype({"bucket": "int32", "block": "int64"})

    def send_words(block: B.Block) -> pd.DataFrame:
        words, at = _words(block)
        train = ~_held(block, held_out)
        code, word = _coded(words)
        m = np.bincount(code, weights=np.repeat(train, np.diff(at)), minlength=len(word)).astype(np.int64)
        z = zstandard.ZstdCompressor(level=3)
        to = word % U64(buckets)
        rows = [(k, block.block, _pack(word[x := to == k], z), _pack(m[x], z), int(m[x].sum()), int(train.sum()) * (k == 0)) for k in range(buckets)]
        return pd.DataFrame(rows, columns=["bucket", "block", "word", "m", "words", "ends"]).astype({"bucket": "int32", "block": "int64", "words": "int64", "ends": "int64"})

    def count_words(pdf: pd.DataFrame) -> pd.DataFrame:
        z = zstandard.ZstdCompressor(level=3)
        asked = [_unpack(x, U64) for x in pdf["word"]]
        word, m = _merge(list(zip(asked, (_unpack(x, np.int64) for x in pdf["m"]), strict=True)))
        return pd.DataFrame(
            {"block": pdf["block"], "bucket": pdf["bucket"], "lp": None, "c": [_pack(m[np.searchsorted(word, x)], z) for x in asked]}
        ).assign(words=int(pdf["words"].sum()), ends=int(pdf["ends"].sum()), types=int((m > 0).sum()))

    sent = materialize(B.ask(bl, send, "bucket int, block long, key binary, n binary"), "ctw-sent")
    reply = "block long, bucket int, lp binary, c binary, words long, ends long, types long"
    words = B.ask(bl, send_words, "bucket int, block long, word binary, m binary, words long, ends long").groupBy("bucket").applyInPandas(count_words, reply)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        z = zstandard.ZstdCompressor(level=3)
        key, n = _merge([(_unpack(a, U64), _unpack(b, np.int64)) for a, b in zip(pdf["key"], pdf["n"], strict=True)])
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1].to_numpy(), "key": [_pack(key, z)], "n": [_pack(n, z)]})

    model = materialize(sent.groupBy("bucket").applyInPandas(merged, "bucket int, key binary, n binary"), "ctw-model")

    def tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, n in zip(pdf["key"], pdf["n"], strict=True):
                node, n0, n1, pw = Trees(_unpack(key, U64), _unpack(n, np.int64), depth, 2).top_nodes()
                k, inv = np.unique(node, return_inverse=True)
                yield pd.DataFrame({"node": k, **{c: np.bincount(inv, weights=x, minlength=len(k)) for c, x in (("n0", n0), ("n1", n1), ("kids", pw))}})

    by_node = model.select("key", "n").mapInPandas(tops, "node long, n0 double, n1 double, kids double").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "kids")))
    top = top_weights(by_node.toPandas())  # 65,536 rows at most

    def answer(_, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        z = zstandard.ZstdCompressor(level=3)
        key, n = _unpack(own["key"].iloc[0], U64), _unpack(own["n"].iloc[0], np.int64)
        lp = log_probability(Trees(key, n, depth, 2), top, key).astype(np.float32)
        lp = ((lp.view(np.uint32) + np.uint32(128)) & np.uint32(0xFFFFFF00)).view(np.float32)  # 16 significant bits travel
        return pd.DataFrame({"block": asked["block"], "bucket": asked["bucket"], "lp": [_pack(lp[np.searchsorted(key, _unpack(x, U64))], z) for x in asked["key"]], "c": None}).assign(words=0, ends=0, types=0)

    told = sent.select("bucket", "block", "key").groupBy("bucket").cogroup(model.groupBy("bucket")).applyInPandas(answer, reply).unionByName(words)

    def last(block: B.Block, pdf: pd.DataFrame) -> pd.DataFrame:
        held = _held(block, held_out)
        keys, at = _keys(block, depth)
        code, key = _coded(keys)
        del keys
        words, woffs = _words(block)
        words_code, word = _coded(words)
        to, deal = bucket_of(key, depth, buckets), word % U64(buckets)
        lp, count = np.zeros(len(key)), np.zeros(len(word), np.int64)
        for k, x, c in zip(pdf["bucket"], pdf["lp"], pdf["c"], strict=True):
            if x is not None:
                lp[to == k] = _unpack(x, np.float32)
            if c is not None:
                count[deal == k] = _unpack(c, np.int64)
        end_total = int(pdf["ends"].sum())
        tokens, types = int(pdf["words"].sum()) + end_total, int(pdf["types"].sum()) + (end_total > 0)
        scale = np.log10(tokens + types + 1.0)
        base_end = np.log10(end_total + 1.0) - scale
        logs = np.log10(count + 1.0) - scale
        x = np.concatenate([[0.0], np.cumsum(lp[code])])
        y, known = np.concatenate([[0.0], np.cumsum(logs[words_code])]), np.concatenate([[0], np.cumsum(count[words_code] > 0)])
        out = pd.DataFrame(
            {
                "n_tokens": np.diff(woffs) + 1,
                "n_known": known[woffs[1:]] - known[woffs[:-1]] + int(end_total > 0),
                "base_score": y[woffs[1:]] - y[woffs[:-1]] + base_end,
                "score": (x[at[1:]] - x[at[:-1]]) * float(np.log10(2.0)),
                "n_bytes": np.diff(at),
            }
        )
        out.insert(0, "doc_id", pd.array(block.id_list(), dtype="Int64"))
        out.insert(1, "held_out", held)
        out["train_tokens"] = np.int64(tokens)
        out["bits_per_byte"] = -out["score"] / float(np.log10(2.0)) / out["n_bytes"]
        return out[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]]

    return B.again(bl, told, last, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
