"""Toxicity scores of noisy-channel restored text.

Restoration: a token of letters with digits or symbols, with a letter three times in a row, or
a run of single characters is read as what a noisy channel made of a hidden word: leetspeak
substitutions, inserted separators and spaces, repeated letters. Viterbi decoding over that
character lattice, all its states kept, under a trigram character model gives the likeliest hidden
word: once where a repeated letter may stand for one, and once where doubled letters stay. Tokens of
any length are decoded, long ones in overlapping pieces. Other tokens are their own restoration.
A word that blanks cut into longer parts isn't put together.

Scoring: from all labelled rows a lexicon of word and word-beginning hashes is learned with
log-odds of presence; a text is described by its strongest distinct hits and its length, and
a logistic regression maps that to a probability at the labels' true share.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .text import BYTE64, U64, _P, _PINV, isin_sorted, mix64, powers, word_spans

LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = set(".-_*~'`^,:;/\\ ")
BEGINNINGS = (4, 5, 6, 7, 8, 9)
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = True
LETTER[128:] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "013456789@$!|+(.-_*~'`^,:;/\\"]] = True
SYMBOL[0xE2] = True  # where the euro sign begins
#: Punctuation around words; what stands for a letter stays.
OUTER = np.zeros(256, dtype=bool)
OUTER[[ord(c) for c in ".,;:?\"')[]{}<>&#*%"]] = True
PIECE, LAP = 192, 64


class Channel:
    """Trigram character model and the lattice decoder."""

    def __init__(self, trigrams: dict[str, int]) -> None:
        self.tri = trigrams
        self.bi: dict[str, int] = {}
        for k, v in trigrams.items():
            self.bi[k[:2]] = self.bi.get(k[:2], 0) + v
        self._restore = None

    def __getstate__(self) -> dict:
        return {"tri": self.tri, "bi": self.bi, "_restore": None}

    def cost(self, a: str, b: str, c: str) -> float:
        return -math.log((self.tri.get(a + b + c, 0) + 0.05) / (self.bi.get(a + b, 0) + 2.0))

    def restore(self, token: str) -> tuple[str, ...]:
        """The readings of a token: with repeated letters as one, and with doubled letters kept."""
        if self._restore is None:
            self._restore = lru_cache(maxsize=50_000)(self._readings)
        return self._restore(token)

    def _readings(self, token: str) -> tuple[str, ...]:
        twice = re.sub(r"(.)\1{2,}", r"\1\1", token)
        one = self._decode(token, True)
        return (one,) if re.search(r"(.)\1", twice) is None else tuple(dict.fromkeys((one, self._decode(twice, False))))

    def _decode(self, token: str, merge: bool) -> str:
        states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
        for ch in token:
            new: dict[str, tuple[float, tuple | None]] = {}
            # (emitted letters, channel cost)
            moves = [(ch, 0.0)] if ch.isalpha() else [(x, 0.7) for x in LEET.get(ch, "")]
            drop = 0.4 if ch in SEPARATORS else 5.0 if not ch.isalpha() else None
            for state, (cost, back) in states.items():
                for x, extra in moves:
                    c = cost + extra + self.cost(state[0], state[1], x)
                    if (s := state[1] + x) not in new or c < new[s][0]:
                        new[s] = (c, (back, x))
                    if merge and x == state[1]:  # a repeated letter stands for one
                        c = cost + extra + 0.2
                        if state not in new or c < new[state][0]:
                            new[state] = (c, back)
                if drop is not None and (state not in new or cost + drop < new[state][0]):
                    new[state] = (cost + drop, back)
            states = new
        back = min(((c + self.cost(s[0], s[1], "$"), s, b) for s, (c, b) in states.items()), key=lambda x: x[:2])[2]
        out = []
        while back is not None:
            back, x = back[0], back[1]
            out.append(x)
        return "".join(reversed(out))


def _bare(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the punctuation around them; a word of punctuation alone is empty."""
    inner = np.flatnonzero(~OUTER[buf])
    if not len(inner):
        return starts, starts
    first = np.searchsorted(inner, starts)
    last = np.searchsorted(inner, ends) - 1
    some = last >= first
    return np.where(some, inner[np.minimum(first, len(inner) - 1)], starts), np.where(some, inner[np.maximum(last, 0)] + 1, starts)


def _pieces(token: str) -> Iterator[str]:
    for k in range(0, max(1, len(token) - LAP), PIECE - LAP):
        yield token[k : k + PIECE]


def suspicious(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, str]]:
    """(first word, token) of what may be obfuscated; a run of single characters is one token."""
    out: list[tuple[int, str]] = []
    n = len(buf)
    if n < 3:
        return out
    s, e = _bare(buf, starts, ends)
    triple = np.zeros(n, dtype=bool)
    triple[:-2] = LETTER[buf[:-2]] & (buf[:-2] == buf[1:-1]) & (buf[1:-1] == buf[2:]) & (buf[:-2] < 128)
    letters, symbols, triples, heads = (np.concatenate([[0], np.cumsum(x)]) for x in (LETTER[buf], SYMBOL[buf], triple, (buf & 0xC0) != 0x80))
    odd = (letters[e] > letters[s]) & ((symbols[e] > symbols[s]) | (triples[e] > triples[s])) & (e - s >= 3)
    for k in np.flatnonzero(odd).tolist():
        out.extend((k, x) for x in _pieces(bytes(buf[s[k] : e[k]]).decode("utf-8", "replace")))
    single = np.concatenate([[False], heads[e] - heads[s] == 1, [False]])
    edge = np.flatnonzero(single[1:] != single[:-1])
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= 3:
            word = "".join(bytes(buf[s[k] : e[k]]).decode("utf-8", "replace") for k in range(a, b))
            if any(map(str.isalpha, word)):
                out.extend((a, x) for x in _pieces(word))
    return out


def features(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, hash) of all letter runs and of their beginnings."""
    mask = np.concatenate([[False], LETTER[buf], [False]])
    edge = np.flatnonzero(mask[1:] != mask[:-1])
    s, e = edge[0::2], edge[1::2]
    use = e - s >= 3
    s, e = s[use], e[use]
    if not len(s):
        return s, np.zeros(0, U64)
    c = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE64[buf] * powers(_P, len(buf)), dtype=U64)])
    inv = powers(_PINV, len(buf))[s]
    at, h = [s], [mix64((c[e] - c[s]) * inv)]
    for k in BEGINNINGS:
        longer = e - s > k
        p = s[longer]
        at.append(p)
        h.append(mix64((c[p + k] - c[p]) * inv[longer] + U64(k)))
    return np.concatenate(at), np.concatenate(h)


def _words_in(word: str) -> bytes:
    """A restored token, and its endings, as separate words: a hidden word may begin inside. Far from the end they are cut
    where no beginning reaches."""
    n = len(word)
    return " ".join([word, *(word[k:] if n - k <= 60 else word[k : k + 12] for k in range(1, n - 2))]).encode() + b" "


class Scorer:
    """Lexicon, channel and regression."""

    def __init__(self, channel: Channel, lexicon: np.ndarray, weights: np.ndarray, coef: np.ndarray | None = None) -> None:
        self.channel, self.lexicon, self.weights, self.coef = channel, lexicon, weights, coef

    def hits(self, texts: list[bytes]) -> list[np.ndarray]:
        """Weights of the distinct lexicon entries of each text, the largest first."""
        low = [t.decode("utf-8", "replace").lower().encode("utf-8", "replace") for t in texts]
        extra = []
        for t in low:
            buf = np.frombuffer(t + b"\n", np.uint8)
            s, e = word_spans(buf)
            extra.append(b" ".join(_words_in(r) for _, x in suspicious(buf, s, e) for r in self.channel.restore(x)))
        whole = [a + b"\n" + b for a, b in zip(low, extra, strict=True)]
        buf = np.frombuffer(b"\n".join(whole) + b"\n", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in whole])
        at, h = features(buf)
        keep = isin_sorted(h, self.lexicon)
        at, k = at[keep], np.searchsorted(self.lexicon, h[keep])
        doc = np.searchsorted(ends, at, side="right")
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        if len(doc):
            pair = np.unique(doc * np.int64(len(self.lexicon)) + k)
            d, w = pair // len(self.lexicon), self.weights[pair % len(self.lexicon)]
            for x in np.unique(d):
                out[int(x)] = np.sort(w[d == x])[::-1]
        return out

    def describe(self, texts: list[bytes]) -> np.ndarray:
        rows = np.zeros((len(texts), 6))
        for k, (w, t) in enumerate(zip(self.hits(texts), texts, strict=True)):
            top = np.concatenate([w[:4], np.zeros(4)])
            rows[k] = 1.0, top[0], top[1], top[2] + top[3], np.log1p(len(t)) - 7, np.log1p(len(w))
        return rows

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.describe(texts) @ self.coef, -30, 30)))


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gradient and, row by row, second derivatives of the weighted logistic loss."""
    p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
    return np.concatenate([x.T @ (w * (p - y)), ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], n: int, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression by Newton steps; ``sums`` adds up _sums() of all rows."""
    b = np.zeros(n)
    for _ in range(60):
        s = sums(b)
        step = np.linalg.solve(s[n:].reshape(n, n) + ridge * np.eye(n), s[:n] + ridge * b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), sample_rows: int | None = None) -> Scorer | None:
    """Fit on all labelled rows outside the held-out part, or on about ``sample_rows`` of each label, chosen by a hash of the id:
    lexicon and channel on six tenths of them, the regression on the rest. None: no row, or one label only."""
    key = F.col("doc_id").cast("string")
    lab = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(key) % held_out[0] != held_out[1]))
    sizes = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}  # two rows
    if len(sizes) < 2:
        return None
    if sample_rows is not None:
        part = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample_rows / sizes[1]))).otherwise(F.lit(min(1.0, sample_rows / sizes[0])))
        lab = lab.where(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 20)) < part * (1 << 20))
    picked = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    late = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(10)) < 4
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).where(F.col("text").isNotNull() & (F.crc32(key) % held_out[0] != held_out[1]))
    early_rows, late_rows = (texts.where(part).join(picked.hint("shuffle_hash"), "doc_id").select("text", "toxic") for part in (~late, late))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dfs: dict[int, list] = {0: [], 1: []}
            tri: dict[str, int] = {}
            n = [0, 0]
            words: Counter[str] = Counter()
            for text, toxic in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                low = text.decode("utf-8", "replace").lower()
                n[toxic] += 1
                dfs[toxic].append(np.unique(features(np.frombuffer(low.encode("utf-8", "replace") + b"\n", np.uint8))[1]))
                words.update(re.findall(r"[^\W\d_]+", low))
            for w, m in words.items():
                w = "^^" + w + "$"
                for k in range(len(w) - 2):
                    tri[w[k : k + 3]] = tri.get(w[k : k + 3], 0) + m
            names = ["kind", "h", "g", "c0", "c1"]
            for k in (0, 1):
                u, m = np.unique(np.concatenate(dfs[k] or [np.zeros(0, U64)]), return_counts=True)
                c = [pa.array(m.astype(np.int64)), pa.array(np.zeros(len(u), np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(u), np.int32)), pa.array(u.view(np.int64)), pa.nulls(len(u), pa.string()), *(c if k == 0 else c[::-1])], names=names)
            rows = [(1, 0, g, m, 0) for g, m in tri.items()] + [(2, 0, None, *n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=names)

    counted = early_rows.mapInArrow(count, "kind int, h long, g string, c0 long, c1 long").groupBy("kind", "h", "g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    got = counted.where("kind > 0 OR c1 >= 3").toArrow()  # distinct trigrams, and word beginnings of several toxic texts
    kind, h, c0, c1 = (got.column(k).to_numpy() for k in ("kind", "h", "c0", "c1"))
    if not (kind == 2).any() or not c0[kind == 2][0] or not c1[kind == 2][0]:
        return None
    n0, n1 = int(c0[kind == 2][0]), int(c1[kind == 2][0])
    tri = {g: int(m) for g, m, k in zip(got.column("g").to_pylist(), c0, kind, strict=True) if k == 1}
    feature = kind == 0
    order = np.argsort(h[feature].view(U64))
    u1, neg, c1 = h[feature].view(U64)[order], c0[feature][order].astype(float), c1[feature][order].astype(float)
    w = np.log((c1 + 0.3) / (n1 + 0.6)) - np.log((neg + 0.3) / (n0 + 0.6))
    strong = w > 1.0
    scorer = Scorer(Channel(tri), u1[strong], w[strong])

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(scorer)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, toxic = (b.column(k).to_pylist() for k in range(2))
            x = [sent.value.describe(text[k : k + 200]) for k in range(0, len(text), 200)]
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), *(pa.array(c) for c in np.concatenate(x).T)], names=names)

    names = ["y", *(f"x{k}" for k in range(6))]
    seen = materialize(late_rows.mapInArrow(describe, "y int, " + ", ".join(f"{n} double" for n in names[1:])), "described")
    found = {r["y"]: r["count"] for r in seen.groupBy("y").count().collect()}  # two rows
    if len(found) < 2:
        scorer.coef = np.array([np.log(sizes[1] / sizes[0]) - 2.0, 0.8, 0.5, 0.2, 0.0, 0.0])
        return scorer
    share, mean = sizes[1] / (sizes[0] + sizes[1]), found[1] / (found[0] + found[1])

    def sums(b: np.ndarray) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(42)
            for batch in batches:
                y, *x = (c.to_numpy() for c in batch.columns)
                total += _sums(np.stack(x, axis=1), y, np.where(y == 1, share / mean, (1 - share) / (1 - mean)), b)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(42)), pa.array(total)], names=["k", "v"])

        out = np.zeros(42)
        for r in seen.mapInArrow(add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # 42 rows
            out[r["k"]] = r["v"]
        return out

    scorer.coef = _newton(sums, 6)
    return scorer


def toxicity(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), sample_rows: int | None = None) -> DataFrame:
    """Score every whole text.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; others and nulls are not learned from).
    One row per input row: doc_id, held_out (crc32(doc_id as text) mod 5 is 0), score and
    predicted. Null and empty texts score as texts without a
    hit. Without both labels to learn from, every score is 0. Repeated rows score alike; an empty
    table gives no row; a null id hashes as '' and matches no label.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    sent = spark.sparkContext.broadcast(train(docs, labels, held_out, sample_rows))  # a lexicon, trigrams and six coefficients

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        for b in batches:
            ids, texts = b.column(0), [t or b"" for t in b.column(1).to_pylist()]
            held = [zlib.crc32(b"" if i is None else str(i).encode()) % held_out[0] == held_out[1] for i in ids.to_pylist()]
            n = len(texts)
            score = np.concatenate([scorer.score(texts[k : k + 200]) for k in range(0, n, 200)]) if scorer and n else np.zeros(n)
            yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
