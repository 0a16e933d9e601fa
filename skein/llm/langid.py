"""Language identification by interpolated Kneser-Ney character models.

One model per language: characters are lower-case letters, all else is a space, runs of spaces
are one. The highest order takes counts, lower orders count distinct left neighbours, each
order gives an absolute discount to the next. Grams and contexts are kept as sorted arrays of
64-bit codes. A text gets the language of the lowest cross-entropy per character. It is rejected
if that entropy is implausible for the language: above the mean of calibration texts by more
than ``limit`` standard deviations, where the deviation has a part between texts and a part that
falls with the length of the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import U64, isin_sorted, lean

ORDER = 4
SAMPLE_ROWS = 1500
CACHE = 400_000
#: Texts that are scored at once.
AT_ONCE = 100
_luts: list[np.ndarray] = []


def _lut() -> np.ndarray:
    """Code point (16 bits; others by their low bits in the private range) to lower-case letter or space."""
    if not _luts:
        t = np.full(65536, 32, np.uint16)
        for c in range(65536):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                low = chr(c).lower()
                t[c] = ord(low) if len(low) == 1 else c
        _luts.append(t)
    return _luts[0]


def characters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of the texts, one after the other, and their offsets."""
    raw = b"\n".join(texts) + b"\n"
    cp = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    x = _lut()[(cp & 0xFFFF).astype(np.uint16)]
    high = cp > 0xFFFF
    if high.any():
        alpha = np.array([chr(c).isalpha() for c in cp[high]], dtype=bool)
        x[high] = np.where(alpha, 0xE000 | (cp[high] & 0xFFF), 32)
    # where each text ends in code points
    lens = np.array([len(t) for t in texts], np.int64)
    starts8 = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    count = np.cumsum(starts8) if len(cp) == int(starts8.sum()) else None
    ends8 = np.cumsum(lens + 1)
    ends = count[ends8 - 1] if count is not None else np.cumsum([len(t.decode("utf-8", "replace")) + 1 for t in texts])
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    keep[0] = x[0] != 32
    kept = np.concatenate([[0], np.cumsum(keep)])
    return x[keep], np.concatenate([[0], kept[ends]])


def codes(x: np.ndarray, offs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Code of the ``order`` characters that end at each position; before a text stand spaces."""
    n = len(x)
    out = x.astype(U64)
    pos = np.arange(n) - np.repeat(offs[:-1], np.diff(offs))
    for k in range(1, order):
        prev = np.full(n, 32, U64)
        prev[k:] = x[: n - k]
        out |= np.where(pos >= k, prev, U64(32)) << U64(16 * k)
    return out


class Model:
    """Interpolated Kneser-Ney over codes: p(last character | the characters before it)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int = ORDER) -> None:
        self.order, self.tables = order, []
        g, c = grams, counts.astype(float)
        for k in range(order, 0, -1):
            n1, n2 = float((c == 1).sum()), float((c == 2).sum())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            h, inv = np.unique(g >> U64(16), return_inverse=True)
            total = np.bincount(inv, weights=c, minlength=len(h))
            kinds = np.bincount(inv, minlength=len(h))
            self.tables.append((g, np.maximum(c - d, 0) / total[inv], h, d * kinds / total))
            if k > 1:
                low = g & U64((1 << (16 * (k - 1))) - 1)
                g, cnt = np.unique(low, return_counts=True)
                c = cnt.astype(float)
        self.uniform = 1.0 / (len(self.tables[-1][0]) + 1.0)

    def log2(self, grams: np.ndarray) -> np.ndarray:
        """log2 p of sorted or unsorted codes."""
        p = np.full(len(grams), self.uniform)
        for k, (g, a, h, b) in zip(range(1, self.order + 1), reversed(self.tables), strict=True):
            q = grams & U64((1 << (16 * k)) - 1)
            i = np.minimum(np.searchsorted(g, q), max(0, len(g) - 1))
            j = np.minimum(np.searchsorted(h, q >> U64(16)), max(0, len(h) - 1))
            seen = h[j] == q >> U64(16)
            p = np.where(seen, np.where(g[i] == q, a[i], 0.0) + b[j] * p, p)
        return np.log2(p)


def _count(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x, offs = characters(texts)
    return np.unique(codes(x, offs), return_counts=True)


class Identifier:
    """Models of all languages, with a bounded cache of codes already scored."""

    def __init__(self, langs: list[str], models: list[Model], calibration: np.ndarray | None = None, heat: float = 1.0) -> None:
        self.langs, self.models, self.calibration, self.heat = langs, models, calibration, heat
        self.known, self.values = np.zeros(0, U64), np.zeros((0, len(langs)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": np.zeros(0, U64), "values": np.zeros((0, len(self.langs)))}

    def _values(self, u: np.ndarray) -> np.ndarray:
        hit = isin_sorted(u, self.known)
        new = np.sort(u[~hit])
        if len(new):
            if len(self.known) + len(new) > CACHE:
                self.known, self.values, new = np.zeros(0, U64), np.zeros((0, len(self.langs))), np.sort(u)
            v = np.stack([m.log2(new) for m in self.models], 1)
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.values = known[order], np.concatenate([self.values, v])[order]
        return self.values[np.searchsorted(self.known, u)]

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits per character by text and language, letters and spaces of each text, letters)."""
        x, offs = characters(texts)
        inv, u = pd.factorize(codes(x, offs))
        v = self._values(u) if len(u) else np.zeros((0, len(self.langs)))
        n = np.diff(offs)
        letters = np.diff(np.concatenate([[0], np.cumsum(x != 32)])[offs])
        out = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(n)
        for k in range(len(self.langs)):
            if len(full):
                out[full, k] = -np.add.reduceat(v[:, k][inv], offs[:-1][full])
        return out / np.maximum(n, 1)[:, None], n, letters

    def predict(self, texts: list[bytes]) -> pd.DataFrame:
        h, n, letters = self.entropies(texts)
        best = h.argmin(1)
        rows = np.arange(len(h))
        w = np.exp2(-(h - h[rows, best][:, None]) * (self.heat * np.sqrt(np.maximum(n, 1)))[:, None])
        mean, between, within = self.calibration.T
        far = (h[rows, best] - mean[best]) / np.sqrt(between[best] ** 2 + within[best] ** 2 / np.maximum(n, 1))
        some = letters > 0
        return pd.DataFrame(
            {
                "lang_pred": np.where(some, np.array(self.langs, dtype=object)[best], "und"),
                "score": np.where(some, 1.0 / w.sum(1), 0.0),
                "bits_per_char": np.where(some, h[rows, best], 0.0),
                "deviation": np.where(some, far, 0.0),
                "letters": letters,
            }
        )


def train(docs: DataFrame, held_out: tuple[int, int] = (4, 2), sample_rows: int = SAMPLE_ROWS) -> Identifier | None:
    """Fit on about ``sample_rows`` rows per language, chosen by a hash of the id, of rows with a text and a lang
    and crc32(doc_id as text) mod held_out[0] other than held_out[1]. A fifth calibrates. None: no such row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(key.alias("k"), "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(key) % held_out[0] != held_out[1]))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample_rows / n))) for k, n in sizes.items()])
    picked = rows.where(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)).select("lang", F.col("text").cast("binary").alias("text"), (F.pmod(F.xxhash64("k", F.lit(11)), F.lit(5)) == 0).alias("late"))

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            by: dict[str, list[bytes]] = {}
            for lang, text, late in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if not late:
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                g, c = _count(texts)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([g.tobytes()], pa.binary()), pa.array([c.astype(np.int64).tobytes()], pa.binary())], names=["lang", "g", "c"])

    parts = picked.mapInArrow(lean(count), "lang string, g binary, c binary").collect()  # of the bounded sample
    langs, models = [], []
    for lang in sorted(sizes):
        own = [p for p in parts if p["lang"] == lang]
        g = np.concatenate([np.frombuffer(p["g"], U64) for p in own] or [np.zeros(0, U64)])
        c = np.concatenate([np.frombuffer(p["c"], np.int64) for p in own] or [np.zeros(0, np.int64)])
        if len(g):
            u, inv = np.unique(g, return_inverse=True)
            langs.append(lang)
            models.append(Model(u, np.bincount(inv, weights=c)))
    if not langs:  # tiny tables: everything fell into the calibration part
        return None
    ident = Identifier(langs, models)
    where = {k: i for i, k in enumerate(langs)}

    def calibrate(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            lang, text, late = (b.column(k).to_pylist() for k in range(3))
            use = [k for k in range(len(lang)) if late[k] and lang[k] in where]
            if use:
                h, n, _ = ident.entropies([text[k] for k in use])
                yield pa.RecordBatch.from_arrays([pa.array([where[lang[k]] for k in use], pa.int32()), pa.array(n), pa.array(list(map(list, h)), pa.list_(pa.float64()))], names=["y", "n", "h"])

    seen = [r for r in picked.mapInArrow(lean(calibrate), "y int, n long, h array<double>").collect() if r["n"] >= 20]
    y, n, h = np.array([r["y"] for r in seen], int), np.array([r["n"] for r in seen], float), np.array([r["h"] for r in seen]).reshape(len(seen), len(langs))
    cal = np.zeros((len(langs), 3))
    for k in range(len(langs)):
        own, m = h[y == k, k], n[y == k]
        own, m = own[own <= np.percentile(own, 99)] if len(own) > 20 else own, m[own <= np.percentile(own, 99)] if len(own) > 20 else m
        mean = float(np.average(own, weights=m)) if len(own) else 4.0
        cal[k] = mean, max(0.1, float(np.sqrt(np.average((own - mean) ** 2, weights=m))) if len(own) else 0.5), 3.0
    ident.calibration = cal
    if len(seen):
        diff = h - h[np.arange(len(seen)), y][:, None]

        def loss(heat: float) -> float:
            return float(np.log1p(np.exp2(-np.clip(diff * (heat * np.sqrt(n))[:, None], -500, 500)).sum(1) - 1).mean())

        ident.heat = min((0.05 * 1.5**k for k in range(14)), key=loss)
    return ident


def identify(docs: DataFrame, held_out: tuple[int, int] = (4, 2), sample_rows: int = SAMPLE_ROWS, limit: float = 6.0, columns: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text.

    docs: doc_id, text, lang; ``columns`` are passed through, others ignored. One row per input row:
    doc_id, held_out, lang_pred (``und`` if the text is null or has no letter, or nothing could be
    learned), score (posterior, 0 to 1; 0 for ``und``), bits_per_char, rejected (und, or entropy
    ``limit`` deviations above the language's). Ties go to the first language in order. A null
    id hashes as ''. Repeated rows get equal results; an empty table gives no row.
    """
    ident = train(docs, held_out, sample_rows)
    sent = docs.sparkSession.sparkContext.broadcast(ident)  # bounded by the sample
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    extra = [c for c in columns if c not in ("doc_id",)]
    private = [f"__{k}" for k in range(len(extra))]  # so that none clashes with a result
    src = docs.select(F.col("text").cast("string").cast("binary").alias("__text"), F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"`{c}`").alias(n) for c, n in zip(extra, private, strict=True)))
    names = ["doc_id", *private]
    schema = T.StructType(src.schema.fields[1:])
    for c, kind in (("held_out", "boolean"), ("lang_pred", "string"), ("score", "double"), ("bits_per_char", "double"), ("rejected", "boolean")):
        schema.add(c, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            texts = [t or b"" for t in b.column(0).to_pylist()]
            held = pa.array([zlib.crc32(b"" if i is None else str(i).encode()) % held_out[0] == held_out[1] for i in b.column(1).to_pylist()], pa.bool_())
            n = len(texts)
            if model is None:
                p = pd.DataFrame({"lang_pred": ["und"] * n, "score": [0.0] * n, "bits_per_char": [0.0] * n, "deviation": [0.0] * n})
            else:
                p = pd.concat([model.predict(texts[k : k + AT_ONCE]) for k in range(0, n, AT_ONCE)]) if n else pd.DataFrame({"lang_pred": [], "score": [], "bits_per_char": [], "deviation": []})
            gone = (p["lang_pred"].to_numpy() == "und") | (p["deviation"].to_numpy(float) > limit)
            yield pa.RecordBatch.from_arrays(
                [b.column(k + 1) for k in range(len(names))] + [held, pa.array(p["lang_pred"].tolist(), pa.string()), pa.array(p["score"].to_numpy(float)), pa.array(p["bits_per_char"].to_numpy(float)), pa.array(gone, pa.bool_())],
                names=[*names, "held_out", "lang_pred", "score", "bits_per_char", "rejected"],
            )

    done = src.mapInArrow(lean(run), schema)
    return done.select("doc_id", *(F.col(n).alias(c) for n, c in zip(private, extra, strict=True)), *done.columns[len(names) :])


def plausible(docs: DataFrame, held_out: tuple[int, int] = (4, 2), sample_rows: int = SAMPLE_ROWS, limit: float = 6.0) -> DataFrame:
    """The rows of ``docs`` that identify() doesn't reject, with all their columns of any name and type. Null texts, empty
    ones and those without a letter go; an empty table gives no row; repeated rows share their fate."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(train(docs, held_out, sample_rows))  # bounded by the sample
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            texts = [b"" if t is None else t.encode("utf-8", "replace") for t in b.column("text").to_pylist()]
            keep: list[int] = []
            for k in range(0, len(texts) if model else 0, AT_ONCE):
                p = model.predict(texts[k : k + AT_ONCE])
                keep.extend(k + np.flatnonzero((p["lang_pred"].to_numpy() != "und") & (p["deviation"].to_numpy(float) <= limit)))
            yield b.take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(lean(run), docs.schema)
