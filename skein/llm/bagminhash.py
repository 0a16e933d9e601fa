"""Near-duplicate classes by BagMinHash signatures over word-shingle multisets.

A shingle that a text holds c times has weight c. Its weight axis is cut into the dyadic intervals
[0, 1), [1, 2), [2, 4), ...; each interval of each shingle is a Poisson process, whose points
carry a time, a register and a place in the interval, all from hashes. A point counts if
its place is below c, and a register keeps its earliest time. Two texts agree in a register with
the probability of their weighted Jaccard similarity. A text needs about m (ln m + 5) points
whatever its length: points later than that are not made, unless a register is still empty.

Banding proposes; the multiset overlap of the texts decides. In a band's bucket every text is
compared to one text, a star instead of all pairs, so comparisons grow with the texts. Texts in
buckets that then still hold several components are banded again by more rows, which unlike
texts rarely share, and compared to stars with other centres. Stars only save comparisons: at the end
the texts of every bucket of the first banding that still holds several components are joined by the rarest
shingles of each, of which two texts that overlap enough share one. So every pair that
shares a bucket is compared, is in one class already, or cannot overlap enough.
Equal texts are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize
from .text import U64, lean, mix64, window_hashes, word_hashes, word_spans

SHINGLE = 5
BANDS = 32
ROWS = 5
THRESHOLD = 0.8
#: Bands and rows of the second banding, for texts whose buckets still hold several components.
SHARP = (48, 8)
#: Texts whose shingles are counted to tell common shingles from rare ones, and the number of common ones
#: kept. They set the order of shingles in the last join, so its cost and never its result.
COUNTED, COMMON = 20_000, 200_000
#: Bytes of texts that are described at once; a shingle takes about 170 bytes meanwhile.
BATCH = 1_000_000


def shingles(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct k-word shingles; a text of 1 to k - 1 words has one shingle, all its words."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    s, e = word_spans(buf)
    h = word_hashes(buf, s, e)
    w = np.searchsorted(s, offs)
    n = np.diff(w)
    doc = np.repeat(np.arange(len(texts)), n)
    ok = np.ones(max(0, len(h) - k + 1), dtype=bool)
    for end in w[1:-1]:
        ok[max(0, end - k + 1) : end] = False
    at = np.flatnonzero(ok)
    d, x = doc[at], window_hashes(h, k)[at]
    small = np.flatnonzero((n > 0) & (n < k))
    if len(small):
        d = np.concatenate([d, small])
        x = np.concatenate([x, np.array([window_hashes(h[w[i] : w[i + 1]], int(n[i]))[0] for i in small], U64)])
    _, first, count = np.unique(mix64(x + d.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    return d[first], x[first], count


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, texts: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Earliest times (texts x m); a text without shingles has infinity."""
    reg = np.full(texts * m, np.inf)
    total = np.bincount(doc, weights=count, minlength=texts)
    unit = [(doc, mix64(h), np.ones(len(h)), np.zeros(len(h)), count.astype(float))]
    level = 1
    while (big := count > (1 << (level - 1))).any():  # the interval [2**(level-1), 2**level)
        unit.append((doc[big], mix64(h[big] + U64(level * 0xD1B54A32D192ED03 % 2**64)), np.full(big.sum(), float(1 << (level - 1))), np.full(big.sum(), float(1 << (level - 1))), count[big].astype(float)))
        level += 1
    d, key, rate, low, top = (np.concatenate(x) for x in zip(*unit, strict=True))
    open_ = total > 0
    until = m * (np.log(m) + 5) / np.maximum(total, 1)
    while open_.any():
        use = open_[d]
        a_d, a_key, a_rate, a_low, a_top = d[use], key[use], rate[use], low[use], top[use]
        t, j = np.zeros(len(a_d)), 0
        while len(a_d):
            j += 1
            r = mix64(a_key + U64(j * 0x9E3779B97F4A7C15 % 2**64))
            t = t - np.log(((r >> U64(11)).astype(float) + 0.5) / 2.0**53) / a_rate
            on = t <= until[a_d]
            if not on.all():
                t, a_d, a_key, a_rate, a_low, a_top, r = (x[on] for x in (t, a_d, a_key, a_rate, a_low, a_top, r))
            q = mix64(r ^ U64(0xA0761D6478BD642F))
            place = a_low + np.where(a_low > 0, a_rate, 1.0) * ((q >> U64(32)).astype(float) / 2.0**32)
            hit = place < a_top
            np.minimum.at(reg, a_d[hit] * m + ((q & U64(0xFFFFFFFF)) % U64(m)).astype(np.int64)[hit], t[hit])
        open_ &= np.isinf(reg.reshape(texts, m)).any(axis=1)
        until = np.where(open_, until * 2, until)
    return reg.reshape(texts, m)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    x = mix64(np.ascontiguousarray(sig).view(U64))
    out = np.zeros((len(sig), sig.shape[1] // rows), U64)
    for k in range(rows):
        out = mix64(out + x[:, k::rows])
    return out + np.arange(out.shape[1], dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1.0, float(a[1].sum() + b[1].sum()) - both)


def _described(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """key (md5 of the text), n (shingles with repeats), bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            a = 0
            while a < len(texts):
                size, z = 0, a
                while z < len(texts) and (z == a or size + len(texts[z]) <= BATCH):
                    size += len(texts[z])
                    z += 1
                d, h, c = shingles(texts[a:z])
                keys = band_keys(signatures(d, h, c, z - a, bands * rows), rows).view(np.int64)
                n = np.bincount(d, weights=c, minlength=z - a).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(z - a + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(n), lists], names=["key", "n", "bands"])
                a = z

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text")).mapInArrow(lean(run), "key binary, n long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of nodes those whose texts overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
            ok = []
            for at in range(0, len(a), 64):
                text = dict(zip(a[at : at + 64] + b[at : at + 64], ta[at : at + 64] + tb[at : at + 64], strict=True))
                d, h, c = shingles(list(text.values()))
                order = np.lexsort((h, d))
                h, c, edge = h[order], c[order], np.searchsorted(d[order], np.arange(len(text) + 1))
                sets = {x: (h[edge[k] : edge[k + 1]], c[edge[k] : edge[k + 1]]) for k, x in enumerate(text)}
                ok.extend(k for k in range(at, min(at + 64, len(a))) if overlap(sets[a[k]], sets[b[k]]) >= threshold)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in ok], pa.int64()), pa.array([b[k] for k in ok], pa.int64())], names=["a", "b"])

    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp): the least node of each connected component of links (a, b); least labels, with pointer jumping."""
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    label = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("node"), "comp")
    k = 0
    while True:
        label = materialize(label, f"{name}-{k}")
        k += 1
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = label.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        # a label that is itself a node follows that node's label
        hop = label.select(F.col("node").alias("low"), F.col("comp").alias("next"))
        new = low.join(hop, "low").select("node", F.least("low", "next").alias("comp"), (F.least("low", "next") < F.col("comp")).alias("moved"))
        new = materialize(new, f"{name}-new-{k}")
        moved = new.where("moved").limit(1).count()
        label = new.select("node", "comp")
        if not moved:
            return label


def _spread_join(rows: DataFrame, by_key: DataFrame, parts: int = 1000) -> DataFrame:
    """rows with their key's values; keys of more than 1/``parts`` of the rows, at most ``parts``, are broadcast."""
    large = by_key.where(F.col("text_copies") > max(1, rows.count() // parts))
    cold = rows.join(F.broadcast(large.select("key")), "key", "left_anti").join(by_key, "key")
    return rows.join(F.broadcast(large), "key").unionByName(cold)


def _sharpened(texts: DataFrame) -> DataFrame:
    """node, n, bands of texts (node, text) by bands of more rows, which unlike texts rarely share."""
    count, rows = SHARP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                t = b.column(1).to_pylist()
                d, h, c = shingles(t)
                keys = band_keys(signatures(d, h, c, len(t), count * rows), rows).view(np.int64)
                n = np.bincount(d, weights=c, minlength=len(t)).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * count), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), lists], names=["node", "n", "bands"])

    return texts.select("node", "text").mapInArrow(lean(run), "node long, n long, bands array<long>")


def _common(texts: DataFrame) -> np.ndarray:
    """Hashes of common shingles of texts (node, text), the least common first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, count = np.unique(shingles(b.column(0).to_pylist())[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count)], names=["h", "c"])

    some = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 20)) < F.lit(min(1.0, COUNTED / max(1, texts.count())) * (1 << 20))
    counts = texts.where(some).select("text").mapInArrow(lean(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    rows = counts.orderBy(F.desc("c"), "h").limit(COMMON).select("h").toArrow()
    return rows.column(0).to_numpy().view(U64)[::-1]


def _rarest(texts: DataFrame, threshold: float) -> DataFrame:
    """node, n, lead, tokens of texts (node, text): the rarest shingles of each, so many that texts overlapping by ``threshold``
    share one, of which the shorter text has it among its first ``lead``."""
    common = _common(texts)
    order = np.argsort(common)
    sent = texts.sparkSession.sparkContext.broadcast((common[order], order + 1))  # at most COMMON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                d, h, c = shingles(b.column(1).to_pylist())
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[k] == h, place[k], 0)
                # the i-th copy of a shingle is an element of its own
                copy = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                d, rank, x = np.repeat(d, c), np.repeat(rank, c), mix64(np.repeat(h, c) + copy.astype(U64) * U64(0xD1B54A32D192ED03))
                o = np.lexsort((x, rank, d))
                d, x = d[o], x[o]
                n = np.bincount(d, minlength=b.num_rows)
                first = np.cumsum(n) - n
                reach = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
                lead = n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + 1
                reach, lead = np.minimum(reach, n), np.minimum(lead, n)
                use = np.arange(len(d)) - first[d] < reach[d]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(reach)]).astype(np.int32)), pa.array(x[use].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(lead), lists], names=["node", "n", "lead", "tokens"])

    return texts.select("node", "text").mapInArrow(lean(run), "node long, n long, lead long, tokens array<long>")


def _rest(texts: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a > b) of texts (node, text) of different components that may overlap by ``threshold``; no other pair does."""
    rare = materialize(_rarest(texts, threshold), "rarest").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    long = rare.select("node", "n", "comp", "lead", F.posexplode("tokens").alias("at", "token"))
    short = long.where("at < lead").select("token", F.col("node").alias("s"), F.col("n").alias("sn"), F.col("comp").alias("s_comp"), F.col("at").alias("s_at"))
    on = long.join(short, "token").where(f"comp <> s_comp and (sn < n or (sn = n and s < node)) and sn >= {threshold} * n")
    most = "least(at, s_at) + least(n - at, sn - s_at)"  # shingles that can be shared, from the places of a shared one
    on = on.where(f"{most} >= {threshold} * (n + sn - ({most}))")
    return on.select(F.greatest("node", "s").alias("a"), F.least("node", "s").alias("b")).distinct()


def _torn(stars: DataFrame, comp: DataFrame) -> DataFrame:
    """node of the texts in buckets of several components."""
    inside = stars.select("band", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    torn = inside.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band")
    return inside.join(torn, "band").select("node").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, rounds: int = 3) -> DataFrame:
    """Class of every row: rows are linked if their five-word shingle multisets overlap by ``threshold``.

    ``rounds`` bounds the rounds of stars only, not the pairs that are compared in the end.
    docs: doc_id, text; other columns are ignored. One row per input row: doc_id, key (md5 of the text), class_id (the least
    doc_id of the class), class_size (rows), text_copies (rows with this very text), kept (one row of
    each class: the least doc_id, of equal ids an arbitrary one). Null and empty texts are one
    text, like only each other. A text of 1 to 4 words has one shingle. A null id comes last
    and gives a class of only null ids a null class_id. An empty table gives no row.
    """
    described = materialize(_described(docs, bands, rows), "described")
    nodes = described.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "n", "bands"), "nodes")
    band = nodes.where("n > 0").select("node", "n", F.explode("bands").alias("band"))
    heads = band.groupBy("band").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("size")).where("size > 1").select("band", F.col("head.node").alias("head"), F.col("head.n").alias("head_n"))
    stars = materialize(band.join(heads, "band"), "stars")  # only buckets of two or more
    like = f"least(n, other_n) >= {threshold} * greatest(n, other_n)"
    pairs = stars.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"), "n", F.col("head_n").alias("other_n")).where(like).select("a", "b").distinct()
    wanted = stars.select("node").distinct().join(nodes.select("node", "key"), "node")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    # copies are one row a task before they are dealt by their text
    distinct = docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    texts = materialize(distinct.join(wanted, "key").select("node", "text"), "texts")
    tested = materialize(pairs, "pairs-0")
    links = materialize(_verified(tested, texts, threshold), "links-0")
    comp = components(links, "comp-0")
    sharp = materialize(_sharpened(texts.join(_torn(stars, comp), "node")), "sharp")
    band = sharp.select("node", "n", F.explode("bands").alias("band"))
    for k in range(1, rounds + 1):
        inside = band.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        centre = F.struct(F.xxhash64("node", "band", F.lit(k)), F.col("node"), F.col("n"), F.col("comp"))
        heads = inside.groupBy("band").agg(F.min(centre).alias("head"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
        heads = heads.select("band", F.col("head.node").alias("head"), F.col("head.n").alias("other_n"), F.col("head.comp").alias("other"))
        more = inside.join(heads, "band").where("comp <> other").where(like).select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
        done = tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        more = materialize(more.join(done, ["a", "b"], "left_anti"), f"pairs-{k}")
        fresh = materialize(_verified(more, texts, threshold), f"links-{k}")
        if not fresh.limit(1).count():
            break
        tested = tested.unionByName(more)
        links = links.unionByName(fresh)
        comp = components(links, f"comp-{k}")
    left = materialize(texts.join(_torn(stars, comp), "node").select("node", "text"), "torn")
    done = tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = materialize(_rest(left, comp, threshold).join(done, ["a", "b"], "left_anti"), "pairs-rest")
    fresh = materialize(_verified(more, texts, threshold), "links-rest")
    if fresh.limit(1).count():
        comp = components(links.unionByName(fresh), "comp-rest")
    own = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text)).alias("key"))
    key_class = nodes.select("node", "key").join(comp, "node", "left").select("key", F.coalesce("comp", "node").alias("class"))
    rowed = materialize(own.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "key"), "rows")
    copies = rowed.groupBy("key").agg(F.count("*").alias("text_copies"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("least"))
    told = copies.join(key_class, "key")
    classes = told.groupBy("class").agg(F.min("least").alias("first"), F.sum("text_copies").alias("class_size"))
    by_key = told.select("key", "class", "text_copies").join(classes, "class").select("key", "text_copies", "class_size", F.col("first.doc_id").alias("class_id"), F.col("first.uid").alias("first_uid"))
    return _spread_join(rowed, materialize(by_key, "by-key")).select("doc_id", "key", "class_id", "class_size", "text_copies", (F.col("uid") == F.col("first_uid")).alias("kept"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of near_duplicates(), the least doc_id's, with all its columns. Rows are told apart by
    id and text; of rows equal in both one stays."""
    kept = near_duplicates(docs, threshold).where("kept").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    rows = docs.withColumn("__key", key).withColumn("__id", F.col("doc_id").cast("long"))
    on = rows["__id"].eqNullSafe(kept["__id"]) & (rows["__key"] == kept["__key"])
    found = rows.join(kept, on, "left_semi")
    first = F.row_number().over(Window.partitionBy("__id", "__key").orderBy(F.lit(0)))
    return found.withColumn("__n", first).where("__n = 1").select(*docs.columns)
