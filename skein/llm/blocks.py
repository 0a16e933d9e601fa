"""Blocks of documents that ask questions about hashes of the whole corpus.

``pack`` puts the documents into compressed blocks, written once to the shared folder.
A *round* has three steps: each block sends the distinct hashes it holds, dealt into
buckets; each bucket finds what several blocks hold; each block gets its own answer back.
A block sends a hash once however often it holds it, so a hash that a third of all
documents share costs one entry a block, and no step gathers a group of documents.
Only blocks and answers are shuffled. Python workers see one block or one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .text import give_back, lean

BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 16
BATCH_BYTES = 1 << 20
SCHEMA = "block long, ids binary, known binary, lens binary, text binary, raw long, extra binary"


class Block:
    """Documents of one block: ids (0 where null), known (id is not null), texts."""

    def __init__(self, row) -> None:
        self.block = int(row.block)
        self.ids = np.frombuffer(row.ids, np.int64)
        self.known = np.frombuffer(row.known, np.bool_)
        self.lens = np.frombuffer(row.lens, np.int64)
        self.extra = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row.extra)).read_all() if row.extra else None
        self.raw = zstandard.ZstdDecompressor().decompress(row.text, max_output_size=max(1, int(row.raw)))

    def batches(self, size: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first document, last + 1, buffer, byte offsets of the documents in it and the end)."""
        ends = np.cumsum(self.lens + 1)
        a, at = 0, 0
        whole = np.frombuffer(self.raw, np.uint8)
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, at + size, side="right")))
            yield a, b, whole[at : ends[b - 1]], np.concatenate([[0], ends[a:b] - at])
            a, at = b, int(ends[b - 1])

    def id_list(self) -> list:
        return [int(i) if k else None for i, k in zip(self.ids, self.known, strict=True)]


def pack(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """The block table of ``docs`` (doc_id, text; null text is empty), by id within a block; read, packed and written once.
    ``columns`` travel along as they are."""
    block_bytes = BLOCK_BYTES

    def flush(part: int, k: int, ids: list, texts: list, more: list) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda k: ids[k] or 0)  # stable
        ids, texts = [ids[k] for k in order], [texts[k] for k in order]
        raw = b"".join(t + b"\n" for t in texts)
        cols = [
            np.array([i or 0 for i in ids], np.int64).tobytes(),
            np.array([i is not None for i in ids], np.bool_).tobytes(),
            np.array([len(t) for t in texts], np.int64).tobytes(),
            zstandard.ZstdCompressor(level=3).compress(raw),
        ]
        extra = None
        if columns:
            table = pa.Table.from_batches(more).take(pa.array(order, pa.int64()))
            with pa.BufferOutputStream() as sink:
                with pa.ipc.new_stream(sink, table.schema) as w:
                    w.write_table(table)
                extra = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + k], pa.int64()), *(pa.array([c], pa.binary()) for c in cols), pa.array([len(raw)], pa.int64()), pa.array([extra], pa.binary())],
            names=["block", "ids", "known", "lens", "text", "raw", "extra"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, ids, texts, more, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        for b in batches:
            rest, begun = b.select(list(columns)) if columns else None, 0
            for at, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True), 1):
                t = t.as_py() or b""
                ids.append(i)
                texts.append(t)
                size += len(t) + 1
                if size >= block_bytes:
                    if columns:
                        more.append(rest.slice(begun, at - begun))
                    yield flush(part, k, ids, texts, more)
                    k, ids, texts, more, size, begun = k + 1, [], [], [], 0, at
            if columns and begun < b.num_rows:
                more.append(rest.slice(begun))
        if ids:
            yield flush(part, k, ids, texts, more)

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    src = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").cast("binary").alias("__text"), *columns)
    return materialize(src.mapInArrow(lean(run), SCHEMA), "blocks")


def bucket_count(blocks: DataFrame, least: int = 12) -> int:
    """Buckets in proportion to the corpus."""
    raw = blocks.agg(F.sum("raw")).first()[0] or 0
    return int(min(MOST_BUCKETS, max(least, raw // BUCKET_BYTES + 1)))


def deal(hashes: np.ndarray, buckets: int, dtype=np.uint64) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted distinct 64-bit hashes by bucket (their high bits); the low bits of ``dtype`` are sent."""
    edges = np.searchsorted(hashes, np.array([(k << 64) // buckets for k in range(buckets)] , dtype=np.uint64))
    for k in range(buckets):
        a, b = edges[k], edges[k + 1] if k + 1 < buckets else len(hashes)
        if b > a:
            yield k, np.unique(hashes[a:b].astype(dtype)) if dtype != np.uint64 else hashes[a:b]


def requests(once: np.ndarray, more: np.ndarray, block: int, buckets: int, dtype) -> pd.DataFrame:
    """Rows of a block's round. once, more: sorted hashes that it holds once, and more often."""
    rows = {}
    for k, x in deal(once, buckets, dtype):
        rows[k] = (x, x[:0])
    for k, x in deal(more, buckets, dtype):
        rows[k] = (rows[k][0] if k in rows else x[:0], x)
    return pd.DataFrame(
        {"bucket": list(rows), "block": block, "once": [a.tobytes() for a, _ in rows.values()], "more": [b.tobytes() for _, b in rows.values()]}
    ).astype({"bucket": "int32", "block": "int64"})


REQUEST = "bucket int, block long, once binary, more binary"


def repeated(sent: DataFrame, dtype) -> DataFrame:
    """(block, bucket, found): which of the hashes that a block holds once another block holds too."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        once = [np.frombuffer(x, dtype) for x in pdf["once"]]
        more = [np.frombuffer(x, dtype) for x in pdf["more"]]
        u, c = np.unique(np.concatenate(once + more), return_counts=True)
        rep = u[c > 1]
        found = [x[isin_sorted(x, rep)] for x in once]
        keep = [k for k, x in enumerate(found) if len(x)]
        return pd.DataFrame({"block": pdf["block"].iloc[keep], "bucket": pdf["bucket"].iloc[keep], "found": [found[k].tobytes() for k in keep]})

    from .text import isin_sorted

    return sent.groupBy("bucket").applyInPandas(answer, "block long, bucket int, found binary")


class Answer:
    """Sorted hashes that other blocks hold too, as one block got them back."""

    def __init__(self, pdf: pd.DataFrame, buckets: int, dtype) -> None:
        self.buckets, self.dtype = buckets, dtype
        self.found = {int(k): np.frombuffer(x, dtype) for k, x in zip(pdf["bucket"], pdf["found"], strict=True)}

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Membership of sorted distinct hashes."""
        from .text import isin_sorted

        out = np.zeros(len(hashes), dtype=bool)
        edges = np.searchsorted(hashes, np.array([(k << 64) // self.buckets for k in range(self.buckets)], dtype=np.uint64))
        for k, x in self.found.items():
            a, b = edges[k], edges[k + 1] if k + 1 < self.buckets else len(hashes)
            out[a:b] = isin_sorted(hashes[a:b].astype(self.dtype), x)
        return out


def ask(blocks: DataFrame, fn: Callable[[Block], pd.DataFrame], schema: str = REQUEST) -> DataFrame:
    """First round: ``fn`` of each block, without a shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                yield fn(Block(row))

    return blocks.mapInPandas(lean(run), schema)


def again(blocks: DataFrame, answers: DataFrame, fn: Callable[[Block, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Later rounds: ``fn`` of each block and its answers (none: an empty frame)."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [fn(Block(row), right) for row in left.itertuples()]
        give_back()
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(",")})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)


def again_arrow(blocks: DataFrame, answers: DataFrame, fn: Callable[[Block, pd.DataFrame], pa.Table], schema) -> DataFrame:
    """again() for results of any column type; ``fn`` gives Arrow tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.to_pandas()
        out = pa.concat_tables([fn(Block(row), told) for row in left.to_pandas().itertuples()])  # one block
        give_back()
        return out

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
