"""Polled sources as Structured Streaming: file drops, deduplication against the sink, dead letters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skein.operators.leads import normalised
from skein.sources.files import or_empty


def file_drop(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int | None = None, kind: str = "parquet") -> DataFrame:
    """A stream of the files that appear in a folder."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def drops(spark: SparkSession, sources: dict[str, tuple[str, T.StructType, dict[str, str]]], per_trigger: int | None = None, kind: str = "parquet") -> DataFrame:
    """One stream of several sources in one shape, such as a pushed form and two polled tables that land in folders of their own.

    sources: origin to (path, schema, column for each field)."""
    parts = [normalised(file_drop(spark, path, schema, per_trigger, kind), mapping, origin) for origin, (path, schema, mapping) in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run ``handle`` on each micro-batch: once over what is there, or every so often."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def dedupe_into(path: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A handler that stores the first row of each key not stored before.

    What was seen is the sink itself, so state doesn't grow in the stream. A batch that is run again after a
    failure replaces its own output: each batch writes its own folder."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = or_empty(spark, path, T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).where(F.col("batch") != number)
        best = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("row")).select("row.*")
        fresh = best.join(stored.select(key), key, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def daily_counts(stream: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """day, kind, rows of a stream of dead letters with event time; late rows are taken for a day."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), "event_type").agg(F.count("*").alias("failures")).select(F.to_date("w.start").alias("day"), "event_type", "failures")
