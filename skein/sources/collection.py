"""A stored set of vectors: made at the first write, one dimension, upserts by id, counts and filtered reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.files import exists
from skein.sources.sinks import latest

PAYLOAD = "chunk_id long, embedding array<float>, text string, source_file string, page_number int"


class Collection:
    """Points (chunk_id, embedding, text, source_file, page_number) in a folder of Parquet batches; the last batch of an id counts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def exists(self) -> bool:
        return exists(self.spark, self.root)

    def dimension(self) -> int | None:
        """Of the stored vectors; None before the first write."""
        row = self.spark.read.schema(PAYLOAD).parquet(self.root).select(F.size("embedding")).first() if self.exists() else None
        return row[0] if row else None

    def _all(self) -> DataFrame:
        schema = f"{PAYLOAD}, batch long"
        return self.spark.read.schema(schema).parquet(self.root) if self.exists() else self.spark.createDataFrame([], schema)

    def points(self) -> DataFrame:
        return latest(self._all(), "chunk_id", "batch").drop("batch")

    def ids(self) -> DataFrame:
        """Stored ids, from the id column alone."""
        return self._all().select("chunk_id").distinct()

    def count(self) -> int:
        """Points stored, 0 if there is no collection yet."""
        return self.ids().count()

    def upsert(self, points: DataFrame, batch: int) -> None:
        """Write a batch; a vector of another dimension is an error, and the batch isn't stored. A batch that runs again replaces itself."""
        d = self.dimension() or (points.select(F.size("embedding")).first() or [0])[0]
        same = F.when(F.size("embedding") == d, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector isn't of dimension {d}")).cast("array<float>"))
        points.select("chunk_id", same.alias("embedding"), "text", "source_file", "page_number").write.mode("overwrite").parquet(f"{self.root}/batch={int(batch)}")

    def on_page(self, source_file: str, page_number: int, limit: int = 100) -> DataFrame:
        """The first ``limit`` points of a page, by id."""
        return self.points().where((F.col("source_file") == source_file) & (F.col("page_number") == page_number)).orderBy("chunk_id").limit(limit)
