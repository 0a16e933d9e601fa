"""Readers: file listings, pages of documents, JSON arrays, order CSV, markdown, results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("order_number", "email", "status", "carrier", "tracking_number")]
    + [T.StructField("expected_delivery", T.DateType()), T.StructField("item", T.StringType()), T.StructField("return_eligible_until", T.DateType())]
)


def listing(spark: SparkSession, root: str, suffix: str = "pdf") -> DataFrame:
    """path, length, modificationTime of files below ``root`` with the suffix in either case; contents aren't read."""
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", "modificationTime")


def seeded_sample(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, the same for the same seed whatever the order of the input."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), key).limit(n)


def copy_manifest(sample: DataFrame) -> DataFrame:
    """name, path: of files with the same name in the flattened target the last path stays, as a later copy overwrites."""
    name = F.element_at(F.split("path", "/"), -1)
    return sample.groupBy(name.alias("name")).agg(F.max("path").alias("path"))


def pages(spark: SparkSession, root: str, extract: Callable[[bytes], list[str | None]], suffix: str = "pdf") -> DataFrame:
    """source_file, page_number (from 1), text, error. ``extract`` gives a file's page texts; if it raises, the file gives
    one row with the error and the others go on."""
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    texts = [t or "" for t in extract(bytes(content))]
                    yield pd.DataFrame({"source_file": name, "page_number": range(1, len(texts) + 1), "text": texts, "error": None})
                except Exception as e:  # a broken file is a row, not a failed job
                    yield pd.DataFrame({"source_file": [name], "page_number": [0], "text": [None], "error": [f"{type(e).__name__}: {e}"]})

    return files.mapInPandas(run, "source_file string, page_number int, text string, error string")


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a file that holds one JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def orders_csv(spark: SparkSession, path: str) -> DataFrame:
    """Order table; tracking numbers stay strings, an empty date is null."""
    return spark.read.csv(path, header=True, schema=ORDERS)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, or an empty one of the schema if nothing is stored there yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
