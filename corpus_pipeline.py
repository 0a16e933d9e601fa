"""Corpus preparation: stages over ``documents``, each from and to Parquet.

Language ID drops texts without a letter or implausible in every language; near-duplicate classes
keep one document; repeated 200-byte strings keep their first copy; documents with a benchmark
item go; what is left is packed. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.bagminhash import deduplicate
from skein.llm.decontam import without_contamination
from skein.llm.langid import plausible
from skein.llm.lpf import suffix_array_dedup
from skein.llm.packing import pack_related
from skein.llm.storage import materialize, release, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject. Null and empty texts and those without a letter go; repeated
    rows share their fate."""
    return plausible(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the least id's; null and empty texts are one class."""
    return deduplicate(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of 200-byte strings, which any passage of 50 words holds; characters that a cut
    breaks go, n_chars follows where there is such a column. Null texts stay null. Of equal rows the first keeps its text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    flagged = docs.withColumn("__null", F.col("text").isNull())
    cut = suffix_array_dedup(flagged, width=200, keep="first", columns=(*rest, "__null"), outputs=("kept_text",))
    cut = cut.toDF(*(f"__c{k}" for k in range(len(rest))), "__null", "__id", "__n", "__removed", "__spans", "__text")
    text = F.when(~F.col("__null"), F.col("__text"))
    own = {c: F.col(f"__c{k}") for k, c in enumerate(rest)} | {"doc_id": F.col("__id"), "text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*(own[c].alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item; null and empty texts have none and stay."""
    return without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences; each row is packed by itself, a null text as its end alone."""
    return pack_related(docs, length=2048)


STAGES = [("language", language), ("near_duplicate", near_duplicate), ("substrings", substrings), ("decontaminate", decontaminate), ("packing", packing)]

#: Language models, signatures and a tokenizer are beyond SQL; tests compare each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage wrote for itself, and its input, goes once its result is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(mark)
    return docs
