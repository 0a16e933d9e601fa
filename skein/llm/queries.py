"""The registered queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import difference_cover_dedup
from .bagminhash import near_duplicates
from .ctw import ctw_score
from .decontam import contaminated
from .langid import identify
from .lpf import suffix_array_dedup
from .packing import pack_related
from .quality import cascade
from .sharding import balanced_label_propagation
from .toxicity import toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difference_cover_dedup(_documents(spark, sf_dir), width=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_score(_documents(spark, sf_dir), held_out=(7, 2))


def op2_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return cascade(_documents(spark, sf_dir), measures=measures).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept")
    )


def op3_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = balanced_label_propagation(_documents(spark, sf_dir), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir), held_out=(4, 2)).select("doc_id", "held_out", "lang_pred", "score", "bits_per_char", "rejected")


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "text_copies", "kept")


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_related(_documents(spark, sf_dir), length=2048)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_array_dedup(_documents(spark, sf_dir), width=400, keep="none", outputs=("longest_repeat", "kept_sha256"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "longest_repeat", "kept_sha256")


def op10_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=(5, 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_tree": op1_context_tree,
    "op2_rule_cascade": op2_rule_cascade,
    "op3_label_propagation": op3_label_propagation,
    "op4_difference_cover": op4_difference_cover,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_bagminhash": op6_bagminhash,
    "op7_suffix_array": op7_suffix_array,
    "op8_simhash_windows": op8_simhash_windows,
    "op9_related_packing": op9_related_packing,
    "op10_noisy_channel": op10_noisy_channel,
}

ORACLE: dict[str, str] = {
    "op2_rule_cascade": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), tri AS (
  SELECT doc_id, i, w[i:i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM rep) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(replace(t, '!', '')) AS n_shouts
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d) AS d
  LEFT JOIN cov USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 20 * n_symbols > n_words OR 4 * n_shouts > n_words
    OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR (n_dup_lines >= 3 AND 20 * n_dup_lines > n_words)) AS kept
FROM m
""",
    "op4_difference_cover": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), rep AS (
  SELECT k FROM win GROUP BY k HAVING count(*) > 1
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN rep USING (k)) GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t
  FROM d, LATERAL (SELECT unnest(w) AS word, generate_subscripts(w, 1) AS p) AS x
  ANTI JOIN (SELECT doc_id AS g, unnest(ps) AS q FROM gone) AS y ON y.g = d.doc_id AND y.q = x.p
  GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op7_suffix_array": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, w, md5_number(substr(h, 2 * i + 1, 2 * w)) AS k FROM (SELECT doc_id, h, w, unnest(range(0, len(h) // 2 - w + 1)) AS i FROM d, (VALUES (200), (400)) AS v(w))),
rep AS (SELECT k, w FROM win GROUP BY k, w HAVING count(*) > 1),
st AS (SELECT doc_id, i, w, i > coalesce(lag(i) OVER (PARTITION BY doc_id, w ORDER BY i) + w, -1) AS fresh FROM win SEMI JOIN rep USING (k, w)),
every AS (SELECT doc_id, w, min(i) AS a, max(i) + w AS b FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, w ORDER BY i) AS g FROM st) GROUP BY doc_id, w, g),
long AS (SELECT doc_id, max(b - a) AS longest FROM every WHERE w = 200 GROUP BY doc_id),
sp AS (SELECT doc_id, a, b FROM every WHERE w = 400),
gone AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM sp GROUP BY doc_id),
cut AS (
  SELECT doc_id, a, substr(h, 2 * before + 1, 2 * (a - before)) AS piece
  FROM (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before
        FROM (SELECT doc_id, a, b FROM sp UNION ALL SELECT doc_id, len(h) // 2, NULL FROM d)) JOIN d USING (doc_id)
), kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS t FROM cut GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, CAST(coalesce(longest, 0) AS BIGINT) AS longest_repeat, sha256(unhex(t)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN long USING (doc_id)
""",
}
