"""One plan from questions to cited answers, with injected models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import retrieval as R

Rows = Callable[[DataFrame], DataFrame]
CANDIDATES, TOP, REFUSE_BELOW, GATE = 20, 5, 0.15, 20.0
REFUSED = "The documents do not cover this."


def ask(
    questions: DataFrame,
    chunks: DataFrame,
    points: DataFrame,
    *,
    embed: Rows,
    generate: Rows,
    classify: Rows,
    relevance: Callable[[Column, Column], Column] = R.lexical_relevance,
    store: Rows = lambda df: df,
    top_k: int = TOP,
    use_reranking: bool = True,
    use_hybrid: bool = False,
    gate: float = GATE,
    refuse_below: float = REFUSE_BELOW,
    message: str = REFUSED,
) -> DataFrame:
    """qid, answer, retrieved_chunks, citations, used_hybrid, bm25_top, top_score, refusal_type, refused, generation_skipped.

    questions: qid, question; chunks: chunk_id, text, source_file, page_number; points: chunk_id,
    embedding of some chunks. embed adds ``embedding`` to questions, generate ``answer`` to rows with
    ``prompt`` and classify ``reply`` to answered rows; a costly model never sees a question that an earlier
    gate refused. ``store`` keeps an intermediate table that several steps read. Hybrid and reranked
    questions take 20 candidates, others ``top_k``. A question without any candidate has
    no score, so no threshold refusal: its prompt has no passage. A candidate whose chunk is missing is an error."""
    limit = CANDIDATES if use_hybrid or use_reranking else top_k
    named = store(embed(questions.select("qid", "question")).select("qid", "question", "embedding"))
    vector = store(R.vector_topk(points, named.select("qid", "embedding"), limit))
    if use_hybrid:
        lexical = store(R.bm25_topk(chunks.select("chunk_id", "text"), named.select("qid", F.col("question").alias("text")), CANDIDATES))
        found = store(R.hybrid_candidates(named.select("qid"), vector, lexical, CANDIDATES, gate))
    else:
        found = vector.select("qid", "rank", "chunk_id", F.col("score").alias("similarity"), F.lit(False).alias("used_hybrid"), F.lit(None).cast("double").alias("bm25_top"))
    own = R.only_ids(chunks.select("chunk_id", "text", "source_file", "page_number"), found)
    text = F.when(F.length("text") > 0, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no text for chunk "), F.col("chunk_id").cast("string"))).cast("string"))
    cand = found.join(own, "chunk_id", "left").withColumn("text", text).join(named.select("qid", "question"), "qid")
    top = store(R.rerank(cand, top_k, relevance, use_reranking).select("qid", "rank", "chunk_id", "text", "source_file", "page_number", "similarity", "rerank_score", "used_hybrid", "bm25_top"))
    parts = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source_file", "page_number", "text", "similarity", "rerank_score")))
    per = top.groupBy("qid").agg(parts.alias("retrieved_chunks"), F.bool_or("used_hybrid").alias("used_hybrid"), F.max("bm25_top").alias("bm25_top"), F.max("rerank_score").alias("top_score"))
    none = F.array().cast(per.schema["retrieved_chunks"].dataType)
    rows = named.select("qid", "question").join(per, "qid", "left").withColumn("retrieved_chunks", F.coalesce("retrieved_chunks", none)).withColumn("used_hybrid", F.coalesce("used_hybrid", F.lit(False)))
    gated = R.refusal_gate(rows, refuse_below).withColumn("prompt", R.prompt(F.col("retrieved_chunks"), F.col("question")))
    answered = store(R.answer(gated, generate, message))
    told = classify(answered.where("NOT generation_skipped")).unionByName(answered.where("generation_skipped").withColumn("reply", F.lit(None).cast("string")))
    cited = R.distinct_citations(top).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "source_file", "page_number"))).alias("citations"))
    out = R.content_refusal(told).join(cited, "qid", "left")
    return out.select("qid", "answer", "retrieved_chunks", "citations", "used_hybrid", "bm25_top", "top_score", "refusal_type", "refused", "generation_skipped")
