"""Registered queries of the document and record workflows, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.clients import called
from skein.functions.text import order_number
from skein.operators import chunking as C
from skein.operators import evaluation as E
from skein.operators import invoices as I
from skein.operators import leads as L
from skein.operators import retrieval as R
from skein.operators import tickets as K
from skein.operators.ask import ask
from skein.sources.collection import Collection
from skein.sources.files import copy_manifest, json_array, orders_csv, seeded_sample
from skein.sources.shared import folder, stored
from skein.sources.sinks import append_new, latest, write_json_array
from skein.streaming import poll

#: Stand-in scores differ from the models' ones, so the two thresholds are set for them here.
HYBRID_GATE, REFUSE_BELOW = 150.0, 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: benchmark items as questions, documents as chunks."""
    top = R.bm25_topk(_chunks(spark, sf_dir), _questions(spark, sf_dir), 20)
    return top.select("qid", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 4).alias("score"))


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_stats(_chunks(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


#: The stated query set of searches: ids divisible by this, against all rows.
EVERY = 20


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), "embedding")
    return R.vector_topk(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), asked, 20)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).withColumn("score", F.round("score", 4))


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_topk(_chunks(spark, sf_dir), _questions(spark, sf_dir).where(F.col("qid") % EVERY == 0), 20)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.rrf_fusion(_vectors(spark, sf_dir), _lexical(spark, sf_dir))
    return out.select("qid", "rank", "chunk_id", F.round("fused", 6).alias("fused"), "vector_rank", "lexical_rank")


def hybrid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector, lexical = stored(_vectors(spark, sf_dir), "vector"), stored(_lexical(spark, sf_dir), "lexical")
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid")).union(_questions(spark, sf_dir).select("qid")).where(F.col("qid") % EVERY == 0).distinct()
    out = R.hybrid_candidates(asked, vector, lexical, 20, HYBRID_GATE)
    return out.select("qid", "rank", "chunk_id", F.round("similarity", 4).alias("similarity"), "used_hybrid", F.round("bm25_top", 4).alias("bm25_top"))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.concat("source", F.lit(".pdf")).alias("source_file"), (F.col("doc_id") % 3 + 1).cast("int").alias("page_number"))


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 runs once; only its candidates' texts are read, joined and compared."""
    q = _questions(spark, sf_dir)
    top = stored(R.bm25_topk(_chunks(spark, sf_dir), q, 20), "top")
    own = stored(R.only_ids(_cited(spark, sf_dir), top), "candidates")
    cand = own.join(top, "chunk_id").join(q.select("qid", F.col("text").alias("question")), "qid")
    return R.rerank(R.check_integrity(cand, own.select("chunk_id", "text")), 5)


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("qid", "rank", "chunk_id", "rerank_score")


def citations_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_citations(_reranked(spark, sf_dir))


def refusal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _reranked(spark, sf_dir).groupBy("qid").agg(F.max("rerank_score").alias("top_score"))
    gated = R.refusal_gate(top, REFUSE_BELOW)

    def generate(df: DataFrame) -> DataFrame:
        return df.withColumn("answer", F.when(F.col("qid") % 5 == 0, F.lit(" ")).otherwise(F.lit("an answer")))

    reply = F.when(F.col("qid") % 3 == 0, F.lit("REFUSAL")).when(F.col("qid") % 3 == 1, F.lit("Answer")).otherwise(F.lit("ANSWER, not a refusal"))
    return R.content_refusal(R.answer(gated, generate).withColumn("reply", reply)).select("qid", "top_score", "refusal_type", "refused", "generation_skipped")


def chunk_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.fixed_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "seq", "n_tokens", F.md5("chunk").alias("chunk_md5"))


def chunk_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.overlapping_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "seq", "n_tokens", F.md5("chunk").alias("chunk_md5"))


def with_headings(docs: DataFrame) -> DataFrame:
    """Documents with a blank line before, and a numbered heading at, every third line; the tables have neither."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". Clause\n"), x)).otherwise(x))
    return docs.select("doc_id", F.array_join(line, "\n").alias("text"))


def chunk_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.structured_chunks(with_headings(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "segment", "seq", "n_tokens", F.md5("chunk").alias("chunk_md5"))


def chunk_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_headings(table(spark, sf_dir, "documents")).withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.lit(" ")).otherwise(F.col("text")))
    s = C.coverage(pages, C.fixed_windows(pages), C.structured_chunks(pages))
    return s.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in s.dtypes])


def _holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.holders(_chunks(spark, sf_dir), _questions(spark, sf_dir).select("qid", F.col("text").alias("needle")))


def eval_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth: the documents that hold the item verbatim."""
    top = R.bm25_topk(_chunks(spark, sf_dir), _questions(spark, sf_dir), 5)
    hit = E.hit_pairs(_holders(spark, sf_dir), top).withColumn("faithfulness", F.lit("FAITHFUL"))
    none = spark.range(0).select(F.lit(True).alias("correctly_refused"))
    return E.eval_summary(hit, none).select("total", "hits", F.round("hit_rate", 4).alias("hit_rate"), "refusal_total", "refusal_accuracy")


def no_answer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("qid").join(_holders(spark, sf_dir).select("qid").distinct(), "qid", "left_anti")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 5 == 0, F.lit("verdict: unfaithful.")).when(F.col("doc_id") % 5 == 1, F.lit(" Partial ")).when(F.col("doc_id") % 5 == 2, F.lit("no idea")).otherwise(F.lit("FAITHFUL"))
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", said.alias("reply"))


def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    refusal = F.when(F.col("toxic") == 1, F.lit("Incorrect")).otherwise(F.lit("CORRECT"))
    return _judged(spark, sf_dir).select("doc_id", E.verdict(F.col("reply"), E.FAITHFULNESS).alias("faithfulness"), E.verdict(refusal, E.REFUSAL).alias("refusal"))


def judge_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _judged(spark, sf_dir).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(4))))
    reply = F.when((F.col("doc_id") % 7 == 0) & (F.col("run") == 4), F.lit("PARTIAL")).otherwise(F.col("reply"))
    return E.judge_stability(runs.select(F.col("doc_id").alias("id"), E.verdict(reply, E.FAITHFULNESS).alias("verdict")))


def rejudge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir)

    def metrics(reply) -> DataFrame:
        results = j.select((F.col("quality") == 1).alias("hit"), E.verdict(reply, E.FAITHFULNESS).alias("faithfulness"))
        return E.metrics_long(results, j.where("toxic = 1").select((F.col("quality") == 0).alias("correctly_refused")))

    return E.rejudge_diff(metrics(F.col("reply")), metrics(F.when(F.col("doc_id") % 11 == 0, F.lit("faithful")).otherwise(F.col("reply"))))


def backfill_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_file"), (F.floor(F.col("doc_id") / 20) % 10).cast("int").alias("page_number"))
    top = stored(_reranked(spark, sf_dir).where("rank <= 3").select("qid", "rank", "chunk_id", "question", "rerank_score"), "top3")
    sources = R.only_ids(docs.select("chunk_id", "source_file", "page_number"), top).join(top, "chunk_id")
    sources = stored(sources.select("qid", "question", F.col("rank").alias("place"), "source_file", "page_number", "rerank_score"), "sources")
    out = E.backfill(sources, docs, R.lexical_relevance)
    return out.select("qid", "place", "source_file", "page_number", F.md5("text").alias("text_md5"), "resolved")


MARKDOWN = """intro
## 1. NORTH_STAR
| Type | Question | Answer | Pages |
| Easy | What is the term? | Two years | 3, 5–7 |
| Connecting | Who signs? | Both | 23, 6 |
**No-answer candidate (not in the 50)**: "What is the color?" — never stated
## 2. BLUE_SEA_2
| easy | ignored | x | 1 |
| Easy | Where? | Here | 36 |
**No-answer candidate (not in the 50)**: "Why?" — no reason
## Summary
| Easy | beyond | the | 1 |
"""
KNOWN = {"North Star": "north.pdf", "Blue Sea": "blue.pdf"}


def eval_md_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = E.eval_sections(spark.createDataFrame([("set.md", MARKDOWN)], "path string, text string"))
    rows = E.parse_eval_rows(sections, KNOWN).select("id", "document", "source_file", "type", "question", F.col("expected_answer").alias("detail"), F.array_join(F.col("expected_pages").cast("array<string>"), ",").alias("pages"))
    none = E.parse_no_answer_rows(sections, KNOWN).select("id", "document", "source_file", F.lit("none").alias("type"), "question", F.col("note").alias("detail"), F.lit("").alias("pages"))
    return rows.unionByName(none)


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw replies made of orders and their lines; the order key decides what is wrong with each."""
    cents = F.col("l_extendedprice").cast("decimal(18,2)")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", cents.alias("v")))).alias("l"), F.sum(cents).alias("s"))
    j = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k, m = F.col("o_orderkey") % 8, F.col("o_orderkey") % 3
    vat = F.when(m == 0, F.lit(',"vat_amount":null')).when(m == 1, F.lit(',"vat_amount":10.50')).otherwise(F.lit(""))
    due = F.coalesce("s", F.lit(0).cast("decimal(18,2)")) + F.when(m == 1, F.lit("10.50")).otherwise(F.lit("0.00")).cast("decimal(18,2)")
    shown = F.when(k == 1, due + F.lit("1.00").cast("decimal(18,2)")).when(k == 6, due + F.lit("0.04").cast("decimal(18,2)")).otherwise(due).cast("decimal(18,2)").cast("string")
    total = F.when(k == 2, F.lit(',"total":null')).when(k == 5, F.lit("")).when(k == 7, F.lit(',"total":"1,200"')).otherwise(F.concat(F.lit(',"total":'), shown))
    item = F.transform(F.coalesce("l", F.array().cast("array<struct<l_linenumber:int,v:decimal(18,2)>>")), lambda x, i: F.concat(F.lit('{"line_total":'), F.when((k == 3) & (i == 0), F.lit("null")).otherwise(x["v"].cast("string")), F.lit("}")))
    body = F.concat(F.lit('{"vendor":"v'), m.cast("string"), F.lit('","invoice_date":"2026-01-02","currency":"EUR","line_items":['), F.array_join(item, ","), F.lit("]"), vat, total, F.lit("}"))
    raw = F.when(k == 4, F.concat(F.lit("Sorry: "), body)).when(m == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return j.select("o_orderkey", raw.alias("raw"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.validate(_replies(spark, sf_dir))


def invoice_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("o_orderkey", "vendor", "calculated_total", "needs_review", "review_reason", F.col("raw_output").isNotNull().alias("has_raw"))


def invoice_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.target(_checked(spark, sf_dir)).groupBy("target", "vendor").agg(F.count("*").alias("n"), F.count_if(F.isnan("calculated_total")).alias("not_a_number"))


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    email = F.when(k % 50 == 0, F.lit("")).otherwise(F.concat(F.when(k % 2 == 0, F.lit("User")).otherwise(F.lit("user")), (k % 400).cast("string"), F.lit("@example.com")))
    phone = F.when(k % 4 == 0, F.concat(F.lit("+23480"), F.lpad(k.cast("string"), 8, "0"))).when(k % 4 == 1, F.concat(F.lit("0803 "), F.lpad(k.cast("string"), 7, "0"))).when(k % 4 == 2, F.lit("")).otherwise(F.lit("n/a"))
    company = F.when(k % 3 == 0, F.concat(F.lit(" Firm "), k.cast("string"), F.lit(" "))).otherwise(F.lit(""))
    message = F.when(k % 5 < 2, F.lit("Please send a Quote for pricing")).otherwise(F.lit("just browsing"))
    raw = c.select(k.alias("lead_id"), F.col("c_name").alias("name"), email.alias("mail"), phone.alias("tel"), company.alias("Company "), message.alias("msg"))
    one = L.normalised(raw.where("lead_id % 3 = 0"), {"name": "name", "email": "mail", "phone": "tel", "company": "Company ", "message": "msg"}, "sheet")
    two = L.normalised(raw.where("lead_id % 3 = 1"), {"name": "name", "email": "mail", "phone": "tel", "company": "Company ", "message": "msg"}, "base")
    three = L.normalised(raw.where("lead_id % 3 = 2"), {"name": "name", "email": "mail", "phone": "tel", "message": "msg"}, "form")
    return one.unionByName(two).unionByName(three)


def lead_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cleaned(_leads(spark, sf_dir)).select("lead_id", "origin", "email", "needs_cleanup", "cleaned_phone", "cleaned_company")


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = L.cleaned(_leads(spark, sf_dir))
    known = leads.where("lead_id < 100").select("email")
    good, _ = L.valid_or_dead(leads.where("lead_id >= 100"), "crm")
    return L.deduplicated(good, known, ["lead_id"])


def lead_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduped(spark, sf_dir).select("lead_id", F.lower("email").alias("email"))


def lead_score_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.routed(L.scored(_deduped(spark, sf_dir))).select("lead_id", "points", "tier", "destination")


def lead_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dead = L.valid_or_dead(L.cleaned(_leads(spark, sf_dir)), "crm", F.lit("2026-01-02 00:00:00").cast("timestamp_ntz"))
    return dead.select(F.get_json_object("payload", "$.lead_id").cast("long").alias("lead_id"), "stage", "error")


def dead_letter_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("ts").alias("failed_at"), F.concat(F.lit("stage"), (F.col("user_id") % 3).cast("string")).alias("stage"))
    d = L.dead_letter_digest(dead)
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "stage", "failures", F.date_format("first_failure", "yyyy-MM-dd HH:mm:ss").alias("first_failure"), F.date_format("last_failure", "yyyy-MM-dd HH:mm:ss").alias("last_failure"))


def _tickets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tickets from the opening turns of conversations, all orders; keys decide labels and order numbers."""
    c = F.col("conv_id")
    text = F.when(c % 3 == 0, F.concat(F.lit("Where is ORD-"), (10000 + c % 40).cast("string"), F.lit("?"))).otherwise(F.col("text"))
    t = table(spark, sf_dir, "conversations").where("turn = 0").select(
        c.alias("ticket_id"),
        F.element_at(F.array(*map(F.lit, ("order_status", "order_status", "return", "complaint", "other"))), (c % 5 + 1).cast("int")).alias("intent"),
        ((c * 37 % 100) / 100.0).alias("confidence"),
        F.concat(F.lit("user"), (c % 30).cast("string"), F.lit("@Example.com")).alias("sender"),
        order_number(text).alias("order_number"),
    )
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ORD-"), (10000 + k).cast("string")).alias("order_number"),
        F.concat(F.lit("user"), F.floor(k / 3).cast("string"), F.lit("@example.com")).alias("email"),
        F.when(k % 7 == 0, F.lit("refund voucher")).otherwise(F.lit("lamp")).alias("item"),
        F.lit("In Transit").alias("status"),
        F.lit("UPS").alias("carrier"),
    )
    return t, o


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, o = _tickets(spark, sf_dir)
    looked = K.lookup(t, o).withColumn("route", K.route(F.col("intent"), F.col("confidence")))
    return K.outcome(K.drafted(looked, o))


def ticket_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("ticket_id", "route", "matches", F.array_join("found", ",").alias("found"), "draft", "outcome")


def ticket_deflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.deflection(_outcomes(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


def guardrail_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    draft = F.when(c % 4 == 0, F.lit("Your REFUND is on its way")).when(c % 4 == 1, F.lit("It is approved.")).when(c % 4 == 2, F.lit("We guarantee delivery")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(c.alias("conv_id"), "turn", F.when(c % 3 == 0, F.lit("return")).otherwise(F.lit("order_status")).alias("route"), draft.alias("draft"))
    return rows.select("conv_id", "turn", "route", F.size(K.guardrail_hits(rows)).alias("violations"))


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return E.pending(d, d.where("id % 2 = 0"))


def seeded_sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 60)


def per_document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.per_document(table(spark, sf_dir, "documents").select(F.col("source").alias("document")))


def stream_poll_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a polled source: the first event of each user, by a stream that ends when it has seen all."""
    root = folder(spark, "poll")
    schema = table(spark, sf_dir, "events").schema
    stream = poll.file_drop(spark, f"{sf_dir}/events*.parquet", schema).select("user_id", "ts", "event_id", "event_type")
    poll.start(stream, poll.dedupe_into(f"{root}/sink", "user_id", ["ts", "event_id"]), f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/sink").select("user_id", "event_id", "event_type")


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts a day and kind of an event-time stream; the last count that each day's window had is the result."""
    root = folder(spark, "daily")
    stream = poll.daily_counts(poll.file_drop(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp")))

    def handle(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/sink/part={number}")

    stream.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{root}/sink").groupBy("day", "event_type").agg(F.max_by("failures", "batch").alias("failures"))
    return last.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "failures")


def ask_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item as a question, from embedding to citations; stand-ins embed, generate and classify."""
    e = table(spark, sf_dir, "embeddings")
    cited = _cited(spark, sf_dir)
    points = e.join(cited.select(F.col("chunk_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("chunk_id"), "embedding")
    n = F.size("retrieved_chunks").cast("string")
    out = ask(
        _questions(spark, sf_dir).select("qid", F.col("text").alias("question")),
        cited,
        points,
        embed=lambda q: q.join(e.select(F.col("vec_id").alias("qid"), "embedding"), "qid"),
        generate=lambda df: df.withColumn("answer", F.concat(n, F.lit(" passages, "), F.length("prompt").cast("string"), F.lit(" characters"))),
        classify=lambda df: df.withColumn("reply", F.when(F.col("qid") % 4 == 0, F.lit("refusal")).otherwise(F.lit("ANSWER"))),
        store=stored,
        use_hybrid=True,
        gate=HYBRID_GATE,
        refuse_below=REFUSE_BELOW,
    )
    ids = F.array_join(F.transform("retrieved_chunks", lambda c: c["chunk_id"].cast("string")), ",")
    return out.select("qid", ids.alias("chunks"), F.size("citations").alias("n_citations"), "used_hybrid", F.round("bm25_top", 4).alias("bm25_top"), "top_score", "refusal_type", "refused", "generation_skipped", T.outcome_label(F.col("refusal_type")).alias("label"), "answer")


def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt a source file, of its first passages."""
    d = _cited(spark, sf_dir)
    parts = d.groupBy("source_file", "page_number").agg(F.min_by(F.struct("chunk_id", "source_file", "page_number", "text"), "chunk_id").alias("p")).groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct(F.col("p.page_number").alias("page_number"), F.col("p.source_file").alias("source_file"), F.col("p.text").alias("text")))).alias("parts"))
    return parts.select("source_file", F.md5(R.prompt(F.col("parts"), F.lit("Why?"))).alias("prompt_md5"))


def embed_with_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a client that refuses some for good: a failed row never ends the run."""

    def embed(text: str) -> list[float]:
        if len(text) % 5 == 0:
            raise ValueError("unreadable")
        return [float(len(text)), 1.0]

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    out = called(d, "text", embed, "embedding array<double>", lanes=8, tries=2, wait=0.0)
    return out.select("doc_id", "status", F.get("embedding", F.lit(0)).cast("long").alias("first"), F.substring_index("error", ":", 1).alias("error"))


def collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored in two batches, of which the second replaces ids divisible by ten and adds the odd ones."""
    c = Collection(spark, folder(spark, "collection"))
    e, k = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    rows = lambda label: e.select(k.alias("chunk_id"), "embedding", F.lit(label).alias("text"), F.lit("f").alias("source_file"), F.col("label").cast("int").alias("page_number"))
    before = c.count()
    c.upsert(rows("old").where("chunk_id % 2 = 0"), 1)
    c.upsert(rows("new").where("chunk_id % 10 = 0 OR chunk_id % 2 = 1"), 2)
    found = c.points().groupBy("text").agg(F.count("*").alias("n"), F.sum("chunk_id").alias("ids"))
    return found.withColumn("before", F.lit(before).cast("long")).withColumn("stored", F.lit(c.count()).cast("long"))


def limited_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a limited run: ids are given first, so the limit moves none."""
    return E.limited(_chunks(spark, sf_dir), 50).select("chunk_id")


def results_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stored as a JSON array in the order of ids, read back and joined to documents by id."""
    path = f"{folder(spark, 'results')}.json"
    write_json_array(E.ordered(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")), path)
    results = json_array(spark, path, "id long, quality int, toxic int")
    return E.with_result(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), results, "quality")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user."""
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return latest(e, "user_id", "at").select("user_id", "event_id")


def append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user appended in two runs, of which the second finds the first's users there."""
    path = folder(spark, "users")
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    append_new(u.where("id % 2 = 0"), u.limit(0), path)
    append_new(u, spark.read.schema("id long").parquet(path), path)
    return spark.read.schema("id long").parquet(path)


def copied_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses flattened to file names; of equal names the last stays."""
    return copy_manifest(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


def scanned_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a scan of files in which some pages fail: files that are committed, and the run's summary."""
    k = F.col("page_id")
    scan = table(spark, sf_dir, "pages").select(F.concat(F.lit("f"), (k % 40).cast("string")).alias("source_file"), k.cast("int").alias("page_number"), F.when(k % 37 == 0, F.lit("broken")).alias("error"))
    m = C.manifest(scan)
    left = C.committed(scan, scan).agg(F.count("*").alias("pages"))
    return m.crossJoin(left).select("documents_found", "documents_succeeded", "documents_failed", "pages", F.array_join(F.transform("failures", lambda x: x["source_file"]), ",").alias("failed"))


def numbered_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin a numbered clause, after no-break spaces are folded."""
    d = with_headings(table(spark, sf_dir, "documents"))
    line = d.select("doc_id", F.explode(T.lines(T.fold_nbsp(F.replace("text", F.lit(". Clause"), F.lit(".\u00a0Clause"))))).alias("line"))
    return line.where(T.is_numbered_clause(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("clauses"))


def example_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.concat("source", F.lit(".pdf")).alias("source_file"), F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("1. ")).otherwise(F.lit("")), F.coalesce("text", F.lit(""))).alias("chunk"))
    return C.pick_examples(chunks, ["THE", "und", "qqqq"], 4, "1").select("place", "chunk_id", "keyword")


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chunk")), "The ").select("doc_id")


def source_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose source isn't among the sources of the labelled ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_file"))
    known = d.where("doc_id % 100 = 7")
    return E.check_sources(d, known).select("doc_id")


def invoice_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices appended to books and review queue, and read back."""
    root = folder(spark, "invoices")
    I.deliver(stored(_checked(spark, sf_dir), "checked"), root)
    b = spark.read.parquet(f"{root}/books").select(F.lit("books").alias("sink"), "vendor", F.lit("").alias("review_reason"), F.lit(False).alias("has_raw"))
    q = spark.read.parquet(f"{root}/review_queue").select(F.lit("review_queue").alias("sink"), "vendor", F.regexp_replace("review_reason", " [0-9.]+", "").alias("review_reason"), F.col("raw_output").isNotNull().alias("has_raw"))
    return b.unionByName(q).groupBy("sink", "vendor", "review_reason", "has_raw").agg(F.count("*").alias("n"))


def lead_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed leads appended to one outbox a channel; those without an email to the dead letters."""
    root = folder(spark, "leads")
    L.deliver(L.routed(L.scored(L.cleaned(_leads(spark, sf_dir)))), root)
    sent = spark.read.parquet(f"{root}/outbox").groupBy("destination").agg(F.count("*").alias("n"))
    return sent.unionByName(spark.read.parquet(f"{root}/dead_letters").agg(F.lit("dead_letters").alias("destination"), F.count("*").alias("n")))


def lead_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy leads get a company from the message; clean ones never reach the extraction."""
    k = F.col("lead_id")
    leads = _leads(spark, sf_dir).withColumn("message", F.when(k % 2 == 0, F.concat(F.lit("hello from Acme "), F.concat(F.lit("N"), (k % 9).cast("string")), F.lit(" again"))).otherwise(F.lit("hello from nowhere")))
    return L.cleaned(leads, L.company_in).select("lead_id", "needs_cleanup", "cleaned_company")


def ticket_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening turns classified by the stand-in, and routed."""
    c = F.col("conv_id")
    text = F.when(c % 3 == 0, F.concat(F.lit("Where is my order ORD-"), c.cast("string"), F.lit(", I need it TODAY"))).when(c % 3 == 1, F.lit("I want to return it, terrible")).otherwise(F.lit("hm"))
    t = table(spark, sf_dir, "conversations").where("turn = 0").select(c.alias("ticket_id"), text.alias("text"))
    out = K.classified(t, K.by_keywords)
    return out.select("ticket_id", "intent", "urgency", "sentiment", "order_number", K.route(F.col("intent"), F.col("confidence")).alias("route"))


def ticket_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.escalations(_outcomes(spark, sf_dir))


def order_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through a CSV file and back: late ones, and those whose return window is closed."""
    path, k = folder(spark, "orders"), F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("00"), k.cast("string")).alias("order_number"), F.lit("a@example.com").alias("email"), F.when(k % 3 == 0, F.lit("Delivered")).otherwise(F.lit("In Transit")).alias("status"), F.lit("UPS").alias("carrier"),
        F.concat(F.lit("0"), k.cast("string")).alias("tracking_number"), day.alias("expected_delivery"), F.lit("lamp").alias("item"), F.when(k % 5 == 0, F.lit(None).cast("date")).otherwise(F.date_add(day, 30)).alias("return_eligible_until"),
    )
    o.write.option("header", True).csv(path)
    as_of = F.lit("1996-06-30").cast("date")
    r = orders_csv(spark, path)
    return r.select("order_number", "tracking_number", K.late(F.col("status"), F.col("expected_delivery"), as_of).alias("late"), K.window_closed(F.col("return_eligible_until"), as_of).alias("closed"))


def error_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a service's errors: class, wait, and the text as HTML."""
    k = F.col("event_id")
    message = F.element_at(F.array(*map(F.lit, ("429 limit PerDay", "429 <slow> & \"wait\"", "boom"))), (k % 3 + 1).cast("int"))
    hint = F.when(k % 2 == 0, F.concat((k % 60).cast("string"), F.lit("s"))).otherwise(F.lit("soon"))
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select("event_id", T.error_class(message).alias("kind"), T.retry_delay(hint, 2.0).alias("wait"), T.html_escape(message).alias("html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_stats, vector_topk, rrf_fusion, hybrid_gate, rerank_topk, citations_distinct, refusal_gate, chunk_naive, chunk_overlapping,
        chunk_structured, chunk_coverage_summary, eval_hit_rate, no_answer_split, verdict_parse, judge_stability, rejudge_diff, backfill_resolve,
        eval_md_parse, invoice_validate, invoice_route, lead_normalize, lead_dedupe, lead_score_route, lead_dead_letters, dead_letter_digest,
        ticket_route, ticket_deflection, guardrail_scan, resume_anti, seeded_sample_ids, per_document_counts, stream_poll_dedupe,
        stream_daily_counts, ask_questions, prompt_assembly, embed_with_retries, collection_upsert, limited_ids, results_joined, upsert_latest, append_once,
        copied_files, scanned_manifest, numbered_clauses, example_pick, phrase_search, source_membership, invoice_sinks, lead_outbox, lead_company,
        ticket_classify, ticket_escalations, order_deadlines, error_labels,
    )
}
