"""Functions, sources, sinks and streams on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from skein.functions import money as M
from skein.functions import text as T
from skein.operators import chunking as C
from skein.operators import evaluation as E
from skein.operators import invoices as I
from skein.operators import leads as L
from skein.operators import retrieval as R
from skein.operators import tickets as K
from skein.sources import files, sinks
from skein.streaming import poll


def one(spark, column, **values):
    """Value of a column over one row."""
    names = list(values) or ["x"]
    kinds = {str: "string", int: "int", float: "double", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(values.get(n))]}" for n in names)
    return spark.createDataFrame([tuple(values.get(n) for n in names)], schema).select(column).first()[0]


@pytest.mark.parametrize(("x", "want"), [("", 0.0), (" 12 ", 12.0), ("1e3", 1000.0), ("1,200", None), ("1d", None), ("true", 1.0), (None, "null")])
def test_loose_number(spark, x, want):
    got = one(spark, M.loose_number(F.col("x")), x=x)
    assert got is None if want == "null" else math.isnan(got) if want is None else got == want


@pytest.mark.parametrize(("x", "want"), [(-2.5 / 100, -0.02), (0.125, 0.13), (2.5, 2.5)])
def test_cents_round_half_up(spark, x, want):
    assert one(spark, M.cents(F.col("x")), x=x) == want


@pytest.mark.parametrize(("x", "want"), [(300.0, "300"), (12345678.9, "12345678.9"), (0.0, "0"), (-1.05, "-1.05"), (float("nan"), "NaN")])
def test_printed(spark, x, want):
    assert one(spark, M.printed(F.col("x")), x=x) == want


def test_not_a_number_never_differs(spark):
    assert one(spark, M.differs(F.col("x"), F.lit(1.0), 0.05), x=float("nan")) is False


@pytest.mark.parametrize(
    ("line", "want"),
    [("7.1 Term", True), ("29. Term", True), ("7.1Term", False), ("section 4", True), ("SECTIONAL", False), ("30 days after", True), ("(a) x", False), ("  12 Term", True), ("Term", False)],
)
def test_heading(spark, line, want):
    assert one(spark, T.is_heading(F.col("x")), x=line) is want


def test_text_functions(spark):
    assert one(spark, T.strip(F.col("x")), x="\t  a b  \n") == "a b"
    assert one(spark, T.lines(F.col("x")), x="a\r\nb\x85c d") == ["a", "b", "c", "d"]
    assert one(spark, T.search_terms(F.col("x")), x="Café-Bar 2x") == ["caf", "bar", "2x"]
    assert one(spark, T.page_list(F.col("x")), x="3, 5–7") == [3, 5, 6, 7]
    assert one(spark, T.retry_delay(F.col("x"), 5.0), x="27s") == 28.0 and one(spark, T.retry_delay(F.col("x"), 5.0), x="soon") == 5.0
    assert [one(spark, T.error_class(F.col("x")), x=m) for m in ("429 PerDay", "429", "boom")] == ["stop", "slow_down", "retry"]
    assert one(spark, T.html_escape(F.col("x")), x="<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert [one(spark, E.verdict(F.col("x"), E.FAITHFULNESS), x=v) for v in ("It is UNFAITHFUL", "faithful.", "partial", "?", None)] == ["UNFAITHFUL", "FAITHFUL", "PARTIAL", "UNKNOWN", "UNKNOWN"]


def words(n):
    return " ".join(["w"] * n)


@pytest.mark.parametrize(("sizes", "want"), [([10, 20, 100, 30, 80, 5], [130, 115]), ([100], [100]), ([99], [99]), ([5, 200], [205]), ([200, 5], [205]), ([], [])])
def test_merge_short(spark, sizes, want):
    df = spark.createDataFrame([([words(n) for n in sizes],)], "p array<string>")
    got = df.select(C.merge_short(F.col("p"))).first()[0]
    assert [len(x.split()) for x in got] == want


def test_segments(spark):
    page = "lead in\n1. First\nbody\n\n   \nplain\n2. Second\n3. Third"
    assert one(spark, C.segments(F.col("x")), x=page) == ["lead in", "1. First\nbody", "plain", "2. Second", "3. Third"]
    assert one(spark, C.segments(F.col("x")), x=" \n ") == []


@pytest.mark.parametrize(("n", "want"), [(1, [1]), (500, [500]), (501, [500, 51]), (950, [500, 500]), (951, [500, 500, 51])])
def test_overlapping_windows(spark, n, want):
    df = C.overlapping_windows(spark.createDataFrame([(1, words(n))], "id int, text string"))
    assert [r.n_tokens for r in df.orderBy("seq").collect()] == want


def test_runts_go_and_empty_pages_have_no_chunk(spark):
    pages = spark.createDataFrame([(1, words(29)), (2, words(30)), (3, ""), (4, None)], "id int, text string")
    assert [r.id for r in C.structured_chunks(pages).collect()] == [2]
    assert C.fixed_windows(pages).where("id > 2").count() == 0


def test_bm25_ties_repeats_and_unknown_terms(spark):
    chunks = spark.createDataFrame([(1, "b x"), (2, "a y"), (3, "z z"), (4, None)], "chunk_id int, text string")
    q = spark.createDataFrame([(1, "a b"), (2, "nothing"), (3, "z z")], "qid int, text string")
    got = {(r.qid, r.rank): r for r in R.bm25_topk(chunks, q).collect()}
    assert [got[1, k].chunk_id for k in (1, 2)] == [2, 1] and (2, 1) not in got
    single = R.bm25_topk(chunks, spark.createDataFrame([(3, "z")], "qid int, text string")).first().score
    assert math.isclose(got[3, 1].score, 2 * single, abs_tol=1e-8)
    assert R.bm25_topk(chunks.limit(0), q).count() == 0


def test_gate_edges(spark):
    top = spark.createDataFrame([(1, None), (2, 0.1499), (3, 0.15)], "qid int, top_score double")
    assert [r.refusal_type for r in R.refusal_gate(top).orderBy("qid").collect()] == [None, "threshold", None]
    lex = spark.createDataFrame([(1, 1, 7, 19.99), (2, 1, 7, 20.0)], "qid int, rank int, chunk_id int, score double")
    vec = spark.createDataFrame([(1, 1, 8, 0.5), (2, 1, 8, 0.5), (3, 1, 8, 0.5)], "qid int, rank int, chunk_id int, score double")
    got = R.hybrid_candidates(spark.createDataFrame([(1,), (2,), (3,)], "qid int"), vec, lex).collect()
    assert sorted((r.qid, r.chunk_id, r.similarity, r.used_hybrid) for r in got if r.similarity is not None) == [(1, 8, 0.5, False), (2, 8, 0.5, True), (3, 8, 0.5, False)]
    assert [(r.qid, r.chunk_id) for r in got if r.similarity is None] == [(2, 7)]


def test_integrity_and_no_rerank(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id int, text string")
    assert R.check_integrity(c, c).count() == 2
    with pytest.raises(Exception, match="stored text differs"):
        R.check_integrity(c.where("chunk_id = 1").withColumn("text", F.lit("z")), c).collect()
    cand = spark.createDataFrame([(1, k, k, "q", "t") for k in range(1, 21)], "qid int, rank int, chunk_id int, question string, text string")
    assert R.rerank(cand, 5, use=False).count() == 20 and R.rerank(cand, 5).count() == 5


@pytest.mark.parametrize(
    ("raw", "total", "reason"),
    [
        ('{"line_items":[{"line_total":10},{"line_total":"5.5"}],"vat_amount":null,"total":15.5}', 15.5, ""),
        ('{"line_items":[{"line_total":10}],"vat_amount":0,"total":11}', 10.0, "Line items sum to 10 but stated total is 11"),
        ('{"line_items":[{"line_total":10}],"vat_amount":0,"total":10.04}', 10.0, ""),
        ('{"line_items":[{"line_total":10}],"total":99}', "nan", ""),
        ('{"line_items":[{"line_total":10}],"vat_amount":0}', 10.0, ""),
        ('{"line_items":[{"line_total":10}],"vat_amount":0,"total":null}', 10.0, "No total found on invoice"),
        ('{"line_items":[{"line_total":null}],"vat_amount":0,"total":1}', 0.0, "One or more line items missing values"),
        ('{"line_items":[{"x":1}],"vat_amount":0,"total":0}', 0.0, "One or more line items missing values"),
        ('{"vat_amount":0,"total":0}', 0.0, ""),
        ('```json\n{"line_items":[],"vat_amount":"","total":"1,200"}\n```', 0.0, ""),
        ('{"line_items":[{"line_total":-2.515}],"vat_amount":0,"total":-2.51}', -2.51, ""),
        ("no json", None, "Could not parse AI output as JSON"),
    ],
)
def test_invoice(spark, raw, total, reason):
    r = I.validate(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (r.review_reason, r.needs_review) == (reason, reason != "")
    assert math.isnan(r.calculated_total) if total == "nan" else r.calculated_total == total
    assert r.raw_output == (raw if total is None else None)


def test_leads(spark):
    raw = spark.createDataFrame(
        [(1, "A", "a@example.com", "0803 555 1212", None, "a bulk quote please"), (2, "T", "t@example.com", "+2348012345678", " Zen ", "a quote for pricing"), (3, "C", "c@example.com", "", "Ventures", "just browsing"), (4, "J", "j@example.com", "", "", "hi"), (5, "T2", "T@example.com", "", "", "quote")],
        "lead_id int, name string, email string, phone string, `Company ` string, message string",
    )
    leads = L.cleaned(L.normalised(raw, {"name": "name", "email": "email", "phone": "phone", "company": "Company ", "message": "message"}, "sheet"))
    got = {r.lead_id: r for r in L.scored(leads).collect()}
    assert [got[k].needs_cleanup for k in (1, 2, 3)] == [True, False, True]
    assert got[1].cleaned_phone == "+2348035551212" and [got[k].tier for k in (1, 2, 3, 4)] == ["Warm", "Hot", "Warm", "Junk"]
    first = L.deduplicated(leads, leads.limit(0), ["lead_id"])
    assert sorted(r.lead_id for r in first.collect()) == [1, 2, 3, 4]
    assert L.deduplicated(leads, first, ["lead_id"]).count() == 0
    assert [r.destination for r in L.routed(L.scored(leads)).where("lead_id = 3").collect()] == ["crm", "records"]


def test_tickets(spark):
    orders = spark.createDataFrame([("ORD-10001", "alice@example.com", "lamp", "In Transit", "UPS"), ("ORD-10015", "alice@example.com", "mat", "Delivered", "UPS"), ("ORD-10002", "ben@example.com", "refund card", "In Transit", "UPS")], "order_number string, email string, item string, status string, carrier string")
    rows = [(1, "order_status", 0.9, "ORD-10001", "x@example.com"), (2, "order_status", 0.9, None, "Alice@example.com"), (3, "order_status", 0.9, "ORD-99999", "ben@example.com"), (4, "return", 0.9, "ORD-10001", "a"), (5, "complaint", 0.9, "ORD-10001", "a"), (6, "order_status", 0.5999, None, "ben@example.com"), (7, "order_status", 0.6, None, "ben@example.com"), (8, "other", None, None, "z")]
    t = spark.createDataFrame(rows, "ticket_id int, intent string, confidence double, order_number string, sender string")
    d = K.drafted(K.lookup(t, orders).withColumn("route", K.route(F.col("intent"), F.col("confidence"))), orders)
    got = {r.ticket_id: r for r in K.outcome(d).collect()}
    assert [got[k].outcome for k in range(1, 9)] == ["auto_send", "clarify", "clarify", "hold", "escalate", "escalate", "escalate", "escalate"]
    assert got[2].matches == 2 and "ORD-10001, ORD-10015" in got[2].draft and got[7].guardrail and got[5].draft is None
    assert K.deflection(K.outcome(d)).first().deflected == 3 and K.deflection(K.outcome(d).limit(0)).first().rate is None


def test_backfill(spark):
    chunks = spark.createDataFrame([(1, "f", 1, "red fox"), (2, "f", 2, "red"), (3, "f", 2, "blue fox den"), (4, "g", 1, "same"), (5, "g", 1, "same")], "chunk_id int, source_file string, page_number int, text string")
    src = spark.createDataFrame([(1, "red fox", 1, "f", 1, 0.3), (1, "red fox", 2, "f", 2, 0.5), (2, "same", 1, "g", 1, 1.0), (3, "x", 1, "h", 1, 1.0), (4, "blue fox den", 1, "f", 2, 0.995)], "qid int, question string, place int, source_file string, page_number int, rerank_score double")
    got = {(r.qid, r.place): (r.text, r.resolved) for r in E.backfill(src, chunks, R.lexical_relevance).collect()}
    assert got == {(1, 1): ("red fox", False), (1, 2): (None, False), (2, 1): (None, False), (3, 1): (None, False), (4, 1): ("blue fox den", True)}


def test_summaries_of_nothing(spark):
    r = E.eval_summary(spark.createDataFrame([], "hit boolean, faithfulness string"), spark.createDataFrame([], "correctly_refused boolean")).first()
    assert (r.total, r.unfaithful, r.hit_rate, r.refusal_accuracy) == (0, 0, None, None)


def test_pages_isolate_broken_files(spark, tmp_path):
    for name, data in (("a.pdf", b"x|y"), ("b.PDF", b"broken"), ("sub/c.pdf", b"z"), ("d.txt", b"no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)

    def extract(data):
        if data == b"broken":
            raise ValueError("not a document")
        return data.decode().split("|")

    got = files.pages(spark, str(tmp_path), extract)
    assert sorted((r.source_file, r.page_number, r.text) for r in got.where("error IS NULL").collect()) == [("a.pdf", 1, "x"), ("a.pdf", 2, "y"), ("c.pdf", 1, "z")]
    m = C.manifest(got).first()
    assert (m.documents_found, m.documents_succeeded, m.documents_failed) == (3, 2, 1) and m.failures[0].error == "ValueError: not a document"
    assert files.listing(spark, str(tmp_path)).count() == 3 and C.committed(got, got.where("error IS NULL")).count() == 3


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "o.csv").write_text("order_number,email,status,carrier,tracking_number,expected_delivery,item,return_eligible_until\nORD-1,a@example.com,Delivered,UPS,007,2026-08-01,Mat,\n")
    r = files.orders_csv(spark, str(tmp_path / "o.csv")).first()
    assert r.tracking_number == "007" and r.return_eligible_until is None and str(r.expected_delivery) == "2026-08-01"
    v = sinks.Versioned(spark, f"file://{tmp_path}/v")
    assert v.read("id long").count() == 0
    v.write(spark.range(3))
    v.write(spark.range(5))
    assert v.read("id long").count() == 5
    sinks.append(spark.range(2), f"{tmp_path}/t")
    sinks.append_new(spark.range(4), spark.read.parquet(f"{tmp_path}/t"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    assert files.or_empty(spark, f"{tmp_path}/none", "id long").count() == 0


def test_polled_dedupe_across_batches(spark, tmp_path):
    rows = [[(1, "a"), (2, "b"), (1, "c")], [(2, "d"), (3, "e")]]
    handle = poll.dedupe_into(f"{tmp_path}/sink", "k", ["v"])
    schema = spark.createDataFrame([], "k int, v string").schema
    for r in rows:
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        poll.start(poll.file_drop(spark, f"{tmp_path}/in", schema), handle, f"{tmp_path}/state").awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/sink").collect()) == [(1, "a"), (2, "b"), (3, "e")]
