"""Clients, collections, sinks and the question plan under failures and edge cases."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import clients
from skein.functions import text as X
from skein.operators import chunking as C
from skein.operators import evaluation as E
from skein.operators import leads as L
from skein.operators import retrieval as R
from skein.operators import tickets as K
from skein.operators.ask import ask
from skein.sources import files, sinks
from skein.sources.collection import Collection
from skein.streaming import poll


class Flaky:
    def __init__(self, *errors):
        self.errors, self.calls = list(errors), 0

    def __call__(self, x):
        self.calls += 1
        if self.errors:
            raise self.errors.pop(0)
        return x


def test_retries_wait_by_kind_of_error():
    limited = RuntimeError("429 too many")
    hinted = RuntimeError("429")
    hinted.retry_delay = "27s"
    for errors, waits in (([RuntimeError("x")], [2.0]), ([limited, RuntimeError("x")], [50.0, 2.0]), ([hinted], [28.0])):
        seen = []
        assert clients.with_retry(Flaky(*errors), 7, sleep=seen.append) == 7 and seen == waits
    with pytest.raises(RuntimeError, match="c"):
        clients.with_retry(Flaky(*map(RuntimeError, "abc")), 7, sleep=lambda _: None)
    f = Flaky(RuntimeError("429 PerDay"))
    with pytest.raises(clients.QuotaExhausted):
        clients.with_retry(f, 7, sleep=lambda _: None)
    assert f.calls == 1


def test_a_quota_stops_a_lane_and_a_failure_does_not(spark):
    def f(x):
        if x == "bad":
            raise ValueError("no")
        if x == "quota":
            raise RuntimeError("429 PerDay")
        return len(x)

    rows = spark.createDataFrame([(1, "aa"), (2, "bad"), (3, "b"), (4, "quota"), (5, "c")], "id int, x string").coalesce(1)
    got = clients.called(rows, "x", f, "n long", tries=2, wait=0.0).collect()
    states = {r.id: r.status for r in got}
    assert states[2] == "failed" and states[4] == "failed" and len(got) == 5
    at = [r.id for r in got].index(4)
    assert all(r.status == "not_attempted" for r in got[at + 1 :]) and all(r.status != "not_attempted" for r in got[:at])


def test_collection(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/c")
    rows = lambda *ids, d=3, t="a": spark.createDataFrame([(i, [1.0] * d, t, "f", i % 2) for i in ids], "chunk_id long, embedding array<float>, text string, source_file string, page_number int")
    assert (c.exists(), c.count(), c.dimension(), c.points().count()) == (False, 0, None, 0)
    c.upsert(rows(1, 2, 3), 1)
    c.upsert(rows(3, 4, t="b"), 2)
    c.upsert(rows(3, 4, t="b"), 2)  # the same batch again
    assert (c.count(), c.dimension()) == (4, 3) and {r.chunk_id: r.text for r in c.points().collect()} == {1: "a", 2: "a", 3: "b", 4: "b"}
    with pytest.raises(Exception, match="dimension"):
        c.upsert(rows(9, d=4), 3)
    assert c.count() == 4 and [r.chunk_id for r in c.on_page("f", 1, 1).collect()] == [1]


def test_a_failed_commit_keeps_the_version_before(spark, tmp_path, monkeypatch):
    v = sinks.Versioned(spark, f"file://{tmp_path}/v")
    v.write(spark.range(3))

    def crash(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(v, "_point", crash)
    with pytest.raises(KeyboardInterrupt):
        v.write(spark.range(9))
    fresh = sinks.Versioned(spark, f"file://{tmp_path}/v")
    assert fresh.read("id long").count() == 3
    fresh.write(spark.range(5))
    assert fresh.read("id long").count() == 5
    with pytest.raises(RuntimeError, match="someone else"):
        fresh._point("v-x", 2)
    assert fresh.read("id long").count() == 5


def test_json_and_manifest_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "é\n"), (1, None)], "id int, t string")
    for _ in range(2):  # an existing file is replaced
        sinks.write_json_array(E.ordered(df), f"file://{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == [{"id": 1, "t": None}, {"id": 2, "t": "é\n"}] and "é" in (tmp_path / "r.json").read_text()
    assert [r.id for r in files.json_array(spark, f"{tmp_path}/r.json", "id int, t string").orderBy("id").collect()] == [1, 2]
    sinks.write_json_array(df.limit(0), f"file://{tmp_path}/none.json")
    assert json.loads((tmp_path / "none.json").read_text()) == []
    m = C.manifest(spark.createDataFrame([("a", 1, None), ("b", 1, "x")], "source_file string, page_number int, error string"))
    path = sinks.write_manifest(m, f"file://{tmp_path}/chunks.json")
    assert path.endswith("chunks_manifest.json") and json.loads((tmp_path / "chunks_manifest.json").read_text())["documents_failed"] == 1
    assert not list(tmp_path.glob("*.tmp"))


def test_append_new_drops_repeats_of_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    sinks.append_new(rows, rows.limit(0), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


@pytest.mark.parametrize("hybrid", [False, True])
@pytest.mark.parametrize("rerank", [False, True])
def test_ask(spark, hybrid, rerank):
    chunks = spark.createDataFrame([(1, "red fox runs", "a", 1), (2, "blue whale", "b", 2), (3, "grey wolf", "b", 2)], "chunk_id long, text string, source_file string, page_number int")
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, "red fox"), (2, "zebra"), (3, "whale")], "qid long, question string")
    asked = []

    def generate(df):
        asked.append(df)
        return df.withColumn("answer", F.col("question"))

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "qid long, embedding array<float>")
    out = ask(q, chunks, points, embed=lambda x: x.join(vectors, "qid"), generate=generate, classify=lambda df: df.withColumn("reply", F.when(F.col("qid") == 3, F.lit("REFUSAL"))), top_k=2, use_reranking=rerank, use_hybrid=hybrid, gate=0.1)
    got = {r.qid: r for r in out.collect()}
    assert set(got) == {1, 2, 3}
    assert got[3].refusal_type == "content" and got[3].refused and not got[3].generation_skipped
    assert got[2].refusal_type == ("threshold" if rerank else None) and got[2].generation_skipped == rerank
    assert [c.chunk_id for c in got[1].retrieved_chunks][:1] == [1] and got[1].citations[0].source_file == "a"
    assert got[1].used_hybrid == hybrid and len(got[1].retrieved_chunks) == (2 if rerank or not hybrid else 3)
    assert asked[0].where("generation_skipped").count() == 0


def test_holders_are_those_of_contains(spark):
    texts = ["a b c d e f", "xx a b c d e", "a b c", "", None, "one  two\nthree four five six", "b c d e fg"]
    needles = ["a b c d e", "b c d e f", "a", "two\nthree four five six", "  ", "never here at all now", None, "one  two\nthree four"]
    c = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "qid long, needle string")
    want = {(i, j) for i, x in enumerate(needles) if x for j, t in enumerate(texts) if t and x in t}
    assert {(r.qid, r.chunk_id) for r in E.holders(c, n).collect()} == want
    plan = E.holders(c, n.where("size(split(needle, ' ')) >= 5"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_small_functions(spark):
    one = lambda col, **v: spark.createDataFrame([tuple(v.values())], list(v)).select(col).first()[0]
    assert one(X.fold_nbsp(F.col("x")), x="a b") == "a b"
    assert [one(X.is_numbered_clause(F.col("x")), x=v) for v in ("7.1 Term", "section 4", " 12. T", "7.1T")] == [True, False, True, False]
    assert [one(X.outcome_label(F.col("x")), x=v) for v in ("content", "other")] == ["Declined: the passages do not hold the answer", "Answered"]
    assert one(L.company_in(F.col("x")), x="hi from Blue Sky today") == "Blue Sky" and one(L.company_in(F.col("x")), x="from nowhere") is None
    day = lambda s: F.lit(s).cast("date")
    assert [one(K.late(F.col("x"), day("2026-01-01"), day(d)), x=s) for s, d in (("In Transit", "2026-01-09"), ("In Transit", "2026-01-08"), ("Delivered", "2026-02-01"))] == [True, False, False]
    assert one(K.window_closed(F.lit(None).cast("date"), day("2026-01-01")), x=1) is False
    p = one(R.prompt(F.array(F.struct(F.lit("f").alias("source_file"), F.lit(3).alias("page_number"), F.lit("t").alias("text"))), F.col("x")), x="Why?")
    assert "[Source: f, page 3]\nt" in p and p.endswith("Question: Why?")
    e = spark.createDataFrame([(1, "a"), (2, "z")], "id int, source_file string")
    assert [r.id for r in E.check_sources(e, e.limit(1)).collect()] == [2]
    assert E.limited(e, None, "id").count() == 2 and [r.id for r in E.limited(e, 2, "id").collect()] == [1]
    r = E.judged(e, lambda d: d.withColumn("reply", F.lit("It is unfaithful")), E.FAITHFULNESS).first()
    assert r.verdict == "UNFAITHFUL"
    cm = files.copy_manifest(spark.createDataFrame([("x/a.pdf",), ("y/a.pdf",), ("y/b.pdf",)], "path string"))
    assert sorted(map(tuple, cm.collect())) == [("a.pdf", "y/a.pdf"), ("b.pdf", "y/b.pdf")]


def test_no_answer_candidate_needs_its_fixed_phrase(spark):
    text = '## 1. NORTH\n**No-answer candidate (maybe)**: "Why?" — x\n'
    sections = E.eval_sections(spark.createDataFrame([("m", text)], "path string, text string"))
    with pytest.raises(Exception, match="no candidate"):
        E.parse_no_answer_rows(sections, {"North": "n.pdf"}).collect()


def test_three_sources_in_one_stream(spark, tmp_path):
    shapes = {"form": "name string, mail string", "sheet": "`Full Name` string, email string", "base": "n string, e string"}
    maps = {"form": {"name": "name", "email": "mail"}, "sheet": {"name": "Full Name", "email": "email"}, "base": {"name": "n", "email": "e"}}
    sources = {}
    for k, ddl in shapes.items():
        spark.createDataFrame([(k, f" {k}@x ")], ddl).write.json(f"{tmp_path}/{k}")
        sources[k] = (f"{tmp_path}/{k}", T.StructType.fromDDL(ddl), maps[k])
    poll.start(poll.drops(spark, sources, kind="json"), lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/b={n}"), f"{tmp_path}/state").awaitTermination()
    assert sorted((r.origin, r.email, r.company) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(k, f"{k}@x", None) for k in ("base", "form", "sheet")]


def test_outboxes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a@x", "crm"), (1, "a@x", "alerts"), (2, "", "records")], "lead_id long, email string, destination string")
    L.deliver(rows, f"{tmp_path}")
    assert sorted(r.destination for r in spark.read.parquet(f"{tmp_path}/outbox").collect()) == ["alerts", "crm"]
    assert spark.read.parquet(f"{tmp_path}/dead_letters").count() == 1
