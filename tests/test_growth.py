"""Steps whose cost must not outgrow the tables: same results as brute force, and no pairs in the plan."""

import math

import pytest

from skein.operators import retrieval as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cosines(points, questions, k):
    """Best k of each question as (qid, rank, chunk_id, score), by sums from the first element to the last."""

    def unit(v):
        if v is None or None in v:
            return None
        n = math.sqrt(sum(x * x for x in v))
        return v if n == 0 else [x / n for x in v]

    out = []
    for qid, q in questions:
        scored = []
        for cid, p in points:
            a, b = unit(p), unit(q)
            s = None if a is None or b is None or len(a) != len(b) else sum(x * y for x, y in zip(a, b, strict=True))
            scored.append((s is None, 0 if s is None or math.isnan(s) else 1, 0 if s is None or math.isnan(s) else -round(s, 9), cid, s))
        for rank, (*_, cid, s) in enumerate(sorted(scored, key=lambda r: r[:4])[:k], 1):
            out.append((qid, rank, cid, "nan" if s is not None and math.isnan(s) else s and round(s, 9)))
    return sorted(out)


def test_vector_topk_is_exact_and_makes_no_pairs(spark):
    def vector(i):
        return [math.sin(i * 7.3 + j * j) for j in range(6)]

    points = [(i, vector(i % 37)) for i in range(90)] + [(100, None), (101, [0.0] * 6), (102, [1.0, 2.0]), (103, [float("nan")] * 6), (104, [None] + [1.0] * 5), (105, vector(3))]
    questions = [(i, vector(i + 0.5)) for i in range(5)] + [(10, vector(3)), (11, None), (12, [0.0] * 6), (13, [3.0, 1.0]), (14, [float("nan")] * 6)]
    p, q = spark.createDataFrame(points, "chunk_id long, embedding array<double>"), spark.createDataFrame(questions, "qid long, embedding array<double>")
    want = cosines(points, questions, 20)
    for block in (100, 3):
        df = R.vector_topk(p, q, 20, block)
        assert "Join" not in plan(df)
        got = sorted((r.qid, r.rank, r.chunk_id, "nan" if r.score is not None and math.isnan(r.score) else r.score) for r in df.collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(a[3] == b[3] or math.isclose(a[3], b[3], abs_tol=2e-9) for a, b in zip(got, want, strict=True))
    named = R.vector_topk(p.selectExpr("cast(chunk_id as string) chunk_id", "embedding"), q.selectExpr("cast(qid as string) qid", "embedding"), 20)
    assert sorted((int(r.qid), r.rank, r.chunk_id) for r in named.where("qid < 10").collect() if r.rank == 1) == [(x[0], 1, "103") for x in want if x[0] < 10 and x[1] == 1]
    assert R.vector_topk(p, q.limit(0)).count() == 0 and R.vector_topk(p.limit(0), q).count() == 0


@pytest.mark.parametrize("x", [0.1234567895, -0.1234567895, 0.12345678949999, 2.5e-9, -0.5e-9, 123.4567890125, 1e-12])
def test_keys_round_as_spark_does(spark, x):
    import numpy as np

    from skein.operators.topk import PLACES, rounded

    assert rounded(np.array([x]))[0] / PLACES == spark.sql(f"SELECT round(cast('{x!r}' AS double), 9)").first()[0]


def test_bm25_shuffles_no_pairs_and_merges_repeated_ids(spark):
    import random

    import duckdb

    from skein.plans.oracle import TOP

    r = random.Random(3)
    word = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(r.choices(word, k=r.randint(0, 30)))) for i in range(300)]
    docs += [(400 + i, docs[5][1]) for i in range(60)] + [(7, "W1 w2 w2"), (7, "w3"), (8, "w1 " * 40), (500, None), (501, "..."), (502, "\u212aw wäw1")]
    items = [(i, " ".join(r.choices(word + ["none", "kw"], k=8))) for i in range(30)] + [(90, docs[5][1]), (91, ""), (92, None), (93, "W1 w1 i")]
    chunks, questions = spark.createDataFrame(docs, "chunk_id long, text string"), spark.createDataFrame(items, "qid long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = con.sql(f"WITH {TOP} SELECT qid, rank, chunk_id, round(score, 6) FROM top ORDER BY 1, 2").fetchall()
    for block in (8192, 7):
        df = R.bm25_topk(chunks, questions, 20, block)
        assert "Join" not in plan(df)
        assert sorted((x.qid, x.rank, x.chunk_id, round(x.score, 6)) for x in df.collect()) == want
    stats = con.sql("WITH " + TOP.split(", q AS")[0] + " SELECT term, df, tf_total FROM dfs").fetchall()
    assert sorted((x.term, x.df, x.tf_total) for x in R.bm25_stats(chunks).collect()) == sorted(stats)


def test_only_wanted_texts_are_moved(spark):
    from skein.operators import evaluation as E

    chunks = spark.range(2000).selectExpr("id AS chunk_id", "concat('a b c d e ', id, ' f') AS text", "concat('s', id % 3) AS source_file", "cast(id % 2 AS int) AS page_number")
    needles = spark.createDataFrame([(1, "a b c d e 77 f"), (2, "x y z w v u")], "qid long, needle string")
    pages = spark.createDataFrame([("s1", 1)], "source_file string, page_number int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, want in ((E.page_candidates(chunks, pages, 4), [1, 7, 13, 19]), (E.holders(chunks, needles), [77])):
            # ids reach the texts by a broadcast, before any shuffle of texts
            assert "LeftSemi, BuildRight" in plan(df)
            assert sorted(r.chunk_id for r in df.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_structured_chunks_are_cut_once(spark):
    from skein.operators import chunking as C

    pages = spark.range(3).selectExpr("id", "repeat('1. Clause\nword ', 60) AS text")
    df = C.structured_chunks(pages)
    before = df._jdf.queryExecution().optimizedPlan().toString()
    # a filter inferred from the explosion would cut and count all lines again
    assert not [line for line in before.split("\n") if "Filter" in line and ("regexp" in line or "lambda" in line)]


def test_strip_knows_the_white_space_of_the_pattern(spark):
    from pyspark.sql import functions as F

    from skein.functions.text import strip

    code = [i for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000] + [0xFEFF, 0x1F600]
    df = spark.createDataFrame([(f"{chr(i)}{chr(i)}a{chr(i)}b{chr(i)}",) for i in code] + [(chr(i),) for i in code] + [("",), (None,)], "t string")
    old = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert df.where(~strip(F.col("t")).eqNullSafe(old) | (strip(F.col("t")) == "").__ne__(~F.col("t").rlike(r"(?U)\S"))).count() == 0
