"""Registered queries against SQL or brute force over the smallest tables."""

import re
import zlib
from collections import Counter

import pytest

from skein.llm.queries import ORACLE, QUERIES
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == []


def test_near_duplicate_classes(spark):
    """Union of all pairs of texts whose five-word multisets overlap by 0.8."""
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sets = {}
    for i, t in rows.items():
        w = WORD.findall(t)
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter({(): 1})
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and sets[a].keys() & sets[b].keys():
                both = sum((sets[a] & sets[b]).values())
                if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    got = {r.doc_id: r.class_id for r in QUERIES["op6_bagminhash"](spark, SF).collect()}
    assert got == {i: root(i) for i in ids}


def test_verbatim_items_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_simhash_windows"](spark, SF).collect()}
    assert {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text} <= got


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in QUERIES["op5_kneser_ney"](spark, sf).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in held) <= 0.02 * len(held)


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in QUERIES["op10_noisy_channel"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    right = sum(r.predicted == toxic[r.doc_id] for r in held)
    found = sum(r.predicted for r in held if toxic[r.doc_id])
    assert right >= 0.95 * len(held) and found >= 0.8 * sum(toxic[r.doc_id] for r in held)


def test_held_out_scores_beat_the_base(spark):
    held = [r for r in QUERIES["op1_context_tree"](spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
