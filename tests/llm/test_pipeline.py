"""Each stage of the pipeline against a brute-force version on its own input."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from skein.llm.storage import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(materialize(f(spark, out[-1], SF), name))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_language_keeps_clean_texts(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    gone = before.keys() - after.keys()
    assert len(gone) <= 0.02 * len(before)
    assert all(after[i] == before[i] for i in after)


def test_near_duplicates(stages):
    """No two texts that are kept overlap by 0.8, and each that goes overlaps a class that stays."""
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def bag(t):
        w = word.findall(t)
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))

    def like(a, b):
        both = sum((a & b).values())
        return both >= 0.8 * (sum(a.values()) + sum(b.values()) - both)

    bags = {i: bag(r.text) for i, r in by_id(stages[1]).items()}
    kept = by_id(stages[2]).keys()
    links = {i: {j for j in bags if j != i and like(bags[i], bags[j])} for i in bags}
    assert all(not (links[i] & kept) for i in kept)
    for i in bags.keys() - kept:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert min(seen) in kept


def test_substrings(stages):
    seen, want = set(), {}
    for i, r in sorted(by_id(stages[2]).items()):
        t = r.text.encode()
        gone = [False] * len(t)
        for k in range(len(t) - 199):
            w = hashlib.blake2b(t[k : k + 200], digest_size=12).digest()
            if w in seen:
                gone[k : k + 200] = [True] * 200
            seen.add(w)
        want[i] = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
    got = by_id(stages[3])
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_contaminated_texts_go(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = by_id(stages[3]), by_id(stages[4])
    assert not any(t in r.text for r in after.values() for t in items)
    assert all(after[i] == before[i] for i in after) and len(after) >= len(before) - 2 * sum(any(t in r.text for t in items) for r in before.values())


def test_packing(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for i, r in by_id(stages[4]).items()}
    got = stages[5].collect()
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got)
    assert sum(r.length for r in got) == sum(map(len, ids.values()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, name):
    """Nulls in every column, repeated rows, a long text, clashing names and types, and an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score map<string,int>, rejected string, held_out array<int>, lang_pred int, kept string, kept_text binary, n_bytes double, node long, key string, band int, start string, bits_per_char int"
    words = ["the", "thing", "other", "within", "again", "upon"]
    text = lambda k, n: " ".join(words[(k * 31 + i * i) % 6] + words[(k + i * 7) % 6] for i in range(n))
    more = ({"a": 1}, "r", [1], 2, "kept", b"x", 0.5, 3, "key", 4, "s", 5)
    rows = [(i, text(i, 120), "en", "s", 10, *more) for i in range(30)]
    rows += [rows[4], (50, text(77, 40_000), "en", None, None, *more), (None, None, None, None, None, *[None] * 12), (51, "", "en", "s", 0, *more), (None, text(5, 90), None, "s", 1, *more)]
    df = spark.createDataFrame(rows, schema)
    out = stage(spark, df, SF)
    got = out.collect()
    assert 0 < len(got) and (name == "packing" or out.columns == df.columns)
    if name not in ("packing", "near_duplicate", "language"):
        assert sum(r.text is None for r in got) == 1 and len(got) == len(rows)
    assert stage(spark, df.limit(0), SF).count() == 0


def test_packing_stage_finds_neighbours_in_the_whole_corpus(spark):
    """Pairs of related texts lie further apart than a run of rows; of those with a common sketch value, both are side by side."""
    from skein.llm.packing import sketches

    texts = [" ".join([f"p{k}x{i}" for i in range(6)] + [f"q{k}x{side}x{i}" for i in range(2)]) for side in (0, 1) for k in range(2500)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.packing(spark, docs, "").where("start = 0").orderBy("sequence_id", "offset").collect()
    at = {r.doc_id: k for k, r in enumerate(got)}
    sk = sketches([t.encode() for t in texts])
    related = [k for k in range(2500) if (sk[k] == sk[k + 2500]).any()]
    assert len(at) == 5000 and len(related) > 2400
    assert all(abs(at[k] - at[k + 2500]) == 1 for k in related)


def test_packing_stage_puts_close_texts_side_by_side_among_loosely_related_ones(spark):
    """Pairs of texts share about half of their words, and all texts share frequent words with many others."""
    rng = np.random.default_rng(11)
    words = []
    for k in range(600):
        own = [f"p{k}x{i}" for i in range(24)]
        words += [{*own, *(f"q{k}x{side}x{i}" for i in range(4)), *(f"w{i}" for i in rng.choice(60, 10, replace=False))} for side in (0, 1)]
    order = rng.permutation(len(words)).tolist()
    docs = spark.createDataFrame([(i, " ".join(sorted(words[i])), "en", "web", 0) for i in order], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.packing(spark, docs, "").where("start = 0").orderBy("sequence_id", "offset").collect()
    at = {r.doc_id: k for k, r in enumerate(got)}
    close = [k for k in range(600) if len(words[2 * k] & words[2 * k + 1]) >= 0.5 * len(words[2 * k] | words[2 * k + 1])]
    assert len(at) == 1200 and len(close) > 300
    assert sum(abs(at[2 * k] - at[2 * k + 1]) == 1 for k in close) >= 0.97 * len(close)
