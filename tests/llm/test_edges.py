"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import blocks
from skein.llm.anchors import difference_cover_dedup
from skein.llm.bagminhash import deduplicate, near_duplicates
from skein.llm.ctw import ctw_score
from skein.llm.decontam import contaminated, without_contamination
from skein.llm.langid import identify
from skein.llm.lpf import _Batch, lpf_array, previous_factors_of, suffix_array_dedup
from skein.llm.packing import pack_related
from skein.llm.quality import cascade
from skein.llm.sharding import balanced_label_propagation
from skein.llm.text import sliding
from skein.llm.toxicity import toxicity, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block long, node long, key string, bucket int, n int, kept boolean"


def sentence(k: int, n: int) -> str:
    return " ".join(f"w{(k * 7919 + i * 104729) % 5003}" for i in range(n))


TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "tiny text",
    sentence(1, 80),
    sentence(1, 80),
    sentence(2, 60) + " " + sentence(3, 40) + "\n" + sentence(3, 40),
    sentence(3, 40) + "\x0b" + sentence(4, 900),
    "é" * 500 + " ß " + "é" * 500,
    "a" * 1500,
    sentence(5, 30000),
    "<|endoftext|> \U0001f600 x y",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "s", 1, 0.5, 1, 1, "k", 1, 1, True) for i, t in enumerate(TEXTS)]
    rows.append(rows[6])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 20000)


def texts(docs):
    return [r.text or "" for r in docs.select("text").collect()]


def by_covering(units: list, width: int) -> list[list[bool]]:
    count = Counter(tuple(u[i : i + width]) for u in units for i in range(len(u) - width + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if count[tuple(u[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


@pytest.mark.parametrize("width", [3, 12, 20, 35])
def test_anchors(docs, width):
    units = [WORD.findall(t) for t in texts(docs)]
    want = sorted((len(u), sum(g), hashlib.sha256(" ".join(w for w, x in zip(u, g) if not x).encode()).hexdigest()) for u, g in zip(units, by_covering(units, width)))
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in difference_cover_dedup(docs, width).collect())
    assert got == want


@pytest.mark.parametrize("width", [16, 50, 400])
def test_suffix_array_removes_all_copies(docs, width):
    units = [t.encode() for t in texts(docs)]
    want = sorted((len(u), sum(g), hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest()) for u, g in zip(units, by_covering(units, width)))
    got = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_array_dedup(docs, width, "none").collect())
    assert got == want


def keep_first(units: list[tuple[int, bytes]], width: int) -> list[tuple[int, bytes]]:
    """Brute force of the first-copy law, by id and position."""
    seen, out = set(), []
    for i, u in sorted(units):
        gone = [False] * len(u)
        for k in range(len(u) - width + 1):
            w = u[k : k + width]
            if w in seen:
                gone[k : k + width] = [True] * width
            seen.add(w)
        out.append((i, bytes(b for b, x in zip(u, gone) if not x)))
    return out


def test_suffix_array_deals_grams_evenly(spark, monkeypatch):
    letters = np.random.default_rng(7).integers(97, 123, 120_000).astype(np.uint8).tobytes().decode()
    table = spark.createDataFrame([(k, letters[k * 1200 : (k + 1) * 1200]) for k in range(100)], "doc_id long, text string")
    sent, repeated = [], blocks.repeated
    monkeypatch.setattr(blocks, "repeated", lambda x, dtype: sent.append(x) or repeated(x, dtype))
    suffix_array_dedup(table, 200)
    size = Counter()
    for r in sent[0].collect():
        size[r.bucket] += len(r.once) + len(r.more)
    assert len(size) >= 12 and max(size.values()) < 2 * sum(size.values()) / len(size)


def test_suffix_array_holds_few_bytes_a_position():
    letters = np.random.default_rng(7).integers(97, 123, 1 << 18).astype(np.uint8)
    _Batch(letters, np.array([0, len(letters)]), 400)  # tables of powers stay
    tracemalloc.start()
    batch = _Batch(letters, np.array([0, len(letters)]), 400)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(batch.gram) and held < 3 * len(letters)


@pytest.mark.parametrize("width", [1, 2, 7, 100, 101])
def test_sliding_takes_little_memory(width):
    x = np.random.default_rng(width).integers(0, 1 << 60, 150_000).astype(np.uint64)
    for op, whole in ((np.minimum, np.min), (np.maximum, np.max)):
        tracemalloc.start()
        got = sliding(x, width, op)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 2.5 * x.nbytes
        assert np.array_equal(got, whole(np.lib.stride_tricks.sliding_window_view(x, width), axis=1))
    assert len(sliding(x[: width - 1], width, np.minimum)) == 0


def test_suffix_array_keeps_the_first_copy(docs):
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).orderBy("doc_id").coalesce(1)
    want = keep_first([(r.doc_id, (r.text or "").encode()) for r in unique.collect()], 50)
    got = sorted((r.doc_id, bytes(r.kept), r.lang) for r in suffix_array_dedup(unique, 50, "first", columns=("lang", "score")).collect())
    assert [g[:2] for g in got] == want
    assert {g[2] for g in got} == {"en", None}


def test_previous_factors():
    data = np.frombuffer(b"abracadabra" * 3 + b"xyz", np.uint8)
    brute = [max((next((k for k in range(len(data) - i + 1) if i + k >= len(data) or data[j + k] != data[i + k]), 0) for j in range(i)), default=0) for i in range(len(data))]
    assert lpf_array(data).tolist() == brute
    assert previous_factors_of(data, 4).tolist() == [v >= 4 for v in brute]


def test_context_trees(docs):
    got = ctw_score(docs, depth=4).collect()
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in {r.doc_id for r in got}}
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    units = {}
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        units[r.doc_id] = [w.encode().translate(low) for w in WORD.findall(r.text or "")] + [None]
    count = Counter(t for r in rows if not held[r.doc_id] for t in units[r.doc_id])
    total, kinds = sum(count.values()), len(count)
    for r in got:
        u = units[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(u), sum(count[t] > 0 for t in u), total)
        assert math.isclose(r.base_score, sum(math.log10((count[t] + 1) / (total + kinds + 1)) for t in u), rel_tol=1e-9)
        assert r.score < 0 and r.bits_per_byte > 0


def test_context_trees_are_a_distribution():
    """Probabilities of all 256 next bytes add up to one after seen and unseen contexts."""
    import pandas as pd

    from skein.llm.ctw import Trees, log_probability, top_weights
    from skein.llm.text import U64

    rng = np.random.default_rng(5)
    keys, counts = np.unique(rng.integers(97, 100, (4000, 4)) @ np.array([1 << 24, 1 << 16, 1 << 8, 1]), return_counts=True)
    t = Trees(keys.astype(U64), counts, 3, 2)
    node, n0, n1, pw = t.top_nodes()
    k, inv = np.unique(node, return_inverse=True)
    top = top_weights(pd.DataFrame({"node": k, **{c: np.bincount(inv, weights=x) for c, x in (("n0", n0), ("n1", n1), ("kids", pw))}}))
    for ctx in (0x616263, 0x7A7A7A, 0x617A7A):
        p = 2.0 ** log_probability(t, top, (np.arange(256) + (ctx << 8)).astype(U64))
        assert math.isclose(p.sum(), 1.0, rel_tol=1e-9)


def test_quality(docs):
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in cascade(docs).collect())
    want = []
    for t in texts(docs):
        w = WORD.findall(t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        at = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(at)))
    assert got == sorted(want)


def test_sharding(docs):
    got = balanced_label_propagation(docs, 4).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(TEXTS) + 1 and max(sizes.values()) - min(sizes[s] for s in range(4)) <= 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_near_duplicates(spark):
    base = sentence(9, 200).split()
    near = base[:100] + ["changed"] + base[101:]
    far = base[:90] + sentence(10, 110).split()
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base)), (5, None), (6, ""), (None, "alone here"), (8, "x"), (8, "x")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cls = {r.doc_id: r.class_id for r in got}
    assert len(got) == len(rows) and cls == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5, None: None, 8: 8}
    assert sum(r.kept for r in got) == 5


def test_near_duplicates_of_a_template(spark):
    """Texts of one template and ten slots of four fillings, which share crowded buckets: classes are those of all pairs, without any
    round of stars."""
    rng = np.random.default_rng(3)
    slots = rng.integers(0, 4, (300, 10))
    for i in range(3, 300, 4):  # a partner with two other fillings
        slots[i] = slots[i - 1]
        k = int(rng.integers(0, 9))
        slots[i, k : k + 2] = (slots[i, k : k + 2] + 1) % 4
    head = [f"t{k}" for k in range(300)]
    rows = [(i, " ".join(head + [f"s{k}_{x}_{j}" for k, x in enumerate(s) for j in range(20)])) for i, s in enumerate(slots)]
    sets = [Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    at: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    size = np.array([len(s) for s in sets])  # no text repeats a shingle
    assert all(len(s) == sum(s.values()) for s in sets)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        both = np.bincount(np.concatenate([at[x] for x in s]), minlength=len(rows))
        for j in np.flatnonzero(both >= 0.8 * (size[i] + size - both)).tolist():
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    want = [root(i) for i in range(len(rows))]
    assert 100 < len(set(want)) <= 225
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0).collect()}
    assert sum(got[i] != want[i] for i in range(len(rows))) == 0


def test_weighted_signatures_are_unbiased():
    from skein.llm.bagminhash import signatures

    a, b = {1: 3, 2: 1, 3: 5, 4: 2}, {1: 1, 2: 1, 3: 7, 5: 4}
    keys = np.array([*a, *b], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = signatures(np.array([0] * 4 + [1] * 4), keys, np.array([*a.values(), *b.values()]), 2, 4000)
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    assert abs((s[0] == s[1]).mean() - want) < 0.035


def test_deduplicate_keeps_columns(docs):
    out = deduplicate(docs)
    assert out.columns == docs.columns and out.count() == 11


def test_decontamination(spark, docs):
    item = sentence(1, 80).split()
    items = spark.createDataFrame([(1, " ".join(item[10:40])), (2, "never seen " * 9), (3, None), (None, "tiny text"), (4, "Tiny TEXT!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    assert got == {(5, 1), (6, 1), (11, 1), (4, 4), (4, None)}  # the longest text holds all that sentence() makes
    out = without_contamination(docs, items)
    assert out.columns == docs.columns and out.count() == docs.count() - 5


def test_language(spark, docs):
    rows = []
    for i in range(120):
        rows.append((i, " ".join(["the", "thing", "other", "within"][(i + k) % 4] for k in range(30)), "en"))
        rows.append((1000 + i, " ".join(["le", "oiseau", "chaque", "été"][(i + k) % 4] for k in range(30)), "fr"))
    got = identify(spark.createDataFrame([*rows, (9000, "12 34 !", "en"), (9001, None, "fr"), (None, "the other", None)], "doc_id long, text string, lang string")).collect()
    pred = {r.doc_id: r.lang_pred for r in got}
    assert all(pred[i] == lang for i, _, lang in rows) and pred[9000] == pred[9001] == "und" and pred[None] == "en"
    assert all(0 <= r.score <= 1 for r in got) and [r.rejected for r in got if r.lang_pred == "und"] == [True, True]
    assert identify(docs).count() == docs.count()


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id, len(ids := tok.encode(r.text or "", add_special_tokens=False).ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())] += 1
    whole = pack_related(docs, length=1 << 20).collect()
    assert Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in whole) == want
    cut = pack_related(docs, length=64).collect()
    by_seq: dict = {}
    for r in cut:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert sum(r.length for r in cut) == sum(n * c for (_, n, _), c in want.items()) and len(by_seq) == -(-sum(r.length for r in cut) // 64)


def test_toxicity(spark, docs):
    rows = [(i, sentence(i, 40) + (" you worthless clown " if i % 3 == 0 else " fine day ") + sentence(i + 500, 20)) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    more = [(9000, None), (9001, ""), (9002, "w0rthl3ss c l o w n " + sentence(3, 20))]
    got = {r.doc_id: r for r in toxicity(spark.createDataFrame(rows + more, "doc_id long, text string"), labels).collect()}
    assert sum(got[i].predicted != (i % 3 == 0) for i, _ in rows) <= 4
    assert got[9000].score == got[9001].score < 0.5 <= got[9002].score
    assert toxicity(docs, labels.limit(0)).where("score = 0").count() == docs.count()


def test_toxicity_learns_trigrams_of_whole_texts(spark):
    rows = [(i, sentence(i, 1500) + " qxjzv") for i in range(40)]
    assert all(len(t) > 5000 for _, t in rows)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    tri = train(spark.createDataFrame(rows, "doc_id long, text string"), labels).channel.tri
    assert tri["xjz"] == tri["^^q"] == tri["zv$"] > 0


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        difference_cover_dedup(empty), suffix_array_dedup(empty), ctw_score(empty), cascade(empty), balanced_label_propagation(empty), near_duplicates(empty),
        deduplicate(empty), contaminated(empty, items), without_contamination(empty, items), identify(empty), pack_related(empty), toxicity(empty, labels),
    ):
        assert out.count() == 0


@pytest.mark.parametrize("width", [16, 61, 400])
def test_longest_repeat(docs, width):
    units = [t.encode() for t in texts(docs)]
    longest = [max(map(len, bytes(g).split(b"\0")), default=0) for g in by_covering(units, width // 4 * 2)]
    removed = [sum(g) for g in by_covering(units, width)]
    got = sorted((r.n_bytes, r.n_removed, r.longest_repeat) for r in suffix_array_dedup(docs, width, "none", outputs=("longest_repeat",)).collect())
    assert got == sorted(zip(map(len, units), removed, longest))


def test_suffix_array_passes_any_column(spark):
    rows = [(i, "abc " * 30, {"k": i}, [i], "x", b"y", 1.5) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, a array<int>, kept string, kept_text binary, n_bytes double")
    out = suffix_array_dedup(df, 16, "first", columns=("m", "a", "kept", "kept_text", "n_bytes"), outputs=("longest_repeat",))
    assert sorted((r[0]["k"], r[1][0], r[2], bytes(r[3]), r[4], r["doc_id"]) for r in out.collect()) == [(i, i, "x", b"y", 1.5, i) for i in range(3)]


def test_cascade_skips_what_a_rejected_text_need_not_know(spark):
    from pyspark.sql import functions as F

    from skein.llm.quality import rule, verdict

    df = spark.createDataFrame([("a b",), ("c d",)], "__t string")
    rules = {"short": "{n_words} < 5", "never": "CAST(raise_error('evaluated') AS boolean)"}
    assert df.select(verdict(["short", "never"], rules).alias("v")).where("v = 'short'").count() == 2
    with pytest.raises(Exception, match="evaluated"):
        df.select(verdict(["never", "short"], rules).alias("v")).where("v = 'short'").collect()
    assert df.where(rule("NULL > 1")).count() == 0 and df.select(F.lit(1)).count() == 2


def test_cascade_measures_and_clashing_columns(spark, docs):
    out = cascade(docs, keep=("n", "kept", "score"), measures=("n_words",))
    assert out.columns == ["doc_id", "n", "kept", "score", "n_words", "rejected_by", "kept"]
    whole = {(r.n_words, r.rejected_by is None) for r in cascade(docs).select("n_words", "rejected_by").collect()}
    assert {(r[4], r[5] is None) for r in out.collect()} == whole


def test_sharding_beside_a_hot_group(spark):
    """A group of a third of all rows and pairs: the pairs come together though some shards are full."""
    rows = [(i, "hot") for i in range(3000)] + [(3000 + i, f"pair {i // 2}") for i in range(4000)] + [(7000 + i, f"single {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = balanced_label_propagation(df, 8).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
    shard = {r.doc_id: r.shard for r in got}
    cut = sum(shard[3000 + 2 * k] != shard[3001 + 2 * k] for k in range(2000))
    assert cut < 40 and len({shard[i] for i in range(3000)}) <= 4


def test_similarity_does_not_depend_on_other_items():
    from skein.llm.decontam import Index

    item = sentence(1, 40)
    text = (sentence(77, 30) + " " + item.replace(item.split()[20], "changed") + " " + sentence(78, 20)).encode()
    alone = Index([(1, item.encode())], 0.6).matches([text])
    among = Index([(1, item.encode())] + [(k, sentence(1, 20 + k).encode()) for k in range(2, 60)], 0.6).matches([text])
    assert alone and alone[0] == next(m for m in among if m[1] == 1)


def test_windows_like_items_against_all_windows():
    """Best windows and similarities are those of all windows and items, but for few at the threshold."""
    from skein.llm.decontam import Index

    rng = np.random.default_rng(11)
    vocab = [f"v{k}" * (1 + k % 3) for k in range(4000)]
    items = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(30, 50, 240)]
    docs, want = [], {}
    for k, t in enumerate(items):
        w = t.split()
        for p in rng.choice(len(w), k % 4, replace=False):
            w[p] = "other"
        docs.append(" ".join([*rng.choice(vocab, 15), *w, *rng.choice(vocab, 9)]))

    def bag(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    def weigh(b):
        return sum(sum(map(len, s)) * c for s, c in b.items())

    for d, t in enumerate(docs):
        w = t.split()
        for i, x in enumerate(items):
            if not set(x.split()) & set(w):
                continue
            own = bag(x.split())
            n = len(x.split())
            sims = [weigh(b & own) / (weigh(b) + weigh(own) - weigh(b & own)) for b in (bag(w[p : p + n]) for p in range(len(w) - n + 1))]
            if sims and max(sims) >= 0.8:
                want[d, i] = (int(np.argmax(sims)), round(max(sims), 9))
    found = Index([(i, t.encode()) for i, t in enumerate(items)], 0.8).matches([t.encode() for t in docs])
    got = {(d, i): (p, round(sim, 9)) for d, i, p, _, sim in found}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) > 40
    assert all(got[k] == want[k] for k in got)


@pytest.mark.parametrize(
    ("text", "word"),
    [("shi7 x", "shit"), ("a$$ x", "ass"), ("$h1+ now", "shit"), ("f--u--c--k it", "fuck"), ("b. i. t. c. h. y", "bitch"), ("a s s h o l e then", "asshole"), ("$tupid", "stupid"), ("!diot", "idiot"), ("clas$", "class"), ("(@pple)", "apple"), ("st" + "u" * 70 + "pid", "stupid"), ("s-" + "t-" * 90 + "u-p-i-d", "stupid")],
)
def test_obfuscated_words_are_read(text, word):
    from skein.llm.text import word_spans
    from skein.llm.toxicity import Channel, suspicious

    tri: dict = {}
    for w in ("shit", "ass", "fuck", "bitch", "asshole", "stupid", "idiot", "class", "apple"):
        x = "^^" + w + "$"
        for k in range(len(x) - 2):
            tri[x[k : k + 3]] = tri.get(x[k : k + 3], 0) + 9
    c = Channel(tri)
    buf = np.frombuffer(text.encode() + b"\n", np.uint8)
    assert any(word in r for _, t in suspicious(buf, *word_spans(buf)) for r in c.restore(t))


def test_runs_of_packing_span_batches():
    import pyarrow as pa

    from skein.llm.packing import RUN, _runs

    batches = [pa.RecordBatch.from_arrays([pa.array(range(k * 1000, k * 1000 + 1000))], names=["x"]) for k in range(10)]
    got = list(_runs(iter(batches)))
    assert [t.num_rows for t in got] == [RUN, RUN, 10_000 - 2 * RUN] and sum((t.column(0).to_pylist() for t in got), []) == list(range(10_000))


def test_walk_goes_from_low_degrees_to_the_closest():
    from skein.llm.packing import walk

    #  0 - 1 - 2 (weights 1, 3), 1 - 3 (weight 2), 4 alone
    near = [{1: 1}, {0: 1, 2: 3, 3: 2}, {1: 3}, {1: 2}, {}]
    assert walk(near) == [4, 0, 1, 2, 3]


def test_rejected_languages_go_and_columns_stay(spark):
    from skein.llm.langid import plausible

    names = "doc_id long, text string, lang string, score int, rejected string, held_out map<string,int>, lang_pred array<int>"
    rows = [(i, " ".join(["the", "thing", "other", "within"][(i + k) % 4] for k in range(30)), "en", 1, "r", {"k": i}, [i]) for i in range(80)]
    rows += [(900, None, None, None, None, None, None), (901, "12 !", "en", 1, "r", {}, [])]
    df = spark.createDataFrame(rows, names)
    out = plausible(df)
    assert out.schema == df.schema and sorted(r.doc_id for r in out.collect()) == list(range(80))
    assert plausible(df.limit(0)).count() == 0
    passed = identify(df, columns=("score", "rejected", "held_out"))
    assert passed.columns == ["doc_id", "score", "rejected", "held_out", "held_out", "lang_pred", "score", "bits_per_char", "rejected"]
    assert passed.count() == 82


def test_only_windows_that_a_block_holds_twice_are_ranked(monkeypatch):
    """All grams lie in other blocks too, but only some passages of the block repeat in it: the ranks need not sort the rest."""
    import pandas as pd
    import zstandard

    from skein.llm import lpf

    texts = [f"{sentence(7, 60)} {sentence(8, 400)}".encode(), f"{sentence(9, 300)} {sentence(7, 60)}".encode(), sentence(10, 500).encode()]
    raw = b"".join(t + b"\n" for t in texts)
    row = pd.Series({"block": 0, "ids": np.arange(3).tobytes(), "known": np.ones(3, bool).tobytes(), "lens": np.array([len(t) for t in texts]).tobytes(), "text": zstandard.compress(raw), "raw": len(raw), "extra": None})
    grams = np.unique(np.concatenate([lpf._Batch(buf, offs, 100).gram for *_, buf, offs in blocks.Block(row).batches()]))
    answer = pd.DataFrame([(k, x.tobytes()) for k, x in blocks.deal(grams, 4)], columns=["bucket", "found"])
    cells = lpf._Cells(blocks.Block(row), answer, 100, 4, False)
    sorted_bytes, plain = [], lpf.suffix_ranks
    monkeypatch.setattr(lpf, "suffix_ranks", lambda data, depth: (sorted_bytes.append(len(data)), plain(data, depth))[1])
    later, shared = lpf._copies(cells)
    starts = np.concatenate([own[0][0] for _, own in cells.parts])
    windows = [raw[i : i + 100] for i in starts]
    count, seen = Counter(windows), set()
    assert shared.tolist() == [count[w] > 1 for w in windows]
    assert later.tolist() == [w in seen or bool(seen.add(w)) for w in windows]
    twice = {i + k for i, w in zip(starts.tolist(), windows, strict=True) if count[w] > 1 for k in range(100)}
    assert sum(sorted_bytes) == len(twice) < len(raw) // 2


def test_packing_finds_neighbours_in_the_whole_corpus(spark):
    """3,000 pairs of texts that share six of ten words lie in two runs; those that agree in a sketch value follow each other."""
    from skein.llm.packing import sketches

    texts = {2 * k + side: " ".join([f"p{k}x{i}" for i in range(6)] + [f"q{k}x{side}x{i}" for i in range(2)]) for k in range(3000) for side in (0, 1)}
    got = pack_related(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), length=1 << 20).orderBy("sequence_id", "offset").collect()
    at = {r.doc_id: k for k, r in enumerate(got)}
    sk = sketches([texts[i].encode() for i in range(6000)])
    related = [k for k in range(3000) if (sk[2 * k] == sk[2 * k + 1]).any()]
    assert len(at) == 6000 and len(related) > 2900
    assert all(abs(at[2 * k] - at[2 * k + 1]) == 1 for k in related)


def test_paths_and_cycles_are_placed(spark):
    from skein.llm.packing import placed

    rng = np.random.default_rng(5)
    want, sides = [], {}
    for size, ring in [(1, False), (2, True), (3, True), (7, True), (40, True), (2, False), (5, False), (100, False), (33, True)]:
        first = len(sides)
        rows = [int(x) for x in first + rng.permutation(size)]
        sides |= {x: [-1, -1] for x in rows}
        for x, y in zip(rows, rows[1:] + rows[:1] * ring):
            i, j = (int(rng.choice([s for s in (0, 1) if sides[z][s] < 0])) for z in (x, y))
            sides[x][i], sides[y][j] = 2 * y + j, 2 * x + i
        want.append((set(rows), {frozenset(p) for p in zip(rows, rows[1:] + rows[:1] * ring)}))
    got: dict = {}
    for r in placed(spark.createDataFrame([(x, *s) for x, s in sides.items()], "row long, a long, b long")).orderBy("path", "place").collect():
        got.setdefault(r.path, []).append(r.row)
    assert sorted(map(sorted, got.values())) == sorted(sorted(rows) for rows, _ in want)
    for rows in got.values():
        pairs = next(p for r, p in want if r == set(rows))
        assert all(frozenset(p) in pairs for p in zip(rows, rows[1:]))


def test_no_free_sides_that_agree_are_left_on_two_paths():
    from skein.llm.packing import STEPS, link

    rng = np.random.default_rng(3)
    sketch = rng.integers(0, 60, (500, 4))
    row, sides, label = np.arange(500), np.full((500, 2), -1), np.arange(500)
    for _, sets in STEPS:
        for values in sets:
            link(row, sketch, sides, label, values)
            ends = np.flatnonzero((sides < 0).any(axis=1))
            groups: dict = {}
            for x in ends:
                groups.setdefault(tuple(sketch[x, list(values)]), set()).add(int(label[x]))
            assert all(len(g) == 1 for g in groups.values())
    other = np.where(sides < 0, -1, sides >> 1)
    assert all(x in other[y] for x in range(500) for y in other[x] if y >= 0)
    assert sum((sketch[x] == sketch[y]).any() for x in range(500) for y in other[x] if y >= 0) == (other >= 0).sum()


def test_toxicity_learns_from_all_labelled_rows(spark):
    """6,000 rows of one label, all but the held-out and the calibrating ones counted; the regression is that of all calibrating rows."""
    bad = [i for i in range(6300) if i % 21 == 0]
    docs = spark.createDataFrame([(i, f"qzx {sentence(i, 3)} " + ("you worthless clown" * (i % 5 > 0) if i in set(bad) else "clown" * (i % 11 == 0))) for i in range(6300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 21 == 0)) for i in range(6300)], "doc_id long, toxic int")
    used = docs.join(labels, "doc_id").where("crc32(CAST(doc_id AS string)) % 5 <> 0").selectExpr("text", "toxic", "pmod(xxhash64(CAST(doc_id AS string), 5), 10) < 4 AS late").collect()
    scorer = train(docs, labels)
    assert scorer.channel.tri["qzx"] == sum(not r.late for r in used)
    from skein.llm.toxicity import _newton, _sums

    late = [r for r in used if r.late]
    x, y = scorer.describe([r.text.encode() for r in late]), np.array([r.toxic for r in late], float)
    all_used = [r.toxic for r in spark.createDataFrame([(i,) for i in range(6300)], "i long").where("crc32(CAST(i AS string)) % 5 <> 0").selectExpr("CAST(i % 21 = 0 AS int) AS toxic").collect()]
    share = sum(all_used) / len(all_used)
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    assert np.allclose(scorer.coef, _newton(lambda b: _sums(x, y, w, b), 6), atol=1e-6)


def test_closest_pairs_are_linked_first():
    from skein.llm.packing import SIGNATURE, WIDE, close, packed

    rng = np.random.default_rng(8)
    values = rng.integers(0, 2**62, (300, SIGNATURE))
    values[:, 5] = rng.integers(0, 20, 300)  # groups of about 15
    for k in range(0, 240, 3):  # of three rows, two share many values and the third some with both
        values[k + 1, :18], values[k + 2, 3:12] = values[k, :18], values[k, 3:12]
    sketch = packed(values)
    assert sketch.shape == (300, 3 * WIDE + SIGNATURE)
    for least in (16, 8):
        row, sides, label = np.arange(300) * 7, np.full((300, 2), -1), np.arange(300) * 7
        close(row, sketch, sides, label, 5, least)
        other = np.where(sides < 0, -1, (sides >> 1) // 7)
        linked = {(x, y) for x in range(300) for y in other[x].tolist() if y >= 0}
        assert all((y, x) in linked and (values[x] == values[y]).sum() >= least and label[x] == label[y] for x, y in linked)
        assert all((k, k + 1) in linked for k in range(0, 240, 3))
        assert len(linked) == 2 * 80 * (1 + (least == 8))


def test_encoding_without_look_ahead_gives_equal_ids(monkeypatch):
    """Texts in which no two blanks meet never take the slower pattern; all others, whatever their blanks, keep their ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from skein.llm import packing

    voc, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = ["", "a", " a b", "it's\tours\n", "naïve café 1234 #?", "ends <|endoftext|> here", "x\x1cy 日本語"]
    blanks = [chr(c) for c in (32, 10, 9, 0x1C, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000)]
    runs = [f"word{a}{b}word {a}{b}{c}" for a in blanks for b in blanks for c in ("", "end", "!")] + ["  ", "x" * 3000, f"a  {'y' * 2500} b"]
    tok = Tokenizer.from_file(voc)
    for texts in (plain, runs, [*plain, *runs]):
        got = packing.encode([t.encode() for t in texts], voc, ranks)
        assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    slow, fast = packing._tokenizers[voc, ranks]
    monkeypatch.setitem(packing._tokenizers, (voc, ranks), (None, [None, fast[1]]))
    assert len(packing.encode([t.encode() for t in plain], voc, ranks)) == len(plain)
