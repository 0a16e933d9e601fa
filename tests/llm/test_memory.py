"""Memory that Python workers take beside an executor's heap."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import bagminhash, langid, lpf, packing, text


class Caught:
    """Stands for a DataFrame of the operators; mapInArrow gives the function itself."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def most(work) -> float:
    """MB at most while ``work`` runs."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    return [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 500)).encode() for _ in range(1000)]


def test_described_batch(spark, texts, monkeypatch):
    """A full Arrow batch of 3 MB of texts, 176 MB before; the cuts of a batch don't change what is described."""
    monkeypatch.setattr(text, "_tables", {})
    run = bagminhash._described(Caught(spark), bagminhash.BANDS, bagminhash.ROWS)
    batch = pa.RecordBatch.from_arrays([pa.array([b"%d" % k for k in range(len(texts))]), pa.array(texts, pa.binary())], names=["key", "text"])
    assert most(lambda: [None for _ in run(iter([batch]))]) < 80
    parts = pa.Table.from_batches(run(iter([batch])))
    d, h, c = bagminhash.shingles(texts)
    keys = bagminhash.band_keys(bagminhash.signatures(d, h, c, len(texts))).view(np.int64)
    assert parts.column("bands").to_pylist() == keys.tolist()
    assert parts.column("n").to_pylist() == [496] * len(texts)


def test_scored_at_once(texts):
    """A batch is scored in parts; scores are those of all texts together."""
    model = langid.Identifier(["a", "b"], [langid.Model(*langid._count(texts[k : k + 20])) for k in (0, 20)], np.ones((2, 3)))
    whole = model.predict(texts[:300])
    assert most(lambda: [model.predict(texts[k : k + langid.AT_ONCE]) for k in range(0, 300, langid.AT_ONCE)]) < 0.5 * most(lambda: model.predict(texts[:300]))
    parts = [model.predict(texts[k : k + langid.AT_ONCE]) for k in range(0, 300, langid.AT_ONCE)]
    assert [x for p in parts for x in p["score"]] == whole["score"].tolist()


def test_suffix_ranks(texts):
    """35 bytes a byte of text at most, 89 before; ranks are dense and in the order of the prefixes."""
    data = np.frombuffer(b"\n".join(texts[:300]), np.uint8)
    assert most(lambda: lpf.suffix_ranks(data, 200)) * 1e6 < 42 * len(data)
    small = np.frombuffer(b"abracadabra abracadabra\xff\x00\xff", np.uint8)
    for depth in (1, 3, 7, 8, 30):
        prefixes = [bytes(small[k : k + depth]) for k in range(len(small))]
        order = {p: k for k, p in enumerate(sorted(set(prefixes)))}
        assert lpf.suffix_ranks(small, depth).tolist() == [order[p] for p in prefixes]


def test_powers_kept(monkeypatch):
    """A long text's powers are right and don't stay."""
    monkeypatch.setattr(text, "_tables", {})
    n = 3 << 20
    t = text.powers(text._P, n)
    assert len(t) == n and all(int(t[k]) == pow(text._P, k, 2**64) for k in (0, 1, 70_000, n - 1))
    assert sum(map(len, text._tables.values())) <= text.KEPT_POWERS
    text.powers(text._P, 100_000)
    assert len(text._tables[text._P]) == 1 << 17


def test_tokenizer_of_long_pieces_waits():
    """The slow tokenizer is loaded where a text has a long piece, and not before."""
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    packing._slow.cache_clear()
    (a,) = packing.encode([b"plain words"], *files)
    assert not packing._slow.cache_info().currsize
    b, c = packing.encode([b"plain words", b"x" * 3000], *files)
    assert packing._slow.cache_info().currsize == 1
    assert a.tolist() == b.tolist() and c.tolist() == packing._slow(files[0]).encode("x" * 3000, add_special_tokens=False).ids


def test_tasks_give_back(monkeypatch):
    seen = []
    monkeypatch.setattr(text, "give_back", lambda: seen.append("back"))
    for x in text.lean(lambda batches: (2 * b for b in batches))(iter([1, 2])):
        seen.append(x)
    assert seen == [2, 4, "back"]
    monkeypatch.undo()
    text.give_back()
