"""Blocks of signatures stay small: a batch of them stands in the executor and in its Python worker at once."""

import numpy as np
from pyspark.sql import functions as F

from demandloom.llm import jaccard
from demandloom.llm.common import BATCH_ROWS


def test_a_batch_of_signature_blocks_is_bounded():
    keys = np.random.default_rng(1).integers(0, 2**63, jaccard.HELD).astype(np.uint64)
    owners = np.arange(jaccard.HELD)
    blocks = jaccard._emit(keys, owners, np.zeros(jaccard.HELD, np.uint8), jaccard.BUCKETS * 8).column(1).to_pylist()
    assert sum(map(len, blocks)) == 15 * jaccard.HELD
    assert BATCH_ROWS * max(map(len, blocks)) < 32 << 20


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles(spark):
    rng = np.random.default_rng(2)
    rows = []
    for size in [1, 30, 64, 100, 350, 900] * 20:
        x = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.integers(0, size) :], rng.integers(0, 1 << 62, rng.integers(0, size + 1)).astype(np.uint64)]))
        for percent in (30, 80):  # at 30 one sketch may be many times as long
            rows.append((*(jaccard.sketch(s, percent).tolist() for s in (x, y)), len(np.setxor1d(x, y))))
    table = spark.createDataFrame(rows, "x array<long>, y array<long>, differ int")
    found = table.select(jaccard._least_difference(F.col("x"), F.col("y")).alias("bits"), "differ").collect()
    assert all(r.bits <= r.differ for r in found) and any(r.bits > r.differ // 2 > 0 for r in found)


def test_pairs_that_do_not_link_are_not_compared(spark, monkeypatch):
    """Near copies, most of them too far from each other: compared pairs stay near the number of links."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(300):
        words = list(base)
        for at in rng.choice(150, rng.integers(2, 10), replace=False):
            words[at] = f"e{rng.integers(40)}"
        texts.append(" ".join(words))
    compared = []
    linked = jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda pairs, *rest: compared.append(pairs.count()) or linked(pairs, *rest))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.similar_documents(table, 5, 80).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    links = [(a, b) for b in range(300) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links and all(found[a] == found[b] for a, b in links)
    assert sum(compared) <= 300 + len(links)


def test_texts_hashed_together_have_their_own_sets(monkeypatch):
    """A task hashes the words of many texts in one array: no shingle reaches into the next text, none is lost."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "B", "cé", "d"], rng.integers(0, 9))).encode() for _ in range(300)] + [b"", b" \t", b"a b c d" * 9]
    for size in (1, 4, 5):
        alone = [next(jaccard.Shingler(size).sets([t])) for t in texts]
        shingles = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if (w := t.lower().split()) else set() for t in texts]
        assert [len(s) for s in alone] == [len(s) for s in shingles]
        assert len({h for s in alone for h in s.tolist()}) == len(set().union(*shingles))
        for together in (1, 40, 100_000):
            monkeypatch.setattr(jaccard, "TEXT_AT_ONCE", together)
            found = list(jaccard.Shingler(size).sets(texts))
            assert len(found) == len(texts) and all(np.array_equal(x, y) for x, y in zip(found, alone))
