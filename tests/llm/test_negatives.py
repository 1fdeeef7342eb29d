"""Hard negatives against all pairs; the threshold algorithm by itself."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, "s", "b") for i, v, c in rows], SCHEMA)


def all_pairs(rows, every, low=80, high=100, positives=5, wanted=5):
    kept = {}
    for i, v, c in rows:
        if i is None or v is None or c is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = (c, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, one), one)
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in kept.items() if i != a}
        best = lambda ids, k: sorted(ids, key=lambda i: (-score[i], i))[:k]
        for p in best([i for i in score if kept[i][0] == label], positives):
            inside = [i for i in score if kept[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(best(inside, wanted), 1)]
    return sorted(out)


def mine(spark, rows, every, **sizes):
    found = negatives.mine(negatives.whole_rows(table(spark, rows), F.col("label")), F.col("vec_id") % every == 0, **sizes)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def mixed(n=160, width=6):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, width)], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, [0.5] * width, i % 2) for i in range(n // 2)]  # ties over blocks: a third of all rows is one vector
    rows += [(2000 + i, [float(-i % 3), 0.0], 9) for i in range(8)]  # short vectors, negative scores
    rows += [(10, rows[11][1], 0), (3, rows[3][1], rows[3][2]), (3000, [0.1] * width, 77), (3010, [0.0] * width, 1)]
    rows += [(None, [0.1] * width, 1), (4000, None, 1), (4001, [], 1), (4002, [None, 0.1], 1), (4003, [math.nan] * width, 1)]
    return rows + [(4010, [math.inf] * width, 1), (4020, [0.3] * width, None)]


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "group": 3}, {"block": 1, "group": 1000}])
def test_equals_all_pairs(spark, sizes):
    rows = mixed(60 if sizes.get("block") == 1 else 160)
    expected = all_pairs(rows, 10)
    assert len(expected) > 100
    assert mine(spark, rows, 10, **sizes) == expected


def test_other_windows_and_counts(spark):
    rows = mixed()
    found = mine(spark, rows, 20, positives=2, negatives=3, low=-50, high=120, block=32)
    assert found == all_pairs(rows, 20, -50, 120, 2, 3)


@pytest.mark.parametrize("rows", [[], [(10, [1.0], 1)], [(10, [1.0], 1), (11, [1.0], 2)], [(11, [1.0], 1), (12, [1.0], 1)]])
def test_nothing_to_mine(spark, rows):
    assert mine(spark, rows, 10) == []


def test_scores_that_leave_64_bits_fail_by_name(spark):
    with pytest.raises(Exception, match="leave 64 bits"):
        mine(spark, [(10, [1e15], 1), (11, [1e15], 1), (12, [1e15], 2)], 10)


def test_threshold_stops_before_all_candidates_are_scored():
    """Few long dimensions: the best candidates stand at the ends of the lists."""
    rng = np.random.default_rng(2)
    rows = rng.integers(-1000, 1000, (2000, 2)).astype(np.float64)
    lists, ids = negatives.Lists(np.arange(2000), rows), np.arange(2000)
    nothing = np.zeros(2000, bool)
    for anchor in rng.integers(-9, 9, (30, 2)).astype(np.float64):
        scores = rows @ anchor
        top = scores.max()
        windows, starts = np.array([[-1e9, 1e9], [0.8 * top, 0.95 * top]]), np.full(2, -1e18)
        found, scored = lists.search(anchor, nothing, windows, starts, 5)
        for (low, high), (at, got) in zip(windows, found):
            inside = ids[(scores >= low) & (scores <= high)]
            assert at.tolist() == sorted(inside, key=lambda i: (-scores[i], i))[:5]
            assert got.tolist() == scores[at].tolist()
        assert scored < 1200 or not anchor.any()
    above = np.full(2, 1000 * np.abs(anchor).sum() + 1)  # others are known to be better: nothing is read
    assert lists.search(anchor, nothing, windows, above, 5)[1] == 0 or not anchor.any()


def test_a_search_far_down_tests_its_threshold_rarely():
    """Wide random vectors: nearly all candidates are met before the threshold falls; reads double, results are whole."""
    rng = np.random.default_rng(5)
    rows, anchor = rng.integers(-40, 41, (2048, 64)), rng.integers(-40, 41, 64)
    lists, reads = negatives.Lists(np.arange(2048), rows), []

    class Counted:
        def __init__(self, order):
            self.order = order

        def __getitem__(self, where):
            reads.append(where)
            return self.order[where]

    lists.order = Counted(lists.order)
    scores = rows @ anchor
    windows = np.array([[0, np.sort(scores)[-10]], [-(10**9), 10**9]])
    found, scored = lists.search(anchor, np.zeros(2048, bool), windows, np.full(2, negatives.NOTHING), 5)
    assert scored > 1500 and len(reads) <= 2 * 9  # both ends of the lists; 8 + 16 + .. + 2048 is beyond the block
    for (low, high), (at, got) in zip(windows, found):
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        want = inside[np.lexsort((inside, -scores[inside]))[:5]]
        assert at.tolist() == want.tolist() and got.tolist() == scores[want].tolist()
