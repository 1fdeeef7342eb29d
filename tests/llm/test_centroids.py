"""Centroid clustering against plain distances with Python integers."""

import hashlib
import math

import numpy as np
import pytest

from demandloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", "d") for i, v in rows], SCHEMA)


def by_distances(rows, k, rounds, width, scale=256):
    """{(vec_id, vector): (cluster, distance)} and centroids; no bisectors, no NumPy."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(scale * float(np.float32(x))) for x in v)))
    number = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centers = [list(v) for _, v in sorted(kept, key=number)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for j, vs in members.items():
            centers[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted(((i, *reversed(nearest(v))) for i, v in kept), key=repr), centers


def mixed(seed, n, width):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, width)]) for i in range(n)]
    hot = [0.25] * width
    rows += [(1000 + i, hot) for i in range(n // 2)]  # a third of all rows is one vector
    rows += [(7, rows[7][1]), (None, rows[3][1]), (2000, None), (2001, []), (2002, [0.5] * (width - 1))]
    rows += [(2003, [None] + [0.1] * (width - 1)), (2004, [float("nan")] * width), (2005, [float("inf")] * width)]
    return rows


@pytest.mark.parametrize("k,rounds,width", [(5, 3, 4), (40, 5, 8), (1, 2, 4), (500, 2, 3)])
def test_equals_plain_distances(spark, k, rounds, width):
    rows = mixed(k, 60, width)
    found, centers = centroids.cluster(vectors(spark, rows).repartition(3), k, rounds, width)
    expected, expected_centers = by_distances(rows, k, rounds, width)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected
    assert centers.tolist() == expected_centers


def test_ties_go_to_the_smaller_number():
    middle = centroids.Bisectors(np.array([[4, 0], [-4, 0], [4, 0], [0, 4]]))
    points = np.array([[0, 0], [4, 0], [-1, 0], [0, 9], [2, 2]])
    assert middle.winners(points).tolist() == [0, 0, 1, 3, 0]
    assert middle.distances(points, middle.winners(points)).tolist() == [16, 0, 9, 25, 8]


@pytest.mark.parametrize("size", [3, 1 << 22])
def test_tournament_in_floats_and_in_integers(size):
    rng = np.random.default_rng(size)
    c, x = rng.integers(-size, size, (40, 64)), rng.integers(-size, size, (2500, 64))
    plain = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x[:50]]
    bisectors = centroids.Bisectors(c)
    assert bisectors.winners(x)[:50].tolist() == [min(range(40), key=lambda j: (d[j], j)) for d in plain]
    whole = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (bisectors.winners(x) == whole.argmin(1)).all()


def test_empty_and_nothing_kept(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        found, centers = centroids.cluster(vectors(spark, rows), width=4)
        assert found.collect() == [] and len(centers) == 0
        assert centroids.with_inertia(found, centers).columns[-1] == "centroid_sha256"
        assert centroids.with_inertia(found, centers).collect() == []


def test_components_that_leave_64_bits_fail_by_name(spark):
    table = vectors(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])])
    with pytest.raises(Exception, match="leave 64 bits"):
        centroids.cluster(table, 2, 1, 2)[0].collect()


def test_inertia_and_digests(spark):
    rows = mixed(3, 40, 4)
    found, centers = centroids.cluster(vectors(spark, rows), 6, 2, 4)
    plain, expected = by_distances(rows, 6, 2, 4)
    per = {j: sum(d for _, c, d in plain if c == j) for j in range(6)}
    for r in centroids.with_inertia(found, centers).collect():
        assert r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, expected[r.cluster])).encode()).hexdigest()
