"""Centroid clustering with a bisector tournament.

Two centroids i < j part the space by their bisector: x is nearer to j exactly if
``2 (c_j - c_i) . x > |c_j|^2 - |c_i|^2``, and a tie keeps i. All normals and thresholds are whole
numbers and are computed once a round for every pair. A vector starts with centroid 0 as its winner
and meets 1, 2, ... in turn: k - 1 sign tests leave the nearest centroid, the smallest number among
equally near ones. Only then is one distance computed, from the differences.

A round is one job: each task tests its batches and emits one row per centroid with the count and
the component sums (partial sums before any shuffle), Spark adds them up and k rows come back to
the driver, which divides exactly. Vectors are never shuffled; a hot label, a third of all rows
being one vector, or a centroid that wins most rows add to a sum like all others.

Every round reads ``vectors`` again: pass a table, not a long plan.

Defined cases: vectors that are null, not of ``width`` components, or hold a null or non-finite
component take no part; a null id takes part and keeps its null; repeated rows count each; fewer
vectors than k give as many centroids as there are vectors, equal first centroids all stay (the
smallest number wins); an empty table gives no rows; among rows of one id the smaller vector is the
earlier first centroid, null ids come last; other columns are not read. A component whose whole
number exceeds ``LARGEST`` fails the job by name: distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.session import ship_package
from demandloom.sources.staging import stage

WIDTH, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Largest absolute whole-number component: squared distances of 64 components stay below 2**55.
LARGEST = 1 << 23
#: Vectors that meet a challenger together; their normals fit a core's cache.
TOGETHER = 1024


def whole_numbers(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that take part, and their components floor(scale * x) as int64 rows."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == width)
    flat = pc.list_flatten(column.take(pa.array(right)))
    x = flat.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).reshape(len(right), width)  # nulls turn NaN
    finite = np.isfinite(x).all(1)
    v = np.floor(scale * x[finite])
    if np.abs(v).max(initial=0) > LARGEST:
        raise OverflowError(f"a component beyond {LARGEST} / {scale}: distances would leave 64 bits")
    return right[finite], v.astype(np.int64)


class Bisectors:
    """Normals and thresholds of all centroid pairs."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])  # [winner, challenger]
        squares = (centroids**2).sum(1)
        self.thresholds = squares[None, :] - squares[:, None]

    def winners(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of every row, the smallest among equally near ones."""
        width = x.shape[1]
        most = 2.0 * np.abs(x).max(initial=0) * np.abs(self.centroids).max(initial=0) * 2 * width
        kind = np.float64 if most < 2**53 else np.int64  # products in floats while they are exact
        normals, thresholds = self.normals.astype(kind), self.thresholds.astype(kind)
        out = np.zeros(len(x), np.int64)
        for at in range(0, len(x), TOGETHER):
            rows, winner = x[at : at + TOGETHER].astype(kind), out[at : at + TOGETHER]
            for challenger in range(1, len(self.centroids)):
                side = np.einsum("ij,ij->i", normals[winner, challenger], rows)
                winner[side > thresholds[winner, challenger]] = challenger
        return out

    def distances(self, x: np.ndarray, winner: np.ndarray) -> np.ndarray:
        return ((x - self.centroids[winner]) ** 2).sum(1)


def first_centroids(vectors: DataFrame, k: int, id_column: str, vector: str, width: int, scale: int) -> np.ndarray:
    """The k vectors that take part with the smallest sha256 of ``2:<id>``, in ascending hash order."""
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    number = F.sha2(F.concat(F.lit("2:"), F.col(id_column).cast("long").cast("string")), 256)
    some = (
        vectors.where(x.isNotNull()).where((F.size(x) == width) & ~odd)
        .select(number.alias("number"), F.transform(x, lambda c: c.cast("double")).alias("x"))
        .orderBy(F.asc_nulls_last("number"), "x").limit(k).collect()  # at most k rows
    )
    found = pa.array([r.x for r in some], pa.list_(pa.float64()))
    return whole_numbers(found, width, scale)[1]


def _sums(vectors: DataFrame, bisectors: Bisectors, vector: str, width: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Row count and component sums of every centroid that won a row."""
    k = len(bisectors.centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            x = whole_numbers(batch.column(0), width, scale)[1]
            winner = bisectors.winners(x)
            counts += np.bincount(winner, minlength=k)
            np.add.at(totals, winner, x)
        won = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(won, pa.int32()), pa.array(counts[won]), pa.array(list(totals[won]), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"],
        )

    parts = vectors.select(vector).mapInArrow(add, "cluster int, n long, total array<long>")
    # 64-bit sums of a task cannot overflow; those of all tasks are added as decimals
    totals = F.array(*[F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(width)])
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), totals.alias("total"))
    return {r.cluster: (r.n, [int(t) for t in r.total]) for r in found.collect()}  # at most k rows


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE,
    id_column: str = "vec_id", vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids."""
    spark = vectors.sparkSession
    ship_package(spark)
    centroids = first_centroids(vectors, k, id_column, vector, width, scale)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        won = _sums(vectors, Bisectors(centroids), vector, width, scale)
        centroids = centroids.copy()
        for number, (n, totals) in won.items():
            centroids[number] = [t // n for t in totals]  # whole numbers, floor
    bisectors = Bisectors(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_numbers(batch.column(1), width, scale)
            winner = bisectors.winners(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(winner.astype(np.int32)), pa.array(bisectors.distances(x, winner))],
                names=["vec_id", "cluster", "distance"],
            )

    ids = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector)
    return ids.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` to the rows of ``cluster``."""
    spark = assigned.sparkSession
    rows = stage(assigned, "clustered")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    everything = Window.partitionBy()  # over at most k rows
    per_cluster = sums.withColumn("inertia", F.sum("cluster_inertia").over(everything)).join(names, "cluster")
    return rows.join(F.broadcast(per_cluster), "cluster").select(  # at most k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
