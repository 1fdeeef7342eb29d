"""Exact top-k inner products with a pivot-distance index.

Index: components become floor(1024 * x); each vector is keyed by its nearest pivot and its distance
to it, and the keys are range-partitioned (vec_id breaks ties, so equal vectors split). A partition
is a run of sorted annuli. Search: for a block of queries, an annulus with distances [lo, hi] to
pivot p and norms up to m holds no vector x with

    q.x > (|q|^2 + m^2 - gap^2) / 2,   gap = max(0, |q-p| - hi, lo - |q-p|)

because |q-x| >= gap by the triangle inequality. Annuli are visited from the best bound down and a
query stops at the first bound below its k-th score. The k-th score starts from the exact scores of a
bounded sample of the vectors (also the source of the pivots): a lower bound for the whole table.

Queries are taken in blocks of bounded size against all rows; only a block, the pivots and the
sample are ever in the driver. Scores are integers and exact (float64 products below 2**53, else
64-bit integers); a vector so long that its scores could leave 64 bits fails the job by its id.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part;
null ids take no part; shorter vectors count as padded with 0; repeated rows are candidates each; a
query id that occurs several times is searched once, with its smallest vector; no row is a
candidate of its own id; fewer than k candidates give all of them; ties go to the smaller vec_id;
empty tables give no rows; only the id and the vector column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.sources.staging import new_folder, stage

SCALE = 1024
#: Bounded sample of vectors for pivots and first bounds, number of pivots, queries per block, rows per annulus.
SAMPLE, PIVOTS, BLOCK, ANNULUS = 4096, 64, 1024, 256
#: Squared length of a scaled vector below which no product of two can leave 64 bits (a score is at most the larger).
MAX_SQUARE = 2.0**62


def to_ints(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as arrays of whole numbers."""
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(SCALE * c.cast("double")))
    square = F.aggregate(x, F.lit(0.0), lambda total, c: total + F.pow(SCALE * c.cast("double"), F.lit(2.0)))
    too_long = F.raise_error(F.concat(F.lit("vector too long for 64-bit scores: id "), F.col(id_column).cast("string")))
    return (
        vectors.where(x.isNotNull() & F.col(id_column).isNotNull())
        .where((F.size(x) > 0) & ~odd)
        .select(
            F.col(id_column).cast("long").alias("vec_id"),
            F.when(square < MAX_SQUARE, whole).otherwise(too_long.cast("array<bigint>")).alias("v"),
        )
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


class Index:
    """Staged keys (pivot, distance, norm, vec_id, v) with the pivots and the sample."""

    def __init__(self, ints: DataFrame, sample: int = SAMPLE, pivots: int = PIVOTS):
        order = F.xxhash64("vec_id", "v")
        some = ints.orderBy(order, "vec_id").limit(sample).collect()  # bounded by the parameter
        self.width = max((len(r.v) for r in some), default=1)
        longest = ints.agg(F.max(F.size("v"))).first()[0]
        self.width = max(self.width, longest or 1)
        self.sample_ids = np.array([r.vec_id for r in some], np.int64)
        self.sample = np.zeros((len(some), self.width), np.int64)
        for k, r in enumerate(some):
            self.sample[k, : len(r.v)] = r.v
        distinct = np.unique(self.sample, axis=0) if len(some) else np.zeros((1, self.width), np.int64)
        pick = np.random.default_rng(7).permutation(len(distinct))[:pivots]
        self.pivots = distinct[np.sort(pick)].astype(np.float64)
        self.rows = stage(self._keyed(ints).repartitionByRange("pivot", "distance", "vec_id"), "pivot-index")

    def _keyed(self, ints: DataFrame) -> DataFrame:
        pivots, width = self.pivots, self.width

        def key(batches):
            squares = (pivots**2).sum(1)
            for batch in batches:
                x = _matrix(batch.column(1), width).astype(np.float64)
                norms = (x**2).sum(1)
                d2 = norms[:, None] + squares[None, :] - 2 * x @ pivots.T
                nearest = d2.argmin(1)
                # the distance again, from differences: exact enough for the bound's margin
                distance = np.sqrt(((x - pivots[nearest]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nearest, pa.int32()), pa.array(distance), pa.array(norms), batch.column(0), batch.column(1)],
                    names=["pivot", "distance", "norm", "vec_id", "v"],
                )

        return ints.mapInArrow(key, "pivot int, distance double, norm double, vec_id long, v array<long>")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -scores, q))
    sorted_q = q[order]
    first = np.searchsorted(sorted_q, sorted_q, side="left")
    return order[np.arange(len(order)) - first < k]


NOTHING = np.iinfo(np.int64).min


def _first_bounds(index: Index, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score within the sample, for each query."""
    if len(index.sample_ids) == 0:
        return np.full(len(ids), NOTHING)
    scores = _products(queries, index.sample)
    scores[ids[:, None] == index.sample_ids[None, :]] = NOTHING
    if scores.shape[1] < k:
        return np.full(len(ids), NOTHING)
    return -np.partition(-np.maximum(scores, NOTHING + 1), k - 1, axis=1)[:, k - 1]


def _search_block(index: Index, ids: np.ndarray, queries: np.ndarray, k: int, annulus: int) -> DataFrame:
    bounds = _first_bounds(index, ids, queries, k)
    shared = index.rows.sparkSession.sparkContext.broadcast((ids, queries, bounds, index.pivots))
    width = index.width

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, bounds, pivots = shared.value
        floats = queries.astype(np.float64)
        own = (floats**2).sum(1)
        to_pivot = np.sqrt(np.maximum(0, ((floats[:, None, :] - pivots[None, :, :]) ** 2).sum(2)))
        kth = bounds.copy()
        pool = [np.empty(0, np.int64)] * 3  # query number, vec_id, score
        for batch in batches:
            pivot, distance, norm = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            vec_ids = batch.column(3).to_numpy(zero_copy_only=False)
            x = _matrix(batch.column(4), width)
            # annuli: at most `annulus` rows of one pivot, by distance
            order = np.lexsort((vec_ids, distance, pivot))
            pivot, distance, norm, vec_ids, x = pivot[order], distance[order], norm[order], vec_ids[order], x[order]
            starts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]])
            cuts = [c for a, b in zip(starts, np.r_[starts[1:], len(pivot)]) for c in range(a, b, annulus)]
            rings = list(zip(cuts, [*cuts[1:], len(pivot)]))
            lo, hi = distance[cuts], np.array([distance[b - 1] for _, b in rings])
            most = np.array([norm[a:b].max() for a, b in rings])
            from_pivot = to_pivot[:, pivot[cuts]]
            gap = np.maximum(0, np.maximum(from_pivot - hi, lo - from_pivot))
            gap = np.maximum(0, gap * (1 - 1e-9) - 1e-6)
            bound = (own[:, None] + most[None, :] - gap**2) / 2
            bound += 1 + np.abs(bound) * 1e-9
            for ring in np.argsort(-bound.max(0, initial=-np.inf)):
                active = np.flatnonzero(bound[:, ring] >= kth)
                if not len(active):
                    continue
                a, b = rings[ring]
                scores = _products(queries[active], x[a:b])
                take = (scores >= kth[active, None]) & (ids[active, None] != vec_ids[None, a:b])
                row, column = np.nonzero(take)
                if not len(row):
                    continue
                fresh = (active[row], vec_ids[a:b][column], scores[row, column])
                pool = [np.concatenate(p) for p in zip(pool, fresh)]
                keep = _best(*pool, k)
                pool = [p[keep] for p in pool]
                counts = np.bincount(pool[0], minlength=len(ids))
                last = np.cumsum(counts) - 1
                full = counts >= k
                kth[full] = np.maximum(kth[full], pool[2][last[full]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[pool[0]]), pa.array(pool[1]), pa.array(pool[2])], names=["query_id", "vec_id", "score"]
        )

    found = index.rows.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def _blocks(queries: DataFrame, width: int, block: int):
    ids: list[int] = []
    rows: list[list[int]] = []
    for r in queries.toLocalIterator(prefetchPartitions=False):
        ids.append(r.vec_id)
        rows.append(r.v)
        if len(ids) == block:
            yield ids, rows
            ids, rows = [], []
    if ids:
        yield ids, rows


def search(index: Index, queries: DataFrame, k: int = 10, block: int = BLOCK, annulus: int = ANNULUS) -> DataFrame:
    """Each query's k best rows. ``queries``: (vec_id, v) as from ``to_ints``."""
    spark = queries.sparkSession
    once = stage(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    path, done, one = new_folder(spark, "topk"), 0, None
    for ids, rows in _blocks(once, index.width, block):
        if one is not None:  # more than one block: results so far are written, one job a block
            one.write.mode("append").parquet(path)
        matrix = np.zeros((len(ids), index.width), np.int64)
        for i, row in enumerate(rows):
            matrix[i, : len(row)] = row
        one = _search_block(index, np.array(ids, np.int64), matrix, k, annulus)
        done += 1
    if one is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if done == 1:
        return one
    one.write.mode("append").parquet(path)
    return spark.read.schema(one.schema).parquet(path)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """Index every vector that takes part and search those that ``is_query`` (over vec_id) picks."""
    ints = to_ints(vectors)
    index = Index(ints)
    return search(index, index.rows.where(is_query).select("vec_id", "v"), k)
