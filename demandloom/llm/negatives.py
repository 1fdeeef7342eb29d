"""Hard-negative mining with the threshold algorithm.

For an anchor and one of its positives, hard negatives are the rows of other labels that score at
most as high as the positive, but not below a share of its score; the best few are wanted.

Candidates are dealt into blocks of bounded size and anchors into groups of bounded size; every
group meets every block once, as a key of a Spark cogroup. Within a block each dimension has its own
list of the candidates, sorted by that component. An anchor reads each list from its high end where
its own component is positive and from its low end where it is negative (a zero component reads
none). A candidate met in any list is scored whole from its row. The products of the anchor with the
components last read add up to a threshold that no candidate still unseen can exceed; the anchor
stops as soon as the threshold is strictly below the k-th score of each of its windows, or below the
window itself (strictly, since ties go to the smaller id). A block whose first threshold is already
below is not read at all. The k best of all blocks are merged by a window that Spark limits to k
rows a key before the shuffle.

Positives come by the same search: one open window over the anchor's own label, so only blocks of
that label take part. One block of candidates goes first there and in the search for negatives: its k-th
scores are where the other blocks start.

Memory: a task holds one block and one group at a time, a hot label fills more blocks, and equal
vectors have different ids and spread over all blocks. Work is (anchors x candidates) at worst, as
the lists of wide random vectors must be read far down; nothing else grows faster than the input.

Defined cases: rows with a null id, a null label, a vector that is null, empty or holds a null or
non-finite component take no part; shorter vectors count as padded with 0; of rows with one id only
the smallest (label, vector) takes part; an anchor without another row of its label gives no rows,
fewer positives or negatives than asked for give all; ties go to the smaller id; a positive below 0
has an empty window; empty tables give no rows; other columns are not read. Components so large that
100 times a score leaves 64 bits fail the job by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.session import ship_package
from demandloom.sources.staging import stage, stage_lookup

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: The window of a positive with score p: scores s with LOW * p <= 100 * s <= HIGH * p.
LOW, HIGH = 80, 100
#: Candidates of a block, anchors of a group, rows read from every list before the threshold is first tested again;
#: each later test waits for twice as many, so a search that must read far down takes few of them.
BLOCK, GROUP, STEP = 2048, 256, 8

_FOUND = "anchor_id long, window int, vec_id long, score long"


def whole_rows(vectors: DataFrame, label: Column, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): rows that take part, one per id, components as whole numbers."""
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = (
        vectors.where(x.isNotNull() & F.col(id_column).isNotNull() & label.isNotNull())
        .where((F.size(x) > 0) & ~odd)
        .select(
            F.col(id_column).cast("long").alias("vec_id"),
            label.cast("long").alias("label"),
            F.transform(x, lambda c: F.floor(scale * c.cast("double"))).alias("v"),
        )
    )
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers, short ones padded with 0."""
    column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    lengths, flat = np.diff(ends), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Lists:
    """The sorted lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(rows, self.order, 0)

    def search(self, anchor: np.ndarray, excluded: np.ndarray, windows: np.ndarray, starts: np.ndarray, k: int, step: int = STEP):
        """Per window the positions and scores of its k best candidates, and how many were scored.

        ``windows``: rows (lowest, highest) of scores; ``starts``: a score per window which k other
        candidates are known to reach, or the smallest number. Rows marked ``excluded`` never count.
        """
        size = len(self.rows)
        down, up = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        scores, seen = np.zeros(size, self.rows.dtype), np.zeros(size, bool)
        low, high = windows[:, :1], windows[:, 1:]
        enough = np.maximum(windows[:, 0], starts)
        depth = 0
        while True:
            # the best that a candidate not read so far can score
            if depth < size:
                threshold = self.sorted[size - 1 - depth, down] @ anchor[down] + self.sorted[depth, up] @ anchor[up]
                counted = seen & ~excluded
                got = scores[counted]
                above = ((got > threshold) & (got >= low) & (got <= high)).sum(1)
                if np.all((threshold < enough) | (above >= k)):
                    break
            else:
                threshold = None
            if threshold is None or not len(down) + len(up):
                fresh = np.flatnonzero(~seen)  # all lists are read, or the anchor is zero and all score alike
            else:
                last, step = min(depth + step, size), 2 * step
                met = [self.order[size - last : size - depth, down].ravel(), self.order[depth:last, up].ravel()]
                new = np.zeros(size, bool)
                new[np.concatenate(met)] = True
                fresh = np.flatnonzero(new & ~seen)
                depth = last
            scores[fresh] = self.rows[fresh] @ anchor
            seen[fresh] = True
            if seen.all():
                break
        found = []
        for lowest, highest in windows:
            at = np.flatnonzero(seen & ~excluded & (scores >= lowest) & (scores <= highest))
            at = at[np.lexsort((self.ids[at], -scores[at]))[:k]]
            found.append((at, scores[at]))
        return found, int(seen.sum())


NOTHING = np.iinfo(np.int64).min


def _searcher(width: int, k: int, low: int, high: int, same_label: bool):
    """The function of one (group of anchors, block of candidates)."""

    def run(anchors: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
        if anchors.num_rows and block.num_rows:
            ids, labels = block["vec_id"].to_numpy(), block["label"].to_numpy()
            rows, queries = _matrix(block["v"], width), _matrix(anchors["anchor_v"], width)
            most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * width
            if most * max(low, high, 100) >= 2**63:
                raise OverflowError("scores of these components leave 64 bits")
            kind = np.float64 if most < 2**53 else np.int64  # scores in floats while they are exact
            lists = Lists(ids, rows.astype(kind))
            queries = queries.astype(kind)
            own, own_label = anchors["anchor_vec_id"].to_numpy(), anchors["anchor_label"].to_numpy()
            windows, starts = anchors["anchor_windows"].to_pylist(), anchors["anchor_starts"].to_pylist()
            for i in range(len(own)):
                excluded = (ids == own[i]) | ((labels != own_label[i]) if same_label else (labels == own_label[i]))
                if same_label:
                    bounds = np.array([[-most, most]], kind)
                else:  # whole scores s with low * p <= 100 * s <= high * p
                    bounds = np.array([[-(-low * p // 100), high * p // 100] for p in windows[i]], kind)
                start = np.array([NOTHING if s is None else s for s in starts[i]], np.float64)
                for w, (at, scores) in enumerate(lists.search(queries[i], excluded, bounds, start, k)[0]):
                    fresh = (np.full(len(at), own[i]), np.full(len(at), w), ids[at], scores.astype(np.int64))
                    for column, part in zip(out, fresh):
                        column.append(part)
        anchor_id, window, vec_id, score = (np.concatenate(column) for column in out)
        return pa.table(
            {"anchor_id": pa.array(anchor_id), "window": pa.array(window.astype(np.int32)), "vec_id": pa.array(vec_id), "score": pa.array(score)}
        )

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _meet(anchors: DataFrame, blocks: DataFrame, keys: list[str], search) -> DataFrame:
    # both sides come from one table: own names and own columns for each
    renamed = [F.col(c).alias(f"anchor_{c}") for c in dict.fromkeys([*keys, "vec_id", "label", "v", "windows", "starts"])]
    left = anchors.select(*renamed).groupBy(*(f"anchor_{c}" for c in keys))
    return left.cogroup(blocks.groupBy(*keys)).applyInArrow(search, _FOUND)


def _in_two_goes(anchors: DataFrame, blocks: DataFrame, keys: list[str], search, k: int, label: str) -> DataFrame:
    """The k best per anchor and window: block 0 first, the others from its k-th scores on."""
    first = stage(_best(_meet(anchors.where("block = 0"), blocks.where("block = 0"), keys, search), k), f"{label}-first")
    kth = first.where(F.col("rank") == k).groupBy("anchor_id").agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth")  # one entry a window
    )
    started = (
        anchors.where("block > 0").join(kth.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left")
        .withColumn("starts", F.transform("starts", lambda s, w: F.coalesce(s, F.try_element_at("kth", w.cast("int")))))
    )
    rest = _meet(started, blocks.where("block > 0"), keys, search)
    return _best(first.drop("rank").unionByName(rest), k)


def _dealt(salt: str, parts) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "vec_id"), parts).cast("int")


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: as from ``whole_rows``; ``is_anchor``: a condition over vec_id.
    """
    ship_package(rows.sparkSession)
    table = stage(rows, "negatives-rows")
    whole = table.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("v")).alias("width")
    ).first()
    width = whole.width or 1
    anchors = table.where(is_anchor)

    # positives: groups and blocks of one label
    sizes = stage_lookup(
        table.groupBy("label").agg(
            F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"),
            F.greatest(F.lit(1), F.ceil(F.count_if(is_anchor) / group)).cast("int").alias("groups"),
        ),
        "negatives-labels",
    )
    numbers = lambda most: F.explode(F.sequence(F.lit(0), most - 1))
    keys = ["label", "group", "block"]
    open_window = [F.array(F.lit(None).cast("long")).alias("windows"), F.array(F.lit(None).cast("long")).alias("starts")]
    asked = anchors.join(sizes, "label").select(
        "vec_id", "label", "v", _dealt("anchor", F.col("groups")).alias("group"), numbers(F.col("blocks")).alias("block"), *open_window
    )
    offered = table.join(sizes, "label").select(
        "vec_id", "label", "v", _dealt("row", F.col("blocks")).alias("block"), numbers(F.col("groups")).alias("group")
    )
    search = _searcher(width, positives, low, high, same_label=True)
    found = stage(_in_two_goes(asked, offered, keys, search, positives, "positives"), "positives")

    # negatives: one window per positive, all blocks
    blocks, groups = max(1, -(-whole.n // block)), max(1, -(-whole.anchors // group))
    windows = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))  # a few a key
    asked = (
        anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
        .select("vec_id", "label", "v", F.col("p.score").alias("windows"), F.transform("p", lambda c: F.lit(None).cast("long")).alias("starts"))
        .select("*", _dealt("anchor", F.lit(groups)).alias("group"), numbers(F.lit(blocks)).alias("block"))
    )
    offered = table.select("vec_id", "label", "v", _dealt("row", F.lit(blocks)).alias("block"), numbers(F.lit(groups)).alias("group"))
    search = _searcher(width, negatives, low, high, same_label=False)
    hard = _in_two_goes(asked, offered, keys[1:], search, negatives, "negatives")
    named = found.select(
        "anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return hard.join(named, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
