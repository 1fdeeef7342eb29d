"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets link if
``100 * |x & y| >= percent * |x | y|``. Equal sets collapse to one before anything is compared.

Signatures. Sizes are covered by overlapping bands so that every pair similar enough shares a band.
Within a band such sets differ in at most k elements. The feature domain is split by hash into n1
parts, each into three; of n1 > k // 2 parts at least one differs in at most one element, hence two
of its three sub-parts are equal: the hashes of the three pairs of sub-parts are its signatures, and
one of them is shared. n1 has a quarter of the needed
parts more, ``SLACK`` at least: a long set has as many more weak signatures, as empty sub-parts are weak
too. That lets a document leave out weak
signatures, those made only of shingles that very many documents hold: as long as fewer parts have a
weak signature than parts must agree, a partner shares another one. Which shingles count as common
comes from a bounded sample and affects only the work, never the links. The same count serves once more
when signatures have met: similar sets share a signature in each part they must agree on, so a set that
met fewer of them in a band has no partner there, and met signatures of large buckets, say those of a
passage that many documents quote, may go while they are fewer than that.

Links. Signatures are partitioned by hash, and sets whose signature is alone go. Candidates are not
all pairs of a bucket: every set is compared, on the whole sets, with the centre of its bucket, and
linked sets share a label. Two sets of a bucket with different labels can still link. For them the
differences from their common centre decide, which are short in a family of near copies: sets whose
prefixes of these differences share a shingle are a pair if their sketches allow it. A sketch holds, for
each of some four times as many slots as similar sets may differ in shingles, the parity of the set's
shingles there: two sets differ in at least as many shingles as sketches differ in bits, so no link is
lost, and nearly all pairs that are left link. These are compared on whole sets.

Defined cases: null and empty texts have no set, link with nothing and are their own component;
documents with fewer words than a shingle have the whole sequence as their only shingle; repeated
rows and equal sets share a component; null ids come back with a null component; an empty table
gives no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import LOWER_BYTES, broadcast_within, bytes_of, mix, release, tidy
from demandloom.llm.graph import components
from demandloom.sources.staging import discard, stage

SHINGLE, PERCENT = 4, 85
#: Parts beyond those needed, at least; ratio of a band's sizes.
SLACK, BAND = 5, 1.4
#: Steps in which a tag counts the signatures that any partner shares, rounded down.
LEAST = [0, 1, 2, 4, 6, 16, 64, 256]
#: Owners beyond which a met signature counts as one of a large bucket.
CROWD = 4
#: Bounded sample behind the common shingles: documents, and how many of them make a shingle common.
SAMPLE_DOCS, COMMON = 20_000, 12
#: Sets that a task remembers and signatures that it holds at a time; rows and shingles whose signatures are cut together.
SETS_SEEN, HELD, ROWS_AT_ONCE, SHINGLES_AT_ONCE = 150_000, 400_000, 128, 15_000
#: Bytes of texts whose words are hashed together.
TEXT_AT_ONCE = 100_000
#: Hash buckets of signatures, and of the far fewer prefixes, for each shuffle partition: a task holds one at a time.
BUCKETS, PREFIX_BUCKETS = 32, 2
#: Slices of the centres, compared one after the other: the shuffled sets of one slice stand on the disks at a time.
SLICES = 4


class Shingler:
    """Sets of texts: sorted 64-bit hashes of the distinct shingles."""

    MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)

    def __init__(self, size: int):
        self.size = size

    def _windows(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each position on."""
        n = len(words) - size + 1
        total = np.full(n, size, np.uint64)
        for k in range(size):
            total = mix(total + words[k : n + k] * self.MULTIPLIERS[k % 5] + np.uint64(k))
        return total

    def _together(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Sets of texts whose words stand one after the other in one array; a shingle ends in its own text."""
        rows = [text.translate(LOWER_BYTES).split() for text in texts]  # at \x20 and \x09 to \x0D
        counts = [len(row) for row in rows]
        # hashing a short word takes less than looking it up
        every = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(rows)), np.uint64, sum(counts))
        every ^= np.uint64(1 << 63)
        del rows
        hashes = self._windows(every, self.size) if len(every) >= self.size else every[:0]
        start = 0
        for n in counts:
            if n < self.size:
                total = self._windows(every[start : start + n], n) if n else every[:0]
            else:
                total = hashes[start : start + n - self.size + 1].copy()
                total.sort()  # many times faster than np.unique, which hashes first
                fresh = np.ones(len(total), bool)
                np.not_equal(total[1:], total[:-1], out=fresh[1:])
                total = total if fresh.all() else total[fresh]
            start += n
            yield total

    def sets(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """The set of each text, in order; short texts are taken together."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TEXT_AT_ONCE:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


class Bands:
    """Overlapping size bands: (low, high, largest difference k, parts n1)."""

    def __init__(self, percent: int, largest: int = 1 << 26):
        self.rows = []
        low = 1
        while low <= largest:
            high = max(low, int(low * BAND))
            k = 2 * high * (100 - percent) // (100 + percent)
            self.rows.append((low, high, k, k // 2 + 1 + (max(SLACK, k // 8) if k >= 8 else 0)))
            low = max(low + 1, -(-percent * (high + 1) // 100))
        self.lows = np.array([r[0] for r in self.rows])
        self.highs = np.array([r[1] for r in self.rows])

    def of(self, size: int) -> range:
        return range(int(np.searchsorted(self.highs, size)), int(np.searchsorted(self.lows, size, side="right")))


def signatures(sets: list[np.ndarray], bands: Bands, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a batch of sets, as 64-bit integers, the number of each one's set, and its tag.

    A tag is 8 * (band modulo 4) + the step in ``LEAST`` of what any partner in the band shares at least.
    """
    pairs = [(k, band) for k, s in enumerate(sets) for band in bands.of(len(s)) if bands.rows[band][2]]
    if not pairs:  # bands whose largest difference is 0 hold equal sets only
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    member, band = np.array(pairs).T
    lengths = np.array([len(sets[k]) for k in member])
    n1 = np.array([bands.rows[b][3] for b in band])
    agree = n1 - np.array([bands.rows[b][2] for b in band]) // 2  # parts that a partner agrees on, at least
    first = np.cumsum(3 * n1) - 3 * n1
    shingles = np.concatenate([sets[k] for k in member])
    salt = mix(band.astype(np.uint64) + np.uint64(0x51ED270B7A1F3D05))
    salted = mix(shingles ^ np.repeat(salt, lengths))
    part = (salted % np.repeat(3 * n1, lengths).astype(np.uint64)).astype(np.int64) + np.repeat(first, lengths)
    total = int(3 * n1.sum())
    values = np.zeros(total, np.uint64)
    np.add.at(values, part, mix(salted + np.uint64(0x632BE59BD9B4E019)))
    values = values.reshape(-1, 3)
    rare = np.ones(len(shingles), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rare = common[at] != shingles
    strong = np.bincount(part[rare], minlength=total).reshape(-1, 3)
    kept = values.sum(1, keepdims=True, dtype=np.uint64) - values  # of the two sub-parts other than j
    weak = strong.sum(1, keepdims=True) - strong == 0
    weak_parts = np.add.reduceat(weak.any(1), first // 3, dtype=np.int64)
    row = np.arange(total).reshape(-1, 3) - np.repeat(first, n1)[:, None]
    labels = row.astype(np.uint64) + np.repeat(salt, n1)[:, None]
    found = mix(mix(kept + np.uint64(1)) + labels * np.uint64(0x9E3779B97F4A7C15))
    send = ~weak | np.repeat(weak_parts >= agree, n1)[:, None]
    owner = np.repeat(member, 3 * n1).reshape(-1, 3)
    step = np.searchsorted(LEAST, np.maximum(agree - weak_parts, 0), side="right") - 1
    tag = np.repeat(8 * (band % 4) + step, 3 * n1).reshape(-1, 3)
    return found[send], owner[send], tag[send].astype(np.uint8)


# --- jobs ---------------------------------------------------------------------------------------


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles of at least ``COMMON`` of ``SAMPLE_DOCS`` documents; a hint of bounded size."""
    order = F.xxhash64("doc_id")
    few = docs.select("doc_id", order.alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS).select("doc_id").distinct()
    sample = docs.join(F.broadcast(few), "doc_id", "left_semi")

    def run(batches):
        shingler = Shingler(size)
        held = [np.concatenate([np.zeros(0, np.uint64), *shingler.sets(bytes_of(b.column(1)))]) for b in batches]
        every = np.concatenate([np.zeros(0, np.uint64), *held])
        held.clear()
        values, counts = _several(every)  # a common one is met twice in some task
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["s", "n"])

    counted = sample.mapInArrow(tidy(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    most = counted.orderBy(F.desc("n"), "s").limit(1 << 18).select("s").toArrow().column(0).to_numpy()
    return np.sort(most.astype(np.int64).view(np.uint64))


def _several(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that come more than once, in order, and how often; sorts ``values`` in its place."""
    values.sort()
    again = np.flatnonzero(values[1:] == values[:-1])  # few: each but the last of a value's copies
    first = np.r_[True, values[again[1:]] != values[again[:-1]]] if len(again) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return values[again[first]], np.diff(np.r_[at, len(again)]) + 1


def _order(keys: np.ndarray, owners: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """The order by key, owner and tag: by key alone, and once more where keys are equal, as few are."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    among = order[tied]
    order[tied] = among[np.lexsort((tags[among], owners[among], keys[among]))]
    return order


def _emit(keys: np.ndarray, owners: np.ndarray, tags: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Blocks of (key, owner, tag under 32) by hash bucket; one row holds thousands of them.

    A key that already has two owners here is settled: its entries travel as found, and one of them
    also as an entry, for others to meet. So a key arrives at most once per block, however hot it is.
    Of a key, 40 bits travel in a field of six bytes, a block's first bytes before its second ones: the
    shuffle's compression takes the empty last bytes away.
    """
    order = _order(keys, owners, tags)
    keys, owners, tags = keys[order], owners[order], tags[order].astype(np.uint8)
    start, other = np.r_[True, keys[1:] != keys[:-1]], np.r_[True, owners[1:] != owners[:-1]]
    fresh = start | other | np.r_[True, tags[1:] != tags[:-1]]
    if not fresh.all():
        keys, owners, tags, start, other = keys[fresh], owners[fresh], tags[fresh], start[fresh], other[fresh]
    order = np.flatnonzero(start)
    settled = np.logical_or.reduceat(other & ~start, order)
    settled = np.repeat(settled, np.diff(np.r_[order, len(keys)])).astype(np.uint8)
    marks = settled * (start + np.uint8(1)) * np.uint8(32) + tags  # 0 entry, 1 found, 2 both
    bucket = (keys % np.uint64(buckets)).astype(np.min_scalar_type(buckets))  # two bytes are sorted by digits
    order = np.argsort(bucket, kind="stable")
    cuts = np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))]
    keys, owners, marks = keys[order], owners[order], marks[order]
    del order, bucket
    keys >>= np.uint64(24)
    low = keys.view(np.uint8).reshape(-1, 8)[:, :6]
    rows = [
        (k, low[a:z].T.tobytes() + owners[a:z].tobytes() + marks[a:z].tobytes())
        for k, (a, z) in enumerate(zip(cuts, cuts[1:]))
        if z > a
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], names=["bucket", "block"]
    )


def _meet(blocks: DataFrame, parts: int, buckets: int) -> DataFrame:
    """(sig, set_id, tag) of the keys that at least two owners have.

    40 bits of a key travel beside its bucket; a clash of two keys only adds candidates.
    """

    def shared(bucket: int, rows: list[bytes]) -> pa.RecordBatch:
        sizes = [len(r) // 15 for r in rows]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :6] = np.concatenate([np.frombuffer(r, np.uint8, 6 * n).reshape(6, n).T for r, n in zip(rows, sizes)])
        key = wide.view(np.int64).ravel()
        owner = np.concatenate([np.frombuffer(r, np.int64, n, 6 * n) for r, n in zip(rows, sizes)])
        mark = np.concatenate([np.frombuffer(r, np.uint8, n, 14 * n) for r, n in zip(rows, sizes)])
        order = _order(key, owner, mark & 31)
        key, owner, mark = key[order], owner[order], mark[order]
        start = np.r_[True, key[1:] != key[:-1]]
        ends = np.r_[np.flatnonzero(start)[1:], len(key)] - 1
        several = (owner[start] != owner[ends])[np.cumsum(start) - 1]
        keep = several | (mark >= 32)
        keep &= np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | ((mark & 31)[1:] != (mark & 31)[:-1])] | (mark >= 32)
        return pa.RecordBatch.from_arrays(
            [pa.array(key[keep] * buckets + bucket), pa.array(owner[keep]), pa.array((mark[keep] & 31).astype(np.int32))],
            names=["sig", "set_id", "tag"],
        )

    def meet(batches):
        now, held = None, []
        for batch in batches:
            for bucket, block in zip(batch.column(0), batch.column(1)):
                bucket = bucket.as_py()
                if bucket != now and held:
                    yield shared(now, held)
                    held = []
                now = bucket
                held.append(block.as_py())
        if held:
            yield shared(now, held)

    sorted_blocks = blocks.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return sorted_blocks.mapInArrow(tidy(meet), "sig long, set_id long, tag int").distinct()


def _portions(docs: list[bytes], shingler: Shingler, seen: set[int]):
    """Sets and ids not in ``seen``, as many at a time as the bounds allow."""
    sets, owners, held = [], [], 0
    for shingles in shingler.sets(docs):
        owner = set_id(shingles) if len(shingles) else None
        if owner is None or owner in seen:
            continue
        if len(seen) >= SETS_SEEN:
            seen.clear()
        seen.add(owner)
        if sets and (len(sets) == ROWS_AT_ONCE or held + len(shingles) > SHINGLES_AT_ONCE):
            yield sets, owners
            sets, owners, held = [], [], 0
        sets.append(shingles)
        owners.append(owner)
        held += len(shingles)
    if sets:
        yield sets, owners


def _shared_signatures(docs: DataFrame, size: int, percent: int, common) -> DataFrame:
    """(sig, set_id, tag): signatures that at least two different sets have."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * parts

    def cut(batches):
        shingler, bands, frequent = Shingler(size), Bands(percent), common.value
        parts_of, held = ([], [], []), 0  # keys, owners, tags
        seen: set[int] = set()  # equal sets of a task are sent once

        def emit():
            whole = []
            for part in reversed(parts_of):
                whole.append(np.concatenate(part))
                part.clear()
            return _emit(whole.pop(), whole.pop(), whole.pop(), buckets)  # which lets go of them as it sorts

        for batch in batches:
            for sets, owners in _portions(bytes_of(batch.column(1)), shingler, seen):
                found, number, tag = signatures(sets, bands, frequent)
                if not len(found):
                    continue
                for part, values in zip(parts_of, (found, np.array(owners, np.int64)[number], tag)):
                    part.append(values)
                held += len(found)
                if held >= HELD:
                    yield emit()
                    held = 0
        if held:
            yield emit()

    blocks = docs.mapInArrow(tidy(cut), "bucket int, block binary")
    return _meet(blocks, parts, buckets)


def _needed(met: DataFrame) -> DataFrame:
    """(sig, set_id): the met signatures (sig, set_id, tag) that finding every link takes.

    Two similar sets share, in some band, at least as many signatures as the tag of either says. A set
    with fewer has no partner in the band. Of the others, those of large buckets go where the set has
    fewer of them than its tag says: at least one of those shared with any partner stays, at both.
    """
    least = F.get(F.array(*map(F.lit, LEAST)), F.col("tag") % 8)
    for _ in range(2):  # the sets that go leave others' signatures alone
        several = met.groupBy("sig").agg(F.count(F.lit(1)).alias("w")).where("w > 1")
        rows = stage(met.select("sig", "set_id", "tag").join(several, "sig"), "several")
        counted = rows.groupBy("set_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("w") > CROWD).alias("crowds"))
        met = stage(rows.join(counted.where(F.col("n") >= least), ["set_id", "tag"]), "possible")
        discard(rows)
    kept = met.where((F.col("w") <= CROWD) | (F.col("crowds") >= least)).select("sig", "set_id")
    return kept.join(kept.groupBy("sig").agg(F.count(F.lit(1)).alias("w")).where("w > 1"), "sig", "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, n_ids: int, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, shingles) of every row.

    ``set_id`` is null for empty sets; ``shingles`` is filled for the sets in ``ids``, at least once each.
    """

    def run(batches):
        shingler = Shingler(size)
        seen: set[int] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                counts, keys, arrays = [], [], []
                for shingles in shingler.sets(bytes_of(batch.column(1))):
                    owner = set_id(shingles) if len(shingles) else None
                    counts.append(len(shingles))
                    keys.append(owner)
                    arrays.append(shingles.view(np.int64) if owner not in seen else np.zeros(0, np.int64))
                    if len(seen) >= SETS_SEEN:
                        seen.clear()
                    seen.add(owner)
                offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int64), *arrays])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()), lists],
                    names=["doc_id", "n_shingles", "set_id", "shingles"],
                )

    every = docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, set_id long, shingles array<long>")
    wanted = broadcast_within(ids.withColumn("wanted", F.lit(True)), n_ids, 32)
    filled = F.when(F.col("wanted") & (F.size("shingles") > 0), F.col("shingles"))
    return every.join(wanted, "set_id", "left").select("doc_id", "n_shingles", "set_id", filled.alias("shingles"))


def _only(members: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """The sets that ``pairs`` names in ``column``; the others do not travel."""
    ids = stage(pairs.select(F.col(column).alias("set_id")).distinct(), "named")
    return members.join(broadcast_within(ids, ids.count(), 32), "set_id", "left_semi")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough, judged on the whole sets."""
    left = _only(sets, pairs, "a").select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    right = _only(sets, pairs, "b").select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    union = F.size("x") + F.size("y") - F.col("both")
    return met.where(100 * F.col("both") >= percent * union).select("a", "b")


def _around(rows: DataFrame) -> DataFrame:
    """(p, x): every set of a bucket beside the bucket's centre, the set that shares most with others."""
    centre = rows.groupBy("sig").agg(F.max(F.struct("score", "set_id"))["set_id"].alias("p"))
    return rows.join(centre, "sig").where("p != set_id").select("p", F.col("set_id").alias("x")).distinct()


def _spokes(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, x) of centres and sets, compared on the whole sets.

    (p, np, x, nx, linked, m, head): ``m`` shingles are in one of x and p only; ``head`` is the first
    of them, those of x by hash, then those of p by hash, as many as a prefix can need.
    """
    left = _only(members, pairs, "x").select(F.col("set_id").alias("x"), F.col("shingles").alias("sx"))
    right = _only(members, pairs, "p").select(F.col("set_id").alias("p"), F.col("shingles").alias("sp"))
    met = pairs.join(left, "x").join(right, "p").withColumns({"nx": F.size("sx"), "np": F.size("sp")})
    met = met.withColumns({"own": F.array_except("sx", "sp"), "other": F.array_except("sp", "sx")})
    met = met.withColumn("both", F.col("nx") - F.size("own"))
    linked = 100 * F.col("both") >= percent * (F.col("nx") + F.col("np") - F.col("both"))
    head = F.slice(F.concat("own", "other"), 1, _most(F.col("nx"), percent) + 1)
    return met.select("p", "np", "x", "nx", linked.alias("linked"), (F.size("own") + F.size("other")).alias("m"), head.alias("head"))


def _most(n, percent: int):
    """The largest difference between a set of size ``n`` and any set similar enough."""
    return F.floor((n + n * 100 / percent) * (100 - percent) / (100 + percent) + 1e-6).cast("int")


def _prefix_keys(spokes: DataFrame, percent: int, parts: int, buckets: int) -> DataFrame:
    """Blocks of the prefixes of the differences, see ``_pairs``."""

    def cut(batches):
        keys, owners, tags, held = [], [], [], 0
        for batch in batches:
            for p, n_p, x, n_x, linked, m, head in zip(*(c.to_pylist() for c in batch.columns)):
                most = _most_of(n_x, percent)
                near = _most_of(n_p, percent)

                def class_of(size: int, near: int = near) -> int:
                    width = max(4, near // 2)
                    edge = 2 * near // width + 1
                    return size // width if size < edge * width else edge + (size - edge * width) // max(4, 4 * near)

                def least_of(number: int, near: int = near) -> int:
                    width = max(4, near // 2)
                    edge = 2 * near // width + 1
                    return number * width if number < edge else edge * width + (number - edge) * max(4, 4 * near)

                unlinked = (percent * n_x + 100 * n_p) * (100 - percent) // (100 * (100 + percent)) + 1
                low = max(0, m - most, unlinked if linked else 0)
                own = class_of(m)
                shingles = np.array(head, np.int64).view(np.uint64)
                for c in range(class_of(low), class_of(m + most) + 1) if low <= m + most else ():
                    least = max(least_of(c), low)
                    common = -(-(m + least - most) // 2)
                    prefix = shingles[: max(0, m - common + 1)]
                    if common < 1:  # nothing need be in common: such sets meet at 0
                        prefix = np.r_[prefix, np.zeros(1, np.uint64)]
                    salt = mix(np.array([p, min(own, c), max(own, c)], np.int64).view(np.uint64) + np.arange(3, dtype=np.uint64))
                    keys.append(mix(mix(prefix + salt[0]) + salt[1:2] * np.uint64(3) + salt[2:] * np.uint64(5)))
                    owners.append(np.full(len(prefix), x, np.int64))
                    tags.append(np.full(len(prefix), 0 if own < c else 1 if own == c else 2, np.uint8))
                    held += len(prefix)
                if held >= HELD:
                    yield _emit(np.concatenate(keys), np.concatenate(owners), np.concatenate(tags), buckets)
                    keys, owners, tags, held = [], [], [], 0
        if held:
            yield _emit(np.concatenate(keys), np.concatenate(owners), np.concatenate(tags), buckets)

    return spokes.select("p", "np", "x", "nx", "linked", "m", "head").mapInArrow(tidy(cut), "bucket int, block binary")


def _most_of(n: int, percent: int) -> int:
    """The largest difference between a set of size n and any set similar enough (as ``_most``)."""
    return int((n + n * 100 / percent) * (100 - percent) / (100 + percent) + 1e-6)


def sketch(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Parities of a set's shingles by slot, 64 slots a number; a power of two of numbers."""
    words = 1 << max(0, (4 * _most_of(len(shingles), percent) - 1).bit_length() - 6)
    slots = (shingles & np.uint64(64 * words - 1)).astype(np.int64)
    odd = np.bincount(slots, minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _sketches(members: DataFrame, percent: int) -> DataFrame:
    """(set_id, sketch) of every set."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                sets = batch.column(1)
                flat, ends = sets.flatten().to_numpy().view(np.uint64), np.cumsum(sets.value_lengths().to_numpy())
                found = [sketch(x, percent) for x in np.split(flat, ends[:-1])]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["set_id", "sketch"])

    return members.select("set_id", "shingles").mapInArrow(tidy(run), "set_id long, sketch array<long>")


def _least_difference(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ; one of a larger set may be twice as long and is folded (0 if it is longer)."""

    def folded(own: Column, other: Column) -> Column:
        half = F.size(other)
        halves = F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(own) > half, halves).otherwise(own)

    bits = F.zip_with(folded(x, y), folded(y, x), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    comparable = F.greatest(F.size(x), F.size(y)) <= 2 * F.least(F.size(x), F.size(y))
    return F.when(comparable, F.aggregate(bits, F.lit(0), lambda total, n: total + n)).otherwise(0)


def _pairs(spokes: DataFrame, named: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), staged, with different labels that may still link, found around their common centre.

    If x and y differ in at most K shingles, their differences from p, of sizes m and l, have at least
    (m + l - K) / 2 shingles in common. So the first m - (m + l - K) / 2 + 1 of one and as many of the
    other, in the one order, share a shingle: only such prefixes meet, one for each class of l. Two
    sets linked to p have one label already; so a linked set only looks for unlinked ones.

    ``named``: (set_id, n, label). A pair meets as often as prefixes share shingles, so the sketches decide
    where it meets: what does not link leaves no row.
    """
    parts = int(spokes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = PREFIX_BUCKETS * parts
    prefixes = stage(_meet(_prefix_keys(spokes, percent, parts, buckets), parts, buckets), "prefixes")
    release(spokes.sparkSession)
    met = prefixes.join(named, "set_id")
    several = met.groupBy("sig").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("sig")
    rows = stage(met.join(several, "sig"), "met-prefixes")
    discard(prefixes)
    rows_of = _sketches(_only(members, rows, "set_id"), percent).join(rows, "set_id")
    same = (F.col("tag") == 1).alias("same")

    def side(tags: str, name: str) -> DataFrame:
        columns = {"set_id": name, "n": f"n{name}", "label": f"l{name}", "sketch": f"s{name}"}
        return rows_of.where(tags).select("sig", same, *[F.col(c).alias(to) for c, to in columns.items()])

    pairs = side("tag <= 1", "a").join(side("tag >= 1", "b"), ["sig", "same"]).where("la != lb AND (NOT same OR a < b)")
    pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = pairs.where((100 + percent) * _least_difference(F.col("sa"), F.col("sb")) <= (100 - percent) * (F.col("na") + F.col("nb")))
    pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    discard(rows)
    return pairs


def links(shared: DataFrame, ids: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the sets in ``ids``: the smallest set of the component.

    ``shared`` and ``members`` are staged tables; they are deleted when they have been used.
    """
    # how much each set shares with others: the centre of a family of near copies scores highest
    weight = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("w"))
    score = shared.join(weight, "sig").groupBy("set_id").agg(F.sum("w").alias("score"))
    around = stage(_around(shared.join(score, "set_id")), "around")
    discard(shared)
    release(members.sparkSession)
    spokes = None
    for k in range(SLICES):
        part = stage(_spokes(around.where(F.pmod(F.xxhash64("p"), F.lit(SLICES)) == k), members, percent), "spokes")
        release(members.sparkSession)
        spokes = part if spokes is None else spokes.union(part)
    found = spokes.where("linked").select(F.col("p").alias("a"), F.col("x").alias("b"))
    every = ids.select(F.col("set_id").alias("node"))

    def labelled(grouped: DataFrame) -> DataFrame:
        return stage(every.join(grouped, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")

    labels = labelled(components(found))
    named = spokes.join(labels.withColumnRenamed("node", "x"), "x")
    open_groups = named.groupBy("p").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("p")
    sizes = members.select("set_id", F.size("shingles").alias("n"))
    by_set = sizes.join(labels.withColumnRenamed("node", "set_id"), "set_id")
    pairs = _pairs(named.join(open_groups, "p"), by_set, members, percent)
    release(members.sparkSession)
    fresh = stage(_linked(pairs, members, percent), "links")
    discard(members, pairs)
    release(members.sparkSession)
    return labels if fresh.isEmpty() else labelled(components(found.union(fresh)))


def similar_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))
    met = stage(_shared_signatures(docs, size, percent, common), "signatures")
    release(docs.sparkSession)
    shared = stage(_needed(met), "needed-signatures")
    discard(met)
    release(docs.sparkSession)
    ids = stage(shared.select("set_id").distinct(), "candidates")
    n_ids = ids.count()
    whole = stage(_sets(docs, ids, n_ids, size), "whole-sets")
    sets = stage(whole.drop("shingles"), "sets")
    labels = None
    if n_ids:
        members = whole.where("shingles IS NOT NULL").groupBy("set_id").agg(F.first("shingles").alias("shingles"))
        members = stage(members, "members")
        discard(whole)
        release(docs.sparkSession)
        labels = links(shared, ids, members, percent)
    classes = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    if labels is not None:
        named = classes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
        named = stage(named.select("set_id", "first", F.coalesce("label", "set_id").alias("label")), "classes")
        lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
        classes = named.join(lowest, "label").select("set_id", "component_id")
    else:
        classes = classes.withColumnRenamed("first", "component_id")
    return sets.join(classes, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def drop_similar(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``docs`` with one document of each component left: the one with the smallest id.

    Rows with a null id stay; rows that share an id are one document and stay or go together.
    """
    found = similar_documents(docs, size, percent)
    gone = stage(found.where("component_id != doc_id").select("doc_id").distinct(), "similar")
    key = f"_gone_{'_'.join(docs.columns)}"
    gone = broadcast_within(gone, gone.count(), 32).select(F.col("doc_id").alias(key))
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")
