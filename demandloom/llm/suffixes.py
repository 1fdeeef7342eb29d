"""Removal of byte strings that an earlier document holds too.

The rule: a byte goes if a 50-byte string over it also starts in a document with a smaller id.

A run-length index of the whole corpus would be one structure in one task. Here it is cut by content.
Every 50-byte string contains its smallest 20-byte gram by hash (its anchor), so two equal strings
share an anchor. Anchors that only one document has are dropped. Around each shared anchor a context
of at most 80 bytes holds all strings with that anchor; contexts meet by anchor. There the 50-byte
strings of all contexts are sorted, equal ones form runs, and the run's head keeps the smallest
document as its sample. Each context is then streamed against the runs: where the sample is a smaller
document, the string is a match of length 50 or more, and its bytes are covered. Strings are compared
by 64-bit hashes of their bytes.

Equal texts are settled before that: all but the smallest id go as a whole. A task sends an anchor or
a context that it holds twice only once, so hot passages arrive once per block, not once per document.

Defined cases: null and empty texts have no bytes; texts under 50 bytes stay; rows with one id do not
remove each other's bytes; repeated rows get equal results; rows with a null id stay as they are and
remove nothing; an empty table gives no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import broadcast_within, bytes_of, mix, release
from demandloom.sources.staging import discard, stage

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1  # grams of a string
CONTEXT = 2 * LENGTH - GRAM  # bytes around an anchor: every string that holds it
#: Anchors and contexts that a task holds before it sends them, and texts it remembers.
HELD, HELD_CONTEXTS, SEEN = 1_000_000, 40_000, 100_000


def gram_hashes(text: bytes) -> np.ndarray:
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    count = len(text) - GRAM + 1
    first, second, last = words[:count], words[8 : 8 + count], words[GRAM - 8 :]
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(second * np.uint64(0x165667B19E3779F9) + mix(last + np.uint64(0xC2B2AE3D27D4EB4F))))


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """Minimum or maximum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out = least(out[:-have], out[have:])
        have *= 2
    return least(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the grams that are the smallest of some 50-byte string."""
    if len(text) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = gram_hashes(text)
    lowest = _sliding(grams, WINDOW, np.minimum)
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), lowest, np.zeros(WINDOW - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, WINDOW, np.maximum) == grams)
    return grams[at], at


def _lists(column: str) -> str:
    return f"bucket int, {column} binary"


def _blocks(bucket: np.ndarray, buckets: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket: the bytes of its part of each column, one column after the other.

    Numbers are written byte plane by byte plane; planes of leading zeros compress to nothing.
    """

    def packed(part: np.ndarray) -> bytes:
        return part.tobytes() if part.ndim > 1 else np.ascontiguousarray(part.view(np.uint8).reshape(len(part), -1).T).tobytes()

    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [np.ascontiguousarray(c[order]) for c in columns]
    rows = [(k, b"".join(packed(c[a:z]) for c in columns)) for k, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], names=["bucket", "block"]
    )


def _columns(blocks: list[bytes], widths: list[tuple[str, int]]) -> list[np.ndarray]:
    """The columns of several blocks, each of (dtype, values per row)."""
    size = sum(np.dtype(d).itemsize * n for d, n in widths)
    out: list[list[np.ndarray]] = [[] for _ in widths]
    for block in blocks:
        rows, at = len(block) // size, 0
        for part, (dtype, n) in zip(out, widths):
            width = n * np.dtype(dtype).itemsize
            raw = np.frombuffer(block, np.uint8, rows * width, at)
            part.append(raw.reshape(rows, n) if n > 1 else np.ascontiguousarray(raw.reshape(width, rows).T).view(dtype).ravel())
            at += rows * width
    return [np.concatenate(c) for c in out]


def _by_bucket(batches):
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(bucket, []).append(block)
    while held:
        yield held.popitem()


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    fresh = np.zeros(len(sorted_columns[0]), bool)
    fresh[:1] = True
    for c in sorted_columns:
        fresh[1:] |= c[1:] != c[:-1]
    return fresh


def _shared_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, pos) of the anchors that at least two documents have."""
    buckets = 2 * parts
    widths = [("<u8", 1), ("<i8", 1), ("<i4", 1), ("u1", 1)]

    def cut(batches):
        found: list[tuple] = []
        held = 0
        seen: dict[bytes, int] = {}  # equal texts of a task are sent once, with the smallest id

        def emit():
            key = np.concatenate([f[0] for f in found])
            doc = np.concatenate([np.full(len(f[0]), f[2], np.int64) for f in found])
            pos = np.concatenate([f[1] for f in found])
            order = np.lexsort((doc, key))
            key, doc, pos = key[order], doc[order], pos[order]
            start = _heads(key)
            group = np.cumsum(start) - 1
            last = np.r_[np.flatnonzero(start)[1:], len(key)] - 1
            settled = (doc[start] != doc[last])[group]  # two documents of this block have it
            state = np.where(settled, np.where(start, 2, 1), 0).astype(np.uint8)  # 0 entry, 1 found, 2 both
            return _blocks((key % np.uint64(buckets)).astype(np.int64), buckets, [key >> np.uint64(16), doc, pos.astype(np.int32), state])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                name = hashlib.md5(text).digest()
                if seen.get(name, doc + 1) <= doc:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen[name] = doc
                keys, at = anchors(text)
                if len(keys):
                    found.append((keys, at, doc))
                    held += len(keys)
                if held >= HELD:
                    yield emit()
                    found, held = [], 0
        if held:
            yield emit()

    def meet(batches):
        for _, blocks in _by_bucket(batches):
            key, doc, pos, state = _columns(blocks, widths)
            order = np.lexsort((doc, key))
            key, doc, pos, state = key[order], doc[order], pos[order], state[order]
            start = _heads(key)
            last = np.r_[np.flatnonzero(start)[1:], len(key)] - 1
            keep = (doc[start] != doc[last])[np.cumsum(start) - 1] | (state > 0)
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(pos[keep])], names=["doc_id", "pos"])

    blocks = docs.mapInArrow(cut, _lists("block"))
    return blocks.repartition(parts, "bucket").mapInArrow(meet, "doc_id long, pos int")


def window_hashes(contexts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the 50-byte strings of each row of a byte matrix."""
    base = np.uint64(0x100000001B3 * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF | 1)
    rows, width = contexts.shape
    prefix = np.zeros((width + 1, rows), np.uint64)
    for j in range(width):
        prefix[j + 1] = prefix[j] * base + contexts[:, j] + np.uint64(1)
    power = np.uint64(pow(int(base), LENGTH, 1 << 64))
    return mix(prefix[LENGTH:] - prefix[:-LENGTH] * power).T


def _covered(joined: DataFrame, parts: int) -> DataFrame:
    """(doc_id, name, pos, strings): bit j of ``strings`` says that the 50 bytes from pos + j on go.

    ``joined``: (doc_id, name, text, positions of shared anchors).
    """
    buckets = 8 * parts
    widths = [("<i8", 1), ("<i8", 1), ("<i4", 1), ("u1", 1), ("u1", 1), ("u1", CONTEXT)]
    settled = [("<i8", 1), ("<i8", 1), ("<i4", 1), ("u1", 1), ("u1", 1)]
    powers = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(CONTEXT)], np.uint64)
    reach = LENGTH - GRAM

    def cut(batches):
        held: list[tuple] = []
        count = 0

        def emit():
            doc, name, pos, key, text, left, size = (np.concatenate([h[i] for h in held]) for i in range(7))
            # equal contexts of a block: the smallest document's is sent, the others are covered whole
            alike = text.astype(np.uint64) @ powers + left.astype(np.uint64) * np.uint64(256) + size
            rows = np.ascontiguousarray(text).view(f"V{CONTEXT}").ravel()
            order = np.lexsort((doc, alike))
            same = np.zeros(len(order), bool)
            same[1:] = (alike[order][1:] == alike[order][:-1]) & (rows[order][1:] == rows[order][:-1])
            same[1:] &= (left[order][1:] == left[order][:-1]) & (size[order][1:] == size[order][:-1])
            group = np.cumsum(~same) - 1
            head_doc = doc[order][~same][group]
            whole = np.zeros(len(order), bool)
            whole[order] = same & (head_doc < doc[order])
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            yield _blocks(bucket[~whole], buckets, [c[~whole] for c in (doc, name, pos, left, size, text)])
            if whole.any():  # settled ones go without their bytes, to buckets of their own
                yield _blocks(bucket[whole] + buckets, 2 * buckets, [c[whole] for c in (doc, name, pos, left, size)])

        for batch in batches:
            docs, names, positions = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for doc, name, text, at in zip(docs, names, bytes_of(batch.column(2)), positions):
                at = np.unique(np.array(at, np.int64))
                at = at[at <= len(text) - GRAM]
                if len(text) < LENGTH or not len(at):
                    continue
                padded = np.frombuffer(bytes(reach) + text + bytes(CONTEXT), np.uint8)
                rows = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[at]  # from at - reach
                left = np.maximum(0, reach - at)
                size = np.minimum(CONTEXT, len(text) - at + reach)
                full = np.full(len(at), doc, np.int64)
                held.append((full, np.full(len(at), name, np.int64), (at - reach).astype(np.int32), gram_hashes(text)[at], rows, left.astype(np.uint8), size.astype(np.uint8)))
                count += len(at)
                if count >= HELD_CONTEXTS:
                    yield from emit()
                    held, count = [], 0
        if count:
            yield from emit()

    def meet(batches):
        offset = np.arange(WINDOW)
        for bucket, blocks in _by_bucket(batches):
            doc, name, pos, left, size, *text = _columns(blocks, widths if bucket < buckets else settled)
            valid = (offset >= left[:, None]) & (offset + LENGTH <= size[:, None])
            gone = valid.copy()
            if text:
                row, at = np.nonzero(valid)
                strings, owner = window_hashes(text[0])[row, at], doc[row]
                order = np.lexsort((owner, strings))
                start = _heads(strings[order])
                sample = owner[order][start]  # the smallest document, at the head of each run
                covered = sample[np.cumsum(start) - 1] < owner[order]
                gone[row[order], at[order]] = covered
            bits = (gone.astype(np.int64) << offset).sum(1)
            keep = bits != 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[keep]) for c in (doc, name, pos, bits)], names=["doc_id", "name", "pos", "strings"]
            )

    blocks = joined.mapInArrow(cut, _lists("block"))
    return blocks.repartition(parts, "bucket").mapInArrow(meet, "doc_id long, name long, pos int, strings long")


def _cut_out(joined: DataFrame) -> DataFrame:
    """(doc_id, name, n_removed, n_spans, kept, kept_sha256) from (doc_id, name, text, found: [(pos, strings)])."""

    def run(batches):
        offset = np.arange(WINDOW)
        for batch in batches:
            rows = []
            for text, found in zip(bytes_of(batch.column(2)), batch.column(3).to_pylist()):
                edge = np.zeros(len(text) + 1, np.int64)
                pos = np.array([f["pos"] for f in found], np.int64)
                bits = np.array([f["strings"] for f in found], np.int64)
                starts = (pos[:, None] + offset)[(bits[:, None] >> offset) & 1 == 1]
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                rows.append((int(gone.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.string())],
                names=["doc_id", "name", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id long, name long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def _with_text(named: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """(doc_id, name, text, column): the texts that ``rows`` speaks of; other texts do not travel."""
    ids = stage(rows.select("doc_id").distinct(), "affected")
    few = named.join(broadcast_within(ids, ids.count(), 32), "doc_id", "left_semi").where(F.octet_length("text") >= LENGTH)
    keys = [c for c in ("doc_id", "name") if c in rows.columns]
    return few.join(rows, keys).select("doc_id", "name", "text", column)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document row: bytes, removed bytes and runs, digest of what is left, and what is left.

    ``kept`` is null where nothing was removed.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = docs.withColumn("name", F.xxhash64("text")).where("doc_id IS NOT NULL")
    plain = docs.select(
        "doc_id",
        F.xxhash64("text").alias("name"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
    )
    plain = stage(plain, "plain")
    first = plain.where("doc_id IS NOT NULL").groupBy("sha256").agg(F.min("doc_id").alias("first"))
    shared = stage(_shared_anchors(docs.where("doc_id IS NOT NULL"), parts), "shared-anchors")
    release(docs.sparkSession)
    # copies of a whole text are settled; only first documents need their contexts compared
    ours = plain.join(first, "sha256").where("doc_id = first").select("doc_id").distinct()
    places = shared.join(ours, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("pos").alias("positions"))
    places = stage(places, "places")
    discard(shared)
    release(docs.sparkSession)
    covered = stage(_covered(_with_text(named, places, "positions"), parts), "covered")
    discard(places)
    release(docs.sparkSession)
    found = covered.groupBy("doc_id", "name").agg(F.collect_list(F.struct("pos", "strings")).alias("found"))
    found = stage(found, "found")
    discard(covered)
    release(docs.sparkSession)
    cut = _cut_out(_with_text(named, found, "found")).dropDuplicates(["doc_id", "name"])
    nothing = hashlib.sha256(b"").hexdigest()
    rows = plain.join(first, "sha256", "left").join(cut, ["doc_id", "name"], "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    pick = lambda whole, name, other: F.when(copy, whole).otherwise(F.coalesce(F.col(name), other))
    return rows.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), "n_removed", F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), "n_spans", F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(nothing), "kept_sha256", F.col("sha256")).alias("kept_sha256"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
