"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items (ten consecutive words; a shorter item is one
window). Words are numbered by the benchmark's own vocabulary; every other word is number 0 and
can never match. For each pattern length a shift table over blocks of two words says how far the
scan may jump; where the shift is 0, the bucket of the block's hash lists the windows ending there
and a direct comparison confirms them.

Defined cases: a null text has no words; empty texts and items give no window; repeated items
share their windows and all count; repeated rows are searched one by one; an empty benchmark or
empty documents give no hit and no row respectively; only ``doc_id``/``text`` and
``item_id``/``text`` are read, so further columns never clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import LOWER_BYTES, bytes_of, tidy
from demandloom.sources.staging import stage

WINDOW = 10
#: Benchmark text per search table. A larger benchmark is searched in several passes.
BLOCK_BYTES = 8 << 20
#: Lower-cased text is cut at ASCII characters other than digits and a-z.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text lower-cased in A-Z."""
    return _WORD.findall(text.translate(LOWER_BYTES))


class WuManber:
    """Shift and bucket tables for the windows of one block of items."""

    BLOCK = 2

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                windows.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.base = len(self.number) + 1
        self.windows = windows
        lengths: dict[int, list[tuple[int, ...]]] = {}
        for w in windows:
            lengths.setdefault(len(w), []).append(w)
        self.tables = [self._table(length, ws) for length, ws in sorted(lengths.items())]

    def _table(self, length: int, windows: list[tuple[int, ...]]):
        block = min(self.BLOCK, length)
        shift: dict[int, int] = {}
        bucket: dict[int, list[tuple[int, ...]]] = {}
        for w in windows:
            for end in range(block, length + 1):
                key = w[end - 1] if block == 1 else w[end - 2] * self.base + w[end - 1]
                shift[key] = min(shift.get(key, length), length - end)
                if end == length:
                    bucket.setdefault(key, []).append(w)
        return length, block, length - block + 1, shift, bucket

    def search(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (start, end) runs of covered words, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        base, n = self.base, len(ids)
        for length, block, most, shift, bucket in self.tables:
            at = length - 1
            while at < n:
                last = ids[at]
                key = last if block == 1 else ids[at - 1] * base + last
                # a block with an unknown word is in no table, as number 0 is never given out
                jump = shift.get(key, most) if last else length
                if jump:
                    at += jump
                    continue
                start = at - length + 1
                here = tuple(ids[start : at + 1])
                for w in bucket[key]:
                    if w == here:
                        spans.append((start, at + 1))
                        items |= self.windows[w]
                        break
                at += 1
        spans.sort()
        merged: list[tuple[int, int]] = []
        for start, end in spans:
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        return merged, items


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded text size; one block is in the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("text IS NOT NULL")
    block: list[tuple[str, bytes]] = []
    size = 0
    for item, text in items.toLocalIterator():
        block.append((item if item is not None else "", bytes(text)))
        size += len(text)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: its words, merged hit runs (word numbers) and the items found.

    One pass over the documents per block of the benchmark; passes before the last are written. No row of ``docs`` is shuffled.
    """
    spark = docs.sparkSession
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.lit(None).cast("long").alias("n_words"),
        *(F.array().cast("array<int>").alias(c) for c in ("starts", "ends")),
        F.array().cast("array<string>").alias("items"),
    )
    blocks = _blocks(benchmark, block_bytes)
    block = next(blocks, [])
    while (following := next(blocks, None)) is not None:
        found = stage(_one_pass(found, spark.sparkContext.broadcast(block), window, True), "decontamination")
        block = following
    return _one_pass(found, spark.sparkContext.broadcast(block), window, False).drop("text")


def _one_pass(found: DataFrame, block, window: int, keep_text: bool) -> DataFrame:
    schema = found.schema

    def run(batches):
        tables = WuManber(block.value, window)
        number = tables.number.get
        for batch in batches:
            counts, starts, ends, items = [], [], [], []
            old = [batch.column(i).to_pylist() for i in (3, 4, 5)]
            for k, text in enumerate(bytes_of(batch.column(1))):
                all_words = words(text)
                spans, names = tables.search([number(w, 0) for w in all_words])
                counts.append(len(all_words))
                starts.append(old[0][k] + [a for a, _ in spans])
                ends.append(old[1][k] + [b for _, b in spans])
                items.append(sorted({*old[2][k], *names}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1) if keep_text else pa.nulls(batch.num_rows, pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(starts, pa.list_(pa.int32())),
                    pa.array(ends, pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["doc_id", "text", "n_words", "starts", "ends", "items"],
            )

    return found.mapInArrow(tidy(run), schema)


def _covered(starts: Column, ends: Column) -> Column:
    """Length of the union of the runs (passes may report overlapping ones)."""
    runs = F.array_sort(F.arrays_zip(starts.alias("s"), ends.alias("e")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda acc, r: F.struct(
        (acc["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(acc["to"], r["s"]))).cast("long").alias("n"),
        F.greatest(acc["to"], r["e"]).alias("to"),
    )
    return F.aggregate(runs, zero, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: words, hit words, items found and the verdict."""
    found = find_windows(docs, benchmark, window, block_bytes)
    return found.select(
        "doc_id",
        "n_words",
        _covered(F.col("starts"), F.col("ends")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns kept, nothing shuffled."""
    kept = docs
    for block in _blocks(benchmark, BLOCK_BYTES):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            tables = WuManber(shared.value, window)
            number = tables.number.get
            for batch in batches:
                texts = bytes_of(batch.column(batch.schema.get_field_index("text")))
                clean = [not tables.search([number(w, 0) for w in words(t)])[1] for t in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(tidy(run), docs.schema)
    return kept


def digest(items: list[str]) -> str:
    """The item digest of ``contamination``, for one document (tests)."""
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()
