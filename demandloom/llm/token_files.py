"""Token ids of documents in compressed files, written in ascending order of doc_id and read back.

Writing: rows are dealt into ranges of (doc_id, hash of the text), sorted within each, and encoded.
The ids of a range are one stream, cut into blocks of ``range_coder.BLOCK`` ids; a document may begin
and end anywhere and may fill many blocks. Format: a Parquet table with one row a block,

    part       number of the range, ascending as the ids are
    block      number of the block within its range
    begin      ids of the range before the block
    first      number within the range of the document that the block's first id belongs to
    doc_ids    documents with ids in the block, in order
    ends       where each of them ends in the block
    ids_crc32  crc32 of the block's ids as little-endian unsigned 32-bit integers
    payload    the ids, coded by ``range_coder``: every block on its own

Reading: any task decodes any blocks (column ``payload`` is all it needs), compares the checksum and
fails by name where it differs. The parts of a document are put together by (part, number): small
rows unless the ids themselves are asked for. ``start`` follows from the
running sum of ids over the ranges: one row a range.

Memory: a task holds one chunk of text (``CHUNK`` characters), ``LANES`` blocks and the model of
those lanes. A long text is cut at single spaces between words where the tokenizer cuts anyway, so
it is encoded in chunks, and a word that the task has met before is looked up.

Defined cases: a null or empty text has only the end id; repeated rows are documents each; documents
of one doc_id come in the order of the hash of their text; null doc_ids come first; special tokens
within a text are encoded as the tokenizer does by default; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandloom.llm import range_coder
from demandloom.llm.common import tidy
from demandloom.session import ship_package

END = 2
#: Characters of a text encoded together, different words that a task remembers.
CHUNK, WORDS = 1 << 18, 400_000

_BLOCKS = (
    "part int, block int, begin long, first long, doc_ids array<long>, ends array<int>,"
    " ids_crc32 long, payload binary"
)
_PIECES = "part int, number long, block int, doc_id long, start long, n long, crc32 long"
#: A single space with a word on both sides. Byte-level vocabularies always cut before it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Whole texts to ids; where the vocabulary allows it, in chunks and with a memory of words."""

    def __init__(self, path: str | None = None, end: int = END):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        cuts = repr(self.tokenizer.pre_tokenizer)
        self.by_word = self.tokenizer.normalizer is None and cuts.startswith("ByteLevel(") and "add_prefix_space=False" in cuts
        self.words: dict[str, bytes] = {}
        self.end = np.array([end], "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        """Ids of a text and the end id, as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self.by_word:
            return b"".join(map(self._words, self._chunks(text))) + self.end
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes() + self.end

    @staticmethod
    def _chunks(text: str) -> Iterator[str]:
        begin = 0
        while len(text) - begin > CHUNK and (cut := _CUT.search(text, begin + CHUNK)):
            yield text[begin : cut.start()]
            begin = cut.start()
        yield text[begin:]

    def _words(self, chunk: str) -> bytes:
        """Ids of a chunk. All its words not in the memory are encoded as one text.

        The first and the last word may have other space around them; they stay at the ends.
        """
        first, *others = _CUT.split(chunk)
        if not others:
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        last = " " + others.pop()
        middle = [" " + w for w in others]
        if len(self.words) > WORDS:
            self.words.clear()
        new = [w for w in dict.fromkeys(middle) if w not in self.words]
        found = self.tokenizer.encode("".join([first, *new, last]), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        begins = np.cumsum([len(first), *map(len, new)])  # where new words and the last one begin
        at = 4 * np.searchsorted(np.array([o for o, _ in found.offsets]), begins)
        parts = [ids[i:j] for i, j in zip(np.r_[0, at], np.r_[at, len(ids)])]
        self.words.update(zip(new, parts[1:-1]))
        return b"".join([parts[0], *map(self.words.__getitem__, middle), parts[-1]])


class _Writer:
    """Blocks of one range."""

    def __init__(self, part: int):
        self.part, self.block, self.begin, self.document = part, 0, 0, -1
        self.ids: list[bytes] = []  # ids not written yet
        self.held = 0
        self.docs: list[tuple[int, int | None, int]] = []  # (number, doc_id, ids not written yet)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.document += 1
        self.ids.append(ids)
        self.held += len(ids) // 4
        self.docs.append((self.document, doc_id, len(ids) // 4))

    def flush(self, last: bool) -> pa.RecordBatch | None:
        """All full blocks, and at the end of the range what is left."""
        size = range_coder.BLOCK
        count = -(-self.held // size) if last else self.held // size
        if not count:
            return None
        stream = np.frombuffer(b"".join(self.ids), "<u4")
        blocks = [stream[i * size : (i + 1) * size] for i in range(count)]
        rest = stream[count * size :]
        docs, rows, at = self.docs, [], 0
        for block in blocks:
            ids, ends, first, filled = [], [], docs[at][0], 0
            while filled < len(block):
                number, doc_id, n = docs[at]
                take = min(n, len(block) - filled)
                filled += take
                ids.append(doc_id)
                ends.append(filled)
                if take < n:  # the document goes on in the next block
                    docs[at] = (number, doc_id, n - take)
                else:
                    at += 1
            rows.append((first, ids, ends))
        self.docs, self.ids, self.held = docs[at:], [rest.tobytes()], len(rest)
        sizes = np.array([len(b) for b in blocks])
        begin = self.begin + np.cumsum(sizes) - sizes
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([self.part] * count, pa.int32()),
                pa.array(range(self.block, self.block + count), pa.int32()),
                pa.array(begin, pa.int64()),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                pa.array([zlib.crc32(b.tobytes()) for b in blocks], pa.int64()),
                pa.array(range_coder.encode(blocks), pa.binary()),
            ],
            names=[c.split()[0] for c in _BLOCKS.split(", ")],
        )
        self.block, self.begin = self.block + count, self.begin + int(sizes.sum())
        return batch


def blocks_of(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """The rows of the file: documents in order, encoded and cut into blocks."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = Encoder(path, end), _Writer(TaskContext.get().partitionId())
        most = range_coder.LANES * range_coder.BLOCK
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):  # one text at a time as a Python string
                writer.add(doc_id.as_py(), encode(text.as_py()))
                if writer.held >= most and (out := writer.flush(False)) is not None:
                    yield out
        if (out := writer.flush(True)) is not None:
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("dealt")]
    dealt = rows.withColumn("dealt", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return dealt.select("doc_id", "text").mapInArrow(tidy(run), _BLOCKS)


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``folder``; payloads are not compressed again."""
    blocks_of(docs, path, end).write.option("compression", "none").parquet(folder)


def open_file(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(folder)


def pieces(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decoded blocks: one row per document and block, ``start`` counted within the range."""
    ship_package(blocks.sparkSession)

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(8)]
        decoded = range_coder.decode(batch.column("payload").to_pylist())
        names = ("part", "block", "begin", "first", "doc_ids", "ends", "ids_crc32")
        for ids, part, block, begin, first, doc_ids, ends, crc in zip(
            decoded, *(batch.column(c).to_pylist() for c in names)
        ):
            raw = ids.astype("<u4").tobytes()
            if zlib.crc32(raw) != crc or 4 * ends[-1] != len(raw):
                raise ValueError(f"damaged block {block} of range {part}: its checksum differs")
            for i, (doc_id, stop) in enumerate(zip(doc_ids, ends)):
                at = ends[i - 1] if i else 0
                one = raw[4 * at : 4 * stop]
                row = (part, first + i, block, doc_id, begin + at, stop - at, zlib.crc32(one), one if with_ids else None)
                for column, value in zip(columns, row):
                    column.append(value)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        fields = [c.split()[0] for c in _PIECES.split(", ")] + ["ids"]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays[: 7 + with_ids], names=fields[: 7 + with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, range_coder.LANES):
                yield decode(batch.slice(at, range_coder.LANES))

    return blocks.mapInArrow(tidy(run), _PIECES + (", ids binary" if with_ids else ""))


def _starts(blocks: DataFrame) -> DataFrame:
    """Ids before each range."""
    sizes = blocks.groupBy("part").agg(F.sum(F.element_at("ends", -1).cast("long")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document with its ids, the end id included."""
    parts = pieces(blocks, with_ids=True).groupBy("part", "number").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"),
        F.array_sort(F.collect_list(F.struct("block", "ids"))).alias("p"),  # the blocks of one document
    )
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    rows = parts.join(F.broadcast(_starts(blocks)), "part")  # one row a range
    rows = rows.select("doc_id", (F.col("before") + F.col("start")).alias("start"), joined)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("ids")
            values = np.frombuffer(b"".join(raw.to_pylist()), "<u4").astype(np.int64)
            ends = np.r_[0, np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False) // 4)]
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
            n = pa.array(np.diff(ends), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, ids], names=["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(lists, "doc_id long, start long, n_tokens long, ids array<long>")


# crc32 of joined byte strings: zlib's polynomial, arithmetic over arrays of 32-bit values
_POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the polynomial, bit-reversed as in crc32."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> bit) & 1, b, 0)
        b = (b >> 1) ^ np.where(b & 1, _POLYNOMIAL, 0)
    return out


def join_crc32(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of x + y from those of x and y, and the bytes of y."""
    shift, power, bits = np.full_like(first, 1 << 31), np.full_like(first, 1 << 23), length.copy()  # 1 and x**8
    while bits.any():
        shift = np.where(bits & 1, _times(shift, power), shift)
        power, bits = _times(power, power), bits >> 1
    return _times(shift, first) ^ second


def summary(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded blocks."""
    parts = pieces(blocks).groupBy("part", "number").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"),
        F.array_sort(F.collect_list(F.struct("block", "n", "crc32"))).alias("p"),  # the blocks of one document
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("p")
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            n, crc = (flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            at = np.cumsum(counts) - counts
            whole, total = crc[at].copy(), n[at].copy()
            for i in range(1, int(counts.max(initial=0))):
                more = np.flatnonzero(counts > i)
                whole[more] = join_crc32(whole[more], crc[at[more] + i], 4 * n[at[more] + i])
                total[more] += n[at[more] + i]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), batch.column("start"), pa.array(total), pa.array(whole)],
                names=["part", "doc_id", "start", "n", "crc32"],
            )

    columns = parts.select("part", "doc_id", "start", "p")
    rows = columns.mapInArrow(run, "part int, doc_id long, start long, n long, crc32 long")
    return rows.join(F.broadcast(_starts(blocks)), "part").select(  # one row a range
        "doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32")
    )
