"""Range coder and token files: exact round trips, checksums, order."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demandloom.llm import range_coder, token_files

DOCS = "doc_id long, text string, part int, ids string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], DOCS)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**32 - 1)), max_size=300), max_size=12))
def test_coder_gives_ids_back(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    back = range_coder.decode(range_coder.encode(blocks))
    assert [b.tolist() for b in back] == [b.tolist() for b in blocks]


def test_coder_with_full_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    n = range_coder.BLOCK
    blocks = [
        np.zeros(n, np.uint32), rng.integers(0, 2**32, n, np.uint32), np.arange(n, dtype=np.uint32) * 7,
        np.tile(np.arange(9, dtype=np.uint32), n // 9), np.minimum(rng.zipf(1.2, n), 50_000).astype(np.uint32),
        np.full(n, 2**32 - 1, np.uint32), np.zeros(0, np.uint32), np.array([2], np.uint32),
    ]
    payloads = range_coder.encode(blocks)
    monkeypatch.setattr(range_coder, "LANES", 3)  # blocks do not depend on the lanes beside them
    assert range_coder.encode(blocks) == payloads
    for order in (range(len(blocks)), reversed(range(len(blocks)))):
        order = list(order)
        for i, ids in zip(order, range_coder.decode([payloads[i] for i in order])):
            assert (ids == blocks[i]).all() and len(ids) == len(blocks[i])
    assert len(payloads[0]) < 40 and len(payloads[3]) < n // 8  # what repeats costs next to nothing


def test_crc32_of_joined_parts():
    rng = np.random.default_rng(1)
    parts = [rng.bytes(n) for n in (0, 1, 4, 999, 16384)]
    for x in parts:
        for y in parts:
            a, b, n = (np.array([v], np.int64) for v in (zlib.crc32(x), zlib.crc32(y), len(y)))
            assert token_files.join_crc32(a, b, n).tolist() == [zlib.crc32(x + y)]


ODD = [
    (5, None), (4, ""), (4, " "), (3, "a b  c\n d e  f 's it's"), (3, "a b  c\n d e  f 's it's"), (None, "null id"),
    (None, None), (-9, "<|endoftext|> x<|endoftext|>"), (2, "word " * 9000), (1, "x" * 5000), (6, "\U0001f600 \x1c y \x85 z"), (7, "\x00"),
]


def ids_of(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_files.tokenizer_path())
    return (plain.encode(text, add_special_tokens=False).ids if text else []) + [2]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_long_texts_in_chunks(monkeypatch, chunk, sf_dir):
    import pyarrow.parquet as pq

    monkeypatch.setattr(token_files, "CHUNK", chunk)
    encode = token_files.Encoder()
    texts = [t for _, t in ODD] + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()[:40]
    for text in texts if chunk > 1 else texts[:20]:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(text)


def test_file_gives_documents_back(spark, tmp_path):
    token_files.write(documents(spark, ODD).repartition(5), f"{tmp_path}/ids")
    blocks = token_files.open_file(spark, f"{tmp_path}/ids")
    back = sorted(token_files.read(blocks).collect(), key=lambda r: r.start)
    at = 0
    for r in back:  # the stream has no gaps and ascends by doc_id, null ids first
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    order = [r.doc_id for r in back]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    assert sorted((r.doc_id or 0, r.ids) for r in back) == sorted((i or 0, ids_of(t)) for i, t in ODD)
    digests = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_files.summary(blocks).collect()}
    assert digests == {(r.doc_id, r.start): (r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in back}
    assert blocks.where("part is null or size(ends) = 0").count() == 0


def test_many_blocks_and_flushes(spark, tmp_path, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    token_files.write(docs, f"{tmp_path}/ids")
    start, found = 0, {r.doc_id: r for r in token_files.summary(token_files.open_file(spark, f"{tmp_path}/ids")).collect()}
    assert len(found) == len(texts)
    for i in sorted(texts):
        ids = ids_of(texts[i])
        expected = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == expected
        start += len(ids)


def test_damage_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    token_files.write(documents(spark, [(i, f"text {i} " * 50) for i in range(20)]).coalesce(1), f"{tmp_path}/ids")
    blocks = token_files.open_file(spark, f"{tmp_path}/ids")
    raw = blocks.first().payload
    for at in (0, 1, len(raw) // 2, len(raw) - 9):
        bad = bytearray(raw)
        bad[at] ^= 0x55
        broken = blocks.limit(1).withColumn("payload", F.lit(bytes(bad)))
        with pytest.raises(Exception, match="damaged block"):
            token_files.summary(broken).collect()


def test_empty_table(spark, tmp_path):
    token_files.write(documents(spark, []), f"{tmp_path}/ids")
    blocks = token_files.open_file(spark, f"{tmp_path}/ids")
    assert token_files.summary(blocks).collect() == [] and token_files.read(blocks).collect() == []
