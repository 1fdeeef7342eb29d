"""Exact length histogram: documents by encoded length, suffix sums for every context limit.

Each text is encoded whole; documents are then counted per length, so the rest of the work is on
one row per distinct length. Running sums go in two levels (blocks of lengths, then lengths within
a block), so no task sees all lengths. For a limit L between two lengths of the histogram, the
totals follow from the row of the largest length <= L (``at_limit``).

Defined cases: a null text has length 0, as an empty one; repeated rows count each; an empty table
gives an empty histogram; only ``text`` is read.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.common import map_rows, texts_of

#: Byte-level BPE ranks: lines of base64 token and id. The file must exist on every executor.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words as that vocabulary cuts them before merging; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTHS_PER_BLOCK = 256


def encoder(ranks: str = RANKS, pattern: str = PATTERN):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_counts(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``n_tokens`` of every row."""

    def build():
        encode = encoder(ranks).encode_ordinary

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [len(encode(text)) for text in texts_of(batch.column(0))]
            return pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["n_tokens"])

        return step

    return map_rows(docs.select(F.col("text").cast("string")), "n_tokens long", build)


def histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(hist: DataFrame, per_block: int = LENGTHS_PER_BLOCK) -> DataFrame:
    """Per length L: the exact totals that a context limit of L gives.

    ``docs_fitting``: documents of length <= L; ``docs_cut``: longer ones; ``tokens_total``: all
    tokens; ``tokens_kept``: tokens left when each document is cut at L; ``quantile``: share of
    documents of length <= L.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    base = hist.withColumn("block", F.floor(F.col("n_tokens") / per_block)).withColumn("tokens", tokens)
    blocks = base.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select(
        "block",
        zero(F.sum("d").over(after)).alias("docs_after"),
        zero(F.sum("t").over(after)).alias("tokens_after"),
        F.sum("d").over(everything).alias("docs_all"),
        F.sum("t").over(everything).alias("tokens_all"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        base.withColumn("d", zero(F.sum("n_docs").over(within)))
        .withColumn("t", zero(F.sum("tokens").over(within)))
        .join(blocks, "block")
        .withColumn("docs_cut", F.col("d") + F.col("docs_after"))
        .withColumn("tokens_longer", F.col("t") + F.col("tokens_after"))
    )
    return rows.select(
        "n_tokens",
        "n_docs",
        (F.col("docs_all") - F.col("docs_cut")).alias("docs_fitting"),
        "docs_cut",
        F.col("tokens_all").alias("tokens_total"),
        (F.col("tokens_all") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_cut")).alias("tokens_kept"),
        ((F.col("docs_all") - F.col("docs_cut")) / F.col("docs_all")).alias("quantile"),
    )


def at_limit(limits: DataFrame, limit: int) -> DataFrame:
    """The totals for any limit, also one that no document has as its length.

    Up to the largest length L0 <= limit nothing changes but ``tokens_kept``, which grows by
    ``docs_cut`` for every token between. Below the shortest length every document is cut.
    """
    fits = F.col("n_tokens") <= limit
    row = F.struct("n_tokens", "docs_fitting", "docs_cut", "tokens_kept")
    b = limits.agg(
        F.max_by(F.when(fits, row), F.when(fits, F.col("n_tokens"))).alias("b"),
        F.max("tokens_total").alias("tokens_total"),
        F.sum("n_docs").alias("docs"),
    )
    beyond = (limit - F.col("b.n_tokens")) * F.col("b.docs_cut")
    return b.select(
        F.lit(limit).cast("long").alias("limit"),
        F.coalesce("b.docs_fitting", F.lit(0)).alias("docs_fitting"),
        F.coalesce("b.docs_cut", "docs", F.lit(0)).alias("docs_cut"),
        F.coalesce(F.col("b.tokens_kept") + beyond, F.col("docs") * limit, F.lit(0)).alias("tokens_kept"),
        F.coalesce("tokens_total", F.lit(0)).alias("tokens_total"),
    )


def quantile(limits: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    return limits.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
