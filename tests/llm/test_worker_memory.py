"""Python workers stay small: two of them stand beside an executor's heap."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from demandloom.llm import jaccard
from demandloom.llm.pieces import Pieces


def test_sorting_signatures_takes_few_bytes_an_entry():
    rng = np.random.default_rng(1)
    n = jaccard.HELD
    held = [rng.integers(0, 32, n).astype(np.uint8), rng.integers(0, 1 << 40, n), rng.integers(0, 2**63, n).astype(np.uint64)]
    jaccard._emit(*(x[:9] for x in reversed(held)), 384)  # pyarrow's imports are none of its memory
    tracemalloc.start()
    try:
        blocks = jaccard._emit(held.pop(), held.pop(), held.pop(), 384)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(len(b.as_py()) for b in blocks.column(1)) == 15 * n
    assert most < 64 * n


def test_repeated_values_and_their_numbers():
    rng = np.random.default_rng(2)
    for n, high in ((0, 5), (1, 5), (2, 1), (40, 9), (4000, 3000)):
        values = rng.integers(0, high, n).astype(np.uint64)
        distinct, counts = np.unique(values, return_counts=True)
        found, numbers = jaccard._several(values)
        assert found.tolist() == distinct[counts > 1].tolist() and numbers.tolist() == counts[counts > 1].tolist()


def test_piece_table_needs_no_python_workers(spark):
    pieces = Pieces(["a", "▁ab", "<0x00>", "b"], [-1.0, -2.5, 0.0, -3.0], [1, 1, 6, 4])
    table = pieces.table(spark)
    assert table.dtypes == [("piece", "string"), ("score", "double"), ("id", "int")]
    assert sorted(map(tuple, table.collect())) == [("a", -1.0, 0), ("b", -3.0, 3), ("▁ab", -2.5, 1)]
    joined = table.where(F.length("piece") > 1)
    assert "RDD" not in joined._jdf.queryExecution().executedPlan().toString()
    assert Pieces(["<0x00>"], [0.0], [6]).table(spark).collect() == []
