"""Price repair and the promotion state machine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions.rounding import round_to
from demandloom.operators.cleaning import HIGH_PRICE, LOW_PRICE, implausible_price
from demandloom.sources.staging import stage_lookup

# Thresholds of the promotion state machine (fixed values).
PROMO_START = 0.90
PROMO_END = 0.97
SMALL_MOVE = 0.05

# Rows of one product that a single task sees at once in the ordered price operators.
BLOCK_ROWS = 100_000


def product_medians(daily: DataFrame) -> DataFrame:
    """Exact median price per product.

    Prices are first counted per (product, price), which spreads a hot product over the
    cluster; the median then reads one weighted row per distinct price.
    """
    counted = (
        daily.filter(F.col("unit_price").isNotNull())
        .groupBy("gb_id", "unit_price")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy("gb_id").agg(F.percentile("unit_price", 0.5, F.col("n")).alias("ref_global_price"))


def recent_store_medians(daily: DataFrame, days_window: int) -> DataFrame:
    """Median per store and product over the last days of the data set (a month of rows a group)."""
    last_day = daily.agg(F.max("date")).scalar()
    return (
        daily.filter(F.col("date") >= F.date_sub(last_day, days_window))
        .groupBy("gln", "gb_id")
        .agg(F.median("unit_price").alias("ref_store_price"))
    )


def correct_daily_unit_price(
    daily: DataFrame,
    low: float = LOW_PRICE,
    high: float = HIGH_PRICE,
    days_window: int = 30,
    history: DataFrame | None = None,
) -> DataFrame:
    """Replace implausible prices by the recent store-product median, else the product median.

    ``history`` is the table the medians are taken from (default: ``daily``); a written table
    with the same prices avoids running the plan of ``daily`` for them.
    """
    history = daily if history is None else history
    priced = (
        daily.withColumn("price_error", implausible_price(low, high))
        .join(stage_lookup(recent_store_medians(history, days_window), "ref_store"), ["gln", "gb_id"], "left")
        .join(stage_lookup(product_medians(history), "ref_global"), "gb_id", "left")
        .withColumn("ref_price", F.coalesce("ref_store_price", "ref_global_price"))
    )
    repaired = F.col("price_error") & F.col("ref_price").isNotNull()
    source = (
        F.when(repaired & F.col("ref_store_price").isNotNull(), "store_median")
        .when(repaired, "global_median")
        .when(F.col("price_error"), "uncorrected_missing_reference")
    )
    return priced.withColumns(
        {
            "corrected_unit_price": F.when(repaired, F.col("ref_price")).otherwise(F.col("unit_price")),
            "price_corrected_flag": repaired,
            "price_correction_source": source,
        }
    )


# --- promotion state machine ---------------------------------------------------------
#
# State: (in promotion?, standard price). Rows of a product are visited by (date, store).
#   normal:    ratio < PROMO_START        -> promotion starts, standard price kept
#              |ratio - 1| > SMALL_MOVE   -> standard price := price
#   promotion: ratio > PROMO_END          -> promotion ends, standard price := price
#
# A product may hold a third of all rows, so it is not run as one group. Its rows are cut
# into date blocks of bounded size. Each block reports how it maps any entry state to an
# exit state; entry states follow by walking the short reports; then every block is replayed
# on its own. The result equals one pass over the whole product.
#
# The report is small because the machine forgets: after a reset ("standard price := price")
# the rest of the block depends on the resetting row alone. An unknown entry price can be
# ended only by a running maximum or minimum of the block, and a promotion entered at such
# a minimum only by a running maximum after it. Those rows, each with the exit state that
# follows a reset there, answer every entry state exactly.


def _step(price: float, promo: bool, std: float, limits: tuple[float, float, float]) -> tuple[bool, bool, float]:
    """(reset?, promo, std) after one row. A price of NaN or a standard price <= 0 changes nothing."""
    start, end, move = limits
    ratio = price / std if std > 0 else 1.0
    if promo:
        return (True, False, price) if ratio > end else (False, True, std)
    if ratio < start:
        return False, True, std
    if abs(ratio - 1.0) > move:
        return True, False, price
    return False, False, std


def _replay(prices: list[float], promo: bool, std: float | None, limits) -> tuple[list, list, list]:
    flags, stds, ratios = [], [], []
    for price in prices:
        if std is None and price == price:
            std = price
        if std is not None:
            _, promo, std = _step(price, promo, std, limits)
        flags.append(promo)
        stds.append(std)
        ratios.append(price / std - 1.0 if promo else 0.0)
    return flags, stds, ratios


def _records(prices: np.ndarray, sign: float) -> np.ndarray:
    """Positions of the running maxima (sign 1) or minima (sign -1); NaN never is one."""
    values = np.where(np.isnan(prices), -np.inf, sign * prices)
    best = np.maximum.accumulate(values)
    fresh = np.concatenate(([True], best[1:] > best[:-1])) & ~np.isnan(prices)
    return np.flatnonzero(fresh)


def _report(prices: np.ndarray, limits) -> pd.DataFrame:
    lows = _records(prices, -1.0)
    keys = set(_records(prices, 1.0)) | set(lows)
    for low in lows:
        keys |= set(_records(prices[low + 1 :], 1.0) + low + 1) if low + 1 < len(prices) else set()
    values = prices.tolist()
    exits: dict[int, tuple[bool, float]] = {}
    for key in sorted(keys, reverse=True):
        visited, promo, std, i = [key], False, values[key], key + 1
        exit_state = None
        while i < len(values):
            reset, promo, std = _step(values[i], promo, std, limits)
            if reset:
                if i in exits:
                    exit_state = exits[i]
                    break
                visited.append(i)
            i += 1
        exit_state = exit_state or (promo, std)
        exits.update(dict.fromkeys(visited, exit_state))
    if not keys:  # no price in the whole block: a single row that changes nothing
        return pd.DataFrame({"pos": [0], "price": [np.nan], "exit_promo": [False], "exit_std": [np.nan]})
    order = sorted(keys)
    return pd.DataFrame(
        {
            "pos": order,
            "price": [values[k] for k in order],
            "exit_promo": [exits[k][0] for k in order],
            "exit_std": [exits[k][1] for k in order],
        }
    )


def _cross_block(promo: bool, std: float | None, block: pd.DataFrame, limits) -> tuple[bool, float | None]:
    """State after a block, from its report rows in row order."""
    for price, exit_promo, exit_std in zip(block["price"], block["exit_promo"], block["exit_std"]):
        if std is None:
            if price == price:  # the first real price of the product acts like a reset
                return bool(exit_promo), exit_std
            continue
        reset, promo, std = _step(price, promo, std, limits)
        if reset:
            return bool(exit_promo), exit_std
    return promo, std


def date_blocks(daily: DataFrame, block_rows: int) -> DataFrame:
    """(gb_id, date, block): consecutive dates of a product, about ``block_rows`` rows a block.

    Works on row counts per product and date, so its windows see one row per calendar day.
    """
    by_date = Window.partitionBy("gb_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    counts = daily.groupBy("gb_id", "date").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(by_date), F.lit(0))
    cut = counts.select("gb_id", "date", F.floor(before / block_rows).alias("cut"))
    dense = F.dense_rank().over(Window.partitionBy("gb_id").orderBy("cut")) - 1
    return cut.select("gb_id", "date", dense.cast("bigint").alias("block"))


def standard_price_and_discount(
    daily: DataFrame,
    promo_start: float = PROMO_START,
    promo_end: float = PROMO_END,
    small_move: float = SMALL_MOVE,
    price_col: str = "unit_price",
    block_rows: int | None = None,
) -> DataFrame:
    """Add ``standard_price``, ``on_promotion`` and ``discount`` per product.

    ``daily`` should be a written table: it is read once for the block reports and once
    for the replay.
    """
    block_rows = block_rows or BLOCK_ROWS
    limits = (promo_start, promo_end, small_move)
    product = daily.schema["gb_id"].dataType
    # plain integers travel to Python much faster than dates
    rows = daily.withColumn("date", F.unix_date("date"))
    entry_unknown = {"entry_promo": F.lit(False), "entry_std": F.lit(None).cast("double")}
    largest = daily.groupBy("gb_id").count().agg(F.max("count")).first()[0] or 0
    if largest <= block_rows:  # every product fits one block
        rows = rows.withColumns({"block": F.lit(0).cast("bigint"), **entry_unknown})
    else:
        blocks = stage_lookup(date_blocks(rows, block_rows), "price_blocks")
        rows = rows.join(blocks, ["gb_id", "date"])
        entry = stage_lookup(_entry_states(rows, blocks, price_col, product, limits), "price_entries")
        rows = rows.join(entry, ["gb_id", "block"], "left")

    def replay(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.iloc[np.lexsort((part["gln"], part["date"]))]
        promo, std = part["entry_promo"].iloc[0], part["entry_std"].iloc[0]
        flags, stds, ratios = _replay(
            part[price_col].astype(float).tolist(), bool(promo), None if pd.isna(std) else std, limits
        )
        part = part.drop(columns=["entry_promo", "entry_std", "block"])
        return part.assign(standard_price=stds, on_promotion=flags, raw_discount=ratios)

    out_schema = T.StructType(
        [rows.schema[f.name] for f in daily.schema.fields]
        + [
            T.StructField("standard_price", T.DoubleType()),
            T.StructField("on_promotion", T.BooleanType()),
            T.StructField("raw_discount", T.DoubleType()),
        ]
    )
    return (
        rows.fillna({"entry_promo": False})
        .groupBy("gb_id", "block")
        .applyInPandas(replay, out_schema)
        .withColumns(
            {
                "date": F.date_from_unix_date("date"),
                "discount": clean_discount(F.col("raw_discount"), F.col("on_promotion")),
            }
        )
        .drop("raw_discount")
    )


def _entry_states(rows: DataFrame, blocks: DataFrame, price_col: str, product: T.DataType, limits) -> DataFrame:
    """(gb_id, block, entry_promo, entry_std) for every block but the first of a product."""
    last_block = blocks.groupBy("gb_id").agg(F.max("block").alias("last_block"))

    def report(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        prices = part.iloc[np.lexsort((part["gln"], part["date"]))][price_col].to_numpy(dtype=float)
        return _report(prices, limits).assign(gb_id=key[0], block=key[1])

    # the exit state of a product's last block is never needed: most products send no rows here
    reports = (
        rows.select("gb_id", "block", "gln", "date", price_col)
        .join(last_block, "gb_id")
        .filter(F.col("block") < F.col("last_block"))
        .drop("last_block")
        .groupBy("gb_id", "block")
        .applyInPandas(
            report,
            T.StructType()
            .add("gb_id", product)
            .add("block", T.LongType())
            .add("pos", T.LongType())
            .add("price", "double")
            .add("exit_promo", "boolean")
            .add("exit_std", "double"),
        )
    )

    def entries(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out, promo, std = [], False, None
        for block, lines in part.sort_values(["block", "pos"]).groupby("block", sort=True):
            promo, std = _cross_block(promo, std, lines, limits)
            out.append((key[0], block + 1, promo, std))
        return pd.DataFrame(out, columns=["gb_id", "block", "entry_promo", "entry_std"])

    return reports.groupBy("gb_id").applyInPandas(
        entries,
        T.StructType()
        .add("gb_id", product)
        .add("block", T.LongType())
        .add("entry_promo", "boolean")
        .add("entry_std", "double"),
    )


def clean_discount(discount: Column, promo: Column, tolerance: float = 1e-6) -> Column:
    """Noise and discounts outside promotions are zero; four decimals."""
    value = F.nanvl(discount, F.lit(None).cast("double"))
    return round_to(F.when(~promo | (F.abs(value) < tolerance), F.lit(0.0)).otherwise(value), 4)


def rolling_top_price(daily: DataFrame, window: int = 30, top: int = 5, block_rows: int | None = None) -> DataFrame:
    """Mean of the ``top`` highest of the last ``window`` prices per product, by (date, store).

    A row frame over a hot product would be one task, so rows get their position in the
    product (day counts plus rank within the day) and windows run on position blocks that
    repeat the last ``window - 1`` rows of the block before.
    """
    block_rows = max(block_rows or BLOCK_ROWS, window - 1)  # a halo comes from one block
    days = Window.partitionBy("gb_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    counts = daily.groupBy("gb_id", "date").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("gb_id", "date", F.coalesce(F.sum("n").over(days), F.lit(0)).alias("offset"))
    in_day = Window.partitionBy("gb_id", "date").orderBy("gln")
    position = F.col("offset") + F.row_number().over(in_day) - 1
    home = F.floor(F.col("pos") / block_rows)
    reach = F.floor((F.col("pos") + window - 1) / block_rows)
    frame = Window.partitionBy("gb_id", "block").orderBy("pos").rowsBetween(-(window - 1), 0)
    highest = F.slice(F.sort_array(F.collect_list("unit_price").over(frame), asc=False), 1, top)
    total = F.aggregate(highest, F.lit(0.0), lambda acc, x: acc + x)
    return (
        daily.select("gln", "gb_id", "date", "unit_price")
        .join(offsets, ["gb_id", "date"])
        .withColumn("pos", position)
        .withColumn("home", home)
        .withColumn("block", F.explode(F.sequence(home, reach)))
        .withColumn("rolling_max_price", F.try_divide(total, F.size(highest)))
        .filter(F.col("block") == F.col("home"))
        .select("gln", "gb_id", "date", "unit_price", "rolling_max_price")
    )


__all__ = [
    "clean_discount",
    "correct_daily_unit_price",
    "date_blocks",
    "product_medians",
    "rolling_top_price",
    "standard_price_and_discount",
]
