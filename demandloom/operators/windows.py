"""Lag, rolling, event-distance, carry-over and densify operators.

Frames count observed rows (not calendar days) and end before the current row. Windows run per
(store, product) or per store-day table, where a partition has about one row per calendar day:
hot stores, products or barcodes were already summed to days before any window sees them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from demandloom.operators.promotions import FAN_OUT
from demandloom.sources.staging import stage_lookup

SERIES = ["gln", "gb_id"]
# Product that shops carry over to the next day (fixed value).
CARRYOVER_PRODUCT_ID = "655629783174417F92A38D18897A69EE"
EMA_BLOCK = 32  # rows whose maps are composed one by one; blocks are composed above them
NEVER = 999  # distance to an event that has not happened yet (fixed value)


def _ordered(df: DataFrame, *keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("date", *[c for c in FAN_OUT if c in df.columns])


def _previous(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(-n, -1)


def add_lag_features(df: DataFrame, lag_days: int = 7) -> DataFrame:
    """Mean, sample deviation and promotion count of the previous ``lag_days`` rows of a series."""
    past = _previous(_ordered(df, *SERIES), lag_days)
    promo = F.col("on_promotion").cast("int")
    return df.withColumns(
        {
            f"avg_last_{lag_days}_sales": F.coalesce(F.avg("quantity").over(past), F.lit(0.0)),
            f"std_last_{lag_days}_sales": F.coalesce(F.stddev_samp("quantity").over(past), F.lit(0.0)),
            f"promotion_days_count_last_{lag_days}": F.coalesce(F.sum(promo).over(past), F.lit(0)),
        }
    )


def add_rolling_mean_features(
    df: DataFrame,
    time_window: int = 5,
    add_all_days_mean: bool = True,
    use_ema: bool = False,
    history_only: bool = False,
) -> DataFrame:
    """Mean of the previous rows of the same weekday and of all days, plus a promotion count.

    Rows without history get the mean of the whole series; ``history_only=True`` leaves them
    NULL, so that no future row is used.
    """
    df = df.withColumn("day_of_week", F.date_format("date", "EEEE"))
    weekday = _ordered(df, *SERIES, "day_of_week")
    everyday = _ordered(df, *SERIES)
    promo = F.col("on_promotion").cast("int")
    promo_count = F.coalesce(F.sum(promo).over(_previous(weekday, time_window)), F.lit(0))
    if use_ema:
        df = _previous_ema(df, time_window).withColumn("promotion_days_count_rolling", promo_count)
    else:
        df = df.withColumns(
            {
                "rolling_mean": F.avg("quantity").over(_previous(weekday, time_window)),
                "promotion_days_count_rolling": promo_count,
                "rolling_mean_all": F.avg("quantity").over(_previous(everyday, time_window)),
            }
        )
    if not add_all_days_mean:
        df = df.drop("rolling_mean_all")
    if history_only:
        return df
    series_mean = F.avg("quantity").over(Window.partitionBy(*SERIES))
    filled = [c for c in ("rolling_mean", "rolling_mean_all") if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c), series_mean) for c in filled})


def _previous_ema(df: DataFrame, span: int) -> DataFrame:
    # the series columns come first: their exchange also serves the windows per weekday
    df = exponential_mean_before(df, SERIES, "rolling_mean_all", span)
    return exponential_mean_before(df, [*SERIES, "day_of_week"], "rolling_mean", span)


def exponential_mean_before(
    df: DataFrame, keys: list[str], name: str, span: int, value: str = "quantity", block: int = EMA_BLOCK
) -> DataFrame:
    """Exponential mean of the rows before the current one, as a scan of affine maps.

    A row takes the mean m to a * m + b. Maps compose, so a block of ``block`` rows is one map
    too: the state before a row is the map of the earlier rows of its block applied to the state
    that the maps of the earlier blocks lead to. A row folds at most ``block`` maps, a block one
    map per earlier block.

    The first known value starts the mean (NULL before it). A missing value keeps the mean and
    makes it older: the next value weighs as much more as one more step would have given it.
    """
    weight = 2.0 / (span + 1)
    window = _ordered(df, *keys)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.withColumn("_x", x).withColumn("_n", F.row_number().over(window) - 1)
    rows = rows.withColumn("_seen", F.max(F.when(F.col("_x").isNotNull(), F.col("_n"))).over(earlier))
    old = F.pow(F.lit(1.0 - weight), F.col("_n") - F.col("_seen"))
    a = F.when(F.col("_seen").isNull(), F.lit(0.0)).otherwise(old / (old + weight))
    step = F.struct(a.alias("a"), ((F.lit(1.0) - a) * F.col("_x")).alias("b"))
    rows = rows.withColumns(
        {"_step": F.when(F.col("_x").isNotNull(), step), "_block": F.floor(F.col("_n") / block)}
    )
    here = Window.partitionBy(*keys, "_block").orderBy("_n")
    rows = rows.withColumn("_maps", F.collect_list("_step").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    last = F.col("_n") % block == block - 1
    with_own = F.concat("_maps", F.array_compact(F.array("_step")))
    rows = rows.withColumn("_whole", F.when(last, _composed(with_own)))
    entry = F.when(F.col("_n") % block == 0, _composed(F.collect_list("_whole").over(earlier))["b"])
    rows = rows.withColumn("_entry", entry)
    entry = F.max("_entry").over(here.rowsBetween(Window.unboundedPreceding, 0))
    inner = _composed(F.col("_maps"))
    mean = F.when(F.col("_seen").isNotNull(), inner["a"] * entry + inner["b"])
    helpers = ["_x", "_n", "_seen", "_step", "_block", "_maps", "_whole", "_entry"]
    return rows.withColumn(name, mean).drop(*helpers)


def _composed(maps: Column) -> Column:
    """One affine map for a list of them, applied from first to last."""
    identity = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(
        maps, identity, lambda m, n: F.struct((m["a"] * n["a"]).alias("a"), (n["a"] * m["b"] + n["b"]).alias("b"))
    )


def add_days_since_events(store_daily: DataFrame) -> DataFrame:
    """Distance in rows of each store to its last markdown and last promotion day."""
    window = Window.partitionBy("gln").orderBy("date")
    numbered = store_daily.withColumn("_row", F.row_number().over(window))
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)

    def since(flag: Column) -> Column:
        last = F.max(F.when(flag, F.col("_row"))).over(so_far)
        return F.coalesce(F.col("_row") - last, F.lit(NEVER))

    return numbered.withColumns(
        {
            "days_since_last_kronemarked": since(F.col("kronemarked").cast("boolean")),
            "days_since_last_promotion": since(F.col("on_promotion") > 0),
        }
    ).drop("_row")


def add_store_temporal_features(store_daily: DataFrame) -> DataFrame:
    """Lags, rolling mean and deviation and event distances of the store totals."""
    window = Window.partitionBy("gln").orderBy("date")
    columns = {
        "sales_lag_1": F.lag("quantity", 1).over(window),
        "sales_lag_7": F.lag("quantity", 7).over(window),
    }
    for n in (7, 30):
        past = _previous(window, n)
        columns[f"rolling_mean_{n}"] = F.avg("quantity").over(past)
        columns[f"rolling_std_{n}"] = F.stddev_samp("quantity").over(past)
    filled = {name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in columns.items()}
    return store_daily.withColumns(filled).transform(add_days_since_events)


def carryover_summary(product_id: str | int, id_type: T.DataType) -> dict[str, Column]:
    """Aggregates per store-day that tell which product follows the carry-over product."""
    target = F.lit(product_id).cast(id_type)
    return {
        "first_id": F.min("gb_id"),
        "next_id": F.min(F.when(F.col("gb_id") > target, F.col("gb_id"))),
        "target_qty": F.max(F.when(F.col("gb_id") == target, F.col("quantity"))),
    }


def with_yesterday(days: DataFrame) -> DataFrame:
    """Carry the quantity over to the next observed day where nothing follows it in its own day."""
    carried = F.when(F.col("next_id").isNull(), F.col("target_qty"))
    by_day = Window.partitionBy("gln").orderBy("date")
    return days.withColumn("from_yesterday", F.lag(carried).over(by_day))


def carryover_value(df: DataFrame, product_id: str | int) -> Column:
    """``gb_id_previous_day`` of rows joined with the store-day summary."""
    first = F.lit(True)  # rows that overlapping intervals made out of one sales row follow each other
    for seq in [c for c in FAN_OUT if c in df.columns]:
        first = first & (F.col(seq) <= 1)
    is_target = F.col("gb_id") == F.lit(product_id).cast(df.schema["gb_id"].dataType)
    follows = (
        F.when(~first & is_target, F.col("target_qty"))
        .when(first & (F.col("gb_id") == F.col("next_id")) & F.col("target_qty").isNotNull(), F.col("target_qty"))
        .when(first & (F.col("gb_id") == F.col("first_id")), F.col("from_yesterday"))
    )
    return F.coalesce(follows, F.lit(0))


CARRYOVER_HELPERS = ["first_id", "next_id", "target_qty", "from_yesterday"]


def add_carryover_previous_row(df: DataFrame, product_id: str | int = CARRYOVER_PRODUCT_ID) -> DataFrame:
    """Quantity of the carry-over product if it is the previous row of the store, else 0.

    Rows of a store are ordered by (date, product). Instead of a window over all rows of a
    store, one summary row per store-day tells which product follows the carry-over product.
    """
    summary = {n: c.alias(n) for n, c in carryover_summary(product_id, df.schema["gb_id"].dataType).items()}
    days = df.groupBy("gln", "date").agg(*summary.values()).transform(with_yesterday)
    joined = df.join(stage_lookup(days, "carryover"), ["gln", "date"], "left")
    return joined.withColumn("gb_id_previous_day", carryover_value(df, product_id)).drop(*CARRYOVER_HELPERS)


def add_carryover_previous_day(df: DataFrame, product_id: str | int = CARRYOVER_PRODUCT_ID) -> DataFrame:
    """Quantity the carry-over product sold in the store on the calendar day before, else 0."""
    yesterday = (
        df.filter(F.col("gb_id").cast("string") == str(product_id))
        .groupBy("gln", F.date_add("date", 1).alias("date"))
        .agg(F.max("quantity").alias("gb_id_previous_day"))
    )
    return df.join(stage_lookup(yesterday, "carryover_day"), ["gln", "date"], "left").fillna(
        0, subset=["gb_id_previous_day"]
    )


def _each_day_until_next(series: DataFrame) -> DataFrame:
    """Repeat each observed row for the missing days after it (``day``); one shuffle, no join."""
    following = F.lead("date").over(Window.partitionBy("item_id").orderBy("date"))
    last = F.coalesce(F.date_sub("next_date", 1), F.col("date"))
    return (
        series.withColumn("next_date", following)
        .withColumn("day", F.explode(F.sequence(F.col("date"), last)))
        .drop("next_date")
    )


def densify_ffill(series: DataFrame) -> DataFrame:
    """One row per day from first to last date of a series; gaps repeat the last known values."""
    so_far = Window.partitionBy("item_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    values = [c for c in series.columns if c not in ("item_id", "date")]
    known = series.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in values})
    return _each_day_until_next(known).drop("date").withColumnRenamed("day", "date").select(series.columns)


def densify_zero(series: DataFrame) -> DataFrame:
    """One row per day from first to last date of a series; gaps are 0."""
    values = [c for c in series.columns if c not in ("item_id", "date")]
    observed = F.col("day") == F.col("date")
    return (
        _each_day_until_next(series)
        .withColumns({c: F.when(observed, F.col(c)).otherwise(F.lit(0)) for c in values})
        .drop("date")
        .withColumnRenamed("day", "date")
        .select(series.columns)
    )
