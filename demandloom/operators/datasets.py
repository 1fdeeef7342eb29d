"""Modelling tables at store and product level, encodings, splits, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.operators.calendar_dim import seasonality_columns
from demandloom.operators.guards import assert_columns_exist, assert_no_forbidden_features
from demandloom.operators.windows import add_store_temporal_features
from demandloom.sources.staging import stage_lookup

STORE_CALENDAR = ["day_of_week_num", "sin_dow", "cos_dow", "sin_day", "cos_day", "month", "quarter"]

# Columns that must not reach a product model (fixed values).
DROP_ALWAYS = [
    "net_sales",
    "gross_margin",
    "tax_amount",
    "price_error",
    "ref_store_price",
    "ref_global_price",
    "fallback_price",
    "ref_price",
    "price_corrected_flag",
    "price_correction_source",
]
DROP_TEXT = ["day_of_week", "last_holiday_type", "next_holiday_type"]

# Columns outside the features, and the label, by model type (fixed values).
NOT_FEATURES = {
    "xgb_total": ["date", "gln", "gb_id", "keep", "year_month", "quantity"],
    "xgb_share": ["date", "gln", "gb_id", "quantity", "store_total", "target"],
    "xgb_direct": ["date", "gln", "gb_id", "store_total", "quantity", "target"],
}
LABELS = {"xgb_total": "quantity", "xgb_share": "target", "xgb_direct": "quantity"}

# kept -> dropped, where both are present (fixed values)
COLLINEAR = {"promo_combined": "on_promotion", "month": "quarter", "rolling_mean_7": "rolling_mean_30"}


def aggregate_to_store_daily(sales: DataFrame) -> DataFrame:
    """Store totals and mean signals per day. Calendar columns follow from the date."""
    share_of = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    daily = sales.groupBy("gln", "date").agg(
        F.sum("quantity").alias("quantity"),
        F.avg("unit_price").alias("unit_price"),
        F.coalesce(F.avg("discount"), F.lit(0.0)).alias("discount"),
        share_of("on_promotion"),
        F.max(F.col("kronemarked").cast("int")).alias("kronemarked"),
        share_of("promo_combined"),
        F.coalesce(F.avg("promotion_count"), F.lit(0.0)).alias("promotion_count"),
        F.max("closed_in_last_3_days").alias("closed_in_last_3_days"),
        F.max("closed_in_next_4_days").alias("closed_in_next_4_days"),
        F.max(F.col("is_holiday").cast("int")).alias("is_holiday"),
        F.coalesce(F.min("days_to_nearest_holiday"), F.lit(0)).alias("days_to_nearest_holiday"),
    )
    calendar = seasonality_columns()
    return daily.withColumns({c: calendar[c] for c in STORE_CALENDAR})


def total_dataset(sales: DataFrame) -> DataFrame:
    store = sales.transform(aggregate_to_store_daily).transform(add_store_temporal_features)
    assert_columns_exist(store.columns, ["gln", "date", "quantity"], "total_dataset")
    return store


def _store_day_stats(sales: DataFrame, with_total: bool) -> DataFrame:
    stats = [
        F.avg("discount").alias("store_mean_discount"),
        F.avg("corrected_unit_price").alias("store_mean_price"),
        F.avg(F.col("on_promotion").cast("double")).alias("store_promo_rate"),
    ]
    if with_total:
        stats.append(F.sum("quantity").alias("store_total"))
    return sales.groupBy("gln", "date").agg(*stats)


def share_target(quantity: str = "quantity", total: str = "store_total") -> Column:
    return F.greatest(F.try_divide(F.col(quantity), F.col(total)), F.lit(0.0))


def relative_feature_columns() -> dict[str, Column]:
    return {
        "discount_relative": F.col("discount") - F.col("store_mean_discount"),
        "price_relative": (F.col("corrected_unit_price") - F.col("store_mean_price"))
        / (F.col("store_mean_price") + 1e-6),
        "promo_boost": F.col("on_promotion").cast("int") * F.col("discount"),
    }


def product_dataset(sales: DataFrame, target: str = "share") -> DataFrame:
    """Product rows with relative features and the share or quantity target.

    Store-day statistics are aggregated once (map-side sums) and joined back: a heavy
    store-day is never one window partition. The store total is used for the share target
    and is not part of the direct table.
    """
    assert_columns_exist(sales.columns, ["gln", "gb_id", "date", "quantity"], "product_dataset")
    if target not in ("share", "quantity"):
        raise ValueError(f"target must be share or quantity, not {target}")
    share = target == "share"
    stats = stage_lookup(_store_day_stats(sales, with_total=share), "store_day_stats")
    df = sales.join(stats, ["gln", "date"], "left")
    if share:
        df = df.filter(F.col("store_total") > 0).withColumn("target", share_target())
    else:
        df = df.withColumn("target", F.col("quantity").cast("double"))
    df = df.withColumns(relative_feature_columns()).drop(*DROP_ALWAYS, *DROP_TEXT)
    if not share and "store_total" in df.columns:
        raise RuntimeError("store_total must not reach the direct model")
    assert_columns_exist(df.columns, ["target", "gln", "gb_id", "date", "quantity"], f"product_dataset:{target}")
    return df


def normalize_shares(df: DataFrame, share: str = "pred_share") -> DataFrame:
    """Scale the shares of a store-day to sum to 1."""
    totals = df.groupBy("gln", "date").agg(F.sum(share).alias("_share_total"))
    scaled = F.try_divide(F.col(share), F.col("_share_total"))
    return (
        df.join(stage_lookup(totals, "share_totals"), ["gln", "date"], "left")
        .withColumn(share, scaled)
        .drop("_share_total")
    )


def reconcile(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """Product quantity = predicted share x predicted store total."""
    return shares.join(totals.select("gln", "date", "pred_total"), ["gln", "date"], "left").withColumn(
        "pred_quantity", F.col("pred_share") * F.col("pred_total")
    )


def select_features(df: DataFrame, model_type: str) -> tuple[list[str], str]:
    """(feature columns, label column) of a model type; the label is never a feature."""
    if model_type not in LABELS:
        raise ValueError(f"model type must be one of {sorted(LABELS)}, not {model_type}")
    label = LABELS[model_type]
    assert_columns_exist(df.columns, [label], f"select_features:{model_type}")
    features = [c for c in df.columns if c not in NOT_FEATURES[model_type]]
    redundant = {drop for keep, drop in COLLINEAR.items() if keep in features}
    features = [c for c in features if c not in redundant]
    assert_no_forbidden_features(features, model_type, "select_features")
    return features, label


# --- target encoding -----------------------------------------------------------------


def detect_column(df: DataFrame, candidates: tuple[str, ...], what: str) -> str:
    for name in candidates:
        if name in df.columns:
            return name
    raise KeyError(f"the table has no {what} column ({', '.join(candidates)})")


def fit_target_encoding(
    train: DataFrame, key: str | None = None, target: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(mean target per key, one-row global mean)."""
    key = key or detect_column(train, ("gln", "store_id", "item_id"), "group")
    target = target or detect_column(train, ("quantity", "target"), "target")
    mapping = train.groupBy(key).agg(F.avg(target).alias("encoded"))
    return mapping, train.agg(F.avg(target).alias("global_mean"))


def apply_target_encoding(
    df: DataFrame, mapping: DataFrame, global_mean: DataFrame, key: str | None = None, name: str = "gln_te"
) -> DataFrame:
    """Mean target of the key; keys unseen in training get the global mean."""
    key = key or detect_column(df, ("gln", "store_id", "item_id"), "group")
    lookup = stage_lookup(mapping.select(key, F.col("encoded").alias(name)), name)
    return df.join(lookup, key, "left").withColumn(name, F.coalesce(F.col(name), global_mean.scalar()))


def encode_store(train: DataFrame, test: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    fitted = fit_target_encoding(train, target=target)
    return apply_target_encoding(train, *fitted), apply_target_encoding(test, *fitted)


def encode_product(train: DataFrame, test: DataFrame, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """Product encoding plus its interaction with the promotion flag."""
    fitted = fit_target_encoding(train, "gb_id", target)
    popularity = F.col("on_promotion").cast("int") * F.col("gb_id_mean_target")
    return tuple(
        apply_target_encoding(df, *fitted, key="gb_id", name="gb_id_mean_target").withColumn(
            "promo_x_popularity", popularity
        )
        for df in (train, test)
    )


# --- splits --------------------------------------------------------------------------


def split_by_time(df: DataFrame, test_start, test_end) -> tuple[DataFrame, DataFrame]:
    """Train before ``test_start``; test from there to ``test_end`` inclusive. Bounds may be
    literals or scalar subqueries; both filters reach the scan."""
    return df.filter(F.col("date") < test_start), df.filter(F.col("date").between(test_start, test_end))


def last_n_start(df: DataFrame, n: int) -> Column:
    """First of the last ``n`` observed dates, as a scalar subquery."""
    last = df.select("date").distinct().orderBy(F.desc("date")).limit(n)
    return last.agg(F.min("date")).scalar()


def split_last_n(df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Test = the last ``n`` observed dates, gaps allowed."""
    start = last_n_start(df, n)
    return df.filter(F.col("date") < start), df.filter(F.col("date") >= start)


def time_folds(df: DataFrame, n_blocks: int = 5) -> DataFrame:
    """(date, fold): distinct dates cut in ``n_blocks`` near-equal blocks in date order.

    Block k validates a model trained on all earlier blocks. The window sees one row per
    calendar day.
    """
    dates = df.select("date").distinct()
    ordered = dates.withColumns(
        {
            "i": F.row_number().over(Window.orderBy("date")) - 1,
            "n": F.count(F.lit(1)).over(Window.partitionBy()),
        }
    )
    size, extra = F.floor(F.col("n") / n_blocks), F.col("n") % n_blocks
    in_long_blocks = F.floor(F.col("i") / (size + 1))
    beyond = extra + F.floor((F.col("i") - extra * (size + 1)) / F.greatest(size, F.lit(1)))
    fold = F.when(F.col("i") < extra * (size + 1), in_long_blocks).otherwise(beyond)
    return ordered.select("date", fold.cast("int").alias("fold"))


# --- series --------------------------------------------------------------------------


def normalize_key(value: Column, dtype: str) -> Column:
    """Integer-like ids as integer text (101.0 -> "101"), NaN as NULL; other text and NULL unchanged."""
    if dtype in ("double", "float"):
        whole = (value == F.rint(value)) & (F.abs(value) < 1e37)
        digits = F.when(whole, value).cast("decimal(38,0)").cast("string")
        return F.when(~F.isnan(value), F.coalesce(digits, value.cast("string")))
    return value.cast("string")


def normalized_key(df: DataFrame, column: str) -> Column:
    return normalize_key(F.col(column), df.schema[column].dataType.simpleString())


def product_series(df: DataFrame, covariates: tuple[str, ...] = ()) -> DataFrame:
    """Long table keyed by product_store."""
    kept = [c for c in covariates if c in df.columns]
    item = F.concat_ws("_", F.col("gb_id").cast("string"), F.col("gln").cast("string"))
    return df.select(item.alias("item_id"), "date", "target", *kept)


# Covariates known at forecast time for store series (fixed values).
CALENDAR_COVARIATES = ["day_of_week_num", "sin_dow", "cos_dow", "month", "quarter", "is_holiday"]
PROMOTION_COVARIATES = ["on_promotion", "discount", "kronemarked", "promo_combined", "promotion_count"]
COVARIATE_SETS = {
    "all": [
        "day_of_week_num",
        "sin_dow",
        "cos_dow",
        "sin_day",
        "cos_day",
        "month",
        "quarter",
        "is_holiday",
        "days_to_nearest_holiday",
        "on_promotion",
        "discount",
        "kronemarked",
        "promo_combined",
        "promotion_count",
        "closed_in_next_4_days",
    ],
    "calendar": CALENDAR_COVARIATES,
    "promotion": PROMOTION_COVARIATES,
    "calendar_promotion": CALENDAR_COVARIATES + PROMOTION_COVARIATES,
    "product_none": [],
    "product_economic": [
        "day_of_week_num",
        "on_promotion",
        "discount",
        "gb_id_mean_target",
        "gln_te",
        "price_relative",
    ],
    "product_calendar": ["day_of_week_num", "month", "is_holiday"],
}


def store_series(
    df: DataFrame, covariates: str | None = "all", expected_series: int | None = None
) -> DataFrame:
    """Daily store series without gaps (gaps repeat the last values), with known covariates.

    ``expected_series`` fails the job when another number of stores is found.
    """
    from demandloom.operators.windows import densify_ffill

    rules = {
        "quantity": F.sum("quantity").cast("double").alias("target"),
        **{c: F.min(c).alias(c) for c in [*STORE_CALENDAR, "is_holiday", "days_to_nearest_holiday"]},
        **{c: F.max(c).alias(c) for c in ["on_promotion", "kronemarked", "promo_combined", "closed_in_next_4_days"]},
        "discount": F.avg("discount").alias("discount"),
        "promotion_count": F.sum("promotion_count").alias("promotion_count"),
    }
    aggregates = [rule for column, rule in rules.items() if column in df.columns]
    item = F.trim(normalized_key(df, "gln")).alias("item_id")
    series = df.groupBy(item, "date").agg(*aggregates)
    if expected_series is not None:
        found = df.agg(F.countDistinct("gln")).scalar()
        message = F.concat(F.lit(f"{expected_series} stores expected, found "), found.cast("string"))
        checked = F.when(found == expected_series, F.col("item_id")).otherwise(F.raise_error(message).cast("string"))
        series = series.withColumn("item_id", checked)
    wanted = [c for c in COVARIATE_SETS[covariates] if c in series.columns] if covariates else []
    return series.select("item_id", "date", "target", *wanted).transform(densify_ffill)


def chain_rollup(evaluation: DataFrame) -> DataFrame:
    """Truth and forecast summed over all series per date."""
    return evaluation.groupBy("date").agg(F.sum("y_true").alias("y_true"), F.sum("y_pred").alias("y_pred"))
