"""Campaign and markdown intervals, and reconciliation of declared with observed discounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.rounding import round_to
from demandloom.sources.staging import broadcast_if_small, stage_lookup

# Orders rows that overlapping campaigns or markdown periods made out of one sales row.
FAN_OUT = ["campaign_seq", "markdown_seq"]


def expand_days(intervals: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """One row per day of each [from_date, to_date]; open or reversed intervals give none.

    ``first``/``last`` clip intervals to the days of interest, so that an open-ended
    interval (to_date 9999-12-31) costs no more days than the data has.
    """
    start = F.col("from_date") if first is None else F.greatest("from_date", first)
    end = F.col("to_date") if last is None else F.least("to_date", last)
    valid = F.col("from_date").isNotNull() & F.col("to_date").isNotNull() & (start <= end)
    return intervals.filter(valid).withColumn("date", F.explode(F.sequence(start, end)))


def campaign_days(campaign: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Daily rows of every campaign with the product and the columns to keep."""
    return expand_days(campaign.filter(F.col("gb_id").isNotNull())).select("gb_id", "date", *keep)


def _clipped(intervals: DataFrame, calendar: DataFrame) -> DataFrame:
    return expand_days(intervals, calendar.agg(F.min("date")).scalar(), calendar.agg(F.max("date")).scalar())


def campaign_interval_join(sales: DataFrame, campaign: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Left join of sales with every campaign that covers the day; overlaps fan rows out.

    The interval condition becomes an equi-join on (gb_id, date): campaigns are small and
    are expanded to days, and a hot product spreads over its dates. ``calendar`` is any table
    with the dates of ``sales`` (default: ``sales``); a cheap one avoids running its plan twice.
    """
    order = Window.partitionBy("gb_id", "date").orderBy(
        "from_date", "to_date", "discount", "standard_price", "campaign_price"
    )
    days = (
        _clipped(campaign, sales if calendar is None else calendar)
        .withColumn("campaign_seq", F.row_number().over(order))
        .select(
            "gb_id",
            "date",
            "campaign_seq",
            F.col("discount").alias("declared_discount"),
            F.col("standard_price").alias("declared_standard_price"),
            F.col("campaign_price").alias("declared_campaign_price"),
        )
    )
    amounts = ["declared_discount", "declared_standard_price", "declared_campaign_price"]
    return (
        sales.join(stage_lookup(days, "campaign_days"), ["gb_id", "date"], "left")
        .withColumn("declared_promotion", F.col("declared_discount").isNotNull())
        .fillna(0.0, subset=amounts)
        .fillna(0, subset=["campaign_seq"])
    )


def markdown_interval_join(sales: DataFrame, periods: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Flag days inside a chain-wide markdown period; overlapping periods fan rows out."""
    order = Window.partitionBy("date").orderBy("from_date", "to_date", "kronemarked")
    days = (
        _clipped(periods, sales if calendar is None else calendar)
        .withColumn("markdown_seq", F.row_number().over(order))
        .select("date", "markdown_seq", "kronemarked")
    )
    return (
        sales.join(stage_lookup(days, "markdown_days"), "date", "left")
        .withColumn("kronemarked", F.coalesce(F.col("kronemarked").cast("boolean"), F.lit(False)))
        .fillna(0, subset=["markdown_seq"])
    )


def add_promotion_features(
    sales: DataFrame,
    campaign: DataFrame,
    periods: DataFrame,
    dedupe: bool = False,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Both interval joins. ``dedupe=True`` keeps one row per sales row where intervals overlap."""
    joined = sales.transform(campaign_interval_join, campaign, calendar).transform(
        markdown_interval_join, periods, calendar
    )
    if dedupe:
        joined = joined.filter((F.col("campaign_seq") <= 1) & (F.col("markdown_seq") <= 1))
    return joined


def reconcile_discount(
    sales: DataFrame,
    tolerance: float = 1e-6,
    conflict_threshold: float = 0.05,
    min_promo_discount: float = 0.01,
) -> tuple[DataFrame, DataFrame]:
    """Merge declared and observed promotions; returns (sales, standard price mismatches)."""
    prices = ["unit_price", "standard_price", "declared_standard_price"]
    df = sales.withColumn("promo_combined", F.col("declared_promotion") | F.col("on_promotion")).withColumns(
        {c: round_to(c, 2) for c in prices}
    )
    differs = F.col("promo_combined") & ~F.col("standard_price").eqNullSafe(F.col("declared_standard_price"))
    mismatch = df.filter(differs).select("gln", "gb_id", "date", "standard_price", "declared_standard_price")

    adopt = differs & (F.col("unit_price") < F.col("declared_standard_price"))
    relative = F.try_divide(F.col("unit_price") - F.col("standard_price"), F.col("standard_price"))
    neither = ~F.col("promo_combined") & ~F.col("on_promotion_recomputed")
    reconciled = (
        df.withColumn(
            "standard_price", F.when(adopt, F.col("declared_standard_price")).otherwise(F.col("standard_price"))
        )
        .withColumn("discount", relative)
        .withColumn("discount", F.when(F.abs("discount") < tolerance, 0.0).otherwise(F.col("discount")))
        .withColumn("on_promotion_recomputed", F.coalesce(F.col("discount") <= -min_promo_discount, F.lit(False)))
        .withColumn("discount", F.when(neither, 0.0).otherwise(F.col("discount")))
        .withColumn(
            "conflict",
            F.coalesce(F.abs(F.col("discount") - F.col("declared_discount")) > conflict_threshold, F.lit(False)),
        )
        .withColumn("discount", round_to("discount", 4))
        .drop("declared_discount", "declared_standard_price", "declared_campaign_price", "declared_promotion")
    )
    return reconciled, mismatch


def prepare_promotion_data(
    sales: DataFrame, campaign: DataFrame, periods: DataFrame, calendar: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    return reconcile_discount(add_promotion_features(sales, campaign, periods, calendar=calendar))


def promoted_rows() -> Column:
    return F.count_if(F.col("on_promotion"))


def add_promotion_count(sales: DataFrame) -> DataFrame:
    """Number of promoted rows per store-day on every row. Counted with partial sums and joined
    back, so a heavy store-day is never gathered as one window partition."""
    counts = sales.groupBy("gln", "date").agg(promoted_rows().alias("promotion_count"))
    return sales.join(stage_lookup(counts, "promotion_count"), ["gln", "date"], "left")


def campaign_discount_consistency(
    campaign: DataFrame, tolerance: float = 0.03
) -> tuple[DataFrame, DataFrame]:
    """(all campaigns with the price-implied discount, those that disagree by more than ``tolerance``)."""
    missing = [c for c in ("standard_price", "campaign_price") if c not in campaign.columns]
    if missing:
        raise ValueError(f"campaign columns not found: {missing}")
    numeric = [c for c in ("standard_price", "campaign_price", "discount") if c in campaign.columns]
    compared = campaign.withColumns({c: F.col(c).cast("string").try_cast("double") for c in numeric})
    implied = -(F.lit(1.0) - F.try_divide(F.col("campaign_price"), F.nullif("standard_price", F.lit(0.0))))
    compared = compared.withColumn("discount_implied", implied)
    if "discount" in numeric:
        gap = F.abs(F.col("discount") - F.col("discount_implied"))
    else:
        gap = F.lit(None).cast("double")
    compared = compared.withColumn("discount_diff_abs", gap)
    return compared, compared.filter(F.col("discount_diff_abs") > tolerance)


def campaign_vs_sales(sales: DataFrame, days: DataFrame, flag: str = "on_promotion") -> DataFrame:
    """Rows by (inside a campaign?, observed promotion flag); overlapping campaigns count each."""
    declared = days.select("gb_id", "date", F.lit(1).alias("on_campaign"))
    observed = sales if flag in sales.columns else sales.withColumn(flag, F.lit(0))
    return (
        observed.join(broadcast_if_small(declared), ["gb_id", "date"], "left")
        .groupBy(F.coalesce("on_campaign", F.lit(0)).alias("on_campaign"), flag)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.desc("n_rows"), "on_campaign", flag)
    )
