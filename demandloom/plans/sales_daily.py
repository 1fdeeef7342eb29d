"""The job from raw hourly rows to the feature table, and its written stages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from demandloom.operators import calendar_dim, cleaning, pricing, promotions, windows
from demandloom.sources.staging import stage, stage_lookup


def clean_daily(sales_hourly: DataFrame, ean_map: DataFrame) -> DataFrame:
    """Daily rollup, written once: later steps read it several times, by column."""
    mapped = sales_hourly.transform(cleaning.distinct_rows).transform(cleaning.map_products, ean_map)
    return stage(cleaning.daily_rollup(mapped), "daily")


def promoted_daily(daily: DataFrame) -> DataFrame:
    """Promotion state machine and repaired prices.

    The machine reads the raw price, so it runs first: fewer columns travel to Python.
    """
    return daily.transform(pricing.standard_price_and_discount).transform(
        pricing.correct_daily_unit_price, history=daily
    )


def add_features(
    sales: DataFrame, dates: DataFrame, holidays: DataFrame, carryover_product: str | int
) -> DataFrame:
    """Promotion count, lags, rolling means, holidays, carry-over and seasonality."""
    # everything that follows from the date alone is computed once per date
    date_features = calendar_dim.holiday_dim(dates, holidays).transform(calendar_dim.add_seasonality_features)
    # promotion count and carry-over need the same grain: one store-day aggregate serves both
    summary = windows.carryover_summary(carryover_product, sales.schema["gb_id"].dataType)
    store_days = (
        sales.groupBy("gln", "date")
        .agg(promotions.promoted_rows().alias("promotion_count"), *[c.alias(n) for n, c in summary.items()])
        .transform(windows.with_yesterday)
    )
    return (
        sales.join(stage_lookup(store_days, "store_days"), ["gln", "date"], "left")
        .withColumn("gb_id_previous_day", windows.carryover_value(sales, carryover_product))
        .drop(*windows.CARRYOVER_HELPERS)
        .transform(windows.add_lag_features)
        .transform(windows.add_rolling_mean_features)
        .transform(calendar_dim.join_dates, date_features)
        .drop(*promotions.FAN_OUT)
    )


def prepare_sales_data(
    sales_hourly: DataFrame,
    ean_map: DataFrame,
    campaign: DataFrame,
    markdown_periods: DataFrame,
    carryover_product: str | int = windows.CARRYOVER_PRODUCT_ID,
    holidays: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(sales_daily features, standard price mismatches).

    Two tables are written on the way: the daily rollup, and the promotion table after the
    state machine, so neither the raw scan nor the state machine runs twice.
    """
    daily = clean_daily(sales_hourly, ean_map)
    joined = promotions.add_promotion_features(
        promoted_daily(daily), campaign, markdown_periods, calendar=daily
    )
    promoted = stage(joined, "promoted")
    reconciled, mismatch = promotions.reconcile_discount(promoted)
    dates = calendar_dim.distinct_dates(daily)
    holidays = calendar_dim.holidays_for(daily) if holidays is None else holidays
    return add_features(reconciled, dates, holidays, carryover_product), mismatch


def prepare_sales_data_with_diagnostics(
    sales_hourly: DataFrame,
    ean_map: DataFrame,
    campaign: DataFrame,
    markdown_periods: DataFrame,
    carryover_product: str | int = windows.CARRYOVER_PRODUCT_ID,
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """The job's two tables plus the raw rows and both price anomaly tables."""
    features, mismatch = prepare_sales_data(
        sales_hourly, ean_map, campaign, markdown_periods, carryover_product
    )
    _, _, dispersion, suspicious = cleaning.preprocess_sales(sales_hourly, ean_map)
    diagnostics = {
        "sales_hourly": sales_hourly,
        "price_dispersion": dispersion,
        "suspicious_daily_prices": suspicious,
    }
    return features, mismatch, diagnostics
