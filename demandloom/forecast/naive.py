"""Seasonal naive forecasts and what is measured on them: backtest rows, quantiles, leaderboard."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.operators.metrics import wape
from demandloom.operators.quantiles import exact_quantiles
from demandloom.sources.staging import stage, stage_lookup

STORE_QUANTILES = [0.025, 0.05, 0.5, 0.95, 0.975]  # fixed values


def with_seasonal_naive(dense: DataFrame, season: int = 7) -> DataFrame:
    """Add ``y_pred`` = the value ``season`` days earlier. ``dense`` has one row per series and
    day, so this is a row lag in the partitioning the densify step already made."""
    by_item = Window.partitionBy("item_id").orderBy("date")
    return dense.withColumn("y_pred", F.lag("target", season).over(by_item))


def seasonal_naive(dense: DataFrame, horizon: int = 7, season: int = 7) -> DataFrame:
    """Forecast of the ``horizon`` days after the end of each series, always ``horizon`` rows.

    Days of the last season before a series began take the mean of the series.
    """
    ends = dense.groupBy("item_id").agg(F.max("date").alias("last_date"), F.avg("target").alias("mean"))
    days = ends.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(season - 1))))
    days = days.withColumn("date", F.date_sub("last_date", F.col("back")))
    seen = dense.select("item_id", "date", "target")
    cycles = F.explode(F.sequence(F.lit(1), F.lit(-(-horizon // season))))
    return (
        days.join(seen, ["item_id", "date"], "left")
        .withColumn("cycle", cycles)
        .withColumn("date", F.date_add("date", F.col("cycle") * season))
        .withColumn("horizon", F.datediff("date", "last_date"))
        .filter(F.col("horizon") <= horizon)
        .select("item_id", "date", "horizon", F.coalesce("target", "mean").alias("y_pred"))
    )


def backtest_rows(
    dense: DataFrame, horizon: int = 7, origins: int = 90, season: int = 7, last_day: Column | None = None
) -> DataFrame:
    """(item_id, origin, horizon, date, y_true, y_pred) for every origin of the last days.

    An origin is the first forecast day and sees only earlier days. A day is the target of up
    to ``horizon`` origins, so rows are multiplied by at most ``horizon``; no range join.
    ``last_day`` may be a scalar from a written table, so the plan of ``dense`` runs once.
    """
    if horizon > season:
        raise ValueError("the horizon of a seasonal naive backtest is at most one season")
    last = dense.agg(F.max("date")).scalar() if last_day is None else last_day
    return (
        dense.transform(with_seasonal_naive, season)
        .filter(F.col("y_pred").isNotNull() & (F.col("date") > F.date_sub(last, origins)))
        .withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .withColumn("origin", F.date_sub("date", F.col("horizon") - 1))
        .filter(F.col("origin") > F.date_sub(last, origins))
        .select("item_id", "origin", "horizon", "date", F.col("target").alias("y_true"), "y_pred")
    )


def forecast_quantiles(
    forecast: DataFrame, backtest: DataFrame, levels: tuple[float, ...] = tuple(STORE_QUANTILES)
) -> DataFrame:
    """Point forecast plus the backtest residual quantiles of its horizon."""
    residuals = backtest.select("horizon", (F.col("y_true") - F.col("y_pred")).alias("residual"))
    spread = exact_quantiles(residuals, "residual", list(levels), by=("horizon",))
    # one row per horizon day and level
    return forecast.join(stage_lookup(spread, "horizon_quantiles"), "horizon").select(
        "item_id", "date", "horizon", "probability", (F.col("y_pred") + F.col("quantile")).alias("y_quantile")
    )


def holdout_predictions(
    dense: DataFrame, models: dict[str, Callable[[DataFrame, int], DataFrame]], horizon: int = 7
) -> dict[str, DataFrame]:
    """Forecast the last ``horizon`` days of the table with every model, from the days before.

    Truth and forecast meet in an inner join, so a series that ended earlier is not scored.
    """
    history = stage(dense, "history")
    cut = F.date_sub(history.agg(F.max("date")).scalar(), horizon)
    train, truth = history.filter(F.col("date") <= cut), history.filter(F.col("date") > cut)
    actual = truth.select("item_id", "date", F.col("target").alias("y_true"))
    return {name: actual.join(forecast(train, horizon), ["item_id", "date"]) for name, forecast in models.items()}


def leaderboard(predictions: dict[str, DataFrame]) -> DataFrame:
    """WAPE per model, best first; each frame holds (y_true, y_pred)."""
    frames = [
        df.select(F.lit(name).alias("model"), F.col("y_true").cast("double"), F.col("y_pred").cast("double"))
        for name, df in predictions.items()
    ]
    scored = wape(reduce(DataFrame.unionByName, frames), by=("model",))
    return scored.withColumnRenamed("wape", "score").orderBy("score", "model")
