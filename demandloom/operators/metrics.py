"""Forecast error metrics and the tables behind the residual plots."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions.normal import normal_quantile
from demandloom.operators.quantiles import exact_quantiles, value_ranks
from demandloom.sources.staging import stage

EPSILON = sys.float_info.epsilon
SHARE_WEIGHT_FLOOR = 0.05  # smallest weight in the share error (fixed value)
VOLUME_LABELS = ["low", "mid-low", "mid-high", "high"]


def _paired(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.withColumns({"_y": F.col(truth).cast("double"), "_p": F.col(pred).cast("double")})


def error_metrics(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by: tuple[str, ...] = ()) -> DataFrame:
    """MSE, MAE, R2, MAPE, RMSLE and WMAPE in one aggregate.

    MAPE divides by max(truth, machine epsilon) as its users expect, so one zero truth makes
    it huge; ``mape_nonzero`` leaves such rows out.
    """
    y, p = F.col("_y"), F.col("_p")
    error = y - p
    floored = lambda c: F.log1p(F.greatest(c, F.lit(0.0)))
    relative = F.abs(error / F.greatest(y, F.lit(EPSILON)))
    spread = F.var_pop(y) * F.count(y)
    grouped = _paired(df, truth, pred).groupBy(*by)
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), spread)).alias("r2"),
        (F.avg(relative) * 100).alias("mape"),
        (F.avg(F.when(y > 0, relative)) * 100).alias("mape_nonzero"),
        F.sqrt(F.avg(F.pow(floored(p) - floored(y), 2))).alias("rmsle"),
        (F.try_divide(F.sum(F.abs(error)), F.sum(y)) * 100).alias("wmape"),
    )


def wape(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by: tuple[str, ...] = ()) -> DataFrame:
    error = F.sum(F.abs(F.col("_y") - F.col("_p")))
    return _paired(df, truth, pred).groupBy(*by).agg(F.try_divide(error, F.sum(F.abs("_y"))).alias("wape"))


def weighted_mae(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Absolute error weighted by the truth, floored so that small shares count too."""
    weight = F.greatest(F.col("_y"), F.lit(SHARE_WEIGHT_FLOOR))
    error = F.abs(F.col("_y") - F.col("_p"))
    return (
        _paired(df, truth, pred)
        .groupBy(*by)
        .agg(F.try_divide(F.sum(weight * error), F.sum(weight)).alias("weighted_mae"))
    )


def wape_by_volume(evaluation: DataFrame, truth: str = "y_true", pred: str = "y_pred", labels=None) -> DataFrame:
    """WAPE by quartile of the series mean; quartile edges are taken over rows.

    Each series is first summed to one row (rows, mean, error), so edges weigh a series by
    its row count instead of sorting all rows. Duplicate edges merge their buckets.
    """
    labels = labels or VOLUME_LABELS
    y, p = F.col("_y"), F.col("_p")
    series = stage(
        _paired(evaluation, truth, pred)
        .groupBy("item_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(y).alias("mean"),
            F.sum(F.abs(y - p)).alias("abs_error"),
            F.sum(F.abs(y)).alias("abs_truth"),
        ),
        "series_volume",
    )
    inner = [i / len(labels) for i in range(1, len(labels))]
    edges = exact_quantiles(series, "mean", inner, weight="n").agg(
        F.sort_array(F.collect_list("quantile")).alias("edges")
    )
    above = F.size(F.filter("edges", lambda e: e < F.col("mean")))
    names = F.array(*[F.lit(name) for name in labels])
    return (
        series.withColumn("edges", edges.scalar())
        .withColumn("volume_bucket", F.get(names, above))
        .groupBy("volume_bucket")
        .agg(
            F.sum("n").alias("n"),
            F.try_divide(F.sum("abs_error"), F.sum("abs_truth")).alias("wape"),
        )
    )


def with_residuals(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Residual and its signed log."""
    residual = F.col(truth) - F.col(pred)
    return df.withColumn("residual", residual).withColumn(
        "log_residual", F.signum("residual") * F.log1p(F.abs("residual"))
    )


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins between the smallest and largest value (last bin closed)."""
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    width = (high - low) / bins
    index = F.least(F.floor(F.try_divide(F.col(value) - low, width)), F.lit(bins - 1))
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.coalesce(index, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_start", low + F.col("bin") * width)
    )


RANKS_AT_ONCE = 65_536


def normal_fit(residuals: DataFrame, value: str = "residual") -> DataFrame:
    """(n, slope, intercept, r): least-squares line of the ordered values over normal order statistics.

    The i-th of n values meets the normal quantile of Filliben's median (i - 0.3175) / (n + 0.365), the first and
    last those of 1 - 0.5^(1/n) and 0.5^(1/n). One distributed row per rank; the copies of a hot value are dealt
    out in pieces of bounded size. Empty input gives n = 0 and NULL, equal values or one value a NULL line.
    """
    ranked = stage(value_ranks(residuals, value), "value_ranks")
    n = F.coalesce(ranked.agg(F.max("last_rank")).scalar(), F.lit(0))
    piece = F.explode(F.sequence("first_rank", "last_rank", F.lit(RANKS_AT_ONCE).cast("bigint")))
    pieces = ranked.select("v", "last_rank", piece.alias("start")).repartition("start")
    ranks = pieces.select("v", F.explode(F.sequence("start", F.least("last_rank", F.col("start") + RANKS_AT_ONCE - 1))).alias("i"))
    end = F.pow(F.lit(0.5), F.lit(1.0) / n)
    middle = (F.col("i") - 0.3175) / (n + 0.365)
    median = F.when(F.col("i") == n, end).when(F.col("i") == 1, 1.0 - end).otherwise(middle)
    paired = ranks.select("v", normal_quantile(median).alias("z"))
    return paired.agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.covar_pop("v", "z"), F.nullif(F.var_pop("z"), F.lit(0.0))).alias("slope"),
        (F.avg("v") - F.try_divide(F.covar_pop("v", "z"), F.nullif(F.var_pop("z"), F.lit(0.0))) * F.avg("z")).alias("intercept"),
        F.try_divide(F.covar_pop("v", "z"), F.nullif(F.stddev_pop("v") * F.stddev_pop("z"), F.lit(0.0))).alias("r"),
    )


def residual_quantiles(residuals: DataFrame, n_points: int = 99, fit: DataFrame | None = None) -> DataFrame:
    """Residual quantiles on an even probability grid, with the normal ordinate of each and, given the row of
    :func:`normal_fit`, the point of the fitted line: what a Q-Q plot shows."""
    grid = [round(i / (n_points + 1), 6) for i in range(1, n_points + 1)]
    points = exact_quantiles(residuals, "residual", grid).withColumn("normal", normal_quantile(F.col("probability")))
    if fit is None:
        return points
    line = stage(fit, "normal_fit")
    return points.withColumn("fitted", line.select("intercept").scalar() + line.select("slope").scalar() * F.col("normal"))


__all__ = [
    "error_metrics",
    "histogram",
    "normal_fit",
    "residual_quantiles",
    "wape",
    "wape_by_volume",
    "weighted_mae",
    "with_residuals",
]
