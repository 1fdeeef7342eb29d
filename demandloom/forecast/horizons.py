"""Forecast origins: covariate frames, backtests of any forecaster, conformal quantiles.

An origin is the first day of a forecast; whoever forecasts there knows the days before it, and of
the days from it on only what was planned: the covariates. Origins stand ``step`` days apart, counted
back from the day after a series' last one.

The frame has one row per series, origin and horizon day: the ``N_LAGS`` values before the origin and
the covariates of the target day. Each day of a series is dealt to the origins that see it as a lag
and to those that see it as a target; lags are put together by one aggregate and meet the targets in
an equi-join on (series, origin). No range join, no ordered pass, no row before its origin.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.operators.calendar_dim import future_covariates
from demandloom.operators.guards import assert_known_at_horizon
from demandloom.operators.metrics import error_metrics
from demandloom.operators.quantiles import exact_quantiles
from demandloom.sources.staging import stage, stage_lookup

N_LAGS = 7
LAGS = [f"lag_{i}" for i in range(1, N_LAGS + 1)]
PRODUCT_QUANTILES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]  # fixed values

Forecaster = Callable[[DataFrame, int], DataFrame]


def origin_states(dense: DataFrame, step: int = 1) -> DataFrame:
    """(item_id, origin, lag_1..): the values before each origin, the day after the last one included.

    A lag before the series began is NULL.
    """
    last = F.max("date").over(Window.partitionBy("item_id"))  # a series is as long as the calendar
    days = dense.select("item_id", "date", F.col("target").cast("double").alias("target"), last.alias("last_date"))
    first = F.pmod(F.datediff("last_date", "date"), F.lit(step)) + 1  # days to the next origin
    seen = days.withColumn("lag", F.explode(F.sequence(first, F.greatest(first, F.lit(N_LAGS)), F.lit(step))))
    values = [F.max(F.when(F.col("lag") == i, F.col("target"))).alias(c) for i, c in enumerate(LAGS, 1)]
    within = seen.filter(F.col("lag") <= N_LAGS).withColumn("origin", F.date_add("date", F.col("lag")))
    return within.groupBy("item_id", "origin").agg(*values, F.max("last_date").alias("last_date")).filter(
        F.col("origin") <= F.date_add("last_date", 1)
    )


def covariate_frame(
    dense: DataFrame,
    covariates: Iterable[str] = (),
    horizon: int = 7,
    step: int | None = None,
    known: DataFrame | None = None,
    known_future: Iterable[str] | None = None,
) -> DataFrame:
    """(item_id, origin, horizon, date, y_true, lags, covariates) of every origin.

    ``dense``: (item_id, date, target, covariates), one row a day. ``known``: covariates of days after a
    series' end, by default the calendar with all other covariates 0; there ``y_true`` is NULL. A
    covariate that is neither history nor in ``known_future`` fails the job. Origins less than
    ``N_LAGS`` days after the start of a series are left out, unless the forecast itself starts there:
    then the mean of the lags there are stands for the others (0 without any).
    """
    covariates, step = list(covariates), step or horizon
    assert_known_at_horizon([*covariates, *LAGS], known_future, "covariate frame")
    states = origin_states(dense, step)
    last = F.max("date").over(Window.partitionBy("item_id"))
    seen = dense.select("item_id", "date", F.col("target").cast("double").alias("y_true"), *covariates, last.alias("last_date"))
    first = F.pmod(-F.datediff("last_date", "date") - 1, F.lit(step)) + 1  # horizon day seen from the latest origin
    targets = (
        seen.withColumn("horizon", F.explode(F.sequence(first, F.greatest(first, F.lit(horizon)), F.lit(step))))
        .filter(F.col("horizon") <= horizon)
        .withColumn("origin", F.date_sub("date", F.col("horizon") - 1))
    )
    ahead = future_covariates(dense, horizon, tuple(covariates)) if known is None else known
    ends = dense.groupBy("item_id").agg(F.date_add(F.max("date"), 1).alias("origin"))
    future = (
        ahead.select("item_id", "date", *covariates).join(ends, "item_id")
        .withColumn("horizon", F.datediff("date", "origin") + 1)
        .filter(F.col("horizon").between(1, horizon))
        .withColumn("y_true", F.lit(None).cast("double"))
    )
    keys = ["item_id", "origin", "horizon", "date", "y_true"]
    rows = targets.select(*keys, *covariates).unionByName(future.select(*keys, *covariates))
    present = F.filter(F.array(*LAGS), lambda x: x.isNotNull())
    mean = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)).otherwise(0.0)
    starts_here = F.col("origin") > F.col("last_date")
    filled = [F.coalesce(c, F.when(starts_here, mean)).alias(c) for c in LAGS]
    whole = states.filter(starts_here | F.col(LAGS[-1]).isNotNull()).select("item_id", "origin", *filled)
    return rows.join(whole, ["item_id", "origin"]).select(*keys, *LAGS, *covariates)


# --- backtests -----------------------------------------------------------------------


def backtest(
    dense: DataFrame, models: dict[str, Forecaster], horizon: int = 7, origins: int = 4, apart: frozenset[str] = frozenset()
) -> DataFrame:
    """(model, item_id, origin, horizon, date, y_true, y_pred) for the last ``origins`` origins.

    Every model sees the days before an origin and forecasts from there. Models in ``apart`` treat
    each series by itself: they run once over a table with one copy of a series per origin. Others are
    fitted once per origin on the days before it, from one written table. Series that ended before an
    origin are not scored there.
    """
    history = stage(dense.select("item_id", "date", "target"), "backtest_history")
    last: dt.date | None = history.agg(F.max("date")).first()[0]
    days = [last - dt.timedelta(days=horizon * k - 1) for k in range(origins, 0, -1)] if last else []

    def scored(name: str, forecast: DataFrame) -> DataFrame:
        ahead = F.datediff("date", "origin") + 1
        return forecast.select(
            F.lit(name).alias("model"), "item_id", "origin", ahead.cast("int").alias("horizon"), "date", F.col("y_pred").cast("double").alias("y_pred")
        )

    parts = []
    for name, forecast in models.items():
        if name in apart:
            copies = history.withColumn("origin", F.explode(F.array(*[F.lit(d) for d in days]).cast("array<date>")))
            copies = copies.filter(F.col("date") < F.col("origin"))
            named = copies.withColumn("item_id", F.concat_ws("@", "item_id", "origin")).drop("origin")
            found = forecast(named, horizon)
            where = F.substring_index("item_id", "@", -1).cast("date")
            whose = F.expr("substring(item_id, 1, length(item_id) - 11)")  # without @ and the date
            parts.append(scored(name, found.withColumns({"origin": where, "item_id": whose})))
    def fitted(fit: tuple[str, dt.date]) -> DataFrame:
        name, day = fit
        return scored(name, models[name](history.filter(F.col("date") < F.lit(day)), horizon).withColumn("origin", F.lit(day)))

    with ThreadPoolExecutor(4) as pool:  # fits are many small jobs that wait for the driver
        parts += pool.map(fitted, [(name, day) for name in models if name not in apart for day in days])
    if not parts:
        return dense.sparkSession.createDataFrame(
            [], "model string, item_id string, origin date, horizon int, date date, y_true double, y_pred double"
        )
    actual = history.select("item_id", "date", F.col("target").cast("double").alias("y_true"))
    rows = reduce(DataFrame.unionByName, parts).filter(F.col("horizon").between(1, horizon))
    return rows.join(actual, ["item_id", "date"]).select("model", "item_id", "origin", "horizon", "date", "y_true", "y_pred")


def by_model_and_horizon(rows: DataFrame) -> DataFrame:
    """One row per model and horizon day."""
    return error_metrics(rows, by=("model", "horizon")).withColumn("wape", F.col("wmape") / 100)


# --- conformal quantiles -------------------------------------------------------------


def residual_spread(rows: DataFrame, probabilities: Iterable[float]) -> DataFrame:
    """(model, level, horizon, probability, quantile): quantiles of truth minus forecast."""
    residual = F.col("y_true") - F.col("y_pred")
    return exact_quantiles(
        rows.select("model", "level", "horizon", residual.alias("residual")), "residual", list(probabilities), by=("model", "level", "horizon")
    )


def conformal_quantiles(rows: DataFrame, probabilities: dict[str, list[float]], level: Column) -> DataFrame:
    """Split-conformal quantiles of every model, and how they fare on origins they have not seen.

    ``rows``: as from ``backtest``. The residuals of all origins but the latest give the quantiles of
    each (model, level, horizon); forecast plus quantile is then compared with the truth of the latest
    origin: ``coverage`` is the share of truths at or below, ``pinball`` the mean quantile loss.
    ``probabilities``: per value of ``level``.
    """
    staged = stage(rows.withColumn("level", level), "backtest_rows")
    latest = staged.agg(F.max("origin")).scalar()
    earlier, held_out = staged.filter(F.col("origin") < latest), staged.filter(F.col("origin") == latest)
    spreads = [residual_spread(earlier.filter(F.col("level") == name), levels) for name, levels in probabilities.items()]
    spread = stage_lookup(reduce(DataFrame.unionByName, spreads), "conformal")  # a row per model, level, horizon, probability
    error = F.col("y_true") - F.col("y_pred") - F.col("quantile")
    loss = F.greatest(F.col("probability") * error, (F.col("probability") - 1) * error)
    return (
        held_out.join(spread, ["model", "level", "horizon"])
        .groupBy("model", "level", "horizon", "probability")
        .agg(
            F.max("quantile").alias("quantile"),
            F.count(F.lit(1)).alias("n"),
            F.avg((error <= 0).cast("double")).alias("coverage"),
            F.avg(loss).alias("pinball"),
        )
    )
