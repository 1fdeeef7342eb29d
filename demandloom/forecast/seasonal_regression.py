"""Additive seasonal model per store: trend, yearly and weekly terms, holiday and regressors.

Fitted by ridge regression from normal equations. Each task sums its rows into a small
(terms x terms) matrix per store; matrices add up in a shuffle aggregate. Store and global
models come from the same sums, so no store and no "all rows" group is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.operators.datasets import normalized_key
from demandloom.operators.guards import assert_no_forbidden_features
from demandloom.sources.staging import stage_lookup

# Regressors used when present (fixed values).
REGRESSORS = ["discount", "on_promotion", "promotion_count", "closed_in_last_3_days", "closed_in_next_4_days"]
GLOBAL_KEY = "__global__"
YEARLY_ORDER, WEEKLY_ORDER = 10, 3
EPOCH_DAY = 10_957  # 2000-01-01 as a day number; centres the trend term
GRAM_SCHEMA = "model_key string, i int, j int, v double, n bigint"


def term_names(regressors: list[str]) -> list[str]:
    yearly = [f"{f}_year_{k}" for k in range(1, YEARLY_ORDER + 1) for f in ("sin", "cos")]
    weekly = [f"{f}_week_{k}" for k in range(1, WEEKLY_ORDER + 1) for f in ("sin", "cos")]
    return ["intercept", "trend", *yearly, *weekly, "is_holiday", *regressors]


def _terms(pdf: pd.DataFrame, regressors: list[str]) -> np.ndarray:
    day = pdf["day"].to_numpy(dtype=float)
    columns = [np.ones(len(pdf)), (day - EPOCH_DAY) / 3652.5]
    for period, order in ((365.25, YEARLY_ORDER), (7.0, WEEKLY_ORDER)):
        for k in range(1, order + 1):
            angle = 2 * np.pi * k * day / period
            columns += [np.sin(angle), np.cos(angle)]
    columns += [pdf[c].fillna(0).to_numpy(dtype=float) for c in ["is_holiday", *regressors]]
    return np.column_stack(columns)


def _inputs(df: DataFrame, regressors: list[str]) -> DataFrame:
    """Model key, day number and regressors; a regressor the table lacks counts as 0."""
    key = normalized_key(df, "gln") if "gln" in df.columns else F.lit(GLOBAL_KEY)
    value = lambda c: (F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c)
    return df.withColumns({"model_key": key, "day": F.unix_date("date")}).select(
        "model_key",
        "day",
        *[c for c in df.columns if c in ("gln", "date", "quantity")],
        *[value(c) for c in ["is_holiday", *regressors]],
    )


def fit_seasonal_regression(df: DataFrame, regressors: list[str] | None = None, ridge: float = 1.0) -> DataFrame:
    """Coefficient table (model_key, n_rows, terms, coefficients): a row per store and a global one."""
    regressors = [c for c in REGRESSORS if c in df.columns] if regressors is None else regressors
    assert_no_forbidden_features(regressors, "prophet_total", "seasonal_regression")
    names = term_names(regressors)
    size = len(names) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(size)
        sums: dict[str, list] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for key, (gram, n) in sums.items():
                yield pd.DataFrame({"model_key": key, "i": upper[0], "j": upper[1], "v": gram[upper], "n": n})
            sums.clear()

        for pdf in batches:
            for key, part in pdf.groupby("model_key"):
                x = np.column_stack([_terms(part, regressors), part["quantity"].to_numpy(dtype=float)])
                total = sums.setdefault(key, [np.zeros((size, size)), 0])
                total[0] += x.T @ x
                total[1] += len(part)
            if len(sums) > 512:  # bounds task memory; the shuffle aggregate adds the pieces up
                yield from flush()
        yield from flush()

    clean = _inputs(df, regressors).filter(F.col("model_key").isNotNull() & F.col("quantity").isNotNull())
    if "gln" in df.columns:  # a store has one row per day, so a hash partition holds whole stores
        clean = clean.repartition("model_key")
    grams = clean.mapInPandas(partial, GRAM_SCHEMA).groupBy("model_key", "i", "j").agg(
        F.sum("v").alias("v"), F.sum("n").alias("n")
    )
    if "gln" in df.columns:
        total = grams.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        grams = grams.unionByName(total.withColumn("model_key", F.lit(GLOBAL_KEY)))

    def solve(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        gram = np.zeros((size, size))
        gram[cells["i"], cells["j"]] = cells["v"]
        gram = gram + np.triu(gram, 1).T
        penalty = np.full(size - 1, ridge)
        penalty[0] = 0.0  # the intercept is free
        beta = np.linalg.lstsq(gram[:-1, :-1] + np.diag(penalty), gram[:-1, -1], rcond=None)[0]
        return pd.DataFrame(
            {"model_key": [key[0]], "n_rows": [int(cells["n"].iloc[0])], "terms": [names], "coefficients": [beta.tolist()]}
        )

    return grams.groupBy("model_key").applyInPandas(
        solve, "model_key string, n_rows bigint, terms array<string>, coefficients array<double>"
    )


def predict_seasonal_regression(df: DataFrame, models: DataFrame, regressors: list[str] | None = None) -> DataFrame:
    """``y_pred`` per row from the model of its store, else the global model, else an error."""
    regressors = [c for c in REGRESSORS if c in df.columns] if regressors is None else regressors
    models = stage_lookup(models, "seasonal_models")
    own = models.select("model_key", F.col("coefficients").alias("own"))
    fallback = models.filter(F.col("model_key") == GLOBAL_KEY).select("coefficients").scalar()
    missing = F.raise_error(F.concat(F.lit("no model for store "), F.col("model_key"))).cast("array<double>")
    coefficients = F.coalesce("own", fallback, missing)
    joined = _inputs(df, regressors).join(own, "model_key", "left").withColumn("beta", coefficients)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            beta = np.vstack(pdf["beta"].to_numpy())
            pred = (_terms(pdf, regressors) * beta).sum(axis=1)
            yield pdf[["model_key", "day", "quantity"]].assign(y_pred=pred)

    return (
        joined.withColumn("quantity", F.col("quantity").cast("double"))
        .mapInPandas(score, "model_key string, day int, quantity double, y_pred double")
        .select(
            F.col("model_key").alias("item_id"),
            F.date_from_unix_date("day").alias("date"),
            F.col("quantity").alias("y_true"),
            "y_pred",
        )
    )
