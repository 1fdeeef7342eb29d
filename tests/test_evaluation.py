"""Quantiles, metrics, profiles, forecasts, models."""

import datetime as dt
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from demandloom.forecast import naive, search, seasonal_regression, smoothing, tabular, trees
from demandloom.operators import metrics, profile, quantiles


@pytest.mark.parametrize("kind", ["normal", "ties", "outlier", "single"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(5)
    data = {
        "normal": rng.normal(0, 10, 3000),
        "ties": rng.integers(-3, 4, 3000).astype(float),
        "outlier": np.concatenate([rng.normal(0, 1, 2000), [1e12, -1e9]]),
        "single": np.array([4.25]),
    }[kind]
    grid = [0.0, 0.025, 0.25, 0.5, 0.9, 0.975, 1.0]
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(data)) % 2, "x": data}))
    for levels in (1, 2):
        out = quantiles.exact_quantiles(df, "x", grid, buckets=16, levels=levels)
        got = [r[1] for r in values(out, "probability", "quantile")]
        assert got == pytest.approx(np.quantile(data, grid).tolist())
    by = quantiles.exact_quantiles(df, "x", grid, by=("g",), buckets=16)
    for g in {int(v) for v in np.arange(len(data)) % 2}:
        got = [r[1] for r in values(by.filter(F.col("g") == g), "probability", "quantile")]
        assert got == pytest.approx(np.quantile(data[np.arange(len(data)) % 2 == g], grid).tolist())


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (0.0, 1.0)], "y_true double, y_pred double")
    row = metrics.error_metrics(df).first()
    assert (row["mse"], row["mae"], row["wmape"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 50.0)
    assert row["mape"] > 1e17 and row["mape_nonzero"] == 50.0
    assert row["r2"] == pytest.approx(1 - 2 / np.var([1, 3, 0]) / 3)
    assert metrics.weighted_mae(df).first()[0] == pytest.approx((1 * 1 + 0.05 * 1) / 4.05)
    assert metrics.wape(df).first()[0] == 0.5


def test_wape_by_volume_merges_duplicate_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 1.0), ("c", 5.0, 4.0)], "item_id string, y_true double, y_pred double")
    got = values(metrics.wape_by_volume(df), "volume_bucket", "n", "wape")
    assert got == [("high", 1, 0.2), ("low", 2, 0.5)]


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 9, 10]], "x double")
    assert values(metrics.histogram(df, "x", 5), "bin", "n") == [(0, 2), (1, 1), (4, 2)]


def test_missingness_and_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, 5.0), (2.0, 4.0, 3.0, 5.0), (3.0, 6.0, float("nan"), 5.0)], "a double, b double, c double, d double")
    assert values(profile.missingness_table(df, 1), "column", "missing_count") == [("c", 2)]
    assert values(profile.high_correlation_pairs(df.select("a", "b", "d")), "feature_a", "feature_b") == [("a", "b")]


def test_correlation_of_many_columns(spark):
    """100 columns with gaps: every pair equals pandas, and the plan names no pair."""
    rng = np.random.default_rng(8)
    data = rng.normal(0, 1, (60, 100)) + 0.5 * rng.normal(0, 1, (60, 1)) + 1e6
    data[rng.random(data.shape) < 0.1] = np.nan
    data[:, 7] = 3.0
    frame = pd.DataFrame(data, columns=[f"c.{i}" for i in range(100)])
    table = profile.correlation_pairs(spark.createDataFrame(frame).repartition(5))
    expected = frame.corr()
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in table.collect()}
    assert len(got) == 100 * 99 // 2
    for (a, b), r in got.items():
        assert r is None if "c.7" in (a, b) else abs(r - expected.loc[a, b]) < 1e-9
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("covar_pop") == 1 and "Python" not in plan


def test_correlation_without_pairs(spark):
    empty = spark.createDataFrame([], "a double, b double, t string")
    assert profile.correlation_pairs(empty).count() == 0
    assert profile.correlation_pairs(empty.select("a")).count() == 0


def test_product_mix_by_day_and_month(rows):
    sales = rows("gln long, gb_id long, date date, quantity long", (1, 1, "2024-01-31", 2), (1, 2, "2024-02-01", 3), (1, 1, "2024-03-05", 9))
    assert len(values(profile.product_mix(sales, "D", "2024-01-31"), "period")) == 2
    assert values(profile.product_mix(sales, month="2024-02"), "period", "gb_id", "quantity") == [("2024-02-01", 2, 3)]
    wide = profile.product_mix_pivot(profile.product_mix(sales), [1, 2])
    assert values(wide, "period", "product_1", "product_2") == [("2024-01", 2, 0), ("2024-02", 0, 3), ("2024-03", 9, 0)]
    with pytest.raises(ValueError):
        profile.product_mix(sales, "D")


def test_anomaly_sample_is_repeatable(rows):
    cases = rows("gln long, gb_id long, date date", *[(i, i % 3, "2024-01-01") for i in range(30)])
    first = values(profile.anomaly_sample(cases, 5), "gln")
    assert first == values(profile.anomaly_sample(cases.repartition(7), 5), "gln") and len(first) == 5


def test_anomaly_sample_of_each_group(rows):
    cases = rows("gln long, gb_id long, date date", *[(i % 4, i, "2024-01-01") for i in range(41)])
    chosen = profile.anomaly_sample(cases.repartition(6), 3, by=("gln",))
    assert {r["gln"]: r["count"] for r in chosen.groupBy("gln").count().collect()} == {0: 3, 1: 3, 2: 3, 3: 3}
    key = lambda i: hashlib.md5(f"42|{i % 4}|{i}|2024-01-01".encode()).hexdigest()
    best = sorted((i for i in range(41) if i % 4 == 2), key=key)[:3]
    assert values(chosen.filter("gln = 2"), "gb_id") == sorted((i,) for i in best)


def test_price_paths(rows):
    cases = rows("gln long, gb_id long, date date, rel_diff double", (1, 1, "2024-01-02", 0.3))
    hourly = rows(
        "gln long, gb_id long, date date, from_hour int, unit_price double",
        (1, 1, "2024-01-02", 8, 10.0), (1, 1, "2024-01-02", 9, 20.0), (1, 1, "2024-01-03", 8, 10.0), (2, 1, "2024-01-02", 8, 1.0),
    )
    paths = profile.dispersion_paths(cases, hourly)
    assert values(paths, "from_hour", "unit_price", "rel_diff") == [(8, 10.0, 0.3), (9, 20.0, 0.3)]
    history = profile.suspicious_paths(cases, hourly, 1)
    assert history.count() == 3 and history.select("case_date").distinct().count() == 1
    assert profile.suspicious_paths(cases.limit(0), hourly, 1).count() == 0


# --- forecasts -----------------------------------------------------------------------


def weekly_series(spark, n=140, noise=0.0, items=("1", "2")):
    rng = random.Random(9)
    start = dt.date(2024, 1, 1)
    shape = [10, 12, 14, 16, 20, 30, 5]
    data = [
        (item, start + dt.timedelta(days=i), shape[i % 7] * (k + 1) + noise * rng.gauss(0, 1))
        for k, item in enumerate(items)
        for i in range(n)
    ]
    return spark.createDataFrame(data, "item_id string, date date, target double")


def test_seasonal_naive_and_backtest(spark):
    dense = weekly_series(spark)
    got = [r[2] for r in values(naive.seasonal_naive(dense).filter("item_id = '1'"), "item_id", "date", "y_pred")]
    assert got == [10, 12, 14, 16, 20, 30, 5]
    rows_ = naive.backtest_rows(dense, origins=10)
    assert rows_.filter(F.col("origin") > F.col("date")).count() == 0
    assert rows_.select("origin").distinct().count() == 10
    assert metrics.wape(rows_).first()[0] == 0.0
    q = naive.forecast_quantiles(naive.seasonal_naive(dense), rows_, (0.1, 0.9))
    assert q.count() == 2 * 7 * 2
    board = naive.leaderboard({"good": rows_, "bad": rows_.withColumn("y_pred", F.lit(0.0))})
    assert [r["model"] for r in board.collect()] == ["good", "bad"]


@pytest.mark.parametrize("model", [smoothing.ets_forecast, smoothing.theta_forecast])
def test_smoothing_follows_the_week(spark, model):
    got = values(model(weekly_series(spark, noise=0.2)).filter("item_id = '1'"), "horizon", "y_pred")
    assert [round(v) for _, v in got] == pytest.approx([10, 12, 14, 16, 20, 30, 5], abs=1.5)


def test_seasonal_regression_recovers_trend_and_falls_back(spark):
    start = dt.date(2020, 1, 1)
    data = [(float(g), start + dt.timedelta(days=i), 50.0 + 0.02 * i + 10 * (i % 7 == 5) + g, 0.1 * (i % 3)) for g in (1, 2) for i in range(900)]
    table = spark.createDataFrame(data, "gln double, date date, quantity double, discount double")
    models = seasonal_regression.fit_seasonal_regression(table)
    assert {r["model_key"]: r["n_rows"] for r in models.collect()} == {"1": 900, "2": 900, "__global__": 1800}
    scored = seasonal_regression.predict_seasonal_regression(table, models)
    assert metrics.error_metrics(scored).first()["mae"] < 1.0
    unseen = table.filter("gln = 1").withColumn("gln", F.lit(77.0))
    assert seasonal_regression.predict_seasonal_regression(unseen, models).count() == 900
    only_stores = models.filter("model_key <> '__global__'")
    with pytest.raises(Exception, match="no model for store"):
        seasonal_regression.predict_seasonal_regression(unseen, only_stores).collect()


def test_tabular_forecasts_have_every_horizon(spark):
    dense = weekly_series(spark, noise=0.5)
    for out in (
        tabular.direct_tabular(dense, horizon=3, maxIter=3, maxDepth=3),
        tabular.recursive_tabular(dense, horizon=3, maxIter=3, maxDepth=3),
    ):
        got = values(out, "item_id", "horizon", "date")
        assert [(r[0], r[1]) for r in got] == [(i, h) for i in ("1", "2") for h in (1, 2, 3)]
        assert got[0][2] == dt.date(2024, 5, 20)


def store_table(spark):
    rng = random.Random(2)
    start = dt.date(2023, 1, 1)
    data = [
        (g, start + dt.timedelta(days=i), 20 + 5 * (i % 7) + g, i % 7, (start + dt.timedelta(days=i)).month, rng.random())
        for g in range(3)
        for i in range(120)
    ]
    return spark.createDataFrame(data, "gln long, date date, quantity long, day_of_week_num int, month int, noise double")


def test_tree_model_roundtrip_cv_and_importance(spark, tmp_path):
    table = store_table(spark)
    model = trees.train(table, "xgb_total", maxIter=5, maxDepth=4)
    trees.save_model(model, str(tmp_path / "model"))
    again = trees.load_model(str(tmp_path / "model"))
    assert trees.feature_names(again) == ["day_of_week_num", "month", "noise"]
    scored = trees.score(again, table, "quantity")
    assert metrics.error_metrics(scored).first()["mae"] < 2.0
    importance = trees.feature_importance(again, spark)
    assert importance.first()["feature"] == "day_of_week_num" and importance.count() == 3
    folds = trees.expanding_folds(table, n_splits=2, test_days=30)
    sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert sizes == {0: 60, 1: 30, 2: 30}
    cv = trees.expanding_cv(table, "xgb_total", folds=folds, maxIter=2, maxDepth=3)
    assert [r["fold"] for r in cv.orderBy("fold").collect()] == [1, 2]
    with pytest.raises(ValueError):
        trees.train(table.withColumn("noise", F.lit(None).cast("double")), "xgb_total")


def test_sampler_is_seeded_and_stays_in_range():
    space = trees.SEARCH_SPACE["gbt"]
    done = []
    for number in range(40):
        trial = search.propose(space, done, number, 3)
        assert trial == search.propose(space, done, number, 3) and set(trial) == set(space)
        for name, bounds in space.items():
            assert bounds[0] <= trial[name] <= bounds[1] and isinstance(trial[name], type(bounds[0]))
        done.append((trial, abs(trial["maxDepth"] - 9) + abs(trial["featureShare"] - 0.8)))
    assert search.propose(space, done, 40, 3) != search.propose(space, done, 40, 4)


def test_sampler_moves_to_the_better_trials():
    """Late trials lie nearer to the optimum than the even ones at the start, on a linear and a log range."""
    space = {"a": (0.0, 1.0), "b": (0.001, 1.0, "log")}
    miss = lambda p: abs(p["a"] - 0.8) + abs(search.to_unit(p["b"], space["b"]) - 0.3)
    early, late = [], []
    for seed in range(8):
        done = []
        for number in range(50):
            trial = search.propose(space, done, number, seed)
            done.append((trial, miss(trial)))
        early += [score for _, score in done[: search.STARTUP]]
        late += [score for _, score in done[-search.STARTUP :]]
    assert np.mean(late) < 0.5 * np.mean(early)


def test_range_units_round_trip():
    assert [search.from_unit(u, (1, 3)) for u in (0.0, 0.34, 0.99, 1.0)] == [1, 2, 3, 3]
    assert abs(search.from_unit(search.to_unit(0.05, (0.01, 0.3, "log")), (0.01, 0.3, "log")) - 0.05) < 1e-12


def test_prefix_of_a_boosted_fit_is_the_smaller_fit(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 3))
    data = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": 3 * x[:, 0] + x[:, 1] ** 2})
    table = spark.createDataFrame(data).coalesce(1)
    settings = {"maxDepth": 3, "subsamplingRate": 0.7, "featureShare": 0.7}
    whole = trees.fit(table, ["a", "b", "c"], "y", maxIter=6, **settings)
    curve = trees.prefix_scores(whole, table, "y")
    assert len(curve) == 6
    for count in (2, 4):
        small = trees.score(trees.fit(table, ["a", "b", "c"], "y", maxIter=count, **settings), table, "y")
        assert abs(metrics.error_metrics(small).first()["mae"] - curve[count - 1]) < 1e-9


# --- normal ordinates -------------------------------------------------------------------


def test_normal_quantile(spark):
    from statistics import NormalDist

    from demandloom.functions.normal import normal_quantile

    grid = [1e-300, 1e-20, 1e-9, 0.01, 0.074, 0.076, 0.3, 0.5, 0.7, 0.924, 0.926, 0.999999, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in grid], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    for p, z in got:
        assert abs(z - NormalDist().inv_cdf(p)) < 1e-9 * max(1, abs(z))
    outside = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "p double").select(normal_quantile(F.col("p")))
    assert {r[0] for r in outside.collect()} == {None}


@pytest.mark.parametrize("blocks", [1, 7, 1024])
def test_value_ranks(spark, blocks):
    rng = random.Random(blocks)
    data = [float(rng.choice([0, 0, 0, rng.randint(-50, 50), rng.random()])) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*data, None, float("nan")]], "x double").repartition(3)
    got = values(quantiles.value_ranks(df, "x", blocks), "v", "w", "first_rank", "last_rank")
    ordered = sorted(data)
    expected = []
    for v in sorted(set(data)):
        first = ordered.index(v) + 1
        expected.append((v, data.count(v), first, first + data.count(v) - 1))
    assert got == expected


def test_normal_fit(spark, monkeypatch):
    """The line over all ranks, a hot value cut in pieces; empty, single and equal values have none."""
    from statistics import NormalDist

    monkeypatch.setattr(metrics, "RANKS_AT_ONCE", 10)
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(3, 2, 150), np.zeros(80)])
    frame = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "residual double")
    row = metrics.normal_fit(frame(data)).first()
    n = len(data)
    medians = [1 - 0.5 ** (1 / n), *[(i - 0.3175) / (n + 0.365) for i in range(2, n)], 0.5 ** (1 / n)]
    z = np.array([NormalDist().inv_cdf(m) for m in medians])
    slope, intercept = np.polyfit(z, np.sort(data), 1)
    assert row["n"] == n and abs(row["slope"] - slope) < 1e-9 and abs(row["intercept"] - intercept) < 1e-9
    assert abs(row["r"] - np.corrcoef(z, np.sort(data))[0, 1]) < 1e-9
    assert tuple(metrics.normal_fit(frame([])).first()) == (0, None, None, None)
    assert tuple(metrics.normal_fit(frame([5.0])).first()) == (1, None, None, None)
    equal = metrics.normal_fit(frame([5.0] * 4)).first()
    assert equal["slope"] == 0 and equal["intercept"] == 5 and equal["r"] is None
