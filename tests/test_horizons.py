"""Origins, covariate frames, backtests and conformal quantiles against plain Python."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandloom.forecast import horizons, naive, tabular

DAY = dt.date(2001, 3, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def series():
    """Values by (item, day number); one series ends early, one is shorter than the lags."""
    out = {("a", i): float((i * 7 + i // 5) % 23 + 1) for i in range(40)}
    out |= {("b", i): float(i % 7 + 2) for i in range(31)}
    return out | {("c", 35 + i): float(i + 1) for i in range(5)}


@pytest.fixture(scope="module")
def dense(spark, series):
    rows = [(k, day(i), v, i % 2, float(i)) for (k, i), v in series.items()]
    return spark.createDataFrame(rows, "item_id string, date date, target double, on_promotion int, discount double")


@pytest.mark.parametrize("step", [1, 3, 7, 9])
def test_frame_holds_lags_of_the_origin_and_covariates_of_the_target_day(dense, series, step):
    frame = horizons.covariate_frame(dense, ["on_promotion", "discount", "day_of_week_num"][:2], 7, step)
    found = {(r.item_id, r.origin, r.horizon): r for r in frame.collect()}
    assert len(found) == frame.count()
    expected = set()
    for item in "abc":
        days = sorted(i for k, i in series if k == item)
        for origin in range(days[0], days[-1] + 2):
            if (days[-1] + 1 - origin) % step or (origin <= days[-1] and origin - 7 < days[0]):
                continue
            for h in range(1, 8):
                target = origin + h - 1
                if target > days[-1] and origin <= days[-1]:
                    continue
                expected.add((item, day(origin), h))
                row = found[item, day(origin), h]
                assert row.date == day(target) and row.y_true == series.get((item, target))
                lags = [series.get((item, origin - i)) for i in range(1, 8)]
                known = [x for x in lags if x is not None]
                assert [row[c] for c in horizons.LAGS] == pytest.approx([sum(known) / len(known) if x is None else x for x in lags])
                planned = (target % 2, float(target)) if target <= days[-1] else (0, 0.0)
                assert (row.on_promotion, row.discount) == planned
    assert set(found) == expected


def test_plan_of_the_coming_days_is_used(spark, dense):
    plan = spark.createDataFrame([("a", day(40 + i), i, 0.5) for i in range(9)], "item_id string, date date, on_promotion int, discount double")
    frame = horizons.covariate_frame(dense, ["on_promotion", "discount"], 7, known=plan).filter("y_true IS NULL")
    assert sorted((r.horizon, r.on_promotion, r.discount) for r in frame.collect()) == [(i + 1, i, 0.5) for i in range(7)]


def test_unknown_covariates_fail_by_name(dense):
    with pytest.raises(RuntimeError, match="unit_price"):
        horizons.covariate_frame(dense.withColumn("unit_price", F.lit(1.0)), ["unit_price"])
    with pytest.raises(RuntimeError, match="unit_price"):
        tabular.direct_tabular(dense.withColumn("unit_price", F.lit(1.0)), covariates=["unit_price"])
    assert horizons.covariate_frame(dense.withColumn("price_plan", F.lit(1.0)), ["price_plan"], known_future=["price_plan"]).count()


def test_tabular_models_follow_a_covariate(spark):
    """The target is 100 on promoted days and 10 on others, in no weekly order: only the plan tells."""
    promoted = lambda i: int(i * i % 11 in (1, 4, 5))
    rows = [(k, day(i), 100.0 if promoted(i) else 10.0, promoted(i)) for k in "ab" for i in range(120)]
    dense = spark.createDataFrame(rows, "item_id string, date date, target double, on_promotion int")
    plan = spark.createDataFrame([(k, day(120 + i), promoted(120 + i)) for k in "ab" for i in range(7)], "item_id string, date date, on_promotion int")
    for model in (tabular.direct_tabular, tabular.recursive_tabular):
        found = model(dense, 3, covariates=["on_promotion"], known=plan, maxIter=8, maxDepth=3).collect()
        assert len(found) == 6
        for r in found:
            assert abs(r.y_pred - (100 if promoted((r.date - DAY).days) else 10)) < 25


def last_value(table, horizon):
    """Forecast of every series: its last value."""
    ends = table.groupBy("item_id").agg(F.max("date").alias("last"), F.max_by("target", "date").alias("y_pred"))
    days = ends.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return days.select("item_id", F.date_add("last", F.col("horizon")).alias("date"), "horizon", "y_pred")


def test_backtest_sees_only_days_before_the_origin(dense, series):
    models = {"together": last_value, "apart": last_value}
    rows = horizons.backtest(dense, models, 7, 3, apart=frozenset({"apart"})).collect()
    expected = set()
    for origin in (19, 26, 33):
        for (item, i), v in series.items():
            before = [j for k, j in series if k == item and j < origin]
            if origin <= i < origin + 7 and before and max(before) + i - origin + 1 == i:
                expected.add((item, day(origin), i - origin + 1, day(i), v, series[item, origin - 1]))
    for name in models:
        found = {(r.item_id, r.origin, r.horizon, r.date, r.y_true, r.y_pred) for r in rows if r.model == name}
        ended = {x for x in found if x[0] == "b" and x[1] == day(33)}  # ended on day 30: forecasts reach day 37
        assert found - ended == expected and not ended
    scores = horizons.by_model_and_horizon(horizons.backtest(dense, models, 7, 3, apart=frozenset({"apart"}))).collect()
    assert sorted((r.model, r.horizon) for r in scores) == [(m, h) for m in ("apart", "together") for h in range(1, 8)]


def test_backtest_of_an_empty_table(dense):
    assert horizons.backtest(dense.filter("false"), {"naive": naive.seasonal_naive}, apart=frozenset({"naive"})).collect() == []


def test_conformal_quantiles_cover_the_held_out_origin(spark):
    """Residuals of 0..100 in the earlier origins; the held-out origin has 0..9."""
    rows = [("m", "x", day(0), 1, day(0), float(i), 0.0) for i in range(101)]
    rows += [("m", "x", day(7), 1, day(7), float(i), 0.0) for i in range(10)]
    table = spark.createDataFrame(rows, "model string, item_id string, origin date, horizon int, date date, y_true double, y_pred double")
    found = horizons.conformal_quantiles(table, {"all": [0.05, 0.5]}, F.lit("all")).collect()
    by = {r.probability: r for r in found}
    assert by[0.05].quantile == 5.0 and by[0.5].quantile == 50.0
    assert (by[0.05].n, by[0.05].coverage, by[0.5].coverage) == (10, 0.6, 1.0)
    loss = lambda p, q: sum(max(p * (i - q), (p - 1) * (i - q)) for i in range(10)) / 10
    assert by[0.05].pinball == pytest.approx(loss(0.05, 5.0)) and by[0.5].pinball == pytest.approx(loss(0.5, 50.0))
