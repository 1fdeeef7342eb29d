"""Windows, datasets, encodings, splits, guards."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from demandloom.operators import datasets, guards, windows

SALES = "gln long, gb_id long, date date, quantity long, on_promotion boolean"


def random_sales(spark, seed=1, days=60):
    rng = random.Random(seed)
    start = dt.date(2024, 1, 1)
    data = [
        (s, p, start + dt.timedelta(days=d), rng.randint(0, 50), rng.random() < 0.3)
        for s in range(2)
        for p in range(3)
        for d in range(days)
        if rng.random() < 0.7
    ]
    return spark.createDataFrame(data, SALES)


def as_pandas(df):
    return df.orderBy("gln", "gb_id", "date").toPandas()


def test_lags_against_array_library(spark):
    sales = random_sales(spark)
    out = as_pandas(windows.add_lag_features(sales))
    shifted = out.groupby(["gln", "gb_id"])["quantity"].shift(1)
    grouped = shifted.groupby([out["gln"], out["gb_id"]])
    mean = grouped.transform(lambda s: s.rolling(7, min_periods=1).mean()).fillna(0)
    std = grouped.transform(lambda s: s.rolling(7, min_periods=1).std()).fillna(0)
    assert np.allclose(out["avg_last_7_sales"], mean)
    assert np.allclose(out["std_last_7_sales"], std)


@pytest.mark.parametrize("ema", [False, True])
def test_rolling_means_against_array_library(spark, ema):
    out = as_pandas(windows.add_rolling_mean_features(random_sales(spark), use_ema=ema))

    def past(s):
        s = s.shift(1)
        return s.ewm(span=5, adjust=False).mean() if ema else s.rolling(5, min_periods=1).mean()

    fallback = out.groupby(["gln", "gb_id"])["quantity"].transform("mean")
    week = out.groupby(["gln", "gb_id", "day_of_week"])["quantity"].transform(past).fillna(fallback)
    every = out.groupby(["gln", "gb_id"])["quantity"].transform(past).fillna(fallback)
    assert np.allclose(out["rolling_mean"], week)
    assert np.allclose(out["rolling_mean_all"], every)


def test_features_never_see_the_current_row(spark):
    sales = random_sales(spark)
    day = dt.date(2024, 1, 25)
    changed = sales.withColumn("quantity", F.when(F.col("date") == F.lit(day), 9999).otherwise(F.col("quantity")))
    names = ["avg_last_7_sales", "std_last_7_sales", "rolling_mean", "rolling_mean_all"]

    def at_day(df):
        df = df.transform(windows.add_lag_features).transform(windows.add_rolling_mean_features, history_only=True)
        return values(df.filter(F.col("date") <= F.lit(day)), "gln", "gb_id", "date", *names)

    assert at_day(sales) == at_day(changed)


def test_store_temporal_and_events(rows):
    store = rows(
        "gln long, date date, quantity long, kronemarked int, on_promotion double",
        (1, "2024-01-01", 10, 0, 0.0),
        (1, "2024-01-03", 20, 1, 0.0),
        (1, "2024-01-04", 30, 0, 0.5),
        (1, "2024-01-09", 40, 0, 0.0),
    )
    out = windows.add_store_temporal_features(store)
    got = values(out, "date", "sales_lag_1", "sales_lag_7", "rolling_mean_7", "rolling_std_7", "days_since_last_kronemarked", "days_since_last_promotion")
    assert [r[1:] for r in got] == [
        (0.0, 0.0, 0.0, 0.0, 999, 999),
        (10.0, 0.0, 10.0, 0.0, 0, 999),
        (20.0, 0.0, 15.0, pytest.approx(7.0710678), 1, 0),
        (30.0, 0.0, 20.0, 10.0, 2, 1),
    ]


def carryover(rows, *data):
    schema = SALES + ", campaign_seq int, markdown_seq int"
    return rows(schema, *[(*d[:4], False, *(d[4:] or (0, 0))) for d in data])


def test_carryover_row_and_day(rows):
    sales = carryover(
        rows,
        (1, 7, "2024-01-01", 5),
        (1, 9, "2024-01-01", 1),
        (1, 3, "2024-01-02", 1),
        (1, 7, "2024-01-02", 6),
        (1, 8, "2024-01-05", 1),
        (1, 9, "2024-01-05", 1),
        (1, 9, "2024-01-06", 1),
        (2, 9, "2024-01-02", 1),
    )
    out = windows.add_carryover_previous_row(sales, 7)
    got = values(out, "gln", "date", "gb_id", "gb_id_previous_day")
    assert [r[3] for r in got] == [0, 5, 0, 0, 6, 0, 0, 0]
    got = values(windows.add_carryover_previous_day(sales, 7), "gln", "date", "gb_id", "gb_id_previous_day")
    assert [r[3] for r in got] == [0, 0, 5, 5, 0, 0, 0, 0]


def test_carryover_rows_made_by_overlapping_intervals(rows):
    sales = carryover(
        rows,
        (1, 7, "2024-01-01", 5, 1, 0),
        (1, 7, "2024-01-01", 5, 2, 0),
        (1, 9, "2024-01-01", 1, 1, 0),
        (1, 9, "2024-01-01", 1, 2, 0),
    )
    out = windows.add_carryover_previous_row(sales, 7)
    assert [r[2] for r in values(out, "gb_id", "campaign_seq", "gb_id_previous_day")] == [0, 5, 5, 0]


def test_densify(rows):
    series = rows("item_id string, date date, target long", ("a", "2024-01-01", 5), ("a", "2024-01-04", 7), ("b", "2024-01-02", 1))
    assert [r[2] for r in values(windows.densify_zero(series), "item_id", "date", "target")] == [5, 0, 0, 7, 1]
    assert [r[2] for r in values(windows.densify_ffill(series), "item_id", "date", "target")] == [5, 5, 5, 7, 1]


# --- encodings -----------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_encodings_are_means_of_the_training_part(spark, seed):
    """Against pandas on random sales: known keys get their mean, unknown ones the mean of all rows."""
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {
            "gln": rng.integers(0, 6, 80),
            "gb_id": rng.integers(0, 9, 80),
            "quantity": rng.gamma(2.0, 9.0, 80),
            "target": rng.random(80),
            "on_promotion": rng.random(80) < 0.4,
        }
    )
    train, test = frame[(frame.gln < 4) & (frame.gb_id < 6)], frame
    parts = [spark.createDataFrame(part) for part in (train, test)]
    by_store = {r["gln"]: r["gln_te"] for r in datasets.encode_store(*parts)[1].collect()}
    for key in frame.gln.unique():
        expected = train.quantity[train.gln == key].mean() if key < 4 else train.quantity.mean()
        assert by_store[key] == pytest.approx(expected)
    for row in datasets.encode_product(*parts)[1].collect():
        expected = train.target[train.gb_id == row["gb_id"]].mean() if row["gb_id"] < 6 else train.target.mean()
        assert row["gb_id_mean_target"] == pytest.approx(expected)
        assert row["promo_x_popularity"] == pytest.approx(expected if row["on_promotion"] else 0.0)


@pytest.mark.parametrize("lost", ["gln", "quantity"])
def test_encoding_names_the_lost_column(spark, lost):
    sales = random_sales(spark, days=3).drop(lost)
    with pytest.raises(KeyError):
        datasets.fit_target_encoding(sales)


# --- datasets and splits -------------------------------------------------------------


def test_shares_sum_to_one_and_zero_totals_drop(spark, rows):
    schema = "gln long, gb_id long, date date, quantity long, discount double, corrected_unit_price double, on_promotion boolean"
    sales = rows(
        schema,
        (1, 1, "2024-01-01", 3, -0.1, 10.0, True),
        (1, 2, "2024-01-01", 1, 0.0, 20.0, False),
        (2, 1, "2024-01-01", 0, 0.0, 20.0, False),
        (3, 1, "2024-01-01", 5, 0.0, 20.0, False),
        (3, 2, "2024-01-01", -1, 0.0, 20.0, False),
    )
    share = datasets.product_dataset(sales, "share")
    got = values(share, "gln", "gb_id", "target", "discount_relative", "promo_boost")
    assert got == [
        (1, 1, 0.75, pytest.approx(-0.05), -0.1),
        (1, 2, 0.25, pytest.approx(0.05), 0.0),
        (3, 1, 1.25, 0.0, 0.0),
        (3, 2, 0.0, 0.0, 0.0),
    ]
    direct = datasets.product_dataset(sales, "quantity")
    assert "store_total" not in direct.columns and direct.count() == 5
    with pytest.raises(ValueError):
        datasets.product_dataset(sales, "other")


def test_feature_selection_drops_label_and_collinear_columns(spark):
    columns = "gln gb_id date quantity target store_total month quarter promo_combined on_promotion rolling_mean_7 rolling_mean_30"
    df = spark.createDataFrame([tuple(range(12))], columns.split())
    features, label = datasets.select_features(df, "xgb_share")
    assert (features, label) == (["month", "promo_combined", "rolling_mean_7"], "target")
    with pytest.raises(ValueError):
        datasets.select_features(df, "other")
    with pytest.raises(RuntimeError):
        datasets.select_features(df.withColumnRenamed("month", "y_pred"), "xgb_direct")


def test_splits_and_folds(spark):
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=3 * i) for i in range(13)]
    df = spark.createDataFrame([(d, k) for d in dates for k in range(2)], "date date, k long")
    train, test = datasets.split_last_n(df, 4)
    assert {r[0] for r in values(test, "date")} == set(dates[-4:])
    assert train.count() + test.count() == df.count()
    train, test = datasets.split_by_time(df, dates[3], dates[5])
    assert (train.count(), test.count()) == (6, 6)
    folds = dict(values(datasets.time_folds(df), "date", "fold"))
    blocks = [list(b) for b in np.array_split(np.array(dates), 5)]
    assert all(folds[d] == i for i, block in enumerate(blocks) for d in block)


def test_normalized_keys(spark):
    numbers = spark.createDataFrame([(101.0,), (1.5,), (None,), (float("nan"),), (1e20,)], "k double")
    keys = [r[0] for r in numbers.select(datasets.normalized_key(numbers, "k")).collect()]
    assert keys == ["101", "1.5", None, None, "100000000000000000000"]
    texts = spark.createDataFrame([("001",)], "k string")
    assert texts.select(datasets.normalized_key(texts, "k")).first()[0] == "001"
    whole = spark.createDataFrame([(101,)], "k long")
    assert whole.select(datasets.normalized_key(whole, "k")).first()[0] == "101"


def test_store_series_fills_gaps_and_checks_store_count(rows):
    store = rows("gln long, date date, quantity long, discount double", (1, "2024-01-01", 5, 0.1), (1, "2024-01-03", 6, 0.3))
    out = datasets.store_series(store)
    assert [r[1:] for r in values(out, "date", "target", "discount")] == [(5.0, 0.1), (5.0, 0.1), (6.0, 0.3)]
    assert datasets.store_series(store, expected_series=1).count() == 3
    with pytest.raises(Exception, match="11 stores expected"):
        datasets.store_series(store, expected_series=11).collect()


# --- guards --------------------------------------------------------------------------


@pytest.mark.parametrize("model", sorted(guards.FORBIDDEN_BY_MODEL))
def test_labels_and_predictions_are_refused(model):
    for name in guards.ALWAYS_FORBIDDEN | guards.FORBIDDEN_BY_MODEL[model]:
        with pytest.raises(RuntimeError, match=name):
            guards.assert_no_forbidden_features(["sin_dow", name], model)
    guards.assert_no_forbidden_features(guards.KNOWN_FUTURE, model)


def test_horizon_guard_takes_plans_and_history_only():
    history = [f"price{token}_x" for token in guards.HISTORY_TOKENS]
    guards.assert_known_at_horizon([*guards.KNOWN_FUTURE, *history])
    for name in ("unit_price", "quantity", "weather"):
        with pytest.raises(RuntimeError, match=name):
            guards.assert_known_at_horizon(["month", name])
    guards.assert_known_at_horizon(["weather"], known_future=["weather"])
    with pytest.raises(ValueError, match="weather"):
        guards.assert_columns_exist(["month"], ["month", "weather"], "frame")


def test_audit_verdicts_follow_the_rules(spark, tmp_path):
    from demandloom.sources.files import write_report

    blocked = guards.ALWAYS_FORBIDDEN | guards.LABEL_COLUMNS
    history = {f"sales_{token.strip('_')}_4" for token in guards.HISTORY_TOKENS if token != "_te"}
    review = {"planned_promo_share", "discount_depth"}
    names = blocked | guards.KNOWN_FUTURE | history | review | {"temperature"}
    audit = guards.audit_features(spark, names, 14)
    by_status = {}
    for row in audit.collect():
        by_status.setdefault(row["status"], set()).add(row["feature"])
        assert row["horizon_days"] == 14 and (row["reason"], row["recommendation"]) == guards.AUDIT_TEXT[row["status"]]
    assert by_status == {
        "blocked": blocked, "known_future": guards.KNOWN_FUTURE, "history_derived": history, "review": review, "unknown": {"temperature"},
    }
    assert guards.flagged_features(audit).count() == len(blocked) + 3
    assert dict(values(guards.audit_status_counts(audit), "status", "n_features")) == {s: len(f) for s, f in by_status.items()}
    write_report(audit, str(tmp_path / "audit"))
    assert sum(len(pd.read_csv(f)) for f in (tmp_path / "audit").glob("*.csv")) == len(names)


def test_null_gate(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, None)], "a double, b long")
    assert tuple(guards.missing_counts(df, ["a", "b"]).first()) == (2, 1)
    with pytest.raises(ValueError):
        guards.assert_no_missing(df, ["a"])
    guards.assert_no_missing(df.limit(1), ["a", "b"])


def test_money_sums_lose_no_amount(spark):
    from demandloom.operators.cleaning import money_sum

    def total(*amounts):
        return spark.createDataFrame([(a,) for a in amounts], "m double").agg(money_sum("m")).first()[0]

    assert total(1e13, 5.0) == 1e13 + 5
    assert total(0.1, 0.2, None) == 0.3
    assert str(total(float("nan"), 5.0)) == "nan"
    assert total(float("inf"), 5.0) == float("inf")
    assert total(1e30, 5.0) == 1e30
    assert total(None) is None


def test_short_series_get_every_horizon_day(rows):
    from demandloom.forecast import naive, tabular

    days = [("long", f"2024-01-{d:02d}", float(d % 7)) for d in range(1, 31)]
    days += [("short", f"2024-01-{d:02d}", v) for d, v in ((27, 1.0), (28, 2.0), (29, 3.0), (30, 6.0))]
    dense = rows("item_id string, date date, target double", *days)
    found = values(naive.seasonal_naive(dense).where("item_id = 'short'"), "horizon", "y_pred")
    assert found == [(1, 3.0), (2, 3.0), (3, 3.0), (4, 1.0), (5, 2.0), (6, 3.0), (7, 6.0)]
    for forecast in (tabular.direct_tabular, tabular.recursive_tabular):
        counts = forecast(dense, horizon=7).groupBy("item_id").count()
        assert values(counts, "item_id", "count") == [("long", 7), ("short", 7)]


@pytest.mark.parametrize(("span", "block"), [(5, 32), (1, 4), (30, 3), (5, 1)])
def test_exponential_mean_equals_pandas(spark, span, block):
    """Also over many blocks, gaps of missing values and a series that starts with one."""
    rng = random.Random(span)
    start = dt.date(2020, 1, 1)
    data = []
    for store in range(3):
        known = [None if rng.random() < 0.2 else float(rng.choice([0, 1, 50, 1e6])) for _ in range(150)]
        known[0] = None if store == 1 else known[0]
        data += [(store, 7, start + dt.timedelta(days=d), v) for d, v in enumerate(known)]
    df = spark.createDataFrame(data, "gln long, gb_id long, date date, quantity double").repartition(4)
    got = windows.exponential_mean_before(df, ["gln", "gb_id"], "m", span, block=block)
    assert "_n" not in got.columns
    frame = pd.DataFrame(data, columns=["gln", "gb_id", "date", "quantity"])
    expected = frame.groupby("gln")["quantity"].transform(lambda s: s.shift(1).ewm(span=span, adjust=False).mean())
    found = got.orderBy("gln", "date").toPandas()["m"].to_numpy(dtype=float)
    assert np.allclose(found, expected.to_numpy(), rtol=1e-12, equal_nan=True)


def test_exponential_mean_stays_in_the_jvm(spark):
    table = windows.add_rolling_mean_features(random_sales(spark), use_ema=True)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_audit_follows_the_rows(spark):
    rows = [(float(i), 2.0 * i + 1, 4.0, None if i else 1.0, float("nan") if i % 2 else 1.0 * (i % 3)) for i in range(12)]
    table = spark.createDataFrame(rows, "quantity double, sales_lag_1 double, month double, odd double, discount double")
    audit = guards.audit_table(table.repartition(3), ["sales_lag_1", "month", "odd", "discount"], "quantity", 7)
    found = {r["feature"]: r for r in audit.collect()}
    assert {f: r["finding"] for f, r in found.items()} == {
        "sales_lag_1": "copies label", "month": "constant", "odd": "empty", "discount": "empty",
    }
    assert found["sales_lag_1"]["status"] == "blocked" and found["month"]["status"] == "known_future"
    assert found["discount"]["null_share"] == 0.5 and found["discount"]["n_distinct"] == 3
    assert found["month"]["label_corr"] is None and abs(found["sales_lag_1"]["label_corr"] - 1) < 1e-12
    changed = table.withColumn("sales_lag_1", F.col("quantity") % 3)
    after = {r["feature"]: r for r in guards.audit_table(changed, ["sales_lag_1"], "quantity", 7).collect()}
    assert after["sales_lag_1"]["finding"] == "none" and after["sales_lag_1"]["status"] == "history_derived"
    empty = guards.audit_table(table.limit(0), ["month"], "quantity", 7).first()
    assert (empty["n_rows"], empty["n_distinct"], empty["finding"]) == (0, 0, "empty")
