"""Model queries use the operators' own defaults and forecast all series."""

import pytest

import __spark_entry__ as entry
from demandloom.forecast import trees


@pytest.mark.parametrize("name", ["ets_forecast", "theta_forecast"])
def test_stores_and_products_are_forecast(spark, sf_dir, name):
    items = {r.item_id for r in entry.queries()[name](spark, sf_dir).select("item_id").distinct().collect()}
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = lineitem.selectExpr("l_suppkey % 11 AS gln", "l_partkey % 40 AS gb_id").distinct().collect()
    assert items == {f"{r.gln}" for r in pairs} | {f"{r.gb_id}_{r.gln}" for r in pairs}


@pytest.mark.parametrize("name", ["gbt_total", "rf_total", "direct_tabular", "recursive_tabular"])
def test_estimators_have_their_defaults(spark, sf_dir, name, monkeypatch):
    class Seen(Exception):
        pass

    def seen(kind, **params):
        raise Seen(params)

    monkeypatch.setattr(trees, "estimator", seen)
    with pytest.raises(Seen) as caught:
        entry.queries()[name](spark, sf_dir)
    assert caught.value.args == ({},)


def test_search_runs_all_trials_over_all_ranges(spark, sf_dir, monkeypatch):
    """Fifty trials, five to a fit; every fit asks for all ranges and every trial has a number of trees."""
    calls = []

    def scored(table, features, metric, counts, parallelism, **params):
        calls.append((params, counts))
        return {count: 1.0 for count in counts}

    monkeypatch.setattr(trees, "_prefix_cv_scores", scored)
    assert entry.queries()["param_search"](spark, sf_dir).count() == 50
    assert sum(len(counts) for _, counts in calls) == 50
    assert all(set(params) == set(trees.SEARCH_SPACE["gbt"]) for params, _ in calls)
    assert len({tuple(sorted(params.items())) for params, _ in calls}) == len(calls)
    assert trees.search_space("xgb_share")["maxIter"] == (200, 600) and "minInfoGain" in trees.search_space("xgb_total")
