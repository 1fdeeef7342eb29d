"""Model queries have no SQL oracle: they run on whole tables and give sane rows."""

import pytest

import __spark_entry__ as entry

#: 50 boosted trials of 50 to 300 trees on five folds take a quarter of an hour in local mode (README);
#: ``test_models_whole`` holds that all are asked for, ``test_search_scores_every_trial`` runs a small search to its end.
TOO_LONG = {"param_search"}
MODELS = sorted(set(entry.queries()) - set(entry.oracle_sql()) - TOO_LONG)


@pytest.mark.parametrize("name", MODELS)
def test_query_gives_rows(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    for row in rows:
        for column in ("y_pred", "mae", "score", "cv_score", "coefficient"):
            if column in df.columns:
                assert row[column] is not None and row[column] == row[column]
    if name == "model_leaderboard":
        scores = [r["score"] for r in rows]
        assert len(scores) == 5 and scores == sorted(scores)


@pytest.mark.parametrize("per_fit", [1, 2])
def test_search_scores_every_trial(spark, per_fit):
    import datetime as dt

    from demandloom.forecast import trees

    days = [dt.date(2001, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    rows = [(d, 1, float(i % 7), 10.0 * (i % 7) + g) for i, d in enumerate(days) for g in range(4)]
    table = spark.createDataFrame(rows, "date date, gln long, weekday double, quantity double")
    space = {"maxIter": (2, 4), "maxDepth": (2, 3), "stepSize": (0.1, 0.3), "minInstancesPerNode": (1, 3)}
    found = [
        trees.param_search(
            table, "xgb_total", n_trials=3, space=space, folds=trees.expanding_folds(table, 2, 10), counts_per_fit=per_fit
        ).collect()
        for _ in range(2)
    ]
    assert found[0] == found[1] and sorted(r.trial for r in found[0]) == [0, 1, 2]
    assert [r.cv_score for r in found[0]] == sorted(r.cv_score for r in found[0])
    assert len({r.params for r in found[0]}) > 1
