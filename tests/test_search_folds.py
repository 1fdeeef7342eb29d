"""The folds of a search are fitted side by side."""

import datetime as dt
import threading

from demandloom.forecast import trees


def test_all_folds_are_fitted_at_once(spark, monkeypatch):
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    rows = [(d, 1, float(i % 7), 10.0 * (i % 7)) for i, d in enumerate(days)]
    table = spark.createDataFrame(rows, "date date, gln long, weekday double, quantity double")
    space = {"maxIter": (2, 2), "maxDepth": (2, 2)}
    together, fit = threading.Barrier(5, timeout=60), trees.fit

    def fit_with_the_others(*args, **params):
        together.wait()
        return fit(*args, **params)

    monkeypatch.setattr(trees, "fit", fit_with_the_others)
    folds = trees.expanding_folds(table, 5, 8)
    assert trees.param_search(table, "xgb_total", n_trials=1, space=space, folds=folds).count() == 1
