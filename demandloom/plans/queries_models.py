"""Queries that train models. They have no SQL equivalent, so no oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.forecast import horizons, naive, seasonal_regression, smoothing, tabular, trees
from demandloom.operators import calendar_dim, datasets, metrics, windows
from demandloom.plans import catalog, queries_reports  # noqa: F401  the latter names the rows of the naive backtest
from demandloom.plans.catalog import query
from demandloom.plans.inputs import Inputs
from demandloom.plans.queries_features import product_series_of
from demandloom.sources.staging import new_folder, stage

METRICS = "n:long mse:double mae:double r2:double mape_nonzero:double rmsle:double wmape:double"

_last_week = partial(datasets.split_last_n, n=7)


def _store_table(inputs: Inputs) -> DataFrame:
    return stage(datasets.total_dataset(catalog.features(inputs)), "store_table")


def _share_table(inputs: Inputs) -> DataFrame:
    return datasets.product_dataset(catalog.features(inputs), "share")


def _direct_table(inputs: Inputs) -> DataFrame:
    return datasets.product_dataset(catalog.features(inputs), "quantity")


def _store_split(inputs: Inputs) -> tuple[DataFrame, DataFrame]:
    return datasets.encode_store(*_last_week(_store_table(inputs)))


def _product_split(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return datasets.encode_store(*datasets.encode_product(*_last_week(table)))


@query("gbt_total", METRICS)
def gbt_total(inputs: Inputs) -> DataFrame:
    """Train, save, load and score the store total model on the last seven dates."""
    train, test = _store_split(inputs)
    folder = new_folder(inputs.spark, "model")
    trees.save_model(trees.train(train, "xgb_total"), folder)
    return trees.load_and_test(folder, test, "xgb_total")


@query("gbt_share", METRICS + " weighted_mae:double")
def gbt_share(inputs: Inputs) -> DataFrame:
    scored = stage(trees.train_and_score(*_product_split(_share_table(inputs)), "xgb_share"), "scored")
    return metrics.error_metrics(scored).withColumn("weighted_mae", metrics.weighted_mae(scored).scalar())


@query("gbt_direct", METRICS)
def gbt_direct(inputs: Inputs) -> DataFrame:
    return metrics.error_metrics(
        trees.train_and_score(*_product_split(_direct_table(inputs)), "xgb_direct")
    )


@query("rf_total", METRICS)
def rf_total(inputs: Inputs) -> DataFrame:
    return metrics.error_metrics(trees.train_and_score(*_store_split(inputs), "xgb_total", kind="rf"))


@query("expanding_cv", "fold:int score:double")
def expanding_cv(inputs: Inputs) -> DataFrame:
    return trees.expanding_cv(_store_table(inputs), "xgb_total")


@query("share_cv", "fold:int score:double")
def share_cv(inputs: Inputs) -> DataFrame:
    """Date blocks 1..4, each predicted from all earlier blocks, scored by weighted error."""
    table = stage(_share_table(inputs), "share_table")
    return trees.expanding_cv(table, "xgb_share", folds=trees.share_folds(table), metric="weighted_mae")


@query("param_search", "trial:int params:string cv_score:double")
def param_search(inputs: Inputs) -> DataFrame:
    return trees.param_search(_store_table(inputs), "xgb_total")


@query("feature_importance", "feature:string importance:double")
def feature_importance(inputs: Inputs) -> DataFrame:
    train, _ = _store_split(inputs)
    return trees.feature_importance(trees.train(train, "xgb_total"), inputs.spark)


@query("prune_compare", f"variant:string n_features:int {METRICS}")
def prune_compare(inputs: Inputs) -> DataFrame:
    return trees.prune_compare(*_store_split(inputs), "xgb_total", top_k=8)


@query("hierarchical_eval", f"shares:string {METRICS}")
def hierarchical_eval(inputs: Inputs) -> DataFrame:
    """Share x total on the last seven dates, with raw and with normalised shares."""
    frame = stage(
        trees.hierarchical_predictions(_store_table(inputs), _share_table(inputs), _last_week), "hierarchy"
    )
    normalized = datasets.normalize_shares(frame.drop("pred_quantity")).withColumn(
        "pred_quantity", F.col("pred_share") * F.col("pred_total")
    )
    scores = [
        metrics.error_metrics(df, "quantity", "pred_quantity").withColumn("shares", F.lit(name))
        for name, df in (("raw", frame), ("normalized", normalized))
    ]
    return scores[0].unionByName(scores[1])


@query("seasonal_regression", "model_key:string n_rows:long term:string coefficient:double")
def seasonal_regression_fit(inputs: Inputs) -> DataFrame:
    models = seasonal_regression.fit_seasonal_regression(_store_table(inputs))
    pairs = F.explode(F.arrays_zip("terms", "coefficients"))
    return models.select("model_key", "n_rows", pairs.alias("p")).select(
        "model_key", "n_rows", F.col("p.terms").alias("term"), F.col("p.coefficients").alias("coefficient")
    )


@query("seasonal_predict", f"regressors:string {METRICS}")
def seasonal_predict(inputs: Inputs) -> DataFrame:
    """Last seven dates predicted with all, no, and discount-only regressors."""
    train, test = _last_week(_store_table(inputs))
    parts = []
    for name, regressors in (("all", None), ("none", []), ("discount", ["discount"])):
        models = seasonal_regression.fit_seasonal_regression(train, regressors)
        scored = seasonal_regression.predict_seasonal_regression(test, models, regressors)
        parts.append(metrics.error_metrics(scored).withColumn("regressors", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


FORECAST = "item_id:string date:date horizon:int y_pred:double"


def _dense_stores(inputs: Inputs) -> DataFrame:
    return datasets.store_series(datasets.aggregate_to_store_daily(catalog.features(inputs)), covariates=None)


def _dense_series(inputs: Inputs) -> DataFrame:
    """Store series and store-product series; the ids of the latter are ``product_store``."""
    products = windows.densify_ffill(product_series_of(inputs))
    stores = _dense_stores(inputs).withColumn("target", F.col("target").cast("double"))
    return stores.unionByName(products.withColumn("target", F.col("target").cast("double")))


def _by_level(model: Callable[..., DataFrame], dense: DataFrame, horizon: int = 7) -> DataFrame:
    """A global model is trained on stores and on products apart, as their scales differ."""
    product = F.col("item_id").contains("_")
    return model(dense.filter(~product), horizon).unionByName(model(dense.filter(product), horizon))


@query("ets_forecast", FORECAST)
def ets_forecast(inputs: Inputs) -> DataFrame:
    return smoothing.ets_forecast(_dense_series(inputs))


@query("theta_forecast", FORECAST)
def theta_forecast(inputs: Inputs) -> DataFrame:
    return smoothing.theta_forecast(_dense_series(inputs))


@query("direct_tabular", FORECAST)
def direct_tabular(inputs: Inputs) -> DataFrame:
    return _by_level(tabular.direct_tabular, stage(_dense_series(inputs), "dense_series"))


@query("recursive_tabular", FORECAST)
def recursive_tabular(inputs: Inputs) -> DataFrame:
    return _by_level(tabular.recursive_tabular, stage(_dense_series(inputs), "dense_series"))


# --- covariates known when a forecast is made -------------------------------------------

_PLANNED = "is_holiday days_to_nearest_holiday on_promotion discount kronemarked promo_combined promotion_count closed_in_next_4_days"
_SEASONAL = "day_of_week_num sin_dow cos_dow sin_day cos_day month quarter".split()
_LAST_KNOWN = ", ".join(f"last_value(s.{c} IGNORE NULLS) OVER w AS {c}" for c in _PLANNED.split())
_WHOLE = {"day_of_week_num", "month", "quarter", "is_holiday", "kronemarked"}

catalog.oracle.cte(
    "store_grid",
    "store_daily",
    f"""
SELECT CAST(g.gln AS VARCHAR) AS item_id, g.date, last_value(s.quantity IGNORE NULLS) OVER w AS target, {_LAST_KNOWN}
FROM (SELECT gln, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM store_daily GROUP BY gln) g
LEFT JOIN store_daily s ON s.gln = g.gln AND s.date = g.date
WINDOW w AS (PARTITION BY g.gln ORDER BY g.date)""",
)
catalog.oracle.cte(
    "store_frame",
    "store_grid",
    f"""
SELECT t.*, {", ".join(f"l.lag_{i}" for i in range(1, 8))}, {catalog.oracle.CALENDAR.replace("(date)", "(t.date)")}
FROM (
  SELECT g.item_id, g.date - (h.h - 1) AS origin, h.h AS horizon, g.date, g.target AS y_true, {_PLANNED.replace(" ", ", ")}
  FROM store_grid g JOIN (SELECT item_id, max(date) AS last_date FROM store_grid GROUP BY item_id) e USING (item_id),
       (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS h) h
  WHERE (e.last_date - g.date + h.h) % 7 = 0
  UNION ALL
  SELECT item_id, last_date + 1, h.h, last_date + h.h, NULL, {", ".join("0" for _ in _PLANNED.split())}
  FROM (SELECT item_id, max(date) AS last_date FROM store_grid GROUP BY item_id), (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS h) h
) t JOIN (
  SELECT item_id, date, {", ".join(f"lag(target, {i - 1}) OVER d AS lag_{i}" for i in range(1, 8))} FROM store_grid
  WINDOW d AS (PARTITION BY item_id ORDER BY date)
) l ON l.item_id = t.item_id AND l.date = t.origin - 1 AND l.lag_7 IS NOT NULL""",
)


def _with_season(dense: DataFrame, covariates: list[str]) -> DataFrame:
    """Calendar columns follow from the date, also where a gap of the series was filled."""
    season = calendar_dim.seasonality_columns()
    return dense.withColumns({c: season[c] for c in covariates if c in season})


def _covariate_stores(inputs: Inputs, kind: str) -> DataFrame:
    series = datasets.store_series(datasets.aggregate_to_store_daily(catalog.features(inputs)), covariates=kind)
    return _with_season(series, datasets.COVARIATE_SETS[kind])


def _frame_query(kind: str) -> None:
    covariates = datasets.COVARIATE_SETS[kind]
    names = ["item_id", "origin", "horizon", "date", "y_true", *horizons.LAGS, *covariates]
    kinds = {"item_id": "string", "origin": "date", "horizon": "int", "date": "date"} | dict.fromkeys(_WHOLE, "int")
    columns = " ".join(f"{c}:{kinds.get(c, 'double@9')}" for c in names)

    @query(f"covariate_frame_{kind}", columns, "store_frame", f"SELECT {', '.join(names)} FROM store_frame")
    def frame(inputs: Inputs) -> DataFrame:
        return horizons.covariate_frame(_covariate_stores(inputs, kind), covariates)


for _kind in ("all", "calendar", "promotion", "calendar_promotion"):
    _frame_query(_kind)


@query("covariate_forecasts", "covariates:string model:string item_id:string date:date horizon:int y_pred:double")
def covariate_forecasts(inputs: Inputs) -> DataFrame:
    """Store forecasts of the tabular models with each set of covariates."""
    parts = []
    for kind in ("all", "calendar", "promotion", "calendar_promotion"):
        dense = stage(_covariate_stores(inputs, kind), "covariate_series")
        for name, model in (("direct", tabular.direct_tabular), ("recursive", tabular.recursive_tabular)):
            found = model(dense, 7, covariates=datasets.COVARIATE_SETS[kind])
            parts.append(found.select(F.lit(kind).alias("covariates"), F.lit(name).alias("model"), "*"))
    return reduce(DataFrame.unionByName, parts)


# --- backtests of all models --------------------------------------------------------------

_ORIGIN_ROWS = "SELECT * FROM backtest WHERE (SELECT max(date) FROM grid) + 1 - origin IN (7, 14, 21, 28)"


def _naive_backtest(inputs: Inputs) -> DataFrame:
    dense = windows.densify_zero(product_series_of(inputs))
    return horizons.backtest(dense, {"seasonal_naive": naive.seasonal_naive}, apart=frozenset({"seasonal_naive"}))


@query(
    "origin_backtest",
    "model:string horizon:int n:long mae:double wape:double",
    "backtest grid",
    f"""SELECT 'seasonal_naive' AS model, horizon, count(*) AS n, avg(abs(y_true - y_pred)) AS mae,
               sum(abs(y_true - y_pred)) / sum(y_true) AS wape FROM ({_ORIGIN_ROWS}) GROUP BY horizon""",
)
def origin_backtest(inputs: Inputs) -> DataFrame:
    return horizons.by_model_and_horizon(_naive_backtest(inputs))


_PRODUCT_LEVELS = ", ".join(str(q) for q in horizons.PRODUCT_QUANTILES)


@query(
    "conformal_quantiles",
    "model:string level:string horizon:int probability:double quantile:double n:long coverage:double pinball:double",
    "backtest grid",
    f"""SELECT 'seasonal_naive' AS model, 'product' AS level, r.horizon, probability, max(quantile) AS quantile, count(*) AS n,
               avg(CASE WHEN y_true <= y_pred + quantile THEN 1e0 ELSE 0e0 END) AS coverage,
               avg(greatest(probability * (y_true - y_pred - quantile), (probability - 1) * (y_true - y_pred - quantile))) AS pinball
        FROM ({_ORIGIN_ROWS}) r JOIN (
          SELECT horizon, unnest([{_PRODUCT_LEVELS}]) AS probability, unnest(q) AS quantile FROM (
            SELECT horizon, quantile_cont(CAST(y_true - y_pred AS DOUBLE), [{_PRODUCT_LEVELS}]) AS q
            FROM ({_ORIGIN_ROWS}) WHERE origin <> (SELECT max(date) FROM grid) - 6 GROUP BY horizon)) s USING (horizon)
        WHERE origin = (SELECT max(date) FROM grid) - 6 GROUP BY r.horizon, probability""",
)
def conformal_quantiles(inputs: Inputs) -> DataFrame:
    return horizons.conformal_quantiles(_naive_backtest(inputs), {"product": horizons.PRODUCT_QUANTILES}, F.lit("product"))


_APART = {"seasonal_naive": naive.seasonal_naive, "ets": smoothing.ets_forecast, "theta": smoothing.theta_forecast}
_TOGETHER = {"direct_tabular": tabular.direct_tabular, "recursive_tabular": tabular.recursive_tabular}


def _model_backtest(inputs: Inputs) -> DataFrame:
    def build() -> DataFrame:
        models = _APART | {name: partial(_by_level, model) for name, model in _TOGETHER.items()}
        rows = horizons.backtest(_dense_series(inputs), models, apart=frozenset(_APART))
        return stage(rows, "model_backtest")

    return catalog.processed(inputs, "model_backtest", build)


def _level() -> Column:
    return F.when(F.col("item_id").contains("_"), "product").otherwise("store")


@query("model_backtest", "level:string model:string horizon:int n:long mse:double mae:double wape:double")
def model_backtest(inputs: Inputs) -> DataFrame:
    """Every series model on four origins: one row per level, model and horizon day."""
    rows = _model_backtest(inputs).withColumn("level", _level())
    return metrics.error_metrics(rows, by=("level", "model", "horizon")).withColumn("wape", F.col("wmape") / 100)


@query(
    "model_quantiles",
    "model:string level:string horizon:int probability:double quantile:double n:long coverage:double pinball:double",
)
def model_quantiles(inputs: Inputs) -> DataFrame:
    """Conformal quantiles of every model on both levels, with their coverage on the held-out origin."""
    levels = {"store": naive.STORE_QUANTILES, "product": horizons.PRODUCT_QUANTILES}
    return horizons.conformal_quantiles(_model_backtest(inputs), levels, _level())


@query("model_leaderboard", "model:string score:double")
def model_leaderboard(inputs: Inputs) -> DataFrame:
    """All series models on the last seven days of the store and store-product series, best first."""
    models = {
        "seasonal_naive": naive.seasonal_naive,
        "ets": smoothing.ets_forecast,
        "theta": smoothing.theta_forecast,
        "direct_tabular": partial(_by_level, tabular.direct_tabular),
        "recursive_tabular": partial(_by_level, tabular.recursive_tabular),
    }
    return naive.leaderboard(naive.holdout_predictions(_dense_series(inputs), models))
