"""Queries for data profiles, anomaly reports and forecast evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.forecast import naive
from demandloom.functions.normal import normal_quantile_sql
from demandloom.operators import cleaning, datasets, metrics, profile, windows
from demandloom.plans import catalog
from demandloom.plans.catalog import query
from demandloom.plans.inputs import PRODUCTS, Inputs, as_of
from demandloom.plans.queries_features import product_series_of
from demandloom.plans.queries_tables import DAILY, _dispersion, _hourly
from demandloom.sources.staging import stage

# --- profiles ------------------------------------------------------------------------


@query(
    "dataset_overview",
    "rows:long columns:int date_min:string date_max:string n_dates:long n_stores:long n_products:long",
    "daily",
    """SELECT count(*) AS rows, 8 AS columns, min(date) AS date_min, max(date) AS date_max,
              count(DISTINCT date) AS n_dates, count(DISTINCT gln) AS n_stores, count(DISTINCT gb_id) AS n_products
       FROM daily""",
)
def dataset_overview(inputs: Inputs) -> DataFrame:
    return profile.dataset_overview(catalog.daily(inputs))


_MISSING = ["ref_store_price", "ref_global_price", "price_correction_source", "standard_price", "discount", "quantity"]


@query(
    "missingness",
    "column:string missing_count:long missing_pct:double",
    "promoted",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
                   (count(*) - count({c})) * 100e0 / count(*) AS missing_pct FROM promoted"""
        for c in _MISSING
    ),
)
def missingness(inputs: Inputs) -> DataFrame:
    return profile.missingness_table(catalog.promoted(inputs).select(_MISSING))


_CORRELATED = ["quantity", "net_sales", "tax_amount", "gross_margin", "unit_price", "corrected_unit_price", "standard_price"]


@query(
    "high_corr_pairs",
    "feature_a:string feature_b:string corr_abs:double",
    "promoted",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, abs(corr({a}, {b})) AS corr_abs FROM promoted"
        for i, a in enumerate(_CORRELATED)
        for b in _CORRELATED[i + 1 :]
    )
    + ") WHERE corr_abs >= 0.9e0 AND NOT isnan(corr_abs)",
)
def high_corr_pairs(inputs: Inputs) -> DataFrame:
    return profile.high_correlation_pairs(catalog.promoted(inputs).select(_CORRELATED), 0.90)


@query(
    "sales_coverage",
    "gln:long date_min:date date_max:date n_days:long n_rows:long n_products:long span_days:int coverage_ratio:double",
    "daily",
    """SELECT *, n_days / CAST(span_days AS DOUBLE) AS coverage_ratio FROM (
         SELECT gln, min(date) AS date_min, max(date) AS date_max, count(DISTINCT date) AS n_days, count(*) AS n_rows,
                count(DISTINCT gb_id) AS n_products, max(date) - min(date) + 1 AS span_days FROM daily GROUP BY gln)""",
)
def sales_coverage(inputs: Inputs) -> DataFrame:
    return profile.sales_coverage(catalog.daily(inputs))


_RECORDS_SQL = """
SELECT *, n_active_days / CAST(span_days AS DOUBLE) AS coverage_ratio FROM (
  SELECT gln, gb_id, count(*) AS n_rows, count(DISTINCT date) AS n_active_days, min(date) AS first_date,
         max(date) AS last_date, max(date) - min(date) + 1 AS span_days FROM daily GROUP BY gln, gb_id)"""
catalog.oracle.cte("records", "daily", _RECORDS_SQL)


def _records(inputs: Inputs) -> DataFrame:
    return profile.product_record_counts(catalog.daily(inputs))


query(
    "product_record_counts",
    "gln:long gb_id:long n_rows:long n_active_days:long first_date:date last_date:date span_days:int"
    " coverage_ratio:double",
    "records",
    "records",
)(_records)


@query(
    "store_record_summary",
    "gln:long mean_rows:double median_rows:double mean_coverage:double n_products:long",
    "records",
    """SELECT gln, avg(n_rows) AS mean_rows, median(n_rows) AS median_rows, avg(coverage_ratio) AS mean_coverage,
              count(DISTINCT gb_id) AS n_products FROM records GROUP BY gln""",
)
def store_record_summary(inputs: Inputs) -> DataFrame:
    return profile.store_record_summary(_records(inputs))


@query(
    "low_coverage_topk",
    "store_product:string coverage_ratio:double n_rows:long",
    "records",
    """SELECT gln || ' | ' || gb_id AS store_product, coverage_ratio, n_rows FROM records
       ORDER BY coverage_ratio, gln, gb_id LIMIT 20""",
)
def low_coverage_topk(inputs: Inputs) -> DataFrame:
    return profile.low_coverage(_records(inputs), 20)


def _suspicious(inputs: Inputs) -> DataFrame:
    return cleaning.suspicious_prices(catalog.daily(inputs))


@query(
    "anomaly_summary",
    "n_hourly_dispersion_cases:long n_suspicious_daily_rows:long stores_with_hourly_dispersion:long"
    " stores_with_suspicious_daily_prices:long",
    "dispersion suspicious",
    """SELECT (SELECT count(*) FROM dispersion) AS n_hourly_dispersion_cases,
              (SELECT count(*) FROM suspicious) AS n_suspicious_daily_rows,
              (SELECT count(DISTINCT gln) FROM dispersion) AS stores_with_hourly_dispersion,
              (SELECT count(DISTINCT gln) FROM suspicious) AS stores_with_suspicious_daily_prices""",
)
def anomaly_summary(inputs: Inputs) -> DataFrame:
    return profile.anomaly_summary(_dispersion(inputs), _suspicious(inputs))


@query(
    "dispersion_by_store",
    "gln:long n_cases:long",
    "dispersion",
    "SELECT gln, count(*) AS n_cases FROM dispersion GROUP BY gln",
)
def dispersion_by_store(inputs: Inputs) -> DataFrame:
    return profile.dispersion_by_store(_dispersion(inputs))


@query(
    "anomalies_by_store",
    "gln:long n_hourly_dispersion:long n_suspicious_daily:long n_total_price_anomalies:long",
    "dispersion suspicious",
    """SELECT gln, sum(h) AS n_hourly_dispersion, sum(d) AS n_suspicious_daily, count(*) AS n_total_price_anomalies
       FROM (SELECT gln, 1 AS h, 0 AS d FROM dispersion UNION ALL SELECT gln, 0, 1 FROM suspicious) GROUP BY gln""",
)
def anomalies_by_store(inputs: Inputs) -> DataFrame:
    return profile.anomalies_by_store(_dispersion(inputs), _suspicious(inputs))


_CASE_HASH = "md5('42|' || gln || '|' || gb_id || '|' || strftime(date, '%Y-%m-%d')), gln, gb_id, date"


@query("anomaly_sample", DAILY, "suspicious", f"SELECT * FROM suspicious ORDER BY {_CASE_HASH} LIMIT 5")
def anomaly_sample(inputs: Inputs) -> DataFrame:
    return profile.anomaly_sample(_suspicious(inputs), 5)


def _sampled(cases: str) -> str:
    return f"SELECT *, date AS case_date FROM {cases} QUALIFY row_number() OVER (PARTITION BY gln ORDER BY {_CASE_HASH}) <= 5"


@query(
    "dispersion_sample",
    "gln:long gb_id:long date:date mean_price:double std_price:double rel_diff:double",
    "dispersion",
    f"SELECT * FROM dispersion ORDER BY {_CASE_HASH} LIMIT 5",
)
def dispersion_sample(inputs: Inputs) -> DataFrame:
    return profile.anomaly_sample(_dispersion(inputs), 5)


@query(
    "dispersion_paths",
    "gln:long gb_id:long case_date:date from_hour:int unit_price:double quantity:long rel_diff:double",
    "hourly dispersion",
    f"""SELECT h.gln, h.gb_id, c.case_date, h.from_hour, h.unit_price, h.quantity, c.rel_diff
        FROM hourly h JOIN ({_sampled("dispersion")}) c ON c.gln = h.gln AND c.gb_id = h.gb_id AND c.date = h.date""",
)
def dispersion_paths(inputs: Inputs) -> DataFrame:
    """Hourly prices of five varying days of every store."""
    hourly = stage(_hourly(inputs), "hourly")
    return profile.dispersion_paths(cleaning.price_dispersion(hourly), hourly, 5, by=("gln",))


@query(
    "suspicious_paths",
    "gln:long gb_id:long case_date:date date:date unit_price:double",
    "daily suspicious",
    f"""SELECT d.gln, d.gb_id, c.case_date, d.date, d.unit_price
        FROM daily d JOIN ({_sampled("suspicious")}) c ON c.gln = d.gln AND c.gb_id = d.gb_id""",
)
def suspicious_paths(inputs: Inputs) -> DataFrame:
    """Price history of the series of five suspicious rows of every store."""
    return profile.suspicious_paths(_suspicious(inputs), catalog.daily(inputs), 5, by=("gln",))


@query(
    "monthly_store_sales",
    "month:string gln:long quantity:long",
    "daily",
    "SELECT strftime(date, '%Y-%m') AS month, gln, sum(quantity) AS quantity FROM daily GROUP BY ALL",
)
def monthly_store_sales(inputs: Inputs) -> DataFrame:
    return profile.monthly_store_sales(catalog.daily(inputs))


@query(
    "product_mix_pivot",
    "gln:long period:string " + " ".join(f"product_{p}:long" for p in range(PRODUCTS)),
    "daily",
    "SELECT gln, strftime(date, '%Y-%m') AS period, "
    + ", ".join(f"coalesce(sum(quantity) FILTER (gb_id = {p}), 0) AS product_{p}" for p in range(PRODUCTS))
    + " FROM daily GROUP BY ALL",
)
def product_mix_pivot(inputs: Inputs) -> DataFrame:
    return profile.product_mix_pivot(profile.product_mix(catalog.daily(inputs)), list(range(PRODUCTS)))


@query(
    "discount_bands",
    "date:date gln:long discount_category:string count:long",
    "promoted",
    """SELECT date, gln, CASE WHEN discount <= -0.30e0 THEN 'Large Discount (-30%)'
                              WHEN discount <= -0.15e0 THEN 'Medium Discount (-15%)' ELSE 'Small Discount' END
              AS discount_category, count(*) AS count
       FROM promoted WHERE discount > -1 AND discount <= -0.05e0 GROUP BY ALL""",
)
def discount_bands(inputs: Inputs) -> DataFrame:
    return profile.discount_bands(catalog.promoted(inputs))


# --- evaluation: seasonal naive on observed product days ------------------------------


def build_evaluation(inputs: Inputs) -> DataFrame:
    """(item_id, date, y_true, y_pred): a week-old quantity as the forecast of each observed day."""
    series = product_series_of(inputs).withColumn("observed", F.lit(1))
    return (
        naive.with_seasonal_naive(windows.densify_zero(series))
        .filter((F.col("observed") == 1) & F.col("y_pred").isNotNull())
        .select("item_id", "date", F.col("target").cast("double").alias("y_true"), F.col("y_pred").cast("double"))
    )


def evaluation(inputs: Inputs) -> DataFrame:
    """The evaluation frame is a written table: every metric reads it."""
    return catalog.processed(inputs, "evaluation", lambda: stage(build_evaluation(inputs), "evaluation"))


@query(
    "error_metrics",
    "n:long mse:double mae:double r2:double mape:double mape_nonzero:double rmsle:double wmape:double",
    "evaluation",
    """SELECT count(*) AS n, avg((y_true - y_pred) ** 2) AS mse, avg(abs(y_true - y_pred)) AS mae,
              1 - sum((y_true - y_pred) ** 2) / sum((y_true - m) ** 2) AS r2,
              avg(abs(y_true - y_pred) / greatest(y_true, 2.220446049250313e-16)) * 100 AS mape,
              avg(abs(y_true - y_pred) / y_true) FILTER (y_true > 0) * 100 AS mape_nonzero,
              sqrt(avg((ln(1 + greatest(y_pred, 0)) - ln(1 + greatest(y_true, 0))) ** 2)) AS rmsle,
              sum(abs(y_true - y_pred)) / sum(y_true) * 100 AS wmape
       FROM evaluation, (SELECT avg(y_true) AS m FROM evaluation)""",
)
def error_metrics(inputs: Inputs) -> DataFrame:
    return metrics.error_metrics(evaluation(inputs))


@query("wape", "wape:double", "evaluation", "SELECT sum(abs(y_true - y_pred)) / sum(abs(y_true)) AS wape FROM evaluation")
def wape(inputs: Inputs) -> DataFrame:
    """Truth and prediction meet in an inner join, as two separate tables would."""
    frame = evaluation(inputs)
    truth, predicted = frame.select("item_id", "date", "y_true"), frame.select("item_id", "date", "y_pred")
    return metrics.wape(truth.join(predicted, ["item_id", "date"]))


@query(
    "weighted_mae",
    "weighted_mae:double",
    "evaluation",
    """SELECT sum(greatest(y_true, 0.05e0) * abs(y_true - y_pred)) / sum(greatest(y_true, 0.05e0)) AS weighted_mae
       FROM evaluation""",
)
def weighted_mae(inputs: Inputs) -> DataFrame:
    return metrics.weighted_mae(evaluation(inputs))


@query(
    "wape_by_volume",
    "volume_bucket:string n:long wape:double",
    "evaluation",
    """SELECT volume_bucket, count(*) AS n, sum(abs(y_true - y_pred)) / sum(abs(y_true)) AS wape
       FROM (SELECT *, CASE WHEN m <= q[1] THEN 'low' WHEN m <= q[2] THEN 'mid-low'
                            WHEN m <= q[3] THEN 'mid-high' ELSE 'high' END AS volume_bucket
             FROM (SELECT *, avg(y_true) OVER (PARTITION BY item_id) AS m FROM evaluation) e,
                  (SELECT quantile_cont(m, [0.25, 0.5, 0.75]) AS q
                   FROM (SELECT avg(y_true) OVER (PARTITION BY item_id) AS m FROM evaluation)) edges)
       GROUP BY volume_bucket""",
)
def wape_by_volume(inputs: Inputs) -> DataFrame:
    return metrics.wape_by_volume(evaluation(inputs))


@query(
    "residual_histogram",
    "bin:int n:long bin_start:double",
    "evaluation",
    """SELECT bin, count(*) AS n, lo + bin * w AS bin_start
       FROM (SELECT lo, w, CAST(least(floor((y_true - y_pred - lo) / w), 29) AS INTEGER) AS bin
             FROM evaluation, (SELECT min(y_true - y_pred) AS lo,
                                      (max(y_true - y_pred) - min(y_true - y_pred)) / 30e0 AS w FROM evaluation))
       GROUP BY ALL""",
)
def residual_histogram(inputs: Inputs) -> DataFrame:
    return metrics.histogram(metrics.with_residuals(evaluation(inputs)), "residual", 30)


@query(
    "log_residual_histogram",
    "bin:int n:long bin_start:double",
    "evaluation",
    """SELECT bin, count(*) AS n, lo + bin * w AS bin_start
       FROM (SELECT lo, w, CAST(least(floor((v - lo) / w), 29) AS INTEGER) AS bin
             FROM (SELECT sign(y_true - y_pred) * ln(1 + abs(y_true - y_pred)) AS v FROM evaluation),
                  (SELECT min(v) AS lo, (max(v) - min(v)) / 30e0 AS w
                   FROM (SELECT sign(y_true - y_pred) * ln(1 + abs(y_true - y_pred)) AS v FROM evaluation)))
       GROUP BY ALL""",
)
def log_residual_histogram(inputs: Inputs) -> DataFrame:
    return metrics.histogram(metrics.with_residuals(evaluation(inputs)), "log_residual", 30)


_MEDIAN = "(CASE WHEN i = n THEN 0.5e0 ** (1e0 / n) WHEN i = 1 THEN 1 - 0.5e0 ** (1e0 / n) ELSE (i - 0.3175e0) / (n + 0.365e0) END)"
catalog.oracle.cte(
    "normal_pairs",
    "evaluation",
    f"""SELECT v, {normal_quantile_sql("m")} AS z FROM (
          SELECT v, {_MEDIAN} AS m FROM (
            SELECT y_true - y_pred AS v, row_number() OVER (ORDER BY y_true - y_pred) AS i, count(*) OVER () AS n FROM evaluation))""",
)
_LINE = "regr_slope(v, z) AS slope, regr_intercept(v, z) AS intercept, corr(v, z) AS r"


@query(
    "normal_fit",
    "n:long slope:double intercept:double r:double",
    "normal_pairs",
    f"SELECT count(*) AS n, {_LINE} FROM normal_pairs",
)
def normal_fit(inputs: Inputs) -> DataFrame:
    return metrics.normal_fit(metrics.with_residuals(evaluation(inputs)))


@query(
    "residual_quantiles",
    "probability:double quantile:double normal:double fitted:double",
    "evaluation normal_pairs",
    f"""SELECT probability, quantile, {normal_quantile_sql("probability")} AS normal,
               intercept + slope * ({normal_quantile_sql("probability")}) AS fitted
        FROM (SELECT unnest(p) AS probability, unnest(q) AS quantile
       FROM (SELECT [i / 100e0 for i in range(1, 100)] AS p,
                    quantile_cont(y_true - y_pred, ["""
    + ", ".join(f"{i / 100}" for i in range(1, 100))
    + f"]) AS q FROM evaluation)), (SELECT {_LINE} FROM normal_pairs)",
)
def residual_quantiles(inputs: Inputs) -> DataFrame:
    residuals = metrics.with_residuals(evaluation(inputs))
    return metrics.residual_quantiles(residuals, fit=metrics.normal_fit(residuals))


@query(
    "chain_rollup",
    "date:date y_true:double y_pred:double",
    "evaluation",
    "SELECT date, sum(y_true) AS y_true, sum(y_pred) AS y_pred FROM evaluation GROUP BY date",
)
def chain_rollup(inputs: Inputs) -> DataFrame:
    return datasets.chain_rollup(evaluation(inputs))


# --- seasonal naive forecasts ---------------------------------------------------------

catalog.oracle.cte(
    "naive_forecast",
    "grid",
    """
SELECT g.gb_id || '_' || g.gln AS item_id, g.date + 7 AS date, 7 - (l.last_date - g.date) AS horizon, target AS y_pred
FROM grid g JOIN (SELECT gln, gb_id, max(date) AS last_date FROM grid GROUP BY gln, gb_id) l USING (gln, gb_id)
WHERE g.date > l.last_date - 7""",
)
catalog.oracle.cte(
    "backtest",
    "grid",
    """
SELECT t.gb_id || '_' || t.gln AS item_id, o.origin, h.horizon, t.date, t.target AS y_true, p.target AS y_pred
FROM (SELECT (SELECT max(date) FROM grid) - CAST(unnest(range(0, 90)) AS INTEGER) AS origin) o
CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS horizon) h
JOIN grid t ON t.date = o.origin + h.horizon - 1
JOIN grid p ON p.gln = t.gln AND p.gb_id = t.gb_id AND p.date = t.date - 7""",
)


def _dense_products(inputs: Inputs) -> DataFrame:
    return windows.densify_zero(product_series_of(inputs))


def _backtest(inputs: Inputs) -> DataFrame:
    return naive.backtest_rows(_dense_products(inputs), last_day=as_of(0, catalog.daily(inputs)))


@query("seasonal_naive", "item_id:string date:date horizon:int y_pred:double", "naive_forecast", "naive_forecast")
def seasonal_naive(inputs: Inputs) -> DataFrame:
    return naive.seasonal_naive(_dense_products(inputs))


@query(
    "rolling_backtest",
    "origin:date n:long wape:double mae:double",
    "backtest",
    """SELECT origin, count(*) AS n, sum(abs(y_true - y_pred)) / nullif(sum(abs(y_true)), 0) AS wape,
              avg(abs(y_true - y_pred)) AS mae FROM backtest GROUP BY origin""",
)
def rolling_backtest(inputs: Inputs) -> DataFrame:
    rows = _backtest(inputs)
    scored = metrics.error_metrics(rows, by=("origin",))
    return scored.select("origin", "n", "mae", (F.col("wmape") / 100).alias("wape"))


@query(
    "metrics_by_horizon",
    "horizon:int n:long mse:double mae:double wmape:double",
    "backtest",
    """SELECT horizon, count(*) AS n, avg((y_true - y_pred) ** 2) AS mse, avg(abs(y_true - y_pred)) AS mae,
              sum(abs(y_true - y_pred)) / sum(y_true) * 100 AS wmape FROM backtest GROUP BY horizon""",
)
def metrics_by_horizon(inputs: Inputs) -> DataFrame:
    return metrics.error_metrics(_backtest(inputs), by=("horizon",))


_LEVELS = ", ".join(str(q) for q in naive.STORE_QUANTILES)


@query(
    "forecast_quantiles",
    "item_id:string date:date horizon:int probability:double y_quantile:double",
    "naive_forecast backtest",
    f"""SELECT item_id, date, f.horizon, probability, y_pred + quantile AS y_quantile
        FROM naive_forecast f
        JOIN (SELECT horizon, unnest([{_LEVELS}]) AS probability, unnest(q) AS quantile
              FROM (SELECT horizon, quantile_cont(CAST(y_true - y_pred AS DOUBLE), [{_LEVELS}]) AS q
                    FROM backtest GROUP BY horizon)) r ON r.horizon = f.horizon""",
)
def forecast_quantiles(inputs: Inputs) -> DataFrame:
    dense = _dense_products(inputs)
    return naive.forecast_quantiles(naive.seasonal_naive(dense), _backtest(inputs))


_CANDIDATES = {"weekday_mean": "rolling_mean", "recent_mean": "rolling_mean_all", "week_mean": "avg_last_7_sales"}


@query(
    "leaderboard",
    "model:string score:double",
    "sales_daily",
    " UNION ALL ".join(
        f"SELECT '{m}' AS model, sum(abs(quantity - {c})) / sum(abs(quantity)) AS score FROM sales_daily"
        for m, c in _CANDIDATES.items()
    ),
)
def leaderboard(inputs: Inputs) -> DataFrame:
    """History means of the feature table as competing forecasts."""
    sales = catalog.features(inputs)
    return naive.leaderboard(
        {m: sales.select(F.col("quantity").alias("y_true"), F.col(c).alias("y_pred")) for m, c in _CANDIDATES.items()}
    )
