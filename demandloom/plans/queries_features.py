"""Queries for windows, series and modelling tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.operators import datasets, guards, windows
from demandloom.plans import catalog
from demandloom.plans.catalog import query
from demandloom.plans.inputs import CARRYOVER_PRODUCT, Inputs, as_of

KEYS = "gln:long gb_id:long date:date"
_BY_SERIES = "PARTITION BY gln, gb_id ORDER BY date"


@query(
    "lag_features",
    f"{KEYS} avg_last_7_sales:double std_last_7_sales:double promotion_days_count_last_7:long",
    "promoted",
    f"""SELECT gln, gb_id, date, coalesce(avg(quantity) OVER p, 0) AS avg_last_7_sales,
               coalesce(stddev_samp(quantity) OVER p, 0) AS std_last_7_sales,
               coalesce(sum(CAST(on_promotion AS INTEGER)) OVER p, 0) AS promotion_days_count_last_7
        FROM promoted WINDOW p AS ({_BY_SERIES} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
)
def lag_features(inputs: Inputs) -> DataFrame:
    return windows.add_lag_features(catalog.promoted(inputs))


_ROLLING = f"{KEYS} day_of_week:string rolling_mean:double promotion_days_count_rolling:long rolling_mean_all:double"


@query(
    "rolling_mean_features",
    _ROLLING,
    "promoted",
    f"""SELECT gln, gb_id, date, dayname(date) AS day_of_week,
               coalesce(avg(quantity) OVER w, avg(quantity) OVER (PARTITION BY gln, gb_id)) AS rolling_mean,
               coalesce(sum(CAST(on_promotion AS INTEGER)) OVER w, 0) AS promotion_days_count_rolling,
               coalesce(avg(quantity) OVER a, avg(quantity) OVER (PARTITION BY gln, gb_id)) AS rolling_mean_all
        FROM promoted
        WINDOW w AS (PARTITION BY gln, gb_id, dayname(date) ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
               a AS ({_BY_SERIES} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def rolling_mean_features(inputs: Inputs) -> DataFrame:
    return windows.add_rolling_mean_features(catalog.promoted(inputs))


def _ema_cte(name: str, keys: list[str]) -> None:
    """Recursive exponential mean (span 5: weights 1/3 and 2/3) per ``keys`` in date order."""
    listed = ", ".join(keys)
    catalog.oracle.cte(
        f"{name}_rows",
        "promoted",
        f"""SELECT *, row_number() OVER (PARTITION BY {listed} ORDER BY date) AS rn
            FROM (SELECT *, dayname(date) AS dow FROM promoted)""",
    )
    catalog.oracle.cte(
        name,
        f"{name}_rows",
        f"""SELECT {listed}, rn, CAST(quantity AS DOUBLE) AS ema FROM {name}_rows WHERE rn = 1
            UNION ALL
            SELECT {", ".join("n." + k for k in keys)}, n.rn, n.quantity / 3e0 + e.ema * (2e0 / 3e0)
            FROM {name} e JOIN {name}_rows n
              ON {" AND ".join(f"n.{k} = e.{k}" for k in keys)} AND n.rn = e.rn + 1""",
    )


_ema_cte("ema_all", ["gln", "gb_id"])
_ema_cte("ema_week", ["gln", "gb_id", "dow"])


@query(
    "ema_feature",
    f"{KEYS} rolling_mean:double rolling_mean_all:double",
    "ema_all ema_week",
    """SELECT a.gln, a.gb_id, a.date, coalesce(w.ema, m.mean) AS rolling_mean, coalesce(e.ema, m.mean) AS rolling_mean_all
       FROM ema_all_rows a
       JOIN ema_week_rows b USING (gln, gb_id, date)
       JOIN (SELECT gln, gb_id, avg(quantity) AS mean FROM promoted GROUP BY gln, gb_id) m USING (gln, gb_id)
       LEFT JOIN ema_all e ON e.gln = a.gln AND e.gb_id = a.gb_id AND e.rn = a.rn - 1
       LEFT JOIN ema_week w ON w.gln = a.gln AND w.gb_id = a.gb_id AND w.dow = b.dow AND w.rn = b.rn - 1""",
)
def ema_feature(inputs: Inputs) -> DataFrame:
    return windows.add_rolling_mean_features(catalog.promoted(inputs), use_ema=True)


_CARRY = f"{KEYS} quantity:long gb_id_previous_day:long"


@query(
    "carryover_prev_row",
    _CARRY,
    "daily",
    """SELECT *, coalesce(lag(CASE WHEN gb_id = 7 THEN quantity END) OVER (PARTITION BY gln ORDER BY date, gb_id), 0)
              AS gb_id_previous_day FROM daily""",
)
def carryover_prev_row(inputs: Inputs) -> DataFrame:
    return windows.add_carryover_previous_row(catalog.daily(inputs), CARRYOVER_PRODUCT)


@query(
    "carryover_prev_day",
    _CARRY,
    "daily",
    """SELECT d.*, coalesce(y.quantity, 0) AS gb_id_previous_day
       FROM daily d LEFT JOIN daily y ON y.gb_id = 7 AND y.gln = d.gln AND y.date = d.date - 1""",
)
def carryover_prev_day(inputs: Inputs) -> DataFrame:
    return windows.add_carryover_previous_day(catalog.daily(inputs), CARRYOVER_PRODUCT)


# --- store and product tables --------------------------------------------------------

_STORE = (
    "gln:long date:date quantity:long unit_price:double discount:double@9 on_promotion:double@9 kronemarked:int"
    " promo_combined:double@9 promotion_count:double closed_in_last_3_days:long closed_in_next_4_days:long"
    " is_holiday:int days_to_nearest_holiday:long day_of_week_num:int sin_dow:double cos_dow:double"
    " sin_day:double cos_day:double month:int quarter:int"
)
_LAGS = (
    "sales_lag_1:double sales_lag_7:double rolling_mean_7:double rolling_std_7:double rolling_mean_30:double"
    " rolling_std_30:double"
)
_SINCE = "days_since_last_kronemarked:long days_since_last_promotion:long"


@query(
    "sales_daily",
    f"{KEYS} quantity:long net_sales:double tax_amount:double gross_margin:double unit_price:double"
    " price_error:boolean ref_price:double corrected_unit_price:double price_correction_source:string"
    " standard_price:double discount:double@9 on_promotion:boolean kronemarked:boolean promo_combined:boolean"
    " on_promotion_recomputed:boolean conflict:boolean promotion_count:long avg_last_7_sales:double"
    " std_last_7_sales:double promotion_days_count_last_7:long day_of_week:string rolling_mean:double"
    " promotion_days_count_rolling:long rolling_mean_all:double closed_in_last_3_days:long"
    " closed_in_next_4_days:long last_holiday_type:string next_holiday_type:string"
    " days_to_nearest_holiday:long is_holiday:int gb_id_previous_day:long day_of_week_num:int sin_dow:double"
    " cos_dow:double day_of_year:int sin_day:double cos_day:double month:int quarter:int",
    "sales_daily",
    "sales_daily",
)
def sales_daily(inputs: Inputs) -> DataFrame:
    """The whole job from raw rows, not from processed tables."""
    return catalog.build_sales_daily(inputs)


@query("store_daily", _STORE, "store_daily", "store_daily")
def store_daily(inputs: Inputs) -> DataFrame:
    return datasets.aggregate_to_store_daily(catalog.features(inputs))


@query("store_temporal", f"gln:long date:date quantity:long {_LAGS}", "total", "total")
def store_temporal(inputs: Inputs) -> DataFrame:
    return windows.add_store_temporal_features(datasets.aggregate_to_store_daily(catalog.features(inputs)))


@query("days_since_event", f"gln:long date:date {_SINCE}", "total", "total")
def days_since_event(inputs: Inputs) -> DataFrame:
    return windows.add_days_since_events(datasets.aggregate_to_store_daily(catalog.features(inputs)))


@query("total_dataset", f"{_STORE} {_LAGS} {_SINCE}", "total", "total")
def total_dataset(inputs: Inputs) -> DataFrame:
    return datasets.total_dataset(catalog.features(inputs))


_PRODUCT = (
    f"{KEYS} quantity:long corrected_unit_price:double discount:double@9 on_promotion:boolean store_mean_discount:double@9"
    " store_mean_price:double store_promo_rate:double@9 discount_relative:double@9 price_relative:double@9"
    " promo_boost:double@9 target:double@9 avg_last_7_sales:double rolling_mean:double is_holiday:int"
)


@query("share_target", f"{KEYS} quantity:long store_total:long target:double@9", "share", "share")
def share_target(inputs: Inputs) -> DataFrame:
    return datasets.product_dataset(catalog.features(inputs), "share")


@query("share_dataset", f"{_PRODUCT} store_total:long", "share", "share")
def share_dataset(inputs: Inputs) -> DataFrame:
    return datasets.product_dataset(catalog.features(inputs), "share")


@query("direct_dataset", _PRODUCT, "relative", "SELECT *, quantity AS target FROM relative")
def direct_dataset(inputs: Inputs) -> DataFrame:
    table = datasets.product_dataset(catalog.features(inputs), "quantity")
    assert not {"store_total", *datasets.DROP_ALWAYS, *datasets.DROP_TEXT} & set(table.columns)
    return table


@query(
    "relative_features",
    f"{KEYS} discount_relative:double@9 price_relative:double@9 promo_boost:double@9",
    "relative",
    "relative",
)
def relative_features(inputs: Inputs) -> DataFrame:
    return datasets.product_dataset(catalog.features(inputs), "quantity")


_TOTAL_FEATURES = (
    "unit_price:double discount:double@9 kronemarked:int promo_combined:double@9 promotion_count:double"
    " closed_in_last_3_days:long closed_in_next_4_days:long is_holiday:int days_to_nearest_holiday:long"
    " day_of_week_num:int sin_dow:double cos_dow:double sin_day:double cos_day:double month:int sales_lag_1:double"
    " sales_lag_7:double rolling_mean_7:double rolling_std_7:double rolling_std_30:double"
    " days_since_last_kronemarked:long days_since_last_promotion:long"
)


@query("feature_select_total", f"{_TOTAL_FEATURES} label:double", "total", "SELECT *, quantity AS label FROM total")
def feature_select_total(inputs: Inputs) -> DataFrame:
    table = datasets.total_dataset(catalog.features(inputs))
    features, label = datasets.select_features(table, "xgb_total")
    assert features == [c.split(":")[0] for c in _TOTAL_FEATURES.split()]
    return table.select(*features, F.col(label).alias("label"))


_AUDITED = [c.split(":")[0] for c in _TOTAL_FEATURES.split()]
_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) AS n_rows, 1 - count({c}) / CAST(count(*) AS DOUBLE) AS null_share,
               count(DISTINCT {catalog.oracle.rounded(f"CAST({c} AS DOUBLE)", 6)}) AS n_distinct,
               CASE WHEN count(DISTINCT {c}) > 1 THEN corr(CAST({c} AS DOUBLE), CAST(quantity AS DOUBLE)) END AS label_corr FROM total"""
    for c in _AUDITED
)


@query(
    "feature_audit",
    "feature:string status:string reason:string recommendation:string horizon_days:int n_rows:long null_share:double"
    " n_distinct:long label_corr:double finding:string",
    "total",
    f"""SELECT feature, t.status, reason, recommendation, 7 AS horizon_days, n_rows, null_share, n_distinct, label_corr, finding
       FROM (SELECT *, CASE WHEN null_share >= 0.5e0 THEN 'empty' WHEN n_distinct <= 1 THEN 'constant'
                            WHEN abs(label_corr) >= 0.999e0 THEN 'copies label' ELSE 'none' END AS finding FROM ({_PROFILE})) p
       JOIN (SELECT * FROM (VALUES
          ('blocked', 'direct target/prediction artifact', 'remove from feature set'),
          ('known_future', 'explicitly listed as forecast-time available', 'safe to keep'),
          ('history_derived', 'looks history-derived (must be shift-safe)', 'keep only if computed from t-1 and earlier'),
          ('unknown', 'not matched by known-safe or history-derived rules', 'manual feature-availability review'))
          v(status, reason, recommendation)) t
         ON t.status = CASE WHEN finding = 'copies label' THEN 'blocked'
                            WHEN regexp_matches(feature, 'lag|rolling|days_since_last') THEN 'history_derived'
                            WHEN feature IN ('unit_price', 'closed_in_last_3_days') THEN 'unknown'
                            ELSE 'known_future' END""",
)
def feature_audit(inputs: Inputs) -> DataFrame:
    """Rules and row profile of the features that the total model gets from the written table."""
    table = datasets.total_dataset(catalog.features(inputs))
    features, label = datasets.select_features(table, "xgb_total")
    return guards.audit_table(table, features, label, 7)


# --- encodings and splits ------------------------------------------------------------

_SPLIT = "(SELECT max(date) FROM daily) - 365"


@query(
    "target_encode_store",
    "gln:long date:date gln_te:double",
    "store_daily",
    f"""SELECT s.gln, s.date, coalesce(m.te, (SELECT avg(quantity) FROM store_daily WHERE date < {_SPLIT})) AS gln_te
        FROM store_daily s
        LEFT JOIN (SELECT gln, avg(quantity) AS te FROM store_daily WHERE date < {_SPLIT} GROUP BY gln) m USING (gln)
        WHERE s.date >= {_SPLIT}""".replace("daily) - 365", "store_daily) - 365"),
)
def target_encode_store(inputs: Inputs) -> DataFrame:
    store = datasets.aggregate_to_store_daily(catalog.features(inputs))
    train, test = datasets.split_by_time(store, as_of(365, store), as_of(0, store))
    return datasets.encode_store(train, test)[1]


@query(
    "target_encode_product",
    f"{KEYS} gb_id_mean_target:double@9 promo_x_popularity:double@9",
    "share",
    f"""SELECT s.gln, s.gb_id, s.date, coalesce(m.te, g.te) AS gb_id_mean_target,
               CAST(on_promotion AS INTEGER) * coalesce(m.te, g.te) AS promo_x_popularity
        FROM share s
        LEFT JOIN (SELECT gb_id, avg(target) AS te FROM share WHERE date < {_SPLIT} GROUP BY gb_id) m USING (gb_id),
             (SELECT avg(target) AS te FROM share WHERE date < {_SPLIT}) g
        WHERE s.date >= {_SPLIT}""",
)
def target_encode_product(inputs: Inputs) -> DataFrame:
    share = datasets.product_dataset(catalog.features(inputs), "share")
    sales = catalog.features(inputs)
    train, test = datasets.split_by_time(share, as_of(365, sales), as_of(0, sales))
    return datasets.encode_product(train, test)[1]


@query(
    "split_by_time",
    "part:string gln:long gb_id:long date:date quantity:long",
    "daily",
    f"""SELECT CASE WHEN date < {_SPLIT} THEN 'train' ELSE 'test' END AS part, gln, gb_id, date, quantity FROM daily""",
)
def split_by_time(inputs: Inputs) -> DataFrame:
    table = catalog.daily(inputs)
    train, test = datasets.split_by_time(table, as_of(365, table), as_of(0, table))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "split_last_n",
    "part:string gln:long gb_id:long date:date quantity:long",
    "daily",
    """SELECT CASE WHEN date IN (SELECT DISTINCT date FROM daily ORDER BY date DESC LIMIT 7) THEN 'test'
                   ELSE 'train' END AS part, gln, gb_id, date, quantity FROM daily""",
)
def split_last_n(inputs: Inputs) -> DataFrame:
    train, test = datasets.split_last_n(catalog.daily(inputs), 7)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "time_folds",
    "date:date fold:int",
    "dates",
    "SELECT date, ntile(5) OVER (ORDER BY date) - 1 AS fold FROM dates",
)
def time_folds(inputs: Inputs) -> DataFrame:
    return datasets.time_folds(catalog.daily(inputs))


# --- series --------------------------------------------------------------------------


def product_series_of(inputs: Inputs) -> DataFrame:
    return datasets.product_series(catalog.daily(inputs).withColumn("target", F.col("quantity")))


@query(
    "product_series",
    "item_id:string date:date target:double@9 discount:double@9 is_holiday:int",
    "sales_daily",
    """SELECT gb_id || '_' || gln AS item_id, date, quantity AS target, discount, is_holiday FROM sales_daily""",
)
def product_series(inputs: Inputs) -> DataFrame:
    return datasets.product_series(
        catalog.features(inputs).withColumn("target", F.col("quantity")), ("discount", "is_holiday", "absent")
    )


@query(
    "densify_zero",
    "item_id:string date:date target:long",
    "grid",
    "SELECT gb_id || '_' || gln AS item_id, date, target FROM grid",
)
def densify_zero(inputs: Inputs) -> DataFrame:
    return windows.densify_zero(product_series_of(inputs))


@query(
    "densify_ffill",
    "item_id:string date:date target:long",
    "daily",
    """SELECT g.gb_id || '_' || g.gln AS item_id, g.date,
              last_value(d.quantity IGNORE NULLS) OVER (PARTITION BY g.gln, g.gb_id ORDER BY g.date) AS target
       FROM (SELECT gln, gb_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
             FROM daily GROUP BY gln, gb_id) g
       LEFT JOIN daily d ON d.gln = g.gln AND d.gb_id = g.gb_id AND d.date = g.date""",
)
def densify_ffill(inputs: Inputs) -> DataFrame:
    return windows.densify_ffill(product_series_of(inputs))


_SERIES_COLUMNS = (
    "item_id:string date:date target:double@9 day_of_week_num:int month:int is_holiday:int on_promotion:double@9"
    " discount:double@9 kronemarked:int promo_combined:double@9 promotion_count:double closed_in_next_4_days:long"
)
_FILL = ", ".join(
    f"last_value(s.{c} IGNORE NULLS) OVER w AS {c}"
    for c in "day_of_week_num month is_holiday on_promotion discount kronemarked promo_combined promotion_count"
    " closed_in_next_4_days".split()
)


@query(
    "store_series",
    _SERIES_COLUMNS,
    "store_daily",
    f"""SELECT CAST(g.gln AS VARCHAR) AS item_id, g.date, last_value(s.quantity IGNORE NULLS) OVER w AS target, {_FILL}
        FROM (SELECT gln, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
              FROM store_daily GROUP BY gln) g
        LEFT JOIN store_daily s ON s.gln = g.gln AND s.date = g.date
        WINDOW w AS (PARTITION BY g.gln ORDER BY g.date)""",
)
def store_series(inputs: Inputs) -> DataFrame:
    return datasets.store_series(datasets.aggregate_to_store_daily(catalog.features(inputs)))


# --- hierarchy -----------------------------------------------------------------------


@query(
    "normalize_shares",
    f"{KEYS} pred_share:double@9",
    "sales_daily",
    """SELECT gln, gb_id, date, rolling_mean / nullif(sum(rolling_mean) OVER (PARTITION BY gln, date), 0) AS pred_share
       FROM sales_daily""",
)
def normalize_shares(inputs: Inputs) -> DataFrame:
    """Weekday means of the products, scaled to shares of their store-day."""
    return datasets.normalize_shares(catalog.features(inputs).withColumn("pred_share", F.col("rolling_mean")))


@query(
    "hierarchical_reconcile",
    f"{KEYS} quantity:long pred_share:double@9 pred_total:double pred_quantity:double@9",
    "sales_daily total",
    """SELECT s.gln, s.gb_id, s.date, s.quantity, pred_share, t.rolling_mean_7 AS pred_total,
              pred_share * t.rolling_mean_7 AS pred_quantity
       FROM (SELECT gln, gb_id, date, quantity,
                    rolling_mean / nullif(sum(rolling_mean) OVER (PARTITION BY gln, date), 0) AS pred_share
             FROM sales_daily) s LEFT JOIN total t USING (gln, date)""",
)
def hierarchical_reconcile(inputs: Inputs) -> DataFrame:
    """Reconstruction with history means as the predicted share and total."""
    totals = datasets.total_dataset(catalog.features(inputs)).withColumn("pred_total", F.col("rolling_mean_7"))
    return datasets.reconcile(normalize_shares(inputs), totals)
