"""Queries for sources, cleaning, prices, promotions and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom import schemas
from demandloom.operators import calendar_dim, cleaning, datasets, guards, pricing, promotions
from demandloom.plans import catalog
from demandloom.plans.catalog import query
from demandloom.plans.inputs import Inputs
from demandloom.sources import files
from demandloom.sources.staging import new_folder

HOURLY = (
    "gln:long gb_id:long date:date from_hour:int to_hour:int quantity:long net_sales:double tax_amount:double"
    " gross_margin:double unit_price:double"
)
DAILY = "gln:long gb_id:long date:date quantity:long net_sales:double tax_amount:double gross_margin:double unit_price:double"
RAW = (
    "gln:long ean_code:long date:date from_hour:int to_hour:int quantity:double net_sales:double"
    " tax_amount:double gross_margin:double"
)


def _mapped(inputs: Inputs) -> DataFrame:
    return inputs.sales_hourly.transform(cleaning.distinct_rows).transform(cleaning.map_products, inputs.ean_map)


def _hourly(inputs: Inputs) -> DataFrame:
    return cleaning.hourly_rollup(_mapped(inputs))


def _dispersion(inputs: Inputs) -> DataFrame:
    return cleaning.price_dispersion(_hourly(inputs))


# --- sources and sinks ---------------------------------------------------------------


@query("csv_folder_scan", RAW, "sales_hourly", "sales_hourly")
def csv_folder_scan(inputs: Inputs) -> DataFrame:
    """Hourly sales written as nested CSV folders, then read back through the folder source."""
    folder = new_folder(inputs.spark, "csv")
    sales = inputs.sales_hourly
    (
        sales.withColumn("sales_year", F.year("date"))
        .select("sales_year", *sales.columns)
        .write.partitionBy("sales_year")
        .option("header", True)
        .csv(folder)
    )
    return files.read_csv_folder(inputs.spark, folder, schemas.SALES_HOURLY)


@query(
    "numeric_if_all_parse",
    "gln:long eans:string n:long",
    "",
    """SELECT l_suppkey % 11 AS gln, 'ean-' || (l_partkey % 10) AS eans, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def numeric_if_all_parse(inputs: Inputs) -> DataFrame:
    text = inputs.sales_hourly.select(
        F.col("gln").cast("string").alias("gln"), F.concat(F.lit("ean-"), F.col("ean_code") % 10).alias("eans")
    )
    typed = files.numeric_if_all_parse(text, ["gln", "eans"])
    assert dict(typed.dtypes) == {"gln": "bigint", "eans": "string"}
    return typed.groupBy("gln", "eans").agg(F.count(F.lit(1)).alias("n"))


@query("parquet_roundtrip", DAILY, "daily", "daily")
def parquet_roundtrip(inputs: Inputs) -> DataFrame:
    folder = new_folder(inputs.spark, "roundtrip")
    files.write_table(cleaning.daily_rollup(_mapped(inputs)), folder)
    return files.read_table(inputs.spark, folder)


# --- cleaning ------------------------------------------------------------------------


@query(
    "dedup_raw", RAW, "sales_hourly", "SELECT * FROM sales_hourly UNION SELECT * FROM sales_hourly"
)
def dedup_raw(inputs: Inputs) -> DataFrame:
    return cleaning.distinct_rows(inputs.sales_hourly.union(inputs.sales_hourly))


query("hourly_rollup", HOURLY, "hourly", "hourly")(_hourly)


@query("daily_rollup", DAILY, "daily", "daily")
def daily_rollup(inputs: Inputs) -> DataFrame:
    return cleaning.daily_rollup(_mapped(inputs))


@query(
    "unit_price",
    "gln:long ean_code:long date:date from_hour:int unit_price:double",
    "sales_hourly",
    """SELECT gln, ean_code, date, from_hour,
              round_even((net_sales + tax_amount) / nullif(quantity, 0) * 1e3, 0) / 1e3 AS unit_price FROM sales_hourly""",
)
def unit_price(inputs: Inputs) -> DataFrame:
    return inputs.sales_hourly.withColumn("unit_price", cleaning.unit_price())


@query(
    "unmapped_barcodes",
    "ean_code:long n_rows:long quantity:double",
    "sales_hourly",
    """SELECT ean_code, count(*) AS n_rows, sum(quantity) AS quantity FROM sales_hourly
       WHERE ean_code NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY') GROUP BY ean_code""",
)
def unmapped_barcodes(inputs: Inputs) -> DataFrame:
    return cleaning.unmapped_barcodes(inputs.sales_hourly, inputs.partial_ean_map)


@query(
    "mapping_overlap",
    "ean_code:long",
    "sales_hourly",
    """SELECT DISTINCT ean_code FROM sales_hourly
       WHERE ean_code NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY')
         AND ean_code IN (SELECT p_partkey + 1 FROM part WHERE p_type <> 'ECONOMY')""",
)
def mapping_overlap(inputs: Inputs) -> DataFrame:
    return cleaning.mapping_overlap(inputs.sales_hourly, inputs.partial_ean_map)


@query(
    "mapping_conflicts",
    "ean_code:long gb_id_count:long",
    "",
    """SELECT p_partkey AS ean_code, 2 AS gb_id_count FROM part WHERE p_partkey % 40 <> p_size % 40""",
)
def mapping_conflicts(inputs: Inputs) -> DataFrame:
    return cleaning.mapping_conflicts(inputs.doubtful_ean_map)


query(
    "price_dispersion",
    "gln:long gb_id:long date:date mean_price:double std_price:double rel_diff:double",
    "dispersion",
    "dispersion",
)(_dispersion)


@query("suspicious_prices", DAILY, "suspicious", "suspicious")
def suspicious_prices(inputs: Inputs) -> DataFrame:
    return cleaning.suspicious_prices(cleaning.daily_rollup(_mapped(inputs)))


# --- prices --------------------------------------------------------------------------


@query(
    "price_correction",
    "gln:long gb_id:long date:date unit_price:double price_error:boolean ref_store_price:double"
    " ref_global_price:double ref_price:double corrected_unit_price:double price_corrected_flag:boolean"
    " price_correction_source:string",
    "priced",
    "priced",
)
def price_correction(inputs: Inputs) -> DataFrame:
    return pricing.correct_daily_unit_price(catalog.daily(inputs))


@query(
    "promo_hysteresis",
    "gln:long gb_id:long date:date unit_price:double standard_price:double on_promotion:boolean discount:double",
    "promoted",
    "promoted",
)
def promo_hysteresis(inputs: Inputs) -> DataFrame:
    return pricing.standard_price_and_discount(catalog.daily(inputs))


@query(
    "rolling_top5_price",
    "gln:long gb_id:long date:date rolling_max_price:double",
    "numbered",
    """SELECT gln, gb_id, date, list_avg(list_reverse_sort(list(unit_price) OVER (
              PARTITION BY gb_id ORDER BY rn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))[1:5]) AS rolling_max_price
       FROM numbered""",
)
def rolling_top5_price(inputs: Inputs) -> DataFrame:
    return pricing.rolling_top_price(catalog.daily(inputs))


# --- promotions ----------------------------------------------------------------------

_PROMO_KEYS = "gln:long gb_id:long date:date"


@query(
    "campaign_days",
    "gb_id:long date:date discount:double",
    "campaign",
    """SELECT gb_id, CAST(unnest(generate_series(from_date, to_date, INTERVAL 1 DAY)) AS DATE) AS date, discount
       FROM campaign""",
)
def campaign_days(inputs: Inputs) -> DataFrame:
    return promotions.campaign_days(inputs.campaign, keep=("discount",))


@query(
    "campaign_interval_join",
    f"{_PROMO_KEYS} quantity:long declared_promotion:boolean declared_discount:double"
    " declared_standard_price:double declared_campaign_price:double",
    "daily campaign",
    """SELECT s.gln, s.gb_id, s.date, s.quantity, c.discount IS NOT NULL AS declared_promotion,
              coalesce(c.discount, 0) AS declared_discount,
              coalesce(c.standard_price, 0) AS declared_standard_price,
              coalesce(c.campaign_price, 0) AS declared_campaign_price
       FROM daily s LEFT JOIN campaign c ON c.gb_id = s.gb_id AND s.date BETWEEN c.from_date AND c.to_date""",
)
def campaign_interval_join(inputs: Inputs) -> DataFrame:
    return promotions.campaign_interval_join(catalog.daily(inputs), inputs.campaign)


@query(
    "markdown_interval_join",
    f"{_PROMO_KEYS} quantity:long kronemarked:boolean",
    "daily markdown_periods",
    """SELECT s.gln, s.gb_id, s.date, s.quantity, k.kronemarked IS NOT NULL AS kronemarked
       FROM daily s LEFT JOIN markdown_periods k ON s.date BETWEEN k.from_date AND k.to_date""",
)
def markdown_interval_join(inputs: Inputs) -> DataFrame:
    return promotions.markdown_interval_join(catalog.daily(inputs), inputs.markdown_periods)


def _joined(inputs: Inputs) -> DataFrame:
    return promotions.add_promotion_features(
        catalog.promoted(inputs), inputs.campaign, inputs.markdown_periods, calendar=catalog.daily(inputs)
    )


@query(
    "discount_reconcile",
    f"{_PROMO_KEYS} unit_price:double standard_price:double discount:double on_promotion:boolean"
    " kronemarked:boolean promo_combined:boolean on_promotion_recomputed:boolean conflict:boolean",
    "reconciled",
    "reconciled",
)
def discount_reconcile(inputs: Inputs) -> DataFrame:
    return promotions.reconcile_discount(_joined(inputs))[0]


@query(
    "discount_mismatch",
    f"{_PROMO_KEYS} standard_price:double declared_standard_price:double",
    "flagged",
    "SELECT * FROM flagged WHERE differs",
)
def discount_mismatch(inputs: Inputs) -> DataFrame:
    return promotions.reconcile_discount(_joined(inputs))[1]


@query(
    "promotion_count",
    f"{_PROMO_KEYS} promotion_count:long",
    "promoted",
    """SELECT gln, gb_id, date, sum(CAST(on_promotion AS INTEGER)) OVER (PARTITION BY gln, date) AS promotion_count
       FROM promoted""",
)
def promotion_count(inputs: Inputs) -> DataFrame:
    return promotions.add_promotion_count(catalog.promoted(inputs))


@query(
    "campaign_consistency",
    "offer_id:long discount:double discount_implied:double discount_diff_abs:double",
    "",
    """SELECT offer_id, discount, implied AS discount_implied, abs(discount - implied) AS discount_diff_abs
       FROM (SELECT p_partkey AS offer_id, -(p_size % 25) / 100e0 AS discount,
                    -(1 - p_retailprice * (1 - p_size / 100e0) / nullif(p_retailprice, 0)) AS implied FROM part)
       WHERE abs(discount - implied) > 0.03e0""",
)
def campaign_consistency(inputs: Inputs) -> DataFrame:
    return promotions.campaign_discount_consistency(inputs.offers)[1]


@query(
    "campaign_vs_sales",
    "on_campaign:int on_promotion:boolean n_rows:long",
    "promoted campaign",
    """SELECT CASE WHEN c.gb_id IS NULL THEN 0 ELSE 1 END AS on_campaign, on_promotion, count(*) AS n_rows
       FROM promoted s LEFT JOIN campaign c ON c.gb_id = s.gb_id AND s.date BETWEEN c.from_date AND c.to_date
       GROUP BY 1, 2""",
)
def campaign_vs_sales(inputs: Inputs) -> DataFrame:
    return promotions.campaign_vs_sales(catalog.promoted(inputs), promotions.campaign_days(inputs.campaign))


# --- calendar ------------------------------------------------------------------------


@query("holiday_calendar", "holiday_date:date holiday_name:string", "holidays", "holidays")
def holiday_calendar(inputs: Inputs) -> DataFrame:
    return catalog.holidays(inputs)


@query(
    "holiday_types",
    "holiday_date:date holiday_name:string holiday_type:string",
    "holiday_types",
    "holiday_types",
)
def holiday_types(inputs: Inputs) -> DataFrame:
    return calendar_dim.holiday_types(catalog.holidays(inputs))


@query("closed_dates", "closed_date:date", "closed", "closed")
def closed_dates(inputs: Inputs) -> DataFrame:
    return calendar_dim.closed_dates(calendar_dim.distinct_dates(catalog.daily(inputs)), catalog.holidays(inputs))


@query(
    "nearest_holiday",
    "date:date last_holiday_type:string next_holiday_type:string days_to_nearest_holiday:long",
    "holiday_dim",
    "holiday_dim",
)
def nearest_holiday(inputs: Inputs) -> DataFrame:
    return calendar_dim.nearest_holiday(calendar_dim.distinct_dates(catalog.daily(inputs)), catalog.holidays(inputs))


@query(
    "holiday_features",
    "gln:long gb_id:long date:date closed_in_last_3_days:long closed_in_next_4_days:long last_holiday_type:string"
    " next_holiday_type:string days_to_nearest_holiday:long is_holiday:int",
    "daily holiday_dim",
    "SELECT d.gln, d.gb_id, h.* FROM daily d JOIN holiday_dim h USING (date)",
)
def holiday_features(inputs: Inputs) -> DataFrame:
    return calendar_dim.add_holiday_features(catalog.daily(inputs), catalog.holidays(inputs))


_SEASONS = "day_of_week_num:int sin_dow:double cos_dow:double sin_day:double cos_day:double month:int quarter:int"


@query(
    "seasonality",
    f"gln:long gb_id:long date:date {_SEASONS} day_of_year:int",
    "daily",
    f"SELECT *, {catalog.oracle.CALENDAR} FROM daily",
)
def seasonality(inputs: Inputs) -> DataFrame:
    return calendar_dim.add_seasonality_features(catalog.daily(inputs))


@query(
    "future_covariates",
    f"item_id:string date:date {_SEASONS} on_promotion:int discount:int",
    "daily",
    f"""SELECT item_id, date, {catalog.oracle.CALENDAR}, 0 AS on_promotion, 0 AS discount
        FROM (SELECT gb_id || '_' || gln AS item_id,
                     max(date) + CAST(unnest(range(1, 8)) AS INTEGER) AS date FROM daily GROUP BY gb_id, gln)""",
)
def future_covariates(inputs: Inputs) -> DataFrame:
    series = datasets.product_series(catalog.daily(inputs).withColumn("target", F.col("quantity")))
    return calendar_dim.future_covariates(series, 7, ("on_promotion", "discount"))


# --- guards --------------------------------------------------------------------------


@query(
    "null_gate",
    "quantity:long unit_price:long",
    "daily",
    """SELECT count(*) FILTER (quantity IS NULL) AS quantity, count(*) FILTER (unit_price IS NULL) AS unit_price
       FROM daily""",
)
def null_gate(inputs: Inputs) -> DataFrame:
    return guards.missing_counts(catalog.daily(inputs), ["quantity", "unit_price"])


@query(
    "normalize_key",
    "raw:string key:string n:long",
    "daily",
    """SELECT raw, key, count(*) AS n FROM (
         SELECT CAST(CAST(gln AS DOUBLE) AS VARCHAR) AS raw, CAST(gln AS VARCHAR) AS key FROM daily
         UNION ALL SELECT '00' || gb_id, '00' || gb_id FROM daily) GROUP BY ALL""",
)
def normalize_key(inputs: Inputs) -> DataFrame:
    daily = catalog.daily(inputs)
    stores = daily.select(F.col("gln").cast("double").alias("raw"))
    texts = daily.select(F.concat(F.lit("00"), F.col("gb_id")).alias("raw"))
    keyed = [
        df.select(F.col("raw").cast("string").alias("raw"), datasets.normalized_key(df, "raw").alias("key"))
        for df in (stores, texts)
    ]
    return keyed[0].unionByName(keyed[1]).groupBy("raw", "key").agg(F.count(F.lit(1)).alias("n"))
