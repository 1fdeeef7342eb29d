"""Data quality profiles and the tables behind the exploration plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.operators.guards import missing_counts
from demandloom.sources.staging import stage_lookup


def dataset_overview(df: DataFrame, date: str = "date", store: str = "gln", product: str | None = "gb_id") -> DataFrame:
    """Rows, columns, date range, and distinct dates, stores and products, as one row."""
    facts = [F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")]
    if date in df.columns:
        facts += [
            F.min(date).cast("string").alias("date_min"),
            F.max(date).cast("string").alias("date_max"),
            F.countDistinct(date).alias("n_dates"),
        ]
    if store in df.columns:
        facts.append(F.countDistinct(store).alias("n_stores"))
    if product and product in df.columns:
        facts.append(F.countDistinct(product).alias("n_products"))
    return df.agg(*facts)


def missingness_table(df: DataFrame, top_n: int = 30) -> DataFrame:
    """Missing values per column, most first: one aggregate, then one row per column."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    return (
        missing_counts(df, df.columns)
        .unpivot([], df.columns, "column", "missing_count")
        .withColumn("missing_pct", F.try_divide(F.col("missing_count") * 100.0, F.greatest(rows, F.lit(1))))
        .orderBy(F.desc("missing_count"), "column")
        .limit(top_n)
    )


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature_a, feature_b, n, corr): Pearson r of every pair of numeric columns.

    A row becomes its pairs of known values, and moments are partial aggregates keyed by the pair:
    the plan has the same size for any number of columns, and what is shuffled is one row of
    moments per pair and task. Only rows where both values are known count; a column that is
    constant there has no correlation (NULL).
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, n bigint, corr double")
    value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    names = F.array(*[F.lit(c) for c in columns])
    first = df.select(F.array(*[value(c) for c in columns]).alias("row")).select("row", F.posexplode("row").alias("i", "x"))
    rest = F.slice("row", F.col("i") + 2, len(columns))
    pairs = (
        first.filter(F.col("x").isNotNull())
        .select("i", "x", F.posexplode(rest).alias("k", "y"))
        .filter(F.col("y").isNotNull())
    )
    moments = pairs.groupBy("i", "k").agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop("x", "y").alias("xy"),
        (F.stddev_pop("x") * F.stddev_pop("y")).alias("spread"),
    )
    return moments.select(
        F.get(names, F.col("i")).alias("feature_a"),
        F.get(names, F.col("i") + F.col("k") + 1).alias("feature_b"),
        "n",
        F.try_divide("xy", "spread").alias("corr"),
    )


def high_correlation_pairs(df: DataFrame, threshold: float = 0.90, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of numeric columns with |Pearson r| >= threshold (rows where both are known)."""
    return (
        correlation_pairs(df.drop(*exclude))
        .select("feature_a", "feature_b", F.abs("corr").alias("corr_abs"))
        .filter(F.col("corr_abs") >= threshold)
        .orderBy(F.desc("corr_abs"), "feature_a", "feature_b")
    )


def _with_span(df: DataFrame, first: str, last: str, active: str) -> DataFrame:
    return df.withColumn("span_days", F.datediff(last, first) + 1).withColumn(
        "coverage_ratio", F.try_divide(F.col(active), F.nullif("span_days", F.lit(0)))
    )


def sales_coverage(df: DataFrame, store: str = "gln", date: str = "date", product: str = "gb_id") -> DataFrame:
    """Date span, active days, rows and products per store.

    Spark expands the distinct counts to partial aggregates per (store, value), so the rows of
    a hot store are counted on many tasks before its few distinct days and products meet.
    """
    if store not in df.columns or date not in df.columns:
        raise ValueError(f"columns not found: {store}, {date}")
    facts = [
        F.min(date).alias("date_min"),
        F.max(date).alias("date_max"),
        F.countDistinct(date).alias("n_days"),
        F.count(F.lit(1)).alias("n_rows"),
    ]
    if product in df.columns:
        facts.append(F.countDistinct(product).alias("n_products"))
    return df.groupBy(store).agg(*facts).transform(_with_span, "date_min", "date_max", "n_days")


def product_record_counts(df: DataFrame, store: str = "gln", product: str = "gb_id", date: str = "date") -> DataFrame:
    missing = [c for c in (store, product, date) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return (
        df.groupBy(store, product)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.countDistinct(date).alias("n_active_days"),
            F.min(date).alias("first_date"),
            F.max(date).alias("last_date"),
        )
        .transform(_with_span, "first_date", "last_date", "n_active_days")
    )


def store_record_summary(records: DataFrame) -> DataFrame:
    """Mean and median rows, mean coverage and product count per store (input: one row per product)."""
    return records.groupBy("gln").agg(
        F.avg("n_rows").alias("mean_rows"),
        F.median("n_rows").alias("median_rows"),
        F.avg("coverage_ratio").alias("mean_coverage"),
        F.countDistinct("gb_id").alias("n_products"),
    )


def low_coverage(records: DataFrame, n: int = 20) -> DataFrame:
    label = F.concat_ws(" | ", F.col("gln").cast("string"), F.col("gb_id").cast("string"))
    return records.withColumn("store_product", label).orderBy("coverage_ratio", "gln", "gb_id").limit(n)


def anomaly_summary(dispersion: DataFrame, suspicious: DataFrame) -> DataFrame:
    """Case counts and affected stores of both anomaly tables, as one row."""

    def facts(df: DataFrame, cases: str, stores: str) -> DataFrame:
        return df.groupBy("gln").agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias(cases), F.count("gln").alias(stores)
        )

    hourly = facts(dispersion, "n_hourly_dispersion_cases", "stores_with_hourly_dispersion")
    daily = facts(suspicious, "n_suspicious_daily_rows", "stores_with_suspicious_daily_prices")
    return hourly.withColumns(
        {c: daily.select(c).scalar() for c in ("n_suspicious_daily_rows", "stores_with_suspicious_daily_prices")}
    )


def dispersion_by_store(dispersion: DataFrame) -> DataFrame:
    return dispersion.groupBy("gln").agg(F.count(F.lit(1)).alias("n_cases")).orderBy(F.desc("n_cases"), "gln")


def anomalies_by_store(dispersion: DataFrame, suspicious: DataFrame) -> DataFrame:
    hourly = dispersion.groupBy("gln").agg(F.count(F.lit(1)).alias("n_hourly_dispersion"))
    daily = suspicious.groupBy("gln").agg(F.count(F.lit(1)).alias("n_suspicious_daily"))
    counts = ["n_hourly_dispersion", "n_suspicious_daily"]
    return (
        hourly.join(daily, "gln", "full_outer")
        .fillna(0, subset=counts)
        .withColumn("n_total_price_anomalies", F.col(counts[0]) + F.col(counts[1]))
        .orderBy(F.desc("n_total_price_anomalies"), "gln")
    )


CASE_KEYS = ["gln", "gb_id", "date"]


def anomaly_sample(cases: DataFrame, n: int = 5, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """The same ``n`` pseudo-random cases on every run, of each group of ``by`` if given.

    A bottom-k sample by the MD5 of seed and keys: each task keeps its own ``n`` smallest (of each
    group) before anything is shuffled, so no table and no hot group is sorted whole. A sample of
    all cases then holds the smallest of what the tasks kept; ties of the hash fall to the keys.
    """
    keys = [c for c in CASE_KEYS if c in cases.columns]
    order = [F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])), *keys]
    if not by:
        return cases.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return cases.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def price_paths(sample: DataFrame, prices: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """Price rows of the sampled cases: the rows of ``prices`` with the same ``keys``.

    ``facts`` are the columns kept from the sample; its date is called ``case_date``. A sample has a
    bounded number of rows per group, so it is broadcast behind a count.
    """
    named = sample.select(*keys, *[F.col(c) for c in facts], F.col("date").alias("case_date")).distinct()
    return prices.join(stage_lookup(named, "sampled_cases"), keys)


def dispersion_paths(cases: DataFrame, hourly: DataFrame, n: int = 5, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """Hourly prices of the sampled days whose prices vary."""
    return price_paths(anomaly_sample(cases, n, seed, by), hourly, CASE_KEYS, ["rel_diff"])


def suspicious_paths(cases: DataFrame, daily: DataFrame, n: int = 5, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """Daily prices of the whole series of each sampled suspicious row."""
    return price_paths(anomaly_sample(cases, n, seed, by), daily, CASE_KEYS[:2], [])


def monthly_store_sales(sales: DataFrame) -> DataFrame:
    """Quantity per month and store; infinite, missing or undated rows are left out."""
    amount = F.col("quantity").cast("double")
    finite = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) != float("inf"))
    return (
        sales.filter(finite & F.col("date").isNotNull())
        .groupBy(F.date_format("date", "yyyy-MM").alias("month"), "gln")
        .agg(F.sum("quantity").alias("quantity"))
    )


def product_mix(
    sales: DataFrame,
    time_unit: str = "M",
    start_date: str | None = None,
    month: str | None = None,
    days: int = 30,
) -> DataFrame:
    """Quantity per store, period and product: by month, by day of ``days`` days, or by day of one month."""
    if month is not None:
        period = F.date_format("date", "yyyy-MM-dd")
        chosen = sales.filter(F.date_trunc("month", "date") == F.lit(f"{month}-01").cast("timestamp"))
    elif time_unit == "M":
        period, chosen = F.date_format("date", "yyyy-MM"), sales
    elif time_unit == "D" and start_date:
        period = F.date_format("date", "yyyy-MM-dd")
        first = F.lit(start_date).cast("date")
        chosen = sales.filter((F.col("date") >= first) & (F.col("date") < F.date_add(first, days)))
    else:
        raise ValueError("give time_unit M, or D with a start_date, or a month")
    return chosen.groupBy("gln", period.alias("period"), "gb_id").agg(F.sum("quantity").alias("quantity"))


def product_mix_pivot(mix: DataFrame, products: list) -> DataFrame:
    """Store-period rows with one 0-filled column per listed product.

    The long table of :func:`product_mix` serves any number of products; the wide form is for
    a known, listed set, because a table cannot have a column per product of a whole chain.
    """
    wide = mix.groupBy("gln", "period").pivot("gb_id", products).agg(F.sum("quantity"))
    return wide.fillna(0).select("gln", "period", *[F.col(f"`{p}`").alias(f"product_{p}") for p in products])


# Upper bounds (right-closed) and names of the discount bands (fixed values).
DISCOUNT_BANDS = [
    (-1.0, -0.30, "Large Discount (-30%)"),
    (-0.30, -0.15, "Medium Discount (-15%)"),
    (-0.15, -0.05, "Small Discount"),
]


def discount_bands(sales: DataFrame) -> DataFrame:
    """Rows per date, store and discount band."""
    value = F.col("discount")
    bands = [F.when((value > low) & (value <= high), name) for low, high, name in DISCOUNT_BANDS]
    return (
        sales.withColumn("discount_category", F.coalesce(*bands))
        .filter(F.col("discount_category").isNotNull())
        .groupBy("date", "gln", "discount_category")
        .agg(F.count(F.lit(1)).alias("count"))
    )
