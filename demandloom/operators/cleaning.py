"""From raw hourly rows to clean hourly and daily tables, with quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.rounding import round_to
from demandloom.sources.staging import broadcast_if_small

HOUR_KEYS = ["gln", "gb_id", "date", "from_hour", "to_hour"]
DAY_KEYS = ["gln", "gb_id", "date"]
MONEY = ["net_sales", "tax_amount", "gross_margin"]

# Plausible daily price range and intra-day dispersion limit (fixed values).
LOW_PRICE = 5.0
HIGH_PRICE = 65.0
DISPERSION_LIMIT = 0.15

# Millionths of money are summed as a multiple of this and a rest, so that sums of 2**36 rows stay whole numbers of 64 bits.
LIMB = 2**26


def distinct_rows(sales: DataFrame) -> DataFrame:
    """Drop exact copies. Copies collapse inside each map task before the shuffle, and the
    shuffle key is the whole row, so no key or group of copies can overload a task."""
    return sales.dropDuplicates()


def unit_price() -> Column:
    """(net + tax) / quantity to three decimals; NULL where nothing was sold."""
    return round_to(F.try_divide(F.col("net_sales") + F.col("tax_amount"), F.col("quantity")), 3)


def implausible_price(low: float = LOW_PRICE, high: float = HIGH_PRICE) -> Column:
    """Out of range, or money booked on zero quantity (an infinite price)."""
    out_of_range = (F.col("unit_price") < low) | (F.col("unit_price") > high)
    money_without_goods = (F.col("quantity") == 0) & (F.col("net_sales") + F.col("tax_amount") != 0)
    return F.coalesce(out_of_range | money_without_goods, F.lit(False))


def mapping_conflicts(ean_map: DataFrame) -> DataFrame:
    """Barcodes that point to more than one product."""
    return (
        ean_map.groupBy("ean_code")
        .agg(F.countDistinct("gb_id").alias("gb_id_count"))
        .filter(F.col("gb_id_count") > 1)
    )


def barcode_lookup(ean_map: DataFrame) -> DataFrame:
    """One product per barcode; a barcode with two products fails the job when it runs."""
    product_type = ean_map.schema["gb_id"].dataType
    message = F.concat(F.lit("barcode maps to several products: "), F.col("ean_code").cast("string"))
    return (
        ean_map.filter(F.col("gb_id").isNotNull())
        .groupBy("ean_code")
        .agg(F.min("gb_id").alias("low"), F.max("gb_id").alias("high"))
        .select(
            "ean_code",
            F.when(F.col("low") == F.col("high"), F.col("low"))
            .otherwise(F.raise_error(message).cast(product_type))
            .alias("gb_id"),
        )
    )


def unmapped_barcodes(sales: DataFrame, ean_map: DataFrame) -> DataFrame:
    """Rows and units lost because the barcode has no product."""
    known = ean_map.filter(F.col("gb_id").isNotNull()).select("ean_code")
    return (
        sales.groupBy("ean_code")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("quantity").alias("quantity"))
        .join(known, "ean_code", "left_anti")
    )


def mapping_overlap(sales: DataFrame, ean_map: DataFrame) -> DataFrame:
    """Unmapped barcodes that do occur as ``gb_ean_code`` of some product."""
    missing = unmapped_barcodes(sales, ean_map).select("ean_code")
    return missing.join(ean_map.select(F.col("gb_ean_code").alias("ean_code")), "ean_code", "left_semi")


def map_products(sales: DataFrame, ean_map: DataFrame) -> DataFrame:
    """Whole-number quantity (half to even) and product id; unmapped rows drop out.

    The barcode lookup is broadcast when its counted size allows. Beyond that the join
    shuffles and AQE splits the partitions of hot barcodes.
    """
    lookup = broadcast_if_small(barcode_lookup(ean_map))
    whole = F.bround("quantity").cast("bigint")
    return sales.withColumn("quantity", whole).join(lookup, "ean_code")


def money_sum(column: str) -> Column:
    """Sum in whole millionths. Sums of doubles depend on the order in which partitions arrive,
    which would flip roundings from run to run; sums of whole numbers do not.

    Nothing is left out: NaN, infinite and immense amounts (1e24 and more) are summed as doubles and
    show in the result. Up to 2**53 millionths an amount is summed in two whole numbers, which costs a
    fraction of a decimal sum; larger ones are summed as decimals.
    """
    amount = F.col(column)
    usual = F.abs(amount) < 1e24  # NaN counts as larger
    millionths = F.rint(amount * 1e6)
    exact = F.abs(millionths) < 2.0**53
    high = F.when(exact, (millionths / LIMB).cast("bigint"))
    low = F.when(exact, millionths.cast("bigint") % F.lit(LIMB).cast("bigint"))
    parts = F.sum(high).cast("decimal(20,0)") * F.lit(LIMB).cast("decimal(10,0)") + F.sum(low).cast("decimal(20,0)")
    larger = F.sum(F.when(usual & ~exact, millionths.cast("decimal(30,0)")))
    whole = F.when(larger.isNull(), parts).otherwise(larger + F.coalesce(parts, F.lit(0))).cast("double") / F.lit(1e6)
    other = F.sum(F.when(~usual, amount))
    return F.when(other.isNull(), whole).otherwise(other + F.coalesce(whole, F.lit(0.0)))


def _rollup(mapped: DataFrame, keys: list[str]) -> DataFrame:
    return mapped.groupBy(*keys).agg(F.sum("quantity").alias("quantity"), *[money_sum(c).alias(c) for c in MONEY])


def _cents(df: DataFrame) -> DataFrame:
    return df.withColumns({c: round_to(c, 3) for c in MONEY})


def hourly_rollup(mapped: DataFrame) -> DataFrame:
    """All barcodes of a product summed per store and hour. The price uses unrounded money."""
    return _rollup(mapped, HOUR_KEYS).withColumn("unit_price", unit_price()).transform(_cents)


def daily_rollup(mapped: DataFrame) -> DataFrame:
    """Per store, product and day. Summed straight from the mapped rows: map-side partial sums
    absorb hot keys, and one shuffle is saved against rolling up the hourly table."""
    return _rollup(mapped, DAY_KEYS).transform(_cents).withColumn("unit_price", unit_price())


def price_dispersion(hourly: DataFrame, limit: float = DISPERSION_LIMIT) -> DataFrame:
    """Store-product-days whose hourly prices vary by more than ``limit`` of their mean."""
    return (
        hourly.groupBy(*DAY_KEYS)
        .agg(F.avg("unit_price").alias("mean_price"), F.stddev_samp("unit_price").alias("std_price"))
        .withColumn("rel_diff", round_to(F.try_divide("std_price", "mean_price"), 3))
        .withColumns({c: round_to(c, 3) for c in ["mean_price", "std_price"]})
        .filter(F.col("rel_diff") > limit)
    )


def suspicious_prices(daily: DataFrame, low: float = LOW_PRICE, high: float = HIGH_PRICE) -> DataFrame:
    return daily.filter(implausible_price(low, high))


def preprocess_sales(
    sales: DataFrame, ean_map: DataFrame, dispersion_limit: float = DISPERSION_LIMIT
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(hourly, daily, dispersion cases, suspicious daily rows)."""
    mapped = sales.transform(distinct_rows).transform(map_products, ean_map)
    hourly = hourly_rollup(mapped)
    daily = daily_rollup(mapped)
    return hourly, daily, price_dispersion(hourly, dispersion_limit), suspicious_prices(daily)
