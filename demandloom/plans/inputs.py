"""The engine's input tables as views over a folder of star-schema Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRODUCTS = 40
STORES = 11
CARRYOVER_PRODUCT = 7
FIRST_DAY = "1995-01-02"


@dataclass(frozen=True)
class Inputs:
    """Lazy input tables of one data folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def sales_hourly(self) -> DataFrame:
        list_price = F.lit(4.6) + F.lit(1.5) * (F.col("l_partkey") % PRODUCTS)
        net = F.col("l_quantity") * list_price * (F.lit(1) - F.lit(2) * F.col("l_discount"))
        return self.table("lineitem").select(
            (F.col("l_suppkey") % STORES).alias("gln"),
            F.col("l_partkey").alias("ean_code"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_linenumber").alias("from_hour"),
            (F.col("l_linenumber") + 1).alias("to_hour"),
            F.col("l_quantity").alias("quantity"),
            net.alias("net_sales"),
            (net * F.col("l_tax")).alias("tax_amount"),
            (net * F.lit(0.3)).alias("gross_margin"),
        )

    @property
    def ean_map(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("ean_code"), (F.col("p_partkey") % PRODUCTS).alias("gb_id")
        )

    @property
    def partial_ean_map(self) -> DataFrame:
        """A map that misses one part type and names a second barcode per product."""
        return (
            self.table("part")
            .filter(F.col("p_type") != "ECONOMY")
            .select(
                F.col("p_partkey").alias("ean_code"),
                (F.col("p_partkey") % PRODUCTS).alias("gb_id"),
                (F.col("p_partkey") + 1).alias("gb_ean_code"),
            )
        )

    @property
    def doubtful_ean_map(self) -> DataFrame:
        """Two sources that disagree about the product of many barcodes."""
        by_size = self.table("part").select(
            F.col("p_partkey").alias("ean_code"), (F.col("p_size") % PRODUCTS).cast("bigint").alias("gb_id")
        )
        return self.ean_map.union(by_size)

    @property
    def campaign(self) -> DataFrame:
        start = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("p_partkey") * 37 % 2400).cast("int"))
        standard = F.lit(4.6) + F.lit(1.5) * F.col("gb_id")
        return (
            self.table("part")
            .filter(F.col("p_partkey") < 120)
            .withColumns({"gb_id": F.col("p_partkey") % PRODUCTS, "from_date": start})
            .select(
                "gb_id",
                "from_date",
                F.date_add("from_date", (F.col("p_size") % 14).cast("int")).alias("to_date"),
                F.lit(-0.2).alias("discount"),
                standard.alias("standard_price"),
                (standard * F.lit(0.8)).alias("campaign_price"),
            )
        )

    @property
    def offers(self) -> DataFrame:
        """Declared offers of every part, some with a wrong discount: input of the consistency check."""
        return self.table("part").select(
            F.col("p_partkey").alias("offer_id"),
            F.col("p_retailprice").alias("standard_price"),
            (F.col("p_retailprice") * (F.lit(1.0) - F.col("p_size") / F.lit(100.0))).alias("campaign_price"),
            (-(F.col("p_size") % 25) / F.lit(100.0)).alias("discount"),
        )

    @property
    def markdown_periods(self) -> DataFrame:
        start = F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("n_nationkey") * 100)
        return (
            self.table("nation")
            .select(start.alias("from_date"))
            .select("from_date", F.date_add("from_date", 6).alias("to_date"), F.lit(1).alias("kronemarked"))
        )


def as_of(days_before_last: int, df: DataFrame) -> Column:
    """A date ``days_before_last`` days before the last date of ``df``."""
    return F.date_sub(df.agg(F.max("date")).scalar(), days_before_last)
