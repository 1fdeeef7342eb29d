"""Explicit input schemas. Nothing is inferred from data."""

from pyspark.sql import types as T

SALES_HOURLY = T.StructType(
    [
        T.StructField("gln", T.LongType()),
        T.StructField("ean_code", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("from_hour", T.IntegerType()),
        T.StructField("to_hour", T.IntegerType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("net_sales", T.DoubleType()),
        T.StructField("tax_amount", T.DoubleType()),
        T.StructField("gross_margin", T.DoubleType()),
    ]
)

EAN_MAP = T.StructType(
    [
        T.StructField("ean_code", T.LongType()),
        T.StructField("gb_id", T.StringType()),
        T.StructField("gb_ean_code", T.LongType()),
    ]
)

CAMPAIGN = T.StructType(
    [
        T.StructField("gb_id", T.StringType()),
        T.StructField("from_date", T.DateType()),
        T.StructField("to_date", T.DateType()),
        T.StructField("discount", T.DoubleType()),
        T.StructField("standard_price", T.DoubleType()),
        T.StructField("campaign_price", T.DoubleType()),
    ]
)

MARKDOWN_PERIODS = T.StructType(
    [
        T.StructField("from_date", T.DateType()),
        T.StructField("to_date", T.DateType()),
        T.StructField("kronemarked", T.IntegerType()),
    ]
)

# Column names of the raw files -> names used by the engine (fixed values).
RAW_COLUMN_NAMES = {
    "eanCode": "ean_code",
    "gb_eanCode": "gb_ean_code",
    "fromHour": "from_hour",
    "toHour": "to_hour",
    "netSalesKr": "net_sales",
    "taxAmount": "tax_amount",
    "grossMargin": "gross_margin",
    "fromDate": "from_date",
    "toDate": "to_date",
    "standardPrice": "standard_price",
    "campaignPrice": "campaign_price",
}
