"""File sources and sinks: nested CSV folders, dimension files, Parquet tables, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom import schemas
from demandloom.sources.staging import stage_lookup


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def _typed(name: str, dtype: T.DataType) -> Column:
    """Unparseable text becomes NULL. Dates may carry a time of day, which is dropped."""
    text = F.trim(F.col(name))
    if isinstance(dtype, T.DateType):
        return F.to_date(F.try_to_timestamp(text)).alias(name)
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        # whole numbers are often written as 12.0; DECIMAL keeps all digits of a barcode
        return text.try_cast(T.DecimalType(38, 6)).try_cast(dtype).alias(name)
    value = text.try_cast(dtype)
    if isinstance(dtype, T.DoubleType):
        value = F.nanvl(value, F.lit(None).cast(dtype))
    return value.alias(name)


def _reader(spark: SparkSession, sep: str):
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
    )


def read_csv_folder(
    spark: SparkSession,
    folder: str,
    schema: T.StructType = schemas.SALES_HOURLY,
    *,
    sep: str = ",",
    mixed_headers: bool = False,
    blank_rows: str = "by_file",
    rename: dict[str, str] = schemas.RAW_COLUMN_NAMES,
) -> DataFrame:
    """All ``*.csv`` below ``folder`` as one table, matched by column name.

    Files normally share one header; a file whose header differs fails the job
    (``enforceSchema=False``) instead of shifting columns. ``mixed_headers=True`` first
    reads the header line of every file and unions the header groups by name.

    ``blank_rows="by_file"`` leaves out files that hold only empty cells and keeps an empty row
    of any other file; finding such files reads the folder once more. ``"drop"`` drops every
    row without a value in the same single pass (a row without a barcode never survives the
    product mapping, so daily tables do not change). ``"keep"`` does nothing.
    """
    if mixed_headers:
        raw = _read_by_header(spark, folder, sep)
    else:
        header = _reader(spark, sep).csv(folder).schema
        raw = _reader(spark, sep).schema(_as_text(header)).option("enforceSchema", False).csv(folder)
        raw = raw.select("*", F.col("_metadata.file_path").alias("_file"))
    for old, new in rename.items():
        if old in raw.columns:
            raw = raw.withColumnRenamed(old, new)
    filled = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in raw.columns if c != "_file"])
    if blank_rows == "drop":
        raw = raw.filter(filled)
    elif blank_rows == "by_file":
        # the list of blank files is short, so rows meet it in a broadcast join
        blank = raw.groupBy("_file").agg(F.max(filled).alias("any_value")).filter(~F.col("any_value"))
        raw = raw.join(stage_lookup(blank.select("_file"), "blank_files"), "_file", "left_anti")
    elif blank_rows != "keep":
        raise ValueError(f"unknown blank_rows: {blank_rows}")
    absent = [f for f in schema.fields if f.name not in raw.columns]
    raw = raw.select("*", *[F.lit(None).cast("string").alias(f.name) for f in absent])
    return raw.select([_typed(f.name, f.dataType) for f in schema.fields])


def _read_by_header(spark: SparkSession, folder: str, sep: str) -> DataFrame:
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line_no"),
            "value",
        )
    )
    headers = (
        lines.filter(F.col("start") == 0)
        .groupBy("file")
        .agg(F.min_by("value", "line_no").alias("header"))
    )
    # one entry per file: the size of the listing the driver holds for any file scan
    groups: dict[str, list[str]] = {}
    for row in headers.toLocalIterator():
        groups.setdefault(row["header"], []).append(row["file"])
    parts = []
    for header, paths in sorted(groups.items()):
        names = [n.strip().strip('"') for n in header.split(sep)]
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        part = spark.read.option("header", True).option("sep", sep).schema(text).csv(paths)
        parts.append(part.select("*", F.col("_metadata.file_path").alias("_file")))
    if not parts:
        raise ValueError(f"no csv file below {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_dimension_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Barcode map, campaign or markdown file, renamed and typed by ``schema``."""
    return read_csv_folder(spark, path, schema, sep=sep, blank_rows="keep")


def numeric_if_all_parse(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast a text column to BIGINT only if every non-null value is an integer.

    Column types must be known when a plan is built, so this is the one check that runs
    a job: a single aggregate over the named columns, returning one row.
    """
    checks = [F.every(F.col(c).isNull() | F.col(c).try_cast("bigint").isNotNull()).alias(c) for c in columns]
    whole = df.agg(*checks).first()
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns if whole[c]})


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, date_col: str = "date", mode: str = "overwrite") -> None:
    """Parquet partitioned by month. Rows of a month meet in as few files as AQE finds useful
    (the REBALANCE hint splits a month that is too large for one file)."""
    month = F.date_format(date_col, "yyyy-MM")
    (
        df.withColumn("month_part", month)
        .hint("rebalance", "month_part")
        .write.mode(mode)
        .partitionBy("month_part")
        .parquet(path)
    )


def write_report(df: DataFrame, path: str, max_rows: int = 100_000) -> None:
    """CSV report: one file for small reports, several part files beyond ``max_rows``."""
    small = df.limit(max_rows + 1).count() <= max_rows
    (df.coalesce(1) if small else df).write.mode("overwrite").option("header", True).csv(path)


__all__ = [
    "numeric_if_all_parse",
    "read_csv_folder",
    "read_dimension_csv",
    "read_table",
    "write_report",
    "write_table",
]
