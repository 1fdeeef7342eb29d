"""Every query with an oracle: Spark result equals DuckDB, row by row, types included."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()
SQL_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in columns)
    cursor = duck.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]}) q")
    types = [str(d[1]) for d in cursor.description]
    theirs = sorted(cursor.fetchall(), key=repr)
    assert types == [SQL_TYPES[dict(df.dtypes)[c]] for c in columns]
    assert len(ours) == len(theirs)
    assert ours == theirs


def test_entry_has_rows(spark, monkeypatch, sf_dir):
    table = entry.entry(spark)
    assert {"gln", "gb_id", "date", "quantity", "rolling_mean"} <= set(table.columns)
    assert table.limit(1).count() == 1


LARGE = ["sales_daily", "rolling_top5_price", "share_dataset", "target_encode_product", "forecast_quantiles", "wape_by_volume"]


@pytest.mark.parametrize("name", LARGE)
def test_plans_of_large_tables_give_the_same_rows(spark, duck, sf_dir, name, monkeypatch):
    """Beyond the broadcast bound and with products cut into many blocks."""
    from demandloom.operators import pricing
    from demandloom.sources import staging

    monkeypatch.setattr(staging, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(pricing, "BLOCK_ROWS", 40)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_query_matches_oracle(spark, duck, sf_dir, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
