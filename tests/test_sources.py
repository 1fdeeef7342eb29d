import datetime as dt

from conftest import values

from demandloom import schemas
from demandloom.plans import sales_daily
from demandloom.sources import files, staging

HEADER = "gln,eanCode,date,fromHour,toHour,quantity,netSalesKr,taxAmount,grossMargin\n"


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_nested_folder_blank_files_and_bad_dates(spark, tmp_path):
    write(tmp_path, "a/one.csv", HEADER + "1,10,2024-01-01,8,9,2,20.5,1,1\n,,,,,,,,\n")
    write(tmp_path, "b/c/two.csv", HEADER + "2,11.0,not a date,8,9,2,20.5,1,1\n")
    write(tmp_path, "b/blank.csv", HEADER + ",,,,,,,,\n,,,,,,,,\n")
    write(tmp_path, "b/empty.csv", HEADER)
    write(tmp_path, "b/readme.txt", "no")
    got = files.read_csv_folder(spark, str(tmp_path))
    assert values(got, "gln", "ean_code", "date", "net_sales") == [
        (None, None, None, None),
        (1, 10, dt.date(2024, 1, 1), 20.5),
        (2, 11, None, 20.5),
    ]
    assert files.read_csv_folder(spark, str(tmp_path), blank_rows="drop").count() == 2
    assert files.read_csv_folder(spark, str(tmp_path), blank_rows="keep").count() == 5


def test_files_with_other_column_orders(spark, tmp_path):
    write(tmp_path, "one.csv", HEADER + "1,10,2024-01-01 00:00:00,8,9,2,20.5,1,1\n")
    write(tmp_path, "two.csv", "quantity,gln,eanCode,extra\n5,2,11,x\n")
    got = files.read_csv_folder(spark, str(tmp_path), mixed_headers=True)
    assert values(got, "gln", "ean_code", "quantity", "date") == [(1, 10, 2.0, dt.date(2024, 1, 1)), (2, 11, 5.0, None)]


def test_dimension_file_with_semicolons(spark, tmp_path):
    write(tmp_path, "c.csv", "gb_id;fromDate;toDate;discount;standardPrice;campaignPrice\nAB;2024-01-01;2024-01-03;-0.2;10;8\n")
    got = files.read_dimension_csv(spark, str(tmp_path), schemas.CAMPAIGN, sep=";")
    assert values(got, "gb_id", "from_date", "campaign_price") == [("AB", dt.date(2024, 1, 1), 8.0)]


def test_numeric_only_if_all_parse(spark):
    df = spark.createDataFrame([("1", "1"), (None, "x")], "a string, b string")
    assert dict(files.numeric_if_all_parse(df, ["a", "b"]).dtypes) == {"a": "bigint", "b": "string"}


def test_table_roundtrip(spark, rows, tmp_path):
    df = rows("date date, v long", ("2024-01-01", 1), ("2024-02-01", 2))
    files.write_table(df, str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").glob("month_part=*")) == ["month_part=2024-01", "month_part=2024-02"]
    assert values(files.read_table(spark, str(tmp_path / "t")), "v") == [(1,), (2,)]


def test_lookup_is_broadcast_only_below_the_bound(spark):
    facts, lookup = spark.range(100), spark.range(50).selectExpr("id", "id as v")

    def plan(max_rows):
        joined = facts.join(staging.stage_lookup(lookup, "t", max_rows), "id")
        return joined._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan(50)
    assert "strategy=broadcast" not in plan(49)


def test_checkpoint_folder_comes_from_the_session(spark):
    assert staging.checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


RAW = "gln long, ean_code long, date date, from_hour int, to_hour int, quantity double, net_sales double, tax_amount double, gross_margin double"


def test_job_contract(spark, rows):
    """Three days of one product: the price falls by a quarter on the last, which becomes a promotion."""
    net = {"2023-06-05": 24.0, "2023-06-06": 24.0, "2023-06-07": 18.0}
    sales = rows(RAW, *[(4, 700, day, 10, 11, 3.0, amount, amount / 4, 0.5) for day, amount in net.items()])
    ean_map = spark.createDataFrame([(700, "p7")], "ean_code long, gb_id string")
    campaign = spark.createDataFrame([], schemas.CAMPAIGN)
    periods = spark.createDataFrame([], schemas.MARKDOWN_PERIODS)
    features, mismatch = sales_daily.prepare_sales_data(sales, ean_map, campaign, periods)
    got = values(features, "date", "quantity", "unit_price", "on_promotion", "discount", "rolling_mean", "day_of_week_num")
    assert [r[1:] for r in got] == [(3, 10.0, False, 0.0, 3.0, 0), (3, 10.0, False, 0.0, 3.0, 1), (3, 7.5, True, -0.25, 3.0, 2)]
    assert values(mismatch, "date", "standard_price") == [(dt.date(2023, 6, 7), 10.0)]
    _, _, extra = sales_daily.prepare_sales_data_with_diagnostics(sales, ean_map, campaign, periods, "p7")
    assert set(extra) == {"sales_hourly", "price_dispersion", "suspicious_daily_prices"}


def test_command_line_jobs(spark, tmp_path, capsys):
    from demandloom import cli

    data = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 10 + i % 7, i % 7, i * 0.5) for i in range(60)]
    table = spark.createDataFrame(data, "gln long, date date, quantity long, day_of_week_num int, odd double")
    table.write.parquet(str(tmp_path / "t"))
    cli.main(["audit", "--dataset", str(tmp_path / "t"), "--output", str(tmp_path / "audit")])
    assert "odd" in capsys.readouterr().out and list((tmp_path / "audit").glob("*.csv"))
    cli.main(["prune", "--dataset", str(tmp_path / "t"), "--top-k", "1"])
    assert "pruned" in capsys.readouterr().out


def test_discarded_stage_is_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "checkpoint_root", lambda _: str(tmp_path))
    kept, gone = staging.stage(spark.range(5).toDF("n"), "kept"), staging.stage(spark.range(5).toDF("n"), "gone")
    staging.discard(gone)
    assert kept.count() == 5
    assert [p.name.split("-")[0] for p in (tmp_path / "demandloom").iterdir()] == ["kept"]
