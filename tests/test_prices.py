"""Price repair, promotion state machine, cleaning."""

import datetime as dt
import random

import pytest
from conftest import values
from pyspark.sql import functions as F

from demandloom.operators import cleaning, pricing

DAILY = "gln long, gb_id long, date date, quantity long, net_sales double, tax_amount double, unit_price double"


def machine(prices, start=0.90, end=0.97, move=0.05):
    """The state machine in its plainest form."""
    promo, std, out = False, None, []
    for p in prices:
        std = p if std is None else std
        ratio = p / std if std > 0 else 1.0
        if promo and ratio > end:
            promo, std = False, p
        elif not promo and ratio < start:
            promo = True
        elif not promo and abs(ratio - 1) > move:
            std = p
        out.append((promo, std, round(p / std - 1, 4) if promo else 0.0))
    return out


def price_table(spark, prices_by_product, stores=1):
    data = []
    for product, prices in prices_by_product.items():
        for i, p in enumerate(prices):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=i // stores)
            data.append((i % stores, product, day, 1, p, 0.0, p))
    return spark.createDataFrame(data, DAILY)


def run_machine(spark, prices_by_product, block_rows, stores=1):
    table = price_table(spark, prices_by_product, stores)
    out = pricing.standard_price_and_discount(table, block_rows=block_rows)
    result = {}
    for r in out.orderBy("gb_id", "date", "gln").collect():
        result.setdefault(r["gb_id"], []).append((r["on_promotion"], r["standard_price"], r["discount"]))
    return result


def test_promotion_starts_stays_ends_and_standard_price_moves(spark):
    path = [20.0, 17.0, 19.0, 19.5, 25.0]
    got = run_machine(spark, {1: path}, 100)[1]
    assert got == [
        (False, 20.0, 0.0),
        (True, 20.0, -0.15),
        (True, 20.0, -0.05),
        (False, 19.5, 0.0),
        (False, 25.0, 0.0),
    ]


@pytest.mark.parametrize("block_rows", [1, 3, 7, 40])
def test_blocks_equal_one_pass(spark, block_rows):
    rng = random.Random(block_rows)
    walks = {}
    for product in range(12):
        price, path = rng.choice([5.0, 20.0, 60.0]), []
        for _ in range(160):
            price = max(price * rng.choice([1.0, 1.0, 0.97, 1.02, 0.85, 1.15, 0.93, 1.06]), 0.5)
            path.append(round(price, 2))
        walks[product] = path
    walks[90] = [float(x) for x in range(1, 161)]
    walks[91] = [float(x) for x in range(160, 0, -1)]
    walks[92] = [10.0] * 160
    walks[93] = [-1.0] + [10.0] * 20  # a first price <= 0 never changes
    got = run_machine(spark, walks, block_rows, stores=3)
    for product, path in walks.items():
        assert [g[:2] for g in got[product]] == [w[:2] for w in machine(path)], product
        assert [g[2] for g in got[product]] == pytest.approx([w[2] for w in machine(path)], abs=1e-4)


def test_missing_prices_change_nothing(spark):
    path = [None, 20.0, None, 17.0, None, None, None, 19.9, None]
    for block_rows in (1, 2, 100):
        got = run_machine(spark, {1: path}, block_rows)[1]
        assert [g[0] for g in got] == [False, False, False, True, True, True, True, False, False]
        assert [g[1] for g in got] == [None, 20.0, 20.0, 20.0, 20.0, 20.0, 20.0, 19.9, 19.9]


def test_price_correction_falls_back_from_store_to_product(rows):
    daily = rows(
        DAILY,
        (1, 7, "2024-03-01", 1, 20.0, 0.0, 20.0),
        (1, 7, "2024-03-02", 1, 22.0, 0.0, 22.0),
        (1, 7, "2024-03-03", 1, 99.0, 0.0, 99.0),
        (2, 7, "2023-01-01", 1, 1.0, 0.0, 1.0),
        (3, 8, "2024-03-01", 0, 5.0, 0.0, None),
        (3, 9, "2024-03-01", 0, 0.0, 0.0, None),
    )
    out = pricing.correct_daily_unit_price(daily)
    got = values(out, "gln", "gb_id", "unit_price", "price_error", "corrected_unit_price", "price_correction_source")
    assert got == [
        (1, 7, 20.0, False, 20.0, None),
        (1, 7, 22.0, False, 22.0, None),
        (1, 7, 99.0, True, 22.0, "store_median"),
        (2, 7, 1.0, True, 21.0, "global_median"),
        (3, 8, None, True, None, "uncorrected_missing_reference"),
        (3, 9, None, False, None, None),
    ]


@pytest.mark.parametrize("block_rows", [29, 31, 64, 1000])
def test_rolling_top_price_across_blocks(spark, block_rows):
    rng = random.Random(3)
    path = [round(rng.uniform(5, 60), 2) for _ in range(200)]
    out = pricing.rolling_top_price(price_table(spark, {1: path}, stores=2), block_rows=block_rows)
    got = [r[0] for r in out.orderBy("date", "gln").select("rolling_max_price").collect()]
    want = []
    for i in range(len(path)):
        top = sorted(path[max(0, i - 29) : i + 1], reverse=True)[:5]
        want.append(sum(top) / len(top))
    assert got == pytest.approx(want)


RAW = (
    "gln long, ean_code long, date date, from_hour int, to_hour int, quantity double, net_sales double,"
    " tax_amount double, gross_margin double"
)


def test_copies_rounding_and_unmapped_rows(rows):
    sale = (1, 10, "2024-01-01", 8, 9, 2.5, 20.0, 5.0, 3.0)
    sales = rows(RAW, sale, sale, (1, 11, "2024-01-01", 8, 9, 3.5, 30.0, 5.0, 3.0), (1, 99, "2024-01-01", 8, 9, 1.0, 1.0, 1.0, 1.0))
    ean_map = rows("ean_code long, gb_id long, gb_ean_code long", (10, 5, 99), (11, 5, 0))
    hourly, daily, _, _ = cleaning.preprocess_sales(sales, ean_map)
    assert values(hourly, "gb_id", "quantity", "net_sales", "unit_price") == [(5, 6, 50.0, 10.0)]  # 2.5 -> 2, 3.5 -> 4
    assert values(daily, "gb_id", "quantity", "unit_price") == [(5, 6, 10.0)]
    assert values(cleaning.unmapped_barcodes(sales, ean_map), "ean_code", "n_rows") == [(99, 1)]
    assert values(cleaning.mapping_overlap(sales, ean_map), "ean_code") == [(99,)]


def test_barcode_with_two_products_fails(rows):
    sales = rows(RAW, (1, 10, "2024-01-01", 8, 9, 2.0, 20.0, 5.0, 3.0))
    ean_map = rows("ean_code long, gb_id long", (10, 5), (10, 6))
    assert values(cleaning.mapping_conflicts(ean_map), "ean_code", "gb_id_count") == [(10, 2)]
    with pytest.raises(Exception, match="several products"):
        cleaning.map_products(sales, ean_map).collect()


def test_dispersion_is_compared_after_rounding(rows):
    hourly = rows(
        "gln long, gb_id long, date date, unit_price double",
        (1, 1, "2024-01-01", 10.0),
        (1, 1, "2024-01-01", 14.0),
        (2, 1, "2024-01-01", 10.0),
        (3, 1, "2024-01-01", 10.0),
        (3, 1, "2024-01-01", 10.1),
    )
    out = cleaning.price_dispersion(hourly)
    assert values(out, "gln", "mean_price", "std_price", "rel_diff") == [(1, 12.0, 2.828, 0.236)]


def test_hot_copies_collapse_before_the_shuffle(rows, spark):
    """A third of all rows is one copied row: the plan deduplicates inside the map tasks."""
    sale = rows(RAW, (1, 10, "2024-01-01", 8, 9, 2.0, 20.0, 5.0, 3.0))
    many = sale.crossJoin(spark.range(5000)).drop("id")
    plan = cleaning.distinct_rows(many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2
    assert cleaning.distinct_rows(many).agg(F.count(F.lit(1))).first()[0] == 1


def test_money_is_summed_in_whole_numbers(rows):
    """Usual amounts meet no decimal; the sums are exact, also where amounts beyond 2**53 millionths take part."""
    groups = [
        [0.1] * 10 + [-0.3, None, 12345678.901234],
        [9007199254.740991, 9007199254.740991, -1e-6],
        [1e10, 0.000001, -2.5e15, 7.25],
        [-0.75, -0.25],
    ]
    sales = rows("g long, x double", *[(g, x) for g, xs in enumerate(groups) for x in xs], (4, None))
    out = sales.groupBy("g").agg(cleaning.money_sum("x").alias("s")).orderBy("g")
    exact = [float(sum(round(x * 1e6) for x in xs if x is not None)) / 1e6 for xs in groups]
    assert [r["s"] for r in out.collect()] == [*exact, None]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "as bigint)" in plan  # a multiple of LIMB and a rest
    wide = rows("g long, x double", *[(1, x) for x in (float("nan"), 2.0)], (2, float("inf")), (2, 1.5), (3, 1e300), (3, 2.5))
    found = dict(wide.groupBy("g").agg(cleaning.money_sum("x")).collect())
    assert found[1] != found[1] and found[2] == float("inf") and found[3] == 1e300
