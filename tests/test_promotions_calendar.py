import datetime as dt

import pytest
from conftest import values
from pyspark.sql import functions as F

from demandloom.operators import calendar_dim, promotions

CAMPAIGN = "gb_id long, from_date date, to_date date, discount double, standard_price double, campaign_price double"
SALES = "gln long, gb_id long, date date, quantity long, unit_price double, standard_price double, discount double, on_promotion boolean"


def test_overlapping_open_and_reversed_campaigns(rows):
    sales = rows(SALES, (1, 7, "2024-01-05", 1, 8.0, 10.0, 0.0, False), (1, 8, "2024-01-05", 1, 8.0, 10.0, 0.0, False))
    campaign = rows(
        CAMPAIGN,
        (7, "2024-01-01", "2024-01-05", -0.2, 10.0, 8.0),
        (7, "2024-01-05", "9999-12-31", -0.3, 10.0, 7.0),
        (7, "2024-01-09", "2024-01-01", -0.4, 10.0, 6.0),
        (7, None, "2024-01-09", -0.5, 10.0, 5.0),
    )
    out = promotions.campaign_interval_join(sales, campaign)
    got = values(out, "gb_id", "declared_discount", "declared_promotion", "campaign_seq")
    assert got == [(7, -0.3, True, 2), (7, -0.2, True, 1), (8, 0.0, False, 0)]
    periods = rows("from_date date, to_date date, kronemarked int", ("2024-01-05", "2024-01-05", 1))
    one = promotions.add_promotion_features(sales, campaign, periods, dedupe=True)
    assert values(one, "gb_id", "declared_discount", "kronemarked") == [(7, -0.2, True), (8, 0.0, True)]


def test_campaign_days(rows):
    campaign = rows(CAMPAIGN, (7, "2023-12-30", "2024-01-01", -0.2, 10.0, 8.0), (None, "2024-01-01", "2024-01-02", 0.0, 1.0, 1.0))
    days = promotions.campaign_days(campaign, keep=("discount",))
    assert [str(r[0]) for r in values(days, "date")] == ["2023-12-30", "2023-12-31", "2024-01-01"]


def reconcile(rows, *data):
    schema = SALES + ", declared_promotion boolean, declared_discount double, declared_standard_price double, declared_campaign_price double"
    return promotions.reconcile_discount(rows(schema, *data))


def test_reconcile_adopts_declared_price_only_below_it(rows):
    out, mismatch = reconcile(
        rows,
        (1, 1, "2024-01-01", 1, 8.0, 9.0, 0.0, False, True, -0.2, 10.0, 8.0),
        (1, 2, "2024-01-01", 1, 11.0, 9.0, 0.0, False, True, -0.2, 10.0, 8.0),
        (1, 3, "2024-01-01", 1, 9.0, 9.0, 0.0, False, False, 0.0, 0.0, 0.0),
        (1, 4, "2024-01-01", 1, 8.0, 0.0, 0.0, False, False, 0.0, 0.0, 0.0),
    )
    got = values(out, "gb_id", "standard_price", "discount", "on_promotion_recomputed", "conflict", "promo_combined")
    assert got == [
        (1, 10.0, -0.2, True, False, True),
        (2, 9.0, 0.2222, False, True, True),
        (3, 9.0, 0.0, False, False, False),
        (4, 0.0, 0.0, False, False, False),
    ]
    assert values(mismatch, "gb_id", "standard_price", "declared_standard_price") == [(1, 9.0, 10.0), (2, 9.0, 10.0)]


def test_promotion_count_counts_rows_of_the_store_day(rows):
    sales = rows(
        SALES,
        (1, 1, "2024-01-01", 1, 1.0, 1.0, 0.0, True),
        (1, 2, "2024-01-01", 1, 1.0, 1.0, 0.0, True),
        (1, 3, "2024-01-01", 1, 1.0, 1.0, 0.0, False),
        (2, 3, "2024-01-01", 1, 1.0, 1.0, 0.0, False),
    )
    got = values(promotions.add_promotion_count(sales), "gln", "gb_id", "promotion_count")
    assert got == [(1, 1, 2), (1, 2, 2), (1, 3, 2), (2, 3, 0)]


def test_campaign_consistency(spark):
    offers = spark.createDataFrame(
        [("10", "8", "-0.2"), ("10", "8", "-0.1"), ("0", "8", "-0.1"), ("x", "8", "-0.1")],
        "standard_price string, campaign_price string, discount string",
    )
    full, bad = promotions.campaign_discount_consistency(offers)
    assert full.count() == 4
    assert values(bad, "discount", "discount_implied") == [(-0.1, pytest.approx(-0.2))]
    with pytest.raises(ValueError):
        promotions.campaign_discount_consistency(offers.drop("standard_price"))


def test_easter_and_names(spark):
    got = dict(values(calendar_dim.holiday_calendar(spark, 2024, 2024), "holiday_date", "holiday_name"))
    assert got[dt.date(2024, 3, 31)] == "Første påskedag"
    assert got[dt.date(2024, 5, 17)] == "Grunnlovsdag"
    assert got[dt.date(2024, 5, 9)] == "Kristi himmelfartsdag"
    assert len(got) == 12
    easters = {1961: (4, 2), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2038: (4, 25)}
    for year, (month, day) in easters.items():
        table = dict(values(calendar_dim.holiday_calendar(spark, year, year), "holiday_date", "holiday_name"))
        assert "Første påskedag" in table[dt.date(year, month, day)]
    assert values(calendar_dim.holiday_calendar(spark, 2008, 2008), "holiday_date", "holiday_name")[5] == (
        dt.date(2008, 5, 1),
        "Arbeidernes dag; Kristi himmelfartsdag",
    )


def test_holiday_features_around_year_end_and_sundays(spark, rows):
    days = ["2023-11-26", "2023-12-01", "2023-12-10", "2023-12-22", "2023-12-24", "2023-12-27", "2023-12-31"]
    sales = rows("date date, quantity long", *[(d, 1) for d in days])
    holidays = calendar_dim.holiday_calendar(spark, 2023, 2023)
    out = calendar_dim.add_holiday_features(sales, holidays)
    got = {str(r[0]): r[1:] for r in values(out, "date", "closed_in_last_3_days", "closed_in_next_4_days", "last_holiday_type", "next_holiday_type", "days_to_nearest_holiday", "is_holiday")}
    # "last" counts closures after the date, "next" those before it
    assert got["2023-12-24"] == (2, 0, "Pentecost", "Christmas", 1, 0)
    assert got["2023-12-27"] == (0, 2, "Christmas", "None", 1, 0)
    assert got["2023-12-31"] == (0, 0, "Christmas", "None", 5, 0)
    closed = [str(r[0]) for r in values(calendar_dim.closed_dates(calendar_dim.distinct_dates(sales), holidays), "closed_date")]
    assert "2023-11-26" in closed and "2023-12-10" not in closed  # ISO weeks 47 and 49
    fixed = calendar_dim.add_holiday_features(sales, holidays, swap_fix=True).filter(F.col("date") == "2023-12-27")
    assert values(fixed, "closed_in_last_3_days", "closed_in_next_4_days") == [(2, 0)]


def test_future_covariates(rows):
    history = rows("item_id string, date date, target double", ("a", "2024-01-01", 1.0), ("a", "2024-01-05", 1.0), ("b", "2024-02-28", 1.0))
    out = calendar_dim.future_covariates(history, 2, ("on_promotion",))
    got = values(out, "item_id", "date", "day_of_week_num", "on_promotion")
    assert [(a, str(b), c, d) for a, b, c, d in got] == [
        ("a", "2024-01-06", 5, 0),
        ("a", "2024-01-07", 6, 0),
        ("b", "2024-02-29", 3, 0),
        ("b", "2024-03-01", 4, 0),
    ]
