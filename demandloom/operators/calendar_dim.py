"""Holiday calendar, closures and calendar features, computed once per distinct date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Norwegian public holidays (fixed values): name, and month/day or days from Easter Sunday.
FIXED_HOLIDAYS = [
    ("Første nyttårsdag", 1, 1),
    ("Arbeidernes dag", 5, 1),
    ("Grunnlovsdag", 5, 17),
    ("Første juledag", 12, 25),
    ("Andre juledag", 12, 26),
]
EASTER_HOLIDAYS = [
    ("Skjærtorsdag", -3),
    ("Langfredag", -2),
    ("Første påskedag", 0),
    ("Andre påskedag", 1),
    ("Kristi himmelfartsdag", 39),
    ("Første pinsedag", 49),
    ("Andre pinsedag", 50),
]

# Name fragment -> class, first match wins (fixed values).
HOLIDAY_CLASSES = [
    ("påske", "Easter"),
    ("langfredag", "Easter"),
    ("skjærtorsdag", "Easter"),
    ("pinse", "Pentecost"),
    ("jul", "Christmas"),
    ("nyttår", "NewYear"),
    ("grunnlov", "NationalDay"),
    ("arbeider", "LaborDay"),
]

# Shops open on Sundays from this ISO week to the end of the year (fixed value).
FIRST_OPEN_SUNDAY_WEEK = 49


def easter_sunday(year: str = "year") -> Column:
    """Gregorian Easter by the anonymous integer algorithm (Meeus/Jones/Butcher)."""
    golden = f"({year} % 19)"
    century, in_century = f"({year} div 100)", f"({year} % 100)"
    epact = (
        f"((19 * {golden} + {century} - {century} div 4"
        f" - ({century} - ({century} + 8) div 25 + 1) div 3 + 15) % 30)"
    )
    weekday = f"((32 + 2 * ({century} % 4) + 2 * ({in_century} div 4) - {epact} - {in_century} % 4) % 7)"
    late = f"(({golden} + 11 * {epact} + 22 * {weekday}) div 451)"
    days_after_march_1 = f"({epact} + {weekday} - 7 * {late} + 21)"
    return F.expr(f"date_add(make_date({year}, 3, 1), cast({days_after_march_1} as int))")


def holiday_calendar(spark: SparkSession, first_year: Column | int, last_year: Column | int) -> DataFrame:
    """(holiday_date, holiday_name); two holidays on one date share a row, names sorted.

    Years may be scalar subqueries over the facts, so nothing is collected.
    """
    low = F.lit(first_year) if isinstance(first_year, int) else first_year
    high = F.lit(last_year) if isinstance(last_year, int) else last_year
    years = spark.range(1, numPartitions=1).select(F.explode(F.sequence(low, high)).alias("year"))
    fixed = [
        F.struct(F.make_date(F.col("year"), F.lit(m), F.lit(d)).alias("holiday_date"), F.lit(n).alias("name"))
        for n, m, d in FIXED_HOLIDAYS
    ]
    moving = [
        F.struct(F.date_add("easter", offset).alias("holiday_date"), F.lit(n).alias("name"))
        for n, offset in EASTER_HOLIDAYS
    ]
    return (
        years.withColumn("easter", easter_sunday())
        .select(F.inline(F.array(*fixed, *moving)))
        .groupBy("holiday_date")
        .agg(F.array_join(F.sort_array(F.collect_set("name")), "; ").alias("holiday_name"))
    )


def holidays_for(df: DataFrame) -> DataFrame:
    """Calendar for the years of ``df.date``."""
    first = df.agg(F.year(F.min("date"))).scalar()
    last = df.agg(F.year(F.max("date"))).scalar()
    return holiday_calendar(df.sparkSession, first, last)


def holiday_type(name: str = "holiday_name") -> Column:
    lowered = F.lower(F.col(name))
    (first, label), *rest = HOLIDAY_CLASSES
    chain = F.when(lowered.contains(first), label)
    for fragment, label in rest:
        chain = chain.when(lowered.contains(fragment), label)
    return chain.otherwise("Other")


def holiday_types(holidays: DataFrame) -> DataFrame:
    return holidays.withColumn("holiday_type", holiday_type())


def distinct_dates(df: DataFrame) -> DataFrame:
    return df.select("date").filter(F.col("date").isNotNull()).distinct()


def _closing_sunday() -> Column:
    return (F.weekday("date") == 6) & (F.weekofyear("date") < FIRST_OPEN_SUNDAY_WEEK)


def closed_dates(dates: DataFrame, holidays: DataFrame) -> DataFrame:
    """Holidays and the observed Sundays on which shops are closed."""
    sundays = dates.filter(_closing_sunday()).select(F.col("date").alias("closed_date"))
    return holidays.select(F.col("holiday_date").alias("closed_date")).union(sundays).distinct()


def holiday_dim(
    dates: DataFrame,
    holidays: DataFrame,
    past_days: int = 3,
    forward_days: int = 4,
    swap_fix: bool = False,
) -> DataFrame:
    """Holiday features of each date in ``dates``.

    ``closed_in_last_N_days`` counts the closures of the N days AFTER a date and
    ``closed_in_next_N_days`` those of the N days BEFORE it: downstream models were built
    on that meaning. ``swap_fix=True`` gives the directions the names promise.

    One window pass over a timeline that holds one row per calendar day (3,653 rows for ten
    years), whatever the size of the facts. Holidays and dates meet by frames, not by pairs.
    """
    timeline = (
        dates.select(
            "date", F.lit(True).alias("wanted"), F.lit(None).cast("string").alias("type"), _closing_sunday().alias("closed")
        )
        .union(
            holidays.transform(holiday_types).select(
                F.col("holiday_date"), F.lit(False), F.col("holiday_type"), F.lit(True)
            )
        )
        .groupBy("date")
        .agg(F.max("wanted").alias("wanted"), F.max("type").alias("type"), F.max("closed").alias("closed"))
        .withColumn("day", F.unix_date("date"))
    )
    by_day = Window.orderBy("day")
    here = Window.currentRow
    holiday = F.when(F.col("type").isNotNull(), F.struct("day", "type"))
    closed = F.col("closed").cast("int")
    after = lambda n: F.coalesce(F.sum(closed).over(by_day.rangeBetween(1, n)), F.lit(0))
    before = lambda n: F.coalesce(F.sum(closed).over(by_day.rangeBetween(-n, -1)), F.lit(0))
    in_last, in_next = (before, after) if swap_fix else (after, before)
    # frames that grow with the scan cost one step a row; a shrinking frame would rescan the rest
    backwards = Window.orderBy(F.desc("day")).rangeBetween(Window.unboundedPreceding, here)
    last = F.max(holiday).over(by_day.rangeBetween(Window.unboundedPreceding, here))
    following = F.min(holiday).over(backwards)
    return (
        timeline.select(
            "date",
            "day",
            "wanted",
            F.col("type").isNotNull().cast("int").alias("is_holiday"),
            in_last(past_days).alias(f"closed_in_last_{past_days}_days"),
            in_next(forward_days).alias(f"closed_in_next_{forward_days}_days"),
            last.alias("last"),
            following.alias("following"),
        )
        .filter("wanted")
        .select(
            "date",
            f"closed_in_last_{past_days}_days",
            f"closed_in_next_{forward_days}_days",
            F.coalesce("last.type", F.lit("None")).alias("last_holiday_type"),
            F.coalesce("following.type", F.lit("None")).alias("next_holiday_type"),
            F.least(F.col("day") - F.col("last.day"), F.col("following.day") - F.col("day")).alias(
                "days_to_nearest_holiday"
            ),
            "is_holiday",
        )
    )


def nearest_holiday(dates: DataFrame, holidays: DataFrame) -> DataFrame:
    return holiday_dim(dates, holidays).select(
        "date", "last_holiday_type", "next_holiday_type", "days_to_nearest_holiday"
    )


def join_dates(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Attach a one-row-per-date table.

    The broadcast side has one row per distinct DATE, so its size is bounded by the calendar
    (a century is 36,525 rows, about 2 MB) and does not grow with the facts.
    """
    return df.join(F.broadcast(dim), "date", "left")


def add_holiday_features(
    df: DataFrame, holidays: DataFrame, past_days: int = 3, forward_days: int = 4, swap_fix: bool = False
) -> DataFrame:
    """Join the holiday features of each date to ``df``."""
    dim = holiday_dim(distinct_dates(df), holidays, past_days, forward_days, swap_fix)
    return df.transform(join_dates, dim)


def seasonality_columns(date: str = "date") -> dict[str, Column]:
    """Weekday, yearly and weekly sine/cosine terms, month and quarter."""
    weekday, day_of_year = F.weekday(date), F.dayofyear(date)
    week_angle = F.lit(2.0) * F.pi() * weekday / 7
    year_angle = F.lit(2.0) * F.pi() * day_of_year / 365
    return {
        "day_of_week_num": weekday,
        "sin_dow": F.sin(week_angle),
        "cos_dow": F.cos(week_angle),
        "day_of_year": day_of_year,
        "sin_day": F.sin(year_angle),
        "cos_day": F.cos(year_angle),
        "month": F.month(date),
        "quarter": F.quarter(date),
    }


def add_seasonality_features(df: DataFrame) -> DataFrame:
    return df.withColumns(seasonality_columns())


def future_covariates(
    history: DataFrame,
    horizon: int,
    covariates: tuple[str, ...] = (),
    holidays: DataFrame | None = None,
) -> DataFrame:
    """The next ``horizon`` days of each series with calendar features.

    Other covariates are 0, unless ``holidays`` is given: then the holiday features come
    from the calendar.
    """
    last = history.groupBy("item_id").agg(F.max("date").alias("last_date"))
    days = F.sequence(F.date_add("last_date", 1), F.date_add("last_date", horizon))
    future = last.select("item_id", F.explode(days).alias("date")).transform(add_seasonality_features)
    future = future.drop("day_of_year")
    if holidays is not None:
        future = add_holiday_features(future, holidays)
    unknown = {c: F.lit(0) for c in covariates if c not in future.columns}
    return future.withColumns(unknown) if unknown else future
