"""The exchange calendar by its rules, and operators over session numbers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Closures that follow no rule.  Fixed values.
AD_HOC_CLOSURES = ["2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09"]
JUNETEENTH_SINCE = 2022


def easter(year: Column) -> Column:
    """Easter Sunday by the anonymous Gregorian algorithm, in integers."""
    y = year.cast("int")
    century = F.floor(y / 100)
    golden = y % 19
    leap, rest = F.floor(century / 4), century % 4
    skip = F.floor((8 * century + 13) / 25)
    epact = (19 * golden + century - leap - skip + 15) % 30
    small, odd = F.floor((y % 100) / 4), y % 4
    fix = F.floor((golden + 11 * epact) / 319)
    back = (2 * rest + 2 * small - epact + fix - odd + 32) % 7
    month = F.floor((epact - fix + back + 90) / 25)
    day = (epact - fix + back + month + 19) % 32
    return F.make_date(y, month.cast("int"), day.cast("int"))


def nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    """The n-th MON..SUN of a month."""
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), weekday), 7 * (n - 1))


def last_weekday(year: Column, month: int, weekday: str) -> Column:
    return F.next_day(F.date_sub(F.last_day(F.make_date(year, F.lit(month), F.lit(1))), 7), weekday)


def observed(day: Column) -> Column:
    """A Saturday holiday is kept on Friday, a Sunday one on Monday."""
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def market_holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(date, holiday) observed in the years first..last."""
    y = F.col("year")
    fixed = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    rules = {
        "new_year": F.when(F.weekday(fixed(1, 1)) != 5, observed(fixed(1, 1))),  # no Friday closing before a Saturday
        "mlk": nth_weekday(y, 1, "MON", 3),
        "washington": nth_weekday(y, 2, "MON", 3),
        "good_friday": F.date_sub(easter(y), 2),
        "memorial": last_weekday(y, 5, "MON"),
        "juneteenth": F.when(y >= JUNETEENTH_SINCE, observed(fixed(6, 19))),
        "independence": observed(fixed(7, 4)),
        "labor": nth_weekday(y, 9, "MON", 1),
        "thanksgiving": nth_weekday(y, 11, "THU", 4),
        "christmas": observed(fixed(12, 25)),
    }
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    pairs = F.explode(F.array(*[F.struct(day.alias("date"), F.lit(name).alias("holiday")) for name, day in rules.items()]))
    ruled = years.select("year", pairs.alias("x")).where("x.date is not null and year(x.date) = year").select("x.*")
    extra = spark.createDataFrame([(d,) for d in AD_HOC_CLOSURES], "d string").select(F.to_date("d").alias("date"), F.lit("ad_hoc").alias("holiday"))
    return ruled.union(extra.where(F.year("date").between(first, last)))


def trading_days(spark: SparkSession, start: date | None, end: date | None) -> DataFrame:
    """(date, session_no from 1) of the sessions in [start, end]; empty if reversed."""
    if start is None or end is None or start > end:
        return spark.createDataFrame([], "date date, session_no int")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")).where(F.weekday("date") < 5)
    open_days = days.join(F.broadcast(market_holidays(spark, start.year, end.year).select("date")), "date", "left_anti")
    return open_days.withColumn("session_no", F.row_number().over(Window.orderBy("date")))  # one row a day


def nth_session_after(days: DataFrame, sessions: DataFrame, n: int) -> DataFrame:
    """days(date) with ``target``: the n-th session after the day, by the calendar."""
    ordered = Window.orderBy("date")
    later = sessions.select("date", F.lead("date", n - 1).over(ordered).alias("target"))
    spans = later.select(F.coalesce(F.lag("date").over(ordered), F.lit("0001-01-01").cast("date")).alias("from_date"), F.col("date").alias("to_date"), "target")
    return days.join(F.broadcast(spans), (F.col("date") >= F.col("from_date")) & (F.col("date") < F.col("to_date")), "left").drop("from_date", "to_date")


def neighbours(sessions: DataFrame) -> DataFrame:
    """Each session with the one before and the one after it."""
    ordered = Window.orderBy("date")
    return sessions.select("date", F.lag("date").over(ordered).alias("previous"), F.lead("date").over(ordered).alias("next"))


def decision_sessions(sessions: DataFrame, cadence: str) -> DataFrame:
    """sessions with ``decides``: the first session of each month or ISO week; the first row is never marked."""
    if cadence == "monthly":
        period = F.year("date") * 12 + F.month("date")
    elif cadence == "weekly":
        period = F.extract(F.lit("YEAROFWEEK"), "date") * 100 + F.weekofyear("date")
    else:
        raise ValueError(f"cadence must be monthly or weekly, not {cadence!r}")
    before = F.lag(period).over(Window.orderBy("date"))
    return sessions.withColumn("decides", F.coalesce(period != before, F.lit(False)))
