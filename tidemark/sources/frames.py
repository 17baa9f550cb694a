"""Canonical frames: bars, sessions, the session-by-ticker panel, actions, vintages, facts, equity.

They are derived from the star schema so that every operator runs on whole
tables; a user reads their own bars with ``read_bars`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.calendar import trading_days

BAR_SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", tickers: list[str] | None = None) -> DataFrame:
    """Bars under an explicit schema; a filter on tickers reaches the scan."""
    bars = spark.read.schema(BAR_SCHEMA).format(fmt).options(header=True).load(path)
    return bars.where(F.col("ticker").isin(tickers)) if tickers else bars


def write_bars(bars: DataFrame, path: str) -> None:
    """Partitioned by ticker; refuses an existing target."""
    bars.repartition("ticker").sortWithinPartitions("date").write.mode("errorifexists").partitionBy("ticker").parquet(path)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand and ship date, priced by line item in line order."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("k"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    by_day = lines.join(parts, "l_partkey").groupBy("ticker", "date")
    return by_day.agg(F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("l_quantity").alias("volume"))


def sessions_of(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """(date, session_no) of the exchange over the span of a frame's dates."""
    span = frame.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    return trading_days(spark, span["a"], span["b"])


def panel(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """Every session with every ticker; prices are null where there is no bar."""
    grid = frame.select("ticker").distinct().crossJoin(F.broadcast(sessions_of(spark, frame)))  # a calendar is a bounded table
    return grid.join(frame, ["ticker", "date"], "left")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic corporate actions on bar dates: a dividend on urgent orders' first shipment of a brand's month, a
    2-for-1 split on the first bar of every fourth year's March."""
    b = bars(spark, sf_dir)
    month = b.groupBy("ticker", F.trunc("date", "MM").alias("month")).agg(F.min("date").alias("date"))
    quarter = month.where(F.month("month") % 3 == 0)
    dividend = quarter.select("ticker", "date", F.lit("dividend").alias("kind"), (F.dayofmonth("date") / 10.0).alias("value"))
    split = month.where((F.month("month") == 3) & (F.year("month") % 4 == 0)).select("ticker", "date", F.lit("split").alias("kind"), F.lit(2.0).alias("value"))
    return dividend.unionByName(split)


def second_source(frame: DataFrame) -> DataFrame:
    """Bars as another vendor might have them: some missing, some off by 20 basis points."""
    day = F.dayofyear("date")
    return frame.where(day % 17 != 0).withColumn("close", F.when(day % 13 == 0, F.col("close") * 1.002).otherwise(F.col("close")))


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, realtime_start, realtime_end, value): monthly order totals by segment, revised by every later order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("realtime_start"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("series"))
    daily = orders.join(customers, "o_custkey").groupBy("series", "realtime_start").agg(F.max("o_totalprice").alias("value")).withColumn("date", F.trunc("realtime_start", "MM"))
    later = F.lead("realtime_start").over(Window.partitionBy("series", "date").orderBy("realtime_start"))
    return daily.withColumn("realtime_end", F.coalesce(F.date_sub(later, 1), F.lit("9999-12-31").cast("date"))).select("series", "date", "realtime_start", "realtime_end", "value")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument_id, field, value, effective_date, observed_at): order status and priority of customers, observed a few days late."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("instrument_id"), "o_orderkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("effective_date"))
    seen = F.date_add("effective_date", (F.col("o_orderkey") % 5).cast("int")).cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    fields = F.explode(F.array(F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value"))))
    return orders.withColumn("observed_at", seen).withColumn("x", fields).select("instrument_id", "x.field", "x.value", "effective_date", "observed_at", "o_orderkey")


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, session, equity): one million plus order flow by market segment."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("session"), F.round("o_totalprice", 2).alias("x"), F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(-1.0).alias("side"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("account"))
    flow = orders.join(customers, "o_custkey").groupBy("account", "session").agg(F.sum(F.round(F.col("x") * F.col("side") * 10).cast("long")).alias("tenths"))
    run = F.sum("tenths").over(Window.partitionBy("account").orderBy("session"))
    return flow.select("account", "session", (F.lit(50_000_000.0) + run / 10.0).alias("equity"))
