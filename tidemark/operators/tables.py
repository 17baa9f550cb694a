"""Small tables about runs, families, dates and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import RISK_FREE_LOG, SESSIONS_PER_YEAR
from tidemark.operators.windows import by_ticker


def cache_key(bars: DataFrame) -> DataFrame:
    """One row: the sorted tickers joined by dashes, whatever the order they were asked for in."""
    return bars.select("ticker").distinct().agg(F.array_join(F.array_sort(F.collect_list("ticker")), "-").alias("key"))


def json_events(lines: DataFrame, text: str, schema: str) -> DataFrame:
    """lines with the fields of their JSON text; a line that is no JSON has nulls and ``malformed``."""
    parsed = F.from_json(text, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("_x", parsed).withColumn("malformed", F.col(text).isNotNull() & F.col("_x._bad").isNotNull())
    return rows.select(*[c for c in rows.columns if c not in ("_x",)], "_x.*").drop("_bad")


def orders_by_outcome(orders: DataFrame) -> DataFrame:
    """(session, outcome, n), outcomes in lower case; wants session, outcome."""
    return orders.groupBy("session", F.lower("outcome").alias("outcome")).agg(F.count("*").alias("n"))


def ledger_progress(runs: DataFrame) -> DataFrame:
    """(config, completed, open, errored) counts of runs (config, outcome)."""
    return runs.groupBy("config").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("completed", "open", "errored")])


def to_resume(runs: DataFrame) -> DataFrame:
    """Configurations of which no run is completed."""
    return runs.select("config").distinct().join(runs.where("outcome = 'completed'").select("config"), "config", "left_anti")


def family_starts(events: DataFrame, cap: int) -> DataFrame:
    """(family, starts, over): started events of each family, and whether they are more than ``cap``."""
    starts = F.count_if(F.col("event_type") == "started")
    return events.groupBy("family").agg(starts.alias("starts"), (starts > cap).alias("over"))


def completed_sessions(runs: DataFrame) -> DataFrame:
    """(profile, sessions): sessions on which a profile completed a run; wants profile, session, completed."""
    return runs.where("completed").groupBy("profile").agg(F.count_distinct("session").alias("sessions"))


def union_of_dates(*windows: DataFrame) -> DataFrame:
    """The dates of any window, once each."""
    out = windows[0].select("date")
    for w in windows[1:]:
        out = out.union(w.select("date"))
    return out.distinct()


def common_dates(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("date").intersect(second.select("date"))


def excluded(rows: DataFrame, key: str, *rules: Column) -> DataFrame:
    """Keys that any rule excludes, from one pass over the rows."""
    any_rule = F.lit(False)
    for rule in rules:
        any_rule = any_rule | F.coalesce(rule, F.lit(False))
    return rows.where(any_rule).select(key).distinct()


def not_in_superset(rows: DataFrame, superset: DataFrame, key: str) -> DataFrame:
    """Keys that a superset should have and hasn't."""
    return rows.select(key).distinct().join(superset.select(key), key, "left_anti")


def executable_endpoints(bars: DataFrame, held: int) -> DataFrame:
    """(ticker, date, entry, exit): a decision's fills at the next open and ``held`` opens after it; null where there is none yet."""
    return bars.select("ticker", "date", F.lead("open").over(by_ticker()).alias("entry"), F.lead("open", held + 1).over(by_ticker()).alias("exit"))


def excess_returns(returns: DataFrame) -> DataFrame:
    """returns with ``excess``: the log return over a session's part of the risk-free log rate."""
    return returns.withColumn("excess", F.col("log_return") - RISK_FREE_LOG / SESSIONS_PER_YEAR)


def order_id(*parts: Column) -> Column:
    """An id that the same parts always give: SHA-256 of their texts."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
