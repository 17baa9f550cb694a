"""Stateful guards: each has a streaming form and a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATUS = "account string, session date, equity double, daily_return double, weekly_return double, weekly_drawdown double, entries_halted boolean, refused boolean"
_STATE = "last_session date, last_equity double, week long, anchor double, high double, latched boolean"


def week_of(column: str):
    return F.extract(F.lit("YEAROFWEEK"), F.col(column)) * 100 + F.weekofyear(column)


def loss_cap_history(equity: DataFrame, *, daily: float, weekly: float, drawdown: float) -> DataFrame:
    """Per session: returns on the day and the week, fall from the week's high, and whether entries halt.

    A weekly breach latches to the end of its ISO week; limits are inclusive.
    """
    by = Window.partitionBy("account").orderBy("session")
    rows = equity.withColumns({"week": week_of("session"), "before": F.lag("equity").over(by)})
    in_week = Window.partitionBy("account", "week").orderBy("session")
    past = in_week.rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.first(F.coalesce("before", "equity")).over(past)
    rows = rows.withColumn("anchor", anchor).withColumn("high", F.greatest("anchor", F.max("equity").over(past)))
    rows = rows.withColumns({"daily_return": F.col("equity") / F.col("before") - 1, "weekly_return": F.col("equity") / F.col("anchor") - 1, "weekly_drawdown": F.col("equity") / F.col("high") - 1})
    breach = (F.col("weekly_return") <= -weekly) | (F.col("weekly_drawdown") <= -drawdown)
    rows = rows.withColumn("_b", breach)
    halted = F.coalesce(F.col("daily_return") <= -daily, F.lit(False)) | F.max("_b").over(past)
    return rows.withColumn("entries_halted", halted).select("account", "session", "equity", "daily_return", "weekly_return", "weekly_drawdown", "entries_halted")


def loss_cap_stream(equity: DataFrame, *, daily: float, weekly: float, drawdown: float) -> DataFrame:
    """The same over a stream, by account; a session out of order comes out ``refused`` and changes nothing."""

    def observe(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, value, week, anchor, high, latched = state.get if state.exists else (None, None, None, None, None, False)
        out = []
        for row in pd.concat(batches).sort_values("session").itertuples(index=False):
            if last is not None and row.session <= last:
                out.append((key[0], row.session, row.equity, None, None, None, None, True))
                continue
            year, number, _ = row.session.isocalendar()
            if week != year * 100 + number:
                week, anchor = year * 100 + number, row.equity if value is None else value
                high, latched = anchor, False
            high = max(high, row.equity)
            today = None if value is None else row.equity / value - 1
            this_week, fall = row.equity / anchor - 1, row.equity / high - 1
            latched = bool(latched or this_week <= -weekly or fall <= -drawdown)
            out.append((key[0], row.session, row.equity, today, this_week, fall, bool(latched or (today is not None and today <= -daily)), False))
            last, value = row.session, row.equity
        state.update((last, value, week, anchor, high, latched))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _STATUS.split(", ")])

    return equity.select("account", "session", "equity").groupBy("account").applyInPandasWithState(observe, _STATUS, _STATE, "append", GroupStateTimeout.NoTimeout)


def changed_incidents(incidents: DataFrame) -> DataFrame:
    """New or changed fingerprints per key, in time order; wants key, ts, id, fingerprint."""
    before = F.lag("fingerprint").over(Window.partitionBy("key").orderBy("ts", "id"))
    return incidents.withColumn("before", before).where("before is null or before <> fingerprint").drop("before")


def rolling_budget(events: DataFrame, key: str, hours: int, most: int) -> DataFrame:
    """Requests counted over the last hours at each event, and whether the budget allows it."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    span = Window.partitionBy(key).orderBy(seconds).rangeBetween(-hours * 3_600_000_000, 0)
    return events.withColumn("used", F.count("*").over(span)).withColumn("allowed", F.col("used") <= most)


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums per event type and window; with ``late``, a watermark that lets a stream close its windows."""
    source = events.withWatermark("ts", late) if late else events
    by = source.groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Runs of a user's events with no pause of ``gap`` or more."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def once(events: DataFrame, key: str, late: str) -> DataFrame:
    """Exactly one row per key within the watermark, for a stream."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def late_split(events: DataFrame, now: str, max_age: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late): refused rows stay visible instead of being dropped."""
    fresh = F.col("ts") >= F.expr(f"timestamp '{now}' - interval {max_age}")
    return events.where(fresh), events.where(~fresh)
