"""Point-in-time joins: as-of, interval, bitemporal, and reconciliations of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 1e-12


def actions_onto_bars(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Left join by ticker and date with the actions by kind; no split is 1, no dividend 0."""
    pick = lambda kind, how: how(F.when(F.col("kind") == kind, F.col("value")))
    by_day = actions.groupBy("ticker", "date").agg(pick("split", F.max).alias("split"), pick("dividend", F.sum).alias("dividend"))
    out = bars.join(by_day, ["ticker", "date"], "left")
    return out.withColumns({"split": F.coalesce("split", F.lit(1.0)), "dividend": F.coalesce("dividend", F.lit(0.0)), "has_action": F.col("split").isNotNull() | F.col("dividend").isNotNull()})


def missing_sessions(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions inside a ticker's own first and last bar without a bar."""
    spans = bars.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    expected = spans.join(F.broadcast(sessions), F.col("date").between(F.col("a"), F.col("b"))).select("ticker", "date")
    return expected.join(bars.select("ticker", "date"), ["ticker", "date"], "left_anti")


def dividends_only(actions: DataFrame) -> DataFrame:
    """(ticker, date, value) of an action table's dividends; ValueError unless it has one instrument."""
    names = [r.ticker for r in actions.select("ticker").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError("dividends are reconciled for one instrument at a time")
    return actions.where("kind = 'dividend'").select("ticker", "date", "value")


def reconcile(first: DataFrame, second: DataFrame, covered: Column, tolerance: float) -> DataFrame:
    """Full outer join of (ticker, date, value); one status per key, the first rule that fails names the reason."""
    both = first.withColumnRenamed("value", "mine").join(second.withColumnRenamed("value", "theirs"), ["ticker", "date"], "full_outer")
    one_sided = F.col("mine").isNull() | F.col("theirs").isNull()
    near = F.abs(F.col("mine") - F.col("theirs")) <= tolerance + SLACK
    status = F.when(~covered, "unreconciled").when(one_sided, "mismatch").when(F.coalesce(near, F.lit(False)), "reconciled").otherwise("mismatch")
    reason = F.when(~covered, "outside coverage").when(F.col("mine").isNull(), "second source only").when(F.col("theirs").isNull(), "primary only").when(~F.coalesce(near, F.lit(False)), "amount outside tolerance")
    return both.withColumns({"status": status, "reason": reason})


def close_mismatches(first: DataFrame, second: DataFrame, bps: float) -> DataFrame:
    """Keys missing on a side, with a close that is not positive and finite, or further apart than ``bps``."""
    a = first.select("ticker", "date", F.col("close").alias("mine"))
    b = second.select("ticker", "date", F.col("close").alias("theirs"))
    fine = lambda c: F.col(c).isNotNull() & (F.col(c) > 0) & (F.col(c) < float("inf"))
    off = F.abs(F.col("theirs") / F.col("mine") - 1) * 10_000 > bps
    return a.join(b, ["ticker", "date"], "full_outer").where(~(fine("mine") & fine("theirs")) | off)


def cross_check(first: DataFrame, second: DataFrame, bps: float) -> DataFrame:
    """Per ticker: the number of mismatches and the first session that has one."""
    return close_mismatches(first, second, bps).groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first_date"))


def latest_as_of(facts: DataFrame, keys: list[str], filed: str, as_of: Column) -> DataFrame:
    """The version of each key filed last, at or before a date."""
    rest = [c for c in facts.columns if c not in keys]
    picked = facts.where(F.col(filed) <= as_of).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(filed, *[c for c in rest if c != filed])).alias("_x"))
    return picked.select(*keys, *[F.col(f"_x.{c}") for c in rest])


def vintage(series: DataFrame, as_of: Column) -> DataFrame:
    """Observations as they stood on a date."""
    return series.where((F.col("realtime_start") <= as_of) & (as_of <= F.col("realtime_end")))


def vintage_as_of(series: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session and series: the newest observation known the day before.

    Where every vintage of a date lasts until the next one or has an open end, a date once known stays known, and the
    newest is a running maximum over one sorted union of vintages and sessions.  Series with a withdrawn vintage are
    joined by interval instead.
    """
    known = series.where("value is not null")
    after = F.lead("realtime_start").over(Window.partitionBy("series", "date").orderBy("realtime_start"))
    ends = known.withColumn("_lasts", (F.col("realtime_end") >= F.lit("9999-12-31").cast("date")) | F.coalesce(F.date_add("realtime_end", 1) >= after, F.lit(False)))
    whole = ends.groupBy("series").agg(F.min("_lasts").alias("_whole"))

    days = sessions.select(F.col("date").alias("session"), F.date_sub("date", 1).alias("_t"))
    grid = series.select("series").distinct().crossJoin(F.broadcast(days))
    newest = F.struct("date", "realtime_start", "value")
    # a vintage counts from its start, or from its own date where that is later
    events = known.select("series", F.greatest("realtime_start", "date").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("date").alias("session"), newest.alias("_v"))
    asks = grid.select("series", "_t", F.lit(1).alias("_side"), "session", F.lit(None).cast(events.schema["_v"].dataType).alias("_v"))
    spec = Window.partitionBy("series").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    run = events.unionByName(asks).withColumn("_best", F.max("_v").over(spec)).where("_side = 1").select("series", "session", F.col("_best.value").alias("_run"))

    odd = known.join(whole.where("not _whole").select("series"), "series", "left_semi")
    cover = (odd["date"] <= days["_t"]) & (odd["realtime_start"] <= days["_t"]) & (days["_t"] <= odd["realtime_end"])
    found = odd.join(F.broadcast(days), cover).groupBy("series", "session").agg(F.max_by("value", F.struct("date", "realtime_start")).alias("_found"))
    out = run.join(whole, "series", "left").join(found, ["series", "session"], "left")
    return out.select("series", "session", F.when(F.coalesce("_whole", F.lit(True)), F.col("_run")).otherwise(F.col("_found")).alias("value"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """The last known ``value`` of right at or before each row of left, by one sorted union: null values are passed over, and
    of values at one time the greatest counts.

    No range join: both sides are shuffled once by the key, and a window carries the
    value forward.
    """
    l = left.select(key, F.col(time).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))  # noqa: E741
    r = right.select(key, F.col(time).alias("_t"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    spec = Window.partitionBy(key).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(spec)).where("_side = 1")
    return out.select("_row.*", F.col("_v").alias(value))


def bitemporal_snapshot(facts: DataFrame, as_of: Column) -> DataFrame:
    """Per instrument and field: the value in force on a date by what was observed by its end."""
    seen = facts.where((F.col("effective_date") <= as_of) & (F.col("observed_at") < F.date_add(as_of, 1).cast("timestamp")))
    return seen.groupBy("instrument_id", "field").agg(F.max_by("value", F.struct("effective_date", "observed_at", "o_orderkey")).alias("value"), F.max("effective_date").alias("effective_date"))


def return_matrix(returns: DataFrame, min_coverage: float) -> DataFrame:
    """Rows of the sessions that all trials share, with each trial's coverage and whether all reach the minimum; wants trial, session, r."""
    n = returns.agg(F.count_distinct("trial").alias("n_trials"))
    counted = returns.groupBy("session").agg(F.count("*").alias("k"))
    shared = counted.join(F.broadcast(n), F.col("k") == F.col("n_trials")).select("session")
    per_trial = returns.groupBy("trial").agg(F.count("*").alias("rows"))
    kept = returns.join(shared, "session")
    kept_n = kept.groupBy("trial").agg(F.count("*").alias("kept"))
    coverage = per_trial.join(kept_n, "trial").withColumn("coverage", F.col("kept") / F.col("rows"))
    return kept.join(coverage.select("trial", "coverage"), "trial").withColumn("enough", F.col("coverage") >= min_coverage)


def exposure(holdings: DataFrame, own: DataFrame) -> DataFrame:
    """What a portfolio holds beside one's own lots; wants ticker, quantity."""
    both = holdings.groupBy("ticker").agg(F.sum("quantity").alias("total")).join(own.groupBy("ticker").agg(F.sum("quantity").alias("own")), "ticker", "full_outer")
    left = F.coalesce("total", F.lit(0.0)) - F.coalesce("own", F.lit(0.0))
    return both.select("ticker", F.when(left >= 0, left).alias("external"), (left < 0).alias("refused"))


def close_panel(bars: DataFrame, tickers: list[str]) -> DataFrame:
    """One column of closes per named ticker; two bars of one ticker and date are an error."""
    per = bars.where(F.col("ticker").isin(tickers)).groupBy("date", "ticker").agg(F.count("*").alias("_n"), F.first("close").alias("close"))
    checked = per.withColumn("close", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two bars of "), F.col("ticker"))).cast("double")).otherwise(F.col("close")))
    days = bars.select("date").distinct()
    return days.join(checked.groupBy("date").pivot("ticker", tickers).agg(F.first("close")), "date", "left")


def covered(bars: DataFrame, sessions: DataFrame, first: str, last: str) -> DataFrame:
    """Bars on sessions inside a source's coverage."""
    return bars.where(F.col("date").between(first, last)).join(F.broadcast(sessions.select("date")), "date", "left_semi")
