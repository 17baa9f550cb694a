"""Validators: each rule is a query whose rows are its violations, so an empty result means valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import is_true
from tidemark.operators.windows import by_ticker


def _broken(frame: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """A row per key and rule that doesn't hold, in one pass over the frame."""
    names = F.array_compact(F.array(*[F.when(~is_true(ok), F.lit(name)) for name, ok in rules.items()]))
    return frame.select(*keys, F.explode(names).alias("rule"))


def bar_violations(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(rule, ticker, date) of bars that break the OHLCV contract, on no session, or twice; and of missing sessions."""
    positive = lambda c: F.col(c).isNotNull() & (F.col(c) > 0) & (F.col(c) < float("inf"))
    known = bars.join(F.broadcast(sessions.select("date", F.lit(True).alias("_open"))), "date", "left")
    known = known.withColumn("_n", F.count("*").over(Window.partitionBy("ticker", "date")))
    rules = {f"{c}_positive": positive(c) for c in ("open", "high", "low", "close")} | {
        "volume_not_negative": F.col("volume") >= 0,
        "high_is_highest": F.col("high") >= F.greatest("open", "close", "low"),
        "low_is_lowest": F.col("low") <= F.least("open", "close", "high"),
        "is_session": F.col("_open"),
        "unique": F.col("_n") == 1,
    }
    from tidemark.operators.joins import missing_sessions

    gaps = missing_sessions(bars, sessions).select("ticker", "date", F.lit("no_gap").alias("rule"))
    return _broken(known, rules, ["ticker", "date"]).unionByName(gaps)


def action_violations(actions: DataFrame, bars: DataFrame) -> DataFrame:
    known = actions.join(bars.select("ticker", "date", F.lit(True).alias("_bar")), ["ticker", "date"], "left")
    known = known.withColumn("_n", F.count("*").over(Window.partitionBy("ticker", "date", "kind")))
    rules = {"kind": F.col("kind").isin("split", "dividend"), "value_positive": (F.col("value") > 0) & (F.col("value") < float("inf")), "has_bar": F.col("_bar"), "unique": F.col("_n") == 1}
    return _broken(known, rules, ["ticker", "date", "kind"])


def split_discontinuities(bars_with_actions: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Splits at which the open does not move by the ratio."""
    off = F.abs(F.lag("close").over(by_ticker()) / F.col("open") / F.col("split") - 1)
    return bars_with_actions.withColumn("off", off).where((F.col("split") != 1) & ~is_true(F.col("off") <= tolerance)).select("ticker", "date", "split", "off")


def sealed(frame: DataFrame, last: str) -> DataFrame:
    """Rows after the last research day; the comparison reaches the scan."""
    return frame.where(F.col("date") > F.lit(last).cast("date"))


def return_row_violations(returns: DataFrame) -> DataFrame:
    """Rows out of order, repeated, or not finite; wants trial, session, r, in the order of n."""
    by = Window.partitionBy("trial").orderBy("n")
    before = F.lag("session").over(by)
    rules = {"increasing": before.isNull() | (F.col("session") > before), "finite": F.col("r").isNotNull() & (F.abs("r") < float("inf"))}
    rows = returns.withColumns({f"_{k}": is_true(ok) for k, ok in rules.items()})
    return _broken(rows, {k: F.col(f"_{k}") for k in rules}, ["trial", "session", "n"])


def panel_violations(weights: DataFrame) -> DataFrame:
    """Sessions whose weights are negative, not finite, or over 1 in total."""
    w = F.col("weight")
    per = weights.groupBy("date").agg(F.bool_and(w.isNotNull() & (F.abs(w) < float("inf"))).alias("f"), F.min(w).alias("least"), F.sum(w).alias("gross"))
    return _broken(per, {"finite": F.col("f"), "long_only": F.col("least") >= 0, "gross_cap": F.col("gross") <= 1 + 1e-9}, ["date"])


def research_eligibility(bars: DataFrame, *, as_of: str, rows: int = 252, floor: float = 5.0, liquidity: float = 1e6, recent: int = 20) -> DataFrame:
    """Per ticker: the reasons that keep it out of research on a day, in a fixed order."""
    past = bars.where(F.col("date") <= F.lit(as_of).cast("date")).withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))))
    per = past.groupBy("ticker").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("_n") == 1, F.col("close"))).alias("last_close"),
        F.percentile(F.when(F.col("_n") <= recent, F.col("close") * F.col("volume")), F.lit(0.5)).alias("median_dollars"),
    )
    rules = {"insufficient_history": F.col("n") < rows, "price_below_floor": ~is_true(F.col("last_close") >= floor), "illiquid": ~is_true(F.col("median_dollars") >= liquidity)}
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return per.withColumn("reasons", F.array_join(reasons, ","))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that fails, null if none does; a missing answer fails."""
    return F.coalesce(*[F.when(~is_true(ok), F.lit(name)) for name, ok in rules])


def part_screen(parts: DataFrame) -> DataFrame:
    """A first-failing-rule chain over instrument names and attributes."""
    rules = [
        ("not_flagged", F.col("p_size") >= 5),
        ("test_issue", ~F.col("p_name").rlike(r"(?i)\btest\b")),
        ("below_floor", F.col("p_retailprice") >= 950),
        ("excluded_type", ~F.col("p_type").contains("PROMO")),
    ]
    return parts.withColumn("reason", first_reason(rules))


def union_of(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
