"""Selections, signals and baselines as DataFrame operators over a dense panel or bars."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import full, is_true, latch
from tidemark.operators.windows import by_ticker, observed_window, panel_log_returns, past_return

MONTH = 21
def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def _named(frame: DataFrame, held: Column, name: str = "held") -> DataFrame:
    return frame.withColumn(name, is_true(held))


def momentum(panel: DataFrame, months: int) -> DataFrame:
    """All closes of the lookback seen, and the return up to a month ago positive."""
    lag = MONTH * months
    return _named(panel, observed_window(lag + 1) & (past_return(lag, MONTH) > 0))


def trend(panel: DataFrame, sessions: int) -> DataFrame:
    """Above the average of the closes seen; a difference under 1e-9 is the running mean's own rounding."""
    c = F.col("close")
    return _named(panel, observed_window(sessions) & (F.round(c - full(F.avg(c), c, by_ticker(), sessions), 9) > 0))


def risk_parity(panel: DataFrame) -> DataFrame:
    return _named(panel, observed_window(61))


def top_k(frame: DataFrame, score: str, eligible: str, k: int, highest: bool) -> DataFrame:
    """``held``: the k best eligible scores of a session, ties to the earlier ticker; none while fewer than k are eligible."""
    order = [F.desc(score) if highest else F.asc(score), F.asc("ticker")]
    place = F.row_number().over(Window.partitionBy("date", eligible).orderBy(*order))
    enough = F.sum(F.col(eligible).cast("int")).over(by_date()) >= k
    return _named(frame, F.col(eligible) & enough & (place <= k))


def cross_momentum(panel: DataFrame, k: int) -> DataFrame:
    lag = 12 * MONTH
    scored = panel.withColumns({"score": past_return(lag, MONTH), "eligible": observed_window(lag + 1)})
    return top_k(scored, "score", "eligible", k, highest=True)


def dual_momentum(panel: DataFrame, months: int, safe: str) -> DataFrame:
    """The best risky ticker where it beats the safe one, else the safe one where that is eligible."""
    lag = MONTH * months
    scored = panel.withColumns({"score": past_return(lag), "eligible": observed_window(lag + 1)})
    risky = F.col("ticker") != safe
    scored = scored.withColumn("risky_ok", risky & F.col("eligible"))
    place = F.row_number().over(Window.partitionBy("date", "risky_ok").orderBy(F.desc("score"), "ticker"))
    scored = scored.withColumn("winner", F.col("risky_ok") & (place == 1))
    top = F.max(F.when(F.col("winner"), F.col("score"))).over(by_date())
    safe_ok = F.max(F.when(~risky, F.col("eligible"))).over(by_date())
    beats = is_true(safe_ok & (top > F.max(F.when(~risky, F.col("score"))).over(by_date())))
    return _named(scored, F.when(risky, F.col("winner") & beats).otherwise(F.col("eligible") & ~beats))


def low_volatility(panel: DataFrame, group: list[str], k: int = 3) -> DataFrame:
    r = F.col("log_return")
    scored = panel_log_returns(panel.where(F.col("ticker").isin(group))).withColumns({"score": full(F.stddev_samp(r), r, by_ticker(), 60), "eligible": observed_window(61)})
    return top_k(scored, "score", "eligible", k, highest=False)


def reversal(panel: DataFrame, group: list[str], k: int = 3) -> DataFrame:
    scored = panel.where(F.col("ticker").isin(group)).withColumns({"score": past_return(5), "eligible": observed_window(6)})
    return top_k(scored, "score", "eligible", k, highest=False)


def hypotheses(safe: str, group: list[str]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The declared configurations, one plan each."""
    return {
        **{f"H1-{m}": (lambda p, m=m: momentum(p, m)) for m in (3, 6, 12)},
        **{f"H2-{n}": (lambda p, n=n: trend(p, n)) for n in (100, 200)},
        **{f"H3-{k}": (lambda p, k=k: cross_momentum(p, k)) for k in (3, 5)},
        "H4": risk_parity,
        "H5": lambda p: momentum(p, 12),  # its risk-parity window is part of the momentum one
        **{f"H6-{m}": (lambda p, m=m: dual_momentum(p, m, safe)) for m in (6, 12)},
        "H7": lambda p: low_volatility(p, group),
        "H8": lambda p: reversal(p, group),
    }


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """Decided on the first row, entered at the second row's open, never left."""
    n = F.row_number().over(by_ticker())
    return bars.withColumns({"buy_next_open": n == 2, "sell_next_open": F.lit(False)})


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of a key; any engine can repeat it."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def random_selection(panel: DataFrame, decisions: DataFrame, *, enter: float, leave: float, start: float, seed: int) -> DataFrame:
    """A long/flat chain per ticker that moves on decision rows and carries between them.

    With the draw u of a decision row, u < min(enter, 1 - leave) sets the state whatever it was,
    u >= max(...) clears it, and between the two the state either stays or flips; the parity of flips since the
    last set or clear gives it in one window pass.
    """
    u = F.when(F.col("decides"), uniform(F.concat_ws("|", F.lit(str(seed)), "ticker", F.col("date").cast("string"))))
    rows = panel.join(F.broadcast(decisions.select("date", "decides")), "date").withColumn("u", u)
    first = F.min(F.when(F.col("decides"), F.col("date"))).over(Window.partitionBy("ticker"))
    to_long, to_flat = F.col("u") < F.lit(enter), F.col("u") < F.lit(leave)  # what a flat and a long state would do
    fixed = (
        F.when(~F.col("decides"), F.lit(None))
        .when(F.col("date") == first, (F.col("u") < start).cast("int"))
        .when(to_long & ~to_flat, 1)
        .when(~to_long & to_flat, 0)
    )
    flips = F.when(F.col("decides") & (F.col("date") != first) & to_long & to_flat, 1).otherwise(0)
    past = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_fixed": fixed, "_flips": flips})
    rows = rows.withColumns({"_run": F.sum("_flips").over(past)})
    rows = rows.withColumn("_base", F.when(F.col("_fixed").isNotNull(), F.struct(F.col("_fixed").alias("v"), F.col("_run").alias("r"))))
    rows = rows.withColumn("_last", F.last("_base", ignorenulls=True).over(past))
    state = (F.col("_last.v") + F.col("_run") - F.col("_last.r")) % 2 == 1
    return _named(rows, state & F.col("close").isNotNull()).drop("_fixed", "_flips", "_run", "_base", "_last")


def matched_activity(held: DataFrame) -> DataFrame:
    """One row: enter, exit and initial rates of a selection on its decision rows; wants close, held, decides."""
    rows = held.where("decides").withColumn("present", F.col("close").isNotNull())
    rows = rows.withColumns({"was": F.lag("held").over(by_ticker()), "both": F.col("present") & is_true(F.lag("present").over(by_ticker()))})
    rate = lambda moved, base: F.coalesce(F.try_divide(F.count_if(moved).cast("double"), F.count_if(base).cast("double")), F.lit(0.0))
    was, now, both = F.col("was"), F.col("held"), F.col("both")
    return rows.agg(rate(both & ~was & now, both & ~was).alias("enter_probability"), rate(both & was & ~now, both & was).alias("exit_probability"), rate(now, F.col("present")).alias("initial_probability"))


def cost_hurdle(price: Column, commission: float, slippage_bps: float, shares: int = 1) -> Column:
    """The simple return a round trip must earn to pay for itself."""
    s = slippage_bps / 10_000
    return (2 * s + F.lit(2.0 * commission) / (shares * price)) / (1 - s)


def hysteresis_positions(rows: DataFrame, exit_threshold: float = 0.0) -> DataFrame:
    """Enter above the hurdle, stay until below the exit; an unknown prediction is flat.  Wants prediction, hurdle."""
    p = F.col("prediction")
    return rows.withColumn("desired_long", latch(p > F.col("hurdle"), p.isNull() | (p < exit_threshold), by_ticker()))


def orders_of(rows: DataFrame) -> DataFrame:
    """Changes of desired_long, then one row later as orders."""
    before = F.lag("desired_long", 1, False).over(by_ticker())
    moved = rows.withColumns({"_in": F.col("desired_long") & ~before, "_out": ~F.col("desired_long") & before})
    return moved.withColumns({"buy_next_open": F.lag("_in", 1, False).over(by_ticker()), "sell_next_open": F.lag("_out", 1, False).over(by_ticker())}).drop("_in", "_out")


def select_universe(pool: DataFrame, size: int, class_cap: int) -> DataFrame:
    """Class leaders first, then by volume, at most ``class_cap`` of a class; ties by ticker.  Wants ticker, class, volume.

    The last ranking runs over at most class_cap names per class.
    """
    in_class = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("volume"), "ticker"))
    kept = pool.withColumn("_c", in_class).where(F.col("_c") <= class_cap)
    place = F.row_number().over(Window.orderBy((F.col("_c") > 1).cast("int"), F.desc("volume"), "ticker"))
    return kept.withColumn("place", place).where(F.col("place") <= size).select("ticker", "class", "volume", "place")


def log_hurdle(price: Column, *, commission: float, slippage_bps: float, shares: float = 1.0) -> Column:
    """The log return that pays for a round trip: commission a share and slippage, both ways."""
    return F.log1p(2 * (F.lit(commission) / (price * shares) + slippage_bps / 1e4))


def direction_positions(predicted: Column) -> Column:
    """Held where the predicted class is 1; an unknown one is flat."""
    return F.coalesce(predicted == 1, F.lit(False))


def carried_selection(selection: DataFrame, decides: Column) -> DataFrame:
    """The selection of decision rows carried on to the next one, only where there is a close."""
    kept = F.last(F.when(decides, F.col("held")), ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    return selection.withColumn("held", F.coalesce(kept, F.lit(False)) & F.col("close").isNotNull())


def random_selections(panel: DataFrame, decisions: DataFrame, seeds: list[int], **rates: float) -> DataFrame:
    """A random selection for each of two or more different seeds, told apart by ``seed``."""
    if len(set(seeds)) < 2 or len(set(seeds)) < len(seeds):
        raise ValueError("two or more different seeds are wanted")
    books = [random_selection(panel, decisions, seed=s, **rates).withColumn("seed", F.lit(s)) for s in seeds]
    return reduce(DataFrame.unionByName, books)


def covered_signal(rows: DataFrame) -> DataFrame:
    """Orders of a position and ``first_covered``, the ticker's first row (from 1) with a prediction; null without any."""
    n = F.row_number().over(by_ticker())
    out = orders_of(rows).withColumn("_n", n)
    covered = F.min(F.when(F.col("prediction").isNotNull(), F.col("_n"))).over(Window.partitionBy("ticker"))
    return out.withColumn("first_covered", covered).drop("_n")


def random_round_trips(bars: DataFrame, trips: int, hold: int, seed: int) -> DataFrame:
    """Per ticker, ``trips`` round trips of ``hold`` rows with at least a row between two: (ticker, trip, entry, exit).

    The trips' slots are the rows with the smallest uniforms among the first rows - trips * hold - 1; each slot then moves by the trips
    before it, so every arrangement is as likely.  A ticker with fewer than trips * (hold + 1) + 1 rows raises.
    """
    by = Window.partitionBy("ticker")
    rows = bars.select("ticker", "date", (F.row_number().over(by_ticker()) - 1).alias("k"), F.count("*").over(by).alias("m"))
    room = F.when(F.col("m") >= trips * (hold + 1) + 1, F.col("m") - trips * hold).otherwise(F.raise_error(F.concat(F.lit("too few rows for the trips of "), F.col("ticker"))).cast("long"))
    u = uniform(F.concat_ws("|", F.lit(str(seed)), F.col("ticker"), F.col("k").cast("string")))
    slots = rows.where(F.col("k") < room - 1).withColumn("n", F.row_number().over(by.orderBy(u, "k"))).where(F.col("n") <= trips)
    slots = slots.select("ticker", F.row_number().over(by.orderBy("k")).alias("trip"), "k")
    entry = F.col("k") + (F.col("trip") - 1) * hold
    ends = slots.select("ticker", "trip", F.explode(F.array(F.struct(entry.alias("k"), F.lit(True).alias("in")), F.struct((entry + hold).alias("k"), F.lit(False).alias("in")))).alias("e")).select("ticker", "trip", "e.*")
    found = ends.join(rows.select("ticker", "date", "k"), ["ticker", "k"])
    return found.groupBy("ticker", "trip").agg(F.max(F.when(F.col("in"), F.col("date"))).alias("entry"), F.max(F.when(~F.col("in"), F.col("date"))).alias("exit"))
