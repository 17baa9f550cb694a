"""Causal features and labels: row t uses rows up to t, labels excepted.

Every operator takes bars (ticker, date, open, high, low, close, volume) or a
dense panel with session_no, and hash-partitions by ticker once: all windows of
one operator share a specification, so they share a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import SESSIONS_PER_YEAR, ewm_std, finite, full, is_true, log_ratio, with_edge

def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")

WHOLE = Window.unboundedPreceding


def sma_crossover(bars: DataFrame, short: int = 10, long: int = 30) -> DataFrame:
    """Crossings of two moving averages, acted on at the next row's open."""
    if short >= long:
        raise ValueError("short must be smaller than long")
    c = F.col("close")
    out = bars.withColumns({"short_sma": full(F.avg(c), c, by_ticker(), short), "long_sma": full(F.avg(c), c, by_ticker(), long)})
    s, lo = F.col("short_sma"), F.col("long_sma")
    s1, l1 = F.lag(s).over(by_ticker()), F.lag(lo).over(by_ticker())
    out = out.withColumns({"crosses_above": is_true((s > lo) & (s1 <= l1)), "crosses_below": is_true((s < lo) & (s1 >= l1))})
    return out.withColumns({"buy_next_open": F.lag("crosses_above", 1, False).over(by_ticker()), "sell_next_open": F.lag("crosses_below", 1, False).over(by_ticker())})


def features(bars: DataFrame, short: int = 10, long: int = 30, vol: int = 20, horizon: int = 5) -> DataFrame:
    """Scale-free features with inference and training eligibility; no row is dropped."""
    c, v = F.col("close"), F.col("volume")
    out = bars.withColumn("log_return", log_ratio(c, F.lag(c).over(by_ticker())))
    short_sma, long_sma = full(F.avg(c), c, by_ticker(), short), full(F.avg(c), c, by_ticker(), long)
    columns = {
        "volatility": full(F.stddev_samp("log_return"), F.col("log_return"), by_ticker(), vol),
        "sma_spread": finite(F.try_divide(short_sma, long_sma)) - 1,
        "close_to_short": finite(F.try_divide(c, short_sma)) - 1,
        "relative_volume": finite(F.try_divide(v, full(F.avg(v), v, by_ticker(), vol))),
        "label": forward_return(horizon),
    }
    out = out.withColumns(columns)
    known = F.lit(True)
    for name in ("log_return", "volatility", "sma_spread", "close_to_short", "relative_volume"):
        known = known & F.col(name).isNotNull()
    return out.withColumns({"inference_eligible": known, "train_eligible": known & F.col("label").isNotNull()})


def forward_return(horizon: int) -> Column:
    """ln(open[t + h + 1] / open[t + 1])."""
    return log_ratio(F.lead("open", horizon + 1).over(by_ticker()), F.lead("open").over(by_ticker()))


def direction_label(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """1 where the next-open forward return is positive, 0 where it is not, null where unknown."""
    return bars.withColumn("label", (forward_return(horizon) > 0).cast("int"))


def forward_return_label(bars_with_actions: DataFrame, horizon: int = 5) -> DataFrame:
    """The forward return, null if a split or dividend falls on rows t + 2 .. t + h + 1; wants ``has_action``."""
    hit = F.max(F.col("has_action").cast("int")).over(by_ticker().rowsBetween(2, horizon + 1))
    return bars_with_actions.withColumn("label", F.when(F.coalesce(hit, F.lit(0)) == 0, forward_return(horizon)))


def panel_log_returns(panel: DataFrame) -> DataFrame:
    """By row position: a missing session gives null on both sides of it, never a stitched return."""
    return panel.withColumn("log_return", log_ratio(F.col("close"), F.lag("close").over(by_ticker())))


def realized_volatility(panel: DataFrame, window: int = 20) -> DataFrame:
    r = F.col("log_return")
    return panel_log_returns(panel).withColumn("volatility", full(F.stddev_samp(r), r, by_ticker(), window) * F.sqrt(F.lit(SESSIONS_PER_YEAR)))


def ewma_volatility(panel: DataFrame, span: int = 60) -> DataFrame:
    """Weights advance with the session number, over sessions without a bar too."""
    r = panel_log_returns(panel).withColumn("position", F.row_number().over(by_ticker()) - 1)
    return r.withColumn("volatility", ewm_std(F.col("log_return"), F.col("position"), by_ticker(), span) * F.sqrt(F.lit(SESSIONS_PER_YEAR))).drop("position")


def trailing_correlation(panel: DataFrame, window: int = 60) -> DataFrame:
    """(date, a, b, correlation) of ticker pairs a < b over the last ``window`` complete sessions."""
    r = panel_log_returns(panel).select("session_no", "date", "ticker", "log_return")
    a = r.select("session_no", "date", F.col("ticker").alias("a"), F.col("log_return").alias("ra"))
    b = r.select("session_no", F.col("ticker").alias("b"), F.col("log_return").alias("rb"))
    both = a.join(b, "session_no").where("a < b")
    spec = Window.partitionBy("a", "b").orderBy("session_no").rowsBetween(1 - window, 0)
    known = F.count(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), 1)).over(spec) == window
    # by moments: corr() of a flat series would be NaN
    m = {k: F.avg(F.expr(e)).over(spec) for k, e in (("xy", "ra * rb"), ("x", "ra"), ("y", "rb"), ("xx", "ra * ra"), ("yy", "rb * rb"))}
    var = (m["xx"] - m["x"] * m["x"]) * (m["yy"] - m["y"] * m["y"])
    return both.withColumn("correlation", F.when(known & (var > 0), (m["xy"] - m["x"] * m["y"]) / F.sqrt(var))).select("date", "a", "b", "correlation")


def observed_window(rows: int) -> Column:
    """All ``rows`` closes that end at t are there."""
    return F.count("close").over(by_ticker().rowsBetween(1 - rows, 0)) == rows


def past_return(start: int, end: int = 0) -> Column:
    return F.lag("close", end).over(by_ticker()) / F.lag("close", start).over(by_ticker()) - 1


def research_close(bars_with_actions: DataFrame) -> DataFrame:
    """Causal total-return close (its log, as the product grows without bound) and split-adjusted volume; wants split and dividend."""
    before = F.lag("close").over(by_ticker())
    gross = F.when(before.isNull(), 0.0).otherwise(F.log(F.col("split") * (F.col("close") + F.col("dividend")) / before))
    out = bars_with_actions.withColumn("_g", gross).withColumn("_s", F.log("split"))
    past = by_ticker().rowsBetween(WHOLE, 0)
    first = F.first("close").over(past)
    return out.withColumns({"log_research_close": F.log(first) + F.sum("_g").over(past), "research_volume": F.col("volume") / F.exp(F.sum("_s").over(past))}).drop("_g", "_s")


def back_adjusted(bars_with_actions: DataFrame) -> DataFrame:
    """Log of the close adjusted backwards from the last row for later splits and dividends."""
    before = F.lag("close").over(by_ticker())
    step = F.when(before.isNull(), 0.0).otherwise(F.log(before / (F.col("split") * (before - F.col("dividend") / F.col("split")))))
    out = bars_with_actions.withColumn("_f", step)
    later = F.coalesce(F.sum("_f").over(by_ticker().rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return out.withColumn("log_adjusted_close", F.log("close") - later).drop("_f")


def equity_log_returns(equity: DataFrame, capital: float) -> DataFrame:
    """Anchored at the capital; null if either side is not positive."""
    by = Window.partitionBy("account").orderBy("session")
    return equity.withColumn("log_return", log_ratio(F.col("equity"), F.coalesce(F.lag("equity").over(by), F.lit(capital))))


def daily_log_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("log_return", log_ratio(F.col("close"), F.lag("close").over(by_ticker()))).withColumn("_n", F.row_number().over(by_ticker())).where("_n > 1").drop("_n")


def growth_index(bars: DataFrame) -> DataFrame:
    """Log of the growth since the first close: 0 there."""
    r = F.coalesce(log_ratio(F.col("close"), F.lag("close").over(by_ticker())), F.lit(0.0))
    return bars.withColumn("_r", r).withColumn("log_growth", F.sum("_r").over(by_ticker().rowsBetween(WHOLE, 0))).drop("_r")


def allocation_eligibility(panel: DataFrame, rows: int = 61) -> DataFrame:
    """Held once ``rows`` closes were seen and while a close is there."""
    return panel.withColumn("held", F.col("close").isNotNull() & (F.count("close").over(by_ticker().rowsBetween(WHOLE, 0)) >= rows))


def trend_monitor(bars: DataFrame, window: int = 63) -> DataFrame:
    """Trend state, whether the next return agreed, and the hit rate over a full window of known outcomes."""
    c = F.col("close")
    out = bars.withColumn("trend", full(F.avg(c), c, by_ticker(), 10) > full(F.avg(c), c, by_ticker(), 30))
    out = out.withColumn("next_return", log_ratio(F.lead("close").over(by_ticker()), c))
    out = out.withColumn("hit", F.when(F.col("trend").isNotNull(), ((F.col("next_return") > 0) == F.col("trend")).cast("int")))
    return out.withColumn("hit_rate", full(F.avg("hit"), F.col("hit"), by_ticker(), window))


def decay_table(bars: DataFrame, window: int = 63) -> DataFrame:
    """Per ticker: matured outcomes among its last ``window`` ones, and their hit rate."""
    matured = trend_monitor(bars).where("hit is not null")
    last = matured.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("_n") <= window)
    return last.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.avg("hit").alias("hit_rate"))


def trend_confidence(bars: DataFrame, short: int = 10, long: int = 30) -> DataFrame:
    """1.0 where the short average of the closes seen so far is above the long one, else 0.0; null until the long one is full."""
    seen = bars.where("close is not null")
    c = F.col("close")
    return seen.withColumn("confidence", (full(F.avg(c), c, by_ticker(), short) > full(F.avg(c), c, by_ticker(), long)).cast("double"))


def marks(panel: DataFrame) -> DataFrame:
    """The last close at or before each session."""
    return panel.withColumn("mark", F.last("close", ignorenulls=True).over(by_ticker().rowsBetween(WHOLE, 0)))


def cost_surface(panel: DataFrame, window: int = 21) -> DataFrame:
    """Per ticker and session: half spread, volatility and average volume of the last ``window`` sessions, or the reason
    why there is no estimate.  The total for a fill is half_spread + sigma * sqrt(quantity / adv)."""
    recent = by_ticker().rowsBetween(1 - window, 0)
    bars = panel.where("close is not null")
    bars = with_edge(bars.withColumns({"_lr": log_ratio(F.col("close"), F.lag("close").over(by_ticker()))}), by_ticker(), window - 1, "_s2")
    known = F.row_number().over(by_ticker()) > window
    whole = F.col("session_no") - F.lag("session_no", window).over(by_ticker()) == window
    out = bars.withColumns({"_known": known, "_whole": whole, "adv": F.avg("volume").over(recent), "sigma": F.stddev_samp("_lr").over(recent)})
    reason = F.when(~F.col("_known"), "warmup").when(~is_true(F.col("_whole")), "missing_session").when(F.col("_s2").isNull(), "spread_undefined").when(F.col("adv") <= 0, "zero_adv")
    out = out.withColumn("reason", reason)
    fine = F.col("reason").isNull()
    return out.select("ticker", "date", F.when(fine, F.sqrt(F.abs("_s2")) / 2).alias("half_spread"), F.when(fine, F.col("sigma")).alias("sigma"), F.when(fine, F.col("adv")).alias("adv"), F.when(fine, F.col("_s2") < 0).alias("negative"), "reason")
