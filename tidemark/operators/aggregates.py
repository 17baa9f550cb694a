"""Metrics over equity curves, returns and predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import RISK_FREE_ANNUAL, SESSIONS_PER_YEAR

RISK_FREE_LOG = math.log1p(RISK_FREE_ANNUAL)


def sharpe(r: Column, gaps: bool = False) -> Column:
    """Annualised, from log returns; null with any missing return (with ``gaps``, those that are known count), fewer than two, or no variance."""
    sd = F.stddev_samp(r)
    return F.when((F.lit(gaps) | (F.count(r) == F.count("*"))) & (F.count(r) >= 2) & (sd > 0), (F.avg(r) * SESSIONS_PER_YEAR - RISK_FREE_LOG) / (sd * F.sqrt(F.lit(SESSIONS_PER_YEAR))))


def return_stats(returns: DataFrame, key: str) -> DataFrame:
    r = F.col("log_return")
    return returns.groupBy(key).agg(F.count(r).alias("n"), (F.avg(r) * SESSIONS_PER_YEAR).alias("annual_return"), (F.stddev_samp(r) * math.sqrt(SESSIONS_PER_YEAR)).alias("annual_volatility"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("excess_kurtosis"), sharpe(r).alias("sharpe"))


def hac(returns: DataFrame, key: str, order: str, lags: int) -> DataFrame:
    """Mean, Bartlett standard error of the mean, and t of the excess mean; null where undefined."""
    by = Window.partitionBy(key)
    ordered = by.orderBy(order)
    centered = returns.withColumn("_c", F.col("log_return") - F.avg("log_return").over(by))
    cross = {f"_l{k}": F.col("_c") * F.lag("_c", k).over(ordered) for k in range(1, lags + 1)}
    n = F.count("*")
    total = F.sum(F.col("_c") * F.col("_c"))
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_l{k}"), F.lit(0.0))
    se = F.when((n > lags) & (n >= 2), F.sqrt(F.greatest(total / n, F.lit(0.0)) / n))
    out = centered.withColumns(cross).groupBy(key).agg(n.alias("n"), F.avg("log_return").alias("mean"), se.alias("se"))
    return out.withColumn("t", F.when(F.col("se") > 0, (F.col("mean") - RISK_FREE_LOG / SESSIONS_PER_YEAR) / F.col("se")))


def max_drawdown(equity: DataFrame) -> DataFrame:
    """Per account: the worst fall from the running high, its trough (first), and the last high strictly before it."""
    by = Window.partitionBy("account").orderBy("session")
    high = F.max("equity").over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = equity.withColumns({"high": high}).withColumn("drawdown", F.col("equity") / F.col("high") - 1)
    worst = rows.groupBy("account").agg(F.min_by(F.struct("drawdown", "session", "high"), F.struct("drawdown", "session")).alias("w"))
    trough = worst.select("account", F.col("w.drawdown").alias("max_drawdown"), F.col("w.session").alias("trough"), F.col("w.high").alias("peak_value"))
    peaks = equity.join(trough, "account").where("session < trough and equity = peak_value and max_drawdown < 0").groupBy("account").agg(F.max("session").alias("peak"))
    return trough.join(peaks, "account", "left").select("account", "max_drawdown", "peak", "trough")


def trade_summary(trades: DataFrame, key: str) -> DataFrame:
    """A break-even trade is no win."""
    return trades.groupBy(key).agg(F.count("*").alias("n_trades"), F.sum("pnl").alias("total_pnl"), F.coalesce(F.try_divide(F.count_if(F.col("pnl") > 0).cast("double"), F.count("*")), F.lit(0.0)).alias("win_rate"))


def autocorrelation(returns: DataFrame, key: str, order: str, lags: int = 5) -> DataFrame:
    by = Window.partitionBy(key)
    c = returns.where("log_return is not null").withColumn("_c", F.col("log_return") - F.avg("log_return").over(by))
    c = c.withColumns({f"_l{k}": F.col("_c") * F.lag("_c", k).over(by.orderBy(order)) for k in range(1, lags + 1)})
    return c.groupBy(key).agg(*[(F.sum(f"_l{k}") / F.sum(F.col("_c") * F.col("_c"))).alias(f"acf{k}") for k in range(1, lags + 1)])


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation) over rows where all the columns are known; one aggregation for all pairs."""
    known = rows.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = known.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("correlation")) for a, b in pairs])).alias("x")).select("x.*")


def z_scores(rows: DataFrame, column: str, train: Column) -> DataFrame:
    """Scaled by the mean and population deviation of the training rows only; no deviation divides by 1."""
    x = F.when(train, F.col(column))
    fit = rows.agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    return rows.crossJoin(F.broadcast(fit)).withColumn("z", (F.col(column) - F.col("_m")) / F.coalesce(F.nullif("_s", F.lit(0.0)), F.lit(1.0))).drop("_m", "_s")


def distribution(rows: DataFrame, key: str, column: str) -> DataFrame:
    c = F.col(column)
    return rows.groupBy(key).agg(F.min(c).alias("least"), F.percentile(c, F.lit(0.5)).alias("median"), F.percentile(F.abs(c), F.lit(0.9)).alias("q90_abs"), F.max(c).alias("most"), F.avg(c).alias("mean"))
