"""Portfolio weights over (date, ticker) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def volatility_target(confidence: Column, volatility: Column, target: float) -> Column:
    """confidence * target / volatility; 0 where either is missing or the volatility is not positive and finite."""
    fine = (confidence > 0) & (volatility > 0) & (volatility < float("inf"))
    return F.when(F.coalesce(fine, F.lit(False)), confidence * target / volatility).otherwise(0.0)


def gross_cap(weight: Column, cap: float) -> Column:
    """Scaled down in proportion where a session's total is over the cap."""
    total = F.sum(weight).over(by_date())
    return F.when(total > cap, weight * cap / total).otherwise(weight)


def entry_halt(target: Column, current: Column, halted: Column) -> Column:
    return F.when(halted, F.least(target, current)).otherwise(target)


def correlation_adjusted(weights: DataFrame, correlation: DataFrame) -> DataFrame:
    """Each held weight over the sum of its positive correlations with the held names, its own being 1.

    Wants weights (date, ticker, weight) and correlation (date, a, b, correlation) for a < b; a held
    pair without a correlation leaves ``overlap`` null.
    """
    held = weights.where("weight > 0").select("date", "ticker")
    sides = correlation.select("date", F.col("a").alias("ticker"), F.col("b").alias("other"), "correlation").unionByName(correlation.select("date", F.col("b").alias("ticker"), F.col("a").alias("other"), "correlation"))
    pairs = sides.join(held, ["date", "ticker"]).join(held.withColumnRenamed("ticker", "other"), ["date", "other"])
    n_held = held.groupBy("date").agg(F.count("*").alias("k"))
    sums = pairs.groupBy("date", "ticker").agg(F.sum(F.greatest("correlation", F.lit(0.0))).alias("s"), F.count("correlation").alias("n"))
    overlap = F.when(F.col("weight") > 0, F.when(F.coalesce("n", F.lit(0)) == F.col("k") - 1, 1 + F.coalesce("s", F.lit(0.0))))
    out = weights.join(n_held, "date", "left").join(sums, ["date", "ticker"], "left").withColumn("overlap", overlap)
    return out.withColumn("adjusted", F.when(F.col("weight") > 0, F.col("weight") / F.col("overlap")).otherwise(0.0)).drop("k", "s", "n")


def equal_weight(selection: DataFrame, cap: float) -> DataFrame:
    """cap / k for each of the k names held in a session."""
    k = F.sum(F.col("held").cast("int")).over(by_date())
    return selection.withColumn("weight", F.when(F.col("held"), F.lit(cap) / k).otherwise(0.0))


def fixed_allocation(panel: DataFrame, allocation: dict[str, float]) -> DataFrame:
    """The allocation where all its names have a close, else flat."""
    share = F.coalesce(*[F.when(F.col("ticker") == t, F.lit(float(w))) for t, w in allocation.items()], F.lit(0.0))
    legs = F.count(F.when(F.col("ticker").isin(list(allocation)), F.col("close"))).over(by_date())
    return panel.withColumn("weight", F.when(legs == len(allocation), share).otherwise(0.0))


def blend(*books: DataFrame) -> DataFrame:
    """The average of weight books (date, ticker, weight)."""
    total = books[0].select("date", "ticker", "weight")
    for book in books[1:]:
        total = total.unionByName(book.select("date", "ticker", "weight"))
    return total.groupBy("date", "ticker").agg((F.sum("weight") / len(books)).alias("weight"))


def pair_covariance(returns: DataFrame, window: int) -> DataFrame:
    """(date, a, b, cov) for a <= b over the last ``window`` sessions, where all of them have both returns."""
    r = returns.select("session_no", "date", "ticker", "log_return")
    a = r.select("session_no", "date", F.col("ticker").alias("a"), F.col("log_return").alias("x"))
    b = r.select("session_no", F.col("ticker").alias("b"), F.col("log_return").alias("y"))
    spec = Window.partitionBy("a", "b").orderBy("session_no").rowsBetween(1 - window, 0)
    both = a.join(b, "session_no").where("a <= b")
    n = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).over(spec)
    cov = (F.avg(F.col("x") * F.col("y")).over(spec) - F.avg("x").over(spec) * F.avg("y").over(spec)) * F.lit(window / (window - 1) * 252)
    return both.withColumn("cov", F.when(n == window, cov)).select("date", "a", "b", "cov")


def volatility_target_book(selection: DataFrame, covariance: DataFrame, target: float, cap: float) -> DataFrame:
    """1 / volatility legs scaled together to the target risk, then capped; flat where a held pair has no covariance.

    Wants selection (date, ticker, held) and covariance (date, a, b, cov) with a <= b.
    """
    own = covariance.where("a = b").select("date", F.col("a").alias("ticker"), F.sqrt("cov").alias("vol"))
    legs = selection.join(own, ["date", "ticker"], "left").withColumn("leg", volatility_target(F.col("held").cast("double"), F.col("vol"), 1.0))
    held = legs.where("leg > 0").select("date", "ticker", "leg")
    pairs = covariance.join(held.select("date", F.col("ticker").alias("a"), F.col("leg").alias("la")), ["date", "a"]).join(held.select("date", F.col("ticker").alias("b"), F.col("leg").alias("lb")), ["date", "b"])
    double = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    risk = pairs.groupBy("date").agg(F.sum(double * F.col("la") * F.col("lb") * F.col("cov")).alias("risk"), F.count("cov").alias("n"))
    k = held.groupBy("date").agg(F.count("*").alias("k"))
    risk = risk.join(k, "date").where((F.col("n") == F.col("k") * (F.col("k") + 1) / 2) & (F.col("risk") > 0)).select("date", "risk")
    scaled = legs.join(risk, "date", "left").withColumn("weight", F.coalesce(F.col("leg") * target / F.sqrt("risk"), F.lit(0.0)))
    return scaled.withColumn("weight", gross_cap(F.col("weight"), cap)).select("date", "ticker", "weight")


def volatility_target_of_returns(selection: DataFrame, returns: DataFrame, window: int, target: float, cap: float) -> DataFrame:
    """``volatility_target_book`` without a covariance for every pair: the risk of a date's legs is the variance of their own weighted
    return over its last ``window`` sessions, a row per name and session instead of one per pair of names.

    Wants selection (date, ticker, held) and returns (session_no, date, ticker, log_return) with a row for each session.
    """
    spec = Window.partitionBy("ticker").orderBy("session_no").rowsBetween(1 - window, 0)
    year = F.lit(window / (window - 1) * 252)
    x = F.col("log_return")
    whole = F.count(x).over(spec) == window
    known = returns.select("date", "ticker", F.when(whole, F.sqrt((F.avg(x * x).over(spec) - F.avg(x).over(spec) * F.avg(x).over(spec)) * year)).alias("vol"), F.when(whole, F.collect_list(x).over(spec)).alias("past"))
    legs = selection.join(known, ["date", "ticker"], "left").withColumn("leg", volatility_target(F.col("held").cast("double"), F.col("vol"), 1.0))
    parts = legs.where("leg > 0").select("date", "leg", F.posexplode("past").alias("back", "x"))
    book = parts.groupBy("date", "back").agg(F.sum(F.col("leg") * F.col("x")).alias("s"))
    risk = book.groupBy("date").agg(((F.avg(F.col("s") * F.col("s")) - F.avg("s") * F.avg("s")) * year).alias("risk")).where("risk > 0")
    scaled = legs.drop("past").join(risk, "date", "left").withColumn("weight", F.coalesce(F.col("leg") * target / F.sqrt("risk"), F.lit(0.0)))
    return scaled.withColumn("weight", gross_cap(F.col("weight"), cap)).select("date", "ticker", "weight")


def random_book(selection: DataFrame, returns: DataFrame, decisions: DataFrame, kind: str, *, cap: float, target: float, window: int) -> DataFrame:
    """(date, ticker, weight) on decision rows of a random selection (date, ticker, held), sized as its candidate's class is.

    Wants returns (session_no, date, ticker, log_return) with a row for each session.
    """
    if kind == "equal_weight_unscaled":
        book = equal_weight(selection, cap)
    elif kind == "equal_legs_vol_target":
        spec = Window.partitionBy("ticker").orderBy("session_no").rowsBetween(1 - window, 0)
        r = F.col("log_return")
        vol = returns.select("date", "ticker", F.when(F.count(r).over(spec) == window, F.stddev_samp(r).over(spec) * F.sqrt(F.lit(252.0))).alias("volatility"))
        met = selection.join(vol, ["date", "ticker"], "left").withColumn("held", F.col("held") & F.coalesce(F.col("volatility") > 0, F.lit(False)))
        book = equal_weight_volatility(met, target)
    elif kind == "inverse_vol_vol_target":
        book = volatility_target_of_returns(selection, returns, window, target, cap)
    else:
        raise ValueError(f"no sizing class {kind!r}")
    days = decisions.where("decides").select("date")
    return book.select("date", "ticker", "weight").join(F.broadcast(days), "date", "left_semi")


def sizing_equity(budget: Column, owned: Column, cash: Column) -> Column:
    return F.least(budget, owned + cash)


def own_sells(held: Column, wanted: Column, own: Column) -> Column:
    """Shares to sell towards what is wanted, of one's own lots only."""
    return F.greatest(F.least(held - wanted, own), F.lit(0.0))


def equal_weight_volatility(selection: DataFrame, target: float) -> DataFrame:
    """1 / k for each of k held names, times target over volatility where that is less than 1; wants held, volatility."""
    k = F.sum(F.col("held").cast("int")).over(by_date())
    return selection.withColumn("weight", F.when(F.col("held"), F.least(F.lit(1.0), target / F.col("volatility")) / k).otherwise(0.0))


def target_weights(rows: DataFrame, correlation: DataFrame, *, target: float, name_cap: float, cap: float) -> DataFrame:
    """The chain from confidence to weight, whose order matters: volatility target, cap of a name, overlap with the names held,
    gross cap of a session, halted entries.

    Wants rows (date, ticker, confidence, volatility, current, halted).  A name whose overlap is unknown has a null weight and
    takes no part in the gross cap.
    """
    alone = F.coalesce(F.least(volatility_target(F.col("confidence"), F.col("volatility"), target), F.lit(name_cap)), F.lit(0.0))
    adjusted = correlation_adjusted(rows.withColumn("weight", alone), correlation)
    capped = adjusted.withColumn("_capped", gross_cap(F.col("adjusted"), cap))
    return capped.withColumn("weight", F.when(F.col("_capped").isNotNull(), entry_halt(F.col("_capped"), F.col("current"), F.col("halted")))).drop("_capped", "adjusted", "overlap")
