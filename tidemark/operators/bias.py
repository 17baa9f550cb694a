"""Selection-bias statistics: combinatorially symmetric cross-validation and the deflated Sharpe ratio."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.operators.aggregates import RISK_FREE_LOG, SESSIONS_PER_YEAR

BLOCKS = 16
EULER_GAMMA = 0.5772156649015329


def blocks(matrix: DataFrame) -> DataFrame:
    """matrix (trial, session, r) with ``block``: 16 contiguous near-equal blocks of sessions, extra rows first."""
    numbered = matrix.select("session").distinct().withColumn("block", F.ntile(BLOCKS).over(Window.orderBy("session")) - 1)
    return matrix.join(F.broadcast(numbered), "session")


def splits(spark: SparkSession) -> DataFrame:
    """(split, mask): all choices of 8 of 16 blocks, as bit masks."""
    masks = spark.range(1 << BLOCKS).where(F.bit_count("id") == BLOCKS // 2)
    return masks.select(F.col("id").cast("int").alias("mask"))


def split_sizes(matrix: DataFrame) -> DataFrame:
    """(mask, inside, outside): sessions in either half of every split."""
    per = blocks(matrix).select("session", "block").distinct().groupBy("block").agg(F.count("*").alias("n"))
    sizes = per.agg(*[F.coalesce(F.sum(F.when(F.col("block") == b, F.col("n"))), F.lit(0)).alias(f"n{b}") for b in range(BLOCKS)])
    rows = splits(matrix.sparkSession).crossJoin(F.broadcast(sizes))

    def half(bit: int) -> Column:
        return reduce(lambda a, b: a + b, [F.when(F.col("mask").bitwiseAND(1 << b) == (1 << b if bit else 0), F.col(f"n{b}")).otherwise(0) for b in range(BLOCKS)])

    return rows.select("mask", half(1).alias("inside"), half(0).alias("outside"))


def block_moments(matrix: DataFrame) -> DataFrame:
    """Per trial and block: rows, mean and centred sum of squares of the excess returns."""
    x = F.col("r") - RISK_FREE_LOG / SESSIONS_PER_YEAR
    return blocks(matrix).groupBy("trial", "block").agg(F.count("*").alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count("*")).alias("ss"))


def half_sharpes(matrix: DataFrame) -> DataFrame:
    """(mask, trial, inside, outside): Sharpe ratios of both halves of every split, pooled from block moments.

    The returns are read once, for one row of 16 moments a trial; the 12,870 splits are a fixed
    table that meets these rows, and both halves come from sums inside the row, without a shuffle.
    """
    n, m = F.col("n"), F.col("m")
    moments = {"n": n, "s": n * m, "q": F.col("ss") + n * m * m}
    columns = [F.coalesce(F.sum(F.when(F.col("block") == b, x)), F.lit(0.0)).alias(f"{k}{b}") for k, x in moments.items() for b in range(BLOCKS)]
    rows = block_moments(matrix).groupBy("trial").agg(*columns).crossJoin(F.broadcast(splits(matrix.sparkSession)))

    def pooled(k: str, bit: int) -> Column:
        terms = [F.when(F.col("mask").bitwiseAND(1 << b) == (1 << b if bit else 0), F.col(f"{k}{b}")).otherwise(0.0) for b in range(BLOCKS)]
        return reduce(lambda a, b: a + b, terms).alias(f"{k}_{bit}")

    both = rows.select("mask", "trial", *[pooled(k, bit) for k in moments for bit in (0, 1)])

    def ratio(bit: int) -> Column:
        count, mean = F.col(f"n_{bit}"), F.try_divide(F.col(f"s_{bit}"), F.col(f"n_{bit}"))
        centred = F.col(f"q_{bit}") - count * mean * mean
        return F.when(centred > 0, mean / F.sqrt(centred / (count - 1)))

    return both.select("mask", "trial", ratio(1).alias("inside"), ratio(0).alias("outside"))


def split_records(halves: DataFrame) -> DataFrame:
    """Per split: the winner inside (ties to the smaller id), its average rank outside over M + 1, the logit, the degradation."""
    by = Window.partitionBy("mask")
    ranked = halves.withColumns(
        {
            "m": F.count("*").over(by),
            "known": F.count(F.when(F.col("inside").isNotNull() & F.col("outside").isNotNull(), 1)).over(by),
            "place": F.row_number().over(by.orderBy(F.desc("inside"), "trial")),
            "low": F.rank().over(by.orderBy("outside")),
            "same": F.count("*").over(Window.partitionBy("mask", "outside")),
        }
    )
    won = ranked.where("place = 1")
    rank = F.col("low") + (F.col("same") - 1) / 2
    relative = F.when(F.col("known") == F.col("m"), rank / (F.col("m") + 1))
    return won.select("mask", F.col("trial").alias("winner"), relative.alias("relative_rank"), F.log(relative / (1 - relative)).alias("logit"), F.when(relative.isNotNull(), F.col("inside") - F.col("outside")).alias("degradation"))


def overfit_probability(records: DataFrame) -> DataFrame:
    """The share of splits whose winner ranks in the lower half outside; null if any split is undefined."""
    share = F.count_if(F.col("logit") <= 0) / F.count("*")
    return records.agg(F.count("*").alias("splits"), F.when(F.count("logit") == F.count("*"), share).alias("pbo"), F.avg("logit").alias("mean_logit"), F.avg("degradation").alias("mean_degradation"))


def extreme_sharpe(spread: Column, trials: Column) -> Column:
    """The Sharpe ratio that the best of so many trials without skill is expected to show; 0 for one trial."""
    q = 1 / trials.cast("double")
    high = spread * ((1 - EULER_GAMMA) * normal.tail_point(q) + EULER_GAMMA * normal.tail_point(q / math.e))
    return F.when(trials == 1, F.lit(0.0)).otherwise(high)


def deflated_sharpe(observed: Column, n: Column, skew: Column, kurtosis: Column, spread: Column, trials: Column) -> Column:
    """Struct (benchmark, z, dsr) by the published formula; all null where undefined."""
    below = 1 - skew * observed + (kurtosis - 1) * observed * observed / 4
    top = extreme_sharpe(spread, trials)
    z = (observed - top) * F.sqrt(n - 1) / F.sqrt(below)
    fine = (trials >= 1) & (n >= 2) & (spread > 0) & (below > 0) & (kurtosis >= 1)
    found = F.transform(F.array(F.struct(top.alias("benchmark"), z.alias("z"))), lambda s: F.struct(s["benchmark"].alias("benchmark"), s["z"].alias("z"), normal.cumulative(s["z"]).alias("dsr")))
    return F.when(fine & z.isNotNull(), F.get(found, F.lit(0)))


def trial_moments(matrix: DataFrame) -> DataFrame:
    """Per trial: rows, daily Sharpe, population skewness and Pearson kurtosis; and the spread of Sharpes over trials."""
    x = F.col("r") - RISK_FREE_LOG / SESSIONS_PER_YEAR
    per = matrix.groupBy("trial").agg(F.count("*").alias("n"), (F.avg(x) / F.stddev_samp(x)).alias("sharpe"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurtosis"))
    spread = per.agg(F.stddev_samp("sharpe").alias("spread"))
    return per.crossJoin(F.broadcast(spread))


def matrix_dsr(matrix: DataFrame, trials: int) -> DataFrame:
    m = trial_moments(matrix).withColumn("trials", F.lit(trials))
    m = m.withColumn("_d", deflated_sharpe(F.col("sharpe"), F.col("n"), F.col("skew"), F.col("kurtosis"), F.col("spread"), F.col("trials")))
    return m.select("*", "_d.benchmark", "_d.z", "_d.dsr").drop("_d")


def counted_dsr(moments: DataFrame, counts: DataFrame) -> DataFrame:
    """(trial, lifetime_dsr, family_dsr) of ``trial_moments``: deflated by all trials ever counted, and beside it by those of the matrix's own family.

    ``counts`` is one row (lifetime, family); a family count of null gives no family figure.
    """
    m = moments.crossJoin(F.broadcast(counts.select("lifetime", "family").limit(1)))
    inputs = [F.col(c) for c in ("sharpe", "n", "skew", "kurtosis", "spread")]
    return m.select("trial", *[deflated_sharpe(*inputs, F.col(c))["dsr"].alias(f"{c}_dsr") for c in ("lifetime", "family")])


def selection(declared: DataFrame, completed: DataFrame, dsr: DataFrame) -> DataFrame:
    """(place, config, trial, family_dsr, lifetime_dsr, selected): every declared configuration by its one completed trial; selected is the
    highest family figure, ties to the lower place.

    ValueError unless ``declared(config, place)`` and ``completed(config, trial)`` match one to one and every family figure is there.
    """
    rows = declared.join(completed, "config", "full_outer").join(dsr, "trial", "left")
    bad = rows.groupBy("config").agg(F.count("*").alias("n"), F.count("place").alias("a"), F.count("trial").alias("b"), F.count("family_dsr").alias("c")).where("n <> 1 or a <> 1 or b <> 1 or c <> 1")
    if faults := bad.select("config").orderBy("config").limit(5).collect():
        raise ValueError("candidates incomplete, repeated or without a family figure: " + ", ".join(str(r.config) for r in faults))
    best = rows.agg(F.max(F.struct("family_dsr", (-F.col("place")).alias("p"))).alias("best"))
    return rows.crossJoin(F.broadcast(best)).select("place", "config", "trial", "family_dsr", "lifetime_dsr", (F.col("place") == -F.col("best.p")).alias("selected"))
