"""Evidence by provenance: what an artifact rests on through the inputs of its inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import screens
from tidemark.sources.storage import scratch_dir


def closure(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(artifact, input, depth): everything an artifact reaches over ``edges(artifact, input)``, with the shortest way's length.

    Ways double in length each round, so a chain of a thousand inputs takes ten; pairs are kept once, whatever the number of
    ways between them.  Each round is written to shared storage.  In a cycle an artifact reaches itself.
    """
    spark, folder = edges.sparkSession, scratch_dir(edges.sparkSession)
    once = edges.where("artifact is not null and input is not null").select("artifact", "input", F.lit(1).alias("depth")).distinct()
    before, reached = None, _kept(once, f"{folder}/0")
    for k in range(1, rounds):
        now = reached.agg(F.count("*"), F.sum("depth")).first()
        if now == before:
            return reached
        step = reached.select(F.col("artifact").alias("input"), F.col("input").alias("_to"), F.col("depth").alias("_more"))
        longer = reached.join(step, "input").select("artifact", F.col("_to").alias("input"), (F.col("depth") + F.col("_more")).alias("depth"))
        before, reached = now, _kept(reached.unionByName(longer).groupBy("artifact", "input").agg(F.min("depth").alias("depth")), f"{folder}/{k}")
    raise RuntimeError(f"ways longer than 2^{rounds - 1}")


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lines(nodes: DataFrame) -> DataFrame:
    """(artifact, to, steps, gone, changed, open): every artifact that has one input, followed over such artifacts to the first
    that has none or several, with the sums of ``nodes(artifact, input, single, gone, changed)`` before it.

    One row per artifact, whose way doubles in length each round; a row is written again only while its way goes on.  The rows
    whose way goes on become fewer each round, unless all of them lead into cycles: those stay open.
    """
    spark, folder = nodes.sparkSession, scratch_dir(nodes.sparkSession)
    ahead = nodes.where("single").select("artifact", F.col("input").alias("to"), F.lit(1).alias("steps"), "gone", "changed", F.lit(True).alias("open"))
    ahead, done, before = _kept(ahead, f"{folder}/0"), [], None
    while (now := ahead.where("open").count()) not in (0, before):
        rows = ahead
        for d in done:
            rows = rows.union(d)
        more = rows.select(F.col("artifact").alias("to"), F.col("to").alias("_to"), *[F.col(c).alias(f"_{c}") for c in ("steps", "gone", "changed", "open")])
        sums = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("steps", "gone", "changed")]
        longer = ahead.where("open").join(more, "to", "left").select("artifact", F.coalesce("_to", "to").alias("to"), *sums, F.coalesce("_open", F.lit(False)).alias("open"))
        done.append(ahead.where("not open"))
        ahead, before = _kept(longer, f"{folder}/{len(done)}"), now
    for d in done:
        ahead = ahead.union(d)
    return ahead


def currentness(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Per artifact of ``recorded(artifact, input, digest)``: inputs reached, depth, how many recorded digests on the way are gone or changed in
    ``current(input, digest)``, whether it rests on itself, and its state: cyclic, stale or fresh.

    Where all on the way have one input, sums along the way tell all of it, one row per artifact.  The closure is taken only for artifacts
    that reach one with several inputs, or a cycle, and over what these can reach.
    """
    met = recorded.join(current.select("input", F.col("digest").alias("_now")), "input", "left").where("artifact is not null")
    own = met.groupBy("artifact").agg(F.count_if(F.col("_now").isNull()).alias("gone"), F.count_if(F.col("_now") != F.col("digest")).alias("changed"), F.min("input").alias("input"), F.max("input").alias("_high"))
    own = own.select("artifact", "input", F.coalesce(F.col("input") == F.col("_high"), F.lit(False)).alias("single"), "gone", "changed")
    nodes = _kept(own, f"{scratch_dir(recorded.sparkSession)}/nodes")
    way, ends = lines(nodes), nodes.where("not single")
    plain = way.where("not open")
    state = F.when(F.col("cyclic"), "cyclic").when(F.col("gone") + F.col("changed") > 0, "stale").otherwise("fresh")
    columns = ["artifact", F.col("inputs").cast("long").alias("inputs"), "depth", "gone", "changed", state.alias("state")]
    shaped = lambda rows: rows.select("artifact", F.col("steps").alias("inputs"), F.col("steps").alias("depth"), "gone", "changed", F.lit(False).alias("cyclic")).select(*columns)
    if ends.isEmpty() and way.where("open").isEmpty():
        return shaped(plain)

    met_last = ends.select(F.col("artifact").alias("to"), F.col("input").isNotNull().alias("_many"), F.col("gone").alias("_gone"), F.col("changed").alias("_changed"))
    plain = plain.join(met_last, "to", "left").withColumn("_many", F.coalesce("_many", F.lit(False)))
    other = ends.where("input is not null").select("artifact").union(way.where("open").select("artifact")).union(plain.where("_many").select("artifact"))
    plain = plain.where("not _many").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("gone", "changed")})
    edges = recorded.join(other, "artifact", "left_semi").select("artifact", "input")
    trees = edges.join(plain.select(F.col("artifact").alias("input"), "to"), "input").select("to").distinct()
    under = plain.join(trees, "to", "left_semi").select("artifact").join(nodes, "artifact").select("artifact", "input")
    reach = closure(edges.union(under)).join(other, "artifact", "left_semi")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = nodes.select("artifact", "gone", "changed")
    below = reach.where("artifact <> input").join(sums.withColumnRenamed("artifact", "input"), "input", "left").groupBy("artifact").agg(zero("gone"), zero("changed"))
    shape = reach.groupBy("artifact").agg(F.count("*").alias("inputs"), F.max("depth").alias("depth"), F.max(F.col("artifact") == F.col("input")).alias("cyclic"))
    both = below.unionByName(sums).groupBy("artifact").agg(F.sum("gone").alias("gone"), F.sum("changed").alias("changed"))
    return shaped(plain).union(shape.join(both, "artifact").select(*columns))


def gather(candidates: DataFrame, dsr: DataFrame, t_stats: DataFrame, pbo: DataFrame, currentness: DataFrame, key: str, least_t: float = 1.645, least_dsr: float = 0.95, most_pbo: float = 0.5) -> DataFrame:
    """One row of evidence per candidate(key, artifact): its deflated Sharpe ratios, robust t, the family's PBO and its artifact's state,
    with what is missing or fails."""
    c = F.col
    rows = candidates.join(dsr, key, "left").join(t_stats.select(key, "t"), key, "left").join(currentness.select("artifact", "state"), "artifact", "left").crossJoin(F.broadcast(pbo.select("pbo").limit(1)))
    held = lambda test: ~F.coalesce(test, F.lit(False))
    tests = (("inputs", held(c("state") == "fresh")), ("dsr", held(c("lifetime_dsr") >= least_dsr)), ("t", held(c("t") >= least_t)), ("pbo", held(c("pbo") <= most_pbo)))
    return rows.select(key, "artifact", "lifetime_dsr", "family_dsr", "t", "pbo", "state", screens.reasons(*tests).alias("failing"))
