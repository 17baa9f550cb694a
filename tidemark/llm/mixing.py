"""Temperature mixing of sources to target weights.

A source's weight is its share of all tokens to the power ``alpha``, normalised.
``alpha`` is bisected between 1 (shares as they are) and 0 (uniform) to the
greatest value whose entropy reaches ``entropy`` times that of uniform weights;
if some source would then be repeated more than ``repeats`` times, it is bisected
back up to the least value that keeps the limit.  The scale is such that the
least repeated source is passed through once: mixing repeats documents of small
sources and never drops one.

A source's quota (repeats times its tokens) is realised as passes over its
documents, each in a permutation of its own; of the last, partial pass those
documents enter that begin before the quota is reached.  The stream is dealt
into blocks of about ``block_tokens`` with each source's share of every block by
weight, and permuted inside the block by ``order_key``.

Positions are running sums by shards of a source, so a source with a third of
all rows is many groups.  Sources are an attribute with few values: their totals
go to the driver, and more than ``MAX_SOURCES`` are refused.

Edge cases.  A null source counts as the empty name.  Null or empty text has no
tokens; a source without any has weight 0 and one pass.  Rows equal in id and text tie and enter together.
Null ids and repeated rows are rows like others.  Other columns are passed by
(``mix`` returns ids) or kept (``mix_rows``).  An empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROWS_PER_SHARD, count_words, running

MAX_SOURCES = 100_000


def weights_at(tokens: dict[str, int], alpha: float) -> dict[str, float]:
    logs = {s: alpha * math.log(t) for s, t in tokens.items() if t > 0}
    top = max(logs.values(), default=0.0)
    raw = {s: math.exp(x - top) for s, x in logs.items()}
    total = sum(raw.values())
    return {s: raw.get(s, 0.0) / total if total else 0.0 for s in tokens}


def entropy_of(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def passes_of(tokens: dict[str, int], weights: dict[str, float]) -> dict[str, float]:
    """Passes over each source, 1 for the least repeated."""
    ratio = {s: weights[s] / t for s, t in tokens.items() if t > 0}
    least = min(ratio.values(), default=1.0)
    return {s: ratio[s] / least if s in ratio else 1.0 for s in tokens}


def find_alpha(tokens: dict[str, int], entropy: float, repeats: float, steps: int = 60) -> float:
    live = {s: t for s, t in tokens.items() if t > 0}
    if len(live) < 2:
        return 1.0
    goal = entropy * math.log(len(live))
    low, high = 0.0, 1.0  # entropy falls as alpha grows
    if entropy_of(weights_at(live, 1.0)) < goal:
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy_of(weights_at(live, mid)) >= goal else (low, mid)
    else:
        low = 1.0
    alpha = low
    most = lambda a: max(passes_of(live, weights_at(live, a)).values())
    if most(alpha) > repeats:
        low, high = alpha, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if most(mid) <= repeats else (mid, high)
        alpha = high
    return alpha


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), count_words(F.col(text_col).cast("string")).alias("n_tokens"), F.xxhash64(F.col(text_col).cast("string")).alias("_tie"))


def _plan(rows: DataFrame, entropy: float, repeats: float) -> tuple[DataFrame, int, int]:
    """(a row per source: source, weight, passes, tokens; shards per source; tokens of the mixture)."""
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = {r["source"]: r["tokens"] for r in sorted(totals, key=lambda r: r["source"])}
    weights = weights_at(tokens, find_alpha(tokens, entropy, repeats))
    passes = passes_of(tokens, weights)
    table = [(s, weights[s], passes[s], tokens[s]) for s in tokens]
    shards = max((r["n"] for r in totals), default=0) // ROWS_PER_SHARD + 8
    plan = rows.sparkSession.createDataFrame(table, "source string, weight double, passes double, tokens long")
    return plan, shards, math.ceil(sum(passes[s] * tokens[s] for s in tokens))


def _key(epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch, "doc_id", "_tie")


def mix(docs: DataFrame, *, entropy: float = 0.98, repeats: float = 4.0, block_tokens: int = 1 << 20, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document and pass: doc_id, source, weight, epoch, n_tokens, block, order_key."""
    rows = _rows(docs, id_col, text_col, source_col)
    plan, shards, total = _plan(rows, entropy, repeats)
    rows = rows.join(F.broadcast(plan), "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("passes") - 1e-9).cast("int") - 1)))
    rows = rows.withColumn("order_key", _key(F.col("epoch"), seed))
    rows = rows.withColumn("_shard", F.col("epoch") * shards + F.pmod(F.xxhash64("order_key"), F.lit(shards)))
    placed = running(rows, ["source"], "_shard", ["order_key"], F.col("n_tokens"))
    quota = F.col("passes") * F.col("tokens")
    placed = placed.where((F.col("epoch") < F.floor(F.col("passes") + 1e-9)) | (F.col("_before") < quota))
    blocks = max(1, math.ceil(total / block_tokens))
    block = F.when(quota > 0, F.least(F.floor(F.col("_before") / quota * blocks), F.lit(blocks - 1))).otherwise(0).cast("long")
    return placed.select("doc_id", "source", "weight", "epoch", "n_tokens", block.alias("block"), "order_key")


def mix_rows(docs: DataFrame, *, entropy: float = 0.98, repeats: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mixture has it.

    The last document of a source's partial pass is found by id and broadcast, one
    row per source; the rows themselves are not shuffled.
    """
    rows = _rows(docs, id_col, text_col, source_col)
    plan, shards, _ = _plan(rows, entropy, repeats)
    last = F.floor(F.col("passes") + 1e-9).cast("int")
    partial = rows.join(F.broadcast(plan), "source").where(F.col("passes") - last > 1e-9).withColumn("order_key", _key(last, seed))
    partial = partial.withColumn("_shard", F.pmod(F.xxhash64("order_key"), F.lit(shards)))
    placed = running(partial, ["source"], "_shard", ["order_key"], F.col("n_tokens")).where(F.col("_before") < (F.col("passes") - last) * F.col("tokens"))
    cuts = placed.groupBy("source").agg(F.max(F.struct("_shard", "order_key")).alias("_cut"))
    plan = plan.join(cuts, "source", "left").select(F.col("source").alias("_source"), last.alias("_last"), "_cut")
    marked = docs.withColumns({"_m_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "_m_id": F.col(id_col).cast("long"), "_m_tie": F.xxhash64(F.col(text_col).cast("string"))})
    marked = marked.join(F.broadcast(plan), F.col("_m_source") == F.col("_source"))
    key = F.xxhash64(F.lit(seed), "_last", "_m_id", "_m_tie")
    more = F.coalesce(F.struct(F.pmod(F.xxhash64(key), F.lit(shards)).alias("_shard"), key.alias("order_key")) <= F.col("_cut"), F.lit(False))
    return marked.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_last") + more.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
