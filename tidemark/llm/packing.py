"""Length-bucketed packing with optimal buckets.

The histogram of all document lengths goes to the driver, a row for each length that occurs,
whatever the number of documents; a dynamic program over it, by divide and conquer as the
best cuts move one way only,
picks the ``n_buckets`` upper bounds with the least padding in total.  Inside
each bucket, documents form batches of at most ``budget`` tokens, every document
counted at its bucket's bound: batch number and slot follow from the document's
rank in the bucket.  Ranks come from per-shard counts and row numbers inside
shards, so no bucket is one task's group, however many documents it has.

Lengths are words ``[^\\x20\\x09-\\x0D]+`` unless a column of lengths is named.
Every document is placed: one longer than the budget is a batch
of its own.

Edge cases.  Null or blank text has length 0 and is packed with the shortest.
Repeated rows are packed each; null ids sort first in their shard; ties in rank
go by id, then text digest (equal rows are interchangeable).  Other columns are kept; columns of the
input with the output's names are replaced.  An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROWS_PER_SHARD, count_words, running


def best_bounds(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Upper bounds, ascending, of at most n_buckets buckets over ascending lengths with the least total padding.

    The padding of a bucket from i to j is lengths[j] * count(i..j) - tokens(i..j).
    """
    m = len(lengths)
    if not m:
        return []
    x, n = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    many, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(x * n)])
    cost = x * many[1:] - mass[1:]  # one bucket for 0..j
    back = []
    for _ in range(min(n_buckets, m) - 1):
        later, choice = cost.copy(), np.full(m, -1)
        spans = [(1, m - 1, 0, m - 2)]  # ends low..high, whose best last cuts lie in first..last
        while spans:
            low, high, first, last = spans.pop()
            if low > high:
                continue
            j = (low + high) // 2
            cut = np.arange(first, min(last, j - 1) + 1)
            total = cost[cut] + x[j] * (many[j + 1] - many[cut + 1]) - (mass[j + 1] - mass[cut + 1])
            i = int(np.argmin(total))
            if total[i] < later[j]:
                later[j], choice[j] = total[i], cut[i]
            spans += [(low, j - 1, first, int(cut[i])), (j + 1, high, int(cut[i]), last)]
        back.append(choice)
        cost = later
    ends = [m - 1]
    for choice in reversed(back):
        if choice[ends[-1]] >= 0:
            ends.append(int(choice[ends[-1]]))
    return [lengths[j] for j in reversed(ends)]


def pack(docs: DataFrame, *, budget: int = 16_384, n_buckets: int = 8, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, bucket, bucket_len, batch, slot, padding.

    Batches are numbered from 0 inside their bucket; all but a bucket's last one
    hold ``max(1, budget // bucket_len)`` documents.
    """
    length = F.col(length_col).cast("long") if length_col else count_words(F.col(text_col).cast("string"))
    tie = F.xxhash64(F.col(text_col)) if text_col in docs.columns else F.lit(0)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).alias("n_tokens"), tie.alias("_tie"))
    histogram = rows.groupBy(F.col("n_tokens").alias("length")).count().orderBy("length").collect()
    bounds = best_bounds([r["length"] for r in histogram], [r["count"] for r in histogram], n_buckets)
    shards = sum(r["count"] for r in histogram) // ROWS_PER_SHARD + 8
    bucket = F.lit(len(bounds) - 1)
    bound = F.lit(bounds[-1] if bounds else 0).cast("long")
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(bucket)
        bound = F.when(F.col("n_tokens") <= bounds[i], bounds[i]).otherwise(bound)
    rows = rows.select("*", bucket.alias("bucket"), bound.cast("long").alias("bucket_len"), F.pmod(F.xxhash64("doc_id", "_tie"), F.lit(shards)).alias("_shard"))
    placed = running(rows, ["bucket"], "_shard", ["doc_id", "_tie"], F.lit(1))
    many = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1)))).cast("long")
    return placed.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("_rank") / many).cast("long").alias("batch"), F.pmod(F.col("_rank"), many).cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
