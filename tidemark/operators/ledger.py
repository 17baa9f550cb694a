"""Append-only, hash-chained event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; every value as a string or null."""
    return F.to_json(F.struct(*[fields[k].cast("string").alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_text(document: Column) -> Column:
    """A JSON text in its one compact form: keys of objects sorted at every depth, arrays in order; null for a text that is no JSON."""
    return F.to_json(F.try_parse_json(document))


def tree_digest(rows: DataFrame, key: str, text: str, levels: tuple[int, ...] = (4, 2)) -> DataFrame:
    """(prefix, digest, n): SHA-256 of every row's key and text, then of the sorted digests below each prefix, level by level up to the root (prefix '').

    It doesn't depend on order or partitions; a group has the rows of one prefix, so no group is the table.  Repeated rows count.
    """
    leaves = rows.select(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.coalesce(F.col(text), F.lit("~"))), 256).alias("digest"), F.lit(1).cast("long").alias("n"))
    here = leaves.withColumn("prefix", F.col("digest"))
    for width in (*levels, 0):
        up = here.groupBy(F.substring("prefix", 1, width).alias("prefix")) if width else here.groupBy(F.lit("").alias("prefix"))
        here = up.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest"), F.sum("n").alias("n"))
    return here


def record_hash(fields: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in fields]), 256)


def chained(events: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Each event with its own hash and the hash of the one before it in its chain."""
    own = events.withColumn("record_hash", record_hash(fields))
    return own.withColumn("prev_hash", F.lag("record_hash").over(Window.partitionBy(key).orderBy(order)))


def verify(chain: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """(key, order, fault) of events whose hash or link does not hold."""
    by = Window.partitionBy(key).orderBy(order)
    bad_hash = F.col("record_hash") != record_hash(fields)
    bad_link = ~F.col("prev_hash").eqNullSafe(F.lag("record_hash").over(by))
    checked = chain.withColumns({"_a": bad_hash, "_b": bad_link})
    fault = F.when(F.col("_a"), "hash").when(F.col("_b"), "link")
    return checked.where("_a or _b").select(key, order, fault.alias("fault"))


def append(chain: DataFrame, path: str) -> None:
    chain.write.mode("append").parquet(path)


def manifest(spark, path: str) -> DataFrame:
    """(path, length, sha256) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def drill(first: DataFrame, second: DataFrame) -> DataFrame:
    """Files that two manifests do not agree on."""
    a, b = first.select("path", F.col("sha256").alias("a")), second.select("path", F.col("sha256").alias("b"))
    return a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def open_intents(intents: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    return intents.join(outcomes.select(key), key, "left_anti")


def flattened(document: Column, depth: int = 3) -> Column:
    """A JSON object as a sorted array of (path, value): nested objects become dotted paths down to ``depth``, values keep
    their JSON text.  Null for a text that is no object."""

    def entries(text: Column, levels: int) -> Column:
        own = F.map_entries(F.from_json(text, "map<string,string>"))
        if levels == 1:
            return F.transform(own, lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value")))

        def deeper(e: Column) -> Column:
            below = F.transform(entries(e["value"], levels - 1), lambda b: F.struct(F.concat_ws(".", e["key"], b["path"]).alias("path"), b["value"].alias("value")))
            return F.when(e["value"].startswith("{"), below).otherwise(F.array(F.struct(e["key"].alias("path"), e["value"].alias("value"))))

        return F.flatten(F.transform(own, deeper))

    return F.array_sort(entries(document, depth))


def changed_paths(frozen: Column, source: Column) -> Column:
    """Sorted paths of two flattened documents that only one has, or that differ."""
    once = F.array_union(F.array_except(frozen, source), F.array_except(source, frozen))
    return F.array_sort(F.array_distinct(F.transform(once, lambda e: e["path"])))


def first_difference(frozen: Column, source: Column) -> Column:
    """The first changed path; null where the documents agree."""
    return F.get(changed_paths(frozen, source), 0)


def additions(frozen: Column, source: Column) -> Column:
    """(added, refused): new paths may be added; a path the frozen document has may be neither changed nor dropped."""
    known = F.transform(frozen, lambda e: e["path"])
    changed = changed_paths(frozen, source)
    return F.struct(F.array_except(changed, known).alias("added"), F.array_intersect(changed, known).alias("refused"))


def amended(amendments: DataFrame) -> DataFrame:
    """Amendments (family, seq, key, value) with ``state``: added (the key's first), repeated (the value it has), or refused
    (another value).  The chain starts at 1 without gaps; what follows a gap is refused as well."""
    first = Window.partitionBy("family", "key").orderBy("seq")
    chain = Window.partitionBy("family").orderBy("seq")
    gap = F.col("seq") != F.coalesce(F.lag("seq").over(chain), F.lit(0)) + 1
    rows = amendments.withColumn("_gap", gap).withColumns({"_broken": F.max("_gap").over(chain), "_n": F.row_number().over(first), "_v": F.first("value").over(first)})
    state = F.when(F.col("_broken"), "refused").when(F.col("_n") == 1, "added").when(F.col("value").eqNullSafe(F.col("_v")), "repeated").otherwise("refused")
    return rows.withColumn("state", state).drop("_gap", "_broken", "_n", "_v")
