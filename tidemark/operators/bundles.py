"""Verified bundles: tables whose manifest, written last, holds counts, date spans and digests of what was published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.screens import reasons


def digest(columns: list[str]) -> Column:
    """Sum over rows of 60 bits of each row's MD5: free of order, sensitive to repeats, combined in the task first."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    return F.sum(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")


def manifest_of(frame: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return frame.groupBy(key).agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"), digest(columns).alias("digest"))


def differences(stored: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, faults) where two manifests disagree: missing, unlisted, or the parts that differ."""
    a = stored.select(key, F.struct("rows", "first", "last", "digest").alias("a"))
    b = found.select(key, F.struct("rows", "first", "last", "digest").alias("b"))
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    parts = [(n, there & ~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))) for n in ("rows", "first", "last", "digest")]
    faults = reasons(("missing", F.col("b").isNull()), ("unlisted", F.col("a").isNull()), *parts)
    return a.join(b, key, "full_outer").select(key, faults.alias("faults")).where("faults <> ''")


def publish(frame: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """Rows, then the manifest of what is read back; a folder without a manifest is no bundle, and a taken path is refused."""
    spark = frame.sparkSession
    frame.write.mode("errorifexists").parquet(f"{path}/rows")
    manifest_of(spark.read.parquet(f"{path}/rows"), key, columns).write.mode("errorifexists").parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """The rows of a bundle, marked nominal only after every key's counts, span and digest hold; else ValueError names some."""
    rows = spark.read.parquet(f"{path}/rows")
    bad = differences(spark.read.parquet(f"{path}/manifest"), manifest_of(rows, key, columns), key).orderBy(key).limit(5).collect()
    if bad:
        raise ValueError("bundle does not match its manifest: " + "; ".join(f"{r[key]}: {r['faults']}" for r in bad))
    return rows.withColumn("basis", F.lit("nominal"))


def load_one(spark: SparkSession, path: str, key: str, value: str, columns: list[str]) -> DataFrame:
    """The rows of one key, read with a filter on it; LookupError if the manifest doesn't list it, ValueError if its rows aren't what it says."""
    listed = spark.read.parquet(f"{path}/manifest").where(F.col(key) == value)
    if listed.isEmpty():
        raise LookupError(f"{key} {value!r} is not in the bundle")
    rows = spark.read.parquet(f"{path}/rows").where(F.col(key) == value)
    bad = differences(listed, manifest_of(rows, key, columns), key).first()
    if bad is not None:
        raise ValueError(f"bundle does not match its manifest: {value}: {bad.faults}")
    return rows.withColumn("basis", F.lit("nominal"))


def resolved(wanted: DataFrame, manifests: DataFrame, key: str) -> DataFrame:
    """wanted(key) with the path of its only manifest, or why there is none: missing or ambiguous."""
    m = manifests.groupBy(key).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    n = F.coalesce("n", F.lit(0))
    return wanted.join(m, key, "left").select(key, F.when(n == 0, "missing").when(n > 1, "ambiguous").otherwise("found").alias("status"), F.when(n == 1, F.col("path")).alias("path"))
