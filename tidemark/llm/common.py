"""What several operators share: cutting lineage, sharded ranks, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.textops import word_counts


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the shared folder that the session names in ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder; on a cluster that is an error, as
    executors don't share the driver's disk.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not named and current.isDefined():
        named = current.get()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if not current.isDefined():
        sc.setCheckpointDir(named)
    return "/".join([named.rstrip("/"), f"tidemark-{sc.applicationId}", *_scratch])


_scratch: list[str] = []


def _removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside is deleted at the end, so results must have been saved elsewhere by then."""
    _scratch.append(uuid.uuid4().hex)
    path = shared_dir(spark)
    try:
        yield
    finally:
        _scratch.pop()
        _removed(spark, path)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete what the operators of this application wrote on their way; to be called once results are saved."""
    _removed(spark, shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and go on from the files, so that no lost executor repeats what went before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Like ``cut``, as Parquet: smaller, and later reads take only the columns they need."""
    path = path or f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of one partition as stars: every node with the smallest one it reaches inside the partition."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    stars = [(x, find(x)) for x in root]
    stars = [(x, y) for x, y in stars if x != y]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([y for _, y in stars], pa.int64())], ["a", "b"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node each node of ``links(a, b)`` reaches.

    Partitions first turn their own edges into stars.  Then large-star and
    small-star steps alternate until nothing changes; each is a map-side combined
    minimum and an equi-join, so a hub of any degree is no single group.  Every
    round starts from a checkpoint.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:  # every larger neighbour hangs below the smallest one
            near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:  # only towards smaller neighbours
            near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        joined = near.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a"), F.col("low").alias("b")))).alias("x")).select("x.*")
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    def fewer(df: DataFrame) -> DataFrame:  # edges are few beside what they come from
        return df.coalesce(max(1, df.rdd.getNumPartitions() // 16))

    def told(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = cut(fewer(links.select("a", "b")).mapInArrow(_forest, "a long, b long"))
    before = told(edges)
    for _ in range(rounds):
        if before[0] == 0:
            break
        edges = fewer(cut(star(star(edges, True), False).distinct()))
        now = told(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _count_words(texts: pa.Array) -> pa.Array:
    return pa.array(word_counts(texts))


def count_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; null has none."""
    return F.arrow_udf(_count_words, "long")(text)


ROWS_PER_SHARD = 200_000


def running(df: DataFrame, keys: list[str], shard: str, order: list[str], weight: Column) -> DataFrame:
    """df with ``_rank`` (rows) and ``_before`` (sum of weight) of the rows before each one of the same keys, in the
    order of (shard, order).

    Sums inside a shard come from a window, those of earlier shards from a table of
    one row per shard; a key of any size is so many shards, never one group.
    """
    df = df.withColumn("_weight", weight)
    sums = df.groupBy(*keys, shard).agg(F.count("*").alias("_n"), F.sum("_weight").alias("_w"))
    earlier = Window.partitionBy(*keys).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, shard, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"))
    inside = Window.partitionBy(*keys, shard).orderBy(*order)
    rows = df.withColumn("_rank", F.row_number().over(inside) - 1).withColumn("_before", F.coalesce(F.sum("_weight").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(offsets, [*keys, shard])
    return rows.withColumn("_rank", F.col("_rank") + F.col("_n0")).withColumn("_before", F.col("_before") + F.col("_w0")).drop("_n0", "_w0", "_weight")
