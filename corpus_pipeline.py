"""A corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

The stages return the columns of documents, the last one the packed batches.
They have no SQL form (a fitted classifier, link components, a bisected
exponent), so the tests hold them against brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, scratch, shared_dir, written
from tidemark.llm.line_dedup import drop_lines, line_dedup
from tidemark.llm.mixing import mix_rows
from tidemark.llm.ngram_join import blank, ngram_jaccard_join, text_key
from tidemark.llm.packing import pack
from tidemark.llm.quality import co_train, keep_quality


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go.

    Every row is judged by itself: repeated rows and null ids like others, null or empty
    text by its features, ties (a score equal to the threshold) stay.  Without labelled
    rows of both classes all rows stay; an empty table gives an empty one.
    """
    return keep_quality(docs, co_train(docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more in three documents or more stay in one of them, the one with the largest id;
    n_chars follows the text.

    No row goes.  A null text stays null; rows that repeat an id are one document in the
    count, and each loses the lines of its own text; rows without an id count as one
    document that is last.
    """
    return drop_lines(docs, line_dedup(docs, min_chars=20, min_docs=3)).withColumn("n_chars", F.length("text").cast("long"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row stays of each group linked by five-word shingles at a similarity of 0.8 or more.

    It is the group's row with the smallest id (rows without one come last), then the smallest
    text digest; of rows equal in both any one stays.  Rows are told apart by text, not by
    id: two texts under one id are judged each, and an exact repeat of a row goes.  Null or blank texts
    are linked with nothing and all stay.
    """
    found = ngram_jaccard_join(docs, k=5, num=80, den=100).where("n_shingles > 0").select("text_key", "component_key", "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    first = found.groupBy("component_key").agg(F.min(order).alias("x"))
    named = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    keep = first.select(F.col("x.doc_id").alias("doc_id"), F.col("x.text_key").alias("key")).select(named.alias("name"), "key")
    rows = docs.select(F.struct("*").alias("row"), named.alias("name"), text_key(F.col("text")).alias("key"), blank(F.col("text")).alias("blank"))
    once = rows.where("not blank").join(keep, ["name", "key"], "left_semi").dropDuplicates(["name", "key"])
    return once.select("row.*").union(rows.where("blank").select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources are repeated, twice at most, towards even weights; none goes.

    A null source is a source of its own with the empty name; texts without words weigh nothing and stay once or
    as often as their source has whole passes.  Rows equal in id and text are repeated together.
    """
    return mix_rows(docs, entropy=0.98, repeats=2.0)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's place in a batch of at most 16,384 tokens, in 8 length buckets with the least padding.

    Null or blank texts have length 0; repeated rows and null ids have a place each, ties in order go by id and text;
    a document longer than a batch is one alone; an empty table gives an empty result.
    """
    return pack(docs, budget=16_384, n_buckets=8)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", one_of_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_documents),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        with scratch(spark):  # what a stage wrote on its way goes when its result is saved
            docs = written(stage(spark, docs, sf_dir), path)
    return STAGES[-1][1](spark, docs, sf_dir)
