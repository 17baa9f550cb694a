"""Registered queries: an operator applied to its whole table, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.base_sql import with_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, frames: str = "", sql: str | None = None):
    """Register a query; doubles in its result are rounded to what both engines agree on."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = with_frames(frames, sql) if frames else sql.strip()
        return fn

    return add


def rounded(df: DataFrame, places: int = 6, **other: int) -> DataFrame:
    """Doubles rounded (from 15 places on, as they are); NaN never appears, and -0.0 becomes 0.0."""
    cols = [(F.round(F.col(f"`{c}`"), other.get(c, places)) + 0.0).alias(c) if t == "double" and other.get(c, places) < 15 else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(*cols)
