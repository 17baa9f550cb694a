"""Purged, embargoed walk-forward folds as tables joined by row position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bounds(rows: DataFrame, keys: list[str], train_months: int, test_months: int) -> DataFrame:
    """(keys, fold, test_start, test_end) of each frame, chained: a fold starts where the last one ended.

    Chained month steps keep a clamped day: from 31 January, a month on is 28 February and
    another is 28 March.  A frame has a few bounds per year of data.
    """
    if train_months <= 0 or test_months <= 0:
        raise ValueError("windows must be positive numbers of months")
    span = rows.groupBy(*keys).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    span = span.withColumn("start", F.add_months("first", train_months)).where("start <= last")
    steps = F.sequence(F.lit(0), F.floor(F.months_between("last", "start") / test_months).cast("int") + 1)
    chain = F.aggregate(steps, F.array("start"), lambda got, _: F.concat(got, F.array(F.add_months(F.element_at(got, -1), test_months))))
    ends = span.withColumn("chain", chain).select(*keys, "last", "chain", F.posexplode("chain").alias("fold", "test_start"))
    return ends.where("test_start <= last").select(*keys, "fold", "test_start", F.get("chain", F.col("fold") + 1).alias("test_end"))


def fold_windows(rows: DataFrame, *, train_months: int, test_months: int, keys: list[str]) -> DataFrame:
    """(keys, fold, test_from, test_to): each fold's test rows as positions within its frame; a fold without any has no row.

    A frame is what ``keys`` name; wants keys and date, one row per date of a frame.
    """
    tests = _tests(_placed(rows, keys), _bounds(rows, keys, train_months, test_months), keys)
    return tests.groupBy(*keys, "fold").agg(F.min("position").alias("test_from"), (F.max("position") + 1).alias("test_to"))


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "date").withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1)


def _tests(placed: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    met = placed.join(bounds, keys).where((F.col("date") >= F.col("test_start")) & (F.col("date") < F.col("test_end")))
    return met.select(*keys, "fold", "date", "position")


def walk_forward(rows: DataFrame, *, train_months: int, test_months: int, horizon: int, embargo: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, fold, date, position, role): rows of each fold's train and test sets, per frame (a ticker's, by default).

    Train rows lie more than ``horizon`` positions before the test window and
    outside the ``embargo`` rows after every earlier test window; a fold without
    train rows has no rows, but its embargo counts.
    """
    if embargo < horizon:
        raise ValueError("the embargo must cover the label horizon")
    keys = keys or ["ticker"]
    placed = _placed(rows, keys)
    tests = _tests(placed, _bounds(rows, keys, train_months, test_months), keys)
    windows = tests.groupBy(*keys, "fold").agg(F.min("position").alias("test_from"), (F.max("position") + 1).alias("gap_from"))
    earlier = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.struct(F.col("gap_from").alias("a"), (F.col("gap_from") + embargo).alias("z"))
    plan = windows.withColumn("gaps", F.collect_list(gap).over(earlier))
    train = placed.join(plan, keys).where(F.col("position") < F.col("test_from") - horizon)
    train = train.where(~F.exists("gaps", lambda g: (F.col("position") >= g["a"]) & (F.col("position") < g["z"])))
    train = train.select(*keys, "fold", "date", "position", F.lit("train").alias("role"))
    alive = train.select(*keys, "fold").distinct()
    test = tests.withColumn("role", F.lit("test")).join(alive, [*keys, "fold"], "left_semi")
    return train.unionByName(test)


def inner_frames(outer: DataFrame) -> DataFrame:
    """(ticker, outer_fold, date): the train rows of each outer fold, as frames of their own.

    Folds of these see nothing that the outer fold left out, and count positions anew:
    purge and embargo reach over the rows that are there.
    """
    return outer.where("role = 'train'").select("ticker", F.col("fold").alias("outer_fold"), "date")
