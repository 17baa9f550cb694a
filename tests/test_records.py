"""Bundles on disk, and bodies that are null, broken, empty or short of columns."""

import datetime as dt

import pytest

from tidemark.operators import bundles, decoders

D = dt.date


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("A", D(2020, 1, 2), 1.5), ("A", D(2020, 1, 3), None), ("B", D(2020, 1, 2), 2.5), ("B", D(2020, 1, 2), 2.5)], "ticker string, date date, close double")


def test_bundle_round_trip_and_refusals(spark, rows, tmp_path):
    path = str(tmp_path / "b")
    bundles.publish(rows, path, "ticker", ["date", "close"])
    got = bundles.load(spark, path, "ticker", ["date", "close"])
    assert got.count() == 4 and {r.basis for r in got.collect()} == {"nominal"}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        bundles.publish(rows, path, "ticker", ["date", "close"])
    rows.where("ticker = 'B'").limit(1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="B: rows,digest"):
        bundles.load(spark, path, "ticker", ["date", "close"])


def test_digest_is_free_of_order_and_tells_repeats(spark, rows):
    digest = lambda f: {r.ticker: r.digest for r in bundles.manifest_of(f, "ticker", ["date", "close"]).collect()}
    assert digest(rows) == digest(rows.orderBy("close"))
    assert digest(rows)["B"] != digest(rows.distinct())["B"]
    assert bundles.manifest_of(rows.where("false"), "ticker", ["date", "close"]).count() == 0


def test_broken_bodies_give_no_rows_and_are_listed(spark):
    pages = spark.createDataFrame([("A", None), ("B", "{"), ("C", '{"bars":[]}'), ("D", '{"bars":[{"t":"2020-01-02","o":1,"h":1,"l":1,"c":1,"v":2},{"t":"no date","o":1}]}')], "ticker string, body string")
    sessions = spark.createDataFrame([(D(2020, 1, 2),)], "date date")
    from pyspark.sql import functions as F

    got = decoders.bar_rows(pages, sessions, F.lit("2021-01-01").cast("timestamp")).collect()
    assert [(r.ticker, r.date, r.volume, r.fault) for r in got] == [("D", D(2020, 1, 2), 2.0, None)]
    assert {r.ticker for r in decoders.undecodable(pages, decoders.BARS, "bars").collect()} == {"A", "B"}


def test_mapping_answers_may_be_fewer_than_jobs(spark):
    batch = spark.createDataFrame([(["x", "y", "z"], '[{"data":[{"figi":"F","ticker":"T"}]},{"warning":"none"}]')], "jobs array<string>, body string")
    assert {(r.job, r.status, r.figi) for r in decoders.mapping_rows(batch).collect()} == {("x", "found", "F"), ("y", "not_found", None), ("z", "missing", None)}


def test_factor_table_may_end_with_the_file_or_be_absent(spark):
    files = spark.createDataFrame([("a", "x\r\n,Mkt\r\n202002, -1.50\r\n202003, -999"), ("b", "no table"), ("c", None)], "dataset string, text string")
    got = {(r.dataset, r.month_end, r.factor, r.value) for r in decoders.factor_rows(files).collect()}
    assert got == {("a", D(2020, 2, 29), "Mkt", -0.015), ("a", D(2020, 3, 31), "Mkt", None)}


def test_blocks_skip_preamble_and_footer(spark):
    text = 'Export\n\nACCOUNT NUMBER,Symbol,Quantity,Current Value\nZ1,"A,B",1,"$1,000.25"\nZ1,CORE**,,$5.00\nZ1,C\n\nfooter, line'
    files = spark.createDataFrame([("f", text), ("g", "nothing"), ("h", None)], "file string, text string")
    got = {(r.symbol, r.quantity, r.value) for r in decoders.positions(files, "s").collect()}
    assert got == {("A,B", 1.0, 1000.25), ("CASH", None, 5.0), ("C", None, None)}
    assert decoders.history(files).count() == 0
