"""Equity that falls to zero and below: against the queries' SQL on orders of a few accounts, and worked by hand."""

import datetime as dt
import math

import duckdb
import pytest

from tests.oracle import difference
from tidemark.plans import evidence  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES
from tidemark.streaming import flows


@pytest.fixture(scope="module")
def sunk(spark, tmp_path_factory):
    """(folder, connection): one account falls below nothing and comes back, another stays above; odd orders take out."""
    folder, con = str(tmp_path_factory.mktemp("sunk")), duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT * FROM (VALUES (1::BIGINT, 'deep'), (2::BIGINT, 'safe')) t(c_custkey, c_mktsegment)")
    con.execute(
        """CREATE TABLE orders AS SELECT (i * 20 + CASE WHEN i BETWEEN 5 AND 44 THEN 1 ELSE 0 END)::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, (3000000 + i * i * 1000)::DOUBLE AS o_totalprice,
             TIMESTAMP '2020-01-01' + i * INTERVAL 1 DAY AS o_orderdate FROM range(70) r(i)
           UNION ALL SELECT (100000 + i * 7)::BIGINT, 2::BIGINT, (10000 + i * 37 % 101)::DOUBLE, TIMESTAMP '2020-01-01' + i * INTERVAL 1 DAY FROM range(70) r(i)"""
    )
    for t in ("customer", "orders"):
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return folder, con


def test_summary_over_missing_returns(spark, sunk):
    folder, con = sunk
    rows = {r.account: r for r in QUERIES["agg_02_performance_summary"](spark, folder).collect()}
    assert rows["deep"].max_drawdown < -1 and rows["deep"].sharpe is not None
    assert difference(QUERIES["agg_02_performance_summary"](spark, folder), con, ORACLE_SQL["agg_02_performance_summary"]) == ""


def test_observation_below_nothing(spark, sunk):
    folder, con = sunk
    rows = [r for r in QUERIES["st_05_equity_observation"](spark, folder).collect() if r.high is not None and r.high < 0]
    assert rows and all(r.drawdown is not None for r in rows)
    assert difference(QUERIES["st_05_equity_observation"](spark, folder), con, ORACLE_SQL["st_05_equity_observation"]) == ""


def test_observation_from_nothing(spark):
    day = lambda d: dt.date(2020, 1, d)
    equity = spark.createDataFrame([("a", day(1), 0.0), ("a", day(2), -5.0), ("a", day(3), 7.0), ("b", day(1), -8.0), ("b", day(2), -4.0)], "account string, session date, equity double")
    flows_ = spark.createDataFrame([], "account string, session date, amount double")
    got = {(r.account, r.session.day): (r.drawdown, r.halted) for r in flows.observe_equity(equity, flows_, window=20, most=0.1).collect()}
    assert got == {("a", 1): (None, False), ("a", 2): (-math.inf, True), ("a", 3): (math.inf, True), ("b", 1): (None, False), ("b", 2): (-0.5, True)}
