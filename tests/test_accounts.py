"""Replays, plans, documents and statistics by hand-worked cases, nulls and empty tables."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import accounts, ledger, signals

D = dt.date


def test_replay_shows_a_wrong_record(spark):
    prices = spark.createDataFrame([("r", D(2020, 1, i), 10.0 + i) for i in (1, 2, 3)], "run string, date date, close double")
    log = spark.createDataFrame([("r", D(2020, 1, 2), 3.0, 11.0, 66.0), ("r", D(2020, 1, 3), -3.0, 12.0, 100.0)], "run string, date date, quantity double, price double, cash double")
    got = accounts.replayed_equity(prices, log, capital=100.0, commission=1.0).orderBy("date").collect()
    assert [(r.cash, r.quantity, r.equity, r.drift) for r in got] == [(100.0, 0.0, 100.0, None), (66.0, 3.0, 102.0, 0.0), (101.0, 0.0, 101.0, -1.0)]


def test_plan_keeps_within_the_band_and_sells_first(spark):
    rows = [("a", 0.5, 10.0, 0.0), ("b", 0.0, 10.0, 7.0), ("c", 0.1, 10.0, 10.0), ("d", 0.1, None, 0.0), ("e", None, 10.0, 1.0), ("f", 0.2, 10.0, 30.0)]
    t = spark.createDataFrame([(D(2020, 1, 1), *r) for r in rows], "date date, ticker string, weight double, close double, held double")
    got = accounts.allocation_plan(t, equity=1000.0).orderBy("place").collect()
    assert [(r.ticker, r.shares, r.side) for r in got] == [("b", -7.0, "sell"), ("f", -10.0, "sell"), ("a", 50.0, "buy")]


def test_unit_root_against_least_squares(spark):
    rng = np.random.default_rng(1)
    walk, noise = np.cumsum(rng.normal(size=300)), rng.normal(size=200)
    rows = [("walk", i, float(v)) for i, v in enumerate(walk)] + [("noise", i, float(v)) for i, v in enumerate(noise)] + [("short", i, 1.0) for i in range(4)]
    got = {r.k: r for r in accounts.unit_root(spark.createDataFrame(rows, "k string, i int, x double"), "k", "i", "x").collect()}
    for name, x in (("walk", walk), ("noise", noise)):
        y = np.diff(x)
        a = np.column_stack([x[1:-1], y[:-1], np.ones(len(y) - 1)])
        w, ssr = np.linalg.lstsq(a, y[1:], rcond=None)[:2]
        se = np.sqrt(ssr[0] / (len(a) - 3) * np.linalg.inv(a.T @ a)[0, 0])
        assert got[name].statistic == pytest.approx(w[0] / se, rel=1e-8)
    assert got["noise"].rejects and not got["walk"].rejects and got["short"].statistic is None


def test_documents_by_path(spark):
    a, b = {"x": 1, "y": {"p": {"q": [1, 2]}, "r": None}}, {"x": 1, "y": {"p": {"q": [1, 3]}, "r": None}, "z": True}
    df = spark.createDataFrame([(json.dumps(a), json.dumps(b)), (json.dumps(a), json.dumps(a)), ("no object", json.dumps(a)), (None, None)], "a string, b string")
    f = df.select(ledger.flattened(F.col("a")).alias("a"), ledger.flattened(F.col("b")).alias("b"))
    got = f.select(ledger.first_difference(F.col("a"), F.col("b")).alias("d"), ledger.additions(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.d for r in got] == ["y.p.q", None, None, None]
    assert (got[0].s.added, got[0].s.refused) == (["z"], ["y.p.q"])


def test_amendments_after_a_gap_are_refused(spark):
    rows = [("f", 1, "a", "1"), ("f", 2, "a", "1"), ("f", 3, "a", "2"), ("f", 5, "b", "1"), ("f", 6, "c", "1")]
    got = ledger.amended(spark.createDataFrame(rows, "family string, seq int, key string, value string")).orderBy("seq").collect()
    assert [r.state for r in got] == ["added", "repeated", "refused", "refused", "refused"]


def test_seeds_must_differ(spark):
    with pytest.raises(ValueError, match="different seeds"):
        signals.random_selections(None, None, [1, 1])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "date date, ticker string, weight double, close double, held double")
    assert accounts.allocation_plan(none, equity=1.0).count() == 0
    assert accounts.unit_root(none, "ticker", "date", "close").count() == 0
    assert accounts.replay_verdict(spark.createDataFrame([], "k string, error boolean, aborted boolean, denials int"), "k").count() == 0


def test_champions_against_a_stack(spark):
    rng = np.random.default_rng(3)
    rows = [(r, i, "promote" if rng.random() < 0.5 else "rollback", f"m{i}") for r in ("a", "b") for i in range(80)]
    got = {(x.registry, x.seq): x.champion for x in accounts.champions(spark.createDataFrame(rows, "registry string, seq int, event string, model string")).collect()}
    stacks = {"a": [], "b": []}
    for r, i, event, model in rows:
        if event == "promote":
            stacks[r].append(model)
        elif stacks[r]:
            stacks[r].pop()
        assert got[(r, i)] == (stacks[r][-1] if stacks[r] else None)


def test_round_trips_are_apart_and_need_room(spark):
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(25)]
    bars = spark.createDataFrame([("t", d) for d in days], "ticker string, date date")
    for seed in (1, 2):
        got = signals.random_round_trips(bars, 4, 5, seed).orderBy("trip").collect()
        assert len(got) == 4 and all((r.exit - r.entry).days == 5 for r in got)
        assert all((b.entry - a.exit).days >= 1 for a, b in zip(got, got[1:]))
    with pytest.raises(Exception, match="too few rows"):
        signals.random_round_trips(bars.where("date < DATE '2020-01-24'"), 4, 5, 1).collect()


def test_kill_on_a_weekend_counts_from_the_session_before(spark):
    sessions = spark.createDataFrame([(D(2020, 1, d), n) for n, d in enumerate((2, 3, 6, 7, 8), 1)], "date date, session_no int")
    kills = spark.createDataFrame([("p", D(2020, 1, 4)), ("q", D(2020, 1, 8)), ("r", None)], "profile string, day date")
    one = lambda d: spark.createDataFrame([("p", d)], "profile string, session date")
    got = accounts.skipped_while_killed(kills, sessions, one(D(2020, 1, 7)), one(D(2020, 1, 3))).collect()
    assert {(r.profile, r.session) for r in got} == {("p", D(2020, 1, 6)), ("p", D(2020, 1, 8))}
