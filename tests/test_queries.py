"""Registered queries against their SQL on another engine, and what has no SQL against brute force."""

import math
from collections import defaultdict
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, difference
from tidemark.functions.columns import edge_squared
from tidemark.operators import bias, calendar, folds, ledger, models, simulate
from tidemark.plans import books, evidence, research, strategies  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES
from tidemark.streaming import guards

#: One query or two of each family; all of them run in the driver's own comparison.
CHECKED = [
    "cal_05_market_holidays", "cal_08_nth_session_after", "cal_11_decisions_weekly", "src_04_bars", "src_28_money", "dq_01_bar_violations", "dq_03_split_discontinuities", "dq_18_research_eligibility",
    "join_03_reconcile", "join_09_vintage_as_of", "join_10_as_of", "join_11_bitemporal", "set_05_difference", "win_01_sma_crossover", "win_02_features", "win_05_forward_return", "win_09_ewma_volatility",
    "win_16_research_close", "win_22_trend_monitor", "top_02_cross_momentum_h3_3", "top_03_dual_momentum_h6_6", "top_09_universe", "sig_03_random_selection", "sig_09_orders", "agg_10_matched_activity", "pf_04_gross_cap",
    "sim_01_paired_trades", "ml_01_walk_forward", "ml_02_inner_splits", "ml_06_walk_forward_ridge", "ml_13_signed_ranks", "agg_04_hac", "agg_06_max_drawdown", "sb_09_split_records", "led_01_chain", "led_01_verify", "st_02_loss_cap_history", "st_15_rolling_budget", "st_sessions",
    "agg_02_performance_summary", "agg_26_diagnose", "dq_20_candidates", "join_12_membership", "pf_18_bound_buys", "sb_11_gate", "st_05_equity_observation", "st_08_journal", "win_28_cost_surface",
]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLE_SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__ as entries

    assert entries.entry(spark).count() > 0
    assert set(entries.oracle_sql()) <= set(entries.queries())


def test_calendar_facts(spark):
    days = {r.date for r in calendar.trading_days(spark, date(2021, 1, 1), date(2023, 12, 31)).collect()}
    assert date(2021, 12, 31) in days and date(2021, 4, 2) not in days  # a Saturday New Year closes no Friday; Good Friday
    assert date(2021, 6, 18) in days and date(2022, 6, 20) not in days  # Juneteenth from 2022, kept on Monday
    assert [sum(d.year == y for d in days) for y in (2021, 2022, 2023)] == [252, 251, 250]
    assert calendar.trading_days(spark, date(2021, 1, 2), date(2021, 1, 1)).count() == 0


def test_fold_bounds_chain_month_ends(spark):
    rows = [("a", date(2021, 1, 31)), ("a", date(2021, 6, 30)), ("b", date(2021, 3, 1)), ("b", date(2021, 4, 10)), ("c", date(2021, 3, 1))]
    got = folds._bounds(spark.createDataFrame(rows, "ticker string, date date"), ["ticker"], 1, 1).orderBy("ticker", "fold").collect()
    assert [r.test_start for r in got if r.ticker == "a"] == [date(2021, 2, 28), date(2021, 3, 28), date(2021, 4, 28), date(2021, 5, 28), date(2021, 6, 28)]
    assert [(r.ticker, r.fold, r.test_start, r.test_end) for r in got if r.ticker != "a"] == [("b", 0, date(2021, 4, 1), date(2021, 5, 1))]


def test_causal_features_ignore_the_future(spark, sf):
    from tidemark.operators.windows import features
    from tidemark.sources.frames import bars

    whole = bars(spark, sf).where("ticker = 'Brand#1'")
    cut = date(1998, 1, 1)
    changed = whole.withColumns({c: F.when(F.col("date") >= F.lit(cut), F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    cols = ["date", "log_return", "volatility", "sma_spread", "close_to_short", "relative_volume"]
    rows = lambda x: sorted(map(tuple, features(x).where(F.col("date") < F.lit(cut)).select(*cols).collect()))
    assert rows(whole) == rows(changed)


def direct_spread(bars):
    """The published estimator's moments by plain sums over the bars, one pair of neighbours at a time."""
    pairs = list(zip(bars, bars[1:]))
    n = len(pairs)
    traded = [now["h"] != now["l"] or now["l"] != old["c"] for old, now in pairs]
    at_open = sum(t * ((now["o"] != now["h"]) + (now["o"] != now["l"])) for t, (_, now) in zip(traded, pairs)) / n
    at_close = sum(t * ((old["c"] != old["h"]) + (old["c"] != old["l"])) for t, (old, _) in zip(traded, pairs)) / n
    middle = lambda x: (x["h"] + x["l"]) / 2
    legs = [(middle(now) - now["o"], now["o"] - middle(old), middle(now) - old["c"], old["c"] - middle(old), now["o"] - old["c"]) for old, now in pairs]
    drift = [sum(leg[k] for leg in legs) / sum(traded) for k in range(5)]
    first = [-4 * ((g[0] - drift[0] * t) * g[1] / at_open + (g[2] - drift[2] * t) * g[3] / at_close) for g, t in zip(legs, traded)]
    second = [-4 * ((g[0] - drift[0] * t) * g[4] / at_open + (g[4] - drift[4] * t) * g[3] / at_close) for g, t in zip(legs, traded)]
    spread = [(np.mean(x), np.var(x)) for x in (first, second)]
    return (spread[1][1] * spread[0][0] + spread[0][1] * spread[1][0]) / (spread[0][1] + spread[1][1])


def test_edge_matches_direct_arithmetic(spark):
    r = np.random.default_rng(4)
    for _ in range(6):
        close = 100 * np.exp(np.cumsum(r.normal(0, 0.01, 22)))
        first = close * np.exp(r.normal(0, 0.004, 22))
        high, low = np.maximum(first, close) * (1 + r.random(22) * 0.01), np.minimum(first, close) * (1 - r.random(22) * 0.01)
        bars = [{"o": float(w), "h": float(x), "l": float(y), "c": float(z)} for w, x, y, z in zip(*(np.log(v) for v in (first, high, low, close)))]
        frame = spark.createDataFrame([(bars,)], "b array<struct<o:double,h:double,l:double,c:double>>")
        assert math.isclose(frame.select(edge_squared(F.col("b")).alias("s")).first().s, direct_spread(bars), rel_tol=1e-6, abs_tol=1e-12)


def test_edge_by_moving_averages(spark):
    """The moving form against the estimator over each row's own 21 bars."""
    from pyspark.sql import Window

    from tidemark.functions.columns import with_edge

    r = np.random.default_rng(5)
    close = 50 * np.exp(np.cumsum(r.normal(0, 0.02, 60)))
    first = close * np.exp(r.normal(0, 0.01, 60))
    rows = [(i, float(o), float(max(o, c) * (1 + x)), float(min(o, c) * (1 - x)), float(c)) for i, (o, c, x) in enumerate(zip(first, close, r.random(60) * 0.02))]
    rows[30:33] = [(i, 40.0, 40.0, 40.0, 40.0) for i in (30, 31, 32)]
    frame, spec = spark.createDataFrame(rows, "i int, open double, high double, low double, close double"), Window.partitionBy(F.lit(1)).orderBy("i")
    out = with_edge(frame, spec, 20, "s2").orderBy("i").collect()
    for k in range(21, 60):
        bars = [{"o": math.log(o), "h": math.log(h), "l": math.log(low), "c": math.log(c)} for _, o, h, low, c in rows[k - 20 : k + 1]]
        assert math.isclose(out[k].s2, direct_spread(bars), rel_tol=1e-5, abs_tol=1e-11)
    assert out[19].s2 is None


def test_deflated_sharpe_paper_points(spark):
    rows = [(2.5 / math.sqrt(250), 1250, -3.0, 10.0, math.sqrt(0.5 / 250), n) for n in (100, 46, 88)]
    frame = spark.createDataFrame(rows, "s double, n long, g double, k double, v double, c long")
    got = [r.d.dsr for r in frame.select(bias.deflated_sharpe(*[F.col(c) for c in "sngkvc"]).alias("d")).collect()]
    assert np.allclose(got, [0.9004, 0.9505, 0.910153], atol=1e-4)


def test_pbo_of_a_persistent_winner(spark):
    rows = [(t, date(2020, 1, 1 + i) if i < 31 else date(2020, 2, i - 30), (0.02 if t == "a" else 0.0) + (0.001 if i % 2 else -0.001) * (1 + (t == "b"))) for t in "abc" for i in range(48)]
    matrix = spark.createDataFrame(rows, "trial string, session date, r double")
    one = bias.overfit_probability(bias.split_records(bias.half_sharpes(matrix))).first()
    assert one.splits == 12870 and one.pbo == 0.0


def test_funded_ledger(spark):
    days = [date(2020, 1, d) for d in range(1, 8)]
    rows = [("r", d, 10.0 + i, 10.5 + i, 2.0 if i == 2 else 1.0, 0.5 if i == 3 else 0.0, days[4] if i == 3 else None, i == 1, i == 5) for i, d in enumerate(days)]
    frame = spark.createDataFrame(rows, "run string, date date, open double, close double, split double, dividend double, pay_date date, buy_next_open boolean, sell_next_open boolean")
    got = simulate.funded_ledger(frame, capital=100.0, shares=3, commission=1.0, bps=0.0).orderBy("event_no").collect()
    assert [r.event for r in got if r.event != "mark"] == ["initial", "buy", "split", "dividend", "payment", "sell"]
    last = got[-1]
    assert last.quantity == 0 and math.isclose(last.cash, 100 - 3 * 11 - 1 + 6 * 0.5 + 6 * 15 - 1)
    assert all(math.isclose(r.equity, r.cash + r.quantity * r.price + r.receivable) for r in got)
    poor = simulate.funded_ledger(frame, capital=20.0, shares=3).collect()
    assert any(r.event == "rejected" for r in poor) and all(r.quantity == 0 for r in poor)


def test_portfolio_by_hand(spark):
    days = [date(2020, 1, d) for d in (1, 2, 3, 6)]
    opens, closes = {"a": [10, 10, 12, 12], "b": [20, 20, 20, 25]}, {"a": [10, 11, 12, 13], "b": [20, 20, 22, 25]}
    weights = {0: {"a": 0.5, "b": 0.5}, 2: {"a": 1.0, "b": 0.0}}
    rows = [("x", d, t, float(opens[t][i]), float(closes[t][i]), weights.get(i, {}).get(t), 0.01) for i, d in enumerate(days) for t in "ab"]
    got = simulate.portfolio(spark.createDataFrame(rows, "run string, date date, ticker string, open double, close double, weight double, cost double"), capital=1000.0).orderBy("date").collect()
    scale = 1000 / (50 * 10 * 1.01 + 25 * 20 * 1.01)
    a, b = 50 * scale, 25 * scale
    v1 = a * 11 + b * 20
    assert math.isclose(got[0].equity, 1000) and math.isclose(got[1].equity, v1, rel_tol=1e-12)
    v2 = a * 12 + b * 22
    cash = b * 25 * 0.99
    more = min(1.0, cash / ((v2 / 12 - a) * 12 * 1.01)) * (v2 / 12 - a)
    assert math.isclose(got[3].equity, cash - more * 12 * 1.01 + (a + more) * 13, rel_tol=1e-12)


def test_ridge_recovers_a_line(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(300):
        x = r.normal(size=2)
        rows.append(("t", 0, "train" if i < 200 else "test", date(2020, 1, 1), i, float(2 * x[0] - x[1]), float(x[0]), float(x[1])))
    frame = spark.createDataFrame(rows, "ticker string, fold int, role string, date date, position int, label double, a double, b double")
    inner = spark.createDataFrame([("t", 0, 0, 100, 150), ("t", 0, 1, 150, 200)], "ticker string, outer_fold int, fold int, test_from int, test_to int")
    assert {(r.strength, r.tuned) for r in models.walk_forward_predictions(frame, "ridge", ["a", "b"]).collect()} == {(1.0, False)}
    got = models.walk_forward_predictions(frame, "ridge", ["a", "b"], 1, 1, inner).toPandas()
    want = [x[5] for x in rows[200:]]
    assert len(got) == 100 and np.corrcoef(sorted(got.prediction), sorted(want))[0, 1] > 0.999 and set(got.strength) == {0.1}


@pytest.mark.parametrize("name", ["ridge", "logistic"])
def test_nested_walk_forward_against_brute_force(spark, name):
    r = np.random.default_rng(7)
    days = pd.bdate_range("2020-01-15", periods=420)
    x = r.normal(size=(420, 2))
    y = x @ [0.3, -0.2] + r.normal(size=420)
    y = (y > 0).astype(float) if name == "logistic" else y
    x[[5, 200], 0], y[[50, 219]], horizon, embargo = np.nan, np.nan, 3, 5
    rows = [("t", d.date(), *(None if np.isnan(v) else float(v) for v in (*x[i], y[i]))) for i, d in enumerate(days)]
    frame = spark.createDataFrame(rows, "ticker string, date date, a double, b double, label double")
    args = {"train_months": 6, "test_months": 3}
    outer = folds.walk_forward(frame, horizon=horizon, embargo=embargo, **args)
    inner = folds.fold_windows(folds.inner_frames(outer), keys=["ticker", "outer_fold"], **args)
    found = models.walk_forward_predictions(outer.join(frame, ["ticker", "date"]), name, ["a", "b"], horizon, embargo, inner).collect()

    def splits(where):
        start, gaps = days[where[0]] + pd.DateOffset(months=6), []
        while start <= days[where[-1]]:
            end = start + pd.DateOffset(months=3)
            test = [k for k, i in enumerate(where) if start <= days[i] < end]
            train = [k for k in range(test[0] - horizon) if all(not g <= k < g + embargo for g in gaps)]
            yield [where[k] for k in train], [where[k] for k in test]
            gaps.append(test[-1] + 1)
            start = end

    def predict(train, test, strength):
        train = [i for i in train if not np.isnan([*x[i], y[i]]).any()]
        m, sd = x[train].mean(0), x[train].std(0)
        z, t = [np.column_stack([np.ones(len(i)), (x[i] - m) / sd]) for i in (train, test)]
        w, tgt = np.zeros(3), y[train]
        pen = np.diag([0, 1.0, 1.0]) * (strength if name == "ridge" else 1 / strength)
        if name == "ridge":
            return t @ np.linalg.solve(z.T @ z + pen, z.T @ tgt)
        for _ in range(100):
            p = 1 / (1 + np.exp(-z @ w))
            w = w + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pen, z.T @ (tgt - p) - pen @ w)
        return 1 / (1 + np.exp(-t @ w))

    def loss(train, test, strength):
        test = [i for i in test if not np.isnan([*x[i], y[i]]).any()]
        p, t = predict(train, test, strength), y[test]
        return np.mean((t - p) ** 2) if name == "ridge" else -np.mean(t * np.log(p) + (1 - t) * np.log(1 - p))

    want = {}
    for n, (train, test) in enumerate(splits(list(range(420)))):
        parts = list(splits(train))
        means = [np.mean([loss(a, b, g) for a, b in parts]) for g in models.GRIDS[name]] if parts else []
        strength = models.GRIDS[name][int(np.argmin(means))] if parts else 1.0
        test = [i for i in test if not np.isnan(x[i]).any()]
        want |= {(n, days[i].date()): (strength, bool(parts), p) for i, p in zip(test, predict(train, test, strength))}
    got = {(g.fold, g.date): (g.strength, g.tuned, g.prediction) for g in found}
    assert got.keys() == want.keys() and {v[1] for v in want.values()} == {True, False}
    assert all(got[k][:2] == want[k][:2] and math.isclose(got[k][2], want[k][2], rel_tol=1e-6, abs_tol=1e-9) for k in want)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", date(2020, 1, d), 100.0 + (7 * d) % 11 - d) for d in (*range(2, 11), *range(13, 18))] + [("b", date(2020, 1, 6), 50.0)]
    schema = "account string, session date, equity double"
    limits = {"daily": 0.02, "weekly": 0.03, "drawdown": 0.04}
    for i, part in enumerate((rows[:6], rows[6:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    late = spark.createDataFrame([("a", date(2020, 1, 3), 1.0)], schema)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = guards.loss_cap_stream(stream, **limits).writeStream.format("memory").queryName("caps").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    late.coalesce(1).write.parquet(str(tmp_path / "in" / "late"))
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from caps").toPandas()
    assert got.refused.sum() == 1
    got = got[~got.refused].sort_values(["account", "session"]).reset_index(drop=True)
    want = guards.loss_cap_history(spark.createDataFrame(rows, schema), **limits).toPandas().sort_values(["account", "session"]).reset_index(drop=True)
    assert list(got.entries_halted) == list(want.entries_halted) and want.entries_halted.any()
    for c in ("daily_return", "weekly_return", "weekly_drawdown"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_windowed_stream_closes_its_windows(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = guards.tumbling(stream, "1 day", late="1 hour").writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): (r.n, r.cents) for r in spark.sql("select * from days").collect()}
    want = {(r.start, r.event_type): (r.n, r.cents) for r in guards.tumbling(events, "1 day").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    fresh, late = guards.late_split(events, "2024-01-20 00:00:00", "10 days")
    assert fresh.count() + late.count() == events.count()


def test_manifest_and_drill(spark, tmp_path):
    for name, text in (("a/x", "1"), ("a/y", "2"), ("b/x", "1"), ("b/y", "3")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    strip = lambda m: m.withColumn("path", F.element_at(F.split("path", "/"), -1))
    a, b = (strip(ledger.manifest(spark, str(tmp_path / d))) for d in "ab")
    assert [r.path for r in ledger.drill(a, b).collect()] == ["y"]


def test_read_and_write_bars(spark, sf, tmp_path):
    from tidemark.sources.frames import bars, read_bars, write_bars

    b = bars(spark, sf)
    write_bars(b, str(tmp_path / "bars"))
    back = read_bars(spark, str(tmp_path / "bars"), tickers=["Brand#3"])
    assert back.count() == b.where("ticker = 'Brand#3'").count() > 0
    assert "PartitionFilters: [" in back._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception):
        write_bars(b, str(tmp_path / "bars"))


def test_whole_panel_queries(spark, sf):
    from tidemark.sources.frames import bars

    panel = strategies._weekly(spark, sf).select("session_no", "date", "ticker", "close").toPandas()
    tickers = sorted(r.ticker for r in bars(spark, sf).select("ticker").distinct().collect())
    wide = panel.pivot(index="session_no", columns="ticker", values="close")[tickers].astype(float)
    returns = np.log(wide / wide.shift(1))
    dates = panel.drop_duplicates("session_no").set_index("session_no").date.to_dict()
    assert len(tickers) == 25 and returns.notna().any().all()

    moments = {r.trial: r for r in QUERIES["sb_03_matrix_dsr"](spark, sf).collect()}
    rate = bias.RISK_FREE_LOG / bias.SESSIONS_PER_YEAR
    assert sorted(moments) == tickers
    for t in tickers:
        x = returns[t].dropna() - rate
        assert moments[t].n == len(x) and math.isclose(moments[t].sharpe, x.mean() / x.std(), rel_tol=1e-6)
    blocks = defaultdict(int)
    for r in QUERIES["sb_07_block_moments_whole"](spark, sf).collect():
        blocks[r.trial] += r.n
    assert dict(blocks) == {t: int(returns[t].notna().sum()) for t in tickers}

    got = QUERIES["win_10_pair_covariance_whole"](spark, sf).where("cov is not null").toPandas()
    assert len(set(zip(got.a, got.b))) == 325
    numbers = {v: k for k, v in dates.items()}
    for r in got.sample(200, random_state=1).itertuples():
        part = returns.loc[numbers[r.date] - 59 : numbers[r.date], [r.a, r.b]]
        x, y = part.iloc[:, 0], part.iloc[:, 1]
        assert len(part) == 60 and math.isclose(((x - x.mean()) * (y - y.mean())).sum() / 59 * 252, r.cov, rel_tol=1e-4, abs_tol=2e-5)
    assert got.date.min() < date(1996, 1, 1)


def test_buys_fractions_and_pots(spark):
    """Worked by hand: 100 of cash and a cap of 150; quantities of three decimals, then of none."""
    from tidemark.operators.orders import bound_buys

    rows = [("r", 1, "A", 7.0, 5.0), ("r", 2, "B", 30.0, 4.0), ("r", 3, "C", 1.0, 1.0), ("s", 1, "A", 200.0, 2.0), ("t", 1, "A", 10.0, 0.4)]
    frame = spark.createDataFrame(rows, "run string, place int, ticker string, price double, quantity double")
    got = {(r.run, r.place): (r.quantity, r.notional, r.reason) for r in bound_buys(frame, cash=100.0, cap=150.0, minimum=5.0, places=3).collect()}
    assert got == {("r", 1): (5.0, 35.0, None), ("r", 2): (2.166, 64.98, None), ("r", 3): (None, None, "below_minimum"), ("s", 1): (0.5, 100.0, None), ("t", 1): (None, None, "below_minimum")}
    whole = {(r.run, r.place): (r.quantity, r.reason) for r in bound_buys(frame, cash=100.0, cap=150.0, minimum=5.0).collect()}
    assert whole == {("r", 1): (5.0, None), ("r", 2): (2.0, None), ("r", 3): (None, "below_minimum"), ("s", 1): (None, "insufficient_settled_cash"), ("t", 1): (None, "below_one_share")}
    spent = {r.place: r.reason for r in bound_buys(frame.where("run = 'r'"), cash=500.0, cap=35.0, minimum=5.0).collect()}
    assert spent == {1: None, 2: "daily_cap", 3: "daily_cap"}


def test_withdrawn_vintage(spark):
    """A vintage that ends without a successor gives way to the date before it."""
    from tidemark.operators.joins import vintage_as_of

    d = date
    far = d(9999, 12, 31)
    series = [("a", d(2020, 1, 1), d(2020, 1, 10), d(2020, 2, 9), 1.0), ("a", d(2020, 1, 1), d(2020, 2, 10), far, 2.0), ("a", d(2020, 2, 1), d(2020, 2, 5), d(2020, 2, 20), 9.0), ("b", d(2020, 1, 1), d(2019, 12, 1), far, 5.0), ("c", d(2020, 1, 1), d(2020, 1, 2), far, None)]
    frame = spark.createDataFrame(series, "series string, date date, realtime_start date, realtime_end date, value double")
    days = spark.createDataFrame([(d(2020, 1, 2), 1), (d(2020, 1, 11), 2), (d(2020, 2, 6), 3), (d(2020, 2, 22), 4)], "date date, session_no int")
    got = {(r.series, r.session): r.value for r in vintage_as_of(frame, days).collect()}
    assert [got["a", x] for x in (d(2020, 1, 2), d(2020, 1, 11), d(2020, 2, 6), d(2020, 2, 22))] == [None, 1.0, 9.0, 2.0]
    assert got["b", d(2020, 1, 2)] == 5.0 and got["c", d(2020, 2, 22)] is None


def test_observations_stream_is_its_batch(spark, tmp_path):
    from datetime import datetime

    from tidemark.streaming import flows

    schema = "observation_id string, ts timestamp, digest string"
    rows = [("x", datetime(2024, 1, 1, 9), "p"), ("x", datetime(2024, 1, 1, 10), "p"), ("y", datetime(2024, 1, 1, 9), "q"), ("x", datetime(2024, 1, 2, 9), "r"), ("y", datetime(2024, 1, 2, 9), "q"), ("z", datetime(2024, 1, 2, 9), "q")]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = flows.first_observations_stream(stream).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = flows.first_observations(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.sql("select * from seen").collect())) == sorted(map(tuple, want.collect()))
