"""Queries over records of sources, fills, configurations and readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import bundles, joins, quality, receipts, signals, simulate, sizing
from tidemark.operators import calendar as cal
from tidemark.operators import windows as win
from tidemark.plans import accounts, research  # noqa: F401  (SQL here is built on theirs)
from tidemark.plans.registry import ORACLE_SQL, query, rounded
from tidemark.plans.strategies import _RUN, _SAFE, _SECTORS, _TRADES, _crossings, _panel, _weekly
from tidemark.sources import frames as src
from tidemark.sources.storage import scratch_dir

_NY = "timezone('America/New_York', {})"


@query(
    "dq_24_manifest_faults",
    "sessions",
    f""", m AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS session, CAST(o_orderdate AS DATE)::TIMESTAMP + to_hours((o_orderkey % 48)::INT) AS fetched, o_orderkey AS k, o_orderpriority AS p FROM orders)
SELECT id, session, concat_ws(',', CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'credential' END, CASE WHEN s.date IS NULL THEN 'no_session' END,
  CASE WHEN s.date IS NOT NULL AND timezone('UTC', {_NY.format("session::TIMESTAMP + INTERVAL 16 HOUR")}) > fetched THEN 'not_closed' END, CASE WHEN k % 13 = 0 THEN 'adjustment' END, CASE WHEN k % 17 = 0 THEN 'row_count' END, CASE WHEN k % 19 = 0 THEN 'digest' END) AS faults FROM m LEFT JOIN sessions s ON s.date = m.session""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://"), F.when(k % 7 == 0, "user:pw@").otherwise(""), F.lit("host/prices?from="), k, F.when(k % 11 == 0, "&Token=x").otherwise("&fmt=csv"))
    day = F.to_date("o_orderdate")
    rows = src.table(spark, d, "orders").select(
        k.alias("id"),
        day.alias("session"),
        (day.cast("timestamp") + F.make_interval(hours=(k % 48).cast("int"))).alias("fetched_at"),
        url.alias("endpoint"),
        F.when(k % 13 != 0, "raw").alias("adjustment"),
        F.when(k % 17 == 0, -1).otherwise(k).alias("row_count"),
        F.when(k % 19 == 0, F.upper(F.sha2(k.cast("string"), 256))).otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"),
    )
    return receipts.manifest_faults(rows, src.sessions_of(spark, src.bars(spark, d))).select("id", "session", "faults")


@query("dq_30_reconciled", "second_source", "SELECT ticker, date FROM second_source WHERE dayofyear(date) % 13 <> 0 AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def _(spark, d):
    """The dates that both sources have and agree on, passed through the assertion."""
    b = src.bars(spark, d)
    value = lambda x: x.select("ticker", "date", F.col("close").alias("value"))
    other = src.second_source(b).where(F.dayofyear("date") % 13 != 0)
    covered = F.col("date").between(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
    statuses = joins.reconcile(value(b.where((F.dayofyear("date") % 17 != 0) & (F.dayofyear("date") % 13 != 0))), value(other), covered, 1e-4)
    return receipts.assert_reconciled(statuses).where("status = 'reconciled'").select("ticker", "date")


@query("src_23_closes_by_day", "", f"SELECT user_id::VARCHAR AS ticker, CAST({_NY.format('timezone(\'UTC\', ts)')} AS DATE) AS date, max_by(value, ts) AS close FROM events GROUP BY 1, 2 HAVING count(*) = count(DISTINCT ts)")
def _(spark, d):
    e = src.table(spark, d, "events").select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("timestamp").alias("t"), F.col("value").alias("c"))
    day = F.to_date(F.from_utc_timestamp("t", "America/New_York")).alias("date")
    single = e.groupBy("ticker", day).agg(F.count("*").alias("n"), F.count_distinct("t").alias("m")).where("n = m").select("ticker", "date")
    return receipts.closes_by_day(e).join(single, ["ticker", "date"], "left_semi")


@query("src_24_replay_inputs", "bars", "SELECT ticker, date, open, close FROM bars WHERE ticker IN (SELECT min(ticker) FROM bars) AND date <= DATE '1997-06-30'")
def _(spark, d):
    b = src.bars(spark, d)
    return receipts.replay_inputs(b, [b.agg(F.min("ticker")).first()[0]], "1997-06-30")


@query("top_13_run_days", "", f"SELECT event_id AS run_id, ts AS started, day, row_number() OVER (PARTITION BY day ORDER BY ts, event_id)::INT AS place FROM (SELECT event_id, ts, CAST({_NY.format('timezone(\'UTC\', ts)')} AS DATE) AS day FROM events)")
def _(spark, d):
    runs = src.table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("started"))
    return receipts.by_run_day(runs).select("run_id", F.col("started").cast("timestamp_ntz").alias("started"), "day", "place")


_ST = "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'new' WHEN k % 5 = 2 THEN 'canceled' ELSE 'filled' END"
_FQ = "CASE WHEN k % 7 = 0 THEN 'x' WHEN k % 7 = 1 THEN NULL WHEN k % 7 = 2 THEN '0' ELSE q::INT::VARCHAR END"


@query(
    "aux_13_fills",
    "",
    f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS k, l_quantity AS q FROM lineitem), p AS (SELECT *, {_ST} AS st, {_FQ} AS f, CASE WHEN k % 11 = 0 THEN '-2' WHEN k % 11 = 1 THEN 'n' ELSE '12.5' END AS pr FROM o)
SELECT l_orderkey, l_linenumber, coalesce(st, 'no broker record') AS status,
  coalesce((st = 'canceled' AND (f IS NULL OR f = '0')) OR (st = 'filled' AND k % 11 NOT IN (0, 1) AND try_cast(f AS DOUBLE) = q), false) AS reconciled,
  CASE WHEN st = 'filled' AND k % 11 NOT IN (0, 1) AND try_cast(f AS DOUBLE) IS NOT NULL THEN 12.5::DOUBLE END AS price,
  CASE WHEN st IS NULL THEN 'no broker snapshot for this order' WHEN st = 'new' THEN 'broker status is not terminal' WHEN st = 'canceled' THEN CASE WHEN f IS NULL OR f = '0' THEN '' ELSE 'canceled after a partial fill' END
    WHEN k % 11 = 1 OR try_cast(f AS DOUBLE) IS NULL THEN 'filled without a numeric price and quantity' WHEN k % 11 = 0 THEN 'filled at a non-positive price' WHEN try_cast(f AS DOUBLE) <> q THEN 'filled another quantity' ELSE '' END AS problem FROM p""",
)
def _(spark, d):
    k = F.col("l_orderkey") + F.col("l_linenumber")
    status = F.when(k % 5 == 0, None).when(k % 5 == 1, "new").when(k % 5 == 2, "Canceled").otherwise("FILLED")
    filled = F.when(k % 7 == 0, "x").when(k % 7 == 1, None).when(k % 7 == 2, "0").otherwise(F.col("l_quantity").cast("int").cast("string"))
    price = F.when(k % 11 == 0, "-2").when(k % 11 == 1, "n").otherwise("12.5")
    rows = src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", receipts.reconciled_fill(status, filled, price, F.col("l_quantity")).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "x.*")


@query(
    "pf_21_buy_refusals",
    "",
    """WITH b AS (SELECT o_custkey AS account, l_partkey AS ticker, sum(l_quantity) AS quantity, any_value(p_retailprice) AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N' GROUP BY 1, 2),
h AS (SELECT o_custkey AS account, l_partkey AS ticker, l_quantity AS quantity, (o_custkey % 4)::BIGINT AS age FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
a AS (SELECT account, max(age) AS age FROM h GROUP BY 1), t AS (SELECT account, ticker, sum(quantity) AS held FROM h GROUP BY 1, 2)
SELECT * FROM (SELECT b.account, b.ticker, CASE WHEN a.age IS NULL THEN 'holdings_missing' WHEN a.age > 2 THEN 'holdings_stale' WHEN (coalesce(held, 0) + quantity) * price > 0.04::DOUBLE * 1000000 THEN 'concentration' END AS reason FROM b LEFT JOIN a ON a.account = b.account LEFT JOIN t ON t.account = b.account AND t.ticker = b.ticker) WHERE reason IS NOT NULL""",
)
def _(spark, d):
    lines = src.table(spark, d, "lineitem").join(src.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("account")), "l_orderkey").withColumnRenamed("l_partkey", "ticker")
    prices = src.table(spark, d, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_retailprice").alias("price"))
    buys = lines.where("l_returnflag = 'N'").groupBy("account", "ticker").agg(F.sum("l_quantity").alias("quantity")).join(prices, "ticker").withColumn("value", F.lit(1_000_000.0))
    held = lines.where("l_returnflag = 'R'").select("account", "ticker", F.col("l_quantity").alias("quantity"), (F.col("account") % 4).alias("age"))
    return receipts.buy_refusals(buys, held, limit=0.04, max_age=2)


@query("pf_15_sizing_class", "", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'equal_legs_vol_target' WHEN p_brand = 'Brand#13' THEN 'equal_weight_unscaled' ELSE 'inverse_vol_vol_target' END AS sizing, CASE WHEN p_brand = 'Brand#12' THEN 'weekly' ELSE 'monthly' END AS cadence FROM part")
def _(spark, d):
    c = F.col("p_brand")
    return src.table(spark, d, "part").select("p_partkey", receipts.sizing_class(c, ["Brand#11", "Brand#12"], ["Brand#13"]).alias("sizing"), receipts.cadence(c, ["Brand#12"]).alias("cadence"))


@query("aux_07_robustness", "bars", "SELECT role, impact, ticker, n FROM (SELECT ticker, count(*)::BIGINT AS n FROM bars GROUP BY 1), (VALUES ('primary', 1.0::DOUBLE), ('robustness', 0.5::DOUBLE), ('robustness', 2.0::DOUBLE)) v(role, impact)")
def _(spark, d):
    primary = src.bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n")).withColumn("impact", F.lit(1.0))
    return receipts.with_robustness(primary, [0.5, 2.0])


@query(
    "aux_10_dividends",
    "actions",
    """, mine AS (SELECT date, value FROM actions WHERE kind = 'dividend' AND ticker = (SELECT min(ticker) FROM bars)), other AS (SELECT date, value * CASE WHEN month(date) = 6 THEN 1.5::DOUBLE ELSE 1 END AS value FROM mine WHERE month(date) <> 12)
SELECT coalesce(a.date, b.date) AS date, CASE WHEN a.date IS NULL OR b.date IS NULL OR abs(a.value - b.value) > 1e-4 + 1e-12 THEN 'mismatch' ELSE 'reconciled' END AS status FROM mine a FULL JOIN other b ON a.date = b.date""",
)
def _(spark, d):
    """One instrument's dividends in two sources; splits take no part."""
    a = src.actions(spark, d)
    one = a.join(F.broadcast(src.bars(spark, d).agg(F.min("ticker").alias("ticker"))), "ticker")
    mine = joins.dividends_only(one)
    other = mine.where(F.month("date") != 12).withColumn("value", F.when(F.month("date") == 6, F.col("value") * 1.5).otherwise(F.col("value")))
    return joins.reconcile(mine, other, F.lit(True), 1e-4).select("date", "status")


_RD = ORACLE_SQL["win_02_features"]


@query("ml_19_rundown", "", f"""WITH r AS ({_RD}), l AS (SELECT * FROM r WHERE close_to_short IS NOT NULL AND sma_spread IS NOT NULL AND volatility IS NOT NULL AND relative_volume IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)
SELECT ticker, date, CASE WHEN close_to_short > 0 AND sma_spread > 0 THEN 'bullish' WHEN NOT close_to_short > 0 AND NOT sma_spread > 0 THEN 'bearish' ELSE 'neutral' END AS agreement, CASE WHEN close_to_short >= 0 THEN 'bullish' ELSE 'bearish' END AS momentum, CASE WHEN sma_spread >= 0 THEN 'bullish' ELSE 'bearish' END AS regime,
  CASE WHEN volatility * sqrt(252) > 0.35 THEN 'caution' WHEN volatility * sqrt(252) > 0.22 THEN 'neutral' ELSE 'bullish' END AS volatility, CASE WHEN relative_volume > 1.25 AND close_to_short > 0 THEN 'bullish' WHEN relative_volume > 1.4 AND close_to_short < 0 THEN 'caution' ELSE 'neutral' END AS flow FROM l""")
def _(spark, d):
    return receipts.rundown(win.features(src.bars(spark, d)))


# books, payloads, bundles


@query("sig_16_random_book", "", f"WITH s AS ({ORACLE_SQL['sig_03_random_selection']}) SELECT ticker, date, round(CASE WHEN held THEN 0.93::DOUBLE / count(*) FILTER (WHERE held) OVER (PARTITION BY date) ELSE 0 END, 8) AS weight FROM s WHERE date IN (SELECT date FROM ({ORACLE_SQL['cal_11_decisions_monthly']}) WHERE decides)")
def _(spark, d):
    decisions = cal.decision_sessions(src.sessions_of(spark, src.bars(spark, d)), "monthly")
    picked = signals.random_selection(_panel(spark, d), decisions, enter=0.45, leave=0.4, start=0.5, seed=7)
    return rounded(sizing.random_book(picked, win.panel_log_returns(_weekly(spark, d)), decisions, "equal_weight_unscaled", cap=0.93, target=0.1, window=60), 8)


_CONFIGS = {"H1-3": "win_14_momentum_h1_3", "H1-12": "win_14_momentum_h1_12", "H2-100": "win_15_trend_h2_100", "H3-3": "top_02_cross_momentum_h3_3", "H4": "top_07_risk_parity_h4", "H6-6": "top_03_dual_momentum_h6_6", "H8": "top_06_reversal_h8"}


@query("top_08_dispatch", "", " UNION ALL ".join(f"SELECT '{c}' AS config, ticker, count(*) FILTER (WHERE held)::BIGINT AS sessions FROM ({ORACLE_SQL[n]}) x GROUP BY 2" for c, n in _CONFIGS.items()))
def _(spark, d):
    """Sessions held by name under each declared configuration, all by its id."""
    known = signals.hypotheses(_SAFE, _SECTORS)
    made = [known[c](_weekly(spark, d)).groupBy("ticker").agg(F.count_if("held").alias("sessions")).select(F.lit(c).alias("config"), "ticker", "sessions") for c in _CONFIGS]
    return quality.union_of(*made)


@query("agg_36_payload", "bars", _RUN + _TRADES + """, s AS (SELECT run, count(*) AS n, round(sum(pnl), 2) AS p, round(avg((pnl > 0)::INT), 4) AS w FROM trades GROUP BY 1) SELECT run, '{"run":"' || run || '","n_trades":"' || n || '","total_pnl":"' || printf('%.2f', p + 0.0) || '","win_rate":"' || printf('%.4f', w) || '"}' AS payload FROM s""")
def _(spark, d):
    summary = agg.trade_summary(simulate.paired_trades(_crossings(spark, d)), "run").select("run", "n_trades", "total_pnl", "win_rate")
    return receipts.payload(summary, "run", {"n_trades": 0, "total_pnl": 2, "win_rate": 4})


@query("set_07_concat", "bars", " SELECT ticker, date, close FROM bars WHERE right(ticker, 1) IN ('1', '2', '3')")
def _(spark, d):
    b = src.bars(spark, d).select("ticker", "date", "close")
    return quality.union_of(*[b.where(F.col("ticker").endswith(x)) for x in "123"])


@query("src_05_round_trip", "bars", " SELECT ticker, date, open, high, low, close, volume FROM bars WHERE ticker IN ('Brand#1', 'Brand#3')")
def _(spark, d):
    """Bars written by ticker, and two of them read back by their folders."""
    path = scratch_dir(spark)
    src.write_bars(src.bars(spark, d), path)
    return src.read_bars(spark, path, tickers=["Brand#1", "Brand#3"]).select("ticker", "date", "open", "high", "low", "close", "volume")


def _bundle(spark, d):
    path = scratch_dir(spark)
    rows = src.bars(spark, d).select("ticker", "date", F.round("volume").cast("long").alias("volume"))
    bundles.publish(rows, path, "ticker", ["date", "volume"])
    return path


@query("src_07_loaded", "bars", " SELECT ticker, date, round(volume)::BIGINT AS volume, 'nominal' AS basis FROM bars")
def _(spark, d):
    return bundles.load(spark, _bundle(spark, d), "ticker", ["date", "volume"])


@query("src_09_loaded_ticker", "bars", " SELECT ticker, date, round(volume)::BIGINT AS volume, 'nominal' AS basis FROM bars WHERE ticker = 'Brand#3'")
def _(spark, d):
    return bundles.load_one(spark, _bundle(spark, d), "ticker", "Brand#3", ["date", "volume"])


@query("src_35_inventory", "", """WITH l0 AS (SELECT sha256(p_partkey || '|' || p_brand) AS x FROM part), l1 AS (SELECT left(x, 4) AS p, sha256(string_agg(x, '' ORDER BY x)) AS x, count(*) AS n FROM l0 GROUP BY 1), l2 AS (SELECT left(p, 2) AS p, sha256(string_agg(x, '' ORDER BY x)) AS x, sum(n) AS n FROM l1 GROUP BY 1)
SELECT p_partkey, p_brand, (SELECT sha256(string_agg(x, '' ORDER BY x)) FROM l2) AS digest FROM part""")
def _(spark, d):
    path = scratch_dir(spark)
    rows = src.table(spark, d, "part").select("p_partkey", "p_brand")
    receipt = receipts.publish_inventory(rows, path, "p_partkey", "p_brand")
    return spark.read.schema(rows.schema).option("header", True).csv(f"{path}/rows").withColumn("digest", F.lit(receipt["digest"]))
