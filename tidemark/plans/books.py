"""Queries over orders, exposures, reports and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import orders, signals, sizing, tables
from tidemark.operators import windows as win
from tidemark.plans.registry import query, rounded
from tidemark.plans.research import _LR, _W, _roll
from tidemark.plans.strategies import _FEAT, _FILLED, _HELD, _OBS, _weekly, win_02_raw
from tidemark.sources import frames as src

_TZ = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"


def _events(spark, d):
    return src.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("cal_16_trading_day", "", f"SELECT event_id, CAST({_TZ} AS DATE) AS day FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", orders.trading_day(F.col("ts")).alias("day"))


@query(
    "cal_12_due_run",
    "holidays",
    f""", l AS (SELECT event_id, {_TZ} AS t FROM events), done AS (SELECT DISTINCT CAST({_TZ} AS DATE) AS session FROM events WHERE event_id % 97 = 0)
SELECT event_id, CAST(t AS DATE) AS session, CASE WHEN isodow(t) > 5 OR CAST(t AS DATE) IN (SELECT date FROM holidays) THEN 'not_session' WHEN CAST(t AS DATE) IN (SELECT session FROM done) THEN 'done'
  WHEN hour(t) * 60 + minute(t) < 480 THEN 'before_window' WHEN hour(t) * 60 + minute(t) >= 568 THEN 'after_cutoff' ELSE 'due' END AS decision FROM l""",
)
def _(spark, d):
    from datetime import date

    from tidemark.operators.calendar import trading_days

    runs = _events(spark, d).select("event_id", "ts")
    span = runs.agg(F.min(orders.trading_day(F.col("ts"))).alias("a"), F.max(orders.trading_day(F.col("ts"))).alias("b")).first()
    done = runs.where("event_id % 97 = 0").select(orders.trading_day(F.col("ts")).alias("session"))
    sessions = trading_days(spark, span["a"] or date(2024, 1, 1), span["b"] or date(2024, 1, 1))
    return orders.due_run(runs, sessions, done).select("event_id", "session", "decision")


@query(
    "pf_16_whole_shares",
    "panel",
    _HELD + " SELECT ticker, date, CASE WHEN close > 0 THEN floor(round(CASE WHEN held THEN 0.93::DOUBLE / sum(held::INT) OVER (PARTITION BY date) ELSE 0 END, 9) * 100000 / close)::BIGINT END AS shares FROM sel",
)
def _(spark, d):
    w = sizing.equal_weight(signals.trend(_weekly(spark, d), 100), 0.93)
    return w.select("ticker", "date", orders.whole_shares(F.round("weight", 9), F.lit(100000.0), F.col("close")).alias("shares"))


@query("pf_22_order_precision", "", "SELECT l_orderkey, l_linenumber, l_partkey, ((CAST(round(l_extendedprice * 100) AS BIGINT) * 10) // 7)::DOUBLE / 1000.0::DOUBLE AS quantity FROM lineitem")
def _(spark, d):
    x = orders.floor_to(F.col("l_extendedprice").cast("decimal(24,6)") / F.lit(7).cast("decimal(6,0)"), 3)
    return src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.cast("double").alias("quantity"))


@query(
    "top_11_order_sides",
    "",
    """, t AS""".replace(", t AS", "WITH t AS")
    + """ (SELECT CAST(o_orderdate AS DATE) AS date, c_mktsegment AS ticker, sum(o_orderkey % 7 - 3)::BIGINT AS delta FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT date, ticker, delta, CASE WHEN delta < 0 THEN 'sell' ELSE 'buy' END AS side, row_number() OVER (PARTITION BY date ORDER BY (delta > 0)::INT, ticker)::INT AS place FROM t WHERE delta <> 0""",
)
def _(spark, d):
    o = src.table(spark, d, "orders").join(src.table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    t = o.groupBy(F.to_date("o_orderdate").alias("date"), F.col("c_mktsegment").alias("ticker")).agg(F.sum(F.col("o_orderkey") % 7 - 3).alias("target"))
    return orders.order_sides(t.withColumn("held", F.lit(0).cast("long"))).select("date", "ticker", "delta", "side", "place")


@query(
    "pf_18_bound_buys",
    "",
    """WITH RECURSIVE b AS (SELECT o_custkey::VARCHAR AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS place, o_orderkey::VARCHAR AS ticker, (o_orderkey % 50 + 5)::BIGINT AS price, (o_orderkey % 13 + 1)::BIGINT AS quantity FROM orders),
q AS (SELECT run, 0 AS place, ''::VARCHAR AS ticker, 400::BIGINT AS cap, 600::BIGINT AS cash, NULL::BIGINT AS got, NULL::BIGINT AS notional, ''::VARCHAR AS reason FROM (SELECT DISTINCT run FROM b)
  UNION ALL SELECT run, place, ticker, cap - coalesce(notional, 0), cash - coalesce(notional, 0), CASE WHEN reason IS NULL THEN qty END, notional, reason FROM (
    SELECT *, CASE WHEN reason IS NULL THEN qty * price END AS notional FROM (
      SELECT *, CASE WHEN cap <= 0 THEN 'daily_cap' WHEN qty <= 0 THEN CASE WHEN quantity * price <= spend THEN 'below_one_share' WHEN cash < cap THEN 'insufficient_settled_cash' ELSE 'budget_exhausted' END WHEN qty * price < 30 THEN 'below_minimum' END AS reason FROM (
        SELECT b.run, b.place, b.ticker, b.price, b.quantity, q.cap, q.cash, least(q.cap, q.cash) AS spend, CASE WHEN least(q.cap, q.cash) > 0 THEN least(b.quantity, least(q.cap, q.cash) // b.price) ELSE 0 END AS qty FROM q JOIN b ON b.run = q.run AND b.place = q.place + 1))))
SELECT run, place, ticker, got::DOUBLE AS quantity, notional::DOUBLE AS notional, reason FROM q WHERE place > 0""",
)
def bound(spark, d):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    buys = src.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("run"), place.alias("place"), k.cast("string").alias("ticker"), (k % 50 + 5).cast("double").alias("price"), (k % 13 + 1).cast("double").alias("quantity"))
    return orders.bound_buys(buys, cash=600.0, cap=400.0, minimum=30.0)


@query("join_20_concentration", "", "SELECT l_suppkey::VARCHAR AS ticker, round(sum(l_quantity * round(l_tax * 100)), 4) AS exposure, 'concentration' AS reason FROM lineitem GROUP BY 1 HAVING sum(l_quantity * round(l_tax * 100)) > 200000 * 0.25::DOUBLE")
def _(spark, d):
    held = src.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_quantity").alias("quantity"), F.round(F.col("l_tax") * 100).alias("price"))
    return rounded(orders.concentration(held, 200_000.0, 0.25), 4)


@query("agg_08_cash_months", "panel", _HELD + " SELECT date FROM sel GROUP BY 1 HAVING max(held::INT) = 0 AND count(close) > 0")
def _(spark, d):
    book = sizing.equal_weight(signals.trend(_weekly(spark, d), 100), 0.93)
    return orders.cash_months(book.withColumn("required", F.col("close").isNotNull()))


_MON2 = f""", t AS (SELECT ticker, date, close, {_roll("avg", "close", 10)} > {_roll("avg", "close", 30)} AS trend, ln(lead(close) OVER ({_W}) / close) AS nr FROM bars),
h AS (SELECT ticker, count(*) AS n, sum(((nr > 0) = trend)::INT)::BIGINT AS hits FROM (SELECT * FROM t WHERE trend IS NOT NULL AND nr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 63) GROUP BY 1)"""


@query(
    "agg_31_binomial_p",
    "bars",
    _MON2
    + """ SELECT ticker, n::BIGINT AS n, hits::BIGINT AS hits, round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(0, least(hits, n - hits) + 1) AS r(i))), 6) AS p FROM h""",
)
def _(spark, d):
    t = win.decay_table(src.bars(spark, d))
    return rounded(t.select("ticker", "n", "hits", orders.binomial_p(F.col("hits"), F.col("n")).alias("p")))


_COLS = ["log_return", "close_to_short", "label"]


@query("agg_25_worst_pair", "bars", _FEAT + " SELECT a, b, round(abs(c), 6) AS size FROM (SELECT 'log_return' AS a, 'close_to_short' AS b, corr(lr, cts) AS c FROM known UNION ALL SELECT 'log_return', 'label', corr(lr, label) FROM known UNION ALL SELECT 'close_to_short', 'label', corr(cts, label) FROM known) ORDER BY abs(c) DESC LIMIT 1")
def _(spark, d):
    return rounded(orders.worst_pair(agg.correlations(win_02_raw(spark, d), _COLS), _COLS))


@query(
    "agg_23_collinearity",
    "bars",
    _FEAT
    + """, c AS (SELECT corr(lr, cts) AS x FROM known) SELECT 'log_return' AS "column", round(1 / (1 - x * x), 5) AS vif, round(sqrt((1 + abs(x)) / (1 - abs(x))), 5) AS condition_number FROM c
UNION ALL SELECT 'close_to_short', round(1 / (1 - x * x), 5), round(sqrt((1 + abs(x)) / (1 - abs(x))), 5) FROM c""",
)
def _(spark, d):
    known = win_02_raw(spark, d).dropna(subset=_COLS)
    return rounded(orders.collinearity(agg.correlations(known, _COLS[:2]), _COLS[:2]), 5)


@query("agg_15_family_counts", "", "SELECT p_brand AS family, count(*)::BIGINT AS candidates, (CASE WHEN count(*) > 80 THEN 16777319 ELSE count(*) END)::BIGINT AS n_current FROM part GROUP BY 1")
def _(spark, d):
    return orders.family_counts(src.table(spark, d, "part").select(F.col("p_brand").alias("family")), 80, 16_777_319)


@query("agg_16_backfill_bound", "", "SELECT p_brand AS family, (2 * pow(2, ceil(log2(sum(greatest(p_size * 2, 30, p_partkey % 40))))))::BIGINT AS bound FROM part GROUP BY 1")
def _(spark, d):
    p = src.table(spark, d, "part")
    return p.groupBy(F.col("p_brand").alias("family")).agg(orders.backfill_bound(F.col("p_size").cast("long"), F.lit(2), F.lit(30), F.col("p_partkey") % 40).alias("bound"))


@query(
    "pf_03_correlation_adjusted",
    "panel",
    _FILLED
    + f""", fr AS (SELECT *, {_LR} AS r FROM filled), w AS (SELECT date, ticker, CASE WHEN {_OBS(61)} THEN 0.1::DOUBLE ELSE 0 END AS weight FROM filled),
pr AS (SELECT a.session_no, a.date, a.ticker AS a, b.ticker AS b, a.r AS x, b.r AS y FROM fr a JOIN fr b ON a.session_no = b.session_no AND a.ticker < b.ticker),
cc AS (SELECT date, a, b, CASE WHEN count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) OVER v = 60 AND NOT isnan(corr(x, y) OVER v) THEN round(corr(x, y) OVER v, 8) END AS c FROM pr WINDOW v AS (PARTITION BY a, b ORDER BY session_no ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
sd AS (SELECT date, a AS ticker, b AS other, c FROM cc UNION ALL SELECT date, b, a, c FROM cc), kk AS (SELECT date, count(*) AS k FROM w WHERE weight > 0 GROUP BY 1),
ov AS (SELECT s.date, s.ticker, sum(greatest(c, 0)) AS s, count(c) AS n FROM sd s JOIN w p ON p.date = s.date AND p.ticker = s.ticker AND p.weight > 0 JOIN w q ON q.date = s.date AND q.ticker = s.other AND q.weight > 0 GROUP BY 1, 2)
SELECT w.date, w.ticker, CASE WHEN w.weight > 0 THEN CASE WHEN coalesce(ov.n, 0) = kk.k - 1 THEN round(w.weight / (1 + coalesce(ov.s, 0)), 6) END ELSE 0 END AS adjusted FROM w LEFT JOIN kk USING (date) LEFT JOIN ov ON ov.date = w.date AND ov.ticker = w.ticker""",
)
def _(spark, d):
    return _correlation_adjusted(_weekly(spark, d))


def _correlation_adjusted(panel):
    weights = signals.risk_parity(panel).select("date", "ticker", F.when(F.col("held"), 0.1).otherwise(0.0).alias("weight"))
    correlation = win.trailing_correlation(panel, 60).withColumn("correlation", F.round("correlation", 8))
    return rounded(sizing.correlation_adjusted(weights, correlation).select("date", "ticker", "adjusted"))


@query("pf_03_correlation_adjusted_whole")
def _(spark, d):
    return _correlation_adjusted(_weekly(spark, d))


@query("pf_13_buffered_weights", "panel", f", {'decisions AS (SELECT date, coalesce(year(date) * 12 + month(date) <> lag(year(date) * 12 + month(date)) OVER (ORDER BY date), false) AS decides FROM sessions)'}, h AS (SELECT p.ticker, p.date, d.decides, p.close IS NOT NULL AND count(p.close) OVER (PARTITION BY p.ticker ORDER BY p.date) >= 61 AS held FROM panel p JOIN decisions d USING (date)) SELECT ticker, date, round(CASE WHEN held THEN 0.93::DOUBLE / sum(held::INT) OVER (PARTITION BY date) ELSE 0 END, 6) AS weight FROM h WHERE decides")
def _(spark, d):
    from tidemark.operators.calendar import decision_sessions

    p = src.panel(spark, src.bars(spark, d))
    decisions = decision_sessions(src.sessions_of(spark, src.bars(spark, d)), "monthly").where("decides").select("date")
    book = sizing.equal_weight(win.allocation_eligibility(p).join(F.broadcast(decisions), "date"), 0.93)
    return rounded(book.select("ticker", "date", "weight"))


@query("st_14_open_intents_by_segment", "", "SELECT c_mktsegment, count(*)::BIGINT AS open FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1")
def _(spark, d):
    from tidemark.operators.ledger import open_intents

    o = open_intents(src.table(spark, d, "orders"), src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return o.join(src.table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("open"))


@query("st_18_deterministic_id", "", "SELECT o_orderkey, sha256(concat_ws('|', o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus)) AS id FROM orders")
def _(spark, d):
    return src.table(spark, d, "orders").select("o_orderkey", tables.order_id(F.col("o_orderpriority"), F.to_date("o_orderdate"), F.col("o_custkey"), F.col("o_orderstatus")).alias("id"))
