"""Queries over calendar, quality, joins and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import calendar as cal
from tidemark.operators import joins, quality, tables
from tidemark.operators import windows as win
from tidemark.plans.base_sql import with_frames
from tidemark.plans.registry import query, rounded
from tidemark.sources import frames as src

# calendar


@query("cal_05_market_holidays", "", with_frames("holidays", ", y AS (SELECT DISTINCT year(l_shipdate) AS y FROM lineitem UNION SELECT DISTINCT year(o_orderdate) FROM orders) SELECT date, holiday FROM holidays WHERE year(date) IN (SELECT y FROM y)"))
def _(spark, d):
    """The holidays of the years that the tables have."""
    years = src.table(spark, d, "lineitem").select(F.year("l_shipdate").alias("y")).union(src.table(spark, d, "orders").select(F.year("o_orderdate").alias("y"))).distinct()
    return cal.market_holidays(spark, 1990, 2030).withColumn("y", F.year("date")).join(years, "y", "left_semi").select("date", "holiday")


@query("cal_07_trading_days", "sessions", "SELECT date, session_no FROM sessions")
def _(spark, d):
    return src.sessions_of(spark, src.bars(spark, d))


@query(
    "cal_08_nth_session_after",
    "sessions",
    """, days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT d.date, (SELECT min(x.date) FROM sessions x WHERE x.session_no = (SELECT count(*) FROM sessions y WHERE y.date <= d.date) + 3) AS target FROM days d""",
)
def _(spark, d):
    days = src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return cal.nth_session_after(days, src.sessions_of(spark, src.bars(spark, d)), 3).select("date", "target")


@query("cal_09_neighbours", "sessions", "SELECT date, lag(date) OVER (ORDER BY date) AS previous, lead(date) OVER (ORDER BY date) AS next FROM sessions")
def _(spark, d):
    return cal.neighbours(src.sessions_of(spark, src.bars(spark, d)))


for _cadence, _period in (("monthly", "year(date) * 12 + month(date)"), ("weekly", "isoyear(date) * 100 + weekofyear(date)")):

    @query(f"cal_11_decisions_{_cadence}", "sessions", f"SELECT date, session_no, coalesce({_period} <> lag({_period}) OVER (ORDER BY date), false) AS decides FROM sessions")
    def _(spark, d, cadence=_cadence):
        return cal.decision_sessions(src.sessions_of(spark, src.bars(spark, d)), cadence)


@query("cal_13_missed_sessions", "sessions", "SELECT s.date FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE CAST(o.o_orderdate AS DATE) = s.date AND o.o_orderpriority = '1-URGENT')")
def _(spark, d):
    done = src.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("date")).distinct()
    return src.sessions_of(spark, src.bars(spark, d)).join(done, "date", "left_anti").select("date")


# sources


@query("src_04_bars", "bars", "SELECT ticker, date, open, high, low, close, volume FROM bars")
def _(spark, d):
    return src.bars(spark, d)


@query("src_02_cache_key", "bars", "SELECT array_to_string(list_sort(list(DISTINCT ticker)), '-') AS key FROM bars")
def _(spark, d):
    return tables.cache_key(src.bars(spark, d))


@query("src_31_distinct_tickers", "bars", "SELECT DISTINCT ticker FROM bars")
def _(spark, d):
    return src.bars(spark, d).select("ticker").distinct()


@query("src_29_json_events", "", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return tables.json_events(src.table(spark, d, "events"), "props", "k bigint").select("event_id", "k")


@query("src_28_money", "", "SELECT c_custkey, round(c_acctbal, 2) AS amount FROM customer")
def _(spark, d):
    text = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("($"), F.format_number(-F.col("c_acctbal"), 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number("c_acctbal", 2)))
    told = src.table(spark, d, "customer").select("c_custkey", text.alias("text"))
    number = F.regexp_replace("text", r"[$,()]", "").try_cast("double")
    return rounded(told.select("c_custkey", F.when(F.col("text").startswith("("), -number).otherwise(number).alias("amount")), 2)


@query("src_32_large_moves", "returns", "SELECT ticker, date, round(r, 6) AS r FROM returns WHERE abs(r) > 0.25")
def _(spark, d):
    p = win.panel_log_returns(src.panel(spark, src.bars(spark, d)))
    return rounded(p.where(F.abs("log_return") > 0.25).select("ticker", "date", F.col("log_return").alias("r")))


# quality

_GAPS = "SELECT t.ticker, s.date FROM (SELECT ticker, min(date) AS a, max(date) AS b FROM bars GROUP BY 1) t JOIN sessions s ON s.date BETWEEN t.a AND t.b WHERE NOT EXISTS (SELECT 1 FROM bars x WHERE x.ticker = t.ticker AND x.date = s.date)"


@query(
    "dq_01_bar_violations",
    "sessions",
    f"""SELECT ticker, date, 'is_session' AS rule FROM bars WHERE date NOT IN (SELECT date FROM sessions)
UNION ALL SELECT ticker, date, 'high_is_highest' FROM bars WHERE high < greatest(open, close, low) UNION ALL SELECT ticker, date, 'low_is_lowest' FROM bars WHERE low > least(open, close, high)
UNION ALL SELECT ticker, date, 'volume_not_negative' FROM bars WHERE volume < 0 UNION ALL SELECT ticker, date, 'no_gap' AS rule FROM ({_GAPS})""",
)
def _(spark, d):
    b = src.bars(spark, d)
    return quality.bar_violations(b, src.sessions_of(spark, b))


@query("dq_02_action_violations", "actions", "SELECT a.ticker, a.date, a.kind, 'has_bar' AS rule FROM actions a WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = a.ticker AND b.date = a.date) UNION ALL SELECT ticker, date, kind, 'value_positive' FROM actions WHERE value <= 0")
def _(spark, d):
    return quality.action_violations(src.actions(spark, d), src.bars(spark, d))


@query("dq_03_split_discontinuities", "acted", "SELECT ticker, date, split, round(off, 6) AS off FROM (SELECT *, abs(lag(close) OVER (PARTITION BY ticker ORDER BY date) / open / split - 1) AS off FROM acted) WHERE split <> 1 AND NOT coalesce(off <= 0.25, false)")
def _(spark, d):
    return rounded(quality.split_discontinuities(joins.actions_onto_bars(src.bars(spark, d), src.actions(spark, d))))


@query("dq_08_missing_bars", "sessions", _GAPS)
def _(spark, d):
    b = src.bars(spark, d)
    return joins.missing_sessions(b, src.sessions_of(spark, b))


@query("dq_09_sealed", "bars", "SELECT ticker, date FROM bars WHERE date > DATE '2000-12-31'")
def _(spark, d):
    return quality.sealed(src.bars(spark, d), "2000-12-31").select("ticker", "date")


@query(
    "dq_12_return_rows",
    "",
    """SELECT o_custkey AS trial, CAST(o_orderdate AS DATE) AS session, o_orderkey AS n, 'increasing' AS rule
FROM (SELECT *, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE before IS NOT NULL AND CAST(o_orderdate AS DATE) <= before""",
)
def _(spark, d):
    rows = src.table(spark, d, "orders").select(F.col("o_custkey").alias("trial"), F.to_date("o_orderdate").alias("session"), F.col("o_orderkey").alias("n"), F.col("o_totalprice").alias("r"))
    return quality.return_row_violations(rows)


@query("dq_13_panel_weights", "", "SELECT CAST(l_shipdate AS DATE) AS date, 'gross_cap' AS rule FROM lineitem GROUP BY 1 HAVING sum(CAST(round(l_discount * 100) AS BIGINT)) > 100")
def _(spark, d):
    w = src.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), (F.round(F.col("l_discount") * 100) / 100).alias("weight"))
    return quality.panel_violations(w)


@query(
    "dq_18_research_eligibility",
    "bars",
    """, past AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars WHERE date <= DATE '2000-06-30'),
per AS (SELECT ticker, count(*) AS n, max(close) FILTER (WHERE n = 1) AS last_close, quantile_cont(close * volume, 0.5) FILTER (WHERE n <= 20) AS median_dollars FROM past GROUP BY 1)
SELECT ticker, n::BIGINT AS n, last_close, round(median_dollars, 4) AS median_dollars,
  concat_ws(',', CASE WHEN n < 252 THEN 'insufficient_history' END, CASE WHEN last_close < 1000 THEN 'price_below_floor' END, CASE WHEN median_dollars < 60000 THEN 'illiquid' END) AS reasons FROM per""",
)
def _(spark, d):
    return rounded(quality.research_eligibility(src.bars(spark, d), as_of="2000-06-30", floor=1000.0, liquidity=60_000.0), 15, median_dollars=4)


@query(
    "dq_22_rule_chain",
    "",
    """SELECT p_partkey, CASE WHEN p_size < 5 THEN 'not_flagged' WHEN regexp_matches(p_name, '(?i)\\btest\\b') THEN 'test_issue' WHEN p_retailprice < 950 THEN 'below_floor'
  WHEN contains(p_type, 'PROMO') THEN 'excluded_type' END AS reason FROM part""",
)
def _(spark, d):
    return quality.part_screen(src.table(spark, d, "part")).select("p_partkey", "reason")


# joins


@query("join_01_actions_onto_bars", "acted", "SELECT ticker, date, split, round(dividend, 4) AS dividend, has_action FROM acted")
def _(spark, d):
    return rounded(joins.actions_onto_bars(src.bars(spark, d), src.actions(spark, d)).select("ticker", "date", "split", "dividend", "has_action"), 4)


@query(
    "join_03_reconcile",
    "second_source",
    """SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.date, b.date) AS date,
  CASE WHEN NOT coalesce(a.date, b.date) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN 'unreconciled' WHEN a.close IS NULL OR b.close IS NULL THEN 'mismatch' WHEN abs(a.close - b.close) <= 1e-4 + 1e-12 THEN 'reconciled' ELSE 'mismatch' END AS status,
  CASE WHEN NOT coalesce(a.date, b.date) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN 'outside coverage' WHEN a.close IS NULL THEN 'second source only' WHEN b.close IS NULL THEN 'primary only' WHEN abs(a.close - b.close) <= 1e-4 + 1e-12 THEN NULL ELSE 'amount outside tolerance' END AS reason
FROM bars a FULL JOIN second_source b ON a.ticker = b.ticker AND a.date = b.date""",
)
def _(spark, d):
    b = src.bars(spark, d)
    value = lambda x: x.select("ticker", "date", F.col("close").alias("value"))
    covered = F.col("date").between(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
    return joins.reconcile(value(b), value(src.second_source(b)), covered, 1e-4).select("ticker", "date", "status", "reason")


_OFF = "FROM bars a FULL JOIN second_source b ON a.ticker = b.ticker AND a.date = b.date WHERE a.close IS NULL OR b.close IS NULL OR abs(b.close / a.close - 1) * 10000 > 10"


@query("join_05_close_mismatches", "second_source", f"SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.date, b.date) AS date, a.close AS mine, b.close AS theirs {_OFF}")
def _(spark, d):
    b = src.bars(spark, d)
    return joins.close_mismatches(b, src.second_source(b), 10.0)


@query("join_04_cross_check", "second_source", f"SELECT coalesce(a.ticker, b.ticker) AS ticker, count(*)::BIGINT AS n, min(coalesce(a.date, b.date)) AS first_date {_OFF} GROUP BY 1")
def _(spark, d):
    b = src.bars(spark, d)
    return joins.cross_check(b, src.second_source(b), 10.0)


@query("join_06_latest_as_of", "vintages", "SELECT series, date, realtime_start, realtime_end, round(value, 2) AS value FROM vintages WHERE realtime_start <= DATE '1999-06-15' QUALIFY row_number() OVER (PARTITION BY series, date ORDER BY realtime_start DESC) = 1")
def _(spark, d):
    return rounded(joins.latest_as_of(src.vintages(spark, d), ["series", "date"], "realtime_start", F.lit("1999-06-15").cast("date")).select("series", "date", "realtime_start", "realtime_end", "value"), 2)


@query("join_08_vintage", "vintages", "SELECT series, date, round(value, 2) AS value FROM vintages WHERE DATE '1998-03-09' BETWEEN realtime_start AND realtime_end")
def _(spark, d):
    return rounded(joins.vintage(src.vintages(spark, d), F.lit("1998-03-09").cast("date")).select("series", "date", "value"), 2)


@query(
    "join_09_vintage_as_of",
    "sessions vintages",
    """, best AS (SELECT v.series, s.date AS session, arg_max(v.value, {'a': v.date, 'b': v.realtime_start}) AS value FROM sessions s JOIN vintages v
  ON v.date <= s.date - 1 AND s.date - 1 BETWEEN v.realtime_start AND v.realtime_end GROUP BY 1, 2)
SELECT g.series, g.session, round(b.value, 2) AS value FROM (SELECT DISTINCT v.series, s.date AS session FROM vintages v, sessions s) g LEFT JOIN best b ON b.series = g.series AND b.session = g.session""",
)
def _(spark, d):
    return rounded(joins.vintage_as_of(src.vintages(spark, d), src.sessions_of(spark, src.bars(spark, d))), 2)


@query("join_10_as_of", "bars", """, b AS (SELECT ticker AS k, date AS t, close FROM bars WHERE day(date) % 3 = 0), l AS (SELECT DISTINCT ticker AS k, date AS t FROM bars)
SELECT l.k, l.t, b.close FROM l ASOF LEFT JOIN b ON l.k = b.k AND l.t >= b.t""")
def _(spark, d):
    b = src.bars(spark, d).select(F.col("ticker").alias("k"), F.col("date").alias("t"), "close")
    return joins.as_of_join(b.select("k", "t"), b.where(F.dayofmonth("t") % 3 == 0), "k", "t", "close")


@query(
    "join_11_bitemporal",
    "facts",
    """SELECT instrument_id, field, arg_max(value, {'a': effective_date, 'b': observed_at, 'c': o_orderkey}) AS value, max(effective_date) AS effective_date
FROM facts WHERE effective_date <= DATE '1999-01-15' AND observed_at < TIMESTAMP '1999-01-16' GROUP BY 1, 2""",
)
def _(spark, d):
    return joins.bitemporal_snapshot(src.facts(spark, d), F.lit("1999-01-15").cast("date"))


@query(
    "join_16_return_matrix",
    "returns",
    """, r AS (SELECT ticker AS trial, date AS session, r FROM returns WHERE r IS NOT NULL),
shared AS (SELECT session FROM r GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT trial) FROM r)), per AS (SELECT trial, count(*) AS n FROM r GROUP BY 1)
SELECT r.trial, r.session, round(r.r, 6) AS r, round((SELECT count(*) FROM shared) / per.n, 6) AS coverage, (SELECT count(*) FROM shared) / per.n >= 0.1 AS enough FROM r JOIN shared USING (session) JOIN per USING (trial)""",
)
def _(spark, d):
    r = win.panel_log_returns(src.panel(spark, src.bars(spark, d))).where("log_return is not null")
    return rounded(joins.return_matrix(r.select(F.col("ticker").alias("trial"), F.col("date").alias("session"), F.col("log_return").alias("r")), 0.1))


@query("join_16_return_matrix_whole")
def _(spark, d):
    r = win.panel_log_returns(src.panel(spark, src.bars(spark, d))).where("log_return is not null")
    return rounded(joins.return_matrix(r.select(F.col("ticker").alias("trial"), F.col("date").alias("session"), F.col("log_return").alias("r")), 0.1))


@query("join_19_exposure", "", "SELECT l_suppkey::VARCHAR AS ticker, sum(l_quantity) - coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS external, false AS refused FROM lineitem GROUP BY 1")
def _(spark, d):
    held = src.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_quantity").alias("quantity"), "l_returnflag")
    return joins.exposure(held, held.where("l_returnflag = 'R'"))


@query("join_21_open_intents", "", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def _(spark, d):
    from tidemark.operators.ledger import open_intents

    return open_intents(src.table(spark, d, "orders"), src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


# sets

_A, _B = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT'", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_returnflag = 'R'"
for _name, _op in (("set_01_union", "UNION"), ("set_03_intersect", "INTERSECT"), ("set_05_difference", "EXCEPT")):

    @query(_name, "", f"{_A} {_op} {_B}")
    def _(spark, d, op=_op):
        a = src.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("date")).distinct()
        b = src.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.to_date("l_shipdate").alias("date")).distinct()
        return {"UNION": a.union(b).distinct(), "INTERSECT": a.intersect(b), "EXCEPT": a.join(b, "date", "left_anti")}[op]


# windows

_W = "PARTITION BY ticker ORDER BY date"
_roll = lambda f, x, n: f"CASE WHEN count({x}) OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN {f}({x}) OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
_LR = f"CASE WHEN close > 0 AND lag(close) OVER ({_W}) > 0 THEN ln(close / lag(close) OVER ({_W})) END"
_FWD = lambda h: f"ln(lead(open, {h + 1}) OVER ({_W}) / lead(open) OVER ({_W}))"
_SMA = f""", a AS (SELECT *, {_roll("avg", "close", 10)} AS s, {_roll("avg", "close", 30)} AS l FROM bars),
b AS (SELECT *, coalesce(s > l AND lag(s) OVER ({_W}) <= lag(l) OVER ({_W}), false) AS up, coalesce(s < l AND lag(s) OVER ({_W}) >= lag(l) OVER ({_W}), false) AS down FROM a),
sig AS (SELECT *, coalesce(lag(up) OVER ({_W}), false) AS buy_next_open, coalesce(lag(down) OVER ({_W}), false) AS sell_next_open FROM b)"""


@query("win_01_sma_crossover", "bars", _SMA + " SELECT ticker, date, round(s / l, 6) AS sma_ratio, buy_next_open, sell_next_open FROM sig")
def win_01(spark, d):
    return rounded(win.sma_crossover(src.bars(spark, d)).select("ticker", "date", (F.col("short_sma") / F.col("long_sma")).alias("sma_ratio"), "buy_next_open", "sell_next_open"))


@query(
    "win_02_features",
    "bars",
    f""", a AS (SELECT *, {_LR} AS lr, {_roll("avg", "close", 10)} AS s, {_roll("avg", "close", 30)} AS l, {_roll("avg", "volume", 20)} AS v, {_FWD(5)} AS label FROM bars),
f AS (SELECT *, {_roll("stddev_samp", "lr", 20)} AS vol, s / l - 1 AS spread, close / s - 1 AS cts, volume / v AS rv FROM a)
SELECT ticker, date, round(lr, 6) AS log_return, round(vol, 6) AS volatility, round(spread, 6) AS sma_spread, round(cts, 6) AS close_to_short, round(rv, 6) AS relative_volume, round(label, 6) AS label,
  lr IS NOT NULL AND vol IS NOT NULL AND spread IS NOT NULL AND cts IS NOT NULL AND rv IS NOT NULL AS inference_eligible,
  lr IS NOT NULL AND vol IS NOT NULL AND spread IS NOT NULL AND cts IS NOT NULL AND rv IS NOT NULL AND label IS NOT NULL AS train_eligible FROM f""",
)
def win_02(spark, d):
    return rounded(win.features(src.bars(spark, d)).drop("open", "high", "low", "close", "volume"))


@query("win_04_direction_label", "bars", f"SELECT ticker, date, CASE WHEN {_FWD(5)} > 0 THEN 1 WHEN {_FWD(5)} <= 0 THEN 0 END AS label FROM bars")
def _(spark, d):
    return win.direction_label(src.bars(spark, d)).select("ticker", "date", "label")


@query("win_05_forward_return", "acted", f"SELECT ticker, date, CASE WHEN coalesce(max(has_action::INT) OVER ({_W} ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING), 0) = 0 THEN round({_FWD(5)}, 6) END AS label FROM acted")
def _(spark, d):
    return rounded(win.forward_return_label(joins.actions_onto_bars(src.bars(spark, d), src.actions(spark, d))).select("ticker", "date", "label"))


@query("win_07_panel_log_returns", "returns", "SELECT ticker, date, round(r, 6) AS log_return FROM returns")
def _(spark, d):
    return rounded(win.panel_log_returns(src.panel(spark, src.bars(spark, d))).select("ticker", "date", "log_return"))


@query("win_08_realized_volatility", "returns", f"SELECT ticker, date, round({_roll('stddev_samp', 'r', 5)} * sqrt(252), 6) AS volatility FROM returns")
def _(spark, d):
    return rounded(win.realized_volatility(src.panel(spark, src.bars(spark, d)), 5).select("ticker", "date", "volatility"))


@query(
    "win_09_ewma_volatility",
    "returns",
    f""", a AS (SELECT *, CASE WHEN r IS NOT NULL THEN exp((row_number() OVER ({_W}) - 1) * -ln(1 - 2.0::DOUBLE / 61)) END AS w FROM returns),
b AS (SELECT *, sum(w) OVER ({_W}) AS s0, sum(w * w) OVER ({_W}) AS s2, sum(w * r) OVER ({_W}) AS s1, sum(w * r * r) OVER ({_W}) AS q, count(r) OVER ({_W}) AS n FROM a)
SELECT ticker, date, CASE WHEN n >= 60 THEN round(sqrt(greatest(q / s0 - (s1 / s0) * (s1 / s0), 0) * s0 * s0 / (s0 * s0 - s2)) * sqrt(252), 6) END AS volatility FROM b""",
)
def _(spark, d):
    return rounded(win.ewma_volatility(src.panel(spark, src.bars(spark, d)), 60).select("ticker", "date", "volatility"))


@query(
    "win_11_trailing_correlation",
    "returns",
    """, p AS (SELECT a.session_no, a.date, a.ticker AS a, b.ticker AS b, a.r AS x, b.r AS y FROM returns a JOIN returns b ON a.session_no = b.session_no AND a.ticker < b.ticker),
m AS (SELECT date, a, b, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) OVER w AS n, corr(x, y) OVER w AS c FROM p WINDOW w AS (PARTITION BY a, b ORDER BY session_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT date, a, b, CASE WHEN n = 10 THEN round(c, 5) END AS correlation FROM m""",
)
def _(spark, d):
    return rounded(win.trailing_correlation(src.panel(spark, src.bars(spark, d)), 10), 5)


@query(
    "win_16_research_close",
    "acted",
    f""", g AS (SELECT *, CASE WHEN lag(close) OVER ({_W}) IS NULL THEN 0.0::DOUBLE ELSE ln(split * (close + dividend) / lag(close) OVER ({_W})) END AS g FROM acted)
SELECT ticker, date, round(ln(first_value(close) OVER ({_W})) + sum(g) OVER ({_W}), 5) AS log_research_close, round(volume / exp(sum(ln(split)) OVER ({_W})), 5) AS research_volume FROM g""",
)
def _(spark, d):
    return rounded(win.research_close(joins.actions_onto_bars(src.bars(spark, d), src.actions(spark, d))).select("ticker", "date", "log_research_close", "research_volume"), 5)


@query(
    "win_20_back_adjusted",
    "acted",
    f""", f AS (SELECT *, CASE WHEN lag(close) OVER ({_W}) IS NULL THEN 0.0::DOUBLE ELSE ln(lag(close) OVER ({_W}) / (split * (lag(close) OVER ({_W}) - dividend / split))) END AS f FROM acted)
SELECT ticker, date, round(ln(close) - coalesce(sum(f) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 5) AS log_adjusted_close FROM f""",
)
def _(spark, d):
    return rounded(win.back_adjusted(joins.actions_onto_bars(src.bars(spark, d), src.actions(spark, d))).select("ticker", "date", "log_adjusted_close"), 5)


@query("win_17_equity_log_returns", "equity", "SELECT account, session, CASE WHEN e > 0 AND b > 0 THEN round(ln(e / b), 6) END AS log_return FROM (SELECT account, session, equity AS e, coalesce(lag(equity) OVER (PARTITION BY account ORDER BY session), 50000000) AS b FROM equity)")
def _(spark, d):
    return rounded(win.equity_log_returns(src.equity(spark, d), 50_000_000.0).select("account", "session", "log_return"))


@query("win_18_daily_log_returns", "bars", f"SELECT ticker, date, round({_LR}, 6) AS log_return FROM bars QUALIFY row_number() OVER ({_W}) > 1")
def _(spark, d):
    return rounded(win.daily_log_returns(src.bars(spark, d)).select("ticker", "date", "log_return"))


@query("win_19_growth_index", "bars", f"SELECT ticker, date, round(sum(x) OVER ({_W}), 5) AS log_growth FROM (SELECT ticker, date, coalesce({_LR}, 0) AS x FROM bars)")
def _(spark, d):
    return rounded(win.growth_index(src.bars(spark, d)).select("ticker", "date", "log_growth"), 5)


@query("win_21_allocation_eligibility", "panel", f"SELECT ticker, date, close IS NOT NULL AND count(close) OVER ({_W}) >= 61 AS held FROM panel")
def _(spark, d):
    return win.allocation_eligibility(src.panel(spark, src.bars(spark, d))).select("ticker", "date", "held")


_MON = f""", t AS (SELECT ticker, date, close, {_roll("avg", "close", 10)} > {_roll("avg", "close", 30)} AS trend, ln(lead(close) OVER ({_W}) / close) AS nr FROM bars),
h AS (SELECT *, CASE WHEN trend IS NOT NULL THEN ((nr > 0) = trend)::INT END AS hit FROM t)"""


@query("win_22_trend_monitor", "bars", _MON + f" SELECT ticker, date, trend, round(nr, 6) AS next_return, hit, round({_roll('avg', 'hit', 63)}, 6) AS hit_rate FROM h")
def _(spark, d):
    return rounded(win.trend_monitor(src.bars(spark, d)).select("ticker", "date", "trend", "next_return", "hit", "hit_rate"))


@query("win_23_decay_table", "bars", _MON + " SELECT ticker, count(*)::BIGINT AS n, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS hit_rate FROM (SELECT * FROM h WHERE hit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 63) GROUP BY 1")
def _(spark, d):
    return rounded(win.decay_table(src.bars(spark, d)))


@query("win_24_trend_confidence", "bars", f"SELECT ticker, date, ({_roll('avg', 'close', 10)} > {_roll('avg', 'close', 30)})::INT::DOUBLE AS confidence FROM bars")
def _(spark, d):
    return win.trend_confidence(src.bars(spark, d)).select("ticker", "date", "confidence")


@query("win_26_marks", "panel", f"SELECT ticker, date, last_value(close IGNORE NULLS) OVER ({_W}) AS mark FROM panel")
def _(spark, d):
    return win.marks(src.panel(spark, src.bars(spark, d))).select("ticker", "date", "mark")


def _surface_sql() -> str:
    mean = lambda x: f"avg({x}) OVER v"

    def mixture(pulled: str, one: str, two: str, other: str) -> tuple[str, str]:
        own = [f"r1 * {one}", f"tau * {one}", f"{other} * {two}", f"tau * {two}"]
        parts = ["(-4 / mpo)", "(4 / mpo * m1 / mtau)", "(-4 / mpc)", f"(4 / mpc * m{pulled} / mtau)"]
        names = [f"{one}{two}{i}" for i in range(4)]
        first = " + ".join(f"{p} * a{n}" for p, n in zip(parts, names))
        square = " + ".join(f"{1 if i == j else 2} * {parts[i]} * {parts[j]} * s{one}{two}{i}{j}" for i in range(4) for j in range(i, 4))
        columns.extend(f"{mean(x)} AS a{n}" for x, n in zip(own, names))
        columns.extend(f"{mean(f'{own[i]} * {own[j]}')} AS s{one}{two}{i}{j}" for i in range(4) for j in range(i, 4))
        return first, square

    columns: list[str] = []
    (e1, q1), (e2, q2) = mixture("3", "r2", "r4", "r3"), mixture("5", "r5", "r4", "r5")
    return f""", g AS (SELECT *, ln(open) AS o, ln(high) AS h, ln(low) AS l, ln(close) AS c, lag(ln(high)) OVER ({_W}) AS h1, lag(ln(low)) OVER ({_W}) AS l1, lag(ln(close)) OVER ({_W}) AS c1, {_LR} AS lr,
  row_number() OVER ({_W}) AS n, session_no - lag(session_no, 21) OVER ({_W}) AS span FROM panel WHERE close IS NOT NULL),
k AS (SELECT *, (h <> l OR l <> c1)::INT::DOUBLE AS tau, (h + l) / 2 - o AS r1, o - (h1 + l1) / 2 AS r2, (h + l) / 2 - c1 AS r3, c1 - (h1 + l1) / 2 AS r4, o - c1 AS r5 FROM g),
z AS (SELECT *, tau * ((o <> h)::INT + (o <> l)::INT) AS po, tau * ((c1 <> h1)::INT + (c1 <> l1)::INT) AS pc FROM k),
m AS (SELECT ticker, date, n, span, avg(volume) OVER u AS adv, stddev_samp(lr) OVER u AS sigma, avg(tau) OVER v AS mtau, avg(po) OVER v AS mpo, avg(pc) OVER v AS mpc, avg(r1) OVER v AS m1, avg(r3) OVER v AS m3, avg(r5) OVER v AS m5, {", ".join(columns)}
  FROM z WINDOW u AS ({_W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), v AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
e AS (SELECT ticker, date, n, span, adv, sigma, mtau, mpo, mpc, {e1} AS e1, {e2} AS e2, {q1} AS q1, {q2} AS q2 FROM m),
w AS (SELECT *, CASE WHEN mtau * 20 >= 2 AND mpo <> 0 AND mpc <> 0 THEN CASE WHEN q1 - e1 * e1 + q2 - e2 * e2 > 0 THEN ((q2 - e2 * e2) * e1 + (q1 - e1 * e1) * e2) / (q1 - e1 * e1 + q2 - e2 * e2) ELSE (e1 + e2) / 2 END END AS s2 FROM e),
x AS (SELECT *, CASE WHEN n <= 21 THEN 'warmup' WHEN coalesce(span <> 21, true) THEN 'missing_session' WHEN s2 IS NULL THEN 'spread_undefined' WHEN adv <= 0 THEN 'zero_adv' END AS reason FROM w)
SELECT ticker, date, CASE WHEN reason IS NULL THEN round(sqrt(abs(s2)) / 2, 6) END AS half_spread, CASE WHEN reason IS NULL THEN round(sigma, 6) END AS sigma, CASE WHEN reason IS NULL THEN round(adv, 6) END AS adv, CASE WHEN reason IS NULL THEN s2 < 0 END AS negative, reason FROM x"""


@query("win_28_cost_surface", "panel", _surface_sql())
def _(spark, d):
    return rounded(win.cost_surface(src.panel(spark, src.bars(spark, d))))
