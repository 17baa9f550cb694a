"""Queries over account replays, evidence, documents compared by path, and the signals built on others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import accounts, joins, ledger, signals, sizing
from tidemark.operators import calendar as cal
from tidemark.operators import windows as win
from tidemark.plans import books  # noqa: F401  (SQL here is built on its SQL)
from tidemark.plans.base_sql import with_frames
from tidemark.plans.evidence import _CLS
from tidemark.plans.registry import ORACLE_SQL, QUERIES, query, rounded
from tidemark.plans.research import _SMA, _W
from tidemark.plans.strategies import _DECIDES, _FILLED, _HELD, _OBS, _POS, _RUN, _VOL, _crossings, _panel, _positions, _returns, _weekly
from tidemark.sources import frames as src

# accounts and evidence


@query("agg_11_exposure_by_ticker", "", "SELECT l_partkey AS ticker, sum(l_quantity) AS quantity, round(sum(l_quantity) * any_value(p.price), 4) AS exposure FROM lineitem LEFT JOIN (SELECT p_partkey, p_retailprice AS price FROM part WHERE p_partkey % 7 <> 0) p ON p_partkey = l_partkey GROUP BY 1")
def _(spark, d):
    held = src.table(spark, d, "lineitem").select(F.col("l_partkey").alias("ticker"), F.col("l_quantity").alias("quantity"))
    prices = src.table(spark, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("ticker"), F.col("p_retailprice").alias("price"))
    return rounded(accounts.exposure_by_ticker(held, prices), 4)


@query("agg_37_account_fold", "", "SELECT o_custkey % 20 AS account, CAST(o_orderdate AS DATE) AS date, max(o_orderkey) AS event_id, arg_max(o_totalprice, o_orderkey) AS equity FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def _(spark, d):
    phase = F.when(F.col("o_orderstatus") == "F", "close").otherwise("open").alias("phase")
    e = src.table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("account"), F.to_date("o_orderdate").alias("date"), phase, F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("equity"))
    return accounts.account_fold(e, ["equity"])


@query("win_25_equity_replay", "bars", _RUN + ", m AS (SELECT *, buy_next_open::INT - sell_next_open::INT AS q FROM runs), c AS (SELECT run, date, close, 10000 - sum(q * open + 1.2345678901::DOUBLE * abs(q)) OVER (PARTITION BY run ORDER BY date) AS cash, sum(q) OVER (PARTITION BY run ORDER BY date)::DOUBLE AS quantity FROM m) SELECT run, date, round(cash, 4) AS cash, quantity, round(cash + quantity * close, 4) AS equity FROM c")
def _(spark, d):
    c = _crossings(spark, d)
    q = F.col("buy_next_open").cast("double") - F.col("sell_next_open").cast("double")
    log = c.where("buy_next_open OR sell_next_open").select("run", "date", q.alias("quantity"), F.col("open").alias("price"), F.lit(None).cast("double").alias("cash"))
    return rounded(accounts.replayed_equity(c.select("run", "date", "close"), log, capital=10_000.0, commission=1.2345678901).drop("drift"), 4)


@query("join_17_order_evidence", "bars", f", n AS (SELECT ticker, date, lead(open) OVER ({_W}) AS next_open, (high - low) / close * 5000 AS modeled FROM bars), o AS (SELECT o_orderkey AS id, 'Brand#' || (o_custkey % 25 + 1) AS ticker, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side, CASE WHEN o_orderkey % 13 <> 0 THEN 1000.0::DOUBLE + o_orderkey % 900 END AS fill FROM orders) SELECT id, o.ticker, o.date, side, fill, next_open, round(modeled, 4) AS modeled_bps, round(CASE side WHEN 'sell' THEN -1 ELSE 1 END * (fill / next_open - 1) * 10000, 4) AS slippage_bps, concat_ws(',', CASE WHEN fill IS NULL THEN 'fill' END, CASE WHEN next_open IS NULL THEN 'next_open' END, CASE WHEN modeled IS NULL THEN 'modeled_cost' END) AS missing FROM o LEFT JOIN n ON n.ticker = o.ticker AND n.date = o.date")
def _(spark, d):
    o = src.table(spark, d, "orders")
    k = F.col("o_orderkey")
    asked = o.select(k.alias("id"), F.concat(F.lit("Brand#"), F.col("o_custkey") % 25 + 1).alias("ticker"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"))
    fills = o.where(k % 13 != 0).select(k.alias("id"), (F.lit(1000.0) + k % 900).alias("fill"))
    return rounded(accounts.order_evidence(asked, fills, src.bars(spark, d)), 4, next_open=15)


@query("pf_12_allocation_weights", "", with_frames("sessions", f", {_DECIDES} SELECT x.* FROM ({ORACLE_SQL['pf_07_volatility_target_book']}) x JOIN decisions USING (date) WHERE decides"))
def _(spark, d):
    decisions = cal.decision_sessions(src.sessions_of(spark, src.bars(spark, d)), "monthly")
    return accounts.on_decisions(QUERIES["pf_07_volatility_target_book"](spark, d), decisions)


@query("pf_17_allocation_plan", "panel", _HELD + ", w AS (SELECT ticker, date, close, CASE WHEN held THEN round(0.93::DOUBLE / sum(held::INT) OVER (PARTITION BY date), 6) ELSE 0 END AS weight, (day(date) % 4 * 3)::DOUBLE AS held FROM sel), m AS (SELECT *, weight * 100000 - held * close AS mv FROM w WHERE close > 0), s AS (SELECT ticker, date, CASE WHEN weight = 0 AND held > 0 THEN -held WHEN abs(mv) >= 500 THEN sign(mv) * floor(abs(mv) / close) END AS shares FROM m) SELECT date, ticker, shares, CASE WHEN shares < 0 THEN 'sell' ELSE 'buy' END AS side, row_number() OVER (PARTITION BY date ORDER BY shares > 0, ticker)::INT AS place FROM s WHERE shares <> 0")
def _(spark, d):
    w = sizing.equal_weight(signals.trend(_weekly(spark, d), 100), 0.93)
    rows = w.select("date", "ticker", F.round("weight", 6).alias("weight"), "close", (F.dayofmonth("date") % 4 * 3).cast("double").alias("held"))
    return accounts.allocation_plan(rows, equity=100_000.0).withColumn("shares", F.col("shares") + 0.0)


@query(
    "agg_30_unit_root",
    "panel",
    _FILLED
    + f""", x AS (SELECT ticker, date, ln(close) AS x FROM filled), y AS (SELECT *, x - lag(x) OVER ({_W}) AS y FROM x), z AS (SELECT ticker, y, lag(x) OVER ({_W}) AS a, lag(y) OVER ({_W}) AS b FROM y),
m AS (SELECT ticker, count(*) AS n, regr_sxx(a, a) AS aa, regr_sxx(b, b) AS bb, regr_sxx(y, y) AS yy, regr_sxy(a, b) AS ab, regr_sxy(a, y) AS ay, regr_sxy(b, y) AS by_ FROM z WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
f AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS s, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS l FROM m),
t AS (SELECT ticker, n, s / sqrt((yy - s * ay - l * by_) / (n - 3) * bb / det) AS tau, -2.86154::DOUBLE - 2.8903::DOUBLE / n - 4.234::DOUBLE / (n * n) - 40.04::DOUBLE / (n * n * n) AS c FROM f)
SELECT ticker, n::BIGINT AS n, round(tau, 5) AS statistic, round(c, 5) AS critical, tau < c AS rejects FROM t""",
)
def _(spark, d):
    return rounded(accounts.unit_root(_weekly(spark, d).withColumn("x", F.log("close")), "ticker", "date", "x"), 5)


_D4 = f"SELECT ticker, concat_ws(',', CASE WHEN NOT coalesce(s.sharpe > 0, false) THEN 'sharpe' END, CASE WHEN NOT coalesce(h.t >= 1.645, false) THEN 't' END) AS failing FROM ({ORACLE_SQL['agg_04_hac']}) h JOIN ({ORACLE_SQL['agg_17_return_stats']}) s USING (ticker)"


@query("sb_13_holdout_check", "", f"SELECT *, CASE WHEN failing = '' THEN 'passed' ELSE 'failed' END AS verdict FROM ({_D4})")
def _(spark, d):
    return accounts.holdout_check(_returns(spark, d), "ticker", "date", 3)


@query("sb_12_stale_artifacts", "", "WITH r AS (SELECT o_custkey AS artifact, o_orderkey, md5(o_orderstatus) AS digest, CASE WHEN o_orderkey % 23 <> 0 THEN md5(CASE WHEN o_orderkey % 41 = 0 THEN 'x' ELSE o_orderstatus END) END AS now FROM orders) SELECT artifact, count(*)::BIGINT AS inputs, count(*) FILTER (WHERE now IS NULL)::BIGINT AS gone, count(*) FILTER (WHERE now <> digest)::BIGINT AS changed, CASE WHEN count(*) FILTER (WHERE now IS NULL OR now <> digest) = 0 THEN 'fresh' ELSE 'stale' END AS state FROM r GROUP BY 1")
def _(spark, d):
    o, k, s = src.table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderstatus")
    now = o.where(k % 23 != 0).select(k.alias("input"), F.md5(F.when(k % 41 == 0, "x").otherwise(s)).alias("digest"))
    return accounts.stale_artifacts(o.select(F.col("o_custkey").alias("artifact"), k.alias("input"), F.md5(s).alias("digest")), now)


@query("aux_46_replay_verdict", "", "SELECT o_custkey AS replay, count(*)::BIGINT AS windows, count(*) FILTER (WHERE o_orderstatus = 'P' OR o_orderkey % 37 = 0)::BIGINT AS bad, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P' OR o_orderkey % 37 = 0) = 0 THEN 'passed' ELSE 'failed' END AS verdict FROM orders GROUP BY 1")
def _(spark, d):
    k = F.col("o_orderkey")
    w = src.table(spark, d, "orders").select(F.col("o_custkey").alias("replay"), (F.col("o_orderstatus") == "P").alias("error"), F.lit(None).cast("boolean").alias("aborted"), F.when(k % 37 == 0, 1).alias("denials"))
    return accounts.replay_verdict(w, "replay")


@query("dq_25_may_publish", "", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN true WHEN c_acctbal > 0 THEN false END, false) AS allowed FROM customer")
def _(spark, d):
    p = F.when(F.col("c_acctbal") > 5000, True).when(F.col("c_acctbal") > 0, False)
    return src.table(spark, d, "customer").select("c_custkey", accounts.may_publish(p).alias("allowed"))


@query("dq_26_capable", "", "SELECT p_partkey, p_size > 10 AND p_type LIKE '% BRASS' AS capable FROM part")
def _(spark, d):
    return src.table(spark, d, "part").select("p_partkey", accounts.capable(F.when(F.col("p_size") > 10, F.split("p_type", " ")), F.lit("BRASS")).alias("capable"))


# documents compared by path


def _documents(spark, d):
    """(p_partkey, frozen, source): each part as a nested JSON document, and a copy with one field changed, dropped or added."""
    k = F.col("p_partkey")
    doc = lambda size, brand, extra: F.to_json(F.struct(F.struct(brand.alias("brand"), F.struct(size.alias("size")).alias("limits")).alias("family"), F.col("p_type").alias("kind"), extra.alias("note")))
    none = F.lit(None).cast("string")
    source = doc(F.when(k % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")), F.when(k % 7 != 0, F.col("p_brand")), F.when(k % 3 == 0, "new"))
    frozen = doc(F.col("p_size"), F.col("p_brand"), none)
    return src.table(spark, d, "part").select(k, ledger.flattened(frozen).alias("frozen"), ledger.flattened(source).alias("source"))


@query("led_09_first_difference", "", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'family.brand' WHEN p_partkey % 5 = 0 THEN 'family.limits.size' WHEN p_partkey % 3 = 0 THEN 'note' END AS path FROM part")
def _(spark, d):
    return _documents(spark, d).select("p_partkey", ledger.first_difference(F.col("frozen"), F.col("source")).alias("path"))


@query("aux_20_additions", "", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'note' ELSE '' END AS added, concat_ws(',', CASE WHEN p_partkey % 7 = 0 THEN 'family.brand' END, CASE WHEN p_partkey % 5 = 0 THEN 'family.limits.size' END) AS refused FROM part")
def _(spark, d):
    a = _documents(spark, d).select("p_partkey", ledger.additions(F.col("frozen"), F.col("source")).alias("a"))
    return a.select("p_partkey", F.array_join("a.added", ",").alias("added"), F.array_join("a.refused", ",").alias("refused"))


@query("led_07_amended", "", "WITH a AS (SELECT o_custkey AS family, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS n, o_orderkey % 20 AS key, o_orderstatus AS value FROM orders), b AS (SELECT *, CASE WHEN family % 9 = 0 AND n > 5 THEN n + 1 ELSE n END AS seq FROM a) SELECT family, seq, key, value, CASE WHEN family % 9 = 0 AND n > 5 THEN 'refused' WHEN row_number() OVER w = 1 THEN 'added' WHEN value = first_value(value) OVER w THEN 'repeated' ELSE 'refused' END AS state FROM b WINDOW w AS (PARTITION BY family, key ORDER BY seq)")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    a = src.table(spark, d, "orders").select(F.col("o_custkey").alias("family"), n.alias("seq"), (F.col("o_orderkey") % 20).alias("key"), F.col("o_orderstatus").alias("value"))
    return ledger.amended(a.withColumn("seq", F.when((F.col("family") % 9 == 0) & (F.col("seq") > 5), F.col("seq") + 1).otherwise(F.col("seq"))))


# signals


_MOVES = "mv AS (SELECT *, held AND NOT coalesce(lag(held) OVER (" + _W + "), false) AS i, NOT held AND coalesce(lag(held) OVER (" + _W + "), false) AS o FROM hp)"


@query("sig_10_control_orders", "bars", _CLS.replace("year(date) AS fold", "date") + ", hp AS (SELECT ticker, date, coalesce(predicted = 1, false) AS held FROM q), " + _MOVES + f" SELECT ticker, date, coalesce(lag(i) OVER ({_W}), false) AS buy_next_open, coalesce(lag(o) OVER ({_W}), false) AS sell_next_open FROM mv")
def _(spark, d):
    c = F.col("close")
    held = signals.direction_positions((c > F.lag(c).over(win.by_ticker())).cast("int"))
    return signals.orders_of(src.bars(spark, d).select("ticker", "date", held.alias("desired_long"))).drop("desired_long")


@query("sig_11_covered_signal", "bars", _POS + f", n AS (SELECT *, row_number() OVER ({_W}) AS n FROM mv) SELECT ticker, date, coalesce(lag(i) OVER ({_W}), false) AS buy_next_open, coalesce(lag(o) OVER ({_W}), false) AS sell_next_open, (min(n) FILTER (WHERE prediction IS NOT NULL) OVER (PARTITION BY ticker))::INT AS first_covered FROM n")
def _(spark, d):
    return signals.covered_signal(_positions(spark, d)).select("ticker", "date", "buy_next_open", "sell_next_open", "first_covered")


@query("sig_12_research_close_signal", "acted", f", g AS (SELECT *, CASE WHEN lag(close) OVER ({_W}) IS NULL THEN 0.0::DOUBLE ELSE ln(split * (close + dividend) / lag(close) OVER ({_W})) END AS g FROM acted), rc AS (SELECT ticker, date, open, round(exp(ln(first_value(close) OVER ({_W})) + sum(g) OVER ({_W})), 4) AS close FROM g)" + _SMA.replace("FROM bars", "FROM rc") + " SELECT ticker, date, buy_next_open, sell_next_open FROM sig")
def _(spark, d):
    b = joins.actions_onto_bars(src.bars(spark, d), src.actions(spark, d))
    r = win.research_close(b).select("ticker", "date", "open", F.round(F.exp("log_research_close"), 4).alias("close"))
    return win.sma_crossover(r).select("ticker", "date", "buy_next_open", "sell_next_open")


@query("sig_15_research_activity", "", ORACLE_SQL["agg_10_matched_activity"].replace("WHERE decides)", "WHERE decides AND date <= DATE '1996-12-31')"))
def _(spark, d):
    held = signals.trend(_weekly(spark, d), 100).where("date <= DATE '1996-12-31'")
    decisions = cal.decision_sessions(src.sessions_of(spark, src.bars(spark, d)), "monthly")
    return rounded(signals.matched_activity(held.join(F.broadcast(decisions.select("date", "decides")), "date")))


_R3 = ORACLE_SQL["sig_03_random_selection"]


@query("sig_04_random_selections", "", f"SELECT 7 AS seed, x.* FROM ({_R3}) x UNION ALL SELECT 11, y.* FROM (" + _R3.replace("'7|'", "'11|'") + ") y")
def _(spark, d):
    decisions = cal.decision_sessions(src.sessions_of(spark, src.bars(spark, d)), "monthly")
    return signals.random_selections(_panel(spark, d), decisions, [7, 11], enter=0.45, leave=0.4, start=0.5).select("seed", "ticker", "date", "held")


_SLOT = "(CAST('0x' || substr(md5('5|' || ticker || '|' || k), 1, 13) AS UBIGINT)::DOUBLE / 4503599627370496.0::DOUBLE)"


@query("sig_02_random_round_trips", "bars", f", r AS (SELECT ticker, date, row_number() OVER ({_W}) - 1 AS k, count(*) OVER (PARTITION BY ticker) AS m FROM bars), s AS (SELECT ticker, k FROM r WHERE k < m - 101 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY {_SLOT}, k) <= 20), t AS (SELECT ticker, k, row_number() OVER (PARTITION BY ticker ORDER BY k) AS trip FROM s) SELECT t.ticker, trip::INT AS trip, a.date AS entry, b.date AS exit FROM t JOIN r a ON a.ticker = t.ticker AND a.k = t.k + (trip - 1) * 5 JOIN r b ON b.ticker = t.ticker AND b.k = t.k + trip * 5")
def _(spark, d):
    return signals.random_round_trips(src.bars(spark, d), 20, 5, 5)


@query("cal_14_skipped_while_killed", "sessions", ", e AS (SELECT o_custkey AS profile, CAST(o_orderdate AS DATE) AS session, o_orderkey FROM orders), k AS (SELECT profile, max(session) AS day FROM e WHERE o_orderkey % 4 = 0 GROUP BY 1) SELECT k.profile, s.date AS session FROM k JOIN sessions s ON s.date > k.day WHERE k.day >= (SELECT min(date) FROM sessions) AND (k.profile, s.date) NOT IN (SELECT (profile, session) FROM e WHERE o_orderkey % 4 <> 0)")
def _(spark, d):
    e = src.table(spark, d, "orders").select(F.col("o_custkey").alias("profile"), F.to_date("o_orderdate").alias("session"), F.col("o_orderkey").alias("k"))
    kills = e.where("k % 4 = 0").groupBy("profile").agg(F.max("session").alias("day"))
    return accounts.skipped_while_killed(kills, src.sessions_of(spark, src.bars(spark, d)), e.where("k % 4 IN (1, 2)").select("profile", "session"), e.where("k % 4 = 3").select("profile", "session"))


@query("dq_14_price_guard", "bars", ", p AS (SELECT ticker, CASE WHEN day(date) = 9 THEN date - 1 WHEN day(date) <> 4 THEN date END AS date, CASE WHEN month(date) = 3 THEN NULL WHEN month(date) = 4 THEN -close ELSE close END AS close FROM bars), q AS (SELECT *, count(*) OVER (PARTITION BY ticker, date) AS n FROM p) SELECT ticker, count(*)::BIGINT AS rows, count(*) FILTER (WHERE date IS NULL)::BIGINT AS no_date, count(*) FILTER (WHERE close IS NULL)::BIGINT AS no_close, count(*) FILTER (WHERE close <= 0)::BIGINT AS not_positive, (count(date) - count(DISTINCT date))::BIGINT AS repeated FROM q GROUP BY 1")
def _(spark, d):
    c, m, day = F.col("close"), F.month("date"), F.dayofmonth("date")
    p = src.bars(spark, d).select("ticker", F.when(day == 9, F.date_sub("date", 1)).when(day != 4, F.col("date")).alias("date"), F.when(m == 3, F.lit(None)).when(m == 4, -c).otherwise(c).alias("close"))
    return accounts.price_guard(p, "ticker")


@query("aux_08_dividend_map", "actions", ", a AS (SELECT ticker, date, value FROM actions WHERE kind = 'dividend' UNION ALL SELECT ticker, date, value FROM actions WHERE kind = 'dividend' AND day(date) % 3 = 0) SELECT ticker, date, CASE WHEN count(*) = 1 THEN min(value) END AS amount, CASE WHEN count(*) = 1 THEN 'as_paid' END AS basis, count(*)::BIGINT AS repeats FROM a GROUP BY 1, 2")
def _(spark, d):
    a = src.actions(spark, d).withColumn("basis", F.lit("as_paid"))
    return accounts.dividend_map(a.union(a.where(F.dayofmonth("date") % 3 == 0)))


@query("aux_25_promotions", "", "SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'no_evidence' WHEN o_orderstatus = 'P' THEN 'not_bound' WHEN o_custkey % 12 > 9 THEN 'stale_evidence' WHEN o_orderkey % 60 < 20 THEN 'short_shadow' ELSE 'promoted' END AS decision FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    r = src.table(spark, d, "orders").select(k, F.when(k % 19 != 0, F.md5(k.cast("string"))).alias("evidence"), (F.col("o_orderstatus") != "P").alias("bound"), (F.col("o_custkey") % 12).alias("age"), (k % 60).alias("shadow"))
    return accounts.promotions(r, most_age=9).select("o_orderkey", "decision")


@query("aux_26_champions", "", "WITH e AS (SELECT o_custkey AS registry, o_orderkey AS seq, CASE WHEN o_orderstatus = 'O' THEN 'rollback' ELSE 'promote' END AS event, 'm' || o_orderkey AS model FROM orders), a AS (SELECT *, sum(CASE event WHEN 'promote' THEN 1 ELSE -1 END) OVER w AS s FROM e WINDOW w AS (PARTITION BY registry ORDER BY seq)), b AS (SELECT *, s - least(min(s) OVER (PARTITION BY registry ORDER BY seq), 0) AS depth FROM a) SELECT b.registry, b.seq, b.depth::INT AS depth, CASE WHEN b.depth > 0 THEN (SELECT max_by(p.model, p.seq) FROM b p WHERE p.registry = b.registry AND p.seq <= b.seq AND p.event = 'promote' AND p.depth = b.depth) END AS champion FROM b")
def _(spark, d):
    k = F.col("o_orderkey")
    e = src.table(spark, d, "orders").select(F.col("o_custkey").alias("registry"), k.alias("seq"), F.when(F.col("o_orderstatus") == "O", "rollback").otherwise("promote").alias("event"), F.concat(F.lit("m"), k).alias("model"))
    return accounts.champions(e).select("registry", "seq", "depth", "champion")


@query("sb_14_family_verdict", "", f"SELECT w.family, w.ticker, concat_ws(',', CASE WHEN g.verdict <> 'passed' THEN 'gate' END, CASE WHEN h.verdict <> 'passed' THEN 'holdout' END) AS failing, CASE WHEN g.verdict = 'passed' AND h.verdict = 'passed' THEN 'passed' ELSE 'failed' END AS verdict FROM ({ORACLE_SQL['top_10_winner']}) w JOIN ({ORACLE_SQL['sb_11_gate']}) g USING (ticker) JOIN ({ORACLE_SQL['sb_13_holdout_check']}) h USING (ticker)")
def _(spark, d):
    return accounts.family_verdict(*(QUERIES[n](spark, d) for n in ("top_10_winner", "sb_11_gate", "sb_13_holdout_check")))


@query("agg_34_family_report", "", f"SELECT right(ticker, 1) AS family, ticker, s.sharpe, h.t, round(avg(s.sharpe) OVER f, 5) AS family_mean, round(stddev_samp(s.sharpe) OVER f, 5) AS family_deviation, max(s.sharpe) OVER f AS family_most FROM ({ORACLE_SQL['agg_07_series_stats']}) s JOIN ({ORACLE_SQL['agg_04_hac']}) h USING (ticker) WINDOW f AS (PARTITION BY right(ticker, 1))")
def _(spark, d):
    s = QUERIES["agg_07_series_stats"](spark, d).select("ticker", "sharpe").join(QUERIES["agg_04_hac"](spark, d).select("ticker", "t"), "ticker")
    f = Window.partitionBy("family")
    s = s.withColumn("family", F.substring("ticker", -1, 1))
    return rounded(s.select("family", "ticker", "sharpe", "t", F.avg("sharpe").over(f).alias("family_mean"), F.stddev_samp("sharpe").over(f).alias("family_deviation"), F.max("sharpe").over(f).alias("family_most")), 5, sharpe=15, t=15, family_most=15)


_P3 = ORACLE_SQL["pf_03_correlation_adjusted"]
_PF6 = (
    _VOL.replace("vol > 0", "vol > 1e-9")
    + f", w AS (SELECT date, ticker, CASE WHEN {_OBS(61)} THEN least(w, 0.08::DOUBLE) ELSE 0 END AS weight FROM ft),\n"
    + _P3[_P3.index("pr AS (SELECT a.session_no") :].replace("\nSELECT w.date", ", adj AS (SELECT w.date", 1).replace("round(w.weight / (1 + coalesce(ov.s, 0)), 6)", "w.weight / (1 + coalesce(ov.s, 0))")
    + "), gc AS (SELECT *, CASE WHEN sum(adjusted) OVER (PARTITION BY date) > 0.2 THEN adjusted * 0.2::DOUBLE / sum(adjusted) OVER (PARTITION BY date) ELSE adjusted END AS g FROM adj) SELECT date, ticker, round(CASE WHEN month(date) = 10 THEN CASE WHEN g IS NOT NULL THEN least(g, 0.002::DOUBLE) END ELSE g END, 5) AS weight FROM gc"
)


@query("pf_06_target_weights", "panel", _PF6)
def _(spark, d):
    p = _weekly(spark, d)
    r = F.col("log_return")
    vol = win.full(F.stddev_samp(r), r, win.by_ticker(), 20) * F.sqrt(F.lit(252.0))
    held = signals.risk_parity(p).select("date", "ticker", F.col("held").cast("double").alias("confidence"))
    v = win.panel_log_returns(p).select("date", "ticker", vol.alias("volatility"))
    rows = v.withColumn("volatility", F.when(F.col("volatility") > 1e-9, F.col("volatility"))).join(held, ["date", "ticker"])
    rows = rows.withColumns({"current": F.lit(0.002), "halted": F.month("date") == 10})
    correlation = win.trailing_correlation(p, 60).withColumn("correlation", F.round("correlation", 8))
    return rounded(sizing.target_weights(rows, correlation, target=0.1, name_cap=0.08, cap=0.2).select("date", "ticker", "weight"), 5)
