"""Queries over performance reports, screens, verdicts, cash flows, and the rest of sizing and signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import joins, performance, screens, signals, sizing, tables
from tidemark.operators import windows as win
from tidemark.operators.calendar import market_holidays
from tidemark.operators.windows import by_ticker
from tidemark.plans.registry import query, rounded
from tidemark.plans.research import _LR, _W, _roll
from tidemark.plans.strategies import _FILLED, _FR, _HELD, _RF, _returns, _weekly, win_02_raw
from tidemark.sources import frames as src
from tidemark.streaming import flows

# performance

_ER = ", er AS (SELECT account, session, CASE WHEN e > 0 AND b > 0 THEN ln(e / b) END AS r FROM (SELECT account, session, equity AS e, coalesce(lag(equity) OVER (PARTITION BY account ORDER BY session), 50000000) AS b FROM equity))"


@query(
    "agg_02_performance_summary",
    "equity",
    _ER
    + f""", c AS (SELECT *, r - avg(r) OVER (PARTITION BY account) AS c FROM er), l AS (SELECT *, c * lag(c, 1) OVER w AS l1, c * lag(c, 2) OVER w AS l2, c * lag(c, 3) OVER w AS l3 FROM c WINDOW w AS (PARTITION BY account ORDER BY session)),
s AS (SELECT account, count(*) AS n, sum(r) AS total, avg(r) AS m, stddev_samp(r) AS sd, avg((r > 0)::INT) AS gaining, sqrt(greatest((sum(c * c) + 2 * (0.75::DOUBLE * sum(l1) + 0.5::DOUBLE * sum(l2) + 0.25::DOUBLE * sum(l3))) / count(*), 0) / count(*)) AS se FROM l GROUP BY 1),
d AS (SELECT account, min(x) AS mdd FROM (SELECT account, equity / max(equity) OVER (PARTITION BY account ORDER BY session) - 1 AS x FROM equity) GROUP BY 1)
SELECT account, n::BIGINT AS sessions, round(total, 6) AS total_log_return, round(m * 252, 6) AS annual_log_return, round(exp(total * 252 / n) - 1, 6) AS growth_rate, round((m * 252 - {_RF}) / (sd * sqrt(252)), 6) AS sharpe, round(gaining, 6) AS gaining,
  round(se, 6) AS se, round((m - {_RF} / 252) / se, 5) AS t, round(mdd, 6) AS max_drawdown FROM s JOIN d USING (account)""",
)
def _(spark, d):
    return rounded(performance.performance_summary(src.equity(spark, d), 50_000_000.0), t=5)


_MOM = f", mo AS (SELECT ticker, avg(r) AS m0 FROM fr GROUP BY 1), st AS (SELECT ticker, count(*) AS n, sum(r) AS total, avg(r) AS m, stddev_samp(r) AS s, avg(pow(r - m0, 2)) AS m2, avg(pow(r - m0, 3)) AS m3, avg(pow(r - m0, 4)) AS m4 FROM fr JOIN mo USING (ticker) GROUP BY 1), sr AS (SELECT *, (m - {_RF} / 252) / s AS x, m3 / pow(m2, 1.5) AS g, m4 / (m2 * m2) AS k FROM st)"


@query("agg_07_series_stats", "panel", _FR + _MOM + f" SELECT ticker, n::BIGINT AS sessions, round(total, 6) AS total_log_return, round((m * 252 - {_RF}) / (s * sqrt(252)), 6) AS sharpe, CASE WHEN 1 - g * x + (k - 1) * x * x / 4 > 0 THEN round(x * sqrt(n - 1) / sqrt(1 - g * x + (k - 1) * x * x / 4), 6) END AS psr_score FROM sr")
def _(spark, d):
    return rounded(performance.series_stats(_returns(spark, d), "ticker"))


_TS = f", ts AS (SELECT ticker, (avg(r) * 252 - {_RF}) / (stddev_samp(r) * sqrt(252)) AS sharpe, sum(r) AS total FROM fr GROUP BY 1)"


def _ticker_stats(spark, d):
    return performance.series_stats(_returns(spark, d), "ticker").select("ticker", "sharpe", F.col("total_log_return").alias("total"))


@query("agg_09_dispersion", "panel", _FR + _TS + "".join(f" {'UNION ALL ' if c == 'total' else ''}SELECT '{c}' AS statistic, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS deviation, round(min({c}), 6) AS least, round(max({c}), 6) AS most FROM ts" for c in ("sharpe", "total")))
def _(spark, d):
    return rounded(performance.dispersion(_ticker_stats(spark, d), ["sharpe", "total"]))


@query("aux_14_seed_summary", "panel", _FR + _TS + " SELECT right(ticker, 1) AS family, count(*)::BIGINT AS seeds, round(avg(sharpe), 6) AS mean, round(stddev_pop(sharpe), 6) AS deviation FROM ts GROUP BY 1")
def _(spark, d):
    return rounded(performance.seed_summary(_ticker_stats(spark, d).withColumn("family", F.substring("ticker", -1, 1)), "family", "sharpe"))


_CLS = f", q AS (SELECT ticker, year(date) AS fold, (lead(close) OVER ({_W}) > close)::INT AS label, (close > lag(close) OVER ({_W}))::INT AS predicted, least(greatest(0.5::DOUBLE + (close / lag(close) OVER ({_W}) - 1), 0), 1) AS p FROM bars)"


def _classes(spark, d):
    c, after, before = F.col("close"), F.lead("close").over(by_ticker()), F.lag("close").over(by_ticker())
    p = F.when(before.isNotNull(), F.least(F.greatest(0.5 + (c / before - 1), F.lit(0.0)), F.lit(1.0)))
    return src.bars(spark, d).select("ticker", F.year("date").alias("fold"), (after > c).cast("int").alias("label"), (c > before).cast("int").alias("predicted"), p.alias("probability"))


@query("agg_19_fold_accuracy", "bars", _CLS + " SELECT ticker, fold::INT AS fold, count(*)::BIGINT AS n, sum(label)::BIGINT AS positives, sum((label = predicted)::INT)::BIGINT AS hits, round(avg((label = predicted)::INT), 6) AS accuracy, round(greatest(sum(label), count(*) - sum(label)) / count(*), 6) AS majority FROM q WHERE label IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return rounded(performance.fold_accuracy(_classes(spark, d), ["ticker", "fold"]))


_LOSS = "-(label * ln(least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)) + (1 - label) * ln(1 - least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)))"


@query("agg_20_fold_score", "bars", _CLS + f" SELECT ticker, fold::INT AS fold, count(*)::BIGINT AS n, round(avg({_LOSS}), 5) AS log_loss, round(avg(pow(label - p, 2)), 5) AS squared_error FROM q WHERE label IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return rounded(performance.fold_scores(_classes(spark, d), ["ticker", "fold"]), 5)


@query("ml_07_tune", "", "WITH s AS (SELECT o_orderpriority AS run, (o_orderkey % 4)::INT AS point, avg(round(o_totalprice, 0)) AS score FROM orders GROUP BY 1, 2) SELECT run, pow(10.0::DOUBLE, point - 1) AS strength, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score, point) AS n FROM s) WHERE n = 1")
def _(spark, d):
    o = src.table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), (F.col("o_orderkey") % 4).cast("int").alias("point"), F.round("o_totalprice", 0).alias("score"))
    return rounded(performance.tune(o.withColumn("strength", F.pow(F.lit(10.0), F.col("point") - 1)), ["run"], 1.0), 4)


@query("agg_21_median_liquidity", "bars", " SELECT ticker, CASE WHEN count(*) = 252 AND count(*) FILTER (WHERE close * volume > 0) = 252 THEN round(quantile_cont(close * volume, 0.5), 4) END AS liquidity FROM (SELECT * FROM bars WHERE date <= DATE '1997-06-30' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 252) GROUP BY 1")
def _(spark, d):
    return rounded(performance.median_liquidity(src.bars(spark, d), F.lit("1997-06-30").cast("date")), 4)


@query("agg_26_diagnose", "bars", f", r AS (SELECT {_LR} AS lr, volume FROM bars), k AS (SELECT * FROM r WHERE lr IS NOT NULL), c AS (SELECT (SELECT count(*) FROM k)::BIGINT AS n, ((SELECT count(*) FROM r) - (SELECT count(*) FROM k))::BIGINT AS x)" + "".join(f" {u} SELECT '{n}' AS \"column\", any_value(c.n) AS rows, any_value(c.x) AS rows_excluded, round(avg({e}), 5) AS mean, round(stddev_samp({e}), 5) AS deviation, round(min({e}), 5) AS least, round(quantile_cont({e}, 0.25), 5) AS q25, round(median({e}), 5) AS median, round(quantile_cont({e}, 0.75), 5) AS q75, round(max({e}), 5) AS most FROM k, c" for u, n, e in (("", "log_return", "lr"), ("UNION ALL", "volume", "volume"))))
def _(spark, d):
    r = src.bars(spark, d).select(win.log_ratio(F.col("close"), F.lag("close").over(by_ticker())).alias("log_return"), "volume")
    return rounded(performance.describe(r, ["log_return", "volume"]), 5)


@query("agg_27_z_scores", "", "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS o_totalprice FROM orders")
def _(spark, d):
    return rounded(performance.standardized(src.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


@query("agg_32_orders_by_outcome", "", "SELECT CAST(o_orderdate AS DATE) AS session, lower(o_orderstatus) AS outcome, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def _(spark, d):
    o = src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("session"), F.col("o_orderstatus").alias("outcome"))
    return tables.orders_by_outcome(o)


def _runs_of(spark, d):
    """Customers' orders as runs of configurations."""
    outcome = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "errored")
    return src.table(spark, d, "orders").select(F.col("o_custkey").alias("config"), outcome.alias("outcome"))


@query("agg_33_ledger_progress", "", "SELECT o_custkey AS config, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS completed, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS open, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS errored FROM orders GROUP BY 1")
def _(spark, d):
    return tables.ledger_progress(_runs_of(spark, d))


@query("aux_22_resume", "", "SELECT DISTINCT o_custkey AS config FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    return tables.to_resume(_runs_of(spark, d))


@query("agg_14_family_starts", "", "SELECT p_brand AS family, count(*) FILTER (WHERE p_size > 10)::BIGINT AS starts, count(*) FILTER (WHERE p_size > 10) > 60 AS over FROM part GROUP BY 1")
def _(spark, d):
    events = src.table(spark, d, "part").select(F.col("p_brand").alias("family"), F.when(F.col("p_size") > 10, "started").otherwise("other").alias("event_type"))
    return tables.family_starts(events, 60)


@query("join_18_mean_holding", "bars", f", p AS (SELECT ticker, date, row_number() OVER ({_W}) AS n FROM bars), t AS (SELECT ticker, month, min(date) AS entry, max(date) AS exit FROM (SELECT ticker, date, date_trunc('month', date) AS month FROM bars) GROUP BY 1, 2) SELECT t.ticker, count(*)::BIGINT AS trades, round(avg(b.n - a.n), 6) AS mean_bars FROM t JOIN p a ON a.ticker = t.ticker AND a.date = t.entry JOIN p b ON b.ticker = t.ticker AND b.date = t.exit GROUP BY 1")
def _(spark, d):
    b = src.bars(spark, d)
    trades = b.groupBy("ticker", F.trunc("date", "MM").alias("month")).agg(F.min("date").alias("entry"), F.max("date").alias("exit"))
    return rounded(performance.mean_holding(b, trades))


@query("top_10_winner", "panel", _FR + _TS + " SELECT right(ticker, 1) AS family, ticker, round(sharpe, 6) AS sharpe FROM ts QUALIFY row_number() OVER (PARTITION BY right(ticker, 1) ORDER BY round(sharpe, 6) DESC, ticker) = 1")
def _(spark, d):
    s = _ticker_stats(spark, d).select(F.substring("ticker", -1, 1).alias("family"), "ticker", F.round("sharpe", 6).alias("sharpe"))
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy("ticker")))
    return performance.winner(s, ["family"], "sharpe", "place").select("family", "ticker", "sharpe")


# screens


@query("dq_05_pay_date_policy", "", "WITH p AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN 'sourced' WHEN 1 THEN 'unbounded' WHEN 2 THEN 'bound_sessions:' || l_linenumber ELSE 'bound_sessions:0' || l_linenumber END AS policy FROM lineitem) SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n, CASE WHEN policy IN ('sourced', 'unbounded') THEN policy WHEN regexp_full_match(policy, 'bound_sessions:[1-9][0-9]{0,3}') THEN 'bound_sessions' END AS kind FROM p GROUP BY ALL")
def _(spark, d):
    k, n = F.col("l_orderkey") % 4, F.col("l_linenumber").cast("string")
    policy = F.when(k == 0, "sourced").when(k == 1, "unbounded").when(k == 2, F.concat(F.lit("bound_sessions:"), n)).otherwise(F.concat(F.lit("bound_sessions:0"), n))
    return src.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", screens.pay_date_policy(policy).alias("kind")).agg(F.count("*").alias("n"))


@query("dq_06_session_labels", "", "WITH e AS (SELECT user_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, count(*) OVER (PARTITION BY user_id, ts) AS c FROM events) SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE ts IS NULL)::BIGINT AS missing, count(*) FILTER (WHERE ts <> date_trunc('day', ts))::BIGINT AS not_midnight, count(*) FILTER (WHERE ts IS NOT NULL AND c > 1)::BIGINT AS repeated, count(*) FILTER (WHERE ts < b)::BIGINT AS descending FROM e GROUP BY 1")
def _(spark, d):
    e = src.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("row_no"))
    return screens.session_label_faults(e, "user_id", "ts")


@query("dq_07_execution_frame", "bars", " SELECT ticker, date, reasons FROM (SELECT ticker, date, concat_ws(',', CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'missing_price' END, CASE WHEN least(open, high, low, close) <= 0 THEN 'not_positive' END, CASE WHEN high < greatest(open, close) OR low > least(open, close) THEN 'outside_range' END, CASE WHEN coalesce(volume, 0) <= 0 THEN 'no_volume' END) AS reasons FROM (SELECT ticker, date, open, high * CASE WHEN day(date) = 5 THEN 0.5::DOUBLE ELSE 1 END AS high, low, close, CASE WHEN day(date) = 7 THEN 0 ELSE volume END AS volume FROM bars)) WHERE reasons <> ''")
def _(spark, d):
    b = src.bars(spark, d).withColumns({"high": F.col("high") * F.when(F.dayofmonth("date") == 5, 0.5).otherwise(1.0), "volume": F.when(F.dayofmonth("date") == 7, 0.0).otherwise(F.col("volume"))})
    return screens.execution_frame_faults(b).select("ticker", "date", "reasons")


@query("dq_11_source_row_check", "sessions actions second_source", ", j AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.date, b.date) AS date, a.close AS x, b.close AS y FROM bars a FULL JOIN second_source b ON a.ticker = b.ticker AND a.date = b.date) SELECT ticker, count(*) FILTER (WHERE y IS NULL)::BIGINT AS only_first, count(*) FILTER (WHERE x IS NULL)::BIGINT AS only_second, count(*) FILTER (WHERE date NOT IN (SELECT date FROM sessions))::BIGINT AS no_session, count(*) FILTER (WHERE abs(y / x - 1) > 0.001::DOUBLE)::BIGINT AS mismatches, count(*) FILTER (WHERE (ticker, date) IN (SELECT (ticker, date) FROM actions))::BIGINT AS action_sessions FROM j GROUP BY 1")
def _(spark, d):
    b = src.bars(spark, d)
    return screens.source_row_check(b, src.second_source(b), src.sessions_of(spark, b), src.actions(spark, d), 0.001)


_MASK = f", f AS (SELECT ticker, date, {_LR} AS a, close / {_roll('avg', 'close', 10)} - 1 AS b, ln(lead(open, 6) OVER ({_W}) / lead(open) OVER ({_W})) AS label FROM bars)"


@query("dq_16_row_masks", "bars", _MASK + " SELECT ticker, date, a IS NOT NULL AND b IS NOT NULL AS inference, a IS NOT NULL AND b IS NOT NULL AND label IS NOT NULL AS train FROM f")
def _(spark, d):
    return screens.row_masks(win_02_raw(spark, d), ["log_return", "close_to_short"], "label", horizon=6, embargo=21, span=6).select("ticker", "date", "inference", "train")


@query("dq_17_scoreable_pairs", "bars", _MASK + " SELECT ticker, date, round(label, 6) AS label, round(a, 6) AS prediction_a, round(b, 6) AS prediction_b FROM f WHERE label IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
def _(spark, d):
    f = win_02_raw(spark, d)
    return rounded(screens.scoreable(f.select("ticker", "date", "label", F.col("log_return").alias("prediction")), f.select("ticker", "date", F.col("close_to_short").alias("prediction")), ["ticker", "date"]))


@query("join_15_paired_predictions", "bars", _MASK + ", y AS (SELECT ticker, date, b FROM f WHERE month(date) <> 7) SELECT f.ticker, f.date, round(abs(f.a - f.label) - abs(y.b - f.label), 6) AS difference FROM f JOIN y ON y.ticker = f.ticker AND y.date = f.date WHERE f.label IS NOT NULL AND f.a IS NOT NULL AND y.b IS NOT NULL")
def _(spark, d):
    f = win_02_raw(spark, d)
    pairs = screens.scoreable(f.select("ticker", "date", "label", F.col("log_return").alias("prediction")), f.where(F.month("date") != 7).select("ticker", "date", F.col("close_to_short").alias("prediction")), ["ticker", "date"])
    return rounded(pairs.select("ticker", "date", (F.abs(F.col("prediction_a") - F.col("label")) - F.abs(F.col("prediction_b") - F.col("label"))).alias("difference")))


_QUOTE = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity AS bid, l_extendedprice / l_quantity * (1 + round(l_tax, 2)) AS ask, (l_orderkey % 50)::INT - 5 AS age, l_quantity AS quantity, CASE WHEN l_partkey % 11 <> 0 THEN l_quantity * (l_suppkey % 40) END AS adv, CASE WHEN l_linestatus = 'O' THEN 'equity' WHEN l_returnflag = 'R' THEN 'option' ELSE 'etf' END AS asset_class, l_orderkey % 97 = 0 AS halted FROM lineitem"


@query(
    "dq_19_executable",
    "",
    f"""WITH q AS ({_QUOTE}), r AS (SELECT *, concat_ws(',', CASE WHEN asset_class NOT IN ('equity', 'etf') THEN 'class_not_allowed' END, CASE WHEN halted THEN 'halted' END, CASE WHEN bid <= 0 THEN 'no_bid' END, CASE WHEN ask <= 0 THEN 'no_ask' END, CASE WHEN bid > ask THEN 'crossed' END, CASE WHEN age > 40 THEN 'stale_quote' END, CASE WHEN age < 0 THEN 'future_quote' END,
  CASE WHEN (ask - bid) / ((bid + ask) / 2) > 0.065::DOUBLE THEN 'wide_spread' END, CASE WHEN adv IS NULL THEN 'no_adv' END, CASE WHEN adv * ((bid + ask) / 2) < 20000.5::DOUBLE THEN 'low_adv' END, CASE WHEN quantity > adv * 0.125::DOUBLE THEN 'large_order' END, CASE WHEN quantity * ((bid + ask) / 2) < 1500.5::DOUBLE THEN 'below_minimum' END) AS reasons FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity, reasons, reasons = '' AS eligible FROM r""",
)
def _(spark, d):
    c = F.col
    q = src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c("l_extendedprice") / c("l_quantity")).alias("bid"), (c("l_extendedprice") / c("l_quantity") * (1 + F.round("l_tax", 2))).alias("ask"), ((c("l_orderkey") % 50).cast("int") - 5).alias("age"), c("l_quantity").alias("quantity"), F.when(c("l_partkey") % 11 != 0, c("l_quantity") * (c("l_suppkey") % 40)).alias("adv"), F.when(c("l_linestatus") == "O", "equity").when(c("l_returnflag") == "R", "option").otherwise("etf").alias("asset_class"), (c("l_orderkey") % 97 == 0).alias("halted"))
    out = screens.executable(q, most_age=40, widest=0.065, least_adv=20000.5, share=0.125, minimum=1500.5)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity", "reasons", "eligible")


_REF = "SELECT DISTINCT ticker AS instrument_id, right(ticker, 1) AS symbol, DATE '1995-01-01' + (ascii(right(ticker, 1)) % 5)::INT * 200 AS listed, CASE WHEN ticker = 'Brand#3' THEN DATE '1996-01-01' END AS delisted, CASE WHEN ticker = 'Brand#5' THEN 'fund' ELSE 'common' END AS kind FROM bars"


def _reference(spark, d):
    t = F.col("instrument_id")
    ref = src.bars(spark, d).select(F.col("ticker").alias("instrument_id")).distinct()
    return ref.select("instrument_id", F.substring(t, -1, 1).alias("symbol"), F.date_add(F.lit("1995-01-01").cast("date"), (F.ascii(F.substring(t, -1, 1)) % 5) * 200).alias("listed"), F.when(t == "Brand#3", F.lit("1996-01-01").cast("date")).alias("delisted"), F.when(t == "Brand#5", "fund").otherwise("common").alias("kind"))


@query(
    "dq_20_candidates",
    "sessions",
    f""", ref AS ({_REF}), past AS (SELECT * FROM sessions WHERE date <= DATE '1997-06-30'), e AS (SELECT max(date) AS last, max(session_no) AS no FROM past),
k AS (SELECT b.ticker AS instrument_id, b.date, b.close, p.session_no FROM bars b JOIN past p USING (date) JOIN ref r ON r.instrument_id = b.ticker AND b.date >= r.listed),
a AS (SELECT instrument_id, max(date) AS last_bar, count(*) FILTER (WHERE session_no > e.no - 20)::BIGINT AS seen, quantile_cont(close, 0.5) FILTER (WHERE session_no > e.no - 20) AS median_close FROM k, e GROUP BY 1)
SELECT r.instrument_id, r.symbol, a.last_bar, coalesce(a.seen, 0)::BIGINT AS seen, round(a.median_close, 6) AS median_close, concat_ws(',', CASE WHEN r.listed > DATE '1997-06-30' THEN 'not_listed' END, CASE WHEN r.delisted <= DATE '1997-06-30' THEN 'delisted' END, CASE WHEN r.kind <> 'common' THEN 'kind_not_allowed' END, CASE WHEN count(*) OVER (PARTITION BY r.symbol) > 1 THEN 'ambiguous_symbol' END,
  CASE WHEN a.last_bar IS NULL THEN 'no_bars' END, CASE WHEN a.last_bar < e.last THEN 'stale_bar' END, CASE WHEN coalesce(a.seen, 0) < 19 THEN 'missing_sessions' END, CASE WHEN a.median_close < 1350 THEN 'low_price' END) AS reasons FROM ref r LEFT JOIN a USING (instrument_id), e""",
)
def _(spark, d):
    b = src.bars(spark, d)
    bars = b.select(F.col("ticker").alias("instrument_id"), "date", "close")
    return rounded(screens.candidates(_reference(spark, d), bars, src.sessions_of(spark, b), F.lit("1997-06-30").cast("date"), rows=20, least=1350.0).drop("eligible"))


@query("join_14_listed_coverage", "bars", f", ref AS ({_REF}) SELECT r.instrument_id AS symbol, r.listed, count(*) FILTER (WHERE b.date >= r.listed)::BIGINT AS bars, min(b.date) FILTER (WHERE b.date >= r.listed) AS first_bar, max(b.date) AS last_bar FROM ref r LEFT JOIN bars b ON b.ticker = r.instrument_id GROUP BY 1, 2")
def _(spark, d):
    ref = _reference(spark, d).select(F.col("instrument_id").alias("symbol"), "listed")
    return screens.listed_coverage(ref, src.bars(spark, d))


@query("dq_23_rederivation", "", "WITH a AS (SELECT p_partkey, p_size, p_brand FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_brand FROM part WHERE p_partkey % 13 <> 0) SELECT * FROM (SELECT p_partkey, concat_ws(',', CASE WHEN b.p_brand IS NULL THEN 'not_derived' END, CASE WHEN a.p_brand IS NULL THEN 'not_stored' END, CASE WHEN a.p_size <> b.p_size THEN 'p_size_differs' END) AS reasons FROM a FULL JOIN b USING (p_partkey)) WHERE reasons <> ''")
def _(spark, d):
    p, k = src.table(spark, d, "part").select("p_partkey", "p_size", "p_brand"), F.col("p_partkey")
    derived = p.where(k % 13 != 0).withColumn("p_size", F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return screens.derivation_differences(p.where(k % 10 != 0), derived, "p_partkey", ["p_size", "p_brand"])


@query("dq_27_staleness", "sessions", ", a AS (SELECT c_custkey AS id, max(CAST(o_orderdate AS DATE)) AS as_of FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT id, as_of, (SELECT count(*) FROM sessions WHERE date > as_of AND date <= DATE '1998-07-31')::BIGINT AS sessions_since, (SELECT count(*) FROM sessions WHERE date > as_of AND date <= DATE '1998-07-31') > 1 AS stale FROM a")
def _(spark, d):
    stamps = src.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.to_date("o_orderdate")).alias("as_of"))
    return screens.staleness(stamps, src.sessions_of(spark, src.bars(spark, d)), F.lit("1998-07-31").cast("date"))


@query("dq_28_trial_eligibility", "", "SELECT p_partkey, coalesce(CASE WHEN p_type LIKE 'PROMO%' THEN 'not_a_candidate' WHEN p_size < 5 THEN 'too_few_rows' WHEN p_retailprice > 1900 THEN 'no_costs' WHEN p_name IS NULL THEN 'no_provenance' END, 'eligible') AS state FROM part")
def _(spark, d):
    why = screens.first_reason(("not_a_candidate", F.col("p_type").startswith("PROMO")), ("too_few_rows", F.col("p_size") < 5), ("no_costs", F.col("p_retailprice") > 1900), ("no_provenance", F.col("p_name").isNull()))
    return src.table(spark, d, "part").select("p_partkey", F.coalesce(why, F.lit("eligible")).alias("state"))


@query("dq_29_matrix_preflight", "panel", _FR + ", c AS (SELECT ticker, count(*) AS n, count(*) FILTER (WHERE r = 0) AS z, stddev_samp(r) AS s FROM fr GROUP BY 1) SELECT ticker, concat_ws(',', CASE WHEN n < 1500 THEN 'too_short' END, CASE WHEN z > n / 2 THEN 'mostly_flat' END, CASE WHEN s = 0 THEN 'no_variance' END) AS refusals FROM c")
def _(spark, d):
    r = F.col("log_return")
    c = _returns(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.count_if(r == 0).alias("z"), F.stddev_samp(r).alias("s"))
    return c.select("ticker", screens.reasons(("too_short", F.col("n") < 1500), ("mostly_flat", F.col("z") > F.col("n") / 2), ("no_variance", F.col("s") == 0)).alias("refusals"))


@query("join_12_membership", "sessions facts", ", f AS (SELECT *, greatest(effective_date, observed_at::DATE) AS day FROM facts WHERE field = 'status'), st AS (SELECT s.date AS session, f.instrument_id, arg_max(f.value, {'a': f.effective_date, 'b': f.observed_at, 'c': f.o_orderkey}) AS v FROM sessions s JOIN f ON f.day <= s.date GROUP BY 1, 2) SELECT s.date AS session, coalesce(count(*) FILTER (WHERE v = 'F'), 0)::BIGINT AS members FROM sessions s LEFT JOIN st ON st.session = s.date GROUP BY 1")
def _(spark, d):
    return screens.members_per_session(screens.membership_spans(src.facts(spark, d), "status", ["F"]), src.sessions_of(spark, src.bars(spark, d))).select("session", F.col("members").cast("long").alias("members"))


@query("join_07_concept_as_of", "facts", " SELECT instrument_id, arg_max(value, {'a': effective_date, 'b': observed_at, 'c': o_orderkey}) AS value FROM facts WHERE field = 'priority' AND effective_date <= DATE '1996-06-30' AND observed_at < TIMESTAMP '1996-07-01' GROUP BY 1")
def _(spark, d):
    return screens.latest_concept(src.facts(spark, d), "priority", F.lit("1996-06-30").cast("date"))


@query("join_23_misaligned", "bars", ", b AS (SELECT * FROM bars WHERE day(date) <> 13 OR month(date) > 3), j AS (SELECT coalesce(x.date, y.date) AS date, x.ticker AS a, y.ticker AS b FROM bars x FULL JOIN b y ON x.date = y.date AND x.ticker = y.ticker) SELECT date, count(*) FILTER (WHERE b IS NULL)::BIGINT AS only_first, count(*) FILTER (WHERE a IS NULL)::BIGINT AS only_second FROM j GROUP BY 1 HAVING count(*) FILTER (WHERE a IS NULL OR b IS NULL) > 0")
def _(spark, d):
    b = src.bars(spark, d)
    return screens.misaligned(b, b.where((F.dayofmonth("date") != 13) | (F.month("date") > 3)), "date", "ticker")


@query("join_22_order_outcomes", "", "WITH s AS (SELECT l_orderkey, sum(l_quantity) AS filled FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), q AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS id, coalesce(quantity, 1) AS quantity, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS state, filled FROM orders LEFT JOIN q ON q.l_orderkey = o_orderkey LEFT JOIN s ON s.l_orderkey = o_orderkey) SELECT id, CASE WHEN state IS NULL THEN 'missing' WHEN filled IS NULL THEN 'unreadable' WHEN filled > quantity THEN 'overfilled' WHEN state = 'F' AND filled = quantity THEN 'filled' WHEN filled > 0 AND filled < quantity THEN 'partial' WHEN state IN ('O', 'P') THEN 'working' ELSE 'unresolved' END AS outcome FROM o")
def _(spark, d):
    lines = src.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("filled"))
    o = src.table(spark, d, "orders").join(lines, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), F.coalesce("quantity", F.lit(1.0)).alias("quantity"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderstatus")).alias("state"), "filled")
    return screens.order_outcomes(o).select("id", "outcome")


# verdicts

_GATE = f", g AS (SELECT *, x * sqrt(n) AS t FROM sr)"


def _gate(spark, d):
    r = F.col("log_return")
    s = performance.series_stats(_returns(spark, d), "ticker")
    m = _returns(spark, d).groupBy("ticker").agg(((F.avg(r) - win_rf()) / F.stddev_samp(r) * F.sqrt(F.count("*"))).alias("t"))
    return s.join(m, "ticker")


def win_rf():
    from tidemark.operators.aggregates import RISK_FREE_LOG, SESSIONS_PER_YEAR

    return RISK_FREE_LOG / SESSIONS_PER_YEAR


@query("sb_11_gate", "panel", _FR + _MOM + _GATE + " SELECT ticker, CASE WHEN round(x, 9) > 0 AND round(t, 6) >= 1 THEN 'passed' ELSE 'failed' END AS verdict, concat_ws(',', CASE WHEN NOT round(x, 9) > 0 THEN 'sharpe' END, CASE WHEN NOT round(t, 6) >= 1 THEN 't' END) AS failing FROM g")
def _(spark, d):
    checks = _gate(spark, d).select("ticker", F.explode(F.array(F.struct(F.lit("sharpe").alias("name"), (F.round("t", 6) > 0).alias("passed")), F.struct(F.lit("t").alias("name"), (F.round("t", 6) >= 1).alias("passed")))).alias("c")).select("ticker", "c.*")
    return screens.verdict(checks, "ticker")


@query("agg_13_evidence_verdict", "", "WITH r AS (SELECT c_mktsegment AS profile, count(DISTINCT CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus = 'F') AS sessions, count(*) FILTER (WHERE o_orderstatus = 'P') AS errors FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT profile, CASE WHEN sessions >= 1100 AND errors < 900 THEN 'passed' ELSE 'failed' END AS verdict, concat_ws(',', CASE WHEN NOT errors < 900 THEN 'errors' END, CASE WHEN NOT sessions >= 1100 THEN 'sessions' END) AS failing FROM r")
def _(spark, d):
    c = _segments(spark, d).groupBy("profile").agg(F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate"))).alias("s"), F.count_if(F.col("o_orderstatus") == "P").alias("e"))
    checks = c.select("profile", F.explode(F.array(F.struct(F.lit("sessions").alias("name"), (F.col("s") >= 1100).alias("passed")), F.struct(F.lit("errors").alias("name"), (F.col("e") < 900).alias("passed")))).alias("c")).select("profile", "c.*")
    return screens.verdict(checks, "profile")


def _segments(spark, d):
    c = src.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("profile"))
    return src.table(spark, d, "orders").join(c, "o_custkey")


@query("agg_12_completed_sessions", "", "SELECT c_mktsegment AS profile, count(DISTINCT CAST(o_orderdate AS DATE))::BIGINT AS sessions FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def _(spark, d):
    return tables.completed_sessions(_segments(spark, d).select("profile", F.to_date("o_orderdate").alias("session"), (F.col("o_orderstatus") == "F").alias("completed")))


# sets


@query("set_02_test_windows", "", "SELECT CAST(o_orderdate AS DATE) AS date FROM orders WHERE month(o_orderdate) IN (1, 2, 3) UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE month(l_shipdate) IN (3, 4)")
def _(spark, d):
    a = src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).where(F.month("date").isin(1, 2, 3))
    return tables.union_of_dates(a, src.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).where(F.month("date").isin(3, 4)))


@query("set_04_common_dates", "", "SELECT CAST(o_orderdate AS DATE) AS date FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem")
def _(spark, d):
    return tables.common_dates(src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")), src.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")))


@query("set_06_exclusions", "", "SELECT p_brand AS ticker FROM part WHERE p_size > 45 UNION SELECT p_brand FROM part WHERE p_retailprice < 910")
def _(spark, d):
    p = src.table(spark, d, "part").select(F.col("p_brand").alias("ticker"), "p_size", "p_retailprice")
    return tables.excluded(p, "ticker", F.col("p_size") > 45, F.col("p_retailprice") < 910)


@query("set_08_not_in_superset", "", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, d):
    known = src.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return tables.not_in_superset(src.table(spark, d, "orders").select(F.col("o_custkey").alias("id")), known, "id")


# windows, signals, sizing


@query("win_03_control_features", "bars", f", a AS (SELECT ticker, date, close, {_roll('avg', 'close', 10)} AS s, {_roll('avg', 'close', 30)} AS l, lead(close) OVER ({_W}) AS nx, row_number() OVER ({_W}) AS n FROM bars) SELECT ticker, date, round(s, 6) AS short, round(l, 6) AS long, (nx > close)::INT AS label FROM a WHERE n > 30")
def _(spark, d):
    c = F.col("close")
    a = src.bars(spark, d).select("ticker", "date", win.full(F.avg(c), c, by_ticker(), 10).alias("short"), win.full(F.avg(c), c, by_ticker(), 30).alias("long"), (F.lead(c).over(by_ticker()) > c).cast("int").alias("label"), F.row_number().over(by_ticker()).alias("n"))
    return rounded(a.where("n > 30").drop("n"))


@query("win_30_collinear_features", "bars", f", a AS (SELECT ticker, {_LR} AS lr, close / {_roll('avg', 'close', 10)} - 1 AS a, close / {_roll('avg', 'close', 30)} - 1 AS b FROM bars) SELECT ticker, count(*)::BIGINT AS n, round(corr(lr, a), 6) AS return_short, round(corr(lr, b), 6) AS return_long, round(corr(a, b), 6) AS short_long FROM a WHERE lr IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def _(spark, d):
    c = F.col("close")
    a = src.bars(spark, d).select("ticker", win.log_ratio(c, F.lag(c).over(by_ticker())).alias("lr"), (c / win.full(F.avg(c), c, by_ticker(), 10) - 1).alias("a"), (c / win.full(F.avg(c), c, by_ticker(), 30) - 1).alias("b")).dropna()
    return rounded(a.groupBy("ticker").agg(F.count("*").alias("n"), F.corr("lr", "a").alias("return_short"), F.corr("lr", "b").alias("return_long"), F.corr("a", "b").alias("short_long")))


@query("sig_06_log_hurdle", "", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + 2 * (1.5::DOUBLE / (l_extendedprice / l_quantity) + 0.0005::DOUBLE)), 9) AS hurdle FROM lineitem")
def _(spark, d):
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return rounded(src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", signals.log_hurdle(px, commission=1.5, slippage_bps=5.0).alias("hurdle")), 9)


@query("sig_08_direction_positions", "bars", _CLS.replace("year(date) AS fold", "date") + " SELECT ticker, date, coalesce(predicted = 1, false) AS held FROM q")
def _(spark, d):
    c = F.col("close")
    return src.bars(spark, d).select("ticker", "date", signals.direction_positions((c > F.lag(c).over(by_ticker())).cast("int")).alias("held"))


@query("sig_14_carried_selection", "panel", _HELD + f", dm AS (SELECT *, CASE WHEN day(date) <= 7 THEN held END AS h FROM sel) SELECT ticker, date, coalesce(last_value(h IGNORE NULLS) OVER ({_W}), false) AND close IS NOT NULL AS held FROM dm")
def _(spark, d):
    sel = signals.trend(_weekly(spark, d), 100)
    return signals.carried_selection(sel, F.dayofmonth("date") <= 7).select("ticker", "date", "held")


@query("pf_19_sizing_equity", "", "SELECT c_custkey, round(least(5000.0::DOUBLE, greatest(c_acctbal, 0) + 1000), 4) AS equity FROM customer")
def _(spark, d):
    return rounded(src.table(spark, d, "customer").select("c_custkey", sizing.sizing_equity(F.lit(5000.0), F.greatest("c_acctbal", F.lit(0.0)), F.lit(1000.0)).alias("equity")), 4)


@query("pf_20_bot_sells", "", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(least(l_quantity - l_orderkey % 20, l_quantity), 0) AS sell FROM lineitem")
def _(spark, d):
    return src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sizing.own_sells(F.col("l_quantity"), (F.col("l_orderkey") % 20).cast("double"), F.col("l_quantity")).alias("sell"))


@query("pf_08_equal_weight_volatility", "panel", _FILLED + f", v AS (SELECT *, {_LR} AS r FROM filled), w AS (SELECT ticker, date, CASE WHEN count(r) OVER z = 20 THEN stddev_samp(r) OVER z * sqrt(252) END AS vol FROM v WINDOW z AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT ticker, date, round(CASE WHEN vol > 0 THEN least(1, 0.1::DOUBLE / vol) / count(*) FILTER (WHERE vol > 0) OVER (PARTITION BY date) ELSE 0 END, 6) AS weight FROM w")
def _(spark, d):
    r = F.col("log_return")
    p = win.panel_log_returns(_weekly(spark, d)).withColumn("volatility", win.full(F.stddev_samp(r), r, by_ticker(), 20) * F.sqrt(F.lit(252.0)))
    return rounded(sizing.equal_weight_volatility(p.withColumn("held", F.coalesce(F.col("volatility") > 0, F.lit(False))), 0.1).select("ticker", "date", "weight"))


# calendars, cash flows, gates


@query("cal_06_is_holiday", "holidays", " SELECT o_orderkey, isodow(CAST(o_orderdate AS DATE)) < 6 AND CAST(o_orderdate AS DATE) IN (SELECT date FROM holidays) AS holiday FROM orders")
def _(spark, d):
    days = F.broadcast(market_holidays(spark, 1990, 2030).select(F.col("date").alias("_d")).distinct().withColumn("_h", F.lit(True)))
    o = src.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.join(days, F.col("day") == F.col("_d"), "left").select("o_orderkey", (F.coalesce("_h", F.lit(False)) & (F.weekday("day") < 5)).alias("holiday"))


@query("cal_15_broker_time", "", "SELECT event_id, date_trunc('microsecond', ts) AS at FROM events")
def _(spark, d):
    from tidemark.operators.orders import broker_time

    text = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))
    return src.table(spark, d, "events").select("event_id", broker_time(text).cast("timestamp_ntz").alias("at"))


@query("st_04_freshness", "", "WITH e AS (SELECT user_id, event_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) AS age FROM events), f AS (SELECT *, CASE WHEN age > 86400 THEN 'late' WHEN age < -5 THEN 'future' ELSE 'fresh' END AS state FROM e) SELECT user_id, event_id, state, max((state <> 'fresh')::INT) OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS halted FROM f")
def _(spark, d):
    e = src.table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    age = F.unix_micros("ts") / 1e6 - F.unix_micros(F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))) / 1e6
    f = e.withColumn("state", flows.freshness(age, 86400, 5))
    return flows.latched(f, "user_id", ["event_id"], F.col("state") != "fresh").select("user_id", "event_id", "state", "halted")


@query("st_05_equity_observation", "equity", ", f AS (SELECT c_mktsegment AS account, CAST(o_orderdate AS DATE) AS session, sum(floor(o_totalprice / 100)) AS amount FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 = 0 GROUP BY 1, 2), a AS (SELECT e.account, e.session, e.equity - coalesce(sum(f.amount) OVER (PARTITION BY e.account ORDER BY e.session), 0) AS adjusted FROM equity e LEFT JOIN f ON f.account = e.account AND f.session = e.session), h AS (SELECT *, max(adjusted) OVER (PARTITION BY account ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS high FROM a), x AS (SELECT *, adjusted / high - 1 AS drawdown FROM h) SELECT account, session, round(adjusted, 4) AS adjusted, round(high, 4) AS high, round(drawdown, 6) AS drawdown, max((coalesce(drawdown < -0.0405::DOUBLE, false))::INT) OVER (PARTITION BY account ORDER BY session) = 1 AS halted FROM x")
def _(spark, d):
    f = _segments(spark, d).where("o_orderkey % 10 = 0").select(F.col("profile").alias("account"), F.to_date("o_orderdate").alias("session"), F.floor(F.col("o_totalprice") / 100).cast("double").alias("amount"))
    return rounded(flows.observe_equity(src.equity(spark, d), f, window=20, most=0.0405), 4, drawdown=6)


@query("st_06_worst_case", "", "WITH h AS (SELECT l_suppkey AS ticker, sum(l_quantity) AS held FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), o AS (SELECT l_suppkey AS ticker, sum(l_quantity) AS open FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT s_suppkey AS ticker, (coalesce(held, 0) + coalesce(open, 0)) * (s_suppkey % 9 + 1) AS exposure FROM supplier LEFT JOIN h ON h.ticker = s_suppkey LEFT JOIN o ON o.ticker = s_suppkey WHERE held IS NOT NULL OR open IS NOT NULL")
def _(spark, d):
    lines = src.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.col("l_quantity").alias("quantity"), "l_linestatus")
    prices = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"), (F.col("s_suppkey") % 9 + 1).cast("double").alias("price"))
    return flows.worst_case(lines.where("l_linestatus = 'F'"), lines.where("l_linestatus = 'O'"), prices)


@query("st_07_first_observations", "", "WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER w AS n, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type, event_id)) SELECT user_id::VARCHAR AS observation_id, CASE WHEN n = 1 THEN 'accepted' WHEN event_type = f THEN 'repeated' ELSE 'conflict' END AS result, count(*)::BIGINT AS n FROM e GROUP BY 1, 2")
def _(spark, d):
    e = src.table(spark, d, "events").select(F.col("user_id").cast("string").alias("observation_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("digest"))
    return flows.first_observations(e).groupBy("observation_id", "result").agg(F.count("*").alias("n"))


_FLOW = """WITH e AS (SELECT (o_custkey % 20)::VARCHAR AS account, CAST(o_orderdate AS DATE) AS batch, (o_orderkey % 500)::VARCHAR AS transfer_id, CASE WHEN o_orderkey % 61 = 0 THEN '12.5' ELSE (o_orderkey % 7)::VARCHAR || '.25' END AS amount,
  CASE WHEN o_orderstatus = 'F' THEN 'settled' ELSE 'pending' END AS status, o_orderdate AS observed_at, CASE WHEN o_orderkey % 83 = 0 THEN 'loan' ELSE 'deposit' END AS direction FROM orders),
f AS (SELECT *, concat_ws(',', CASE WHEN NOT regexp_full_match(amount, '(0|[1-9][0-9]{0,12})\\.[0-9]{2}') THEN 'bad_amount' END, CASE WHEN direction NOT IN ('deposit', 'withdrawal') THEN 'bad_direction' END) AS faults FROM e)"""


def _flow_events(spark, d):
    k = F.col("o_orderkey")
    e = src.table(spark, d, "orders").select((F.col("o_custkey") % 20).cast("string").alias("account"), F.to_date("o_orderdate").alias("batch"), (k % 500).cast("string").alias("transfer_id"), F.when(k % 61 == 0, "12.5").otherwise(F.concat((k % 7).cast("string"), F.lit(".25"))).alias("amount"), F.when(F.col("o_orderstatus") == "F", "settled").otherwise("pending").alias("status"), F.col("o_orderdate").cast("timestamp").alias("observed_at"), F.when(k % 83 == 0, "loan").otherwise("deposit").alias("direction"))
    e = e.withColumns({"currency": F.lit("USD"), "source_id": F.lit("bank"), "effective_at": F.col("observed_at")})
    return flows.event_faults(e, ["bank"], F.lit("2030-01-01").cast("timestamp"))


@query("st_09_event_faults", "", _FLOW + " SELECT faults, count(*)::BIGINT AS n FROM f GROUP BY 1")
def _(spark, d):
    return _flow_events(spark, d).groupBy("faults").agg(F.count("*").alias("n"))


@query("st_08_journal", "", _FLOW + ", b AS (SELECT account, batch FROM f GROUP BY 1, 2 HAVING max(faults) = ''), p AS (SELECT account, transfer_id, count(DISTINCT amount) AS k, min(amount) AS amount, max((status = 'settled')::INT) AS s, min(observed_at) FILTER (WHERE status = 'settled') AS settled_at, max(observed_at) FILTER (WHERE status = 'pending') AS pe FROM f JOIN b USING (account, batch) GROUP BY 1, 2) SELECT account, transfer_id, CASE WHEN k = 1 THEN amount END AS amount, CASE WHEN k > 1 THEN 'conflict' WHEN pe > settled_at THEN 'reverted' WHEN s = 1 THEN 'settled' ELSE 'pending' END AS state FROM p")
def _(spark, d):
    return flows.journal(_flow_events(spark, d)).drop("settled_at")


@query("st_08_quarantined", "", _FLOW + " SELECT account, batch, count(*)::BIGINT AS events, count(*) FILTER (WHERE faults <> '')::BIGINT AS faulty FROM f GROUP BY 1, 2 HAVING count(*) FILTER (WHERE faults <> '') > 0")
def _(spark, d):
    return flows.quarantined(_flow_events(spark, d))


@query("st_03_order_gate", "", "WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 31 = 0 AS stale, l_orderkey % 37 = 0 AS killed, l_orderkey % 41 <> 0 AS reconciled, l_quantity AS quantity, (l_partkey % 30)::DOUBLE AS held, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_extendedprice / l_quantity AS price, l_suppkey % 7 = 0 AS reduce_only, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS repeats FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN stale THEN 'stale_state' WHEN killed THEN 'killed' WHEN NOT reconciled THEN 'not_reconciled' WHEN side = 'sell' AND held < quantity THEN 'short_sale' WHEN reduce_only AND side = 'buy' THEN 'reduce_only' WHEN price <= 0 THEN 'no_price' WHEN side = 'buy' AND (held + quantity) * price > 60000.123::DOUBLE THEN 'position_share' WHEN repeats > 1 THEN 'duplicate_id' ELSE 'allowed' END AS decision FROM o")
def _(spark, d):
    k = F.col("l_orderkey")
    o = src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(k % 31 == 0, "late").otherwise("fresh").alias("fresh"), (k % 37 == 0).alias("killed"), (k % 41 != 0).alias("reconciled"), F.col("l_quantity").alias("quantity"), (F.col("l_partkey") % 30).cast("double").alias("held"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_suppkey") % 7 == 0).alias("reduce_only"), F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber")).alias("repeats"), F.lit(60000.123).alias("equity"))
    return flows.order_gate(o, most_share=1.0).select("l_orderkey", "l_linenumber", "l_partkey", "decision")


# helpers on columns


@query("aux_01_close_panel", "bars", " SELECT date, " + ", ".join(f"max(close) FILTER (WHERE ticker = 'Brand#{i}') AS \"Brand#{i}\"" for i in (1, 2, 3)) + " FROM bars GROUP BY 1")
def _(spark, d):
    from tidemark.operators.joins import close_panel

    return close_panel(src.bars(spark, d), [f"Brand#{i}" for i in (1, 2, 3)])


@query("aux_03_endpoints", "bars", f" SELECT ticker, date, lead(open) OVER ({_W}) AS entry, lead(open, 6) OVER ({_W}) AS exit FROM bars")
def _(spark, d):
    return tables.executable_endpoints(src.bars(spark, d), 5)


@query("aux_04_excess", "panel", _FR + f" SELECT ticker, date, round(r - {_RF} / 252, 9) AS excess FROM fr")
def _(spark, d):
    return rounded(tables.excess_returns(_returns(spark, d)).select("ticker", "date", "excess"), 9)


@query("aux_09_covered_closes", "sessions second_source", " SELECT b.ticker, b.date, b.close FROM second_source b JOIN sessions USING (date) WHERE b.date BETWEEN DATE '1995-03-01' AND DATE '1997-03-01'")
def _(spark, d):
    b = src.bars(spark, d)
    return joins.covered(src.second_source(b), src.sessions_of(spark, b), "1995-03-01", "1997-03-01").select("ticker", "date", "close")
