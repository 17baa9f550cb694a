"""Queries over signals, sizing, simulation, folds, models, statistics, ledgers and guards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import bias, folds, joins, ledger, models, signals, simulate, sizing
from tidemark.operators import calendar as cal
from tidemark.operators import windows as win
from tidemark.plans.registry import query, rounded
from tidemark.plans.research import _LR, _SMA, _W, _roll, win_02
from tidemark.sources import frames as src
from tidemark.streaming import guards

_SECTORS = [f"Brand#{i}" for i in range(10, 19)]
_SAFE = "Brand#1"
_IN = "ticker IN (" + ", ".join(f"'{t}'" for t in _SECTORS) + ")"


def _panel(spark, d):
    return src.panel(spark, src.bars(spark, d))


def _weekly(spark, d):
    """The panel with the last close carried over gaps: most sessions of the derived bars have no trade in a ticker."""
    return win.marks(_panel(spark, d)).withColumn("close", F.col("mark")).drop("mark")


_FILLED = f""", filled AS (SELECT session_no, date, ticker, last_value(close IGNORE NULLS) OVER ({_W}) AS close FROM panel)"""
_OBS = lambda n: f"count(close) OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n}"
_RET = lambda a, b=0: f"(lag(close, {b}) OVER ({_W}) / lag(close, {a}) OVER ({_W}) - 1)"

# top-k and selections

for _m in (3, 6, 12):

    @query(f"win_14_momentum_h1_{_m}", "panel", _FILLED + f" SELECT ticker, date, coalesce({_OBS(21 * _m + 1)} AND {_RET(21 * _m, 21)} > 0, false) AS held FROM filled")
    def _(spark, d, m=_m):
        return signals.momentum(_weekly(spark, d), m).select("ticker", "date", "held")


for _n in (100, 200):

    @query(f"win_15_trend_h2_{_n}", "panel", _FILLED + f" SELECT ticker, date, coalesce({_OBS(_n)} AND round(close - {_roll('avg', 'close', _n)}, 9) > 0, false) AS held FROM filled")
    def _(spark, d, n=_n):
        return signals.trend(_weekly(spark, d), n).select("ticker", "date", "held")


_TOPK = lambda k, way: f"""k AS (SELECT *, eligible AND sum(eligible::INT) OVER (PARTITION BY date) >= {k} AND row_number() OVER (PARTITION BY date, eligible ORDER BY score {way}, ticker) <= {k} AS held FROM e)
SELECT ticker, date, coalesce(held, false) AS held FROM k"""  # noqa: E731

for _k in (3, 5):

    @query(f"top_02_cross_momentum_h3_{_k}", "panel", _FILLED + f", e AS (SELECT ticker, date, {_RET(252, 21)} AS score, {_OBS(253)} AS eligible FROM filled), " + _TOPK(_k, "DESC NULLS LAST"))
    def _(spark, d, k=_k):
        return signals.cross_momentum(_weekly(spark, d), k).select("ticker", "date", "held")


@query("top_07_risk_parity_h4", "panel", _FILLED + f" SELECT ticker, date, {_OBS(61)} AS held FROM filled")
def _(spark, d):
    return signals.risk_parity(_weekly(spark, d)).select("ticker", "date", "held")


for _m in (6, 12):

    @query(
        f"top_03_dual_momentum_h6_{_m}",
        "panel",
        _FILLED
        + f""", e AS (SELECT ticker, date, {_RET(21 * _m)} AS score, {_OBS(21 * _m + 1)} AS eligible FROM filled),
w AS (SELECT date, ticker, score FROM e WHERE eligible AND ticker <> '{_SAFE}' QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) = 1),
s AS (SELECT e.date, e.eligible, coalesce(e.eligible AND w.score > e.score, false) AS beats, w.ticker AS best FROM e LEFT JOIN w USING (date) WHERE e.ticker = '{_SAFE}')
SELECT e.ticker, e.date, CASE WHEN e.ticker = '{_SAFE}' THEN s.eligible AND NOT s.beats ELSE coalesce(s.beats AND s.best = e.ticker, false) END AS held FROM e JOIN s USING (date)""",
    )
    def _(spark, d, m=_m):
        return signals.dual_momentum(_weekly(spark, d), m, _SAFE).select("ticker", "date", "held")


@query("top_06_reversal_h8", "panel", _FILLED + f", e AS (SELECT ticker, date, {_RET(5)} AS score, {_OBS(6)} AS eligible FROM filled WHERE {_IN}), " + _TOPK(3, "ASC NULLS FIRST"))
def _(spark, d):
    return signals.reversal(_weekly(spark, d), _SECTORS).select("ticker", "date", "held")


@query("top_05_low_volatility_h7", "panel", _FILLED + f", r AS (SELECT *, {_LR} AS r FROM filled WHERE {_IN}), e AS (SELECT ticker, date, round({_roll('stddev_samp', 'r', 60)}, 9) AS score, {_OBS(61)} AS eligible FROM r), " + _TOPK(3, "ASC NULLS FIRST"))
def _(spark, d):
    r = F.col("log_return")
    from tidemark.functions.columns import full

    scored = win.panel_log_returns(_weekly(spark, d).where(F.col("ticker").isin(_SECTORS)))
    scored = scored.withColumns({"score": F.round(full(F.stddev_samp(r), r, win.by_ticker(), 60), 9), "eligible": win.observed_window(61)})
    return signals.top_k(scored, "score", "eligible", 3, highest=False).select("ticker", "date", "held")


@query(
    "top_09_universe",
    "bars",
    """, v AS (SELECT ticker, CAST(substr(ticker, 7) AS INT) % 4 AS class, sum(volume)::BIGINT AS volume FROM bars GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY volume DESC, ticker) AS in_class FROM v), c AS (SELECT *, row_number() OVER (ORDER BY (in_class > 1)::INT, volume DESC, ticker) AS place FROM r WHERE in_class <= 3)
SELECT ticker, class, volume, place::INT AS place FROM c WHERE place <= 10""",
)
def _(spark, d):
    return signals.select_universe(src.bars(spark, d).groupBy("ticker").agg(F.sum("volume").cast("long").alias("volume")).withColumn("class", F.substring("ticker", 7, 9).cast("int") % 4), size=10, class_cap=3)


# signals


@query("sig_01_buy_and_hold", "bars", f"SELECT ticker, date, row_number() OVER ({_W}) = 2 AS buy_next_open, false AS sell_next_open FROM bars")
def _(spark, d):
    return signals.buy_and_hold(src.bars(spark, d)).select("ticker", "date", "buy_next_open", "sell_next_open")


_U = "(CAST('0x' || substr(md5('7|' || ticker || '|' || CAST(date AS VARCHAR)), 1, 13) AS UBIGINT)::DOUBLE / 4503599627370496.0::DOUBLE)"
_DECIDES = "decisions AS (SELECT date, coalesce(year(date) * 12 + month(date) <> lag(year(date) * 12 + month(date)) OVER (ORDER BY date), false) AS decides FROM sessions)"


@query(
    "sig_03_random_selection",
    "panel",
    f""", {_DECIDES}, step AS (SELECT p.ticker, p.date, p.close, row_number() OVER (PARTITION BY p.ticker ORDER BY p.date) AS k, {_U} AS u FROM panel p JOIN decisions d USING (date) WHERE d.decides),
chain AS (WITH RECURSIVE c AS (SELECT ticker, date, k, u < 0.5 AS long FROM step WHERE k = 1
  UNION ALL SELECT s.ticker, s.date, s.k, CASE WHEN c.long THEN s.u >= 0.4 ELSE s.u < 0.45 END FROM c JOIN step s ON s.ticker = c.ticker AND s.k = c.k + 1) SELECT * FROM c)
SELECT p.ticker, p.date, coalesce(p.close IS NOT NULL AND last_value(c.long IGNORE NULLS) OVER (PARTITION BY p.ticker ORDER BY p.date), false) AS held FROM panel p LEFT JOIN chain c ON c.ticker = p.ticker AND c.date = p.date""".replace("chain AS (WITH RECURSIVE c AS", "chain AS (WITH RECURSIVE c AS"),
)
def random_selection(spark, d):
    p = _panel(spark, d)
    decisions = cal.decision_sessions(src.sessions_of(spark, src.bars(spark, d)), "monthly")
    return signals.random_selection(p, decisions, enter=0.45, leave=0.4, start=0.5, seed=7).select("ticker", "date", "held")


@query("sig_05_cost_hurdle", "bars", "SELECT ticker, date, round((2 * 0.0005::DOUBLE + 2.0::DOUBLE / (10 * open)) / (1 - 0.0005::DOUBLE), 8) AS hurdle, round(ln(1 + (2 * 0.0005::DOUBLE + 2.0::DOUBLE / (10 * open)) / (1 - 0.0005::DOUBLE)), 8) AS log_hurdle FROM bars")
def _(spark, d):
    h = signals.cost_hurdle(F.col("open"), 1.0, 5.0, 10)
    return rounded(src.bars(spark, d).select("ticker", "date", h.alias("hurdle"), F.log1p(h).alias("log_hurdle")), 8)


_POS = f""", p AS (SELECT ticker, date, open, {_LR} AS prediction, 0.05::DOUBLE AS hurdle FROM bars),
st AS (SELECT *, CASE WHEN prediction IS NULL OR prediction < -0.05 THEN false WHEN prediction > hurdle THEN true END AS s FROM p),
pos AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER ({_W}), false) AS desired_long FROM st),
mv AS (SELECT *, desired_long AND NOT coalesce(lag(desired_long) OVER ({_W}), false) AS i, NOT desired_long AND coalesce(lag(desired_long) OVER ({_W}), false) AS o FROM pos)"""


def _positions(spark, d):
    b = src.bars(spark, d).withColumns({"prediction": F.log(F.col("close") / F.lag("close").over(win.by_ticker())), "hurdle": F.lit(0.05)})
    return signals.hysteresis_positions(b, -0.05)


@query("sig_07_hysteresis", "bars", _POS + " SELECT ticker, date, desired_long FROM pos")
def _(spark, d):
    return _positions(spark, d).select("ticker", "date", "desired_long")


@query("sig_09_orders", "bars", _POS + f" SELECT ticker, date, coalesce(lag(i) OVER ({_W}), false) AS buy_next_open, coalesce(lag(o) OVER ({_W}), false) AS sell_next_open FROM mv")
def _(spark, d):
    return signals.orders_of(_positions(spark, d)).select("ticker", "date", "buy_next_open", "sell_next_open")


@query(
    "agg_10_matched_activity",
    "panel",
    _FILLED
    + f""", h AS (SELECT ticker, date, close, coalesce({_OBS(100)} AND round(close - {_roll('avg', 'close', 100)}, 9) > 0, false) AS held FROM filled), {_DECIDES},
r AS (SELECT h.*, close IS NOT NULL AS present FROM h JOIN decisions USING (date) WHERE decides), l AS (SELECT *, lag(held) OVER ({_W}) AS was, present AND coalesce(lag(present) OVER ({_W}), false) AS both_ FROM r)
SELECT round(count(*) FILTER (WHERE both_ AND NOT was AND held) / count(*) FILTER (WHERE both_ AND NOT was), 6) AS enter_probability, round(count(*) FILTER (WHERE both_ AND was AND NOT held) / count(*) FILTER (WHERE both_ AND was), 6) AS exit_probability,
  round(count(*) FILTER (WHERE held) / count(*) FILTER (WHERE present), 6) AS initial_probability FROM l""",
)
def _(spark, d):
    held = signals.trend(_weekly(spark, d), 100)
    decisions = cal.decision_sessions(src.sessions_of(spark, src.bars(spark, d)), "monthly")
    return rounded(signals.matched_activity(held.join(F.broadcast(decisions.select("date", "decides")), "date")))


# sizing

_HELD = _FILLED + f", sel AS (SELECT ticker, date, close, coalesce({_OBS(100)} AND round(close - {_roll('avg', 'close', 100)}, 9) > 0, false) AS held FROM filled)"


@query("pf_09_equal_weight", "panel", _HELD + " SELECT ticker, date, CASE WHEN held THEN round(0.93::DOUBLE / sum(held::INT) OVER (PARTITION BY date), 6) ELSE 0 END AS weight FROM sel")
def _(spark, d):
    return rounded(sizing.equal_weight(signals.trend(_weekly(spark, d), 100), 0.93).select("ticker", "date", "weight"))


@query("pf_10_fixed_allocation", "panel", "SELECT ticker, date, CASE WHEN count(close) FILTER (WHERE ticker IN ('Brand#2', 'Brand#3')) OVER (PARTITION BY date) = 2 THEN CASE ticker WHEN 'Brand#2' THEN 0.6::DOUBLE WHEN 'Brand#3' THEN 0.4::DOUBLE ELSE 0 END ELSE 0 END AS weight FROM panel")
def _(spark, d):
    return sizing.fixed_allocation(_panel(spark, d), {"Brand#2": 0.6, "Brand#3": 0.4}).select("ticker", "date", "weight")


@query(
    "pf_11_blend",
    "panel",
    _HELD + " SELECT ticker, date, round((CASE WHEN held THEN 0.93::DOUBLE / sum(held::INT) OVER (PARTITION BY date) ELSE 0 END + CASE WHEN count(close) FILTER (WHERE ticker IN ('Brand#2', 'Brand#3')) OVER (PARTITION BY date) = 2 THEN CASE ticker WHEN 'Brand#2' THEN 0.6::DOUBLE WHEN 'Brand#3' THEN 0.4::DOUBLE ELSE 0 END ELSE 0 END) / 2, 6) AS weight FROM sel",
)
def _(spark, d):
    p = _weekly(spark, d)
    return rounded(sizing.blend(sizing.equal_weight(signals.trend(p, 100), 0.93), sizing.fixed_allocation(p, {"Brand#2": 0.6, "Brand#3": 0.4})))


_VOL = _FILLED + f", fr AS (SELECT *, {_LR} AS r FROM filled), fv AS (SELECT *, {_roll('stddev_samp', 'r', 20)} * sqrt(252) AS vol FROM fr), ft AS (SELECT *, CASE WHEN vol > 0 THEN 0.1::DOUBLE / vol ELSE 0 END AS w FROM fv)"


def _vol_weights(spark, d):
    v = win.realized_volatility(_weekly(spark, d), 20)
    return v.withColumn("weight", sizing.volatility_target(F.lit(1.0), F.when(F.col("volatility") > 1e-9, F.col("volatility")), 0.1))


@query("pf_01_volatility_target", "panel", _VOL.replace("vol > 0", "vol > 1e-9") + " SELECT ticker, date, round(w, 5) AS weight FROM ft")
def _(spark, d):
    return rounded(_vol_weights(spark, d).select("ticker", "date", "weight"), 5)


@query("pf_04_gross_cap", "panel", _VOL.replace("vol > 0", "vol > 1e-9") + " SELECT ticker, date, round(CASE WHEN sum(w) OVER (PARTITION BY date) > 0.2 THEN w * 0.2::DOUBLE / sum(w) OVER (PARTITION BY date) ELSE w END, 5) AS weight FROM ft")
def _(spark, d):
    w = _vol_weights(spark, d)
    return rounded(w.select("ticker", "date", sizing.gross_cap(F.col("weight"), 0.2).alias("weight")), 5)


@query("pf_05_entry_halt", "", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN least(l_discount, l_tax) ELSE l_discount END AS weight FROM lineitem")
def _(spark, d):
    w = sizing.entry_halt(F.col("l_discount"), F.col("l_tax"), F.col("l_returnflag") == "R")
    return src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", w.alias("weight"))


_PAIRS = _FILLED + f""", fr AS (SELECT *, {_LR} AS r FROM filled),
pr AS (SELECT a.session_no, a.date, a.ticker AS a, b.ticker AS b, a.r AS x, b.r AS y FROM fr a JOIN fr b ON a.session_no = b.session_no AND a.ticker <= b.ticker),
cv AS (SELECT date, a, b, CASE WHEN count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) OVER w = 60 THEN (avg(x * y) OVER w - avg(x) OVER w * avg(y) OVER w) * (60.0::DOUBLE / 59 * 252) END AS cov FROM pr WINDOW w AS (PARTITION BY a, b ORDER BY session_no ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""


@query("win_10_pair_covariance", "panel", _PAIRS + " SELECT date, a, b, round(cov, 5) AS cov FROM cv")
def _(spark, d):
    return rounded(sizing.pair_covariance(win.panel_log_returns(_weekly(spark, d)), 60), 5)


@query(
    "pf_07_volatility_target_book",
    "panel",
    _PAIRS
    + f""", sel AS (SELECT ticker, date, {_OBS(61)} AS held FROM filled), leg AS (SELECT s.ticker, s.date, CASE WHEN s.held AND c.cov > 0 THEN 1 / sqrt(c.cov) ELSE 0 END AS leg FROM sel s LEFT JOIN cv c ON c.date = s.date AND c.a = s.ticker AND c.b = s.ticker),
rk AS (SELECT c.date, sum(CASE WHEN c.a = c.b THEN 1 ELSE 2 END * x.leg * y.leg * c.cov) AS risk, count(c.cov) AS n FROM cv c JOIN leg x ON x.date = c.date AND x.ticker = c.a AND x.leg > 0 JOIN leg y ON y.date = c.date AND y.ticker = c.b AND y.leg > 0 GROUP BY 1),
kk AS (SELECT date, count(*) AS k FROM leg WHERE leg > 0 GROUP BY 1), sc AS (SELECT l.ticker, l.date, coalesce(CASE WHEN r.n = k.k * (k.k + 1) / 2 AND r.risk > 0 THEN l.leg * 0.1::DOUBLE / sqrt(r.risk) END, 0) AS w FROM leg l LEFT JOIN rk r USING (date) LEFT JOIN kk k USING (date))
SELECT ticker, date, round(CASE WHEN sum(w) OVER (PARTITION BY date) > 1 THEN w / sum(w) OVER (PARTITION BY date) ELSE w END, 5) AS weight FROM sc""",
)
def _(spark, d):
    p = _weekly(spark, d)
    return rounded(sizing.volatility_target_of_returns(signals.risk_parity(p), win.panel_log_returns(p), 60, 0.1, 1.0), 5)


# simulation

_RUN = _SMA + ", runs AS (SELECT ticker AS run, date, open, close, buy_next_open, sell_next_open FROM sig)"


def _crossings(spark, d):
    s = win.sma_crossover(src.bars(spark, d)).withColumnRenamed("ticker", "run")
    return s.select("run", "date", "open", "close", "buy_next_open", "sell_next_open")


_TRADES = """, o AS (SELECT run, date, open, buy_next_open AS b FROM runs WHERE buy_next_open OR sell_next_open), t AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY run ORDER BY date), false) AS was FROM o),
n AS (SELECT run, b, date AS entry, lead(date) OVER (PARTITION BY run ORDER BY date) AS exit, lead(open) OVER (PARTITION BY run ORDER BY date) - open AS pnl FROM t WHERE b <> was), trades AS (SELECT run, entry, exit, pnl FROM n WHERE b AND exit IS NOT NULL)"""


@query("sim_01_paired_trades", "bars", _RUN + _TRADES + " SELECT run, entry, exit, round(pnl, 6) AS pnl FROM trades")
def _(spark, d):
    return rounded(simulate.paired_trades(_crossings(spark, d)))


@query("agg_01_trade_summary", "bars", _RUN + _TRADES + " SELECT run, count(*)::BIGINT AS n_trades, round(sum(pnl), 4) AS total_pnl, round(avg((pnl > 0)::INT), 6) AS win_rate FROM trades GROUP BY 1")
def _(spark, d):
    return rounded(agg.trade_summary(simulate.paired_trades(_crossings(spark, d)), "run"), 6, total_pnl=4)


@query("sim_01_funded_ledger")
def funded(spark, d):
    acted = joins.actions_onto_bars(src.bars(spark, d), src.actions(spark, d))
    rows = win.sma_crossover(acted).withColumns({"run": F.col("ticker"), "pay_date": F.date_add("date", 30)})
    return simulate.funded_ledger(rows, capital=250_000.0, shares=1, commission=1.0, bps=5.0)


@query("sim_02_portfolio")
def portfolio(spark, d):
    p = _panel(spark, d)
    decisions = cal.decision_sessions(src.sessions_of(spark, src.bars(spark, d)), "monthly").select("date", "decides")
    book = sizing.equal_weight(signals.trend(_weekly(spark, d), 100), 0.93).select("ticker", "date", "weight")
    rows = p.join(F.broadcast(decisions), "date").join(book, ["ticker", "date"])
    rows = rows.withColumns({"weight": F.when(F.col("decides") & F.col("close").isNotNull(), F.col("weight")).when(F.col("decides"), F.lit(0.0)), "run": F.lit("h2_100"), "cost": F.lit(0.001)})
    return simulate.portfolio(rows, capital=100_000.0, commission=1.0)


# folds and models

_FOLD_ARGS = {"train_months": 13, "test_months": 12, "horizon": 6, "embargo": 21}


_BOUNDS = """, span AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM bars GROUP BY 1),
bounds AS (SELECT ticker, n::INT AS fold, (lo + to_months(13) + to_months((12 * n)::INT))::DATE AS a, (lo + to_months(13) + to_months((12 * n + 12)::INT))::DATE AS z FROM span, range(60) AS t(n)),
pos AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS p FROM bars),
te AS (SELECT x.ticker, b.fold, x.date, x.p FROM pos x JOIN bounds b ON x.ticker = b.ticker AND x.date >= b.a AND x.date < b.z), wn AS (SELECT ticker, fold, min(p) AS f, max(p) + 1 AS g FROM te GROUP BY 1, 2),
tr AS (SELECT x.ticker, w.fold, x.date, x.p FROM pos x JOIN wn w ON x.ticker = w.ticker AND x.p < w.f - 6 WHERE NOT EXISTS (SELECT 1 FROM wn e WHERE e.ticker = x.ticker AND e.fold < w.fold AND x.p >= e.g AND x.p < e.g + 21))"""


@query("ml_01_walk_forward", "bars", _BOUNDS + " SELECT ticker, fold, date, p::INT AS position, 'train' AS role FROM tr UNION ALL SELECT ticker, fold, date, p::INT, 'test' FROM te WHERE (ticker, fold) IN (SELECT DISTINCT ticker, fold FROM tr)")
def _(spark, d):
    return folds.walk_forward(src.bars(spark, d), **_FOLD_ARGS)


@query(
    "ml_02_inner_splits",
    "bars",
    _BOUNDS
    + """, ip AS (SELECT ticker, fold AS o, date, row_number() OVER (PARTITION BY ticker, fold ORDER BY date) - 1 AS p FROM tr),
it AS (SELECT x.ticker, x.o, b.fold, x.date, x.p FROM ip x JOIN bounds b ON x.ticker = b.ticker AND x.date >= b.a AND x.date < b.z), iw AS (SELECT ticker, o, fold, min(p) AS f, max(p) + 1 AS g, max(date) AS hi FROM it GROUP BY 1, 2, 3),
ir AS (SELECT w.ticker, w.o, w.fold, count(*) AS n, max(x.date) AS last FROM ip x JOIN iw w ON x.ticker = w.ticker AND x.o = w.o AND x.p < w.f - 6 WHERE NOT EXISTS (SELECT 1 FROM iw e WHERE e.ticker = x.ticker AND e.o = x.o AND e.fold < w.fold AND x.p >= e.g AND x.p < e.g + 21) GROUP BY 1, 2, 3)
SELECT w.ticker, w.o AS outer_fold, w.fold, r.n::BIGINT AS train_rows, r.last AS train_last, (SELECT count(*) FROM it WHERE it.ticker = w.ticker AND it.o = w.o AND it.fold = w.fold)::BIGINT AS test_rows, w.hi AS test_last FROM iw w JOIN ir r ON w.ticker = r.ticker AND w.o = r.o AND w.fold = r.fold""",
)
def _(spark, d):
    inner = folds.walk_forward(folds.inner_frames(folds.walk_forward(src.bars(spark, d), **_FOLD_ARGS)), keys=["ticker", "outer_fold"], **_FOLD_ARGS)
    measures = [f(F.when(F.col("role") == r, F.col("date"))).alias(f"{r}_{n}") for r in ("train", "test") for n, f in (("rows", F.count), ("last", F.max))]
    return inner.groupBy("ticker", "outer_fold", "fold").agg(*measures)


def _fold_rows(spark, d, label):
    f = win.features(src.bars(spark, d)).withColumn("label", label)
    return folds.walk_forward(f, **_FOLD_ARGS).join(f.drop("open", "high", "low", "close", "volume"), ["ticker", "date"])


def _nested(spark, d, name, label):
    outer = folds.walk_forward(src.bars(spark, d), **_FOLD_ARGS)
    inner = folds.fold_windows(folds.inner_frames(outer), train_months=13, test_months=12, keys=["ticker", "outer_fold"])
    return models.walk_forward_predictions(_fold_rows(spark, d, label), name, _COLUMNS, _FOLD_ARGS["horizon"], _FOLD_ARGS["embargo"], inner)


_COLUMNS = ["log_return", "volatility", "sma_spread", "close_to_short", "relative_volume"]


@query("ml_08_nested_ridge")
def _(spark, d):
    return _nested(spark, d, "ridge", F.col("label"))


@query("ml_08_nested_logistic")
def _(spark, d):
    return _nested(spark, d, "logistic", (F.col("label") > 0).cast("double"))


_FEAT = f""", fa AS (SELECT *, {_LR} AS lr, {_roll("avg", "close", 10)} AS s, ln(lead(open, 6) OVER ({_W}) / lead(open) OVER ({_W})) AS label FROM bars), ff AS (SELECT ticker, date, lr, close / s - 1 AS cts, label FROM fa),
known AS (SELECT * FROM ff WHERE lr IS NOT NULL AND cts IS NOT NULL AND label IS NOT NULL)"""


@query(
    "ml_06_walk_forward_ridge",
    "bars",
    _FEAT
    + _BOUNDS
    + """, k AS (SELECT tr.fold, n.* FROM tr JOIN known n ON n.ticker = tr.ticker AND n.date = tr.date),
m AS (SELECT ticker, fold, count(*) AS n, avg(lr) AS ma, avg(cts) AS mb, avg(label) AS mt, stddev_pop(lr) AS sa, stddev_pop(cts) AS sb, covar_pop(lr, cts) AS ab, covar_pop(lr, label) AS lt, covar_pop(cts, label) AS ct FROM k GROUP BY 1, 2),
c AS (SELECT *, n * ab / (sa * sb) AS o, n * lt / sa AS u, n * ct / sb AS v FROM m), w AS (SELECT *, (u * (n + 1) - v * o) / ((n + 1) * (n + 1) - o * o) AS wa, (v * (n + 1) - u * o) / ((n + 1) * (n + 1) - o * o) AS wb FROM c)
SELECT w.ticker, w.fold, x.date, round(mt + wa * (lr - ma) / sa + wb * (cts - mb) / sb, 9) + 0.0 AS prediction FROM w JOIN te ON te.ticker = w.ticker AND te.fold = w.fold JOIN ff x ON x.ticker = te.ticker AND x.date = te.date WHERE lr IS NOT NULL AND cts IS NOT NULL""",
)
def _(spark, d):
    return rounded(models.walk_forward_predictions(_fold_rows(spark, d, F.col("label")), "ridge", ["log_return", "close_to_short"]).select("ticker", "fold", "date", "prediction"), 9)


@query(
    "ml_05_normal_equations",
    "bars",
    _FEAT
    + """, m AS (SELECT ticker, count(*) AS n, covar_pop(lr, lr) AS aa, covar_pop(cts, cts) AS bb, covar_pop(lr, cts) AS ab, covar_pop(lr, label) AS a_t, covar_pop(cts, label) AS b_t FROM known GROUP BY 1)
SELECT ticker, n::BIGINT AS n, round((a_t * bb - b_t * ab) / (aa * bb - ab * ab), 5) AS beta_1, round((b_t * aa - a_t * ab) / (aa * bb - ab * ab), 5) AS beta_2 FROM m""",
)
def _(spark, d):
    return rounded(models.normal_equations(win_02_raw(spark, d), "ticker", ["log_return", "close_to_short"], "label"), 5)


def win_02_raw(spark, d):
    return win.features(src.bars(spark, d))


@query(
    "ml_12_paired_counts",
    "bars",
    _FEAT
    + """ SELECT ticker, count(*) FILTER (WHERE ra AND rb)::BIGINT AS "both", count(*) FILTER (WHERE ra AND NOT rb)::BIGINT AS only_a, count(*) FILTER (WHERE NOT ra AND rb)::BIGINT AS only_b, count(*) FILTER (WHERE NOT ra AND NOT rb)::BIGINT AS neither
FROM (SELECT ticker, (lr > 0) = (label > 0) AS ra, (cts > 0) = (label > 0) AS rb FROM known) GROUP BY 1""",
)
def _(spark, d):
    f = win_02_raw(spark, d).dropna(subset=["log_return", "close_to_short", "label"])
    rows = f.select("ticker", *[(F.col(c) > 0).alias(n) for c, n in (("label", "label"), ("log_return", "a"), ("close_to_short", "b"))])
    return models.paired_counts(rows, "ticker")


@query(
    "ml_13_signed_ranks",
    "",
    """, d AS""".replace(", d AS", "WITH d AS")
    + """ (SELECT l_shipmonth, x FROM (SELECT month(l_shipdate)::INT AS l_shipmonth, CAST(round((l_discount - l_tax) * 100) AS INT) AS x FROM lineitem) WHERE x <> 0),
r AS (SELECT l_shipmonth, x, rank() OVER (PARTITION BY l_shipmonth ORDER BY abs(x)) + (count(*) OVER (PARTITION BY l_shipmonth, abs(x)) - 1) / 2.0::DOUBLE AS r FROM d)
SELECT l_shipmonth, count(*)::BIGINT AS n, sum(CASE WHEN x > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN x < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY 1""",
)
def _(spark, d):
    rows = src.table(spark, d, "lineitem").select(F.month("l_shipdate").alias("l_shipmonth"), F.round((F.col("l_discount") - F.col("l_tax")) * 100).cast("int").alias("difference"))
    return models.signed_ranks(rows, "l_shipmonth")


# statistics


def _returns(spark, d):
    return win.panel_log_returns(_weekly(spark, d)).where("log_return is not null")


_FR = _FILLED + f", fr AS (SELECT * FROM (SELECT *, {_LR} AS r FROM filled) WHERE r IS NOT NULL)"
_RF = "ln(1.04::DOUBLE)"


@query(
    "agg_17_return_stats",
    "panel",
    _FR
    + f""", m AS (SELECT ticker, avg(r) AS m FROM fr GROUP BY 1), c AS (SELECT fr.ticker, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, avg(pow(r - m, 2)) AS m2, avg(pow(r - m, 3)) AS m3, avg(pow(r - m, 4)) AS m4 FROM fr JOIN m USING (ticker) GROUP BY 1)
SELECT ticker, n::BIGINT AS n, round(m * 252, 6) AS annual_return, round(s * sqrt(252), 6) AS annual_volatility, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS excess_kurtosis, round((m * 252 - {_RF}) / (s * sqrt(252)), 6) AS sharpe FROM c""",
)
def _(spark, d):
    return rounded(agg.return_stats(_returns(spark, d), "ticker"))


@query(
    "agg_04_hac",
    "panel",
    _FR
    + f""", c AS (SELECT *, r - avg(r) OVER (PARTITION BY ticker) AS c FROM fr), l AS (SELECT *, c * lag(c, 1) OVER ({_W}) AS l1, c * lag(c, 2) OVER ({_W}) AS l2, c * lag(c, 3) OVER ({_W}) AS l3 FROM c),
s AS (SELECT ticker, count(*) AS n, avg(r) AS m, sum(c * c) + 2 * (0.75::DOUBLE * sum(l1) + 0.5::DOUBLE * sum(l2) + 0.25::DOUBLE * sum(l3)) AS v FROM l GROUP BY 1)
SELECT ticker, n::BIGINT AS n, round(m, 8) AS mean, round(sqrt(greatest(v / n, 0) / n), 8) AS se, round((m - {_RF} / 252) / sqrt(greatest(v / n, 0) / n), 5) AS t FROM s""",
)
def _(spark, d):
    return rounded(agg.hac(_returns(spark, d), "ticker", "date", 3), 8, t=5)


@query(
    "agg_06_max_drawdown",
    "equity",
    """, h AS (SELECT *, max(equity) OVER (PARTITION BY account ORDER BY session) AS high FROM equity), dd AS (SELECT *, equity / high - 1 AS x FROM h),
w AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY account ORDER BY x, session) = 1)
SELECT w.account, round(w.x, 8) AS max_drawdown, (SELECT max(e.session) FROM equity e WHERE e.account = w.account AND e.session < w.session AND e.equity = w.high AND w.x < 0) AS peak, w.session AS trough FROM w""",
)
def _(spark, d):
    return rounded(agg.max_drawdown(src.equity(spark, d)), 8)


@query("agg_29_autocorrelation", "panel", _FR + f", c AS (SELECT *, r - avg(r) OVER (PARTITION BY ticker) AS c FROM fr), l AS (SELECT *, c * lag(c, 1) OVER ({_W}) AS l1, c * lag(c, 2) OVER ({_W}) AS l2 FROM c) SELECT ticker, round(sum(l1) / sum(c * c), 6) AS acf1, round(sum(l2) / sum(c * c), 6) AS acf2 FROM l GROUP BY 1")
def _(spark, d):
    return rounded(agg.autocorrelation(_returns(spark, d), "ticker", "date", 2))


@query("agg_22_correlations", "bars", _FEAT + " SELECT 'log_return' AS a, 'close_to_short' AS b, round(corr(lr, cts), 6) AS correlation FROM known UNION ALL SELECT 'log_return', 'label', round(corr(lr, label), 6) FROM known UNION ALL SELECT 'close_to_short', 'label', round(corr(cts, label), 6) FROM known")
def _(spark, d):
    return rounded(agg.correlations(win_02_raw(spark, d), ["log_return", "close_to_short", "label"]))


@query("agg_28_fold_z_score", "", "SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderdate < DATE '1998-01-01')")
def _(spark, d):
    return rounded(agg.z_scores(src.table(spark, d, "orders"), "o_totalprice", F.col("o_orderdate") < F.lit("1998-01-01").cast("date")).select("o_orderkey", "z"))


@query("agg_38_distribution", "", "SELECT o_orderpriority, min(o_totalprice) AS least, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(abs(o_totalprice), 0.9), 4) AS q90_abs, max(o_totalprice) AS most, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _(spark, d):
    return rounded(agg.distribution(src.table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 4)


# selection bias


def _matrix(spark, d):
    r = win.panel_log_returns(_weekly(spark, d)).where("log_return is not null")
    return r.select(F.col("ticker").alias("trial"), F.col("date").alias("session"), F.col("log_return").alias("r"))


_MX = _FILLED + f""", mx AS (SELECT ticker AS trial, date AS session, r FROM (SELECT *, {_LR} AS r FROM filled) WHERE r IS NOT NULL),
sb AS (SELECT session, ntile(16) OVER (ORDER BY session) - 1 AS block FROM (SELECT DISTINCT session FROM mx)), ex AS (SELECT trial, block, r - {_RF} / 252 AS x FROM mx JOIN sb USING (session)),
bm AS (SELECT trial, block, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM ex GROUP BY 1, 2)"""
_CS = """, masks AS (SELECT i::INT AS mask FROM range(65536) t(i) WHERE bit_count(i) = 8), pk AS (SELECT mask, trial, (mask >> block) & 1 AS side, sum(n) AS n, sum(n * m) / sum(n) AS mean, sum(ss + n * m * m) AS q FROM masks, bm GROUP BY 1, 2, 3),
sh AS (SELECT mask, trial, side, mean / sqrt((q - n * mean * mean) / (n - 1)) AS s FROM pk), hv AS (SELECT mask, trial, max(s) FILTER (WHERE side = 1) AS inside, max(s) FILTER (WHERE side = 0) AS outside FROM sh GROUP BY 1, 2),
rc AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY inside DESC, trial) AS place, rank() OVER (PARTITION BY mask ORDER BY outside) + (count(*) OVER (PARTITION BY mask, outside) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY mask) AS m FROM hv),
rec AS (SELECT mask, trial AS winner, rk / (m + 1) AS rel, ln(rk / (m + 1) / (1 - rk / (m + 1))) AS logit, inside - outside AS degradation FROM rc WHERE place = 1)"""


@query("sb_07_block_moments", "panel", _MX + " SELECT trial, block::INT AS block, n::BIGINT AS n, round(m, 8) AS m, round(ss, 8) AS ss FROM bm")
def _(spark, d):
    return rounded(bias.block_moments(_matrix(spark, d)), 8)


@query("sb_06_splits", "panel", _MX + ", bs AS (SELECT block, count(*) AS n FROM sb GROUP BY 1) SELECT i::INT AS mask, sum(CASE WHEN (i >> block) & 1 = 1 THEN n ELSE 0 END)::BIGINT AS inside, sum(CASE WHEN (i >> block) & 1 = 0 THEN n ELSE 0 END)::BIGINT AS outside FROM range(65536) t(i), bs WHERE bit_count(i) = 8 GROUP BY 1")
def _(spark, d):
    return bias.split_sizes(_matrix(spark, d))


@query("sb_09_split_records", "panel", _MX + _CS + " SELECT mask, winner, round(rel, 6) AS relative_rank, round(logit, 6) AS logit, round(degradation, 6) AS degradation FROM rec")
def _(spark, d):
    return rounded(bias.split_records(bias.half_sharpes(_matrix(spark, d))))


@query("sb_10_pbo", "panel", _MX + _CS + " SELECT count(*)::BIGINT AS splits, round(count(*) FILTER (WHERE logit <= 0) / count(*), 6) AS pbo, round(avg(logit), 6) AS mean_logit, round(avg(degradation), 6) AS mean_degradation FROM rec")
def pbo(spark, d):
    return rounded(bias.overfit_probability(bias.split_records(bias.half_sharpes(_matrix(spark, d)))))


def _whole_matrix(spark, d):
    r = win.panel_log_returns(_weekly(spark, d)).where("log_return is not null")
    return r.select(F.col("ticker").alias("trial"), F.col("date").alias("session"), F.col("log_return").alias("r"))


# The queries above whose SQL takes six tickers, over all tickers and dates; without SQL.


@query("win_10_pair_covariance_whole")
def _(spark, d):
    return rounded(sizing.pair_covariance(win.panel_log_returns(_weekly(spark, d)), 60), 5)


@query("pf_07_volatility_target_book_whole")
def _(spark, d):
    w = _weekly(spark, d)
    return rounded(sizing.volatility_target_book(signals.risk_parity(w), sizing.pair_covariance(win.panel_log_returns(w), 60), 0.1, 1.0), 5)


@query("sb_02_trial_moments_whole")
def _(spark, d):
    return rounded(bias.trial_moments(_whole_matrix(spark, d)))


@query("sb_07_block_moments_whole")
def _(spark, d):
    return rounded(bias.block_moments(_whole_matrix(spark, d)), 8)


@query("sb_09_split_records_whole")
def _(spark, d):
    return rounded(bias.split_records(bias.half_sharpes(_whole_matrix(spark, d))))


@query("sb_10_pbo_whole")
def _(spark, d):
    return rounded(bias.overfit_probability(bias.split_records(bias.half_sharpes(_whole_matrix(spark, d)))))


@query(
    "sb_02_trial_moments",
    "panel",
    _MX
    + """, mm AS (SELECT trial, avg(x) AS m FROM ex GROUP BY 1), c AS (SELECT ex.trial, count(*) AS n, avg(x) / stddev_samp(x) AS sharpe, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM ex JOIN mm USING (trial) GROUP BY 1)
SELECT trial, n::BIGINT AS n, round(sharpe, 6) AS sharpe, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2), 6) AS kurtosis, round(stddev_samp(sharpe) OVER (), 6) AS spread FROM c""",
)
def _(spark, d):
    return rounded(bias.trial_moments(_matrix(spark, d)))


# ledger and guards

_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_HASH = "sha256(" + " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in _FIELDS) + ")"


@query("led_01_chain", "", f"SELECT o_custkey, o_orderkey, {_HASH} AS record_hash, lag({_HASH}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev_hash FROM orders")
def chain(spark, d):
    return ledger.chained(src.table(spark, d, "orders"), "o_custkey", "o_orderkey", _FIELDS).select("o_custkey", "o_orderkey", "record_hash", "prev_hash")


@query("led_01_verify", "", "SELECT o_custkey, o_orderkey, 'hash' AS fault FROM orders WHERE o_orderkey % 101 = 0")
def _(spark, d):
    whole = ledger.chained(src.table(spark, d, "orders"), "o_custkey", "o_orderkey", _FIELDS)
    forged = whole.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 101 == 0, "X").otherwise(F.col("o_orderstatus")))
    return ledger.verify(forged, "o_custkey", "o_orderkey", _FIELDS)


_WEEK = "isoyear(session) * 100 + weekofyear(session)"


@query(
    "st_02_loss_cap_history",
    "equity",
    f""", a AS (SELECT *, {_WEEK} AS wk, lag(equity) OVER (PARTITION BY account ORDER BY session) AS before FROM equity),
b AS (SELECT *, first_value(coalesce(before, equity)) OVER (PARTITION BY account, wk ORDER BY session) AS anchor, max(equity) OVER (PARTITION BY account, wk ORDER BY session) AS mx FROM a),
c AS (SELECT *, equity / before - 1 AS dr, equity / anchor - 1 AS wr, equity / greatest(anchor, mx) - 1 AS wd FROM b)
SELECT account, session, equity, round(dr, 8) AS daily_return, round(wr, 8) AS weekly_return, round(wd, 8) AS weekly_drawdown,
  coalesce(dr <= -0.02, false) OR max((wr <= -0.03 OR wd <= -0.04)::INT) OVER (PARTITION BY account, wk ORDER BY session) = 1 AS entries_halted FROM c""",
)
def _(spark, d):
    return rounded(guards.loss_cap_history(src.equity(spark, d), daily=0.02, weekly=0.03, drawdown=0.04), 8)


@query("st_13_changed_incidents", "", "SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def _(spark, d):
    e = src.table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("fingerprint"))
    return guards.changed_incidents(e).select("event_id")


@query("st_15_rolling_budget", "", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)::BIGINT AS used, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) <= 3 AS allowed FROM events")
def _(spark, d):
    return guards.rolling_budget(src.table(spark, d, "events"), "user_id", 24, 3).select("event_id", "used", "allowed")


@query("st_tumbling_windows", "", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1, 2")
def _(spark, d):
    return guards.tumbling(src.table(spark, d, "events"), "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st_sliding_windows", "", "SELECT start, event_type, count(*)::BIGINT AS n FROM (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) - to_hours((6 * k)::INT) AS start FROM events, range(4) t(k)) GROUP BY 1, 2")
def _(spark, d):
    return guards.sliding(src.table(spark, d, "events"), "1 day", "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "st_sessions",
    "",
    """SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s""",
)
def _(spark, d):
    return guards.sessions(src.table(spark, d, "events"), "2 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))
