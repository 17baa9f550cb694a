"""Queries over boosted and fold-local models, model tables, deflated Sharpe ratios, trial ledgers, bound panels and provenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import bias, boosting, bundles, ledger, models, provenance, studies
from tidemark.operators import windows as win
from tidemark.operators.trials import TrialLedger
from tidemark.plans.registry import ORACLE_SQL, QUERIES, query, rounded
from tidemark.plans.research import _W
from tidemark.plans.strategies import _BOUNDS, _COLUMNS, _FEAT, _FILLED, _MX, _fold_rows, _matrix, _weekly
from tidemark.sources import frames as src
from tidemark.sources import panels
from tidemark.sources.storage import scratch_dir

# boosting

_TWO = ["log_return", "close_to_short"]
_KNOWN = _FEAT + _BOUNDS + ", k AS (SELECT tr.fold, n.* FROM tr JOIN known n ON n.ticker = tr.ticker AND n.date = tr.date)"
_TICKS = ", ".join(str(x) for x in boosting.percentiles(16))


@query(
    "ml_03_first_stump",
    "bars",
    _KNOWN
    + f""", u AS (SELECT ticker, fold, 0 AS place, 'log_return' AS c, lr AS v, label FROM k UNION ALL SELECT ticker, fold, 1, 'close_to_short', cts, label FROM k),
q AS (SELECT ticker, fold, place, list_sort(list_distinct(quantile_cont(v, [{_TICKS}]))) AS cuts FROM u GROUP BY 1, 2, 3), m AS (SELECT ticker, fold, avg(label) AS m FROM k GROUP BY 1, 2),
b AS (SELECT u.ticker, u.fold, u.place, c, m - label AS g, cuts, len(list_filter(cuts, lambda t: t < v)) AS bin FROM u JOIN q ON q.ticker = u.ticker AND q.fold = u.fold AND q.place = u.place JOIN m ON m.ticker = u.ticker AND m.fold = u.fold),
h AS (SELECT ticker, fold, place, c, bin, any_value(cuts[bin + 1]) AS cut, count(*) AS n, sum(g) AS g FROM b GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT *, sum(n) OVER w AS ln, sum(g) OVER w AS lg, sum(n) OVER (PARTITION BY ticker, fold, place) AS an, sum(g) OVER (PARTITION BY ticker, fold, place) AS ag FROM h WINDOW w AS (PARTITION BY ticker, fold, place ORDER BY bin)),
x AS (SELECT *, round(lg * lg / ln + (ag - lg) * (ag - lg) / (an - ln) - ag * ag / an, 9) AS gain FROM s WHERE cut IS NOT NULL AND ln >= 20 AND an - ln >= 20)
SELECT ticker, fold, c AS "column", round(cut, 9) + 0.0 AS cut, round(gain, 7) + 0.0 AS gain, ln::BIGINT AS n_left, round(-lg / ln, 7) + 0.0 AS "left", round(-(ag - lg) / (an - ln), 7) + 0.0 AS "right"
FROM x WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY ticker, fold ORDER BY gain DESC, place, bin) = 1""",
)
def first_stump(spark, d):
    """The first split of every (ticker, fold) booster: gradients of the squared error at the mean."""
    node = ["ticker", "fold"]
    rows = _fold_rows(spark, d, F.col("label")).where("role = 'train'").dropna(subset=["label", *_TWO]).select(*node, "label", *_TWO)
    start = rows.groupBy(*node).agg(F.avg("label").alias("_start"))
    binned = boosting.with_bins(rows, node, _TWO, 16).join(start, node).withColumns({"g": F.col("_start") - F.col("label"), "h": F.lit(1.0)})
    found = boosting.best_splits(boosting.histograms(binned, node, _TWO), node, min_samples_leaf=20)
    return rounded(found, 7, cut=9)


@query("ml_03_boosted_regression")
def _(spark, d):
    return models.boosted_predictions(_fold_rows(spark, d, F.col("label")), "regression", _COLUMNS)


@query("ml_03_boosted_classification")
def _(spark, d):
    return models.boosted_predictions(_fold_rows(spark, d, (F.col("label") > 0).cast("double")), "classification", _COLUMNS)


# fold-local models and their table

_MOMENTS = _KNOWN + """, m AS (SELECT ticker, fold, count(*) AS n, min(date) AS a, max(date) AS z, avg(lr) AS ma, avg(cts) AS mb, avg(label) AS mt, stddev_pop(lr) AS sa, stddev_pop(cts) AS sb, covar_pop(lr, cts) AS ab, covar_pop(lr, label) AS lt, covar_pop(cts, label) AS ct FROM k GROUP BY 1, 2),
c AS (SELECT *, n * ab / (sa * sb) AS o, n * lt / sa AS u, n * ct / sb AS v FROM m), w AS (SELECT *, (u * (n + 1) - v * o) / ((n + 1) * (n + 1) - o * o) AS wa, (v * (n + 1) - u * o) / ((n + 1) * (n + 1) - o * o) AS wb FROM c),
alive AS (SELECT DISTINCT te.ticker, te.fold FROM te JOIN ff x ON x.ticker = te.ticker AND x.date = te.date WHERE lr IS NOT NULL AND cts IS NOT NULL)"""


def _ridges(spark, d):
    return models.fold_local(_fold_rows(spark, d, F.col("label")), _TWO, lambda: models.Linear("ridge"))


@query("ml_11_fold_state", "bars", _MOMENTS + " SELECT w.ticker, w.fold, n::BIGINT AS train_rows, a AS train_first, z AS train_last, round(ma, 9) + 0.0 AS mean_0, round(mb, 9) + 0.0 AS mean_1, round(sa, 9) AS scale_0, round(sb, 9) AS scale_1, round(mt, 9) + 0.0 AS weight_0, round(wa, 9) + 0.0 AS weight_1, round(wb, 9) + 0.0 AS weight_2 FROM w JOIN alive USING (ticker, fold)")
def _(spark, d):
    one = _ridges(spark, d)
    parts = [F.get(c, F.lit(i)).alias(f"{n}_{i}") for c, n, k in (("mean", "mean", 2), ("scale", "scale", 2), ("weights", "weight", 3)) for i in range(k)]
    return rounded(one.select("ticker", "fold", "train_rows", "train_first", "train_last", *parts), 9)


@query("ml_11_fold_local_logistic")
def _(spark, d):
    rows = _fold_rows(spark, d, (F.col("label") > 0).cast("double"))
    return models.fold_predictions(models.fold_local(rows, _TWO, lambda: models.Linear("logistic"), classes=True))


@query("ml_17_scored", "bars", _MOMENTS + " SELECT w.ticker, w.fold, x.date, round(mt + wa * (lr - ma) / sa + wb * (cts - mb) / sb, 9) + 0.0 AS prediction FROM w JOIN alive USING (ticker, fold) JOIN te ON te.ticker = w.ticker AND te.fold = w.fold JOIN ff x ON x.ticker = te.ticker AND x.date = te.date WHERE lr IS NOT NULL AND cts IS NOT NULL")
def _(spark, d):
    """Models written as a table, read back, verified against the digests told of them, and joined to rows."""
    path = scratch_dir(spark)
    models.artifacts(_ridges(spark, d), _TWO, "regression").write.parquet(path)
    stored = spark.read.parquet(path)
    checked = models.verified(stored, stored.select("ticker", "fold", "digest"))
    tests = _fold_rows(spark, d, F.col("label")).where("role = 'test'")
    return rounded(models.scored(checked, tests, _TWO), 9)


# deflated Sharpe ratios

_SIMPSON = "(1 + (i % 2) * 3 + ((i + 1) % 2)) * CASE WHEN i IN (0, 2000) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
_CDF = f"(0.5::DOUBLE + ({{z}}) / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(2001), lambda i: {_SIMPSON} * exp(-pow(i * ({{z}}) / 2000, 2) / 2))))"
_TAIL = f"(12.0::DOUBLE / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(2001), lambda i: {_SIMPSON} * exp(-pow({{x}} + i * 12.0::DOUBLE / 2000, 2) / 2))))"
_MOM = ", mm AS (SELECT trial, avg(x) AS m FROM ex GROUP BY 1), mo0 AS (SELECT ex.trial, count(*) AS n, avg(x) / stddev_samp(x) AS sharpe, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM ex JOIN mm USING (trial) GROUP BY 1), mo AS (SELECT trial, n, sharpe, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) AS kurtosis, stddev_samp(sharpe) OVER () AS spread FROM mo0)"


def _dsr_sql(counts: str) -> str:
    """CTEs ds(trial, k, trials, benchmark, z, dsr) for every named count (k, trials): quantiles by bisection, probabilities by Simpson's rule."""
    return (
        _MX
        + _MOM
        + f""", cn AS ({counts}), qs AS (SELECT DISTINCT trials, f, f / trials AS q FROM cn, (VALUES (1.0::DOUBLE), (exp(-1.0::DOUBLE))) v(f) WHERE trials > 1),
bi AS MATERIALIZED (SELECT trials, f, q, lo, hi FROM (SELECT *, 0.0::DOUBLE AS lo, 9.0::DOUBLE AS hi FROM qs)),"""
        + "".join(f" b{j} AS MATERIALIZED (SELECT trials, f, q, CASE WHEN t > q THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN t > q THEN hi ELSE (lo + hi) / 2 END AS hi FROM (SELECT *, {_TAIL.format(x='((lo + hi) / 2)')} AS t FROM {'bi' if j == 0 else f'b{j - 1}'}))," for j in range(46))
        + """ pt AS MATERIALIZED (SELECT trials, max(CASE WHEN f = 1 THEN (lo + hi) / 2 END) AS one, max(CASE WHEN f < 1 THEN (lo + hi) / 2 END) AS two FROM b45 GROUP BY 1),
bm2 AS (SELECT mo.*, cn.k, cn.trials, CASE WHEN cn.trials = 1 THEN 0.0::DOUBLE ELSE spread * ((1 - 0.5772156649015329::DOUBLE) * one + 0.5772156649015329::DOUBLE * two) END AS benchmark FROM mo CROSS JOIN cn LEFT JOIN pt ON pt.trials = cn.trials),
zz AS (SELECT *, (sharpe - benchmark) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) * sharpe * sharpe / 4) AS z FROM bm2), """
        + f"ds AS (SELECT *, {_CDF.format(z='z')} AS dsr FROM zz)"
    )


@query("sb_03_matrix_dsr", "panel", _dsr_sql("SELECT 'a' AS k, 25 AS trials") + " SELECT trial, n::BIGINT AS n, round(sharpe, 10) AS sharpe, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(spread, 10) AS spread, trials::INT AS trials, round(benchmark, 6) AS benchmark, round(z, 5) AS z, round(dsr, 6) AS dsr FROM ds")
def matrix_dsr(spark, d):
    return rounded(bias.matrix_dsr(_matrix(spark, d), 25), 6, sharpe=10, spread=10, z=5)


_COUNTS = "SELECT 'lifetime' AS k, (SELECT count(*) FROM lineitem) + 16700000 AS trials UNION ALL SELECT 'family', (SELECT count(DISTINCT trial) FROM mx)"
_SB04 = " SELECT trial, round(max(dsr) FILTER (WHERE k = 'lifetime'), 6) AS lifetime_dsr, round(max(dsr) FILTER (WHERE k = 'family'), 6) AS family_dsr FROM ds GROUP BY 1"


def _counted(spark, d):
    matrix = _matrix(spark, d)
    lifetime = src.table(spark, d, "lineitem").agg((F.count("*") + 16_700_000).alias("lifetime"))
    counts = lifetime.crossJoin(matrix.agg(F.count_distinct("trial").alias("family")))
    return bias.counted_dsr(bias.trial_moments(matrix), counts)


@query("sb_04_counted_dsr", "panel", _dsr_sql(_COUNTS) + _SB04)
def _(spark, d):
    return rounded(_counted(spark, d))


@query("sb_15_selection", "panel", _dsr_sql(_COUNTS) + f", r AS ({_SB04}) SELECT row_number() OVER (ORDER BY trial)::INT AS place, 'c-' || trial AS config, trial, family_dsr, lifetime_dsr, row_number() OVER (ORDER BY family_dsr DESC, trial) = 1 AS selected FROM r")
def _(spark, d):
    dsr = rounded(_counted(spark, d))
    trials = src.bars(spark, d).select(F.col("ticker").alias("trial")).distinct()
    completed = trials.select(F.concat(F.lit("c-"), "trial").alias("config"), "trial")
    names = F.array_sort(F.collect_list("config"))  # declared configurations are a written list
    declared = completed.agg(names.alias("c")).select(F.posexplode("c").alias("place", "config")).select("config", (F.col("place") + 1).alias("place"))
    return bias.selection(declared, completed, dsr)


# ledger and panels


@query(
    "led_02_trials",
    "bars",
    """, f AS (SELECT DISTINCT right(ticker, 1) AS family FROM bars), o AS (SELECT family, row_number() OVER (ORDER BY family) AS i, sum(1) OVER () AS n FROM f)
SELECT i::BIGINT AS seq, family, 'started' AS event_type, NULL AS fault FROM o UNION ALL SELECT (n + i)::BIGINT, family, 'completed', NULL FROM o""",
)
def _(spark, d):
    """A trial per family started, then each completed with its returns; every event with its fault, if it has one."""
    ledger = TrialLedger(spark, scratch_dir(spark))
    b = src.bars(spark, d).select("ticker", F.substring("ticker", -1, 1).alias("family"), F.col("date").alias("session"), F.col("close").alias("x"))
    families = sorted(r.family for r in b.select("family").distinct().collect())
    begun = {f: ledger.start({"family": f, "model": "mean"}, role="candidate", family=f, runner="plan") for f in families}
    daily = b.groupBy("family", "session").agg(F.log(F.avg("x")).alias("log_return"))
    for f, trial in begun.items():
        ledger.finish(trial, "completed", returns=daily.where(F.col("family") == f))
    return ledger.events().join(ledger.faults(), "seq", "left").select("seq", "family", "event_type", "fault")


_BODY = ["date", "volume"]
_END, _LAST = "1997-06-30", "1998-03-31"


def _published(spark, d):
    rows = src.bars(spark, d).select("ticker", "date", "close", F.round("volume").cast("long").alias("volume"))
    path = scratch_dir(spark)
    bundles.publish(rows, path, "ticker", _BODY)
    return path, spark.read.parquet(f"{path}/manifest")


@query("src_21_research_panel", "bars", f" SELECT ticker, date, close, round(volume)::BIGINT AS volume FROM bars WHERE date <= DATE '{_END}'")
def research(spark, d):
    path, manifest = _published(spark, d)
    return panels.research_panel(spark, path, panels.data_check(manifest, "ticker", _END), "ticker", _BODY, _END)


@query("src_22_holdout_panel", "bars", f" SELECT ticker, date, close, round(volume)::BIGINT AS volume, date > DATE '{_END}' AS sealed FROM bars WHERE date <= DATE '{_LAST}'")
def holdout(spark, d):
    """The sealed rows beside the research rows, after the one claim that its ledger gives."""
    path, manifest = _published(spark, d)
    ledger, config = TrialLedger(spark, scratch_dir(spark)), {"family": "edge", "model": "h10"}
    ledger.start(config, role="holdout", family="edge", runner="plan")
    check = panels.data_check(manifest, "ticker", _END)
    return panels.holdout_panel(spark.read.parquet(f"{path}/rows"), manifest, check, "ticker", _BODY, _END, _LAST, ledger, "edge", config)


# provenance

_PROV = """rec AS (SELECT o_orderkey AS artifact, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS input FROM orders), edges AS (SELECT * FROM rec WHERE input IS NOT NULL),
marks AS (SELECT artifact, input, CASE WHEN input % 89 = 0 THEN 1 ELSE 0 END AS gone, CASE WHEN input % 89 <> 0 AND input % 97 = 0 THEN 1 ELSE 0 END AS changed FROM edges),
reach AS (SELECT artifact, input, 1 AS depth FROM edges UNION ALL SELECT r.artifact, e.input, r.depth + 1 FROM reach r JOIN edges e ON e.artifact = r.input),
below AS (SELECT r.artifact, coalesce(m.gone, 0) AS gone, coalesce(m.changed, 0) AS changed FROM reach r LEFT JOIN marks m ON m.artifact = r.input UNION ALL SELECT artifact, gone, changed FROM marks),
tot AS (SELECT artifact, sum(gone) AS gone, sum(changed) AS changed FROM below GROUP BY 1), shp AS (SELECT artifact, count(*) AS inputs, max(depth) AS depth FROM reach GROUP BY 1)"""


def _recorded(spark, d):
    """Every order rests on the customer's order before it, recorded under that one's status."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = src.table(spark, d, "orders")
    edges = o.select(F.col("o_orderkey").alias("artifact"), F.lag("o_orderkey").over(by).alias("input"), F.lag("o_orderstatus").over(by).alias("digest")).where("input is not null")
    k = F.col("o_orderkey")
    now = o.where(k % 89 != 0).select(k.alias("input"), F.when(k % 97 == 0, "X").otherwise(F.col("o_orderstatus")).alias("digest"))
    return edges, now


@query("aux_18_currentness", "", f"WITH RECURSIVE {_PROV} SELECT artifact, inputs::BIGINT AS inputs, depth::INT AS depth, gone::BIGINT AS gone, changed::BIGINT AS changed, CASE WHEN gone + changed > 0 THEN 'stale' ELSE 'fresh' END AS state FROM shp JOIN tot USING (artifact)")
def current(spark, d):
    return provenance.currentness(*_recorded(spark, d))


_GATHERED = f"""SELECT c.ticker, c.artifact::BIGINT AS artifact, s.lifetime_dsr, s.family_dsr, h.t, p.pbo, a.state, concat_ws(',', CASE WHEN a.state IS DISTINCT FROM 'fresh' THEN 'inputs' END, CASE WHEN coalesce(s.lifetime_dsr < 0.95, true) THEN 'dsr' END, CASE WHEN coalesce(h.t < 1.645, true) THEN 't' END, CASE WHEN coalesce(p.pbo > 0.5, true) THEN 'pbo' END) AS failing
FROM (SELECT p_brand AS ticker, max(l_orderkey) AS artifact FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) c LEFT JOIN ({ORACLE_SQL['sb_04_counted_dsr']}) s ON s.trial = c.ticker LEFT JOIN ({ORACLE_SQL['agg_04_hac']}) h ON h.ticker = c.ticker
LEFT JOIN ({ORACLE_SQL['aux_18_currentness']}) a ON a.artifact = c.artifact CROSS JOIN ({ORACLE_SQL['sb_10_pbo']}) p"""


@query("aux_17_gather", "", _GATHERED)
def _(spark, d):
    """Each ticker's evidence; its artifact is the last order that its bars rest on."""
    parts = src.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    candidates = src.table(spark, d, "lineitem").join(parts, "l_partkey").groupBy("ticker").agg(F.max("l_orderkey").alias("artifact"))
    dsr = rounded(_counted(spark, d)).withColumnRenamed("trial", "ticker")
    return provenance.gather(candidates, dsr, QUERIES["agg_04_hac"](spark, d), QUERIES["sb_10_pbo"](spark, d), current(spark, d), "ticker")


# studies

_COLS3 = ["log_return", "close_to_short", "label"]


@query(
    "aux_45_collinearity",
    "bars",
    _FEAT
    + """, c AS (SELECT ticker, count(*) AS n, corr(lr, cts) AS x, corr(lr, label) AS y, corr(cts, label) AS z FROM known GROUP BY 1),
d AS (SELECT *, 1 + 2 * x * y * z - x * x - y * y - z * z AS det, sqrt((x * x + y * y + z * z) / 3) AS p FROM c), e AS (SELECT *, (1 - z * z) / det AS v0, (1 - y * y) / det AS v1, (1 - x * x) / det AS v2, acos(greatest(-1, least(1, x * y * z / pow(p, 3)))) / 3 AS phi FROM d)
SELECT ticker, n::BIGINT AS rows, round(sqrt((1 + 2 * p * cos(phi)) / (1 + 2 * p * cos(phi + 2 * pi() / 3))), 5) AS condition_number, round(v0, 5) AS vif_0, round(v1, 5) AS vif_1, round(v2, 5) AS vif_2,
  CASE WHEN v0 >= v1 AND v0 >= v2 THEN 'log_return' WHEN v1 >= v2 THEN 'close_to_short' ELSE 'label' END AS worst, round(greatest(v0, v1, v2), 5) AS max_vif FROM e""",
)
def _(spark, d):
    found = studies.collinearity_by_key(win.features(src.bars(spark, d)), "ticker", _COLS3)
    return rounded(found.select("ticker", "rows", "condition_number", *[F.get("vifs", F.lit(i)).alias(f"vif_{i}") for i in range(3)], "worst", "max_vif"), 5)


def _adf_moments(lag: int, skip: int) -> str:
    """Centred moments by ticker of the level (a), two changes back (b, c) and the change (y), without the first changes."""
    pairs = ", ".join(f"covar_pop({p}, {q}) * count(*) AS \"{p}{q}\"" for p, q in (("a", "a"), ("b", "b"), ("c", "c"), ("y", "y"), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "y"), ("b", "y"), ("c", "y")))
    return f"SELECT ticker, {lag} AS lag, count(*) AS n, {pairs} FROM dz WHERE i > {skip} GROUP BY 1"


_ADF = (
    f""", dx AS (SELECT ticker, date, ln(close) AS x FROM filled WHERE close IS NOT NULL), dy AS (SELECT ticker, date, lag(x) OVER ({_W}) AS a, x - lag(x) OVER ({_W}) AS y FROM dx),
dz AS (SELECT ticker, a, y, coalesce(lag(y) OVER ({_W}), 0) AS b, coalesce(lag(y, 2) OVER ({_W}), 0) AS c, row_number() OVER ({_W}) - 1 AS i FROM dy WHERE y IS NOT NULL),
g AS ({_adf_moments(9, 1)}), g1 AS (SELECT *, yy - ay * ay / aa AS r0, bb - ab * ab / aa AS b1, "by" - ab * ay / aa AS y1, cc - ac * ac / aa AS c1, bc - ab * ac / aa AS k1, cy - ac * ay / aa AS z1 FROM g),
"""
    + """g2 AS (SELECT *, r0 - y1 * y1 / b1 AS r1, c1 - k1 * k1 / b1 AS c2, z1 - k1 * y1 / b1 AS z2 FROM g1), g3 AS (SELECT *, r1 - z2 * z2 / c2 AS r2 FROM g2),
ai AS (SELECT ticker, unnest([{'lag': 0, 'aic': round(n * ln(r0 / n) + 4, 9)}, {'lag': 1, 'aic': round(n * ln(r1 / n) + 6, 9)}, {'lag': 2, 'aic': round(n * ln(r2 / n) + 8, 9)}]) AS s FROM g3),
ch AS (SELECT ticker, s.lag AS lag FROM ai QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY s.aic, s.lag) = 1), """
    + f"fm AS ({_adf_moments(0, -1)} UNION ALL {_adf_moments(1, 0)} UNION ALL {_adf_moments(2, 1)}), "
    + """fc AS (SELECT fm.* FROM fm JOIN ch ON ch.ticker = fm.ticker AND ch.lag = fm.lag),
o1 AS (SELECT *, CASE WHEN lag >= 1 THEN ab / bb ELSE 0 END AS t, CASE WHEN lag >= 2 THEN 1 ELSE 0 END AS two FROM fc),
o2 AS (SELECT *, aa - t * ab AS a1, ay - t * "by" AS ay1, yy - CASE WHEN lag >= 1 THEN "by" * "by" / bb ELSE 0 END AS yy1, cc - bc * bc / bb AS cc1, ac - ab * bc / bb AS ac1, cy - bc * "by" / bb AS cy1 FROM o1),
o3 AS (SELECT *, a1 - two * ac1 * ac1 / cc1 AS a2, ay1 - two * ac1 * cy1 / cc1 AS ay2, yy1 - two * cy1 * cy1 / cc1 AS yy2 FROM o2),
st AS (SELECT ticker, n, lag, (ay2 / a2) / sqrt((yy2 - ay2 * ay2 / a2) / (n - 2 - lag) / a2) AS tau FROM o3),
sc AS (SELECT *, CASE WHEN tau <= -1.61 THEN 2.1659::DOUBLE + 1.4412::DOUBLE * tau + 0.038269::DOUBLE * tau * tau ELSE 1.7339::DOUBLE + 0.93202::DOUBLE * tau - 0.12745::DOUBLE * tau * tau - 0.010368::DOUBLE * tau * tau * tau END AS z FROM st),
pv AS (SELECT *, CASE WHEN tau > 2.74 THEN 1.0::DOUBLE WHEN tau < -18.83 THEN 0.0::DOUBLE ELSE """
    + _CDF.format(z="z")
    + """ END AS p FROM sc) SELECT ticker, n::BIGINT AS n, lag::BIGINT AS lag, round(tau, 5) AS statistic, round(p, 6) AS p_value, p < 0.05 AS stationary FROM pv"""
)


@query("agg_30_chosen_lag", "panel", _FILLED + _ADF)
def _(spark, d):
    return rounded(studies.unit_roots(_weekly(spark, d).withColumn("x", F.log("close")), "ticker", "date", "x", max_lag=2), 5, p_value=6)


@query("agg_30_usual_lags")
def _(spark, d):
    """Up to 12 (n / 100)^(1/4) lags."""
    return studies.unit_roots(_weekly(spark, d).withColumn("x", F.log("close")), "ticker", "date", "x")


_SETS = {"a": ["log_return"], "b": _TWO}


def _compared(spark, d, entries):
    f = _fold_rows(spark, d, F.col("label"))
    said = studies.feature_set_predictions(f, _SETS, entries, {"regression": F.col("label"), "classification": (F.col("label") > 0).cast("double")})
    return studies.paired(said, "a", "b")


@query(
    "ml_14_ridge_comparison",
    "bars",
    _MOMENTS
    + """, k1 AS (SELECT tr.fold, n.* FROM tr JOIN (SELECT * FROM ff WHERE lr IS NOT NULL AND label IS NOT NULL) n ON n.ticker = tr.ticker AND n.date = tr.date), m1 AS (SELECT ticker, fold, count(*) AS n, avg(lr) AS ma, avg(label) AS mt, stddev_pop(lr) AS sa, covar_pop(lr, label) AS lt FROM k1 GROUP BY 1, 2),
pa AS (SELECT m1.ticker, m1.fold, x.date, x.label, mt + n * lt / sa / (n + 1) * (lr - ma) / sa AS a FROM m1 JOIN te ON te.ticker = m1.ticker AND te.fold = m1.fold JOIN ff x ON x.ticker = te.ticker AND x.date = te.date WHERE lr IS NOT NULL),
pb AS (SELECT w.ticker, w.fold, x.date, mt + wa * (lr - ma) / sa + wb * (cts - mb) / sb AS b FROM w JOIN te ON te.ticker = w.ticker AND te.fold = w.fold JOIN ff x ON x.ticker = te.ticker AND x.date = te.date WHERE lr IS NOT NULL AND cts IS NOT NULL),
df AS (SELECT pa.ticker, round(pow(a - label, 2) - pow(b - label, 2), 9) AS d FROM pa JOIN pb USING (ticker, fold, date) WHERE label IS NOT NULL), dn AS (SELECT * FROM df WHERE d <> 0),
rk AS (SELECT ticker, d, rank() OVER (PARTITION BY ticker ORDER BY abs(d)) + (count(*) OVER (PARTITION BY ticker, abs(d)) - 1) / 2.0::DOUBLE AS r FROM dn)
SELECT ticker, count(*)::BIGINT AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM rk GROUP BY 1""",
)
def _(spark, d):
    return studies.compare_regressions(_compared(spark, d, [("ridge", "regression")]), "ticker")


@query("ml_15_logistic_comparison")
def _(spark, d):
    return studies.compare_classifications(_compared(spark, d, [("logistic", "classification")]), "ticker")


# canonical texts and digests


@query("led_04_canonical", "", """SELECT event_id, '{"a":[' || user_id || ',"' || event_type || '"],"z":{"b":{"k":' || (props::JSON ->> 'k') || '},"id":' || event_id || '}}' AS canonical, sha256('{"a":[' || user_id || ',"' || event_type || '"],"z":{"b":{"k":' || (props::JSON ->> 'k') || '},"id":' || event_id || '}}') AS digest FROM events""")
def _(spark, d):
    text = F.concat(F.lit('{ "z" : {"id": '), F.col("event_id"), F.lit(', "b": '), F.col("props"), F.lit('}, "a": ['), F.col("user_id"), F.lit(', "'), F.col("event_type"), F.lit('"]}'))
    out = src.table(spark, d, "events").select("event_id", ledger.canonical_text(text).alias("canonical"))
    return out.withColumn("digest", F.sha2("canonical", 256))


_LEAF = """lt AS (SELECT instrument_id, field, value FROM facts WHERE effective_date <= DATE '1997-06-30' AND observed_at < TIMESTAMP '1997-07-01' QUALIFY row_number() OVER (PARTITION BY instrument_id, field ORDER BY effective_date DESC, observed_at DESC, o_orderkey DESC) = 1),
sn AS (SELECT instrument_id, '{' || string_agg('"' || field || '":"' || value || '"', ',' ORDER BY field) || '}' AS state FROM lt GROUP BY 1), l0 AS (SELECT sha256(instrument_id || '|' || state) AS x FROM sn),
l1 AS (SELECT left(x, 4) AS p, sha256(string_agg(x, '' ORDER BY x)) AS x, count(*) AS n FROM l0 GROUP BY 1), l2 AS (SELECT left(p, 2) AS p, sha256(string_agg(x, '' ORDER BY x)) AS x, sum(n) AS n FROM l1 GROUP BY 1)"""


@query("aux_11_snapshot_hash", "facts", ", " + _LEAF + " SELECT '' AS prefix, sha256(string_agg(x, '' ORDER BY x)) AS digest, sum(n)::BIGINT AS n FROM l2")
def _(spark, d):
    """The digest of every instrument's state as of a day."""
    known = src.facts(spark, d).where("effective_date <= DATE '1997-06-30' and observed_at < TIMESTAMP '1997-07-01'")
    last = known.groupBy("instrument_id", "field").agg(F.max_by("value", F.struct("effective_date", "observed_at", "o_orderkey")).alias("value"))
    state = last.groupBy("instrument_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))).alias("state"))
    return ledger.tree_digest(state.withColumn("state", ledger.canonical_text(F.col("state"))), "instrument_id", "state")
