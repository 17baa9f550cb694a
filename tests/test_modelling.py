"""Boosting against an independent booster, fold-local models, model tables, the trial ledger, bound panels, provenance."""

import datetime as dt
import math
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.operators import bias, boosting, bundles, models, provenance
from tidemark.operators.boosting import Booster
from tidemark.operators.trials import Refused, TrialLedger, canonical_json, sha256
from tidemark.plans.modelling import QUERIES
from tidemark.sources import panels
from tidemark.sources.storage import create_once

# boosting


def plain_tree(x, g, h, rows, depth, least, cuts):
    """A nested dict by trying every threshold of every column on lists of rows."""
    G, H = g[rows].sum(), h[rows].sum()
    best = None
    if depth:
        for c in range(x.shape[1]):
            for t in cuts[c]:
                left = [r for r in rows if x[r, c] <= t]
                right = [r for r in rows if x[r, c] > t]
                if min(len(left), len(right)) < least or min(h[left].sum(), h[right].sum()) < 1e-3:
                    continue
                gain = round(g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - G * G / H, 9)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, c, t, left, right
    if best is None:
        return {"value": -0.1 * G / H, "rows": rows}
    _, c, t, left, right = best
    return {"c": c, "t": t, "left": plain_tree(x, g, h, left, depth - 1, least, cuts), "right": plain_tree(x, g, h, right, depth - 1, least, cuts)}


def walk(tree, row):
    while "c" in tree:
        tree = tree["left"] if row[tree["c"]] <= tree["t"] else tree["right"]
    return tree["value"]


def plain_boost(task, x, y, new, depth, least, iterations, bins):
    cuts = [sorted(set(np.percentile(c, [i / bins * 100 for i in range(1, bins)]))) for c in x.T]
    start = y.mean() if task == "regression" else math.log(y.mean() / (1 - y.mean()))
    raw, out = np.full(len(x), start), np.full(len(new), start)
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-raw))
        g, h = (raw - y, np.ones(len(x))) if task == "regression" else (p - y, p * (1 - p))
        tree = plain_tree(x, g, h, list(range(len(x))), depth, least, cuts)
        raw = raw + [walk(tree, r) for r in x]
        out = out + [walk(tree, r) for r in new]
    return out if task == "regression" else 1 / (1 + np.exp(-out))


def learnable(seed, n=160):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.standard_normal(n), np.round(r.standard_normal(n), 1), r.integers(0, 3, n)])
    return x, np.where(x[:, 0] > 0.3, x[:, 1], -x[:, 2] / 3) + 0.1 * r.standard_normal(n)


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_booster_equals_a_plain_one(task):
    x, y = learnable(3)
    new, _ = learnable(4, 50)
    y = y if task == "regression" else (y > 0).astype(float)
    points = [(2, 20), (3, 5), (1, 70)]
    got = Booster(task, points, iterations=6, bins=12).fit(x, y).predict(new)
    for p, (depth, least) in zip(got, points):
        assert np.allclose(p, plain_boost(task, x, y, new, depth, least, 6, 12), atol=1e-9)


def test_first_split_on_spark_is_the_boosters(spark):
    x, y = learnable(7, 300)
    rows = pd.DataFrame({"model": ["m"] * 300, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    df = spark.createDataFrame(rows).repartition(3)
    binned = boosting.with_bins(df, ["model"], ["a", "b", "c"], 10).withColumns({"g": F.lit(float(y.mean())) - F.col("y"), "h": F.lit(1.0)})
    got = boosting.best_splits(boosting.histograms(binned, ["model"], ["a", "b", "c"]), ["model"], 20).first()
    one = Booster("regression", [(1, 20)], iterations=1, bins=10).fit(x, y)
    column, cut, value = one.trees[0]
    assert got.column == "abc"[column[0, 0]] and math.isclose(got.cut, one.cuts[column[0, 0]][cut[0, 0]])
    assert np.allclose([0.1 * got.left, 0.1 * got.right], value[0, 1:3])


def test_grids():
    assert models.grid_points("hgb", "regression") == [{"max_depth": d, "min_samples_leaf": n} for d in (2, 3) for n in (20, 50)]
    assert [p["alpha"] for p in models.grid_points("ridge", "regression")] == [0.1, 1.0, 10.0, 100.0]
    with pytest.raises(ValueError, match="no estimator"):
        models.grid_points("ridge", "classification")
    with pytest.raises(ValueError, match="more than 2"):
        models.grid_points("hgb", "regression", most=2)


def fold_frame(spark, seed=1, n=140):
    x, y = learnable(seed, n)
    rows = [("t", 0, "train" if i < 110 else "test", dt.date(2020, 1, 1) + dt.timedelta(i), i, float(y[i]), *map(float, x[i])) for i in range(n)]
    rows[5] = (*rows[5][:5], None, *rows[5][6:])
    rows[7] = (*rows[7][:6], None, *rows[7][7:])
    return spark.createDataFrame(rows, "ticker string, fold int, role string, date date, position int, label double, a double, b double, c double"), x, y


def test_boosted_walk_forward_and_tuning(spark):
    rows, x, y = fold_frame(spark)
    train = [i for i in range(110) if i not in (5, 7)]
    got = models.boosted_predictions(rows, "regression", ["a", "b", "c"], iterations=5).orderBy("date").collect()
    want = plain_boost("regression", x[train], y[train], x[110:], 3, 20, 5, 255)
    assert np.allclose([r.prediction for r in got], want, atol=1e-8) and not any(r.tuned for r in got)
    inner = spark.createDataFrame([("t", 0, 0, 50, 80), ("t", 0, 1, 80, 105)], "ticker string, outer_fold int, fold int, test_from int, test_to int")
    tuned = models.boosted_predictions(rows, "regression", ["a", "b", "c"], horizon=2, embargo=3, inner=inner, iterations=5).collect()
    losses = []
    place = np.array(train)
    for start, end, gaps in ((50, 80, []), (80, 105, [80])):
        past = (place < start - 2) & np.all([(place < g) | (place >= g + 3) for g in gaps] or [np.ones(len(place), bool)], axis=0)
        held = (place >= start) & (place < end)
        losses.append([np.mean((plain_boost("regression", x[train][past], y[train][past], x[train][held], p["max_depth"], p["min_samples_leaf"], 5, 255) - y[train][held]) ** 2) for p in models.grid_points("hgb", "regression")])
    best = models.grid_points("hgb", "regression")[int(np.argmin(np.mean(losses, axis=0)))]
    assert {(r.max_depth, r.min_samples_leaf, r.tuned) for r in tuned} == {(best["max_depth"], best["min_samples_leaf"], True)}
    one_kind = rows.withColumn("label", F.lit(1.0))
    assert models.boosted_predictions(one_kind, "classification", ["a"], iterations=2).count() == 0


def test_fold_state_and_no_leak(spark):
    rows, x, y = fold_frame(spark)
    train = [i for i in range(110) if i not in (5, 7)]
    one = models.fold_local(rows, ["a", "b"], lambda: models.Linear("ridge")).first()
    assert np.allclose(one["mean"], x[train][:, :2].mean(axis=0)) and np.allclose(one.scale, x[train][:, :2].std(axis=0))
    assert (one.train_rows, one.train_first, one.train_last, len(one.dates)) == (108, dt.date(2020, 1, 1), dt.date(2020, 4, 19), 30)
    moved = rows.withColumns({c: F.when(F.col("role") == "test", F.col(c) + 1000).otherwise(F.col(c)) for c in ("a", "label")})
    other = models.fold_local(moved, ["a", "b"], lambda: models.Linear("ridge")).first()
    assert other["mean"] == one["mean"] and other.weights == one.weights and other.predictions != one.predictions
    plain = models.fold_local(rows, ["a", "b"], lambda: models.Linear("ridge"), scale=False).first()
    assert plain["mean"] == [0, 0] and plain.scale == [1, 1]


def test_model_table_round_trip_and_flipped_bit(spark, tmp_path):
    rows, _, _ = fold_frame(spark)
    made = models.fold_local(rows, ["a", "b"], lambda: models.Linear("ridge"))
    models.artifacts(made, ["a", "b"], "regression").write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    told = stored.select("ticker", "fold", "digest")
    scored = models.scored(models.verified(stored, told), rows.where("role = 'test'"), ["a", "b"]).orderBy("date").collect()
    assert np.allclose([r.prediction for r in scored], made.first().predictions)
    bit = F.transform("weights", lambda w, i: F.when(i == 1, w + 1e-15 * F.greatest(F.abs(w), F.lit(1.0))).otherwise(w))
    for bad, want in ((stored.withColumn("weights", bit), told), (stored, told.withColumn("digest", F.lit("0"))), (stored.where("false"), told), (stored, told.where("false"))):
        with pytest.raises(ValueError, match="t/0"):
            models.verified(bad, want)


# the normal distribution


def test_normal(spark):
    xs = [0.0, 1e-9, 0.3, 1.0, 2.4999, 2.5, 3.0, 5.3, 8.0, 12.0]
    df = spark.createDataFrame([(s * x,) for x in xs for s in (1, -1)], "x double")
    for r in df.select("x", normal.upper_tail(F.col("x")).alias("q"), normal.cumulative(F.col("x")).alias("p")).collect():
        want = math.erfc(r.x / math.sqrt(2)) / 2
        assert math.isclose(r.q, want, rel_tol=1e-11, abs_tol=1e-15) and abs(r.p - (1 - want)) < 1e-12
    qs = [0.5, 0.4, 0.9, 1e-2, 1 / 16_777_319, 1 / (16_777_319 * math.e), 1e-15]
    for r in spark.createDataFrame([(q,) for q in qs], "q double").select("q", normal.tail_point(F.col("q")).alias("x")).collect():
        assert math.isclose(math.erfc(r.x / math.sqrt(2)) / 2, r.q, rel_tol=1e-11)
    assert spark.createDataFrame([(0.0,), (1.0,)], "q double").where(normal.tail_point(F.col("q")).isNotNull()).count() == 0


def test_selection_refuses_incomplete_candidates(spark):
    declared = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "config string, place int")
    completed = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("c", "t3")], "config string, trial string")
    dsr = spark.createDataFrame([("t1", 0.4, 0.1), ("t2", 0.7, 0.2), ("t3", 0.7, 0.3)], "trial string, family_dsr double, lifetime_dsr double")
    got = {r.config: r.selected for r in bias.selection(declared, completed, dsr).collect()}
    assert got == {"a": False, "b": True, "c": False}
    again = completed.union(spark.createDataFrame([("b", "t4")], completed.schema))
    for d, c, s in ((declared, completed.where("config <> 'b'"), dsr), (declared.where("place < 3"), completed, dsr), (declared, again, dsr), (declared, completed, dsr.where("trial <> 't3'"))):
        with pytest.raises(ValueError, match="candidates"):
            bias.selection(d, c, s)


# the trial ledger


def daily(spark, n=5):
    return spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(i), 0.01 * i) for i in range(n)], "session date, log_return double")


def test_two_writers_lose_no_event(spark, tmp_path):
    path, ids, errors = str(tmp_path / "ledger"), [], []

    def write(family):
        try:
            for k in range(4):
                ids.append(TrialLedger(spark, path).start({"k": k}, role="candidate", family=family, runner="test"))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(f,)) for f in "xyz"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    ledger = TrialLedger(spark, path)
    rows = ledger.events().orderBy("seq").collect()
    assert not errors and [r.seq for r in rows] == list(range(1, 13)) and {r.trial_id for r in rows} == set(ids)
    assert ledger.faults().isEmpty() and ledger.head() == (12, rows[-1].record_hash)


def test_start_finish_and_faults(spark, tmp_path):
    ledger = TrialLedger(spark, str(tmp_path / "ledger"))
    assert ledger.head()[0] == 0 and ledger.events().count() == 0
    trial = ledger.start({"b": 1, "a": [1, None]}, role="candidate", family="f", runner="test")
    assert ledger.events().first().config == '{"a":[1,null],"b":1}'
    with pytest.raises(Refused, match="needs its daily returns"):
        ledger.finish(trial, "completed")
    with pytest.raises(Refused, match="finite"):
        ledger.finish(trial, "completed", returns=daily(spark).union(daily(spark)))
    ledger.finish(trial, "completed", returns=daily(spark))
    assert ledger.returns(trial).count() == 5
    for bad in (trial, "unknown"):
        with pytest.raises(Refused):
            ledger.finish(bad, "failed", reason="again")
    with pytest.raises(Refused, match="role"):
        ledger.start({}, role="other", family="f", runner="test")
    second = ledger.start({}, role="baseline", family="f", runner="test")
    ledger.finish(second, "aborted", reason="stopped")
    file = tmp_path / "ledger" / "events" / "000000000003.json"
    file.write_text(file.read_text().replace("baseline", "candidate"))
    assert {(r.seq, r.fault) for r in ledger.faults().collect()} == {(3, "hash")}


def test_a_begun_event_ends_the_prefix(spark, tmp_path):
    ledger = TrialLedger(spark, str(tmp_path / "ledger"))
    ledger.start({}, role="candidate", family="f", runner="test")
    (tmp_path / "ledger" / "events" / "000000000002.json").write_text("")
    assert ledger.events().count() == 1
    with pytest.raises(RuntimeError, match="never finished"):
        ledger.head(wait=0.2)
    assert not create_once(spark, str(tmp_path / "ledger" / "events" / "000000000001.json"), b"x")


# panels


def published(spark, tmp_path):
    rows = spark.createDataFrame([(t, dt.date(2024, 1, 1) + dt.timedelta(i), 10 * i + len(t)) for t in ("a", "bb") for i in range(10)], "ticker string, date date, volume long")
    bundles.publish(rows, str(tmp_path / "panel"), "ticker", ["date", "volume"])
    manifest = spark.read.parquet(str(tmp_path / "panel" / "manifest"))
    return str(tmp_path / "panel"), manifest, panels.data_check(manifest, "ticker", "2024-01-06")


def test_research_panel_is_bound(spark, tmp_path):
    path, manifest, check = published(spark, tmp_path)
    got = panels.research_panel(spark, path, check, "ticker", ["date", "volume"], "2024-01-06")
    assert got.count() == 12
    assert "PushedFilters: [IsNotNull(date), LessThanOrEqual(date,2024-01-06)]" in got._jdf.queryExecution().executedPlan().toString()
    inputs = check["panel_hash_input"]
    other = {**inputs, "bodies": {**inputs["bodies"], "a": "1"}}
    cases = [
        ({**check, "status": "FAILED"}, "data_check_status"),
        ({**check, "panel_hash": "0"}, "data_check_hash"),
        (panels.data_check(manifest, "ticker", "2024-01-07"), "research_end"),
        ({"status": "VERIFIED", "panel_hash_input": other, "panel_hash": sha256(canonical_json(other))}, "manifest_and_data_check_disagree: a"),
        (panels.data_check(manifest.where("ticker = 'a'"), "ticker", "2024-01-06"), "manifest_and_data_check_disagree: bb"),
    ]
    for bad, why in cases:
        with pytest.raises(Refused, match=why):
            panels.research_panel(spark, path, bad, "ticker", ["date", "volume"], "2024-01-06")
    changed = spark.read.parquet(f"{path}/rows").withColumn("volume", F.col("volume") + F.when((F.col("ticker") == "bb") & (F.dayofmonth("date") == 9), 1).otherwise(0))
    with pytest.raises(Refused, match="body_digest: bb"):
        panels.bound(changed, manifest, check, "ticker", ["date", "volume"], "2024-01-06")


def test_holdout_is_opened_once(spark, tmp_path):
    path, manifest, check = published(spark, tmp_path)
    ledger, config = TrialLedger(spark, str(tmp_path / "ledger")), {"model": "h"}
    rows = spark.read.parquet(f"{path}/rows")

    def panel(c=config, end="2024-01-08"):
        return panels.holdout_panel(rows, manifest, check, "ticker", ["date", "volume"], "2024-01-06", end, ledger, "f", c)

    with pytest.raises(Refused, match="stays sealed"):
        panel()
    won, lost = [], []

    def claim(k):
        try:
            won.append(TrialLedger(spark, ledger.path).start(config, role="holdout", family="f", runner=f"r{k}"))
        except Refused as e:
            lost.append(e)

    threads = [threading.Thread(target=claim, args=(k,)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == len(lost) == 1 and "spent" in str(lost[0])
    assert {(r.sealed, r.n) for r in panel().groupBy("sealed").agg(F.count("*").alias("n")).collect()} == {(False, 12), (True, 4)}
    with pytest.raises(Refused, match="another configuration"):
        panel({"model": "x"})
    with pytest.raises(Refused, match="precedes"):
        panel(end="2024-01-06")
    ledger.finish(won[0], "completed", returns=daily(spark))
    with pytest.raises(Refused, match="has been run"):
        panel()


# provenance


def test_closure_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (0, 100), (7, 7), (200, 201), (200, 202), (201, 203), (202, 203), (None, 1)]
    edges = spark.createDataFrame(pairs, "artifact long, input long")
    want = {}
    for a in {a for a, _ in pairs if a is not None}:
        level, depth = {a}, 0
        while level:
            depth += 1
            level = {y for x, y in pairs if x in level and (a, y) not in want}
            want |= {(a, y): depth for y in level}
    assert {(r.artifact, r.input): r.depth for r in provenance.closure(edges).collect()} == want
    recorded = edges.where("artifact is not null").withColumn("digest", F.lit("d"))
    now = spark.createDataFrame([(i, "x" if i == 203 else "d") for _, i in set(pairs) if i != 102], "input long, digest string").distinct()
    state = {r.artifact: (r.state, r.gone, r.changed) for r in provenance.currentness(recorded, now).collect()}
    assert state[100][0] == state[101][0] == state[7][0] == "cyclic"
    assert state[200][0] == "stale" and state[200][2] == 2 and state[8] == ("fresh", 0, 0) and state[0][0] == "stale"


@pytest.mark.parametrize("name", ["ml_03_boosted_regression", "ml_03_boosted_classification", "ml_11_fold_local_logistic"])
def test_whole_panel_models(spark, sf, name):
    rows = QUERIES[name](spark, sf).toPandas()
    assert rows.ticker.nunique() == 25 and rows.prediction.notna().all() and not rows.duplicated(["ticker", "fold", "date"]).any()
    if name != "ml_03_boosted_regression":
        assert rows.prediction.between(0, 1).all()
