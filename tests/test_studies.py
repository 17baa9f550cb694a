"""Collinearity by key, unit roots, feature-set comparison and digests against plain versions."""

import datetime as dt
import hashlib
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger, studies


def test_collinearity_of_many_keys(spark):
    r = np.random.default_rng(2)
    frames = []
    for k in range(30):
        x = r.standard_normal((60, 3))
        x[:, 2] += k * 0.2 * x[:, 0]
        frames.append(pd.DataFrame({"key": f"k{k:02d}", "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    rows = pd.concat([*frames, pd.DataFrame({"key": "flat", "a": 1.0, "b": r.standard_normal(9), "c": r.standard_normal(9)}), pd.DataFrame({"key": "same", "a": np.arange(9.0), "b": np.arange(9.0) * 2, "c": r.standard_normal(9)})])
    df = spark.createDataFrame(rows).repartition(5)
    df = df.union(spark.createDataFrame([("k00", None, 1.0, 2.0)], df.schema))
    got = {x.key: x for x in studies.collinearity_by_key(df, "key", ["a", "b", "c"]).collect()}
    assert len(got) == 32
    for f in frames:
        x = f[["a", "b", "c"]].to_numpy()
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        row, vif = got[f.key.iloc[0]], np.diag(np.linalg.inv(np.corrcoef(x, rowvar=False)))
        assert math.isclose(row.condition_number, np.linalg.cond(z), rel_tol=1e-6) and np.allclose(row.vifs, vif)
        assert (row.rows, row.worst) == (60, "abc"[vif.argmax()]) and math.isclose(row.max_vif, vif.max())
    assert got["flat"].vifs is None and got["flat"].condition_number is None
    assert got["same"].condition_number is None and got["same"].vifs is not None
    assert studies.collinearity_by_key(df.where("false"), "key", ["a", "b", "c"]).count() == 0


def plain_adf(x, max_lag=None):
    """Least squares for every lag."""
    change = np.diff(x)
    most = math.ceil(12 * (len(x) / 100) ** 0.25) if max_lag is None else max_lag
    most = min(most, len(x) // 2 - 3)

    def fit(lag, skip):
        at = range(skip, len(change))
        z = np.array([[1.0, x[t], *[change[t - k] for k in range(1, lag + 1)]] for t in at])
        y = np.array([change[t] for t in at])
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        rss = float(((y - z @ beta) ** 2).sum())
        return beta[1] / math.sqrt(rss / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1]), len(y) * math.log(rss / len(y)) + 2 * (2 + lag), len(y)

    lag = min(range(most + 1), key=lambda k: round(fit(k, most)[1], 9))
    t, _, n = fit(lag, lag)
    return t, lag, n


def test_unit_roots(spark):
    r = np.random.default_rng(5)
    series = {"walk": np.cumsum(r.standard_normal(300)), "noise": r.standard_normal(300), "ar": np.zeros(250), "short": r.standard_normal(7), "flat": np.ones(50)}
    for t in range(3, 250):
        series["ar"][t] = 0.5 * series["ar"][t - 1] - 0.3 * series["ar"][t - 3] + r.standard_normal()
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(i), float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("walk", dt.date(2019, 1, 1), None)]
    df = spark.createDataFrame(rows, "key string, day date, x double").repartition(4)
    got = {x.key: x for x in studies.unit_roots(df, "key", "day", "x").collect()}
    for k in ("walk", "noise", "ar", "short"):
        t, lag, n = plain_adf(series[k])
        assert math.isclose(got[k].statistic, t, rel_tol=1e-7) and (got[k].lag, got[k].n) == (lag, n)
    assert got["noise"].stationary and got["ar"].stationary and not got["walk"].stationary and got["flat"].statistic is None
    # published points of the surface: 1, 5 and 10 % for a constant
    points = spark.createDataFrame([(-3.43035, 0.01), (-2.86154, 0.05), (-2.56677, 0.1)], "t double, p double")
    assert all(abs(x.got - x.p) < 0.001 for x in points.withColumn("got", studies.mackinnon_p(F.col("t"))).collect())
    assert [x.p for x in spark.createDataFrame([(3.0,), (-19.0,)], "t double").select(studies.mackinnon_p(F.col("t")).alias("p")).collect()] == [1.0, 0.0]


def test_comparison_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(1)
    rows = []
    for ticker in ("t", "u"):
        x = r.standard_normal((120, 2))
        y = x[:, 0] + 0.5 * r.standard_normal(120)
        rows += [(ticker, 0, "train" if i < 80 else "test", dt.date(2020, 1, 1) + dt.timedelta(i), i, float(y[i]) if i < 118 else None, float(x[i, 0]), float(x[i, 1])) for i in range(120)]
    df = spark.createDataFrame(rows, "ticker string, fold int, role string, date date, position int, y double, a double, b double")
    labels = {"regression": F.col("y"), "classification": (F.col("y") > 0).cast("double")}
    entries = [("ridge", "regression"), ("logistic", "classification")]
    results = []
    for n in (2, 8):
        pairs = studies.paired(studies.feature_set_predictions(df.repartition(n), {"one": ["b"], "two": ["a", "b"]}, entries, labels), "one", "two")
        results.append((sorted(map(tuple, pairs.collect())), sorted(map(tuple, studies.compare_regressions(pairs, "ticker").collect())), sorted(map(tuple, studies.compare_classifications(pairs, "ticker").collect()))))
    assert results[0] == results[1]
    pairs, ranks, counts = results[0]
    assert len(pairs) == 2 * 2 * 38
    for ticker, n, plus, minus in ranks:
        assert plus + minus == n * (n + 1) / 2 and plus > minus  # the set with the signal errs less
    for ticker, both, only_a, only_b, neither, p in counts:
        k, n = only_b, only_a + only_b
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n) if n else None
        assert both + only_a + only_b + neither == 38 and (p == want if want is None else math.isclose(p, want))


def test_canonical_text_and_tree(spark):
    docs = ['{"b": {"d": [3, {"z": 1, "y": null}], "c": "é\\n"}, "a": true}', "[]", '{"x": 1}', "not json", None]
    got = [x.c for x in spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").select("i", ledger.canonical_text(F.col("d")).alias("c")).orderBy("i").collect()]
    assert got == [json.dumps(json.loads(d), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for d in docs[:3]] + [None, None]
    rows = [(i, f"v{i % 7}") for i in range(500)] + [(3, "v3"), (None, None)]
    df = spark.createDataFrame(rows, "k long, v string")

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    leaves = [sha("|".join(x for x in (None if k is None else str(k), "~" if v is None else v) if x is not None)) for k, v in rows]
    level = [(x, x) for x in leaves]
    for width in (4, 2, 0):
        groups = {}
        for p, x in level:
            groups.setdefault(p[:width], []).append(x)
        level = [(p, sha("".join(sorted(xs)))) for p, xs in groups.items()]
    for n in (1, 7):
        assert [tuple(x) for x in ledger.tree_digest(df.repartition(n), "k", "v").collect()] == [("", level[0][1], 502)]
    other = df.where("k <> 250").union(spark.createDataFrame([(250, "v9")], df.schema))
    assert ledger.tree_digest(other, "k", "v").first().digest != level[0][1]


@pytest.mark.parametrize("name", ["agg_30_usual_lags", "ml_15_logistic_comparison"])
def test_whole_panel(spark, sf, name):
    from tidemark.plans.modelling import QUERIES

    assert QUERIES[name](spark, sf).select("ticker").distinct().count() == 25
