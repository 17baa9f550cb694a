"""The toxicity network against plain loops, numeric gradients, and held-out labels."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm import toxicity as tx
from tidemark.llm.toxicity import Network, Read, ToxicModel, fit_toxicity, toxicity_scores, train, without_copies

LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")


def words(text):
    return [x.lower() for x in LETTERS.findall(text.encode())]


def read(texts):
    ((_, raw, offsets),) = tx.slices(pa.array(texts, pa.large_string()), 1 << 40)
    return Read(raw, offsets)


def plain_odds(net, text):
    """Log-odds of every window by scalar loops over words, states and gates."""
    w = {k: v.astype(float) for k, v in net.w.items()}
    h, all_words = tx.HIDDEN, words(text)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def embedded(word):
        one = read([word.decode()])
        place = int(net.places(one.hash)[0])
        framed = [0, *word, 0]
        codes = np.array([framed[i - 1] << 16 | framed[i] << 8 | framed[i + 1] for i in range(1, len(word) + 1)], np.uint64)
        cells = (tx.mix64(codes + np.uint64(77)) >> np.uint64(52)).astype(int)
        return np.concatenate([w["word"][place], w["char"][cells].mean(axis=0)]) @ w["in"] + w["in0"]

    out, start = [], 0
    while True:
        window = all_words[start : start + tx.WINDOW]
        xs = [embedded(x) for x in window]
        states = np.zeros((len(window), 2 * h))
        for side, name in enumerate(("fwd", "bwd")):
            s = np.zeros(h)
            for t in range(len(window)) if side == 0 else reversed(range(len(window))):
                x, u = xs[t][side * 3 * h : (side + 1) * 3 * h], s @ w[name]
                r, z = sig(x[:h] + u[:h]), sig(x[h : 2 * h] + u[h : 2 * h])
                s = (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :]) + z * s
                states[t, side * h : (side + 1) * h] = s
        pooled = np.zeros(2 * h)
        if window:
            a = np.exp(np.tanh(states @ w["att"]) @ w["att1"])
            pooled = (a / a.sum()) @ states
        out.append(float(pooled @ w["out"] + w["out0"][0]))
        start += tx.STEP
        if start + tx.WINDOW - tx.STEP >= len(all_words):
            return out


@pytest.fixture(scope="module")
def network():
    texts = ["alpha beta Gamma", "délta alpha", "omega"]
    net = Network(np.unique(read(texts).hash)[:4], seed=3)
    r = np.random.default_rng(1)
    for k, x in net.w.items():
        net.w[k] = (x + 0.3 * r.standard_normal(x.shape)).astype(np.float32)
    return net


TEXTS = ["alpha beta gamma délta " * 30, "", "12 34 !!", "omega", "ALPHA%%% beta***", "one two three " * 11, "x" * 500, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(33))]


def test_windows_and_scores(network):
    got = ToxicModel(network, 0.5).scores(pa.array([*TEXTS, None])).to_pylist()
    for text, row in zip([*TEXTS, ""], got):
        odds = plain_odds(network, text)
        assert row["n_windows"] == len(odds)
        assert math.isclose(row["score"], 1 / (1 + math.exp(-max(odds))), rel_tol=2e-4)
        assert odds[row["worst_word"] // tx.STEP] == pytest.approx(max(odds), abs=2e-4)


def test_gradients(network):
    net = Network(network.known)
    net.w = {k: x.astype(np.float64) for k, x in network.w.items()}
    page = read(TEXTS)
    index, size = page.chosen(np.arange(len(page.first)))
    place, target = net.places(page.hash), np.linspace(0, 1, len(index))
    found, _ = net.gradients(place, page.cell, page.cells, index, size, target)
    r = random.Random(4)
    for name, x in net.w.items():
        flat, g = x.reshape(-1), found[name].reshape(-1)
        busy = np.flatnonzero(g)
        for i in r.sample(list(busy), min(6, len(busy))):
            was = flat[i]
            losses = []
            for step in (1e-3, -1e-3):
                flat[i] = was + step
                losses.append(net.gradients(place, page.cell, page.cells, index, size, target)[1])
            flat[i] = was
            assert g[i] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=2e-2, abs=2e-5), name


def corpus(seed, n):
    r = random.Random(seed)
    stock = ["".join(r.choice("abcdefghilmnorst") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    texts, toxic = [], []
    for i in range(n):
        own = [r.choice(stock) for _ in range(r.choice([10, 60, 200]))]
        bad = i % 4 == 0
        for _ in range(max(1, len(own) // 30) if bad else 0):
            own[r.randrange(len(own))] = r.choice(["vilewurd", "Nastig", "grotz"])
        texts.append(" ".join(own))
        toxic.append(int(bad) if i % 37 else 1)  # a few labels are wrong
    return texts, np.array(toxic, float), np.array([i % 4 == 0 for i in range(n)])


def test_learns_and_ignores_wrong_labels():
    texts, labels, _ = corpus(1, 400)
    net = train(texts, labels)
    fresh, _, truth = corpus(1, 700)
    scores = ToxicModel(net, 0.2).scores(pa.array(fresh[400:])).field("score").to_numpy()
    assert ((scores >= 0.5) == truth[400:]).mean() > 0.97


def test_copies_count_once():
    long = " ".join(f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    texts, target = without_copies([long, long + " more", "other words here now and then", "", "", long + " again x"], np.array([1.0, 1, 0, 0, 1, 0]))
    assert texts[:2] == [long, "other words here now and then"]
    assert target[0] == pytest.approx(2 / 3)


def test_table(spark):
    texts, labels, truth = corpus(2, 240)
    rows = [(i if i % 50 else None, t, int(y), 0.1, "x") for i, (t, y) in enumerate(zip(texts, labels))]
    rows += [(900, None, 0, 0.1, "x"), (901, "", 0, 0.1, "x"), (901, "", 0, 0.1, "x"), (902, "Nastig " * 30_000, None, 0.1, "x"), (903, "9 9 9", None, 0.1, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double, predicted string").repartition(3)
    model = fit_toxicity(table, table)
    got = toxicity_scores(table, model)
    assert got.columns == ["doc_id", "score", "predicted", "n_windows", "worst_word"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[902].predicted == 1 and by_id[902].n_windows == math.ceil((30_000 - 16) / 16)
    assert by_id[900].score == by_id[901].score == by_id[903].score < 0.5
    assert np.mean([by_id[i].predicted == truth[i] for i in range(240) if i % 50]) > 0.95
    again = toxicity_scores(table.repartition(7), fit_toxicity(table.repartition(7), table))
    assert sorted((r.doc_id or -1, round(r.score, 5)) for r in again.collect()) == sorted((r.doc_id or -1, round(r.score, 5)) for r in found)


def test_without_labels(spark):
    one = spark.createDataFrame([(1, "a b", 1), (2, "c", 1), (3, "d", None)], "doc_id long, text string, toxic int")
    assert [r.score for r in toxicity_scores(one, fit_toxicity(one, one)).collect()] == [1.0, 1.0, 1.0]
    assert [r.score for r in toxicity_scores(one, fit_toxicity(one.where("false"), one)).collect()] == [0.5, 0.5, 0.5]
    assert toxicity_scores(one.where("false"), fit_toxicity(one, one)).count() == 0


def test_query_on_held_out_labels(spark, sf):
    got = queries.op12_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    judged = [r for r in rows if r.toxic is not None]
    assert np.mean([r.predicted == r.toxic for r in judged]) > 0.85
    assert got.select(F.max("score")).first()[0] <= 1
