"""The classifier's fit takes little of the driver, and gives what a fit in one piece gives."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality as q
from tidemark.llm.textops import slices


def one_piece(x, y, ridge=1.0):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += (step := np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w))
        if np.abs(step).max() < 1e-6:
            break
    return w


def test_fit_works_in_parts():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, q.TEXT_WIDTH)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] + rng.normal(size=len(x)) > 0).astype(float)
    tracemalloc.start()
    fitted = q.Logistic(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes  # a copy in double precision has twice as much
    assert np.allclose(fitted.w, one_piece(x.astype(np.float64), y), rtol=1e-7, atol=1e-9)
    for n in (1, q.PART, q.PART + 1):
        few = np.arange(n) % 2
        assert np.allclose(q.Logistic(x[:n], few).w, one_piece(x[:n].astype(np.float64), few), rtol=1e-6, atol=1e-8)


def test_rows_to_fit_on_come_as_arrays(spark, sf):
    """The same rows, order and features as those of the tables; ids that repeat included."""
    docs = q._rows(spark.read.parquet(f"{sf}/documents.parquet"))
    docs = docs.union(docs.where("doc_id % 7 = 0").withColumn("text", F.concat("text", F.lit(" and more")))).union(docs.where("doc_id % 11 = 0"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "cast(quality as int) as y")
    found = q._labelled(docs, labels, 10_000)
    want = []
    for r in docs.join(labels, "doc_id").toArrow().to_batches():
        for low, raw, offsets in slices(r.column("text")):
            part = r.slice(low, len(offsets) - 1)
            x, m = q.text_features(raw, offsets), q.meta_features(*(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
            want += zip(part.column("doc_id").to_pylist(), (b.tobytes() for b in x), part.column("y").to_pylist(), (b.tobytes() for b in m))
    want.sort()
    got = list(zip(found.ids.tolist(), (b.tobytes() for b in found.x), found.y.tolist(), (b.astype(np.float32).tobytes() for b in found.m)))
    assert [r[:3] for r in got] == [r[:3] for r in want] and sorted(got) == want
    assert len(got) > len(set(found.ids.tolist())) > 0
    assert sum(a.nbytes for a in found) <= len(got) * (4 * q.TEXT_WIDTH + q.META_WIDTH + 16)


def test_no_rows_to_fit_on(spark, sf):
    docs = q._rows(spark.read.parquet(f"{sf}/documents.parquet"))
    none = spark.createDataFrame([], "doc_id long, y int")
    assert [len(a) for a in q._labelled(docs, none, 10)] == [0, 0, 0, 0]
