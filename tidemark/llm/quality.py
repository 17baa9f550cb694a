"""Quality classifier by co-training on two views of a document.

One logistic classifier sees the text (shares of kinds of characters, word and
repetition statistics, a hashed histogram of words), the other the page's
metadata (language, source, length class).  In each round both score all
documents; of the distinct documents without a label, those that each one ranks highest and
lowest join the other's training rows under their pseudo-label, ``picks`` in all, shared
between the classes as the labels are.  The views are then
calibrated on labelled rows that neither was fitted on, combined there by a
logistic layer over both log-odds, and all documents are scored.

Only the fit is bounded: by ``fit_rows`` labelled rows, in the order of a hash of
the id, and ``picks`` pseudo-labels per view and round.  These rows come to the
driver as Arrow batches, metadata as one byte a cell, and a fit takes ``PART``
of them at a time in double precision.  Scoring, and the
search for confident rows, covers all documents.  Labels are looked up by id and scores
only; features are made again for the picked rows, so texts are never shuffled.

Edge cases.  Labels that are null, or that disagree for one id, are not used; their
documents count as having a label all the same and are not picked.
Null or empty text and null metadata have features like any other value.
Repeated rows and null ids are scored each; rows equal in text and metadata are one
candidate for a pick, ties go by a hash of these.  Without labelled rows of both
classes every score is 0.5.  Documents are kept from ``threshold`` on.  Other
columns are passed by; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.textops import Words, slices

WORD_CELLS, LANG_CELLS, SOURCE_CELLS, LENGTH_CELLS = 128, 16, 64, 32
TEXT_WIDTH, META_WIDTH = WORD_CELLS + 14, LANG_CELLS + SOURCE_CELLS + LENGTH_CELLS
PART = 1024
_KIND = np.full(256, 7, np.int32)  # 7: other symbols
_KIND[list(range(97, 123))] = 0
_KIND[list(range(65, 91))] = 1
_KIND[list(range(48, 58))] = 2
_KIND[list(b" \t\r\x0b\x0c")] = 3
_KIND[10] = 4
_KIND[list(b".,;:'\"?-()")] = 5
_KIND[list(range(128, 256))] = 6


def text_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """TEXT_WIDTH features of each row of a slice."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    kinds = np.bincount(owner * 8 + _KIND[raw], minlength=8 * n).reshape(n, 8) / np.maximum(size, 1)[:, None]
    words = Words(raw, offsets)
    many = np.maximum(words.counts, 1)
    cells = np.bincount(words.doc * WORD_CELLS + (words.hash & np.uint64(WORD_CELLS - 1)).astype(np.int64), minlength=WORD_CELLS * n).reshape(n, WORD_CELLS) / many[:, None]
    keys = np.sort((words.doc.astype(np.uint64) << np.uint64(40)) | (words.hash >> np.uint64(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(keys)))
    owners = (keys[starts] >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(owners, minlength=n) / many
    most = np.zeros(n)
    full = np.flatnonzero(words.counts)
    if len(full):
        most[full] = np.maximum.reduceat(runs, np.searchsorted(owners, full))
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    length = np.bincount(words.doc, words.end - words.start, minlength=n) / many
    more = [distinct, most / many, np.bincount(words.doc, again, minlength=n) / many, length / 10, np.log1p(words.counts) / 10, (words.counts == 0).astype(float)]
    return np.column_stack([kinds, *more, np.sqrt(cells)]).astype(np.float32)


def meta_features(langs: list, sources: list, sizes: list) -> np.ndarray:
    out = np.zeros((len(langs), META_WIDTH), np.float32)
    rows = np.arange(len(langs))
    cell = lambda x, n: 0 if x is None else 1 + zlib.crc32(str(x).encode()) % (n - 1)
    out[rows, [cell(x, LANG_CELLS) for x in langs]] = 1
    out[rows, [LANG_CELLS + cell(x, SOURCE_CELLS) for x in sources]] = 1
    out[rows, [LANG_CELLS + SOURCE_CELLS + (0 if x is None else min(LENGTH_CELLS - 1, 1 + max(0, int(x)).bit_length())) for x in sizes]] = 1
    return out


class Logistic:
    """Ridge-penalised logistic regression by Newton steps, on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25):
        parts = [slice(i, i + PART) for i in range(0, len(x), PART)]
        self.mean = sum(x[p].sum(axis=0, dtype=np.float64) for p in parts) / len(x)
        self.scale = np.sqrt(sum(((x[p] - self.mean) ** 2).sum(axis=0) for p in parts) / len(x))
        self.scale[self.scale < 1e-9] = 1
        w = np.zeros(x.shape[1] + 1)
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            bent, up = np.diag(penalty), -penalty * w
            for p in parts:
                z = np.column_stack([np.ones(len(x[p])), (x[p] - self.mean) / self.scale])
                q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                bent += (z * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ z
                up += z.T @ (y[p] - q)
            step = np.linalg.solve(bent, up)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the positive class."""
        return np.clip(self.w[0] + ((x.astype(np.float64) - self.mean) / self.scale) @ self.w[1:], -30, 30)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, text features, metadata features) in slices; the columns are doc_id, text, lang, source, n_chars, ..."""
    for batch in batches:
        for low, raw, offsets in slices(batch.column("text")):
            part = batch.slice(low, len(offsets) - 1)
            yield part, text_features(raw, offsets), meta_features(*(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))


def _rows(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


class Fit(NamedTuple):
    """Rows to fit on, as arrays: their ids, classes, text and metadata features."""

    ids: np.ndarray
    y: np.ndarray
    x: np.ndarray
    m: np.ndarray

    def of(self, rows: np.ndarray) -> Fit:
        return Fit(*(a[rows] for a in self))


def _packed(x: np.ndarray, m: np.ndarray) -> list[pa.Array]:
    """Features as two binary columns; those of metadata are 0 or 1."""
    return [pa.array([r.tobytes() for r in f], pa.binary()) for f in (x, m.astype(np.uint8))]


def _matrices(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The features of ``_packed`` columns x and m."""
    out = np.empty((rows.num_rows, TEXT_WIDTH), np.float32), np.empty((rows.num_rows, META_WIDTH), np.uint8)
    for name, into in zip("xm", out):
        for i, r in enumerate(rows.column(name)):
            into[i] = np.frombuffer(r.as_buffer(), into.dtype)
    return out


def _labelled(rows: DataFrame, labels: DataFrame, fit_rows: int) -> Fit:
    """In the order of the ids; those of one id in that of the bytes of their text features."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, m in _batches(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *_packed(x, m)], ["doc_id", "y", "x", "m"])

    known = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = rows.join(F.broadcast(known), "doc_id").mapInArrow(features, "doc_id long, y int, x binary, m binary").toArrow()
    x, m = _matrices(sample)
    ids, y = (np.asarray(sample.column(c)) for c in ("doc_id", "y"))
    return Fit(ids, y.astype(float), x, m).of(np.lexsort((*x.view(">u4").T[::-1], ids)))


def _tied(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tie", F.xxhash64("text", "lang", "source", "n_chars"))


def _confident(rows: DataFrame, labels: DataFrame, models: tuple[Logistic, Logistic], picks: int, good: float, least: float) -> dict[tuple[int, int], list[int]]:
    """Ties of the rows that each view ranks lowest (class 0) and highest (class 1) among those without a label; ``good`` is
    the share of class 1."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, m in _batches(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(models[0].odds(x)), pa.array(models[1].odds(m))], ["doc_id", "tie", "odds0", "odds1"])

    scored = rows.mapInArrow(score, "doc_id long, tie long, odds0 double, odds1 double").join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    distinct = written(scored.groupBy("tie").agg(F.first("odds0").alias("odds0"), F.first("odds1").alias("odds1")))
    picks = min(picks, distinct.count() // 4)
    most = min(max(1, round(picks * good)), max(0, picks - 1))
    out = {}
    for view in (0, 1):
        for y in (0, 1):
            odds = F.col(f"odds{view}") if y else -F.col(f"odds{view}")
            out[view, y] = [r["tie"] for r in distinct.where(odds >= least).orderBy(odds.desc(), "tie").limit(most if y else picks - most).select("tie").collect()]
    return out


def _features_of(rows: DataFrame, ties: set[int]) -> tuple[dict[int, int], tuple[np.ndarray, np.ndarray]]:
    """Each tie's row in the text and metadata features, of at most a few times ``picks`` rows."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, m in _batches(batches):
            yield pa.RecordBatch.from_arrays([part.column("tie"), *_packed(x, m)], ["tie", "x", "m"])

    wanted = rows.sparkSession.createDataFrame([(t,) for t in sorted(ties)], "tie long")
    found = rows.join(F.broadcast(wanted), "tie", "left_semi").mapInArrow(features, "tie long, x binary, m binary")
    once = found.groupBy("tie").agg(F.first("x").alias("x"), F.first("m").alias("m")).toArrow()
    return {t: i for i, t in enumerate(once.column("tie").to_pylist())}, _matrices(once)


class CoTrained:
    """The two fitted views and the layer that combines them."""

    def __init__(self, text: Logistic, meta: Logistic, held: tuple[np.ndarray, np.ndarray, np.ndarray]):
        x, m, y = held
        self.text, self.meta = text, meta
        odds = text.odds(x), meta.odds(m)
        self.platt = [Logistic(o[:, None], y) for o in odds]
        self.both = Logistic(np.column_stack([p.odds(o[:, None]) for p, o in zip(self.platt, odds)]), y)

    def scores(self, x: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view, and both."""
        views = [p.odds(o[:, None]) for p, o in zip(self.platt, (self.text.odds(x), self.meta.odds(m)))]
        return [1 / (1 + np.exp(-o)) for o in (*views, self.both.odds(np.column_stack(views)))]


def co_train(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 20_000, picks: int = 1000, sure: float = 0.95, rounds: int = 2) -> CoTrained | None:
    """None without labelled rows of both classes."""
    rows = _tied(_rows(docs))
    every = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null")
    known = _labelled(rows, every.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).where("y = _y").drop("_y"), fit_rows)
    apart = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in known.ids.tolist()], bool)
    held, fit = known.of(apart), known.of(~apart)
    if any(len(np.unique(part.y)) < 2 for part in (held, fit)):
        return None
    models = Logistic(fit.x, fit.y), Logistic(fit.m, fit.y)
    for _ in range(rounds):
        found = _confident(rows, every, models, picks, float(fit.y.mean()), float(np.log(sure / (1 - sure))))
        at, features = _features_of(rows, {t for ties in found.values() for t in ties})
        models = ()
        for view, base in enumerate((fit.x, fit.m)):  # what the other view is sure of
            taught = [(at[t], c) for c in (0, 1) for t in found[1 - view, c]]
            more = features[view][np.array([i for i, _ in taught], np.int64)]
            models += (Logistic(np.vstack([base, more]), np.concatenate([fit.y, [float(c) for _, c in taught]])),)
    return CoTrained(*models, (held.x, held.m, held.y))


def score_quality(docs: DataFrame, model: CoTrained | None, *, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, text_score, meta_score, score, keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for part, x, m in _batches(batches):
            found = fitted.scores(x, m) if fitted else [np.full(len(x), 0.5)] * 3
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found), pa.array(found[2] >= threshold)], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return _rows(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def keep_quality(docs: DataFrame, model: CoTrained | None, *, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        fitted = shared.value
        if fitted is None:
            return pa.array(np.full(len(text), 0.5 >= threshold))
        out, m = [], meta_features(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist())
        for low, raw, offsets in slices(text):
            x = text_features(raw, offsets)
            out.append(fitted.scores(x, m[low : low + len(x)])[2] >= threshold)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    columns = [(F.col(c) if c in docs.columns else F.lit(None)).cast(t) for c, t in (("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return docs.where(F.arrow_udf(good, "boolean")(*columns))
