"""Walk-forward models: each (ticker, fold) is one bounded group, so folds fit in parallel."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.boosting import Booster


@dataclass(frozen=True)
class Estimator:
    """Grid and default of an estimator, and whether folds scale their columns for it."""

    grid: dict[str, list]
    default: dict[str, float]
    scale: bool


#: What is tuned.
ESTIMATORS = {
    ("logistic", "classification"): Estimator({"C": [0.01, 0.1, 1.0, 10.0]}, {"C": 1.0}, True),
    ("ridge", "regression"): Estimator({"alpha": [0.1, 1.0, 10.0, 100.0]}, {"alpha": 1.0}, True),
    ("hgb", "classification"): Estimator({"max_depth": [2, 3], "min_samples_leaf": [20, 50]}, {"max_depth": 3, "min_samples_leaf": 20}, False),
    ("hgb", "regression"): Estimator({"max_depth": [2, 3], "min_samples_leaf": [20, 50]}, {"max_depth": 3, "min_samples_leaf": 20}, False),
}


def estimator(name: str, task: str) -> Estimator:
    if (name, task) not in ESTIMATORS:
        raise ValueError(f"no estimator {name!r} for {task!r}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[name, task]


def grid_points(name: str, task: str, most: int = 8) -> list[dict]:
    """The grid's points, the last of the sorted parameters varying fastest; more than ``most`` are refused."""
    grid = estimator(name, task).grid
    names = sorted(grid)
    points = [dict(zip(names, x)) for x in itertools.product(*(grid[n] for n in names))]
    if len(points) > most:
        raise ValueError(f"{name} for {task} has {len(points)} grid points, more than {most}")
    return points


GRIDS = {"ridge": [0.1, 1.0, 10.0, 100.0], "logistic": [0.01, 0.1, 1.0, 10.0]}
DEFAULT = 1.0


def _fit(name: str, x: np.ndarray, y: np.ndarray, strength: float):
    """Weights with the intercept first: ridge by its normal equations, logistic by Newton steps (C = strength)."""
    z = np.column_stack([np.ones(len(x)), x])
    penalty = np.eye(z.shape[1]) * (strength if name == "ridge" else 1 / strength)
    penalty[0, 0] = 0
    if name == "ridge":
        return np.linalg.lstsq(z.T @ z + penalty, z.T @ y, rcond=None)[0]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.lstsq((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w, rcond=None)[0]
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return w


def _apply(name: str, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = w[0] + x @ w[1:]
    return out if name == "ridge" else 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _score(name: str, y: np.ndarray, p: np.ndarray) -> float:
    if name == "ridge":
        return float(np.mean((y - p) ** 2))
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def _tune(name: str, x: np.ndarray, y: np.ndarray, place: np.ndarray, inner: pd.DataFrame, horizon: int, embargo: int) -> tuple[float, bool]:
    """The grid point of the lowest mean loss over the inner folds, the first on ties; the default where no fold can be scored.

    Every inner fold scales by its own train rows, so that no validation row reaches the fit.
    """
    losses: list[list[float]] = []
    for past, held in inner_masks(place, inner, horizon, embargo):
        if past.any() and held.any() and (name == "ridge" or len(set(y[past])) > 1):
            losses.append([_score(name, y[held], _fit_predict(name, x[past], y[past], x[held], s)) for s in GRIDS[name]])
    return (GRIDS[name][int(np.argmin(np.mean(losses, axis=0)))], True) if losses else (DEFAULT, False)


def inner_masks(place: np.ndarray, inner: pd.DataFrame, horizon: int, embargo: int):
    """(train, validation) masks of each inner fold, purged and with the embargoes of those before it."""
    gaps: list[int] = []
    for start, end in zip(inner.test_from, inner.test_to):
        past = place < start - horizon
        for g in gaps:
            past &= (place < g) | (place >= g + embargo)
        gaps.append(end)
        yield past, (place >= start) & (place < end)


def _fit_predict(name: str, x: np.ndarray, y: np.ndarray, new: np.ndarray, strength: float) -> np.ndarray:
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    return _apply(name, _fit(name, (x - mean) / sd, y, strength), (new - mean) / sd)


def walk_forward_predictions(rows: DataFrame, name: str, columns: list[str], horizon: int = 0, embargo: int = 0, inner: DataFrame | None = None) -> DataFrame:
    """(ticker, fold, date, strength, tuned, prediction) from rows (ticker, fold, role, date, position, label, columns).

    Per (ticker, fold): choose the strength on the purged, embargoed inner folds, refit on
    all train rows (scaled by them), predict the test rows.  ``inner`` has (ticker,
    outer_fold, fold, test_from, test_to) with positions among the fold's train rows;
    without it the default strength is used.  Rows with a column that is null or not finite are left
    out, and train rows without a label, but they keep their positions; a logistic fold
    whose train labels are all equal predicts nothing.
    """

    def run(group: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
        train, test = _parts(group)
        if train.empty or test.empty or (name == "logistic" and train.label.nunique() < 2):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("ticker", "fold", "date", "strength", "tuned", "prediction")})
        x, y = train[columns].to_numpy(float), train.label.to_numpy(float)
        strength, tuned = _tune(name, x, y, train.place.to_numpy(), windows.sort_values("fold"), horizon, embargo)
        p = _fit_predict(name, x, y, test[columns].to_numpy(float), strength)
        return pd.DataFrame({"ticker": test.ticker, "fold": test.fold, "date": test.date, "strength": strength, "tuned": tuned, "prediction": p})

    return _over_folds(rows, columns, inner, run, "ticker string, fold int, date date, strength double, tuned boolean, prediction double")


def _parts(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Train rows with a label and test rows of a fold, in order."""
    return group[(group.role == "train") & group.label.notna()].sort_values("place"), group[group.role == "test"].sort_values("place")


def _over_folds(rows: DataFrame, columns: list[str], inner: DataFrame | None, run: Callable, schema: str) -> DataFrame:
    """``run(rows of a fold, its inner windows)`` for each (ticker, fold); rows get their ``place`` among the fold's rows, and rows with a
    column that is null or not finite are left out."""
    by = Window.partitionBy("ticker", "fold").orderBy("position")  # a fold's train rows all come before its test rows
    placed = rows.select("ticker", "fold", "role", "date", "position", "label", *columns).withColumn("place", F.row_number().over(by) - 1)
    known = placed.where(" and ".join(f"abs({c}) < double('infinity')" for c in columns))
    if inner is None:
        inner = rows.sparkSession.createDataFrame([], "ticker string, outer_fold int, fold int, test_from int, test_to int")
    own = inner.toDF(*inner.columns)  # columns of its own, where both sides come from the same rows
    return known.groupBy("ticker", "fold").cogroup(own.groupBy("ticker", "outer_fold")).applyInPandas(run, schema)


def boosted_predictions(rows: DataFrame, task: str, columns: list[str], horizon: int = 0, embargo: int = 0, inner: DataFrame | None = None, iterations: int = 100) -> DataFrame:
    """(ticker, fold, date, max_depth, min_samples_leaf, tuned, prediction): like ``walk_forward_predictions`` by histogram gradient boosting.

    All grid points grow together on the rows of an inner fold; the one of the lowest mean loss is grown again
    on all train rows.  A classifier's fold needs train labels of both kinds.
    """
    points = [(p["max_depth"], p["min_samples_leaf"]) for p in grid_points("hgb", task)]
    usual = tuple(estimator("hgb", task).default[k] for k in ("max_depth", "min_samples_leaf"))
    fields = ["ticker", "fold", "date", "max_depth", "min_samples_leaf", "tuned", "prediction"]
    loss = "ridge" if task == "regression" else "logistic"

    def run(group: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
        train, test = _parts(group)
        if train.empty or test.empty or (task == "classification" and train.label.nunique() < 2):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in fields})
        x, y, place = train[columns].to_numpy(float), train.label.to_numpy(float), train.place.to_numpy()
        losses = []
        for past, held in inner_masks(place, windows.sort_values("fold"), horizon, embargo):
            if past.any() and held.any() and (task == "regression" or len(set(y[past])) > 1):
                found = Booster(task, points, iterations).fit(x[past], y[past]).predict(x[held])
                losses.append([_score(loss, y[held], p) for p in found])
        point = points[int(np.argmin(np.mean(losses, axis=0)))] if losses else usual
        p = Booster(task, [point], iterations).fit(x, y).predict(test[columns].to_numpy(float))[0]
        return pd.DataFrame({"ticker": test.ticker, "fold": test.fold, "date": test.date, "max_depth": point[0], "min_samples_leaf": point[1], "tuned": bool(losses), "prediction": p})

    return _over_folds(rows, columns, inner, run, "ticker string, fold int, date date, max_depth int, min_samples_leaf int, tuned boolean, prediction double")


class Linear:
    """Ridge or logistic model of a default strength; ``weights`` has the intercept first."""

    def __init__(self, name: str, strength: float = DEFAULT):
        self.name, self.strength, self.weights = name, strength, np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Linear:
        self.weights = _fit(self.name, x, y, self.strength)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _apply(self.name, self.weights, x)


def fold_local(rows: DataFrame, columns: list[str], make_model: Callable, scale: bool = True, classes: bool = False) -> DataFrame:
    """One row per (ticker, fold): what a model of its own saw and said.

    ``make_model()`` gives an object with ``fit(x, y)`` and ``predict(x)``.  The row has the train rows' number and span, the scaler's mean and
    scale (0 and 1 without scaling), the model's ``weights`` if it has any, and the test dates with their predictions.  With ``classes`` a
    fold whose train labels are all equal has no row.
    """
    fields = ["ticker", "fold", "train_rows", "train_first", "train_last", "mean", "scale", "weights", "dates", "predictions"]

    def run(group: pd.DataFrame, _: pd.DataFrame) -> pd.DataFrame:
        train, test = _parts(group)
        if train.empty or test.empty or (classes and train.label.nunique() < 2):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in fields})
        x, new = train[columns].to_numpy(float), test[columns].to_numpy(float)
        mean, sd = (x.mean(axis=0), x.std(axis=0)) if scale else (np.zeros(len(columns)), np.ones(len(columns)))
        sd[sd == 0] = 1
        model = make_model()
        model.fit((x - mean) / sd, train.label.to_numpy(float))
        said = model.predict((new - mean) / sd)
        own = [train.ticker.iloc[0], train.fold.iloc[0], len(train), train.date.min(), train.date.max(), mean, sd, np.asarray(getattr(model, "weights", []), float), list(test.date), np.asarray(said, float)]
        return pd.DataFrame([own], columns=fields)

    return _over_folds(rows, columns, None, run, "ticker string, fold int, train_rows long, train_first date, train_last date, mean array<double>, scale array<double>, weights array<double>, dates array<date>, predictions array<double>")


def fold_predictions(folds: DataFrame) -> DataFrame:
    """(ticker, fold, date, prediction) of ``fold_local`` rows."""
    return folds.select("ticker", "fold", F.explode(F.arrays_zip(F.col("dates").alias("date"), F.col("predictions").alias("prediction"))).alias("x")).select("ticker", "fold", "x.date", "x.prediction")


# Linear models as a table: one row per (ticker, fold), scored by a join


def artifact_digest() -> Column:
    """SHA-256 over a model's keys and its numbers, written so that they read back exactly."""
    bits = [F.array_join(F.transform(c, lambda v: v.cast("string")), ",") for c in ("mean", "scale", "weights")]
    return F.sha2(F.concat_ws("|", "ticker", F.col("fold").cast("string"), "task", F.array_join("columns", ","), *bits), 256)


def artifacts(folds: DataFrame, columns: list[str], task: str) -> DataFrame:
    """(ticker, fold, task, columns, mean, scale, weights, digest) of ``fold_local`` rows of linear models."""
    rows = folds.select("ticker", "fold", F.lit(task).alias("task"), F.array(*map(F.lit, columns)).alias("columns"), "mean", "scale", "weights")
    return rows.withColumn("digest", artifact_digest())


def verified(models: DataFrame, expected: DataFrame) -> DataFrame:
    """Models whose digest holds and is the expected one (ticker, fold, digest), each expected one there; else ValueError names some."""
    want = expected.select("ticker", "fold", F.col("digest").alias("_want"))
    met = models.withColumn("_own", artifact_digest()).join(want, ["ticker", "fold"], "full_outer")
    bad = met.where(~(F.col("digest").eqNullSafe(F.col("_own")) & F.col("digest").eqNullSafe(F.col("_want")))).select("ticker", "fold").orderBy("ticker", "fold").limit(5).collect()
    if bad:
        raise ValueError("models that are missing, unexpected or changed: " + ", ".join(f"{r.ticker}/{r.fold}" for r in bad))
    return models


def scored(models: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(ticker, fold, date, prediction) of rows (ticker, fold, date, columns) by their model; rows with a null column have none."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    scaled = F.zip_with(F.zip_with(x, F.col("mean"), lambda a, m: a - m), F.col("scale"), lambda a, s: a / s)
    terms = F.zip_with(scaled, F.slice("weights", 2, len(columns)), lambda a, w: a * w)
    odds = F.aggregate(terms, F.get("weights", F.lit(0)), lambda t, v: t + v)
    out = F.when(F.col("task") == "classification", 1 / (1 + F.exp(-odds))).otherwise(odds)
    met = rows.select("ticker", "fold", "date", *columns).dropna(subset=columns).join(models.select("ticker", "fold", "task", "mean", "scale", "weights"), ["ticker", "fold"])
    return met.select("ticker", "fold", "date", out.alias("prediction"))


def normal_equations(rows: DataFrame, key: str, x: list[str], y: str) -> DataFrame:
    """Per key the least-squares line of y over two columns, from sums alone."""
    a, b = (F.col(c) for c in x)
    t = F.col(y)
    known = rows.dropna(subset=[*x, y])
    m = known.groupBy(key).agg(F.count("*").alias("n"), F.covar_pop(a, a).alias("aa"), F.covar_pop(b, b).alias("bb"), F.covar_pop(a, b).alias("ab"), F.covar_pop(a, t).alias("at"), F.covar_pop(b, t).alias("bt"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return m.select(key, "n", F.try_divide(F.col("at") * F.col("bb") - F.col("bt") * F.col("ab"), det).alias("beta_1"), F.try_divide(F.col("bt") * F.col("aa") - F.col("at") * F.col("ab"), det).alias("beta_2"))


def paired_counts(rows: DataFrame, key: str) -> DataFrame:
    """The two-by-two table of two classifiers against the truth; wants label, a, b."""
    ra, rb = F.col("a") == F.col("label"), F.col("b") == F.col("label")
    return rows.dropna(subset=["label", "a", "b"]).groupBy(key).agg(F.count_if(ra & rb).alias("both"), F.count_if(ra & ~rb).alias("only_a"), F.count_if(~ra & rb).alias("only_b"), F.count_if(~ra & ~rb).alias("neither"))


def signed_ranks(rows: DataFrame, key: str) -> DataFrame:
    """Wilcoxon sums of average ranks of |difference|, zero differences dropped; wants difference."""
    d = rows.where("difference <> 0").withColumn("_d", F.abs("difference"))
    by = Window.partitionBy(key)
    ranked = d.withColumn("_r", F.rank().over(by.orderBy("_d")) + (F.count("*").over(Window.partitionBy(key, "_d")) - 1) / 2)
    return ranked.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.when(F.col("difference") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("difference") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"))
