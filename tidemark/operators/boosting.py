"""Histogram gradient boosting, in two forms.

``histograms`` and ``best_splits`` are one level of trees as aggregates: sums of gradients per (model, node,
column, bin), combined in the task before a shuffle, and the best split of every node of every model at once.  A
model may be of any size there.  ``Booster`` grows whole models of a bounded history in one task: one
``bincount`` gives the histograms of all grid points, nodes and columns of a level.

Bins are cut at interpolated percentiles of the train rows (``bins - 1`` of them, equal ones once); a value goes
left of a threshold that it doesn't exceed.  A split must leave ``min_samples_leaf`` rows and ``LEAST_HESSIAN`` on
either side and gain more than nothing; ties go to the first column, then the lowest threshold.  Losses are squared
error (start: the mean) and log loss (start: the log-odds).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_HESSIAN = 1e-3


def percentiles(bins: int) -> list[float]:
    return [i / bins for i in range(1, bins)]


def with_bins(rows: DataFrame, keys: list[str], columns: list[str], bins: int) -> DataFrame:
    """rows with ``<column>_bin`` and ``<column>_cuts``: thresholds of each column among the rows of the same keys."""
    cuts = [F.array_distinct(F.percentile(c, F.array(*map(F.lit, percentiles(bins))))).alias(f"{c}_cuts") for c in columns]
    met = rows.join(rows.groupBy(*keys).agg(*cuts), keys)
    return met.withColumns({f"{c}_bin": F.size(F.filter(f"{c}_cuts", _below(c))) for c in columns})


def _below(column: str):
    return lambda t: t < F.col(column)


def histograms(binned: DataFrame, node: list[str], columns: list[str]) -> DataFrame:
    """(node, place, column, bin, cut, n, g, h): sums over rows with ``g`` and ``h`` of a node; ``cut`` is the bin's upper threshold, null for the last."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(f"{c}_bin").alias("bin"), F.get(f"{c}_cuts", F.col(f"{c}_bin")).alias("cut")) for i, c in enumerate(columns)]))
    sums = [F.count("*").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")]
    return binned.select(*node, "g", "h", cells.alias("x")).groupBy(*node, "x.place", "x.column", "x.bin", "x.cut").agg(*sums)


def best_splits(hist: DataFrame, node: list[str], min_samples_leaf: int, places: int = 9) -> DataFrame:
    """Per node its best split (column, cut, gain, n_left, left, right): left and right are the steps -g / h; nodes without one have no row.

    Gains that agree to ``places`` decimals are ties.
    """
    along = Window.partitionBy(*node, "place").orderBy("bin")
    whole = Window.partitionBy(*node, "place")
    low = {k: F.sum(k).over(along) for k in ("n", "g", "h")}
    rows = hist.withColumns({f"l{k}": v for k, v in low.items()} | {f"a{k}": F.sum(k).over(whole) for k in ("n", "g", "h")})
    c = F.col
    rows = rows.withColumns({"rn": c("an") - c("ln"), "rg": c("ag") - c("lg"), "rh": c("ah") - c("lh")}).where("cut is not null")
    rows = rows.where((c("ln") >= min_samples_leaf) & (c("rn") >= min_samples_leaf) & (c("lh") >= LEAST_HESSIAN) & (c("rh") >= LEAST_HESSIAN))
    gain = F.round(c("lg") * c("lg") / c("lh") + c("rg") * c("rg") / c("rh") - c("ag") * c("ag") / c("ah"), places)
    rows = rows.withColumn("gain", gain).where("gain > 0")
    best = F.min_by(F.struct("column", "cut", "gain", c("ln").alias("n_left"), (-c("lg") / c("lh")).alias("left"), (-c("rg") / c("rh")).alias("right")), F.struct(-c("gain"), "place", "bin"))
    return rows.groupBy(*node).agg(best.alias("s")).select(*node, "s.*")


def thresholds(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.percentile(c, np.array(percentiles(bins)) * 100)) for c in x.T]


def bin_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(t, c, "left") for t, c in zip(cuts, x.T)], 1)


@dataclass
class Booster:
    """Trees of all grid points (max_depth, min_samples_leaf), grown together on the same rows."""

    task: str  # "regression" or "classification"
    points: list[tuple[int, int]]
    iterations: int = 100
    rate: float = 0.1
    bins: int = 255
    cuts: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # column (-1: none), bin, value by (point, node)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        self.cuts = thresholds(x, self.bins)
        binned = bin_of(x, self.cuts)
        many, (n, width) = len(self.points), x.shape
        depth = max(d for d, _ in self.points)
        cells = max(len(t) for t in self.cuts) + 1
        limit, least = (np.array(v) for v in zip(*self.points))
        mean = float(np.mean(y))
        self.start = mean if self.task == "regression" else float(np.log(mean / (1 - mean)))
        raw = np.full((many, n), self.start)
        offsets = (np.arange(width) * cells + binned)[None]  # (1, n, width)
        open_end = np.arange(cells)[None, :] >= np.array([len(t) for t in self.cuts])[:, None]
        for _ in range(self.iterations):
            p = 1 / (1 + np.exp(-raw)) if self.task == "classification" else None
            g = raw - y if p is None else p - y
            h = np.ones_like(raw) if p is None else p * (1 - p)
            node = np.zeros((many, n), np.int64)
            size = 2 ** (depth + 1) - 1
            column, cut, value = np.full((many, size), -1), np.zeros((many, size), np.int64), np.zeros((many, size))
            for level in range(depth):
                first, here = 2**level - 1, 2**level
                at = (np.arange(many)[:, None] * here + node - first)[:, :, None] * (width * cells) + offsets
                live = np.broadcast_to((node >= first)[:, :, None], at.shape)
                flat = at[live]
                shape = (many, here, width, cells)
                sums = [np.bincount(flat, weights=None if w is None else np.broadcast_to(w[:, :, None], at.shape)[live], minlength=int(np.prod(shape))).reshape(shape) for w in (None, g, h)]
                (ln, lg, lh), (an, ag, ah) = (np.cumsum(s, 3) for s in sums), (s.sum(3, keepdims=True) for s in sums)
                rn, rg, rh = an - ln, ag - lg, ah - lh
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = lg * lg / lh + rg * rg / rh - ag * ag / ah
                floor = least[:, None, None, None]
                ok = (ln >= floor) & (rn >= floor) & (lh >= LEAST_HESSIAN) & (rh >= LEAST_HESSIAN) & ~open_end & (limit > level)[:, None, None, None]
                gain = np.where(ok, np.round(gain, 9), 0.0).reshape(many, here, -1)
                best = gain.argmax(2)
                split = np.take_along_axis(gain, best[:, :, None], 2)[:, :, 0] > 0
                column[:, first : first + here] = np.where(split, best // cells, -1)
                cut[:, first : first + here] = best % cells
                chosen, bound = np.take_along_axis(column, node, 1), np.take_along_axis(cut, node, 1)
                goes = (node >= first) & (chosen >= 0)
                right = binned[np.arange(n)[None], np.maximum(chosen, 0)] > bound
                node = np.where(goes, 2 * node + 1 + right, node)
            key = np.arange(many)[:, None] * size + node
            top, bottom = (np.bincount(key.ravel(), weights=w.ravel(), minlength=many * size).reshape(many, size) for w in (g, h))
            value = -self.rate * top / (bottom + 1e-15)
            raw += np.take_along_axis(value, node, 1)
            self.trees.append((column, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(points, rows): means, or probabilities of class 1."""
        binned = bin_of(x, self.cuts)
        raw = np.full((len(self.points), len(x)), self.start)
        rows = np.arange(len(x))[None]
        for column, cut, value in self.trees:
            node = np.zeros(raw.shape, np.int64)
            for _ in range(max(d for d, _ in self.points)):
                chosen = np.take_along_axis(column, node, 1)
                right = binned[rows, np.maximum(chosen, 0)] > np.take_along_axis(cut, node, 1)
                node = np.where(chosen >= 0, 2 * node + 1 + right, node)
            raw += np.take_along_axis(value, node, 1)
        return 1 / (1 + np.exp(-raw)) if self.task == "classification" else raw
