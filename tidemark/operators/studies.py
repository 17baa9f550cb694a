"""Studies over many keys at once: collinearity, unit roots with a chosen lag, and two feature sets compared fold by fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.operators import models
from tidemark.sources.storage import scratch_dir

# collinearity


def collinearity_by_key(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, rows, condition_number, vifs, worst, max_vif) from one aggregate of correlations a key.

    Eigenvalues and inverses of all keys of an Arrow batch are taken at once.  A key with a constant column has nulls; a singular matrix has
    an infinite condition number, stored as null, and the pseudo-inverse's factors.
    """
    size = len(columns)
    pairs = [(i, j) for i in range(size) for j in range(size)]
    corr = F.array(*[F.lit(1.0) if i == j else F.try_divide(F.covar_pop(columns[min(i, j)], columns[max(i, j)]), F.stddev_pop(columns[i]) * F.stddev_pop(columns[j])) for i, j in pairs])
    per = rows.dropna(subset=columns).groupBy(key).agg(F.count("*").alias("rows"), corr.alias("corr"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.array([x if x is not None and None not in x else [np.nan] * size * size for x in batch.column(2).to_pylist()], float).reshape(-1, size, size)
            fine = np.isfinite(m).all(axis=(1, 2))
            safe = np.where(fine[:, None, None], m, np.eye(size))
            values = np.linalg.eigvalsh(safe)
            vif = np.diagonal(np.linalg.pinv(safe), axis1=1, axis2=2)
            positive = values[:, 0] > 1e-12
            number = np.sqrt(values[:, -1] / np.where(positive, values[:, 0], 1))
            worst = vif.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(number, mask=~(fine & positive)), pa.array([list(v) if f else None for v, f in zip(vif, fine)], pa.list_(pa.float64())), pa.array([columns[i] for i in worst], mask=~fine), pa.array(vif.max(axis=1), mask=~fine)],
                [key, "rows", "condition_number", "vifs", "worst", "max_vif"],
            )

    kind = dict(rows.dtypes)[key]
    return per.select(key, "rows", "corr").mapInArrow(solve, f"`{key}` {kind}, rows long, condition_number double, vifs array<double>, worst string, max_vif double")


# unit roots


def _regressors(x: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (1, level, lags changes back) and the changes they explain, without the first ``skip`` changes."""
    change = np.diff(x)
    at = np.arange(skip, len(change))
    return np.column_stack([np.ones(len(at)), x[at], *[change[at - k] for k in range(1, lags + 1)]]), change[at]


def nested_residuals(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Residual sums of squares of y on the first 1, 2, ... columns of z, from one triangular factor of their common Gram matrix."""
    both = np.column_stack([z, y])
    scale = np.sqrt((both * both).sum(axis=0))
    factor = np.linalg.cholesky((both / scale).T @ (both / scale))
    return (1 - np.cumsum(factor[-1, :-1] ** 2)) * scale[-1] ** 2


def dickey_fuller(x: np.ndarray, max_lag: int | None = None) -> tuple[float, int, int] | None:
    """(statistic, lag, rows): a constant, lags chosen by the least AIC on common rows, then all rows that lag leaves; None if undefined."""
    most = int(np.ceil(12 * (len(x) / 100) ** 0.25)) if max_lag is None else max_lag
    most = min(most, len(x) // 2 - 3)
    if most < 0 or not np.isfinite(x).all() or np.ptp(x) == 0:
        return None
    try:
        z, y = _regressors(x, most, most)
        rss = nested_residuals(z, y)[1:]
        lag = int(np.argmin(np.round(len(y) * np.log(rss / len(y)) + 2 * np.arange(2, most + 3), 9)))
        z, y = _regressors(x, lag, lag)
        rss = nested_residuals(z, y)[-1]
        spread = rss / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1]
        slope = np.linalg.solve(z.T @ z, z.T @ y)[1]
    except np.linalg.LinAlgError:
        return None
    return (float(slope / np.sqrt(spread)), lag, len(y)) if spread > 0 else None


def mackinnon_p(statistic: Column) -> Column:
    """Approximate p-value of a statistic with a constant."""
    # fixed values: MacKinnon (1994), one series, constant
    low = 2.1659 + 1.4412 * statistic + 0.038269 * statistic * statistic
    high = 1.7339 + 0.93202 * statistic - 0.12745 * statistic * statistic - 0.010368 * statistic * statistic * statistic
    p = normal.cumulative(F.when(statistic <= -1.61, low).otherwise(high))
    return F.when(statistic > 2.74, 1.0).when(statistic < -18.83, 0.0).otherwise(p)


def unit_roots(rows: DataFrame, key: str, order: str, x: str, max_lag: int | None = None, level: float = 0.05) -> DataFrame:
    """(key, n, lag, statistic, p_value, stationary) of each key's series in order; rows without a value are left out.  A group is one history."""
    kind = dict(rows.dtypes)[key]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = dickey_fuller(group.sort_values(order)[x].to_numpy(float), max_lag)
        return pd.DataFrame([(group[key].iloc[0], *(found or (None, None, None)))], columns=[key, "statistic", "lag", "n"])

    found = rows.select(key, order, x).where(F.col(x).isNotNull()).groupBy(key).applyInPandas(run, f"`{key}` {kind}, statistic double, lag long, n long")
    return found.select(key, "n", "lag", "statistic", mackinnon_p(F.col("statistic")).alias("p_value")).withColumn("stationary", F.col("p_value") < level)


# two feature sets


def feature_set_predictions(rows: DataFrame, sets: dict[str, list[str]], entries: list[tuple[str, str]], labels: dict[str, Column]) -> DataFrame:
    """(entry, task, feature_set, ticker, fold, date, label, prediction) of every estimator (name, task) on every feature set, untuned.

    The fold rows are made once and written; all fits read that table, and what one gives doesn't depend on the others.
    """
    spark = rows.sparkSession
    path = scratch_dir(spark)
    columns = sorted({c for s in sets.values() for c in s})
    rows.withColumns({f"label_{task}": labels[task] for task in {t for _, t in entries}}).select("ticker", "fold", "role", "date", "position", *columns, *[f"label_{t}" for t in sorted({t for _, t in entries})]).write.parquet(path)
    shared, out = spark.read.parquet(path), None
    for name, task in entries:
        models.estimator(name, task)
        own = shared.withColumn("label", F.col(f"label_{task}"))
        truth = own.where("role = 'test'").select("ticker", "fold", "date", "label")
        for label, columns in sets.items():
            said = models.boosted_predictions(own, task, columns) if name == "hgb" else models.walk_forward_predictions(own, name, columns)
            one = said.select("ticker", "fold", "date", "prediction").join(truth, ["ticker", "fold", "date"]).select(F.lit(name).alias("entry"), F.lit(task).alias("task"), F.lit(label).alias("feature_set"), "ticker", "fold", "date", "label", "prediction")
            out = one if out is None else out.unionByName(one)
    return out


def paired(predictions: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of both feature sets with a label, by (entry, task, ticker, fold, date): label, a, b."""
    keys = ["entry", "task", "ticker", "fold", "date"]
    a, b = (predictions.where(F.col("feature_set") == s) for s in (first, second))
    return a.select(*keys, "label", F.col("prediction").alias("a")).join(b.select(*keys, F.col("prediction").alias("b")), keys).where("label is not null")


def compare_regressions(pairs: DataFrame, key: str, places: int = 9) -> DataFrame:
    """Wilcoxon rank sums by key of squared errors, first set minus second, that agree to ``places`` decimals as ties."""
    d = F.round(F.pow(F.col("a") - F.col("label"), 2) - F.pow(F.col("b") - F.col("label"), 2), places)
    return models.signed_ranks(pairs.where("task = 'regression'").withColumn("difference", d), key)


def compare_classifications(pairs: DataFrame, key: str) -> DataFrame:
    """The two-by-two table of right and wrong answers by key, with McNemar's exact p from its discordant pairs."""
    from tidemark.operators.orders import binomial_p

    side = lambda c: (F.col(c) >= 0.5).cast("double")
    counts = models.paired_counts(pairs.where("task = 'classification'").select(key, "label", side("a").alias("a"), side("b").alias("b")), key)
    return counts.withColumn("p_value", binomial_p(F.col("only_a"), F.col("only_a") + F.col("only_b")))
