"""Behaviour of vessels along tracks: mixtures and hidden Markov models by trip, and tree classifiers with folds by trip."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grouped import grouped
from .summary import grouped_folds


def _normal(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Densities (n, k) of rows of x under k normals with diagonal variances."""
    d = x[:, None, :] - mean[None]
    return np.exp(-0.5 * (d * d / var[None] + np.log(2 * np.pi * var[None])).sum(2)) + 1e-300


def em(x: np.ndarray, k: int, rounds: int = 200, tol: float = 1e-8):
    """Gaussian mixture with diagonal variances; states in order of the first mean."""
    order = np.quantile(x[:, 0], (np.arange(k) + 0.5) / k)
    mean = np.stack([x[np.argmin(np.abs(x[:, 0] - q))] for q in order]).astype(float)
    floor = np.maximum(x.var(0) * 1e-4, 1e-9)
    var, weight, last = np.tile(np.maximum(x.var(0), floor), (k, 1)), np.full(k, 1 / k), -np.inf
    for _ in range(rounds):
        p = _normal(x, mean, var) * weight
        like = np.log(p.sum(1)).sum()
        r = p / p.sum(1, keepdims=True)
        n = r.sum(0) + 1e-12
        weight, mean = n / n.sum(), (r.T @ x) / n[:, None]
        var = np.maximum((r.T @ (x * x)) / n[:, None] - mean**2, floor)
        if abs(like - last) < tol * max(1, abs(like)):
            break
        last = like
    sort = np.argsort(mean[:, 0])
    return weight[sort], mean[sort], var[sort]


def baum_welch(x: np.ndarray, k: int, rounds: int = 100, tol: float = 1e-6):
    """Gaussian hidden Markov model from a mixture start; then its Viterbi path."""
    weight, mean, var = em(x, k)
    move, floor, last = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)), np.maximum(x.var(0) * 1e-4, 1e-9), -np.inf
    for _ in range(rounds):
        b = _normal(x, mean, var)
        a, c = np.empty_like(b), np.empty(len(x))
        row = weight * b[0]
        for t in range(len(x)):
            row = row if t == 0 else (a[t - 1] @ move) * b[t]
            c[t] = row.sum()
            a[t] = row / c[t]
        z = np.ones_like(b)
        for t in range(len(x) - 2, -1, -1):
            z[t] = move @ (b[t + 1] * z[t + 1]) / c[t + 1]
        g = a * z
        g /= g.sum(1, keepdims=True)
        if len(x) > 1:
            pair = move * ((a[:-1] / c[1:, None]).T @ (b[1:] * z[1:]))
            move = pair / np.maximum(pair.sum(1, keepdims=True), 1e-12)
        n = g.sum(0) + 1e-12
        weight, mean = g[0], (g.T @ x) / n[:, None]
        var = np.maximum((g.T @ (x * x)) / n[:, None] - mean**2, floor)
        like = np.log(c).sum()
        if abs(like - last) < tol * max(1, abs(like)):
            break
        last = like
    score, back = np.log(weight + 1e-300) + np.log(_normal(x[:1], mean, var))[0], []
    for row in np.log(_normal(x, mean, var))[1:]:
        step = score[:, None] + np.log(move + 1e-300)
        back.append(step.argmax(0))
        score = step.max(0) + row
    path = [int(score.argmax())]
    for p in reversed(back):
        path.append(int(p[path[-1]]))
    return move, mean, var, np.array(path[::-1])


def _by_trip(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], extra: list[tuple[str, T.DataType]], fit) -> DataFrame:

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        out = {n: pd.Series([None] * len(pdf), index=pdf.index, dtype=object) for n, _ in extra}
        x = pdf[list(columns)].astype(float)
        ok = x.notna().all(axis=1).to_numpy()
        if ok.sum() > 4 and x[ok].iloc[:, 0].nunique() > 1:
            for name, value in fit(x[ok].to_numpy()).items():
                full = np.full(len(pdf), None, dtype=object)
                full[ok] = value
                out[name] = pd.Series(full, index=pdf.index)
        return pdf.assign(**out)

    return grouped(df, by, extra, run)


def gaussian_thresholds(df: DataFrame, speed: str, by: Sequence[str], order: Sequence[str], k: int = 3) -> DataFrame:
    """Mixture of speeds by trip: adds threshold_lower and threshold_upper of the middle state (mean and two deviations)."""

    def fit(x):
        _, mean, var = em(x, k)
        mid, sd = mean[k // 2, 0], np.sqrt(var[k // 2, 0])
        return {"threshold_lower": float(max(0, mid - 2 * sd)), "threshold_upper": float(mid + 2 * sd)}

    return _by_trip(df, by, order, [speed], [("threshold_lower", T.DoubleType()), ("threshold_upper", T.DoubleType())], fit)


def binary_clusters(df: DataFrame, speed: str, turn: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Classes 1 to 4 (column A) of low or high speed and small or large turns, by the midpoints of two-state mixtures."""

    def fit(x):
        cut = [em(x[:, [c]], 2)[1].mean() if np.unique(x[:, c]).size > 1 else x[:, c].mean() for c in (0, 1)]
        return {"A": (1 + 2 * (x[:, 0] > cut[0]) + (x[:, 1] > cut[1])).astype(int).tolist()}

    return _by_trip(df, by, order, [speed, turn], [("A", T.IntegerType())], fit)


def hidden_states(df: DataFrame, columns: Sequence[str], by: Sequence[str], order: Sequence[str], k: int = 2) -> DataFrame:
    """Hidden Markov model by trip on step (and turn): adds vit, the Viterbi state 1 to k in order of mean step."""
    return _by_trip(df, by, order, columns, [("vit", T.IntegerType())], lambda x: {"vit": (baum_welch(x, k)[3] + 1).tolist()})


def forest_by_trip(df: DataFrame, features: Sequence[str], label: str, trip: str, folds: int = 5, trees: int = 50, seed: int = 1) -> DataFrame:
    """Predictions of random forests, each row by the forest that did not see its trip: adds fold and predicted."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    rows = df.na.drop(subset=[*features, label]).withColumn("fold", grouped_folds(F.col(trip), folds))
    index = StringIndexer(inputCol=label, outputCol="_label").fit(rows)
    out = None
    for k in range(folds):
        model = Pipeline(stages=[index, VectorAssembler(inputCols=list(features), outputCol="_x"), RandomForestClassifier(labelCol="_label", featuresCol="_x", numTrees=trees, seed=seed, predictionCol="_p"), IndexToString(inputCol="_p", outputCol="predicted", labels=index.labels)]).fit(rows.where(F.col("fold") != k))
        part = model.transform(rows.where(F.col("fold") == k)).select(*df.columns, "fold", "predicted")
        out = part if out is None else out.unionByName(part)
    return out
