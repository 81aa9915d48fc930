"""A linear support-vector classifier with calibrated probabilities. M1-M5, O6, O7, A21, A22.

Training sets are the user's two files, thousands of rows of up to three numbers: they are gathered and solved by
numpy. The grid search deals its (C, fold) fits to the executors. Prediction is a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = tuple(np.logspace(-6, 6, 13))


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    bias: float
    slope: float
    shift: float
    quality: float = 1.0

    def margin(self, features: Sequence[str]) -> Column:
        out = F.lit(self.bias)
        for f, w in zip(features, self.weights, strict=True):
            out = out + F.col(f) * F.lit(w)
        return out

    def probability(self, margin: Column) -> Column:
        return 1 / (1 + F.exp(margin * self.slope + self.shift))


def solve(x: np.ndarray, y: np.ndarray, c: float, weight: np.ndarray, tolerance: float = 1e-3, steps: int = 100_000) -> tuple[np.ndarray, float]:
    """Weights and bias of the C-SVM with hinge loss, the bias unpenalised: pairs of the dual that violate most, in turn."""
    upper, alpha, gradient = c * weight, np.zeros(len(x)), -np.ones(len(x))
    w = np.zeros(x.shape[1])
    square = (x * x).sum(1)
    for _ in range(steps):
        score = -y * gradient
        up = np.where(((y > 0) & (alpha < upper)) | ((y < 0) & (alpha > 0)), score, -np.inf)
        low = np.where(((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < upper)), score, np.inf)
        i, j = int(up.argmax()), int(low.argmin())
        if up[i] - low[j] < tolerance:
            break
        curve = max(square[i] + square[j] - 2 * x[i] @ x[j], 1e-12)
        step = (up[i] - low[j]) / curve
        step = min(step, (upper[i] - alpha[i]) if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else (upper[j] - alpha[j]))
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        change = step * (x[i] - x[j])
        w += change
        gradient += y * (x @ change)
    score = -y * gradient
    free = (alpha > 1e-12) & (alpha < upper - 1e-12)
    if free.any():
        return w, float(score[free].mean())
    up = np.where(((y > 0) & (alpha < upper)) | ((y < 0) & (alpha > 0)), score, -np.inf).max()
    low = np.where(((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < upper)), score, np.inf).min()
    return w, float((up + low) / 2)


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that give both classes the same total."""
    n = np.array([(y < 0).sum(), (y > 0).sum()])
    return np.where(y > 0, len(y) / (2 * max(n[1], 1)), len(y) / (2 * max(n[0], 1)))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(u12) = 1 / (1 + exp(slope * margin + shift)), by Newton's method on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack([margin, np.ones_like(margin)], 1)
    at = np.array([0.0, np.log((n0 + 1) / (n1 + 1))])

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return float((target * z + np.logaddexp(0, -z)).sum())

    for _ in range(100):
        z = design @ at
        p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
        g = design.T @ (target - p)
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-12 * np.eye(2)
        if np.abs(g).max() < 1e-5:
            break
        move, size, now = np.linalg.solve(h, g), 1.0, loss(at)
        while size > 1e-10 and loss(at - size * move) > now - 1e-4 * size * (g @ move):
            size /= 2
        at = at - size * move
    return float(at[0]), float(at[1])


def folds(y: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A fold for each row, each class spread evenly."""
    rng, out = np.random.default_rng(seed), np.zeros(len(y), int)
    for c in (-1, 1):
        at = rng.permutation(np.flatnonzero(y == c))
        out[at] = np.arange(len(at)) % k
    return out


def f1(y: np.ndarray, guess: np.ndarray) -> float:
    tp = ((y > 0) & (guess > 0)).sum()
    return float(2 * tp / max(2 * tp + ((y < 0) & (guess > 0)).sum() + ((y > 0) & (guess < 0)).sum(), 1))


def fit(x: np.ndarray, y: np.ndarray, c: float, weighted: bool = True, seed: int = 42) -> Model:
    """Trained on a stratified 80 %, calibrated by five-fold margins, with the F1 of the other 20 % as its quality. M2."""
    held = folds(y, 5, seed) == 0
    tx, ty = x[~held], y[~held]
    weigh = balanced if weighted else lambda v: np.ones(len(v))
    w, b = solve(tx, ty, c, weigh(ty))
    inner, margin = folds(ty, 5, seed + 1), np.zeros(len(ty))
    for k in range(5):
        v, a = solve(tx[inner != k], ty[inner != k], c, weigh(ty[inner != k]))
        margin[inner == k] = tx[inner == k] @ v + a
    slope, shift = platt(margin, ty)
    return Model(tuple(map(float, w)), b, slope, shift, f1(y[held], np.sign(x[held] @ w + b)))


def _accuracy(x: np.ndarray, y: np.ndarray, c: float, fold: int, seed: int) -> float:
    at = folds(y, 5, seed)
    w, b = solve(x[at != fold], y[at != fold], c, balanced(y[at != fold]))
    guess = np.sign(x[at == fold] @ w + b)
    return float(np.mean([(guess[y[at == fold] == k] == k).mean() for k in (-1, 1)]))


def search(spark: SparkSession, x: np.ndarray, y: np.ndarray, rounds: int = 5, divisions: int = 100) -> float:
    """The penalty C: each round scores a grid by five-fold balanced accuracy, takes the geometric mean of the best and
    narrows the grid to its neighbours. Fits are spread over the cluster. M3."""
    shared = spark.sparkContext.broadcast((x, y))
    grid = np.array(GRID)
    for r in range(rounds):

        def run(frames: Iterator[pd.DataFrame], seed: int = 42 + r) -> Iterator[pd.DataFrame]:
            for rows in frames:
                yield rows.assign(score=[_accuracy(*shared.value, c, int(k), seed) for c, k in zip(rows.c, rows.fold, strict=True)])

        tasks = pd.DataFrame([(float(c), k) for c in grid for k in range(5)], columns=["c", "fold"])
        scores = spark.createDataFrame(tasks).repartition(min(len(tasks), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "c double, fold long, score double").groupBy("c").agg(F.avg("score").alias("s")).toPandas().sort_values("c")
        best = scores.c[np.isclose(scores.s, scores.s.max())].to_numpy()
        centre = float(np.exp(np.log(best).mean()))
        values = scores.c.to_numpy()
        at = int(np.abs(values - centre).argmin())
        low, high = values[max(at - 1, 0)], values[min(at + 1, len(values) - 1)]
        grid = np.geomspace(low, high, divisions)
    return float(np.sqrt(grid[0] * grid[-1]))


def subsets(x: np.ndarray, y: np.ndarray, count: int, seed: int = 42) -> list[np.ndarray]:
    """Row numbers of training sets: all of the rare class with disjoint samples of the other, as large. O7."""
    if not count:
        return [np.arange(len(y))]
    rare, other = np.flatnonzero(y > 0), np.random.default_rng(seed).permutation(np.flatnonzero(y < 0))
    return [np.concatenate([rare, other[i * len(rare) : (i + 1) * len(rare)]]) for i in range(min(count, len(other) // max(len(rare), 1)))]


def train(spark: SparkSession, references: DataFrame, features: Sequence[str], subsamples: int = 0, c: float | None = None, rounds: int = 5) -> list[Model]:
    """Models of references (features, type_id); a single one, or one for each subset."""
    rows = references.select(*features, "type_id").toPandas()
    x, y = rows[list(features)].to_numpy(float), np.where(rows.type_id == "u12", 1.0, -1.0)
    c = c or search(spark, x, y, rounds)
    return [fit(x[s], y[s], c, not subsamples) for s in subsets(x, y, subsamples)]


def predict(introns: DataFrame, models: Sequence[Model], features: Sequence[str], threshold: float) -> DataFrame:
    """svm_score, score_distance, label_ratio, relative_score and type_id. Votes of several models are weighted by their
    quality and averaged plainly; the type follows the votes, not the threshold. M4, M5."""
    many = len(models) > 1
    margins = [m.margin(features) for m in models]
    weights = [m.quality if many else 1.0 for m in models]
    mean = lambda cols: sum(cols[1:], cols[0]) / len(cols)
    probability = mean([m.probability(d) * w for m, d, w in zip(models, margins, weights, strict=True)])
    distance = mean([d * w for d, w in zip(margins, weights, strict=True)])
    ratio = mean([(d > 0).cast("double") for d in margins])
    out = introns.withColumns({"svm_score": probability * 100, "score_distance": distance, "label_ratio": ratio})
    return out.withColumns({"relative_score": F.col("svm_score") - threshold, "type_id": F.when(F.col("label_ratio") > 0.5, "u12").otherwise("u2")})
