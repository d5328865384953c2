"""Principal components, linear discriminants and logistic regression: sums by Spark, small algebra on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.optimize import bfgs, lbfgs
from quarry.functions.vector import dot_with_intercept, log1pe, logistic, softmax
from quarry.operators.statistics import check_labels, gram


def _linear(features, weights: np.ndarray, constant: float = 0.0) -> Column:
    x = F.col(features) if isinstance(features, str) else features
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(constant)), lambda s, v: s + v)


@dataclass
class PCA:
    """Components in order of falling variance; the largest weight of each is positive."""

    mean: np.ndarray
    variances: np.ndarray
    loadings: np.ndarray  # one column a component
    kept: int

    @staticmethod
    def fit(frame: DataFrame, column: str = "features", correlation: bool = False) -> "PCA":
        n, s, g = gram(frame, column)
        mean = s / n
        cov = g / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        if correlation:
            cov = cov / np.outer(sd, sd)
        values, vectors = np.linalg.eigh(cov)
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
        if correlation:
            vectors = vectors / sd[:, None]
        return PCA(mean, values, vectors, len(values)).with_share(0.95)

    @property
    def proportion(self) -> np.ndarray:
        return self.variances / self.variances.sum()

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.proportion)

    def with_components(self, p: int) -> "PCA":
        if not 1 <= p <= len(self.variances):
            raise ValueError(f"Invalid dimension of feature space: {p}")
        return PCA(self.mean, self.variances, self.loadings, p)

    def with_share(self, share: float) -> "PCA":
        if not 0 < share <= 1:
            raise ValueError(f"Invalid percentage of variance: {share}")
        return self.with_components(int(np.searchsorted(self.cumulative, share - 1e-12)) + 1)

    def project(self, frame: DataFrame, column: str = "features", to: str = "projected") -> DataFrame:
        checked = F.when(F.size(column) != len(self.mean), F.raise_error(F.lit("Invalid input vector size")).cast("array<double>")).otherwise(F.col(column))
        w = self.loadings[:, : self.kept]
        return frame.withColumn(to, F.array(*[_linear(checked, w[:, k], -(w[:, k] @ self.mean)) for k in range(self.kept)]))


@dataclass
class Discriminant:
    means: np.ndarray
    priors: np.ndarray
    directions: np.ndarray
    variances: np.ndarray

    @staticmethod
    def fit(frame: DataFrame, features: str = "features", label: str = "label", priors: list[float] | None = None, tolerance: float = 1e-4) -> "Discriminant":
        if tolerance < 0:
            raise ValueError(f"Invalid tol: {tolerance}")
        labels = check_labels(frame, label)
        sums = [gram(frame.where(F.col(label) == k), features) for k in labels]
        n = sum(s[0] for s in sums)
        if n <= len(labels):
            raise ValueError("Sample size is too small")
        if priors is not None and (len(priors) != len(labels) or any(p <= 0 or p >= 1 for p in priors) or abs(sum(priors) - 1) > 1e-10):
            raise ValueError("Invalid priori probabilities")
        means = np.array([s / m for m, s, _ in sums])
        within = sum(g - m * np.outer(c, c) for (m, _, g), c in zip(sums, means)) / (n - len(labels))
        values, vectors = np.linalg.eigh(within)
        if (values < tolerance**2).any():
            raise ValueError("Covariance matrix is close to singular")
        return Discriminant(means, np.array(priors) if priors else np.array([m for m, _, _ in sums]) / n, vectors, values)

    def scores(self, features: str = "features") -> Column:
        """ln prior - half the squared distance to the mean, as linear functions of the features plus a common term."""
        inverse = self.directions @ np.diag(1 / self.variances) @ self.directions.T
        return F.array(*[_linear(features, inverse @ m, np.log(p) - m @ inverse @ m / 2) for m, p in zip(self.means, self.priors)])

    def predict(self, frame: DataFrame, features: str = "features") -> DataFrame:
        scored = frame.withColumn("_s", self.scores(features))
        return scored.withColumn("posterior", softmax("_s")).withColumn("predicted", (F.array_position("_s", F.array_max("_s")) - 1).cast("int")).drop("_s")


def logistic_terms(features: str, label: str, weights: list[float]) -> tuple[Column, Column]:
    """(loss, sigma(z) - y) of a row at fixed weights, intercept last."""
    z = dot_with_intercept(features, F.array(*[F.lit(float(w)) for w in weights]))
    return log1pe(z) - F.col(label) * z, logistic(z) - F.col(label)


def logistic_objective(frame: DataFrame, weights: list[float], penalty: float = 0.0, features: str = "features", label: str = "label") -> DataFrame:
    """One row: value and gradient g0 .. gp (intercept last, not penalised), a single aggregate."""
    loss, error = logistic_terms(features, label, weights)
    x = F.col(features)
    p = len(weights) - 1
    rows = frame.select(loss.alias("_l"), error.alias("_e"), x.alias("_x"))
    gradient = [(F.sum(F.col("_e") * F.col("_x")[i]) + penalty * weights[i]).alias(f"g{i}") for i in range(p)]
    value = F.sum("_l") + penalty / 2 * sum(w * w for w in weights[:p])
    return rows.agg(value.alias("value"), *gradient, F.sum("_e").alias(f"g{p}"))


def multiclass_scores(weights: list[list[float]], features: str = "features") -> Column:
    flat = F.array(*[F.lit(float(v)) for w in weights for v in w])
    return F.array(*[dot_with_intercept(features, flat, k) for k in range(len(weights))])


def multiclass_objective(frame: DataFrame, weights: list[list[float]], penalty: float = 0.0, features: str = "features", label: str = "label") -> DataFrame:
    """-sum ln p[y] + penalty / 2 * sum w^2 (without intercepts)."""
    p = softmax(multiclass_scores(weights, features))
    return frame.agg((-F.sum(F.log(p[F.col(label)])) + penalty / 2 * sum(v * v for w in weights for v in w[:-1])).alias("value"))


@dataclass
class Logistic:
    weights: np.ndarray  # (p + 1) for two classes, (k, p + 1) else
    objective: float

    @property
    def log_likelihood(self) -> float:
        return -self.objective

    @staticmethod
    def fit(frame: DataFrame, features: str = "features", label: str = "label", penalty: float = 0.0, tolerance: float = 1e-5, iterations: int = 500) -> "Logistic":
        """L-BFGS on the driver (BFGS if it fails); each evaluation is one pass with a row of sums a task."""
        if penalty < 0:
            raise ValueError(f"Invalid regularization factor: {penalty}")
        if tolerance <= 0:
            raise ValueError(f"Invalid tolerance: {tolerance}")
        if iterations <= 0:
            raise ValueError(f"Invalid maximum number of iterations: {iterations}")
        k = len(check_labels(frame, label))
        rows = frame.select(features, F.col(label).cast("int").alias("label")).cache()
        width = len(rows.first()[0]) + 1
        size = width if k == 2 else k * width

        def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
            parts = rows.mapInArrow(_loss_and_gradient(w, k, width), "value double, gradient binary").collect()
            value, gradient = sum(r.value for r in parts), sum(np.frombuffer(r.gradient) for r in parts)
            free = w.reshape(-1, width).copy()
            free[:, -1] = 0
            return value + penalty / 2 * float((free**2).sum()), gradient + penalty * free.ravel()

        try:
            try:
                w, value = lbfgs(evaluate, np.zeros(size), 5, tolerance, iterations)
            except (RuntimeError, ValueError):
                w, value = bfgs(evaluate, np.zeros(size), tolerance, iterations)
        finally:
            rows.unpersist()
        return Logistic(w if k == 2 else w.reshape(k, width), value)

    def predict(self, frame: DataFrame, features: str = "features") -> DataFrame:
        """posterior (array) and predicted; with two classes 0 if sigma < 0.5."""
        if self.weights.ndim == 1:
            s = logistic(dot_with_intercept(features, F.array(*[F.lit(float(w)) for w in self.weights])))
            return frame.withColumn("posterior", F.array(1 - s, s)).withColumn("predicted", (s >= 0.5).cast("int"))
        scored = frame.withColumn("_s", multiclass_scores(self.weights.tolist(), features))
        return scored.withColumn("posterior", softmax("_s")).withColumn("predicted", (F.array_position("_s", F.array_max("_s")) - 1).cast("int")).drop("_s")


def _loss_and_gradient(w: np.ndarray, k: int, width: int):
    def run(batches):
        value, gradient = 0.0, np.zeros_like(w)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.column_stack([np.asarray(batch.column(0).flatten(), float).reshape(n, -1), np.ones(n)])
            y = batch.column(1).to_numpy()
            if k == 2:
                z = x @ w
                value += float(np.logaddexp(0, z).sum() - z @ y)
                gradient += x.T @ (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
            else:
                z = x @ w.reshape(k, width).T
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                total = p.sum(axis=1, keepdims=True)
                value += float((np.log(total[:, 0]) - z[np.arange(n), y]).sum())
                p /= total
                p[np.arange(n), y] -= 1
                gradient += (p.T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([gradient.tobytes()])], ["value", "gradient"])

    return run
