"""Small feed-forward networks without bias terms: forward passes as expressions, training by online gradient steps."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.vector import let, logistic, softmax

HIDDEN = {"LogisticSigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40))), lambda o: o * (1 - o)), "Tanh": (np.tanh, lambda o: 1 - o * o)}


@dataclass
class Network:
    """layers: units from input to output; kind: classification or regression (one linear output)."""

    layers: list[int]
    kind: str = "classification"
    error: str = "CrossEntropy"  # or LeastMeanSquares
    output: str | None = None  # Linear, LogisticSigmoid, SoftMax
    hidden: str = "LogisticSigmoid"  # or Tanh
    rate: float = 0.1
    momentum: float = 0.0
    decay: float = 0.0
    epochs: int = 25
    seed: int = 0
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        if len(self.layers) < 2:
            raise ValueError(f"Invalid number of layers: {len(self.layers)}")
        if min(self.layers) < 1:
            raise ValueError("Invalid number of units")
        if self.rate <= 0 or not 0 <= self.momentum < 1 or not 0 <= self.decay <= 0.1 or self.epochs < 1:
            raise ValueError("Invalid learning rate, momentum, weight decay or epochs")
        units = self.layers[-1]
        if self.kind == "regression":
            if units != 1:
                raise ValueError("Regression has one output unit")
            self.error, self.output = "LeastMeanSquares", "Linear"
        if self.output is None:
            self.output = "LogisticSigmoid" if self.error == "LeastMeanSquares" or units == 1 else "SoftMax"
        bad = {("LeastMeanSquares", "SoftMax"), ("CrossEntropy", "Linear")}
        if (self.error, self.output) in bad or self.error == "CrossEntropy" and (self.output == "SoftMax") == (units == 1):
            raise ValueError(f"Invalid combination: {self.error}, {self.output}, {units} output units")
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            self.weights = [rng.uniform(-0.5, 0.5, (b, a)) / np.sqrt(a) for a, b in zip(self.layers, self.layers[1:])]

    def target(self, y) -> np.ndarray:
        if self.kind == "regression":
            return np.array([float(y)])
        units = self.layers[-1]
        if not 0 <= int(y) < max(2, units):
            raise ValueError(f"Invalid class label: {y}")
        high, low = (1.0, 0.0) if self.error == "CrossEntropy" else (0.9, 0.1)
        return np.array([high if y == 0 else low]) if units == 1 else np.where(np.arange(units) == int(y), high, low)

    def _out(self, z: np.ndarray) -> np.ndarray:
        if self.output == "Linear":
            return z
        if self.output == "LogisticSigmoid":
            return HIDDEN["LogisticSigmoid"][0](z)
        e = np.exp(z - z.max())
        return e / e.sum()

    def step(self, x: np.ndarray, y, weights: list[np.ndarray], last: list[np.ndarray]) -> float:
        f, slope = HIDDEN[self.hidden]
        outs = [x]
        for w in weights[:-1]:
            outs.append(f(w @ outs[-1]))
        outs.append(self._out(weights[-1] @ outs[-1]))
        t = self.target(y)
        delta = t - outs[-1]
        loss = float(delta @ delta) / 2
        if self.error == "LeastMeanSquares" and self.output == "LogisticSigmoid":
            delta = delta * outs[-1] * (1 - outs[-1])
        for k in range(len(weights) - 1, -1, -1):
            back = weights[k].T @ delta
            move = self.rate * np.outer(delta, outs[k]) + self.momentum * last[k]
            last[k] = move
            weights[k] = weights[k] * (1 - self.rate * self.decay) + move
            if k:
                delta = back * slope(outs[k])
        return loss

    def fit(self, rows: DataFrame, features: str = "features", label: str = "label", order: str | None = None) -> "Network":
        """Each epoch every task steps through its rows from the current weights; weights are averaged by rows.

        With one partition sorted by `order` this is plain online learning.  A task holds one batch.
        """
        data = rows.select(features, F.col(label).cast("double").alias("y"), *([order] if order else []))
        if order:
            data = data.sortWithinPartitions(order)
        data = data.select(features, "y").cache()
        try:
            for _ in range(self.epochs):
                self.weights = self._epoch(data)
        finally:
            data.unpersist()
        return self

    def _epoch(self, data: DataFrame) -> list[np.ndarray]:
        net, start = self, [w.copy() for w in self.weights]

        def run(batches):
            weights, last, n = [w.copy() for w in start], [np.zeros_like(w) for w in start], 0
            for batch in batches:
                m = batch.num_rows
                x = np.asarray(batch.column(0).flatten(), float).reshape(m, -1) if m else np.zeros((0, 1))
                for i, y in enumerate(batch.column(1).to_pylist()):
                    net.step(x[i], y, weights, last)
                n += m
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate([w.ravel() for w in weights]).tobytes()])], ["n", "w"])

        parts = data.mapInArrow(run, "n long, w binary").collect()
        if not parts:
            return start
        total = sum(r.n for r in parts)
        flat = sum(np.frombuffer(r.w) * (r.n / total) for r in parts)
        out, at = [], 0
        for w in start:
            out.append(flat[at : at + w.size].reshape(w.shape))
            at += w.size
        return out

    def forward(self, features: str = "features") -> Column:
        """The output units as ARRAY<DOUBLE>, an expression."""

        def layer(k: int, x: Column) -> Column:
            dots = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in row]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for row in self.weights[k]]
            kind = self.output if k == len(self.weights) - 1 else self.hidden
            z = F.array(*dots)
            out = z if kind == "Linear" else softmax(z) if kind == "SoftMax" else F.transform(z, F.tanh if kind == "Tanh" else logistic)
            return out if k == len(self.weights) - 1 else let(out, lambda v: layer(k + 1, v))

        return layer(0, F.col(features))

    def predict(self, features: str = "features") -> Column:
        """Regression: the output.  One unit: class 0 above one half.  Else the largest unit."""
        out = self.forward(features)
        if self.kind == "regression":
            return out[0]
        return (out[0] <= 0.5).cast("int") if self.layers[-1] == 1 else let(out, lambda v: F.array_position(v, F.array_max(v)) - 1).cast("int")
