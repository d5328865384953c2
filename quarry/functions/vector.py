"""Column functions on ARRAY<DOUBLE>: JVM-side expressions, no Python workers.

Null arrays give null; arrays of different lengths raise an error when the row is read.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LOG_FLOOR = -690.7755


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row: lambdas evaluate outer expressions for every element."""
    return F.transform(F.array(value), body)[0]


def _same_size(x: Column, y: Column, value: Column) -> Column:
    return F.when(F.size(x) != F.size(y), F.raise_error(F.lit("Arrays have different length")).cast("double")).otherwise(value)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def squared_distance(x, y) -> Column:
    x, y = _col(x), _col(y)
    return _same_size(x, y, _sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def squared_distance_with_missing(x, y) -> Column:
    """Pairs with a NaN are skipped and the sum is scaled up by length / pairs used; no distance counts as the largest double."""
    x, y = _col(x), _col(y)
    pairs = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: ~(F.isnan(p["x"]) | F.isnan(p["y"])))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["x"] - p["y"]) * (p["x"] - p["y"]))
    scaled = F.size(x) * total / F.nullif(F.size(pairs), F.lit(0))
    return _same_size(x, y, F.when(F.coalesce(scaled, F.lit(0.0)) == 0.0, F.lit(1.7976931348623157e308)).otherwise(scaled))


def _divergence(p: Column, q: Column) -> Column:
    both = F.filter(F.arrays_zip(p.alias("p"), q.alias("q")), lambda z: (z["p"] != 0) & (z["q"] != 0))
    total = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda s, z: s + z["p"] * F.log(z["p"] / z["q"]))
    return let(both, lambda pairs: F.when(F.size(pairs) == 0, F.lit(float("inf"))).otherwise(total(pairs)))


def kullback_leibler(p, q) -> Column:
    """Sum of p ln(p / q) where both are positive; infinite without such a place."""
    return let(F.struct(_col(p).alias("p"), _col(q).alias("q")), lambda z: _same_size(z["p"], z["q"], _divergence(z["p"], z["q"])))


def jensen_shannon(p, q) -> Column:
    def halves(z: Column) -> Column:
        middle = F.zip_with(z["p"], z["q"], lambda a, b: (a + b) / 2)
        return let(middle, lambda m: (_divergence(z["p"], m) + _divergence(z["q"], m)) / 2)

    return let(F.struct(_col(p).alias("p"), _col(q).alias("q")), lambda z: _same_size(z["p"], z["q"], halves(z)))


def dot(x, y) -> Column:
    x, y = _col(x), _col(y)
    return _same_size(x, y, _sum(F.zip_with(x, y, lambda a, b: a * b)))


def axpy(a, x, y) -> Column:
    """y + a x."""
    a = a if isinstance(a, Column) else F.lit(float(a))
    return F.zip_with(_col(x), _col(y), lambda u, v: v + a * u)


def norm1(x) -> Column:
    return _sum(F.transform(_col(x), F.abs))


def norm2(x) -> Column:
    return F.sqrt(_sum(F.transform(_col(x), lambda a: a * a)))


def unitize1(x) -> Column:
    return let(_col(x), lambda v: let(norm1(v), lambda n: F.transform(v, lambda a: a / n)))


def dot_with_intercept(x, weights, position: int = 0) -> Column:
    """x . w + b for the weights of one class, intercept last, in a flat array of classes."""
    x, weights = _col(x), _col(weights)
    width = F.size(x) + 1
    mine = F.slice(weights, F.lit(position) * width + 1, width)
    return _sum(F.zip_with(x, F.slice(mine, F.lit(1), F.size(x)), lambda a, b: a * b)) + F.element_at(mine, -1)


def softmax(x) -> Column:
    shifted = lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda a: F.exp(a - m)))
    return let(_col(x), lambda v: let(shifted(v), lambda e: let(_sum(e), lambda t: F.transform(e, lambda a: a / t))))


def logistic(x) -> Column:
    """1 / (1 + e^-x), flat beyond 40."""
    x = _col(x)
    return F.when(x < -40, 0.0).when(x > 40, 1.0).otherwise(1 / (1 + F.exp(-x)))


logistic_sigmoid = logistic


def safe_log(x) -> Column:
    x = _col(x)
    return F.when(x < 1e-300, LOG_FLOOR).otherwise(F.log(F.greatest(x, F.lit(1e-300))))


def log1pe(x) -> Column:
    """ln(1 + e^x); x itself beyond 15."""
    x = _col(x)
    return F.when(x > 15, x).otherwise(F.log1p(F.exp(F.least(x, F.lit(15.0)))))


def log_factorial(n) -> Column:
    n = _col(n).cast("int")
    checked = F.when(n < 0, F.raise_error(F.lit("n has to be nonnegative")).cast("array<int>")).when(n < 2, F.expr("array(1)")).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    return F.aggregate(checked, F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))


def log_choose(n, k) -> Column:
    n, k = _col(n), _col(k)
    bad = (n < 0) | (k < 0) | (k > n)
    return F.when(bad, F.raise_error(F.lit("0 <= k <= n is required")).cast("double")).otherwise(log_factorial(n) - log_factorial(F.least(k, n)) - log_factorial(F.greatest(n - k, F.lit(0))))


def choose(n, k) -> Column:
    n, k = _col(n), _col(k)
    return F.when(n < k, 0.0).otherwise(F.floor(0.5 + F.exp(log_choose(F.greatest(n, k), k))).cast("double"))


def tanh(x) -> Column:
    return F.tanh(_col(x))


def sqr(x) -> Column:
    return _col(x) * _col(x)


def decimal_round(x, digits: int) -> Column:
    return F.round(_col(x), digits)


def is_missing(x) -> Column:
    return F.isnan(_col(x))


def gini(counts) -> Column:
    counts = F.transform(_col(counts), lambda c: c.cast("double"))
    total = _sum(counts)
    return 1 - _sum(F.transform(counts, lambda c: (c / total) * (c / total)))


def entropy(counts) -> Column:
    """In bits."""
    counts = F.filter(F.transform(_col(counts), lambda c: c.cast("double")), lambda c: c > 0)
    total = _sum(counts)
    return -_sum(F.transform(counts, lambda c: c / total * F.log2(c / total)))


def classification_error(counts) -> Column:
    counts = F.transform(_col(counts), lambda c: c.cast("double"))
    return F.abs(1 - F.array_max(counts) / _sum(counts))


IMPURITY = {"GINI": gini, "ENTROPY": entropy, "CLASSIFICATION_ERROR": classification_error}
