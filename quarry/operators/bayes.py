"""Naive Bayes as joins with a small parameter table: multinomial, Bernoulli and Gaussian.

Inputs are long: (doc_id, label, term, tf) for words, (id, label, features) for Gaussian.  Counts are
additive, so a batch learns by a union of counts (`add_counts`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators.statistics import class_moments

EPSILON = 1e-20


def check(sigma: float, classes: int, priors: list[float] | None) -> None:
    if sigma < 0:
        raise ValueError(f"Invalid add-k smoothing parameter: {sigma}")
    if classes < 2:
        raise ValueError(f"Invalid number of classes: {classes}")
    if priors is not None and (len(priors) != classes or any(p <= 0 or p >= 1 for p in priors) or abs(sum(priors) - 1) > 1e-10):
        raise ValueError("Invalid priori probabilities")


def class_counts(docs: DataFrame) -> DataFrame:
    """(label, n) of (doc_id, label)."""
    return docs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def term_counts(terms: DataFrame) -> DataFrame:
    """(label, term, ntc, present): occurrences, and documents that have the term."""
    return terms.groupBy("label", "term").agg(F.sum("tf").alias("ntc"), F.count(F.lit(1)).alias("present"))


def add_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Counts after another batch."""
    sums = [c for c in old.columns if c not in keys]
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def log_priors(classes: DataFrame, priors: list[float] | None = None) -> DataFrame:
    """(label, log_prior): (n + eps) / (all + k eps), or given priors in order of the labels."""
    if priors is not None:
        check(0.0, classes.count(), priors)
        return classes.select("label", F.log(F.array(*map(F.lit, priors))[F.col("label")]).alias("log_prior"))
    total = classes.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    return classes.join(F.broadcast(total)).select("label", F.log((F.col("n") + EPSILON) / (F.col("all") + F.col("k") * EPSILON)).alias("log_prior"))


def _grid(classes: DataFrame, vocabulary: DataFrame, counts: DataFrame) -> DataFrame:
    """Every class (few, broadcast) with every term, missing counts as zero."""
    full = vocabulary.select("term").join(F.broadcast(classes))
    return full.join(counts, ["label", "term"], "left").fillna(0, ["ntc", "present"])


def multinomial(classes: DataFrame, counts: DataFrame, vocabulary: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(label, term, logp): ln (ntc + sigma) / (nt + sigma * terms)."""
    check(sigma, classes.count(), None)
    grid = _grid(classes, vocabulary, counts)
    totals = grid.groupBy("label").agg(F.sum("ntc").alias("nt"), F.count(F.lit(1)).alias("terms"))
    return grid.join(F.broadcast(totals), "label").select("label", "term", F.log((F.col("ntc") + sigma) / (F.col("nt") + sigma * F.col("terms"))).alias("logp"))


def bernoulli(classes: DataFrame, counts: DataFrame, vocabulary: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(label, term, logp, log_not): p = (documents with the term + sigma) / (n + 2 sigma)."""
    check(sigma, classes.count(), None)
    p = (F.col("present") + sigma) / (F.col("n") + 2 * sigma)
    return _grid(classes, vocabulary, counts).select("label", "term", F.log(p).alias("logp"), F.log(1 - p).alias("log_not"))


def _posterior(scores: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key)
    top = F.max("score").over(w)
    return scores.withColumn("posterior", F.exp(F.col("score") - top) / F.sum(F.exp(F.col("score") - top)).over(w))


def word_scores(docs: DataFrame, terms: DataFrame, model: DataFrame, priors: DataFrame) -> DataFrame:
    """(doc_id, label, score) of documents with a vocabulary term."""
    weight = F.col("logp") - F.col("log_not") if "log_not" in model.columns else F.col("tf") * F.col("logp")
    base = priors.withColumn("base", F.col("log_prior"))
    if "log_not" in model.columns:
        base = base.join(model.groupBy("label").agg(F.sum("log_not").alias("none")), "label").withColumn("base", F.col("log_prior") + F.col("none"))
    sums = terms.select("doc_id", "term", "tf").join(model, "term").groupBy("doc_id", "label").agg(F.sum(weight).alias("s"))
    return sums.join(F.broadcast(base.select("label", "base")), "label").select("doc_id", "label", (F.col("base") + F.col("s")).alias("score"))


def predict_words(docs: DataFrame, terms: DataFrame, model: DataFrame, priors: DataFrame) -> DataFrame:
    """(doc_id, predicted): the best class, the lowest of equal ones; -1 for documents without vocabulary terms."""
    best = word_scores(docs, terms, model, priors).groupBy("doc_id").agg(F.max_by("label", F.struct(F.round("score", 9), -F.col("label"))).alias("predicted"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("predicted", F.lit(-1)).alias("predicted"))


def word_posteriors(docs: DataFrame, terms: DataFrame, model: DataFrame, priors: DataFrame) -> DataFrame:
    return _posterior(word_scores(docs, terms, model, priors), "doc_id")


def gaussian(frame: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(feature, label, n, mean, sd): normal densities by class."""
    return class_moments(frame, features, label).select("feature", "label", "n", "mean", "sd")


def gaussian_scores(features: list[str], model: list, priors: dict[int, float]) -> Column:
    """ARRAY<DOUBLE> of log prior + log densities by class, out of the collected (small) model."""
    import math

    scores = []
    for k in sorted(priors):
        total = F.lit(math.log(priors[k]))
        for r in sorted((r for r in model if r["label"] == k), key=lambda r: r["feature"]):
            z = (F.col(features[r["feature"]]) - r["mean"]) / r["sd"]
            total = total - z * z / 2 - math.log(r["sd"] * math.sqrt(2 * math.pi))
        scores.append(total)
    return F.array(*scores)
