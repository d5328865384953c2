"""Grouped moments, ranking of features, covariance, standard scores, contingency tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def check_labels(frame: DataFrame, label: str, exactly: set[int] | None = None) -> list[int]:
    """The labels, 0 .. k - 1 without gaps and two at least."""
    found = sorted(r[0] for r in frame.select(label).distinct().collect())
    if exactly is not None and set(found) != exactly:
        raise ValueError(f"Labels must be {sorted(exactly)}, found {found}")
    if found and found[0] < 0:
        raise ValueError("Negative class label")
    if found != list(range(len(found))):
        raise ValueError("Class labels have gaps")
    if len(found) < 2:
        raise ValueError("Only one class")
    return found


def class_moments(frame: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, label, n, mean, var_pop, sd): one aggregate by label; only its few rows are unpivoted."""
    aggs = [x for i, f in enumerate(features) for x in (F.count(f).alias(f"n{i}"), F.avg(f).alias(f"m{i}"), F.var_pop(f).alias(f"v{i}"), F.stddev_samp(f).alias(f"s{i}"))]
    wide = frame.groupBy(F.col(label).alias("label")).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var_pop"), F.col(f"s{i}").alias("sd")) for i in range(len(features))])
    return wide.select("label", F.inline(rows))


def sum_square_ratio(frame: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, ratio): between-class over within-class sum of squares."""
    m = class_moments(frame, features, label)
    total = m.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    both = m.join(total, "feature")
    between = F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand")))
    return both.groupBy("feature").agg((between / F.sum(F.col("n") * F.col("var_pop"))).alias("ratio"))


def signal_to_noise(frame: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, ratio): |mean0 - mean1| / (sd0 + sd1) for labels 0 and 1, sample deviations."""
    m = class_moments(frame, features, label)
    pick = lambda c, k: F.max(F.when(F.col("label") == k, F.col(c)))
    return m.groupBy("feature").agg((F.abs(pick("mean", 0) - pick("mean", 1)) / (pick("sd", 0) + pick("sd", 1))).alias("ratio"))


def covariance(frame: DataFrame, features: list[str], correlation: bool = False) -> DataFrame:
    """(i, j, value) for i <= j: population covariance or correlation, one aggregate."""
    f = F.corr if correlation else F.covar_pop
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    wide = frame.agg(*[f(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("value")) for i, j in pairs])))


def gram(vectors: DataFrame, column: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum, sum of outer products) of an array column; one small row a task."""

    def run(batches):
        n, s, g = 0, 0.0, 0.0
        for batch in batches:
            x = batch.column(0)
            if len(x):
                m = np.asarray(x.flatten(), np.float64).reshape(len(x), -1)
                n, s, g = n + len(m), s + m.sum(0), g + m.T @ m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.asarray(s).tobytes()]), pa.array([np.asarray(g).tobytes()])], ["n", "s", "g"])

    rows = vectors.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "n long, s binary, g binary").collect()
    if not rows:
        raise ValueError("No rows")
    s = reduce(np.add, [np.frombuffer(r.s) for r in rows])
    return sum(r.n for r in rows), s, reduce(np.add, [np.frombuffer(r.g) for r in rows]).reshape(len(s), len(s))


def z_scores(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus their mean over their sample deviation; the one-row statistics are joined, rows are not gathered."""
    stats = frame.agg(*[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"_m{i}"), F.stddev_samp(c).alias(f"_s{i}"))])
    joined = frame.join(F.broadcast(stats))
    return joined.select(*[c for c in frame.columns if c not in columns], *[((F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")).alias(c) for i, c in enumerate(columns)])


def contingency(frame: DataFrame, a: str, b: str) -> DataFrame:
    return frame.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _pair_sums(frame: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, sums of squares of the cells, the rows and the columns of the contingency table."""
    cells = contingency(frame, a, b)
    cube = cells.cube("a", "b").agg(F.sum("n").cast("double").alias("n"), F.grouping_id().alias("g"))
    square = lambda g: F.sum(F.when(F.col("g") == g, F.col("n") * F.col("n")))
    return cube.agg(F.max(F.when(F.col("g") == 3, F.col("n"))).alias("n"), square(0).alias("cells"), square(1).alias("rows"), square(2).alias("cols"))


def rand_index(frame: DataFrame, a: str, b: str) -> DataFrame:
    s, n = _pair_sums(frame, a, b), F.col("n")
    pairs = n * (n - 1) / 2
    t, p, q = F.col("cells") - n, F.col("rows") - n, F.col("cols") - n
    return s.select(((t - p / 2 - q / 2 + pairs) / pairs).alias("rand_index"))


def adjusted_rand_index(frame: DataFrame, a: str, b: str) -> DataFrame:
    s, n = _pair_sums(frame, a, b), F.col("n")
    half = lambda c: (F.col(c) - n) / 2
    expected = half("rows") * half("cols") / (n * (n - 1) / 2)
    return s.select(((half("cells") - expected) / ((half("rows") + half("cols")) / 2 - expected)).alias("adjusted_rand_index"))


def error_rate(frame: DataFrame, predicted: str, actual: str) -> DataFrame:
    wrong = F.sum((F.col(predicted) != F.col(actual)).cast("long"))
    return frame.agg(wrong.alias("errors"), F.count(F.lit(1)).alias("n"), (wrong / F.count(F.lit(1))).alias("rate"))


def one_vs_rest(frame: DataFrame, label: str, chosen) -> DataFrame:
    return frame.withColumn("target", (F.col(label) == F.lit(chosen)).cast("int"))


def words(text: str):
    """The words of a text column: runs of anything but ASCII white space, A-Z in lower case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit("[^ \\t\\n\\x0B\\f\\r]+"), F.lit(0))


def bag_of_words(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of the terms of a vocabulary table (term)."""
    terms = docs.select("doc_id", F.explode(words("text")).alias("term"))
    return terms.join(vocabulary.select("term"), "term", "left_semi").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def row_index(frame: DataFrame, order: list) -> DataFrame:
    """A gapless 0-based `row_index` in the given order without gathering the rows: range partitions, their sizes, an offset each."""
    from quarry.session import checkpointed

    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(frame.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = dict(dealt.groupBy("_p").count().collect())
    offsets, at = {}, 0
    for p in sorted(sizes):
        offsets[p], at = at, at + sizes[p]
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("_p")), F.lit(0)) if offsets else F.lit(0)
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn("row_index", (base + local).cast("long")).drop("_p")


def fold_of(index, n: int, k: int):
    """Fold of a 0-based place: k chunks of n div k, the last one takes the rest."""
    if n < 0 or not 0 < k <= n:
        raise ValueError(f"Invalid number of folds: {k} of {n} rows")
    return F.least(F.floor(index / (n // k)), F.lit(k - 1)).cast("int")


def cross_validation(frame: DataFrame, key: str, k: int) -> DataFrame:
    """`fold` by the order of the key's md5: the same shuffle on every engine."""
    n = frame.count()
    if not 0 < k <= n:
        raise ValueError(f"Invalid number of folds: {k} of {n} rows")
    indexed = row_index(frame.withColumn("_h", F.md5(F.col(key).cast("string"))), ["_h", key]).drop("_h")
    return indexed.withColumn("fold", fold_of(F.col("row_index"), n, k)).drop("row_index")


def leave_one_out(frame: DataFrame, key: str) -> DataFrame:
    """(test, train_n): one fold a row, closed form; the training rows of a fold are all others."""
    return frame.join(F.broadcast(frame.agg((F.count(F.lit(1)) - 1).alias("train_n")))).select(F.col(key).alias("test"), "train_n")


def leave_one_out_fold(frame: DataFrame, key: str, left_out) -> tuple[DataFrame, DataFrame]:
    """(train, test): the rows but those of one key, and that one; filters, so no fold is stored."""
    test = F.col(key).eqNullSafe(F.lit(left_out))
    return frame.where(~test), frame.where(test)


def slice_rows(frame: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    return frame.join(chosen.select(key), key, "left_semi")
