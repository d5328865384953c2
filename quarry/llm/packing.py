"""Length buckets of least padding, and batches under a token budget inside them.

1. Texts of more than `max_length` words are cut into sequences of at most that, so whole texts are
   packed: a text is its sequences joined in order, white space included.  Lengths are rounded up to
   `align` (1: not at all); their histogram over the whole table has at most max_length / align bins,
   whatever the input.
2. Dynamic programming over the bins chooses at most `buckets` boundaries (multiples of `align`) with
   the least total padding, exactly, in whole numbers.
3. A bucket is dealt by hash into shards of about `shard` tokens, so a bucket with a third of all rows is
   many groups and no group outgrows a task.  In each shard sequences are ordered by length, and every budget //
   boundary of them are a batch; a shard leaves one batch unfilled at most.

Defined cases: a null or empty text is one sequence of no tokens (padded to `align`), its text stays
null or empty; a null id is kept; repeated rows are packed each and dealt by their input split too;
equal lengths are ordered by id, sequence and text; very long texts become many sequences; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MAX_LENGTH, ALIGN, BUCKETS, BUDGET, SHARD = 4096, 1, 16, 65536, 1 << 22
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FAR = 1 << 62


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most `buckets` of the sorted lengths (the last one always) such that padding up to the next boundary is least.

    A last bucket over lengths i + 1 .. j costs lengths[j] * (sequences in it) - (tokens in it).  The best
    i never falls while j grows, so each layer of the programme is solved from its middle outwards.
    Of equal costs the fewest buckets and the smallest cuts win.
    """
    if not lengths:
        return []
    x, n = np.array(lengths, np.int64), len(lengths)
    c, s = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.concatenate([[0], np.cumsum(x * np.array(counts, np.int64))])
    best, cuts = x * c[1:] - s[1:], []
    totals = [int(best[-1])]
    for k in range(1, min(buckets, n)):
        layer, cut = np.full(n, FAR), np.zeros(n, np.int64)
        open_ = [(k, n - 1, k - 1, n - 2)]
        while open_:
            lo, hi, a, b = open_.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            total = best[i] + x[j] * (c[j + 1] - c[i + 1]) - (s[j + 1] - s[i + 1])
            at = int(total.argmin())
            layer[j], cut[j] = total[at], i[at]
            open_ += [(lo, j - 1, a, int(cut[j])), (j + 1, hi, int(cut[j]), b)]
        best = layer
        cuts.append(cut)
        totals.append(int(best[-1]))
    k = int(np.argmin(totals))
    out, j = [n - 1], n - 1
    while k:
        j = int(cuts[k - 1][j])
        out.append(j)
        k -= 1
    return [int(lengths[i]) for i in reversed(out)]


def cut(text: bytes, max_length: int) -> list[tuple[int, bytes]]:
    """(words, text) of each sequence; a sequence ends where the next one's first word begins."""
    n = len(text.split())
    if n <= max_length:
        return [(n, text)]
    starts = [m.start() for k, m in enumerate(WORD.finditer(text)) if k % max_length == 0]
    edges = [0, *starts[1:], len(text)]
    return [(min(max_length, n - k * max_length), text[a:b]) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))


def histogram(docs: DataFrame, max_length: int) -> dict[int, int]:
    """Sequences by length: max_length + 1 rows at most."""

    def run(batches):
        found: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                whole, rest = divmod(len((text or b"").split()), max_length)
                found[max_length] += whole
                found[rest] += bool(rest or not whole)
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], ["length", "n"])

    rows = _texts(docs).select("body").mapInArrow(run, "length int, n long").groupBy("length").agg(F.sum("n").alias("n")).where("n > 0")
    return {r["length"]: r["n"] for r in rows.collect()}


def sequences(docs: DataFrame, max_length: int) -> DataFrame:
    """(doc_id, sequence, n_tokens, text): a document's words in runs of at most max_length."""

    def run(batches):
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(i, k, n, None if t is None else part.decode("utf-8", "replace")) for i, t in zip(ids, bodies) for k, (n, part) in enumerate(cut(t or b"", max_length))]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "sequence", "n_tokens", "text"])

    return _texts(docs).mapInArrow(run, "doc_id long, sequence int, n_tokens int, text string")


def _ladder(value: Column, steps: list[tuple[int, int]]) -> Column:
    """The first step's result whose bound is not below the value."""
    out = F.when(value <= steps[0][0], steps[0][1])
    for bound, result in steps[1:]:
        out = out.when(value <= bound, result)
    return out


def packed(docs: DataFrame, max_length: int = MAX_LENGTH, align: int = ALIGN, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD) -> DataFrame:
    """doc_id, sequence, text, n_tokens, bucket_length, padding, batch_id, slot (row of the batch)."""
    if budget < math.ceil(max_length / align) * align:
        raise ValueError("the budget must hold a sequence of the greatest length")
    aligned: Counter[int] = Counter()
    for length, n in histogram(docs, max_length).items():
        aligned[max(align, math.ceil(length / align) * align)] += n
    bins = sorted(aligned.items())
    cuts = boundaries([h[0] for h in bins], [h[1] for h in bins], buckets) or [max_length]
    sizes = {b: sum(n for x, n in bins if a < x <= b) for a, b in zip([0, *cuts], cuts)}
    rows = sequences(docs, max_length).withColumn("bucket_length", _ladder(F.col("n_tokens"), [(b, b) for b in cuts]))
    shards = _ladder(F.col("bucket_length"), [(b, max(1, math.ceil(n * b / shard))) for b, n in sizes.items()])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "sequence", "text", F.spark_partition_id()), shards).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket_length", "shard").orderBy("n_tokens", "doc_id", "sequence", "text")) - 1
    rows, size = rows.withColumn("place", place), F.floor(F.lit(budget) / F.col("bucket_length"))
    batch = F.concat_ws("-", "bucket_length", "shard", F.floor(F.col("place") / size))
    return rows.select("doc_id", "sequence", "text", "n_tokens", "bucket_length", (F.col("bucket_length") - F.col("n_tokens")).alias("padding"), batch.alias("batch_id"), (F.col("place") % size).cast("int").alias("slot"))


def op3_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
