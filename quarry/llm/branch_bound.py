"""Exact top-k inner products by columnar branch-and-bound.

A vector becomes whole numbers, floor(256 * x) for each component x as double.  Blocks of query
vectors meet blocks of candidates, each pair in a task of its own; a candidate block is kept
vertically (one row a dimension).  For every query of the pair

1. the products of the first `STEP` dimensions are summed for all candidates of the block;
2. the best few by that sum are finished and give a threshold, the k-th best score;
3. a candidate survives while its sum plus the bound of the rest (product of the lengths of the
   remaining dimensions, Cauchy-Schwarz) reaches the threshold; survivors are compacted, the next
   dimensions are added, and so on until the scores are exact.

At most k rows a query and pair of blocks go on to the final ranking.  Blocks are numbered by hash,
so their number follows the table and no block grows with it.

Defined cases: null vectors and those with a null, NaN or infinite component take no part; missing
components of shorter vectors count as zero; a row with the query's own vec_id is its own and no
candidate; queries that share a vec_id each get their rows; a null vec_id is a candidate only, ranked
last among equal scores; scores are exact while sums of products stay below 2^53; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.llm.parts import NO_ID, paired

SCALE, K, EVERY, STEP = 256, 5, 50, 16
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
HITS = "query_id long, query_row long, vec_id long, score long"


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    """Components by row, scaled and floored, padded with zeros to `dims`."""
    column = table.column("embedding").combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64) if len(column) else np.zeros(0, np.int64)
    flat = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.floor(SCALE * flat)
    return out


def _dims(*tables: pa.Table) -> int:
    lengths = [t.column("embedding").combine_chunks().value_lengths() for t in tables if len(t)]
    return max([1, *(int(x or 0) for n in lengths for x in n.to_pylist())])


def top_of_block(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int, step: int = STEP):
    """For each query the positions and exact scores of its k best of the block (ties to the smaller id), as a generator."""
    dims, n = block.shape
    cuts = [*range(0, dims, step), dims]
    rest_block = [np.sqrt(np.square(block[c:]).sum(axis=0)) for c in cuts]
    rest_query = [np.sqrt(np.square(queries[:, c:]).sum(axis=1)) for c in cuts]
    first = cuts[1]
    for lo in range(0, len(queries), 64):
        partials = queries[lo : lo + 64, :first] @ block[:first]
        for j, partial in enumerate(partials, lo):
            alive = np.flatnonzero(ids != query_ids[j])
            partial = partial[alive]
            q = queries[j]
            if len(alive) > k and len(cuts) > 2:
                bound = partial + rest_query[1][j] * rest_block[1][alive]
                seeds = np.argpartition(bound, len(alive) - k)[-k:]
                threshold = (partial[seeds] + q[first:] @ block[first:, alive[seeds]]).min()
                slack = 1e-9 * abs(bound).max() + 0.5
                for c, (a, b) in enumerate(zip(cuts[1:], cuts[2:]), 1):
                    stay = partial + rest_query[c][j] * rest_block[c][alive] + slack >= threshold
                    alive, partial = alive[stay], partial[stay]
                    partial = partial + q[a:b] @ block[a:b, alive]
                    if len(alive) > k:
                        now = partial - rest_query[c + 1][j] * rest_block[c + 1][alive] - slack
                        threshold = max(threshold, np.partition(now, len(now) - k)[-k])
            elif len(cuts) > 2:
                partial = partial + q[first:] @ block[first:, alive]
            best = np.lexsort((ids[alive], -partial))[:k]
            yield j, alive[best], partial[best]


def _search(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    out: list[tuple[np.ndarray, ...]] = []
    if len(queries) and len(candidates):
        dims = _dims(queries, candidates)
        q_ids, ids = (t.column("vec_id").to_numpy().astype(np.int64) for t in (queries, candidates))
        rows = queries.column("query_row").to_numpy()
        block = np.ascontiguousarray(_matrix(candidates, dims).T)
        for j, at, scores in top_of_block(_matrix(queries, dims), q_ids, block, ids, k):
            out.append((np.full(len(at), q_ids[j]), np.full(len(at), rows[j]), ids[at], np.clip(scores, -(2.0**63), 2.0**63 - 1024).astype(np.int64)))
    cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table(dict(zip(("query_id", "query_row", "vec_id", "score"), map(pa.array, cols))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of largest inner product of every query, both as (vec_id, embedding)."""
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = vectors.where(sound).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), "embedding")
    queries = queries.where(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.xxhash64("vec_id", "embedding").alias("query_row"))
    # Equal query rows get numbers of their own, so that each has its result.
    queries = queries.withColumn("query_row", F.col("query_row") + F.row_number().over(Window.partitionBy("vec_id").orderBy("query_row")))
    n_queries, n_vectors = queries.count(), vectors.count()
    q_blocks, c_blocks = max(1, math.ceil(n_queries / query_block)), max(1, math.ceil(n_vectors / candidate_block))
    mine = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("q", mine(q_blocks)).select("*", every(c_blocks).alias("c"))
    right = vectors.withColumn("c", mine(c_blocks)).select("*", every(q_blocks).alias("q"))
    pair = lambda f: f.withColumn("pair", F.col("q").cast("long") * c_blocks + F.col("c")).drop("q", "c")
    hits = pair(left).groupBy("pair").cogroup(pair(right).groupBy("pair")).applyInArrow(paired(_search, k=k), HITS)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
