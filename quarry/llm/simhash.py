"""SimHash near-duplicates: fingerprints linked within a Hamming radius through BK-trees.

1. Texts are lower-cased (A-Z), cut into words, and each shingle of `shingle` words is hashed with
   XXH64 (seed 42); a bit is set if it is set in over half of the hashes.
2. Documents with one fingerprint are one node.  Two fingerprints within the radius agree on at
   least one of radius + 1 blocks of bits, so the nodes are dealt into shards by (block, value): no
   link is lost and no shard needs another.  Each shard builds a BK-tree (children keyed by their
   distance to the parent) and searches it following only edges within the radius.  The trees stay
   with their shard: a broadcast of all trees would grow with the data.  A shard over CHUNK nodes
   is cut into chunks, and each pair of chunks is a task of its own.
3. A shard emits a star for each of its groups, not all its pairs; the stars are joined by
   connected components, and every document gets the smallest id of its group.

Defined cases: a null or empty text has the fingerprint zero, linked like any other; fewer words
than a shingle give one shingle of all words; null ids are never the smallest id (a group of null
ids has the component null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh64_intdigest

from quarry.llm.components import connected_components
from quarry.llm.parts import group_starts, grouped, part_count
from quarry.session import checkpointed

SEED, SHINGLE, RADIUS = 42, 3, 3
CHUNK = 4096


def shingle_hashes(text: bytes, shingle: int):
    """XXH64 of the shingles of a text, in arrays of at most 65536; nothing for a text without words."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    for at in range(0, len(starts), 1 << 16):
        spans = zip(starts[at : at + (1 << 16)].tolist(), ends[k - 1 :][at : at + (1 << 16)].tolist())
        yield np.fromiter(map(xxh64_intdigest, [joined[a:b] for a, b in spans], repeat(SEED)), np.uint64)


def bit_counts(bits: np.ndarray) -> np.ndarray:
    """Column sums of rows of 0 and 1: first in bytes over 255 rows at a time."""
    whole = len(bits) // 255 * 255
    out = bits[whole:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    if whole:
        out += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    counts, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        counts += bit_counts(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("body")).mapInArrow(run, "doc_id long, print long")


class BKTree:
    """Fingerprints in a tree whose children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        node = 0
        while node != len(self.values) - 1:
            d = (self.values[node] ^ value).bit_count()
            node = self.children[node].setdefault(d, len(self.values) - 1)

    def within(self, value: int, radius: int) -> list[int]:
        """Indexes of the values at most `radius` bits from this one."""
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            node = stack.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            for edge, child in children[node].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found


def _stars(left: list[int], right: list[int], radius: int) -> list[tuple[int, int]]:
    """Stars of the groups linked within `left` (if right is empty) or between left and right, out of a tree of left."""
    every = left + right
    root = list(range(len(every)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree = BKTree()
    for i, value in enumerate(every):
        for j in tree.within(value, radius) if right == [] or i >= len(left) else ():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        if i < len(left):
            tree.add(value)
    return [(every[find(i)], x) for i, x in enumerate(every) if find(i) != i]


def _shard_links(table: pa.Table, radius: int) -> pa.Table:
    """The stars of all shards in one bin."""
    shard, i, j, mine, prints = (table.column(c).to_numpy() for c in ("shard", "i", "j", "mine", "print"))
    order = np.lexsort((prints, mine, j, i, shard))
    shard, i, j, mine, prints = (x[order] for x in (shard, i, j, mine, prints))
    at = group_starts(shard, i, j)
    ends = np.append(at[1:], len(shard))
    pairs: list[tuple[int, int]] = []
    for a, b in zip(at.tolist(), ends.tolist()):
        if b - a > 1:
            values, side = prints[a:b].astype(np.int64).view(np.uint64).tolist(), mine[a:b]
            cut = b - a if i[a] == j[a] else int((side == i[a]).sum())
            pairs += _stars(values[:cut], values[cut:], radius)
    return _edge_table(pairs)


def _edge_table(pairs: list[tuple[int, int]]) -> pa.Table:
    src, dst = (np.array(x, np.uint64).view(np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(src, dst): edges that connect the fingerprints (`print`, distinct) that are linked directly or over others."""
    blocks = radius + 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = [F.shiftrightunsigned("print", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) * blocks + k for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    shards = nodes.select("print", F.explode(F.array(*keys)).alias("shard"))
    crowded = shards.groupBy("shard").count().where(F.col("count") > chunk).select("shard", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    sized = shards.join(crowded, "shard", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    sized = sized.withColumn("mine", F.pmod(F.xxhash64("print"), "chunks").cast("int"))
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("shard", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "print")
    dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("shard", "i", "j"), F.lit(part_count(nodes))).cast("int"))
    return dealt.groupBy("bin").applyInArrow(grouped(_shard_links, radius=radius), "src long, dst long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id)."""
    prints = checkpointed(fingerprints(docs, shingle))
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    groups = connected_components(links(nodes.select("print"), radius)).withColumnRenamed("node", "print")
    grouped_nodes = nodes.join(groups, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = grouped_nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = grouped_nodes.join(least, "component").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
