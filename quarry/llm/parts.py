"""Texts dealt into parts, and the exchange of packed keys between parts and buckets.

Operators that must compare every piece of text with every other use two units of work:

* a *part* is a hash-dealt slice of the documents (hash of id, text and input split, so no source,
  group of copies or repeated row gathers in one part);
* a *bucket* is a slice of the key space (window hashes, anchors, words).

A part sends each bucket one row holding a packed numpy array of its distinct keys, and gets one
row back.  A key that is in a third of all documents therefore reaches its bucket at most once
per part, whatever the number of documents.  Both counts follow the number of input splits, so a
part and a bucket keep their size when the input grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Stands for a null document id inside the arrays: later than any other id.
NO_ID = np.iinfo(np.int64).max
U64 = np.uint64
FLAGS = "part int, kind int, bucket int, body binary"
#: Fingerprints that are counted together.
SKETCHED = 1 << 17


def part_count(frame: DataFrame) -> int:
    """Parts and buckets for a frame: the shuffle partitions, or more if the input has more splits."""
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * frame.rdd.getNumPartitions())


def deal(docs: DataFrame, parts: int, keep: list[str] | None = None) -> DataFrame:
    """(part, doc_id, body[, rest]) with whole texts as UTF-8 bytes; a null text is empty, a null id is NO_ID."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    columns = [
        F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(parts)).cast("int").alias("part"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        text.alias("body"),
    ]
    if keep:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest"))
    return docs.select(*columns).repartition(parts, "part")


def bodies(table: pa.Table) -> list[bytes]:
    return table.column("body").to_pylist()


def ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").to_numpy().astype(np.int64)


def chunks(texts: list[bytes], size: int = 1 << 21):
    """Ranges of documents with about `size` bytes each, so that work arrays stay small."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def rolled(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` word hashes, built from runs of 1, 2, 4, ... words."""
    step, done, out, left = hashes + U64(seed), 0, None, width
    size = 1
    while left:
        if left & 1:
            piece = step[done:]
            out = piece if out is None else mix(out[: len(piece)] * U64(0x9E3779B97F4A7C15) + piece[: len(out)] + U64(size))
            done += size
        left >>= 1
        if left:
            step = mix(step[:-size] * U64(0xC2B2AE3D27D4EB4F) + step[size:]) if len(step) > size else step[:0]
            size *= 2
    return out[: max(0, len(hashes) - width + 1)]


def pack(x: np.ndarray | None) -> bytes | None:
    """An array as bytes: its size, then its bytes by place, compressed."""
    if x is None:
        return None
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1 if len(x) else 1).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(x: bytes, kind) -> np.ndarray:
    raw = pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def group_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in arrays sorted together."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Prints:
    """The distinct 32-bit fingerprints of one part by bucket, each with a saturating count of documents.

    With `contents` (a hash of what stands at each key) also the number of distinct contents, as a
    power of two that is not below it.
    """

    def __init__(self, keys: np.ndarray, docs: np.ndarray, buckets: int, contents: np.ndarray | None = None):
        self.buckets = buckets
        order_key = self.order_key(keys)
        order = np.argsort(order_key, kind="stable") if contents is None else np.lexsort((contents, order_key))
        sorted_keys, d = order_key[order], docs[order]
        starts = group_starts(sorted_keys)
        self.unique = sorted_keys[starts]
        #: The place in `unique` of each key.
        self.index = np.empty(len(keys), np.int64)
        self.index[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
        if len(starts):
            self.twice = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
        else:
            self.twice = np.zeros(0, bool)
        self.many = None
        if contents is not None:
            at = group_starts(sorted_keys, contents[order])
            found = np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(starts)) if len(at) else np.zeros(0)
            self.many = np.ceil(np.log2(found)).astype(np.uint8)

    def order_key(self, keys: np.ndarray) -> np.ndarray:
        """Bucket in the high half, fingerprint in the low half."""
        return ((keys % U64(self.buckets)) << U64(32)) | (keys >> U64(32))

    def slices(self):
        """(bucket, from, to) of the buckets that have fingerprints."""
        of = (self.unique >> U64(32)).astype(np.int64)
        at = group_starts(of)
        ends = np.append(at[1:], len(of))
        for a, b in zip(at, ends):
            yield int(of[a]), int(a), int(b)

    def rows(self, part: int) -> pa.Table:
        out = [(bucket, part, self.unique[a:b].astype(np.uint32).tobytes(), np.packbits(self.twice[a:b]).tobytes(), None if self.many is None else self.many[a:b].tobytes()) for bucket, a, b in self.slices()]
        cols = list(zip(*out)) or [[]] * 5
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "part": pa.array(cols[1], pa.int32()), **{n: pa.array(c, pa.binary()) for n, c in zip(("prints", "twice", "many"), cols[2:])}})

    def estimated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which of the keys the merged sketches count in two or more documents."""
        return self._answered(answers, 0)

    def hot(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which of the keys the merged sketches count with more than `hot` contents."""
        return self._answered(answers, 1)

    def _answered(self, answers: dict[int, bytes], plane: int) -> np.ndarray:
        flags = np.zeros(len(self.unique), bool)
        for bucket, a, b in self.slices():
            if bucket in answers:
                size = (b - a + 7) // 8
                flags[a:b] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8, size, plane * size), count=b - a).astype(bool)
        return flags[self.index]


SKETCHES = "bucket int, part int, prints binary, twice binary, many binary"


def merge_sketches(table: pa.Table, hot: int | None = None) -> pa.Table:
    """Adds the count-min rows of all parts in one bucket and answers each part with one bit a fingerprint.

    With `hot` a second bit a fingerprint follows: whether its contents, added up over the parts in
    the same way, are estimated at more than that.

    Two counter rows are addressed by a fingerprint; the estimate is the smaller counter, which is
    never below the true number of documents (saturated at two a part).  Their width follows the
    number of fingerprints in the bucket, eight counters for each; many fingerprints are dealt into
    groups by their remainder, one after another, so that the counters stay small.
    """
    parts = table.column("part").to_pylist()
    prints = [np.frombuffer(x, np.uint32) for x in table.column("prints").to_pylist()]
    weights = [1 + np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table.column("twice").to_pylist(), prints)]
    bucket = table.column("bucket")[0].as_py()
    sizes = [len(p) for p in prints]
    every, counts = np.concatenate(prints), np.concatenate(weights)
    groups = 1 + len(every) // SKETCHED
    bits = min(28, max(10, (8 * len(every) // groups).bit_length()))
    contents = None if hot is None else np.exp2(np.frombuffer(b"".join(table.column("many").to_pylist()), np.uint8))
    planes = [np.zeros(len(every), bool) for _ in range(1 if hot is None else 2)]
    for k in range(groups):
        mine = np.flatnonzero(every % np.uint32(groups) == k)
        many = mine[counts[mine] > 1]
        estimate = total = None
        for factor in (0x9E3779B1, 0x85EBCA77):
            slots = lambda which, f=np.uint32(factor): (every[which] * f) >> np.uint32(32 - bits)
            slot = slots(mine)
            row = np.bincount(slot, minlength=1 << bits) + np.bincount(slots(many), minlength=1 << bits)
            row = np.minimum(row, 2).astype(np.uint8)[slot]
            estimate = row if estimate is None else np.minimum(estimate, row)
            if hot is not None:
                amount = np.bincount(slot, contents[mine], 1 << bits)[slot]
                total = amount if total is None else np.minimum(total, amount)
        planes[0][mine] = estimate >= 2
        if hot is not None:
            planes[1][mine] = total > hot
    out, at = [], 0
    for n in sizes:
        out.append(b"".join(np.packbits(x[at : at + n]).tobytes() for x in planes))
        at += n
    return pa.table({"part": pa.array(parts, pa.int32()), "kind": pa.array([0] * len(parts), pa.int32()), "bucket": pa.array([bucket] * len(parts), pa.int32()), "body": pa.array(out, pa.binary())})


def answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    """The answers of one kind by bucket, out of a part's rows of FLAGS."""
    return {b: x for k, b, x in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("body").to_pylist()) if k == kind}


def grouped(function, **fixed):
    """A plain function of one table, as applyInArrow wants it, with the other arguments fixed."""

    def run(table: pa.Table) -> pa.Table:
        return function(table, **fixed)

    return run


def paired(function, **fixed):
    """The same for the two tables of a cogroup."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return function(left, right, **fixed)

    return run
