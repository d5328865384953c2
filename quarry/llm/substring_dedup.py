"""Exact removal of repeated word windows behind a count-min prefilter.

Words are maximal runs of anything but ASCII white space, unchanged.  A window is `width`
consecutive words of one document; each word covered by a window whose word sequence also starts
in a document with a smaller id is removed.  Windows are judged on the input.

1. Every part sends sketches of its windows (fingerprint, count of documents saturating at two) to
   the buckets; a bucket merges them as count-min rows, whose estimates are never too low.
2. Every part sends the windows estimated in two or more documents, as 96-bit hashes with its own
   smallest document; a bucket groups them exactly and answers whether another part has a smaller one.
3. Every part marks the covered words of its documents.

Defined cases: a null text has no words; a null id counts as later than all ids and its rows come
back with a null id; rows with equal ids never remove each other's words; texts shorter than a
window are kept whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from xxhash import xxh3_64_intdigest

from quarry.llm.parts import FLAGS, NO_ID, SKETCHES, U64, Prints, answers, bodies, chunks, deal, group_starts, grouped, ids, merge_sketches, paired, part_count, rolled

WIDTH = 13
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"


class Windows:
    """All windows of a part: hash a (64 bits), hash b (32 bits), document, document row and start."""

    def __init__(self, table: pa.Table, width: int):
        texts, doc_ids = bodies(table), ids(table)
        a, b, rows, starts = [], [], [], []
        self.n_words = np.zeros(len(texts), np.int64)
        for lo, hi in chunks(texts):
            words = [t.split() for t in texts[lo:hi]]
            n = np.array([len(w) for w in words], np.int64)
            self.n_words[lo:hi] = n
            flat = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(n.sum()))
            if len(flat) < width:
                continue
            first = np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(np.arange(lo, hi), n)
            at = np.arange(len(flat)) - first
            valid = np.flatnonzero((at <= np.repeat(n, n) - width)[: len(flat) - width + 1])
            a.append(rolled(flat, width, 0x27D4EB2F)[valid])
            b.append((rolled(flat, width, 0x165667B19E3779F9)[valid] >> U64(32)).astype(np.uint32))
            rows.append(row[valid].astype(np.int32))
            starts.append(at[valid].astype(np.int32))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.a, self.b = join(a, np.uint64), join(b, np.uint32)
        self.row, self.start = join(rows, np.int32), join(starts, np.int32)
        self.doc = doc_ids[self.row] if len(self.row) else np.zeros(0, np.int64)

    def keep(self, flags: np.ndarray) -> None:
        self.a, self.b, self.row, self.start, self.doc = (x[flags] for x in (self.a, self.b, self.row, self.start, self.doc))


class Exact:
    """The distinct windows of a part that are estimated repeated, by bucket, with the part's smallest document."""

    def __init__(self, w: Windows, buckets: int):
        bucket = (w.a % U64(buckets)).astype(np.int32)
        order = np.lexsort((w.b, w.a, bucket))
        a, b, bucket, doc = w.a[order], w.b[order], bucket[order], w.doc[order]
        at = group_starts(a, b, bucket)
        self.a, self.b, self.bucket = a[at], b[at], bucket[at]
        self.least = np.minimum.reduceat(doc, at) if len(at) else doc[:0]
        self.index = np.empty(len(order), np.int64)
        self.index[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))

    def slices(self):
        at = group_starts(self.bucket)
        for lo, hi in zip(at, np.append(at[1:], len(self.bucket))):
            yield int(self.bucket[lo]), int(lo), int(hi)


def _sketch(table: pa.Table, buckets: int, width: int) -> pa.Table:
    w = Windows(table, width)
    return Prints(w.a, w.doc, buckets).rows(table.column("part")[0].as_py())


def _flagged(table: pa.Table, flags: pa.Table, buckets: int, width: int) -> tuple[Windows, Exact]:
    w = Windows(table, width)
    w.keep(Prints(w.a, w.doc, buckets).estimated(answers(flags, 0)))
    return w, Exact(w, buckets)


def _candidates(table: pa.Table, flags: pa.Table, buckets: int, width: int) -> pa.Table:
    rows = []
    if len(table):
        part = table.column("part")[0].as_py()
        _, e = _flagged(table, flags, buckets, width)
        rows = [(k, part, e.a[x:y].tobytes(), e.b[x:y].tobytes(), e.least[x:y].tobytes()) for k, x, y in e.slices()]
    cols = list(zip(*rows)) or [[]] * 5
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "part": pa.array(cols[1], pa.int32()), **{n: pa.array(c, pa.binary()) for n, c in zip(("a", "b", "least"), cols[2:])}})


def _group(table: pa.Table) -> pa.Table:
    """One bucket: groups equal windows of all parts; a bit says that another part has a smaller document."""
    parts = table.column("part").to_pylist()
    a, b, least = ([np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("a", np.uint64), ("b", np.uint32), ("least", np.int64)))
    sizes = [len(x) for x in a]
    a, b, least = np.concatenate(a), np.concatenate(b), np.concatenate(least)
    order = np.lexsort((b, a))
    at = group_starts(a[order], b[order])
    smaller = np.empty(len(order), bool)
    smaller[order] = np.repeat(np.minimum.reduceat(least[order], at), np.diff(np.append(at, len(order)))) < least[order]
    out, lo = [], 0
    for n in sizes:
        out.append(np.packbits(smaller[lo : lo + n]).tobytes())
        lo += n
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"part": pa.array(parts, pa.int32()), "kind": pa.array([1] * len(parts), pa.int32()), "bucket": pa.array([bucket] * len(parts), pa.int32()), "body": pa.array(out, pa.binary())})


def _apply(table: pa.Table, flags: pa.Table, buckets: int, width: int, with_text: bool) -> pa.Table:
    texts, doc_ids = bodies(table), ids(table)
    removed = np.zeros(len(texts), np.int64)
    digests, kept_texts = [], []
    masks: dict[int, np.ndarray] = {}
    if len(texts):
        w, e = _flagged(table, flags, buckets, width)
        exact, elsewhere = answers(flags, 1), np.zeros(len(e.a), bool)
        for bucket, lo, hi in e.slices():
            elsewhere[lo:hi] = np.unpackbits(np.frombuffer(exact[bucket], np.uint8), count=hi - lo).astype(bool)
        gone = elsewhere[e.index] | (w.doc > e.least[e.index]) if len(e.index) else np.zeros(0, bool)
        row, start = w.row[gone], w.start[gone]
        first = np.cumsum(w.n_words + 1) - (w.n_words + 1)
        edge = np.zeros(int((w.n_words + 1).sum()) + 1, np.int32)
        np.add.at(edge, first[row] + start, 1)
        np.add.at(edge, first[row] + start + width, -1)
        covered = np.cumsum(edge) > 0
        for r in np.unique(row):
            masks[int(r)] = covered[first[r] : first[r] + w.n_words[r]]
            removed[r] = masks[int(r)].sum()
    n_words = []
    for r, t in enumerate(texts):
        words = t.split()
        n_words.append(len(words))
        text = b" ".join(compress(words, ~masks[r]) if r in masks else words)
        digests.append(hashlib.sha256(text).hexdigest())
        kept_texts.append(text if with_text else None)
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept_texts, pa.binary())})


def remove_repeated_windows(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by one space (`kept`, bytes)."""
    parts = part_count(docs)
    texts = deal(docs, parts)
    sketches = texts.groupBy("part").applyInArrow(grouped(_sketch, buckets=parts, width=width), SKETCHES)
    flags = sketches.groupBy("bucket").applyInArrow(grouped(merge_sketches), FLAGS).repartition(parts, "part")
    candidates = texts.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(paired(_candidates, buckets=parts, width=width), "bucket int, part int, a binary, b binary, least binary")
    exact = candidates.groupBy("bucket").applyInArrow(_group, FLAGS).repartition(parts, "part")
    both = flags.unionByName(exact)
    out = texts.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(paired(_apply, buckets=parts, width=width, with_text=with_text), RESULT)
    return out if with_text else out.drop("kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
