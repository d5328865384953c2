"""Removal of bytes repeated across documents by suffix sorting with a difference cover.

A byte goes if a 50-byte string covering it also starts in a document with a smaller id.

The suffix order is only needed where repeats can be, and only to a depth of 50 bytes:

1. Each 50-byte window has one *anchor*, its 16-byte substring of least hash (a minimiser), so equal
   windows have equal anchors.  Parts send sketches of their anchors to buckets (`parts.Prints`);
   a window whose anchor is estimated in one document only cannot repeat and is left out.
2. Runs of consecutive windows with one anchor are cut out as pieces (at most 84 bytes).  A part
   sends its distinct pieces, each with its smallest document, to the bucket of the anchor, so all
   equal windows meet in one bucket and a hot passage arrives once per part.
   An anchor with more than HOT pieces (estimated by the same sketches) is no key any more: its runs
   are cut by the place of the anchor in the window, STEP places a piece, and the key is the 46
   bytes that all windows of the piece share.  Equal windows have equal places, so they still meet.
3. A bucket sorts the suffixes of its pieces by the difference cover modulo 3 (`suffix_order`): the
   triples at positions 1 and 2 modulo 3 are sorted and named, the string of names is sorted by
   recursion down to the depth needed, the remaining suffixes are sorted by (symbol, rank of the
   next) and merged; adjacent suffixes are then compared over 50 bytes to find the classes of equal
   windows, and each window gets the smallest document of its class.
4. Parts mark the bytes covered by windows whose class has a smaller document.

Defined cases: a null text is empty; a null id counts as later than all ids and comes back as null;
rows with equal ids never remove each other's bytes; texts under 50 bytes are kept; an empty table
gives an empty result; very long texts are cut into chunks of work, never shortened; other columns are ignored, or
carried in `rest` if named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

from quarry.llm.parts import FLAGS, NO_ID, SKETCHES, U64, Prints, answers, bodies, chunks, deal, group_starts, grouped, ids, merge_sketches, mix, paired

LENGTH = 50
ANCHOR = 16
#: A bucket's pieces come in so many slices, dealt by the anchor; slices are sorted together, and texts searched, up to so many bytes, to bound the work arrays.
SLICES, SORTED = 32, 1 << 20
#: Bytes of text in a part.
PART = 3 << 22
#: Pieces of one anchor that are kept together, and the windows of a piece (of 54 bytes) beyond that.
HOT, STEP = 8192, 5


# --- suffix order by a difference cover -------------------------------------------------------


def _packed(*keys: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """Tuples of integers as one integer in their order, and a bound; each key comes with a bound above its values."""
    packed, bound = keys[0]
    for values, limit in keys[1:]:
        if bound * limit >= 1 << 62:
            packed, bound = _named(packed)
        packed, bound = packed * limit + values, bound * limit
    return packed, bound


def _named(packed: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense names from 1, in order, and a bound above them."""
    order = np.argsort(packed)
    sorted_ = packed[order]
    new = np.ones(len(packed), np.int64)
    new[1:] = sorted_[1:] != sorted_[:-1]
    names = np.empty(len(packed), np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum()) + 1


def _ordered(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in their order, and the keys in order; small ones are sorted with their place in the low bits."""
    bits = len(keys).bit_length()
    if bound << bits >= 1 << 63:
        order = np.argsort(keys)
        return order, keys[order]
    both = (keys << bits) | np.arange(len(keys))
    both.sort()
    return both & ((1 << bits) - 1), both >> bits


def suffix_order(symbols: np.ndarray, bound: int, depth: int) -> np.ndarray:
    """Positions of all suffixes in order of their first `depth` symbols at least (values 1 .. bound - 1; ties any way)."""
    n = len(symbols)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(symbols[i:])), np.int64)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(4, np.int64)])
    n1, n2, n0 = (n + 1) // 3, n // 3, (n + 2) // 3  # suffixes at places 1, 2 and 0 modulo 3
    n1 += n % 3 == 1  # a place past the end, so that the last suffix at 0 modulo 3 has a next one
    of = lambda x, k, size: x[k : k + 3 * size - 2 : 3] if size else x[:0]
    triple = lambda k: np.concatenate([of(s, 1 + k, n1), of(s, 2 + k, n2)])
    names, limit = _packed((triple(0), bound), (triple(1), bound), (triple(2), bound))
    distinct = False
    m = n1 + n2
    if limit > 1 << 20:  # else the packed triple is a small enough name, already in order
        names, limit = _named(names)
        distinct = limit - 1 == m
    if distinct or depth <= 3:
        order, _ = _ordered(names, limit)
    else:
        order = suffix_order(names, limit, -(-depth // 3))
    rank_of = np.empty(m, np.int64)
    rank_of[order] = np.arange(1, m + 1)
    rank = np.zeros(n + 4, np.int64)
    of(rank, 1, n1)[:], of(rank, 2, n2)[:] = rank_of[:n1], rank_of[n1:]
    is_one = order < n1
    first = np.where(is_one, 3 * order + 1, 3 * (order - n1) + 2)
    inside = first < n
    first, order, is_one = first[inside], order[inside], is_one[inside]
    # Suffixes at multiples of 3: by (symbol, rank of the next), then merged into the sample.
    rest, rest_key = _ordered(of(s, 0, n0) * (m + 1) + of(rank, 1, n0), bound * (m + 1))
    key1 = of(s, 1, n1) * (m + 1) + of(rank, 2, n1)
    before1 = np.searchsorted(key1[order[is_one]], rest_key)
    a2 = order[~is_one] - n1
    next_ = lambda k: np.concatenate([of(s, 2 + k, n2)[a2], of(s, k, n0)[rest]])
    both, _ = _packed((next_(0), bound), (next_(1), bound), (np.concatenate([of(rank, 4, n2)[a2], of(rank, 2, n0)[rest]]), m + 1))
    before2 = np.searchsorted(both[: len(a2)], both[len(a2) :])
    rest = 3 * rest
    at = np.arange(len(rest)) + np.maximum.accumulate(before1) + np.maximum.accumulate(before2)
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = rest, first
    return out


# --- windows and their anchors ----------------------------------------------------------------


def _words(buffer: bytes) -> np.ndarray:
    """The 8 bytes from each position as one integer (padded with zeros)."""
    padded = buffer + b"\0" * 16
    n = len(buffer)
    out = np.empty(n + 8, U64)
    for k in range(8):
        view = np.frombuffer(padded, "<u8", (n + 8 - k + 7) // 8, k) if n + 8 > k else np.zeros(0, U64)
        out[k::8] = view[: len(out[k::8])]
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class Runs:
    """Runs of windows with one anchor: document row, start in the document, windows, start of the anchor, key.

    On request also `content`, a hash of the anchor's key, the run's ends and its length.
    """

    def __init__(self, texts: list[bytes], length: int, contents: bool = False):
        rows, starts, counts, places, keys, ends = [], [], [], [], [], []
        spread = length - ANCHOR + 1
        for lo, hi in chunks(texts, SORTED):
            sizes = np.array([len(t) for t in texts[lo:hi]], np.int64)
            buffer = b"".join(texts[lo:hi])
            if len(buffer) < length:
                continue
            w = _words(buffer)
            n = len(buffer) - ANCHOR + 1
            h = w[:n] * U64(0x9E3779B97F4A7C15)
            h += w[8 : n + 8] * U64(0xC2B2AE3D27D4EB4F)
            h ^= h >> U64(32)
            h *= U64(0xD6E8FEB86659FD93)
            h ^= h >> U64(29)
            least = _sliding_min((h & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64), spread)
            anchor = (least & U64(0xFFFFFFFF)).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            step = np.zeros(len(buffer) + 1, np.int32)
            long = sizes >= length
            np.add.at(step, first[long], 1)
            np.add.at(step, first[long] + sizes[long] - length + 1, -1)
            anchor[np.cumsum(step)[: len(anchor)] <= 0] = -1
            begin = group_starts(anchor)
            count = np.diff(np.append(begin, len(anchor)))
            valid = anchor[begin] >= 0
            begin, count = begin[valid], count[valid]
            row = np.searchsorted(first, begin, side="right") - 1
            rows.append(row + lo)
            starts.append(begin - first[row])
            counts.append(count)
            places.append(anchor[begin] - first[row])
            keys.append(mix(h[anchor[begin]] + U64(1)))
            if contents:
                ends.append(mix((h[begin] + U64(3)) * U64(0x9E3779B97F4A7C15) + h[begin + count + (length - 1 - ANCHOR)] * U64(5) + keys[-1] + count.astype(U64)))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.row, self.start, self.count, self.place = (join(x, np.int64) for x in (rows, starts, counts, places))
        self.key, self.content = join(keys, U64), join(ends, U64) if contents else None

    def keep(self, chosen: np.ndarray) -> None:
        """Only the runs chosen by flags or positions."""
        self.row, self.start, self.count, self.place, self.key = (x[chosen] for x in (self.row, self.start, self.count, self.place, self.key))

    def split(self, hot: np.ndarray, texts: list[bytes], length: int) -> None:
        """Cuts the hot runs by the place of the anchor in the window, STEP places a run, each with a key of its own.

        Windows with the places k .. k + STEP - 1 share the bytes from `k` before the anchor on, length - STEP + 1 of them.
        """
        row, start, end, place = self.row[hot], self.start[hot], (self.start + self.count)[hot], self.place[hot]
        high, low = (place - start) // STEP, (place - end + 1) // STEP
        n = high - low + 1
        of = np.repeat(np.arange(len(n)), n)
        group = high[of] - (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
        row, start, end, place = row[of], start[of], end[of], place[of]
        shared = place - group * STEP
        used, of = np.unique(row, return_inverse=True)  # rows ascend
        held = [texts[r] for r in used.tolist()]
        key, size = group.astype(U64), length - STEP + 1
        for lo, hi in chunks(held, SORTED):
            w, first = _words(b"".join(held[lo:hi])), np.cumsum([0, *map(len, held[lo:hi])])
            mine = slice(*np.searchsorted(of, (lo, hi)).tolist())
            at = first[of[mine] - lo] + shared[mine]
            for k in (*range(0, size - 7, 8), size - 8):
                key[mine] = mix(key[mine] * U64(0x9E3779B97F4A7C15) + w[at + k] + U64(1))
        start = np.maximum(start, shared - (STEP - 1))
        count = np.minimum(end, shared + 1) - start
        self.keep(~hot)
        self.row, self.start, self.count, self.place, self.key = (np.concatenate(x) for x in ((self.row, row), (self.start, start), (self.count, count), (self.place, place), (self.key, key)))

    def pieces(self, texts: list[bytes], length: int) -> Iterator[bytes]:
        ends = self.start + self.count + (length - 1)
        return (texts[r][a:b] for r, a, b in zip(self.row.tolist(), self.start.tolist(), ends.tolist()))

    def names(self, texts: list[bytes], length: int) -> np.ndarray:
        """A 64-bit hash of each piece."""
        return np.fromiter(map(xxh3_64_intdigest, self.pieces(texts, length)), U64, len(self.row))


def _slice_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys // U64(buckets)) % U64(SLICES)).astype(np.int64)


def _sketch(table: pa.Table, buckets: int, length: int) -> pa.Table:
    runs, doc_ids = Runs(bodies(table), length, contents=True), ids(table)
    return Prints(runs.key, doc_ids[runs.row], buckets, runs.content).rows(table.column("part")[0].as_py())


def _flagged(texts: list[bytes], doc_ids: np.ndarray, flags: pa.Table, buckets: int, length: int) -> Runs:
    runs = Runs(texts, length)
    prints, found = Prints(runs.key, doc_ids[runs.row], buckets), answers(flags, 0)
    repeated, hot = prints.estimated(found), prints.hot(found)
    runs.keep(repeated)
    runs.split(hot[repeated], texts, length)
    return runs


PIECES = "bucket int, part int, pieces binary, sizes binary, least binary, slices binary"


def _joined(column: pa.ChunkedArray) -> bytes:
    """The bytes of all rows, one after another, without an object a row."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int32, len(whole) + 1, 4 * whole.offset)
    return data[int(at[0]) : int(at[-1])].to_pybytes() if at[-1] > at[0] else b""


def _cut(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of an array, cut at its rows `ends` (the last is its length), without a step a piece."""
    raw = np.ascontiguousarray(data).view(np.uint8)
    width = data.dtype.itemsize
    offsets = np.concatenate([[0], ends]).astype(np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())


def _pieces(table: pa.Table, flags: pa.Table, buckets: int, length: int) -> pa.Table:
    """PIECES of one part: its distinct pieces for each bucket, slice by slice, with their sizes, smallest documents and the pieces a slice.

    Pieces of one bucket and slice are told apart by their names, and only one bucket's are held as objects.
    """
    texts: list[bytes] = []
    part, least, sizes, bucket, which = 0, *(np.zeros(0, np.int64) for _ in range(4))
    text: Iterator[bytes] = iter(())
    if len(table):
        part = table.column("part")[0].as_py()
        texts, doc_ids = bodies(table), ids(table)
        runs = _flagged(texts, doc_ids, flags, buckets, length)
        names = runs.names(texts, length)
        key = (runs.key % U64(buckets)) * U64(SLICES) + _slice_of(runs.key, buckets).astype(U64)
        order = np.lexsort((names, key))
        at = group_starts(key[order], names[order])
        if len(at):
            least = np.minimum.reduceat(doc_ids[runs.row[order]], at)
        runs.keep(order[at])
        key, sizes, text = key[order[at]].astype(np.int64), runs.count + (length - 1), runs.pieces(texts, length)
        bucket, which = key // SLICES, key % SLICES
    at = group_starts(bucket)
    ends = np.append(at[1:], len(bucket)) if len(at) else at
    of = np.repeat(np.arange(len(at)), ends - at)
    slices = np.bincount(of * SLICES + which, minlength=len(at) * SLICES).astype(np.uint32)
    columns = [
        pa.array(bucket[at], pa.int32()),
        pa.array(np.full(len(at), part), pa.int32()),
        pa.array([b"".join(islice(text, n)) for n in (ends - at).tolist()], pa.binary()),
        _cut(sizes.astype(np.uint16), ends),
        _cut(least, ends),
        _cut(slices, np.arange(1, len(at) + 1) * SLICES),
    ]
    return pa.table(columns, names=["bucket", "part", "pieces", "sizes", "least", "slices"])


def class_minima(pieces: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each piece (flat, in order) the smallest document of the pieces that hold an equal window."""
    buffer = b"".join(p + b"\0" for p in pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    first = np.cumsum(sizes) - sizes
    raw = np.frombuffer(buffer, np.uint8)
    used = np.bincount(raw, minlength=256) > 0
    symbols = np.cumsum(used)[raw]  # the bytes that occur, named from 1 in order
    order = suffix_order(symbols, int(used.sum()) + 1, length)
    counts = sizes - length
    window = np.zeros(len(buffer) + 1, np.int32)
    np.add.at(window, first, 1)
    np.add.at(window, first + counts, -1)
    is_window = np.cumsum(window)[:-1] > 0
    order = order[is_window[order]]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    w = _words(buffer)
    steps = [*range(0, length - 7, 8), length - 8]
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in steps:
        x = w[order + k]
        same[1:] &= x[1:] == x[:-1]
    at = np.flatnonzero(~same)
    smallest = np.repeat(np.minimum.reduceat(least[owner[order]], at), np.diff(np.append(at, len(order))))
    out = np.empty(len(buffer), np.int64)
    out[order] = smallest
    return out[is_window], counts


def _classes(table: pa.Table, length: int) -> pa.Table:
    """One bucket: suffix-sorts the distinct pieces of all parts; answers each part with its pieces' windows' smallest documents.

    An answer holds the names of the pieces and their runs of windows by smallest document.  Apart from
    cutting the answers, nothing is done part by part: there are as many pairs of part and bucket as the square of the parts.
    """
    parts, bucket = table.column("part").to_pylist(), table.column("bucket")[0].as_py()
    text, sizes, docs, slices = (_joined(table.column(c)) for c in ("pieces", "sizes", "least", "slices"))
    sizes, docs, slices = np.frombuffer(sizes, np.uint16).astype(np.int64), np.frombuffer(docs, np.int64), np.frombuffer(slices, np.uint32)
    ends = np.cumsum(sizes)
    which = np.repeat(np.tile(np.arange(SLICES), len(parts)), slices)
    names, many, start = np.zeros(len(sizes), U64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    run_docs, run_lens, base = [], [], 0
    together = (np.cumsum(np.bincount(which, sizes, SLICES)) // SORTED)[which]
    for k in np.unique(together).tolist():
        mine = np.flatnonzero(together == k)
        own, name, per_piece, run_doc, run_len = _slice_classes((text[a:b] for a, b in zip((ends - sizes)[mine].tolist(), ends[mine].tolist())), docs[mine], length)
        names[mine], many[mine], start[mine] = name[own], per_piece[own], base + (np.cumsum(per_piece) - per_piece)[own]
        run_docs.append(run_doc)
        run_lens.append(run_len)
        base += len(run_doc)
    take = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    run_doc = np.concatenate([np.zeros(0, np.int64), *run_docs])[take]
    run_len = np.concatenate([np.zeros(0, np.int64), *run_lens])[take].astype(np.uint16)
    piece_at = np.concatenate([[0], np.cumsum(slices.reshape(-1, SLICES).sum(axis=1, dtype=np.int64))])
    run_at = np.concatenate([[0], np.cumsum(many)])[piece_at].tolist()
    many, piece_at, out = many.astype(np.uint16), piece_at.tolist(), []
    for a, b, x, y in zip(piece_at, piece_at[1:], run_at, run_at[1:]):
        out.append(b"".join(((b - a).to_bytes(8, "little"), names[a:b], run_doc[x:y], many[a:b], run_len[x:y])))
    return pa.table({"part": pa.array(parts, pa.int32()), "kind": pa.array([1] * len(parts), pa.int32()), "bucket": pa.array([bucket] * len(parts), pa.int32()), "body": pa.array(out, pa.binary())})


def _slice_classes(sent: Iterator[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Some slices of a bucket: the distinct piece of each piece sent; their names, and their runs of windows by smallest document."""
    index: dict[bytes, int] = {}
    own = np.fromiter((index.setdefault(piece, len(index)) for piece in sent), np.int64, len(docs))
    pieces = list(index)
    least = np.full(len(pieces), NO_ID)
    np.minimum.at(least, own, docs)
    minima, counts = class_minima(pieces, least, length)
    piece_of = np.repeat(np.arange(len(pieces)), counts)
    at = group_starts(piece_of, minima)
    names = np.fromiter(map(xxh3_64_intdigest, pieces), U64, len(pieces))
    return own, names, np.bincount(piece_of[at], minlength=len(pieces)), minima[at], np.diff(np.append(at, len(minima)))


def _answer(body: bytes) -> tuple[np.ndarray, ...]:
    """Names of pieces, runs of windows in each; smallest document and windows of each run (flat)."""
    k = int.from_bytes(body[:8], "little")
    runs = (len(body) - 8 - 10 * k) // 10
    docs = np.frombuffer(body, np.int64, runs, 8 + 8 * k)
    n = np.frombuffer(body, np.uint16, k, 8 + 8 * k + 8 * runs)
    return np.frombuffer(body, U64, k, 8), n, docs, np.frombuffer(body, np.uint16, runs, 8 + 10 * k + 8 * runs)


def whole_characters(text: bytes, a: int, b: int) -> bytes:
    """text[a:b] without the bytes of a character that an edge of the span cuts."""
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    if b < len(text) and text[b] & 0xC0 == 0x80:
        while a < b and text[b - 1] & 0xC0 == 0x80:
            b -= 1
        b = max(a, b - 1)
    return text[a:b]


def _apply(table: pa.Table, flags: pa.Table, buckets: int, length: int, with_text: bool) -> pa.Table:
    texts, doc_ids = bodies(table), ids(table)
    sizes = np.array([len(t) for t in texts], np.int64)
    removed, spans = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    cuts: dict[int, list[tuple[int, int]]] = {}
    found = [_answer(x) for x in answers(flags, 1).values()]
    if len(texts) and found:
        runs = _flagged(texts, doc_ids, flags, buckets, length)
        names, many, docs, sizes_ = (np.concatenate(x) for x in zip(*found))
        many, sizes_ = many.astype(np.int64), sizes_.astype(np.int64)
        base, before = np.cumsum(many) - many, np.cumsum(sizes_) - sizes_
        order = np.argsort(names)
        hit = order[np.searchsorted(names[order], runs.names(texts, length))]
        # Windows stay in their runs of one smallest document, so repeats cost no array of a place a window.
        n = many[hit]
        of = np.repeat(np.arange(len(hit)), n)
        at = base[hit][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        gone = docs[at] < doc_ids[runs.row[of]]
        of, at = of[gone], at[gone]
        first = np.cumsum(sizes + 1) - (sizes + 1)
        low = first[runs.row[of]] + runs.start[of] + before[at] - before[base[hit][of]]
        order = np.argsort(low)
        low, high = low[order], (low + sizes_[at] + (length - 1))[order]
        # Unions of [low, high), in the coordinate of all texts with a gap after each.
        new = np.ones(len(low), bool)
        new[1:] = low[1:] > high[:-1]
        a = low[new]
        b = high[np.append(np.flatnonzero(new)[1:], len(low)) - 1] if len(low) else low
        r = np.searchsorted(first, a, side="right") - 1
        np.add.at(removed, r, b - a)
        np.add.at(spans, r, 1)
        for k, x, y in zip(r.tolist(), (a - first[r]).tolist(), (b - first[r]).tolist()):
            cuts.setdefault(k, []).append((x, y))
    digests, kept_texts = [], []
    for k, t in enumerate(texts):
        edges = [0, *(e for c in cuts.get(k, ()) for e in c), len(t)]
        spans_left = list(zip(edges[::2], edges[1::2]))
        digests.append(hashlib.sha256(b"".join(t[x:y] for x, y in spans_left) if k in cuts else t).hexdigest())
        kept_texts.append(b"".join(whole_characters(t, x, y) for x, y in spans_left).decode("utf-8", "replace") if with_text else None)
    out = {"doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID), "n_bytes": pa.array(sizes), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept_texts, pa.string())}
    if "rest" in table.column_names:
        out["rest"] = table.column("rest")
    return pa.table(out)


def _part_count(docs: DataFrame) -> int:
    """Parts and buckets: the shuffle partitions, or more for more than PART bytes of text each.

    They follow the bytes, not the input splits: pairs of part and bucket grow with the square of their number,
    and small files or well compressed ones would make many parts too small or parts too large for a task's memory.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, with_text: bool = False, keep: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; on request `kept` (the remaining whole characters) and `rest` (columns named in keep)."""
    parts = _part_count(docs)
    texts = deal(docs, parts, keep)
    sketches = texts.groupBy("part").applyInArrow(grouped(_sketch, buckets=parts, length=length), SKETCHES)
    flags = sketches.groupBy("bucket").applyInArrow(grouped(merge_sketches, hot=hot), FLAGS).repartition(parts, "part")
    pieces = texts.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(paired(_pieces, buckets=parts, length=length), PIECES)
    classes = pieces.groupBy("bucket").applyInArrow(grouped(_classes, length=length), FLAGS).repartition(parts, "part")
    both = flags.unionByName(classes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    if keep:
        schema += ", rest " + texts.schema["rest"].dataType.simpleString()
    out = texts.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(paired(_apply, buckets=parts, length=length, with_text=with_text), schema)
    return out if with_text else out.drop("kept")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated bytes taken out of their texts; n_chars, if there, follows.

    The other bytes of a character that was cut go too.  Null texts stay null; empty texts, null ids, repeated
    rows, very long texts and empty tables as above; other columns, whatever their names, are carried along.
    """
    others = [c for c in docs.columns if c != "text"]
    out = remove_repeated_bytes(docs.where(F.col("text").isNotNull()), with_text=True, keep=others)
    columns = {c: F.col(f"rest.`{c}`") for c in others} | {"text": F.col("kept")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns]).unionByName(docs.where(F.col("text").isNull()))
