"""Scoring texts with a class-based bigram model (Brown classes found by exchange).

Learned from the training documents, those whose crc32 of the id as text modulo 5 is not 1:

1. Texts are cut into parts and kept there as positions in the part's distinct words (64-bit
   hashes).  Exact counts of all words: parts send their distinct words with counts to buckets, which
   add them up to the vocabulary.  It stays distributed.
2. The SEED most frequent words are clustered by the exchange algorithm on the driver, on a dense
   matrix of bigram counts (bounded by SEED and the number of shapes), all other words standing in
   classes by shape (length, digits, characters beyond ASCII).  This is only where step 3 starts.
3. Sweeps of the exchange over every training word, however rare: parts send each of their words'
   counts by class of the neighbours to its bucket, the bucket adds them up, moves each word to the
   class that raises the likelihood most (all words of a sweep by the same class bigram counts) and
   answers the parts with the new classes.  The driver holds a matrix of the classes alone.  Sweeps
   end when the likelihood no longer rises (that sweep is taken back) or after ROUNDS.  Shapes are
   left to words that are in no training text.
4. score = sum of log10 P(class | class before) + log10 P(word | class), both with add-1/2
   smoothing; the class of a text's end stands before its first word.

Classes and counts of a part's distinct words come back from their buckets, so no task holds the
vocabulary.  base_score is the smoothed unigram score; perplexity is 10 to the power of -score / n_tokens.

Defined cases: a null or empty text has one token, its end; a null id counts as the empty text in
crc32 (so it is in training) and comes back as null; repeated rows count every time; without
training documents all counts are zero; very long texts are parts of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

from quarry.llm.parts import FLAGS, NO_ID, U64, answers, chunks, group_starts, grouped, pack, paired, part_count, unpack
from quarry.session import checkpointed, freed, tidied

#: Bytes of text coded together.
PART = 12 << 20
#: Words that are clustered first, classes, sweeps over these words and over all words at most.
SEED, CLASSES, SWEEPS, ROUNDS = 512, 32, 20, 2
#: Shapes: three lengths by digit or not by ASCII or not; the last one is the end of a text.
SHAPES = 13
#: All classes, and the columns of a word's counts: by class after it, by class before it, beside itself.
K = CLASSES + SHAPES
OUT, INTO, OWN = 0, K, 2 * K
END = b"\n"
#: What a bucket answers the parts.
ANSWERS = FLAGS.replace("part int", "part long")
FOLDS, HELD_OUT = 5, 1


def held_out(doc_id: int | None) -> bool:
    return crc32(b"" if doc_id is None or doc_id == NO_ID else str(doc_id).encode()) % FOLDS == HELD_OUT


def shape(word: bytes) -> int:
    if word == END:
        return SHAPES - 1
    length = 0 if len(word) <= 4 else 1 if len(word) <= 8 else 2
    return length * 4 + (2 if any(48 <= b <= 57 for b in word) else 0) + (0 if word.isascii() else 1)


class Tokens:
    """Hashes of all tokens of some texts, tokens a text, and the distinct hashes with their shapes."""

    def __init__(self, texts: list[bytes]):
        hashes, distinct, shapes = [], [], []
        self.n = np.zeros(len(texts), np.int64)
        for lo, hi in chunks(texts):
            words = [[*t.lower().split(), END] for t in texts[lo:hi]]
            self.n[lo:hi] = [len(w) for w in words]
            flat = list(chain.from_iterable(words))
            h = np.fromiter(map(xxh3_64_intdigest, flat), U64, len(flat))
            unique, first = np.unique(h, return_index=True)
            hashes.append(h)
            distinct.append(unique)
            shapes.append(np.array([shape(flat[i]) for i in first.tolist()], np.int64))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.hash = join(hashes, U64)
        self.unique, first = np.unique(join(distinct, U64), return_index=True)
        self.shape = join(shapes, np.int64)[first]

    def index(self) -> np.ndarray:
        return np.searchsorted(self.unique, self.hash)


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, positions of its keys): the keys must be sorted and stay so in each bucket."""
    bucket = (keys % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = group_starts(bucket[order])
    for lo, hi in zip(at, np.append(at[1:], len(order))):
        yield int(bucket[order[lo]]), order[lo:hi]


def _table(rows: list[tuple], ints: list[str], blobs: list[str]) -> pa.Table:
    """Rows of integers and of arrays, which are packed."""
    cols = list(zip(*([*r[: len(ints)], *map(pack, r[len(ints) :])] for r in rows))) or [[]] * (len(ints) + len(blobs))
    return pa.table({n: pa.array(c, pa.int64() if n == "part" else pa.int32() if n in ints else pa.binary()) for n, c in zip([*ints, *blobs], cols)})


CODED = "part long, docs binary, sizes binary, words binary, shapes binary, positions binary"


def coded_texts(docs: DataFrame) -> DataFrame:
    """CODED: runs of about PART bytes of text out of each input split, numbered by split and run; no shuffle."""

    def run(batches):
        split, runs, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                held.append((batch.column(0)[at].as_py(), batch.column(1)[at].as_py()))
                size += len(held[-1][1])
                if size >= PART:
                    yield from _code(split << 32 | runs, held).to_batches()
                    runs, held, size = runs + 1, [], 0
        if held:
            yield from _code(split << 32 | runs, held).to_batches()

    body = F.coalesce("text", F.lit("")).cast("binary").alias("body")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), body).mapInArrow(run, CODED)


def _code(part: int, held: list[tuple[int, bytes]]) -> pa.Table:
    t = Tokens([x for _, x in held])
    row = (part, np.array([i for i, _ in held], np.int64), t.n, t.unique, t.shape.astype(np.uint8), t.index().astype(np.int32))
    return _table([row], ["part"], ["docs", "sizes", "words", "shapes", "positions"])


class Coded:
    """The texts of one part (a row of CODED) as positions in its distinct words."""

    def __init__(self, part: int, docs: bytes, sizes: bytes, words: bytes, shapes: bytes, positions: bytes):
        self.part, self.docs, self.n = part, unpack(docs, np.int64), unpack(sizes, np.int64)
        self.unique, self.shape = unpack(words, U64), unpack(shapes, np.uint8).astype(np.int64)
        self.at = unpack(positions, np.int32)
        self.held = np.array([held_out(i) for i in self.docs.tolist()], bool)
        self.train = np.repeat(~self.held, self.n)
        self.first = np.cumsum(self.n) - self.n

    def before(self, symbol: np.ndarray, end: int) -> np.ndarray:
        """What stands before each token, the end of a text before its first one."""
        out = np.concatenate([symbol[:1], symbol[:-1]]).astype(np.int64)
        out[self.first] = end
        return out


def coded(batches):
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield Coded(*row)


def _count(batches, buckets: int):
    for c in coded(batches):
        counts = np.bincount(c.at[c.train], minlength=len(c.unique))
        seen = np.flatnonzero(counts)
        words, counts, shapes = c.unique[seen], counts[seen], c.shape[seen]
        rows = [(k, words[x], counts[x], shapes[x].astype(np.uint8)) for k, x in _by_bucket(words, buckets)]
        yield from _table(rows, ["bucket"], ["words", "counts", "shapes"]).to_batches()


def _add(table: pa.Table) -> pa.Table:
    """One bucket of the vocabulary: words, counts and shapes, sorted by word."""
    words, counts, shapes = (np.concatenate([unpack(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("words", U64), ("counts", np.int64), ("shapes", np.uint8)))
    unique, first, at = np.unique(words, return_index=True, return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, at, counts)
    return _table([(table.column("bucket")[0].as_py(), unique, total, shapes[first])], ["bucket"], ["words", "counts", "shapes"])


def vocabulary(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, words, counts, shapes) of the training documents in CODED."""
    schema = "bucket int, words binary, counts binary, shapes binary"

    def run(batches):
        yield from _count(batches, buckets)

    return texts.mapInArrow(run, schema).groupBy("bucket").applyInArrow(_add, schema)


def _top(batches):
    """The SEED words of each bucket (kind 1), and its words and tokens by shape (kind 0)."""
    for batch in batches:
        for words, counts, shapes in zip(*(batch.column(c).to_pylist() for c in ("words", "counts", "shapes"))):
            w, c, s = unpack(words, U64), unpack(counts, np.int64), unpack(shapes, np.uint8)
            best = np.lexsort((w, -c))[:SEED]
            n, v = np.bincount(s, c, SHAPES).astype(np.int64), np.bincount(s, minlength=SHAPES)
            kind = np.repeat([1, 0], [len(best), SHAPES])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(np.concatenate([w[best].view(np.int64), np.zeros(SHAPES, np.int64)])), pa.array(np.concatenate([s[best], np.arange(SHAPES)]).astype(np.int32)), pa.array(np.concatenate([c[best], n])), pa.array(np.concatenate([np.ones(len(best), np.int64), v]))],
                ["kind", "word", "shape", "n", "v"],
            )


def exchange(bigrams: np.ndarray, top: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each symbol: the first `top` are moved between classes, the others keep one of their own.

    Classes start with the most frequent words alone and the rest together; a word moves to the class
    of the largest likelihood (the smallest class among equal ones).
    """
    fixed = len(bigrams) - top
    total = classes + fixed
    of = np.concatenate([np.minimum(np.arange(top), classes - 1), classes + np.arange(fixed)])
    member = np.zeros((len(bigrams), total))
    member[np.arange(len(bigrams)), of] = 1
    m = member.T @ bigrams @ member

    def f(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    b = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(top):
            a = of[w]
            member[w, a] = 0
            out, into, own = bigrams[w] @ member, bigrams[:, w] @ member, bigrams[w, w]
            m[a] -= out
            m[:, a] -= into
            m[a, a] -= own
            rows, cols, diagonal = m[:classes], m[:, :classes].T, m[b, b]
            gain = (f(rows + out) - f(rows)).sum(1) + (f(cols + into) - f(cols)).sum(1)
            gain -= f(diagonal + out[:classes]) - f(diagonal) + f(diagonal + into[:classes]) - f(diagonal)
            gain += f(diagonal + out[:classes] + into[:classes] + own) - f(diagonal)
            r, c = m.sum(1)[:classes], m.sum(0)[:classes]
            gain -= f(r + out.sum() + own) - f(r) + f(c + into.sum() + own) - f(c)
            best = int(np.argmax(gain > gain.max() - 1e-9 * max(1.0, abs(gain.max()))))
            if gain[best] <= gain[a] + 1e-9 * max(1.0, abs(gain[a])):
                best = a
            moved += best != a
            of[w], member[w, best] = best, 1
            m[best] += out
            m[:, best] += into
            m[best, best] += own
        if not moved:
            break
    return of


def _symbols(words: np.ndarray, numbers: np.ndarray, first_shape: int, unique: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The number of each distinct word if it is a top word, else that of its shape."""
    out = first_shape + shapes
    if len(words):
        at = np.minimum(np.searchsorted(words, unique), len(words) - 1)
        out = np.where(words[at] == unique, numbers[at], out)
    return out


def _sum_rows(table: pa.Table) -> pa.Table:
    rows = [unpack(x, np.int64) for x in table.column("counts").to_pylist()]
    return pa.table({"symbol": table.column("symbol")[:1], "counts": pa.array([pack(np.sum(rows, axis=0))], pa.binary())})


def _matrix(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of rows (symbol, counts) as a square matrix."""
    out = np.zeros((size, size))
    for r in rows.groupBy("symbol").applyInArrow(_sum_rows, "symbol int, counts binary").collect():
        out[r["symbol"]] = unpack(r["counts"], np.int64)
    return out


def bigram_counts(texts: DataFrame, top: list[tuple[int, int, int]]) -> np.ndarray:
    """Counts of neighbouring symbols in the training documents, a matrix of (SEED + SHAPES) squared at most."""
    words = np.array([w for w, _, _ in top], np.int64).view(U64)
    order = np.argsort(words)
    words, numbers, size = words[order], order, len(top) + SHAPES

    def run(batches):
        total = np.zeros((size, size), np.int64)
        for c in coded(batches):
            symbol = _symbols(words, numbers, len(top), c.unique, c.shape)[c.at]
            pairs = (c.before(symbol, size - 1) * size + symbol)[c.train]
            total += np.bincount(pairs, minlength=size * size).reshape(size, size)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([pack(total[i]) for i in at], pa.binary())], ["symbol", "counts"])

    return _matrix(texts.mapInArrow(run, "symbol int, counts binary"), size)


#: A part's words with their classes and counts by column (bucket 0 and up), or a row of the class bigrams (symbol).
SENT = "bucket int, part long, symbol int, words binary, classes binary, sizes binary, columns binary, counts binary"


def _send(c: Coded, of: np.ndarray, buckets: int, last: bool = False) -> pa.Table:
    """SENT of one part, `of` being the classes of its distinct words; the class bigrams alone, if no sweep follows."""
    end = int(np.flatnonzero(c.shape == SHAPES - 1)[0])
    second, first = c.at.astype(np.int64)[c.train], c.before(c.at, end)[c.train]
    pairs = np.bincount(of[first] * K + of[second], minlength=K * K).reshape(K, K).astype(np.int64)
    rows = [(None, None, int(i), None, None, None, None, pairs[i]) for i in np.flatnonzero(pairs.any(axis=1))]
    if last:
        return _table(rows, ["bucket", "part", "symbol"], ["words", "classes", "sizes", "columns", "counts"])
    own, width = first == second, 2 * K + 1
    keys = np.concatenate([first[~own] * width + OUT + of[second[~own]], second[~own] * width + INTO + of[first[~own]], first[own] * width + OWN])
    keys, counts = np.unique(keys, return_counts=True)
    moves = keys // width != end
    keys, counts = keys[moves], counts[moves]
    sizes = np.bincount(keys // width, minlength=len(c.unique))
    start = np.cumsum(sizes) - sizes
    columns, counts = (keys % width).astype(np.uint8), counts.astype(np.int32)
    for k, x in _by_bucket(c.unique, buckets):
        n = sizes[x]
        at = np.repeat(start[x] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows.append((k, c.part, None, c.unique[x], of[x].astype(np.uint8), n.astype(np.uint8), columns[at], counts[at]))
    return _table(rows, ["bucket", "part", "symbol"], ["words", "classes", "sizes", "columns", "counts"])


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(word: np.ndarray, column: np.ndarray, n: np.ndarray, of: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class below CLASSES to which each word adds most likelihood, by the class bigrams `m` without the word itself.

    The counts of the words (numbered by `word`) lie in `column` and `n`; the class a word is in wins
    against equal ones, then the smallest.
    """
    size, b = len(of), np.arange(CLASSES)
    counts = np.zeros((size, 2 * K + 1))
    counts[word, column] = n
    out, into, own = counts[:, OUT : OUT + K], counts[:, INTO : INTO + K], counts[:, OWN]
    is_now = of[:, None] == b
    gain = np.zeros((size, CLASSES))
    for this, other, matrix, first in ((out, into, m, OUT), (into, out, m.T, INTO)):
        e = np.flatnonzero((column >= first) & (column < first + K))
        w, y, add = word[e], column[e] - first, n[e].astype(np.float64)[:, None]
        beside, now = (y == of[w])[:, None], is_now[w]
        rest = matrix[:CLASSES, y].T - beside * other[w, :CLASSES]
        rest -= now * (add + beside * own[w][:, None])
        change = np.where(b == y[:, None], 0.0, _f(rest + add) - _f(rest))
        starts = group_starts(w)
        if len(starts):
            gain[w[starts]] += np.add.reduceat(change, starts)
        total = (this.sum(1) + own)[:, None]
        margin = matrix.sum(1)[:CLASSES] - is_now * total
        gain -= _f(margin + total) - _f(margin)
    both = out[:, :CLASSES] + into[:, :CLASSES] + own[:, None]
    rest = m[b, b] - is_now * both
    gain += _f(rest + both) - _f(rest)
    top = gain.max(axis=1, keepdims=True)
    near = gain >= top - 1e-9 * np.maximum(1.0, np.abs(top))
    stay = (near & is_now).any(axis=1)
    return np.where(stay, of, np.argmax(near, axis=1))


def _move(table: pa.Table, m: np.ndarray) -> pa.Table:
    """New classes (kind 0) and counts (kind 1) of the words each part sent to a bucket; words by class (kind 2)."""
    bucket, parts = table.column("bucket")[0].as_py(), table.column("part").to_pylist()
    sent = [[unpack(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("words", U64), ("classes", np.uint8), ("sizes", np.uint8), ("columns", np.uint8), ("counts", np.int32))]
    words, classes, sizes, columns, counts = map(np.concatenate, sent)
    unique, first, at = np.unique(words, return_index=True, return_inverse=True)
    width, of = 2 * K + 1, classes[first].astype(np.int64)
    keys, which = np.unique(np.repeat(at, sizes) * width + columns, return_inverse=True)
    n = np.bincount(which, counts, len(keys)).astype(np.int64)
    word, column = keys // width, keys % width
    total = np.bincount(word, n * ((column < INTO) | (column == OWN)), len(unique)).astype(np.int64)
    for lo in range(0, len(unique), 1 << 14):
        hi = min(lo + (1 << 14), len(unique))
        a, b = np.searchsorted(word, [lo, hi])
        found = best_classes(word[a:b] - lo, column[a:b], n[a:b], of[lo:hi], m)
        of[lo:hi] = np.where(total[lo:hi] > 0, found, of[lo:hi])
    rows, start = [(-1, 2, bucket, np.bincount(of[total > 0], minlength=K).astype(np.int64))], 0
    for part, x in zip(parts, sent[0]):
        own = at[start : start + len(x)]
        start += len(x)
        rows += [(part, 0, bucket, of[own].astype(np.uint8)), (part, 1, bucket, total[own])]
    return _table(rows, ["part", "kind", "bucket"], ["body"])


def _packed(c: Coded, found: pa.Table, kind: int, dtype, buckets: int) -> np.ndarray:
    """What the buckets answered for each distinct word of a part."""
    got, out = answers(found, kind), np.zeros(len(c.unique), np.int64)
    for k, x in _by_bucket(c.unique, buckets):
        out[x] = unpack(got[k], dtype)
    return out


def _send_again(table: pa.Table, found: pa.Table, buckets: int, last: bool) -> pa.Table:
    (c,) = coded(table.to_batches())
    return _send(c, _packed(c, found, 0, np.uint8, buckets), buckets, last)


def likelihood(m: np.ndarray) -> float:
    return _f(m).sum() - _f(m.sum(0)).sum() - _f(m.sum(1)).sum()


class Model:
    """What scoring needs besides classes and counts of words: transitions, tokens and types by class."""

    def __init__(self, m: np.ndarray, types: np.ndarray):
        self.tokens, self.types = m.sum(0), types.astype(np.float64)
        self.types[K - 1] = self.tokens[K - 1] > 0
        self.train_tokens, self.train_types = int(self.tokens.sum()), int(self.types.sum())
        self.transition = np.log10((m + 0.5) / (m.sum(1, keepdims=True) + 0.5 * K))


def learn(texts: DataFrame, words: DataFrame, buckets: int) -> tuple[Model, DataFrame]:
    """The model of CODED and its vocabulary, and what the buckets answer the parts (FLAGS)."""
    found = words.mapInArrow(_top, "kind int, word long, shape int, n long, v long")
    top = found.where(f"kind = 1 AND shape != {SHAPES - 1}").orderBy(F.desc("n"), "word").limit(SEED).collect()
    top = [(r["word"], r["shape"], r["n"]) for r in top]
    hashes = np.array([w for w, _, _ in top], np.int64).view(U64)
    order, bigrams = np.argsort(hashes), bigram_counts(texts, top)
    of = exchange(bigrams, len(top))
    hashes, of_word = hashes[order], of[: len(top)][order]
    member = np.zeros((len(bigrams), K))
    member[np.arange(len(bigrams)), of] = 1
    m = member.T @ bigrams @ member

    def run(batches):
        for c in coded(batches):
            yield from _send(c, _symbols(hashes, of_word, CLASSES, c.unique, c.shape), buckets).to_batches()

    sent, best = texts.mapInArrow(run, SENT), None
    for k in range(ROUNDS):
        answered = checkpointed(sent.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(grouped(_move, m=m), ANSWERS))
        freed(sent) if k else tidied(texts.sparkSession)
        sent = checkpointed(texts.groupBy("part").cogroup(answered.where("kind = 0").groupBy("part")).applyInArrow(paired(_send_again, buckets=buckets, last=k == ROUNDS - 1), SENT))
        m = _matrix(sent.where("symbol IS NOT NULL").select("symbol", "counts"), K)
        if best is not None:
            if likelihood(m) <= likelihood(best[0]):
                freed(answered)
                break
            freed(best[1])
        best = m, answered
    freed(sent)
    m, answered = best
    types = sum((unpack(r["body"], np.int64) for r in answered.where("kind = 2").select("body").collect()), np.zeros(K, np.int64))
    return Model(m, types), answered.where("kind != 2")


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _score(table: pa.Table, found: pa.Table, buckets: int, model: Model) -> pa.Table:
    (c,) = coded(table.to_batches())
    of, counts = _packed(c, found, 0, np.uint8, buckets), _packed(c, found, 1, np.int64, buckets)
    counts[c.shape == SHAPES - 1] = model.tokens[K - 1]
    n, v = model.train_tokens, model.train_types
    base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
    emission = np.log10((counts + 0.5) / (model.tokens[of] + 0.5 * (model.types[of] + 1)))
    symbol = of[c.at]
    scores = model.transition[c.before(symbol, K - 1), symbol] + emission[c.at]
    out = [np.add.reduceat(x, c.first) for x in ((counts[c.at] > 0).astype(np.int64), base[c.at], scores)]
    return pa.table({"doc_id": pa.array(c.docs, pa.int64(), mask=c.docs == NO_ID), "held_out": pa.array(c.held, pa.bool_()), "n_tokens": pa.array(c.n), "n_known": pa.array(out[0], pa.int64()), "train_tokens": pa.array([n] * len(c.docs), pa.int64()), "base_score": pa.array(out[1], pa.float64()), "score": pa.array(out[2], pa.float64()), "perplexity": pa.array(10.0 ** (-out[2] / c.n), pa.float64())})


def score_texts(docs: DataFrame) -> DataFrame:
    """RESULT for every document."""
    parts = part_count(docs)
    texts = checkpointed(coded_texts(docs))
    words = checkpointed(vocabulary(texts, parts))
    model, answered = learn(texts, words, parts)
    freed(words)
    return texts.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(paired(_score, buckets=parts, model=model), RESULT)


def op6_class_ngram_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
