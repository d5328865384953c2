"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Only the vocabulary (pieces, scores, kinds) is read from the model file; merging is done here.

* A text gets a leading mark and its spaces become marks (U+2581).  No piece has a mark after
  another character, and no piece of several characters holds a line feed, so texts are cut there
  into segments that merge independently; equal segments are merged once (a bounded cache).
* The symbols of all new segments lie in one flat array.  A round looks up the rank of every
  neighbouring pair, takes the least rank of each segment, merges its occurrences from the left
  without overlap, and compacts the array; segments without a pair drop out.
* The library merges one pair at a time, best rank and leftmost first.  Merging all occurrences at
  once gives the same unless a merge makes a pair of better or equal rank; where one would, only the
  leftmost occurrence of that segment is merged in the round.
* Symbols that are no pieces become byte pieces.  Decoding joins the surfaces of the ids, bytes
  included, marks as spaces, without the leading one.

Defined cases: a null or empty text has no ids and decodes to the empty text; texts of any length,
without white space too; repeated rows give repeated rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.parts import group_starts

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
NONE = np.iinfo(np.int32).max
#: Segments kept merged in a worker, and characters merged at once.
CACHE, BLOCK = 300_000, 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pair ranks and ids of a byte-fallback BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ids = {pieces[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) or "\n" in p and len(p) > 1 for p in ids):
            raise ValueError("the vocabulary has pieces that cross the cuts between segments")
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        rank_of = {s: k for k, s in enumerate(scores)}
        #: Symbols are ids; characters that are no pieces but start or end one get numbers from n on; others get `other`.
        inner = {p[k : k + 1] for p in ids for k in range(len(p))} - ids.keys()
        symbols = ids | {c: n + k for k, c in enumerate(sorted(inner))}
        self.n, self.other = n, n + len(inner)
        self.base = self.other + 1
        self.of_char = np.full(0x110000, self.other, np.int32)
        for s, k in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    pairs[symbols[p[:k]] * self.base + symbols[p[k:]]] = (rank_of[model.get_score(i)], i)
        order = sorted(pairs)
        self.keys = np.array(order + [np.iinfo(np.int64).max], np.int64)
        self.rank = np.array([pairs[k][0] for k in order] + [NONE], np.int32)
        self.merged = np.array([pairs[k][1] for k in order] + [0], np.int32)
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = [str(i).encode() for i in range(n)]
        of_byte = {i: bytes([b]) for b, i in enumerate(self.byte)}
        self.surface = [of_byte.get(i, b"" if model.is_control(i) else pieces[i].replace(MARK, " ").encode()) for i in range(n)]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in `keys`; the last index (rank NONE) if they do not merge."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)


def merge_rounds(v: Vocabulary, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Final symbols of all segments in order, the segment of each, and the character at which each begins (in the joined text)."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol, segment, begin = v.of_char[codes], np.repeat(np.arange(len(segments), dtype=np.int32), sizes), np.arange(len(codes), dtype=np.int32)
    done: list[tuple[np.ndarray, ...]] = []
    while len(symbol):
        pair = v.pair(symbol[:-1], symbol[1:])
        pair[segment[1:] != segment[:-1]] = len(v.keys) - 1
        rank = np.append(v.rank[pair], NONE)
        starts = group_starts(segment)
        lengths = np.diff(np.append(starts, len(segment)))
        best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
        over = best == NONE
        if over.any():
            done.append((symbol[over], segment[over], begin[over]))
        hit = np.flatnonzero((rank == best) & ~over)
        if len(hit):
            hit = _apart(hit)
            hit = _safe(v, symbol, segment, best, pair, hit)
            symbol[hit] = v.merged[pair[hit]]
            over[hit + 1] = True
        symbol, segment, begin = symbol[~over], segment[~over], begin[~over]
    if not done:
        return symbol, segment, begin
    symbol, segment, begin = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(begin, kind="stable")
    return symbol[order], segment[order], begin[order]


def _apart(hit: np.ndarray) -> np.ndarray:
    """Every other one of neighbouring positions, from the left."""
    new = np.ones(len(hit), bool)
    new[1:] = hit[1:] != hit[:-1] + 1
    first = np.flatnonzero(new)
    inside = np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))
    return hit[inside % 2 == 0]


def _safe(v: Vocabulary, symbol: np.ndarray, segment: np.ndarray, best: np.ndarray, pair: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The hits, but only the leftmost in segments where one of several merges would make a pair of better or equal rank."""
    own = segment[hit]
    starts = group_starts(own)
    sizes = np.diff(np.append(starts, len(hit)))
    several = np.repeat(sizes > 1, sizes)
    if not several.any():
        return hit
    h = hit[several]
    new = v.merged[pair[h]]
    unsafe = np.zeros(len(h), bool)
    padded = np.concatenate([symbol, np.full(2, v.other, np.int32)])
    after = np.where(np.append(segment, [-1, -1])[h + 2] == segment[h], padded[h + 2], v.other)
    before = np.where((h > 0) & (segment[h - 1] == segment[h]), symbol[h - 1], v.other)
    joined = np.zeros(len(h), bool)
    joined[1:] = (h[1:] == h[:-1] + 2) & (segment[h[1:]] == segment[h[:-1]])
    left = np.where(joined, np.concatenate([new[:1], new[:-1]]), before)
    for a, b in ((new, after), (before, new), (left, new)):
        unsafe |= v.rank[v.pair(a, b)] <= best[h]
    bad = np.isin(own, segment[h[unsafe]])
    first = np.zeros(len(hit), bool)
    first[starts] = True
    return hit[~bad | first]


class Codec:
    """Encodes and decodes with one vocabulary; keeps a bounded number of merged segments."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.index: dict[str, int] = {}
        self.ids: list[list[int]] = []
        self.joined: list[bytes] = []
        self.counts: list[int] = []
        self.surface: list[bytes] = []

    def segments(self, text: str) -> list[str]:
        return SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, segments: list[str]) -> None:
        """Merges segments that are not known yet (all different), a block of characters at a time."""
        start, size = 0, 0
        for k, s in enumerate(segments):
            size += len(s)
            if size >= BLOCK or k == len(segments) - 1:
                self._learn(segments[start : k + 1])
                start, size = k + 1, 0

    def _learn(self, segments: list[str]) -> None:
        v = self.v
        symbol, segment, begin = merge_rounds(v, segments)
        text = "".join(segments)
        at = np.searchsorted(segment, np.arange(len(segments) + 1)).tolist()
        symbols, begins = symbol.tolist(), begin.tolist()
        for k, s in enumerate(segments):
            own = symbols[at[k] : at[k + 1]]
            if max(own) >= v.n:
                own = [i for x, b in zip(own, begins[at[k] : at[k + 1]]) for i in ((x,) if x < v.n else (v.byte[c] for c in text[b].encode("utf-8", "replace")))]
            self.index[s] = len(self.ids)
            self.ids.append(own)
            self.joined.append(b",".join([v.text[i] for i in own]))
            self.counts.append(len(own))
            self.surface.append(b"".join([v.surface[i] for i in own]))

    def prepare(self, texts: list[str]) -> list[list[int]]:
        """The known numbers of the segments of each text."""
        if len(self.index) > CACHE:
            self.index.clear()
            self.ids, self.joined, self.counts, self.surface = [], [], [], []
        cut = [self.segments(t) for t in texts]
        new = {s for c in cut for s in c if s not in self.index}
        if new:
            self.learn(list(new))
        return [[self.index[s] for s in c] for c in cut]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[i for k in own for i in self.ids[k]] for own in self.prepare(texts)]

    def decode(self, ids: list[int]) -> str:
        whole = b"".join([self.v.surface[i] for i in ids])
        return (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; no shuffle."""
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            counts, ids, decoded = [], [], []
            for lo in range(0, len(texts), 256):
                for own in c.prepare(texts[lo : lo + 256]):
                    counts.append(sum([c.counts[k] for k in own]))
                    ids.append(hashlib.sha256(b",".join([c.joined[k] for k in own])).hexdigest())
                    whole = b"".join([c.surface[k] for k in own])
                    decoded.append(hashlib.sha256(whole[1:] if whole[:1] == b" " else whole).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("body")).mapInArrow(run, RESULT)


def tokenized(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the ids themselves."""
    path = model or default_model()

    def run(batches):
        for batch in batches:
            ids = codec(path).encode([t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("body")).mapInArrow(run, "doc_id long, ids array<int>")


def detokenized(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) out of (doc_id, ids); a null list gives the empty text."""
    path = model or default_model()

    def run(batches):
        for batch in batches:
            texts = [codec(path).decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
