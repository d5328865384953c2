"""Quality rules: divergence of a document's histograms from its language's reference.

Two histograms are taken of every text: characters by class, and words by common word (`COMMON`,
the last bin holds all other words).  The reference of a language is the sum over its documents
that pass the base rules, so it is learned from the whole table.  A document is rejected if the
Jensen-Shannon distance (base 2, square root) of either histogram from the reference is over its
limit.  Short histograms scatter, so limits widen with the square root of FULL / n_words below FULL
words (the base rules leave no document under 50).  The limit for words follows the reference: a
document is rejected too if it is at least as far from it as a text without any common word, once it
is so long that a text of the language has none by chance with a probability below CHANCE.  A null
language is compared with the reference of all languages together.  A language with less than
`min_share` of all words has no reference (so there are at most 1 / min_share) and is judged by the base
rules alone.

Base rules (exact counts): n_words < 50 or 100 * n_repeat_words > 50 * n_words fails a document.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; null ids,
repeated rows and very long texts are judged one by one by the whole text; an empty table gives an empty
result; with no reference at all the divergence is zero; other columns are ignored (`drop_low_quality`
carries them along, whatever their names).
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType
from xxhash import xxh3_64_intdigest

from quarry.llm.parts import U64, chunks, group_starts, mix
from quarry.session import checkpointed

#: Frequent function words of English, French, German and Spanish.
COMMON = (
    "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no",
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec",
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "de la que el en y a los se del las un por con no una su para es al lo como",
)
WORDS = tuple(dict.fromkeys(w for line in COMMON for w in line.split()))
INDEX = {w.encode(): k for k, w in enumerate(WORDS)}
#: Character classes by first byte: lower, upper, digit, space, symbols, other ASCII, not ASCII.
CLASSES, SPACES, SYMBOLS = 7, b" \t\n\v\f\r", b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
FULL, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_SHARE, CHANCE = 100, 0.28, 0.50, 0.0001, 1e-4
STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<int>, common array<int>"
JUDGED = "lang string, n_words long, n_repeat_words long, classes array<int>, common array<int>"


def _class_table() -> np.ndarray:
    table = np.full(256, 5, np.uint8)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[list(SPACES)], table[list(SYMBOLS)] = 3, 4
    table[0x80:0xC0], table[0xC0:] = CLASSES, 6  # continuation bytes fall into a bin of their own
    return table


CLASS_OF = _class_table()


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The exact counts and both histograms of each text."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    out["classes"], out["common"] = np.zeros((n, CLASSES), np.int32), np.zeros((n, len(WORDS) + 1), np.int32)
    out["n_dup_lines"][:] = [_duplicate_lines(t) for t in texts]
    for lo, hi in chunks(texts):
        m = hi - lo
        sizes = np.fromiter(map(len, texts[lo:hi]), np.int64, m)
        kinds = CLASS_OF[np.frombuffer(b"".join(texts[lo:hi]), np.uint8)]
        row = np.repeat(np.arange(m, dtype=np.int32), sizes)
        out["classes"][lo:hi] = np.bincount(row * (CLASSES + 1) + kinds, minlength=m * (CLASSES + 1)).reshape(m, -1)[:, :CLASSES]
        words = [t.split() for t in texts[lo:hi]]
        counts = np.fromiter(map(len, words), np.int64, m)
        out["n_words"][lo:hi] = counts
        total, doc = int(counts.sum()), np.repeat(np.arange(m), counts)
        found = np.fromiter(map(INDEX.get, chain.from_iterable(t.lower().split() for t in texts[lo:hi]), repeat(len(WORDS))), np.int64, total)
        out["common"][lo:hi] = np.bincount(doc * (len(WORDS) + 1) + found, minlength=m * (len(WORDS) + 1)).reshape(m, -1)
        out["n_repeat_words"][lo:hi] = _repeated(np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), U64, total), doc, m)
    out["word_chars"] = (out["classes"].sum(axis=1) - out["classes"][:, 3]).astype(np.int64)
    out["n_symbols"] = out["classes"][:, 4].astype(np.int64)
    return out


def _repeated(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words in three-word windows found twice or more in their document."""
    if len(hashes) < 3:
        return np.zeros(n, np.int64)
    window = mix(mix(hashes[:-2] * U64(0x9E3779B97F4A7C15) + hashes[1:-1]) * U64(0x9E3779B97F4A7C15) + hashes[2:])
    at = np.flatnonzero(doc[:-2] == doc[2:])
    key = mix(window[at] + doc[at].astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key)
    starts = group_starts(key[order])
    sizes = np.diff(np.append(starts, len(order)))
    hit = at[order[np.repeat(sizes > 1, sizes)]]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[hit + k] = True
    return np.bincount(doc[covered], minlength=n)


def document_statistics(docs: DataFrame) -> DataFrame:
    """STATS for every row: one pass over the texts, without a shuffle."""

    def run(batches):
        for batch in batches:
            s = statistics(batch.column(2).to_pylist())
            arrays = [batch.column(0), batch.column(1), *(pa.array(s[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
            arrays += [_lists(s[k]) for k in ("classes", "common")]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("body")).mapInArrow(run, STATS)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def references(stats: DataFrame, min_share: float) -> dict[str | None, tuple[list[int], list[int]]]:
    """Summed histograms of the documents that pass the base rules: by language with its share, and of all (None)."""
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(CLASSES)] + [F.sum(F.col("common")[k]).alias(f"w{k}") for k in range(len(WORDS) + 1)]
    passed = stats.where(~base_failed())
    by_lang = passed.groupBy("lang").agg(F.sum("n_words").alias("n"), *sums)
    whole = passed.agg(F.sum("n_words").alias("n"), *sums).first()
    cut = lambda r: ([r[f"c{k}"] for k in range(CLASSES)], [r[f"w{k}"] for k in range(len(WORDS) + 1)])
    if whole["n"] is None:
        return {}
    rows = by_lang.where(F.col("lang").isNotNull() & (F.col("n") >= min_share * whole["n"])).collect()  # at most 1 / min_share
    return {None: cut(whole)} | {r["lang"]: cut(r) for r in rows}


def distances(hist: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row from the reference row beside it; zero where either is empty."""
    p_sum, q_sum = hist.sum(axis=1, keepdims=True), reference.sum(axis=1, keepdims=True)
    p, q = hist / np.maximum(p_sum, 1), reference / np.maximum(q_sum, 1)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / middle), 0) + np.where(q > 0, q * np.log2(q / middle), 0)
    out = np.sqrt(np.maximum(terms.sum(axis=1) / 2, 0))
    return np.where((p_sum[:, 0] > 0) & (q_sum[:, 0] > 0), out, 0.0)


def both_distances(classes: np.ndarray, common: np.ndarray, langs: list, known: dict) -> list[np.ndarray]:
    """Distances of the class and the word histograms from the references of the languages (zero without one)."""
    none = ([0] * CLASSES, [0] * (len(WORDS) + 1))
    rows = [known.get(x, none) for x in langs] or [none]
    return [distances(h.astype(np.float64), np.array([r[i] for r in rows], np.float64)) if len(langs) else np.zeros(0) for i, h in enumerate((classes, common))]


def word_rule(words: list[int], most: float) -> tuple[float, float]:
    """(words from which a text is judged by it, the limit): the distance of a text without common words, `most` at most."""
    reference, none = np.array([words], np.float64), np.zeros((1, len(words)))
    none[0, -1] = 1
    share = reference[0, :-1].sum() / max(1.0, reference.sum())
    from_ = np.log(CHANCE) / np.log1p(-share) if 0 < share < 1 else 1.0 if share else np.inf
    return float(from_), min(most, float(distances(none, reference)[0]) * (1 - 1e-9))


def limits(n_words: np.ndarray, langs: list, known: dict, max_class: float, max_word: float) -> list[np.ndarray]:
    """The distances over which each document is rejected."""
    wide = np.sqrt(np.maximum(1.0, FULL / np.maximum(n_words, 1)))
    rules = {lang: word_rule(words, max_word) for lang, (_, words) in known.items()}
    from_, limit = (np.array([rules.get(x, (np.inf, max_word))[k] for x in langs], np.float64) for k in range(2))
    return [max_class * wide, np.where(n_words >= from_, limit, max_word * wide)]


def quality(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, the exact counts, base_failed, both distances and kept."""
    stats = checkpointed(document_statistics(docs))
    known = references(stats, min_share)

    def run(batches):
        for batch in batches:
            hists = [batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in ("classes", "common")]
            langs = batch.column("lang").to_pylist()
            out = [*both_distances(*hists, langs, known), *limits(batch.column("n_words").to_numpy(), langs, known, max_class, max_word)]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *map(pa.array, out)], [*names, "class_distance", "word_distance", "class_limit", "word_limit"])

    counts = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    judged = stats.mapInArrow(run, f"{counts}, class_distance double, word_distance double, class_limit double, word_limit double")
    differs = (F.col("class_distance") > F.col("class_limit")) | (F.col("word_distance") > F.col("word_limit"))
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~differs).drop("class_limit", "word_limit")


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The rows that are kept, each judged by its own text and language.

    One pass over the texts: rows that pass the base rules are written with their histograms, which give the
    references and are then judged by them.
    """
    names = docs.columns
    text = names.index("text")
    lang = names.index("lang") if "lang" in names else None
    row = StructType([StructField("row", StructType(docs.schema.fields)), *StructType.fromDDL(JUDGED).fields])

    def measured(batches):
        for batch in batches:
            s = statistics([(t or "").encode() for t in batch.column(text).to_pylist()])
            passed = (s["n_words"] >= MIN_WORDS) & (100 * s["n_repeat_words"] <= MAX_REPEAT_PERCENT * s["n_words"])
            langs = batch.column(lang).cast(pa.string()) if lang is not None else pa.nulls(batch.num_rows, pa.string())
            arrays = [pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema)), langs, *(pa.array(s[k]) for k in ("n_words", "n_repeat_words")), *(_lists(s[k]) for k in ("classes", "common"))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "lang", "n_words", "n_repeat_words", "classes", "common"]).filter(pa.array(passed))

    passed = checkpointed(docs.mapInArrow(measured, row))
    known = references(passed, MIN_SHARE)

    def judged(batches):
        for batch in batches:
            hists = [batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in ("classes", "common")]
            langs, keep = batch.column("lang").to_pylist(), np.ones(batch.num_rows, bool)
            most = limits(batch.column("n_words").to_numpy(), langs, known, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE)
            for distance, limit in zip(both_distances(*hists, langs, known), most):
                keep &= distance <= limit
            yield pa.RecordBatch.from_arrays(batch.column("row").filter(pa.array(keep)).flatten(), names=names)

    return passed.mapInArrow(judged, docs.schema)
