import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm.class_lm import CLASSES, K, best_classes, exchange, likelihood, score_texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [*WORD.findall("".join(c.lower() if c.isascii() else c for c in text or "")), "\n"]


def brute(rows):
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {(i, t): (out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t in rows}


def check(spark, rows):
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, held_out boolean")
    found = score_texts(docs).collect()
    want = sorted(((i, *brute(rows)[i, t]) for i, t in rows), key=str)
    assert [tuple(r)[:5] for r in sorted(found, key=lambda r: str((r.doc_id, r.held_out, r.n_tokens, r.n_known)))] == [w[:5] for w in sorted(want, key=lambda w: str(w[:4]))]
    assert sorted(r.base_score for r in found) == pytest.approx(sorted(w[5] for w in want))
    assert all(r.score < 0 or r.n_tokens == 1 for r in found)
    return found


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = check(spark, rows)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (None, "A b É"), (3, "a B"), (3, "a B"), (4, "x1 " * 5000), (29, "a new word")])
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_without_training(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    check(spark, [(only, "a b")])


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    # Words 0-9 are followed by 10-19 and the other way round: two classes explain it.
    m = np.zeros((21, 21))
    m[:10, 10:20] = rng.integers(5, 9, (10, 10))
    m[10:20, :10] = rng.integers(5, 9, (10, 10))
    m[20, 0] = m[15, 20] = 3
    of = exchange(m, 20, classes=2)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10] and of[20] == 2

    def likelihood(of):
        k = np.zeros((of.max() + 1,) * 2)
        np.add.at(k, (of[:, None].repeat(len(of), 1), of[None].repeat(len(of), 0)), m)
        f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return f(k) - f(k.sum(0)) - f(k.sum(1))

    m = rng.integers(0, 20, (43, 43)).astype(float)
    start = np.concatenate([np.minimum(np.arange(40), 5), 6 + np.arange(3)])
    assert likelihood(exchange(m, 40, classes=6)) > likelihood(start)


def test_rare_words_are_classed_by_exchange(spark):
    from quarry.llm.class_lm import SEED

    rnd = random.Random(3)
    first, second = [f"a{i:03d}" for i in range(SEED)], [f"b{i:03d}" for i in range(SEED)]
    docs = [(5 * i, " ".join(w for _ in range(60) for w in (rnd.choice(first), rnd.choice(second)))) for i in range(400)]
    # p stands where first words stand, q where second words stand.
    rare = [(3000 + i, " ".join(x for _ in range(3) for x in (f"p{i % 9}xx", rnd.choice(second), rnd.choice(first), f"q{i % 9}xx"))) for i in range(90)]
    rare = [(i, t.replace("xx p", f"xx {first[i % SEED]} {second[i % SEED]} p")) for i, t in rare]
    held = [i for i in range(5000, 5200) if zlib.crc32(str(i).encode()) % 5 == 1]
    right, wrong = [(held[i], f"a001 b001 p{i}xx b002") for i in range(9)], [(held[9 + i], f"a001 b001 q{i}xx b002") for i in range(9)]
    rows = [r for r in docs + rare if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    # p and q words have one shape and are below the SEED words; only the exchange tells them apart.
    scores = {r.doc_id: r.score for r in check(spark, rows + right + wrong)}
    assert sum(scores[i] for i, _ in right) > sum(scores[i] for i, _ in wrong) + 9


def test_best_classes_as_by_brute_force():
    rng = np.random.default_rng(1)
    words = 30
    bigrams = rng.integers(0, 4, (words, words)).astype(float)
    of = np.concatenate([rng.integers(0, 4, 20), rng.integers(CLASSES, K, 10)])

    def matrix(of):
        m = np.zeros((K, K))
        np.add.at(m, (of[:, None].repeat(words, 1), of[None].repeat(words, 0)), bigrams)
        return m

    rows = []
    for w in range(words):
        other = np.arange(words) != w
        counts = np.concatenate([np.bincount(of[other], bigrams[w, other], K), np.bincount(of[other], bigrams[other, w], K), [bigrams[w, w]]])
        rows += [(w, c, counts[c]) for c in np.flatnonzero(counts)]
    word, column, n = (np.array(x) for x in zip(*rows))
    found = best_classes(word, column, n, of, matrix(of))
    for w in range(words):
        tried = [likelihood(matrix(np.where(np.arange(words) == w, c, of))) for c in range(CLASSES)]
        assert tried[found[w]] == pytest.approx(max(tried))
