import math
import random
import re
from collections import Counter

import pytest

from quarry.llm.quality import CLASSES, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, WORDS, drop_low_quality, quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def histograms(text):
    classes, words = [0] * CLASSES, [0] * (len(WORDS) + 1)
    for c in text:
        k = 6 if ord(c) > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\n\v\f\r" else 4 if c in "#*$%&|<>" else 5
        classes[k] += 1
    for w in WORD.findall("".join(c.lower() if c.isascii() else c for c in text)):
        words[WORDS.index(w) if w in WORDS else -1] += 1
    return classes, words


def distance(a, b):
    sa, sb = sum(a), sum(b)
    if not sa or not sb:
        return 0
    total = 0
    for x, y in zip(a, b):
        p, q = x / sa, y / sb
        m = (p + q) / 2
        total += (p * math.log2(p / m) if p else 0) + (q * math.log2(q / m) if q else 0)
    return math.sqrt(max(0, total / 2))


def brute(rows):
    sums = {}
    for _, text, lang in rows:
        if not base(text)[-1]:
            for key in {lang, None}:
                for total, h in zip(sums.setdefault(key, ([0] * CLASSES, [0] * (len(WORDS) + 1))), histograms(text)):
                    total[:] = [a + b for a, b in zip(total, h)]
    out = []
    for i, text, lang in rows:
        b = base(text)
        ref, far = sums.get(lang), False
        if ref and b[0]:
            wide = max(1, 100 / b[0]) ** 0.5
            share = sum(ref[1][:-1]) / max(1, sum(ref[1]))
            enough = 0 < share < 1 and (1 - share) ** b[0] <= 1e-4 or share == 1
            bare = distance([0] * len(WORDS) + [1], ref[1]) * (1 - 1e-9)
            limits = (MAX_CLASS_DISTANCE * wide, min(MAX_WORD_DISTANCE, bare) if enough else MAX_WORD_DISTANCE * wide)
            far = any(distance(h, r) > m for h, r, m in zip(histograms(text), ref, limits))
        out.append((i, *b, not b[-1] and not far))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()), key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    want = brute([tuple(r) for r in docs.collect()])
    assert got(docs) == want
    assert {r[-1] for r in want} == {True, False}
    counts = Counter((r.class_distance > MAX_CLASS_DISTANCE, r.word_distance > 0.34) for r in quality(docs).where("n_words >= 100 and not base_failed").collect())
    assert counts[True, False] + counts[True, True]


def test_odd_rows(spark):
    rnd = random.Random(5)
    say = lambda n, v: " ".join(rnd.choice(v) for _ in range(n))
    rows = [(1, None, "en"), (None, "", None), (2, "a\n\na\n a\na\n", "en"), (2, "a\n\na\n a\na\n", "en"), (3, "x y z x y z x", "en"), (4, "é ü\x1fb\x0bc" * 40, "fr"), (5, say(20000, ["the", "of", "cat", "Straße"]), None), (6, say(300, ["###", "$$$", "a%%"]), "en")]
    rows += [(10 + i, say(150, ["the", "of", *map(str, range(1000))]), "en") for i in range(9)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n_words int")
    assert got(docs) == brute(rows)
    kept = [r[0] for r in brute(rows) if r[-1]]
    assert sorted(r.doc_id for r in drop_low_quality(docs).collect()) == sorted(kept)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert got(docs) == [] and drop_low_quality(docs).count() == 0


def test_words_alone_reject_a_text(spark):
    rnd = random.Random(8)
    say = lambda n, v: " ".join(rnd.choice(v) for _ in range(n))
    names = ["".join(rnd.choice("etaoinshr") for _ in range(4)) + "x" for _ in range(3000)]
    rows = [(i, say(300, ["the", "of", "and", "to", *names[:12], *names[:3000:250]]) + " " + say(300, names), "en") for i in range(30)] + [(99, say(300, names), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality(docs).collect()}
    assert not found[99].base_failed and found[99].class_distance <= MAX_CLASS_DISTANCE
    assert [i for i, r in found.items() if not r.base_failed and not r.kept] == [99]
    assert 99 not in {r.doc_id for r in drop_low_quality(docs).collect()}


def test_each_text_is_measured_once(spark, tmp_path):
    """The filter measures no text a second time, and rows keep columns that are named like its own."""
    rnd = random.Random(7)
    text = lambda: " ".join(rnd.choice(WORDS) if rnd.random() < 0.4 else "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(3, 9))) for _ in range(120))
    rows = [(i, text(), "en", f"r{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string").selectExpr("*", "row as n_words", "row as classes")
    log = tmp_path / "seen"

    def noted(batches):
        for batch in batches:
            with log.open("a") as f:
                f.write("".join(f"{x}\n" for x in batch.column(0).to_pylist()))
            yield batch

    out = drop_low_quality(docs.mapInArrow(noted, docs.schema))
    found = out.collect()
    assert out.columns == docs.columns and found
    assert all(r.row == r.n_words == r.classes == f"r{r.doc_id}" for r in found)
    assert sorted(map(int, log.read_text().split())) == list(range(20))
