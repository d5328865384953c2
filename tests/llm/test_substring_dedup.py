import hashlib
import random
import re

import pytest

from quarry.llm.substring_dedup import remove_repeated_windows

SPACE = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, width):
    """(doc_id, n_words, n_removed, sha256) of each row, by a dictionary of all windows."""
    words = [(i, SPACE.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            j = float("inf") if i is None else i
            first[key] = min(first.get(key, j), j)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (float("inf") if i is None else i):
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, width=13):
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    return sorted((tuple(r) for r in remove_repeated_windows(docs, width).collect()), key=str)


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    vocabulary = ["a", "b", "ü x", "c,"]
    rows = [(i if i != 7 else None, " \n\t"[i % 3].join(rnd.choice(vocabulary) for _ in range(rnd.randrange(60))), "clash") for i in range(60)]
    rows += [(100, rows[3][1], None), (100, rows[4][1], None), (101, None, None), (102, "", None), (103, "z " * 3000, None), (104, "z " * 2000, None)]
    for width in (1, 5, 13):
        assert got(spark, rows, width) == brute([r[:2] for r in rows], width)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r) for r in remove_repeated_windows(docs).collect()), key=str) == brute(rows, 13)


@pytest.mark.parametrize("text", [None])
def test_empty(spark, text):
    assert got(spark, []) == []
    assert got(spark, [(1, text, "x")]) == [(1, 0, 0, hashlib.sha256(b"").hexdigest())]
