import hashlib
import random
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import suffix_array
from quarry.llm.parts import merge_sketches
from quarry.llm.suffix_array import HOT, Runs, drop_repeats, remove_repeated_bytes, suffix_order

END = float("inf")


def brute(rows, length=50):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            first[w] = min(first.get(w, END), END if i is None else i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < (END if i is None else i):
                gone[k + 1 : k + 1 + length] = True
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, hot=HOT):
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    return sorted((tuple(r) for r in remove_repeated_bytes(docs, hot=hot).collect()), key=str)


@pytest.mark.parametrize("alphabet", [2, 4, 200])
def test_suffix_order(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 50, 301, 1000]:
        s = rng.integers(1, alphabet, n)
        if n > 100:
            s[60:100] = s[:40]
        order = suffix_order(s, alphabet, 10**9)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("hot", [HOT, 2, 0])
def test_matches_brute_force(spark, hot):
    rnd = random.Random(2)
    passages = ["".join(rnd.choice("abc dé") for _ in range(rnd.randrange(30, 140))) for _ in range(12)]
    rows = []
    for i in range(70):
        text = "".join(rnd.choice(passages)[rnd.randrange(20) :] if rnd.random() < 0.5 else "".join(rnd.choice("xyz uvwß") for _ in range(rnd.randrange(80))) for _ in range(rnd.randrange(7)))
        rows.append((i if i != 9 else None, text, "clash"))
    rows += [(200, rows[5][1], None), (200, rows[6][1] + "!", None), (201, None, None), (202, "", None), (203, "ab" * 400, None), (204, "b" + "ab" * 300, None), (205, "é" * 3000, None), (206, "é" * 40, None)]
    assert got(spark, rows, hot) == brute([r[:2] for r in rows])


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    for hot in (HOT, 3):
        assert sorted((tuple(r) for r in remove_repeated_bytes(docs, hot=hot).collect()), key=str) == want


def test_hot_anchor_is_dealt_out():
    """A phrase in thousands of contexts: one key before the split, then few pieces a key and every window once."""
    rnd = random.Random(3)
    texts = [("".join(rnd.choice("abcdefgh ") for _ in range(40)) + "a phrase that is very common here " + "".join(rnd.choice("abcdefgh ") for _ in range(40))).encode() for _ in range(3000)]
    runs = Runs(texts, 50)
    _, of, many = np.unique(runs.key, return_inverse=True, return_counts=True)
    windows = int(runs.count.sum())
    assert many.max() > 1000 and windows == sum(len(t) - 49 for t in texts)
    runs.split(many[of] > 10, texts, 50)
    flat = {(r, k) for r, a, n in zip(runs.row, runs.start, runs.count) for k in range(a, a + n)}
    assert len(flat) == int(runs.count.sum()) == windows
    assert np.unique(runs.key, return_counts=True)[1].max() <= 10


def test_empty(spark):
    assert got(spark, []) == []


def test_drop_repeats_keeps_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = drop_repeats(docs)
    assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
    assert out.count() == docs.count()
    row = spark.createDataFrame([(1, "é" * 30, "a", "b", 30), (2, "x" + "é" * 30 + "y", "a", "b", 32)], docs.schema)
    assert {r.doc_id: r.text for r in drop_repeats(row).collect()} == {1: "é" * 30, 2: "xy"}


def test_drop_repeats_odd_rows(spark):
    """Genuine replacement characters, cut characters, nulls, repeated rows, clashing names, an empty table."""
    shared = "0123456789" * 6
    rows = [(1, "bad \ufffd mark " + shared, "a"), (2, "x\ufffd" + shared + "\ufffdy", "b"), (3, None, "c"), (4, "", "d"), (None, shared, "e"), (None, shared, "e"), (5, "ä" + "é" * 40, "f"), (6, "ö" + "é" * 40, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").selectExpr("*", "kept as rest", "kept as n_removed", "kept as part")
    out = drop_repeats(docs)
    assert out.columns == docs.columns
    found = sorted(((r.doc_id, r.text, r.kept) for r in out.collect()), key=str)
    assert found == sorted([(1, rows[0][1], "a"), (2, "x\ufffd\ufffdy", "b"), (3, None, "c"), (4, "", "d"), (None, "", "e"), (None, "", "e"), (5, rows[6][1], "f"), (6, "ö", "g")], key=str)
    assert drop_repeats(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(300_000))
    assert got(spark, [(1, long, ""), (2, "z" + long[1000:200_000], ""), (3, "q" * 100_000, "")]) == brute([(1, long), (2, "z" + long[1000:200_000]), (3, "q" * 100_000)])


def test_hot_runs_are_keyed_at_once(monkeypatch):
    """Cutting hot runs calls nothing once a piece; equal windows still get one key, windows with other shared bytes another."""
    def refused(*_):
        raise AssertionError("a hash a piece")

    monkeypatch.setattr(suffix_array, "xxh3_64_intdigest", refused)
    line = b"a line of a licence that is in very many documents, whatever stands around it"
    texts = [bytes([65 + k]) * 40 + line + bytes([97 + k]) * 40 for k in range(6)]
    runs = suffix_array.Runs(texts, 50)
    runs.split(np.ones(len(runs.row), bool), texts, 50)
    keys: dict[bytes, set[int]] = {}
    seen = 0
    for row, start, count, key in zip(runs.row.tolist(), runs.start.tolist(), runs.count.tolist(), runs.key.tolist()):
        assert count <= suffix_array.STEP
        for k in range(start, start + count):
            keys.setdefault(texts[row][k : k + 50], set()).add(key)
            seen += 1
    assert seen == sum(len(t) - 49 for t in texts)
    assert all(len(keys[line[k : k + 50]]) == 1 for k in range(len(line) - 49))
    assert len(set().union(*keys.values())) > len(texts)


def test_a_pair_of_part_and_bucket_costs_little():
    """Pairs of part and bucket grow with the square of the input, so a bucket does next to nothing for each, only for each piece."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(90)).encode() for _ in range(4)]

    def bucket(parts):
        table = lambda part: pa.table({"part": pa.array([part] * 4, pa.int32()), "doc_id": pa.array(range(part, part + 4)), "body": pa.array(texts, pa.binary())})
        flags = merge_sketches(pa.concat_tables([suffix_array._sketch(table(k), 1, 50) for k in range(parts)]), hot=HOT)
        return pa.concat_tables([suffix_array._pieces(table(k), flags.filter(pa.array(np.array(flags["part"]) == k)), 1, 50) for k in range(parts)])

    def calls(table):
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(1) if event == "c_call" else None)
        try:
            out = suffix_array._classes(table, 50)
        finally:
            sys.setprofile(None)
        assert len(out) == len(table)
        return len(seen)

    few, many = bucket(20), bucket(120)
    pieces = sum(len(x) if isinstance(x, bytes) else sum(map(len, x)) for x in many["sizes"].to_pylist()) // 2 // 120
    assert pieces >= 4 and (calls(many) - calls(few)) / 100 <= 10 + 3 * pieces


def test_a_part_full_of_repeats_stays_small():
    """Marking the bytes takes memory by runs of windows, not eight bytes and more for each window many times over."""
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(20_000)).encode() for _ in range(300)]
    table = lambda part: pa.table({"part": pa.array([part] * 300, pa.int32()), "doc_id": pa.array(range(300 * part, 300 * part + 300)), "body": pa.array(texts, pa.binary())})
    flags = merge_sketches(pa.concat_tables([suffix_array._sketch(table(k), 1, 50) for k in range(2)]), hot=HOT)
    of = lambda t, k: t.filter(pa.array(np.array(t["part"]) == k))
    classes = suffix_array._classes(pa.concat_tables([suffix_array._pieces(table(k), of(flags, k), 1, 50) for k in range(2)]), 50)
    size, both = sum(map(len, texts)), of(pa.concat_tables([flags, classes]), 1)
    tracemalloc.start()
    try:
        out = suffix_array._apply(table(1), both, 1, 50, False)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(out["n_removed"].to_pylist()) == size and set(out["n_spans"].to_pylist()) == {1}
    assert peak < 30 * size


def test_parts_follow_the_bytes(spark, tmp_path, monkeypatch):
    """Many small files make no more parts: the pairs of part and bucket would grow with the square of the files."""
    path = str(tmp_path / "docs")
    spark.range(400).selectExpr("id as doc_id", "repeat(chr(65 + id % 26), 100) as text").repartition(40).write.parquet(path)
    docs = spark.read.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert docs.rdd.getNumPartitions() >= 40
        assert suffix_array._part_count(docs) == 4
        monkeypatch.setattr(suffix_array, "PART", 1000)
        assert suffix_array._part_count(docs) == 40
        assert suffix_array._part_count(docs.limit(0)) == 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
