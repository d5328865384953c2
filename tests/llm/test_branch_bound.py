import math
import random

from quarry.llm.branch_bound import op8_exact_top_k, top_k


def brute(rows, queries, k=5):
    ok = lambda e: e is not None and all(x is not None and math.isfinite(x) for x in e)
    whole = lambda e: [math.floor(256 * x) for x in e]
    rows = [(i, whole(e)) for i, e in rows if ok(e)]
    out = []
    for q, e in [(i, whole(e)) for i, e in queries if ok(e)]:
        best = sorted((-sum(a * b for a, b in zip(e, c)), float("inf") if i is None else i, i) for i, c in rows if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(op8_exact_top_k(spark, sf)) == brute(rows, [r for r in rows if r[0] % 50 == 0])


def test_odd_rows_and_blocks(spark):
    rnd = random.Random(8)
    centres = [[rnd.gauss(0, 1) for _ in range(40)] for _ in range(4)]
    rows = [(i, [x + rnd.gauss(0, 0.1) for x in rnd.choice(centres)]) for i in range(200)]
    rows += [(300 + i, rows[3][1]) for i in range(20)]
    rows += [(None, rows[3][1]), (400, None), (401, [float("nan")] * 40), (402, [None] * 40), (403, [float("inf")] + [0.0] * 39), (404, []), (405, [1.0] * 7)]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score int, query_id string")
    queries = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    asked = vectors.where("vec_id % 10 = 0")
    for q, c in ((7, 30), (2048, 8192)):
        assert got(top_k(vectors, asked, query_block=q, candidate_block=c)) == brute(rows, queries)
    assert got(top_k(vectors.limit(0), asked)) == [] and got(top_k(vectors, asked.limit(0))) == []
    assert len(got(top_k(vectors.where("vec_id < 3"), vectors.where("vec_id < 3")))) == 6
