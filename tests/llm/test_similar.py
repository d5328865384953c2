import random

from quarry.llm.similar import _shards, candidates, keep_one_of_each_group, node_names, set_fingerprint, shingle_sets, similar_groups, simhash_groups


def words(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def test_rows_that_stay(spark):
    """Shared ids, repeated rows, null ids, null and empty texts, clashing columns."""
    rnd = random.Random(1)
    x, y, z = (" ".join(words(rnd, 60)) for _ in range(3))
    rows = [(1, x, "a"), (5, x, "b"), (5, y, "c"), (7, z, "d"), (7, z, "d"), (7, z, "d"), (None, x.upper(), "e"), (None, "only here", "f"), (None, "only  here", "f"), (3, None, "g"), (2, "", "h"), (4, " \t\n", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").selectExpr("*", "node as times", "node as id", "node as component", "node as `a.b`")
    kept = keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    found = sorted((tuple(r)[:3] for r in kept.collect()), key=str)
    (only,) = [r for r in found if r[2] == "f"]
    assert only[:2] in {(None, "only here"), (None, "only  here")}
    assert [r for r in found if r[2] != "f"] == sorted([(1, x, "a"), (5, y, "c"), (7, z, "d"), (2, "", "h")], key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert keep_one_of_each_group(empty).count() == similar_groups(empty).count() == 0


def test_very_long_texts(spark):
    """Copies of 200,000 words with one word in fifty changed, and one in ten."""
    rnd = random.Random(2)
    long = words(rnd, 200_000)
    near = [w if i % 50 else "x" for i, w in enumerate(long)]
    far = [w if i % 10 else "y" for i, w in enumerate(long)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_chunks_find_all_links(spark):
    """A crowded shard whose groups are only linked across chunks, against one chunk for all."""
    rnd = random.Random(3)
    base, rows = words(rnd, 100), []
    for k in range(60):
        copy = list(base)
        for at in rnd.sample(range(100), rnd.randrange(6)):
            copy[at] = f"x{k}-{at}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.component_id for r in similar_groups(docs).collect()}
    assert {r.doc_id: r.component_id for r in similar_groups(docs, chunk=4).collect()} == whole


def test_simhash_finds_the_first_candidates(spark):
    """SimHash groups against brute force; keys inside one of them are no shards; what is further apart is linked too."""
    rnd = random.Random(5)
    rows = []
    for k in range(12):
        base = words(rnd, 400)
        rows.append(" ".join(base))
        for changed in (1, 2, 8):  # the last one is beyond the radius
            copy = list(base)
            for at in range(changed):
                copy[at * 30 + k] = "x"
            rows.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    nodes = candidates(docs, 3, 5, 0.8)
    prints = {r.node: r.print & 2**64 - 1 for r in nodes.collect()}
    assert prints == {n: set_fingerprint(s) & 2**64 - 1 for n, s in zip(node_names([t.encode() for t in rows]), shingle_sets([t.encode() for t in rows], 5))}
    near = {n: n for n in prints}
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and near[a] != near[b]:
                near = {n: near[a] if g == near[b] else g for n, g in near.items()}
    groups = {frozenset(n for n in near if near[n] == g) for g in near.values()}
    by_print = {r.print & 2**64 - 1: r.near for r in simhash_groups(nodes).collect()}
    assert {frozenset(n for n in prints if by_print[prints[n]] == g) for g in by_print.values()} == groups
    shards = {}
    for r in _shards(nodes).collect():
        shards.setdefault(r.shard, set()).add(r.node)
    inside = [s for s in shards.values() if any(s <= g for g in groups)]
    assert sorted(map(sorted, inside)) == sorted(sorted(g) for g in groups if len(g) > 1) and 0 < len(inside) < len(shards)
    assert {r.doc_id: r.component_id for r in similar_groups(docs).collect()} == {i: i // 4 * 4 for i in range(48)}
