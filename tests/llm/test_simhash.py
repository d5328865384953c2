import random
import re

import pytest
import xxhash

from quarry.llm.components import connected_components
from quarry.llm.simhash import BKTree, links, near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def print_of(text, k=3):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """{index: smallest index reachable} by brute force."""
    root = list(range(len(prints)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def brute(rows):
    prints = [print_of(t) for _, t in rows]
    root = classes(prints)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, root)), key=str)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(10001, None), (10002, ""), (10003, "A b"), (10004, "a\tB"), (None, "É x y z"), (None, "É x y z"), (10004, "a b")]
    rows += [(10005, "longword" * 30_000), (10006, " ".join(f"Q{k % 977}" for k in range(60_000)))]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component long".replace("component long", "component_id string"))
    assert sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("chunk", [5, 4096])
def test_links_lose_nothing(spark, chunk):
    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    prints = list({c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) & (2**64 - 1) for c in centres for _ in range(40)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    found = {r.node: r.component for r in connected_components(links(nodes, chunk=chunk)).collect()}
    want = classes(prints)
    for i, p in enumerate(prints):
        for j in range(i):
            same = found.get(signed(p), signed(p)) == found.get(signed(prints[j]), signed(prints[j]))
            assert same == (want[i] == want[j])


def test_tree_follows_edges_within_radius():
    rnd = random.Random(4)
    tree, values = BKTree(), [rnd.getrandbits(12) for _ in range(300)]
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 200), (300, 250), (260, 300)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200, 250: 250, 260: 250, 300: 250}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert near_duplicates(empty).count() == 0
