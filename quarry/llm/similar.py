"""Near-duplicates: candidates by SimHash in shards of BK-trees, checked exactly, and an exact way for the rest.

A group is what is linked, directly or over others, by a similarity of `similarity` or more between
sets of `shingle` words.

1. Texts are lower-cased (A-Z) and cut into words.  Equal sequences of words are one *node*; each
   input split sends a node's text on once, so a text in a third of all rows is sent once a split.
2. Parts send the 32 high bits of their distinct shingles to buckets and get back how many nodes have
   them (never too low, on a scale of logarithms).  That makes one order of all shingles, rare ones
   first.  Two sets of the similarity share one of the first n - ceil(similarity * n) + 1 shingles
   of each, so a node that shares none of these has no link and goes no further.
3. The others get a SimHash fingerprint of 64 bits.  Fingerprints are dealt into shards by blocks of
   bits, each shard searches a BK-tree, and what is linked within `simhash.RADIUS` bits is a
   *SimHash group*: the first candidates (`simhash.links`, as in op5).
4. Similar texts may differ in more bits, so nodes that share one of their first shingles are
   candidates too, but only where they are of several SimHash groups: no link is lost.
5. A *shard* is a SimHash group, or the nodes that share such a shingle.  Shards of the same nodes are
   one.  A shard of more than `chunk` nodes is cut into chunks.  All comparisons are exact, on the
   sets; a shard gives a tree of links, not its pairs.  Each node first goes to the nearest leaders
   of a BK-tree of wide fingerprints (512 bits, to order the comparisons only).  Then all pairs that
   are still in different groups and not ruled out by their sizes or by the place of the shared
   shingle are compared.
6. Shards with several chunks go on with one node of each group found until it fits one chunk, then
   the nodes outside the largest group meet all others, chunk by chunk.
7. Links are joined by connected components.  The row with the smallest (doc_id, hash of its text)
   of a group stays, one row where it is repeated.

Defined cases: texts without words (null, empty, white space) are one group; fewer words than a
shingle give one shingle of all words; a null doc_id comes after all others, and such rows go or stay like
others; rows that share an id but not a text are judged apart; repeated rows are one group, and one of
them stays; very long texts are compared whole; an empty table gives an empty result; other columns are
carried along, whatever their names.  Texts are named by 64-bit hashes of their words, shingles by
64-bit hashes.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from quarry.llm.components import connected_components
from quarry.llm.parts import FLAGS, NO_ID, U64, answers, chunks, group_starts, grouped, mix, pack, paired, part_count, rolled, unpack
from quarry.llm.simhash import BKTree, bit_counts, links
from quarry.session import checkpointed

SHINGLE, SIMILARITY, CHUNK = 5, 0.8, 4096
#: Bytes of a fingerprint; sets of similarity 0.8 differ in 77 of 512 bits on average (deviation 9).
WIDE_BYTES, RADIUS = 64, 110
#: A node further than this from all leaders leads too; leaders that a node is compared with.
LEADER_RADIUS, TRIES = 70, 4
#: Shards of up to so many nodes go to the bin of their least node, so that a set is sent there once.
SMALL = 64


def words_of(texts: list[bytes]) -> list[list[bytes]]:
    return [t.lower().split() for t in texts]


def node_names(texts: list[bytes]) -> list[int]:
    """The hash of the words of each text, as a signed number."""
    names = np.array([xxh3_64_intdigest(b" ".join(w)) for w in words_of(texts)], U64)
    return names.view(np.int64).tolist()


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    out = []
    for lo, hi in chunks(texts):
        words = words_of(texts[lo:hi])
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), U64, int(sizes.sum()))
        whole = rolled(flat, shingle, 1)
        for first, n in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
            out.append(np.unique(whole[first : first + n - shingle + 1] if n >= shingle else rolled(flat[first : first + n], n, 1) if n else flat[:0]))
    return out


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles, signed: a bit is set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        counts += bit_counts(np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def wide_fingerprint(hashes: np.ndarray) -> int:
    """512 bits of a set of shingles: eight fingerprints of hashes mixed from the first."""
    counts = np.zeros(8 * WIDE_BYTES, np.int64)
    for lo in range(0, len(hashes), 8192):
        h = hashes[lo : lo + 8192]
        mixed = np.stack([mix(h + U64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(WIDE_BYTES // 8)], axis=1)
        counts += bit_counts(np.unpackbits(mixed.view(np.uint8), axis=1))
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


# --- nodes, the order of shingles, and shards ---------------------------------------------------


def _named(docs: DataFrame) -> DataFrame:
    """(id, text_hash, node) of every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node_names(batch.column(2).to_pylist()), pa.int64())], ["id", "text_hash", "node"])

    return _keyed(docs).select("id", "text_hash", "body").mapInArrow(run, "id long, text_hash long, node long")


def _keyed(docs: DataFrame) -> DataFrame:
    body = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("body"))


def _dealt_texts(docs: DataFrame, parts: int) -> DataFrame:
    """(part, node, body): the texts of all nodes, each once an input split."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            bodies = batch.column(0).to_pylist()
            names = node_names(bodies)
            new = [k for k, n in enumerate(names) if not (n in seen or seen.add(n))]
            names = np.array([names[k] for k in new], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names % parts, pa.int32()), pa.array(names), pa.array([bodies[k] for k in new], pa.binary())], ["part", "node", "body"])

    return _keyed(docs).select("body").mapInArrow(run, "part int, node long, body binary").repartition(parts, "part")


class Part:
    """The nodes of one part with their sets, and the distinct 32-bit fingerprints of all their shingles by bucket."""

    def __init__(self, table: pa.Table, buckets: int, shingle: int):
        texts = dict(zip(table.column("node").to_pylist(), table.column("body").to_pylist()))
        self.nodes, self.sets = list(texts), shingle_sets(list(texts.values()), shingle)
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.flat = np.concatenate([np.zeros(0, U64), *self.sets])
        keys = ((self.flat % U64(buckets)) << U64(32)) | (self.flat >> U64(32))
        self.unique, self.index, self.counts = np.unique(keys, return_inverse=True, return_counts=True)

    def buckets(self):
        """(bucket, from, to) in `unique`."""
        of = (self.unique >> U64(32)).astype(np.int64)
        at = group_starts(of)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(of)]):
            yield int(of[a]), a, b


def _send(table: pa.Table, buckets: int, shingle: int) -> pa.Table:
    p, part = Part(table, buckets, shingle), table.column("part")[0].as_py()
    rows = [(k, part, pack(np.diff(p.unique[a:b].astype(np.uint32), prepend=np.uint32(0))), pack(p.counts[a:b].astype(np.int32))) for k, a, b in p.buckets()]
    cols = list(zip(*rows)) or [[]] * 4
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "part": pa.array(cols[1], pa.int32()), "prints": pa.array(cols[2], pa.binary()), "counts": pa.array(cols[3], pa.binary())})


def _ranks(table: pa.Table) -> pa.Table:
    """Adds the counts of all parts in one bucket and answers each part with 8 * log2 of them."""
    parts, bucket = table.column("part").to_pylist(), table.column("bucket")[0].as_py()
    prints = [np.cumsum(unpack(x, np.uint32), dtype=np.uint32) for x in table.column("prints").to_pylist()]
    counts = np.concatenate([unpack(x, np.int32) for x in table.column("counts").to_pylist()])
    unique, at = np.unique(np.concatenate(prints), return_inverse=True)
    total = np.bincount(at, counts, len(unique))
    rank = np.minimum(8 * np.log2(total), 255).astype(np.uint8)[at]
    ends = np.cumsum([len(x) for x in prints])
    out = [pack(rank[e - len(x) : e]) for e, x in zip(ends, prints)]
    return pa.table({"part": pa.array(parts, pa.int32()), "kind": pa.array([0] * len(parts), pa.int32()), "bucket": pa.array([bucket] * len(parts), pa.int32()), "body": pa.array(out, pa.binary())})


NODES = "node long, size long, print long, hashes binary, keys array<struct<key: long, rank: int, place: int>>"


def _keys(table: pa.Table, found: pa.Table, buckets: int, shingle: int, similarity: float) -> pa.Table:
    """NODES of one part: those that share one of their first shingles with another node (by all counts)."""
    out = []
    if len(table):
        p, got = Part(table, buckets, shingle), answers(found, 0)
        rank = np.zeros(len(p.unique), np.uint8)
        for k, a, b in p.buckets():
            rank[a:b] = unpack(got[k], np.uint8)
        rank = rank[p.index]
        order = np.lexsort(((rank.astype(U64) << U64(56)) | (p.flat >> U64(8)), np.repeat(np.arange(len(p.sets)), p.sizes)))
        first = np.cumsum(p.sizes) - p.sizes
        for node, s, a, n in zip(p.nodes, p.sets, first.tolist(), p.sizes.tolist()):
            used = order[a : a + min(n, n - int(np.ceil(similarity * n - 1e-9)) + 1)]
            places = np.flatnonzero(rank[used] > 0)
            if len(places):
                used = used[places]
                out.append((node, n, set_fingerprint(s), s.tobytes(), p.flat[used].view(np.int64), rank[used], places))
    nodes, sizes, prints, hashes, keys, ranks, places = zip(*out) if out else ((),) * 7
    join = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
    keys_ = pa.StructArray.from_arrays([join(keys, np.int64), join(ranks, np.int32), join(places, np.int32)], ["key", "rank", "place"])
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
    return pa.table({"node": pa.array(nodes, pa.int64()), "size": pa.array(sizes, pa.int64()), "print": pa.array(prints, pa.int64()), "hashes": pa.array(hashes, pa.binary()), "keys": pa.ListArray.from_arrays(offsets, keys_)})


def simhash_groups(nodes: DataFrame) -> DataFrame:
    """(print, near): each fingerprint and the least of those linked with it within the radius, by BK-trees in shards."""
    prints = checkpointed(nodes.select("print").distinct())
    found = connected_components(links(prints)).withColumnRenamed("node", "print")
    return prints.join(found, "print", "left").select("print", F.coalesce("component", "print").alias("near"))


def _shards(nodes: DataFrame) -> DataFrame:
    """(shard, n, low, node, size, central, place): n nodes of one SimHash group or with one key, `low` the least.

    A key inside one SimHash group adds nothing to it; keys of the same nodes are one shard, the first in order.
    The same nodes: as many, with the same sums (bitwise) of two hashes.
    """
    central = F.size("keys") / F.col("size")
    near = nodes.select("node", "size", "print", central.alias("central"), "keys").join(simhash_groups(nodes), "print").drop("print")
    whole = F.struct(F.xxhash64(F.lit("near"), "near").alias("key"), F.lit(-1).alias("rank"), F.lit(0).alias("place"))
    keys = near.select("node", "size", "near", "central", F.explode(F.concat(F.array(whole), "keys")).alias("key")).select("node", "size", "near", "central", "key.*")
    same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "node")).alias("y")]
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), *same, F.min("rank").alias("rank"), (F.min("near") != F.max("near")).alias("across"))
    shared = shared.where("n > 1 and (rank < 0 or across)")
    one = shared.groupBy("n", "low", "x", "y").agg(F.min(F.struct("rank", "key")).alias("one")).select("n", "low", F.col("one.key").alias("key"))
    return keys.drop("rank", "near").join(one, "key").withColumnRenamed("key", "shard")


# --- links inside a shard ----------------------------------------------------------------------


class Groups:
    """Nodes with their sets and the groups found so far."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray], similarity: float):
        self.nodes, self.sets, self.similarity = np.array(nodes, np.int64), sets, similarity
        self.sizes, self.group = np.array([len(s) for s in sets], np.int64), np.arange(len(sets))
        self.prints: dict[int, int] = {}

    def print(self, a: int) -> int:
        if a not in self.prints:
            self.prints[a] = wide_fingerprint(self.sets[a])
        return self.prints[a]

    def alike(self, a: int, others: np.ndarray) -> np.ndarray:
        """Which of the others (sets that are not empty) are similar to a."""
        out, s = [], self.sets[a]
        ends = np.cumsum(self.sizes[others])
        cuts = [0, *(np.flatnonzero(np.diff(ends >> 20)) + 1).tolist(), len(others)]  # about a million hashes at once
        for lo, hi in zip(cuts, cuts[1:]):
            of = others[lo:hi]
            if len(of):
                sizes = self.sizes[of]
                every = np.concatenate([self.sets[k] for k in of.tolist()])
                hit = s[np.minimum(np.searchsorted(s, every), len(s) - 1)] == every
                common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                out.append(common >= self.similarity * (len(s) + sizes - common) - 1e-9)
        return np.concatenate([np.zeros(0, bool), *out])

    def link(self, a: int, others: np.ndarray) -> None:
        for g in np.unique(self.group[others]).tolist():
            if g != self.group[a]:
                self.group[self.group == max(g, self.group[a])] = min(g, self.group[a])

    def lead(self, members: list[int]) -> None:
        """Links each member with one of its nearest leaders, if it is similar to it."""
        tree, leaders = BKTree(), []
        for a in members:
            value = self.print(a)
            near = sorted(((tree.values[t] ^ value).bit_count(), t) for t in tree.within(value, RADIUS))
            for _, t in near[:TRIES]:
                other = np.array([leaders[t]])
                if self.group[a] == self.group[leaders[t]] or self.alike(a, other)[0]:
                    self.link(a, other)
                    break
            if not near or near[0][0] > LEADER_RADIUS:
                tree.add(value)
                leaders.append(a)

    def settle(self, members: np.ndarray, places: np.ndarray, asks: np.ndarray | None = None) -> None:
        """Compares all members in different groups (if `asks` is given, those that ask with all) that may be similar."""
        order = np.lexsort((self.nodes[members], self.sizes[members]))
        members, places = members[order], places[order]
        asks = None if asks is None else asks[order]
        sizes, t = self.sizes[members], self.similarity
        rest = sizes - places  # shingles from the shared one on
        least = np.searchsorted(sizes, np.ceil(t * sizes - 1e-9))
        for i in range(1, len(members)):
            lo, a = int(least[i]), int(members[i])
            may = np.minimum(rest[i], rest[lo:i]) >= t / (1 + t) * (sizes[i] + sizes[lo:i]) - 1e-9
            may &= self.group[members[lo:i]] != self.group[a]
            if asks is not None and not asks[i]:
                may &= asks[lo:i]
            others = members[lo:i][may]
            if len(others):
                self.link(a, others[self.alike(a, others)])


def _linked(rows: pa.Table, sets: pa.Table, similarity: float) -> pa.Table:
    """(src, dst): a star for each group found in one bin of (shard, i, j, asks, node, central, place); asks is -1 where all may ask all."""
    src = dst = np.zeros(0, np.int64)
    if len(rows) and len(sets):
        names = sets.column("name").to_pylist()
        g = Groups(names, [np.frombuffer(x, U64) for x in sets.column("hashes").to_pylist()], similarity)
        index = np.argsort(g.nodes)
        shard, i, j, asks, central, place = (rows.column(c).to_numpy() for c in ("shard", "i", "j", "asks", "central", "place"))
        node = index[np.searchsorted(g.nodes[index], rows.column("node").to_numpy())]
        order = np.lexsort((g.nodes[node], -central, j, i, shard))
        at = group_starts(shard[order], i[order], j[order])
        units = [order[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)])]
        for u in sorted(units, key=len):
            if len(u) > 1:
                free = asks[u[0]] < 0
                if free:
                    g.lead(node[u].tolist())
                g.settle(node[u], place[u], None if free else asks[u] > 0)
        away = np.flatnonzero(g.group != np.arange(len(g.group)))  # a group is named by its first node
        src, dst = g.nodes[g.group[away]], g.nodes[away]
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def _links(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Links among (bin, shard, i, j, asks, node, central, place); a bin gets each set it needs once."""
    rows = rows.select("bin", "shard", "i", "j", "asks", "node", "central", "place")
    needs = rows.select(F.col("bin").alias("at"), F.col("node").alias("name")).distinct().join(nodes.select(F.col("node").alias("name"), "hashes"), "name")
    return rows.groupBy("bin").cogroup(needs.groupBy("at")).applyInArrow(paired(_linked, similarity=similarity), "src long, dst long")


def _in_chunks(shards: DataFrame, chunk: int, bins: int) -> DataFrame:
    """The rows of _links for shards dealt into chunks, each chunk by itself."""
    chunked = F.ceil(F.col("n") / chunk)
    rows = shards.withColumn("i", F.pmod(F.xxhash64("shard", "node"), chunked).cast("int"))
    at = F.when(F.col("n") <= SMALL, F.xxhash64("low")).otherwise(F.xxhash64("shard", "i"))
    return rows.select(F.pmod(at, F.lit(bins)).cast("int").alias("bin"), "shard", "i", F.lit(0).alias("j"), F.lit(-1).alias("asks"), "node", "central", "place")


def _crowded(shards: DataFrame, groups: DataFrame, chunk: int) -> DataFrame:
    """The rows of shards with several chunks, with their groups."""
    return shards.where(F.col("n") > chunk).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _outsiders(named: DataFrame, chunk: int, bins: int) -> DataFrame:
    """The rows of _links in which all nodes outside a shard's largest group meet all its other nodes."""
    sizes = named.groupBy("shard", "component").agg(F.count(F.lit(1)).alias("size_of"))
    sizes = sizes.groupBy("shard").agg(F.sum("size_of").alias("all"), F.max("size_of").alias("most"), F.max_by("component", F.struct("size_of", "component")).alias("main"))
    sizes = sizes.where("most < all").select("shard", "main", F.ceil(F.col("all") / chunk).cast("int").alias("trees"), F.ceil((F.col("all") - F.col("most")) / chunk).cast("int").alias("askers"))
    dealt = named.join(sizes, "shard").withColumn("mix", F.xxhash64("shard", "node"))
    own_i, own_j = F.pmod("mix", "trees").cast("int"), F.pmod("mix", "askers").cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rest = ["node", "central", "place"]
    # A node that asks and is asked in the same unit comes once, asking.
    asked = dealt.select("shard", own_i.alias("i"), every("askers").alias("j"), F.when((F.col("component") != F.col("main")) & (own_j == F.col("j")), 1).otherwise(0).alias("asks"), *rest)
    asking = dealt.where("component != main").select("shard", every("trees").alias("i"), own_j.alias("j"), F.lit(1).alias("asks"), *rest, own_i.alias("own")).where("i != own").drop("own")
    return asked.unionByName(asking).withColumn("bin", F.pmod(F.xxhash64("shard", "i", "j"), F.lit(bins)).cast("int"))


def _components(edges: DataFrame) -> DataFrame:
    return checkpointed(connected_components(edges))


def candidates(docs: DataFrame, parts: int, shingle: int, similarity: float) -> DataFrame:
    """NODES that share one of their first shingles with another."""
    texts = _dealt_texts(docs, parts)
    sent = texts.groupBy("part").applyInArrow(grouped(_send, buckets=parts, shingle=shingle), "bucket int, part int, prints binary, counts binary")
    ranks = sent.groupBy("bucket").applyInArrow(_ranks, FLAGS)
    return checkpointed(texts.groupBy("part").cogroup(ranks.groupBy("part")).applyInArrow(paired(_keys, buckets=parts, shingle=shingle, similarity=similarity), NODES))


def grouped_nodes(docs: DataFrame, shingle: int, similarity: float, chunk: int) -> DataFrame:
    """(node, component) of all nodes that have a link."""
    parts = part_count(docs)
    nodes = candidates(docs, parts, shingle, similarity)
    shards = checkpointed(_shards(nodes))
    edges = checkpointed(_links(_in_chunks(shards, chunk, parts), nodes, similarity))
    groups = _components(edges)
    if shards.where(F.col("n") > chunk).isEmpty():
        return groups
    while True:
        one = _crowded(shards, groups, chunk).groupBy("shard", "component").agg(F.max_by(F.struct("node", "size", "central", "place"), F.struct("central", -F.col("node"))).alias("one"))
        counted = one.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("one.node").alias("low")).where("n > 1")
        ones = checkpointed(one.select("shard", "one.*").join(counted, "shard"))
        found = checkpointed(_links(_in_chunks(ones, chunk, parts), nodes, similarity))
        if found.isEmpty():
            break
        edges = edges.unionByName(found)
        groups = _components(edges)
        if ones.where(F.col("n") > chunk).isEmpty():
            break
    last = _links(_outsiders(_crowded(shards, groups, chunk), chunk, parts), nodes, similarity)
    return _components(edges.unionByName(last))


def _grouped_rows(docs: DataFrame, shingle: int, similarity: float, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, node) of all rows; (node, component, id, text_hash) with the row of each group that stays."""
    rows = checkpointed(_named(docs))
    groups = grouped_nodes(docs, shingle, similarity, chunk)
    first = rows.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("one"))
    nodes = first.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    stays = nodes.groupBy("component").agg(F.min("one").alias("stays"))
    return rows, nodes.select("node", "component").join(stays, "component").select("node", "component", "stays.*")


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id of the group, null if all are null."""
    rows, nodes = _grouped_rows(docs, shingle, similarity, chunk)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    least = nodes.select("node", known("id").alias("component_id"))
    return rows.join(least, "node").select(known("id").alias("doc_id"), "component_id")


def keep_one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """The row of each group that comes first by (doc_id, hash of its text)."""
    rows, nodes = _grouped_rows(docs, shingle, similarity, chunk)
    times = rows.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    stays = checkpointed(nodes.select("id", "text_hash").distinct().join(times, ["id", "text_hash"]))
    body = F.coalesce("text", F.lit("")).cast("binary")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(body).alias("text_hash"))
    kept = whole.join(stays, ["id", "text_hash"])
    if not stays.where("times > 1").isEmpty():
        kept = kept.where("times = 1").unionByName(kept.where("times > 1").dropDuplicates(["id", "text_hash"]))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
