"""Decision trees by split queries, forests by bootstrap samples; models are small lists of nodes."""

from __future__ import annotations

import heapq
import math
import random
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators.statistics import check_labels


def numeric_splits(rows: DataFrame, features: list[str], classes: int, rule: str = "GINI", group: str | None = None, node_size: int = 1, only: dict[int, list[int]] | None = None) -> DataFrame:
    """(group, feature, threshold, gain, t, f): every boundary of every feature.

    Values are grouped first, so the windows run over distinct values: running class counts, the next
    value for the midpoint, and the gain of impurity.  Quantiles cut each feature into as many ranges as
    there are shuffle partitions, each a window of its own.  `f` and `t` are class counts of both sides.
    The quantiles are fixed before (on the driver, groups x features x partitions): they depend on the
    order in which tasks are merged, and a range must be the same wherever the plan refers to it.
    With `only` each group is split by its features named there (by position), others not at all.
    """
    g = F.col(group) if group else F.lit(0)
    long = rows.select(g.alias("group"), F.col("label").alias("label"), F.col("weight").alias("weight") if "weight" in rows.columns else F.lit(1).alias("weight"), F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("feature", "value"))
    if only is not None:
        long = long.where(reduce(or_, [(F.col("group") == n) & F.col("feature").isin(d) for n, d in only.items()]))
    counts = [F.sum(F.when(F.col("label") == k, F.col("weight")).otherwise(0)).alias(f"c{k}") for k in range(classes)]
    by_value = long.groupBy("group", "feature", "value").agg(*counts)
    # Each feature's values are dealt into ranges; a range adds up its own counts after those before it.
    bins = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = by_value.groupBy("group", "feature").agg(F.percentile_approx("value", F.array(*[F.lit(k / bins) for k in range(1, bins)]), 20 * bins).alias("edges"))
    edges = rows.sparkSession.createDataFrame(edges.collect(), edges.schema)
    dealt = by_value.join(F.broadcast(edges), ["group", "feature"]).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
    names = [f"c{k}" for k in range(classes)]
    ranges = dealt.groupBy("group", "feature", "bin").agg(*[F.sum(c).alias(c) for c in names], F.min("value").alias("low"))
    ordered = Window.partitionBy("group", "feature").orderBy("bin")
    whole = Window.partitionBy("group", "feature")
    before = [F.coalesce(F.sum(c).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"b{k}") for k, c in enumerate(names)]
    ranges = ranges.select("group", "feature", "bin", *before, *[F.sum(c).over(whole).alias(f"a{k}") for k, c in enumerate(names)], F.lead("low").over(ordered).alias("low_after"))
    upto = Window.partitionBy("group", "feature", "bin").orderBy("value")
    running = [F.sum(c).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias(f"w{k}") for k, c in enumerate(names)]
    cut = dealt.select("group", "feature", "bin", "value", F.lead("value").over(upto).alias("after"), *running).join(ranges, ["group", "feature", "bin"])
    following = F.coalesce("after", "low_after")
    sides = [(F.col(f"w{k}") + F.col(f"b{k}")).alias(f"t{k}") for k in range(classes)]
    cut = cut.where(following.isNotNull()).select("group", "feature", ((F.col("value") + following) / 2).alias("threshold"), *sides, *[f"a{k}" for k in range(classes)])
    return _gains(cut, classes, rule, node_size)


def nominal_splits(rows: DataFrame, features: list[str], classes: int, rule: str = "GINI", group: str | None = None, node_size: int = 1) -> DataFrame:
    """The same for one value against all others; threshold is the value's code."""
    g = F.col(group) if group else F.lit(0)
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1)
    long = rows.select(g.alias("group"), F.col("label").alias("label"), weight.alias("weight"), F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("feature", "value"))
    counts = [F.sum(F.when(F.col("label") == k, F.col("weight")).otherwise(0)).alias(f"c{k}") for k in range(classes)]
    by_value = long.groupBy("group", "feature", "value").agg(*counts)
    whole = Window.partitionBy("group", "feature")
    sides = [F.col(f"c{k}").alias(f"t{k}") for k in range(classes)]
    cut = by_value.select("group", "feature", F.col("value").alias("threshold"), *sides, *[F.sum(f"c{k}").over(whole).alias(f"a{k}") for k in range(classes)])
    return _gains(cut, classes, rule, node_size)


def _impurity(counts: list[Column], n: Column, rule: str) -> Column:
    """The impurity of class counts in plain arithmetic, which compiles; null if there are none."""
    shares = [c / F.nullif(n, F.lit(0.0)) for c in counts]
    if rule == "GINI":
        return 1 - sum(s * s for s in shares)
    if rule == "ENTROPY":
        return -sum(F.when(s > 0, s * F.log2(s)).otherwise(0.0) for s in shares)
    if rule == "CLASSIFICATION_ERROR":
        return F.abs(1 - (F.greatest(*shares) if len(shares) > 1 else shares[0]))
    raise ValueError(f"Invalid split rule: {rule}")


def _gains(cut: DataFrame, classes: int, rule: str, node_size: int) -> DataFrame:
    """Counts of one side (t0, t1, ...) and of all (a0, a1, ...) as gains, both sides as arrays."""
    double = lambda c: F.col(c).cast("double")
    t, f = [f"t{k}" for k in range(classes)], [F.col(f"a{k}") - F.col(f"t{k}") for k in range(classes)]
    sized = cut.withColumn("n", sum(double(f"a{k}") for k in range(classes))).withColumn("nt", sum(map(double, t)))
    kept = sized.where((F.col("nt") >= node_size) & (F.col("n") - F.col("nt") >= node_size))
    n, nt = F.col("n"), F.col("nt")
    all_ = _impurity([double(f"a{k}") for k in range(classes)], n, rule)
    share = nt / F.nullif(n, F.lit(0.0))
    sides = share * _impurity(list(map(double, t)), nt, rule) + (1 - share) * _impurity([x.cast("double") for x in f], n - nt, rule)
    return kept.select("group", "feature", "threshold", (all_ - sides).alias("gain"), F.array(*t).alias("t"), F.array(*f).alias("f"))


def best_splits(splits: DataFrame) -> DataFrame:
    """The largest gain (9 digits) of each group; equal ones: first feature, smallest threshold."""
    best = F.max_by(F.struct("feature", "threshold", "gain", "t", "f"), F.struct(F.round("gain", 9), -F.col("feature"), -F.col("threshold")))
    return splits.where("round(gain, 9) > 0").groupBy("group").agg(best.alias("s")).select("group", "s.*")


@dataclass
class Node:
    node_id: int
    counts: list[float]
    feature: int | None = None
    threshold: float | None = None
    gain: float = 0.0
    children: tuple = field(default=())

    @property
    def output(self) -> int:
        return max(range(len(self.counts)), key=lambda k: (self.counts[k], -k))

    @property
    def posterior(self) -> list[float]:
        total = sum(self.counts) + len(self.counts)
        return [(c + 1) / total for c in self.counts]


@dataclass
class Tree:
    root: Node
    features: list[str]
    nominal: frozenset = frozenset()

    @staticmethod
    def fit(rows: DataFrame, features: list[str], label: str = "label", max_nodes: int = 100, rule: str = "GINI", node_size: int = 1, nominal: tuple = (), mtry: int | None = None, seed: int = 0) -> "Tree":
        """Best-first growth to max_nodes leaves.  One job evaluates all new leaves: the leaf of a row is an expression.

        With mtry every leaf may split by that many features only, drawn anew by (seed, leaf).
        """
        if max_nodes < 2:
            raise ValueError(f"Invalid maximum leaves: {max_nodes}")
        if node_size < 1:
            raise ValueError(f"Invalid minimum size of leaf nodes: {node_size}")
        if mtry is not None and not 0 < mtry <= len(features):
            raise ValueError(f"Invalid number of variables to split on at a node of the tree: {mtry}")
        classes = len(check_labels(rows, label))
        weight = ["weight"] if "weight" in rows.columns else []
        rows = rows.select(*features, *weight, F.col(label).alias("label")).persist()
        try:
            return Tree._grown(rows, features, classes, max_nodes, rule, node_size, nominal, mtry, seed)
        finally:
            rows.unpersist()

    @staticmethod
    def _grown(rows: DataFrame, features: list[str], classes: int, max_nodes: int, rule: str, node_size: int, nominal: tuple, mtry: int | None, seed: int) -> "Tree":
        counted = dict(rows.groupBy("label").agg(F.sum("weight") if "weight" in rows.columns else F.count(F.lit(1))).collect())
        tree = Tree(Node(0, [counted.get(k, 0) for k in range(classes)]), list(features), frozenset(nominal))
        queue: list = []
        leaves, made, fresh = 1, 1, [tree.root]
        numeric = [f for f in features if f not in tree.nominal]
        while leaves < max_nodes:
            if fresh:
                leaf = rows.withColumn("_leaf", tree.leaf()).where(F.col("_leaf").isin([n.node_id for n in fresh]))
                drawn = None if mtry is None else {n.node_id: random.Random(f"{seed}/{n.node_id}").sample(range(len(features)), mtry) for n in fresh}
                only = drawn and {n: [numeric.index(features[k]) for k in d if features[k] in numeric] for n, d in drawn.items()}
                found = numeric_splits(leaf, numeric, classes, rule, "_leaf", node_size, only) if numeric else None
                found = found and found.withColumn("feature", F.array(*[F.lit(features.index(f)) for f in numeric])[F.col("feature")])
                if tree.nominal:
                    names = [f for f in features if f in tree.nominal]
                    more = nominal_splits(leaf, names, classes, rule, "_leaf", node_size).withColumn("feature", F.array(*[F.lit(features.index(f)) for f in names])[F.col("feature")])
                    found = more if found is None else found.unionByName(more)
                nodes = {n.node_id: n for n in fresh}
                if drawn is not None:
                    found = found.where(reduce(or_, [(F.col("group") == n) & F.col("feature").isin(d) for n, d in drawn.items()]))
                for s in best_splits(found).collect():  # one row a leaf
                    heapq.heappush(queue, (-s["gain"], s["group"], nodes[s["group"]], s))
                fresh = []
            if not queue:
                break
            _, _, node, s = heapq.heappop(queue)
            node.feature, node.threshold, node.gain = s["feature"], s["threshold"], s["gain"]
            node.children = (Node(made, list(s["t"])), Node(made + 1, list(s["f"])))
            made, leaves, fresh = made + 2, leaves + 1, [c for c in node.children if sum(x > 0 for x in c.counts) > 1]
        return tree

    def _case(self, value, node: Node | None = None) -> Column:
        node = node or self.root
        if not node.children:
            return value(node)
        x = F.col(self.features[node.feature])
        goes = x == node.threshold if self.features[node.feature] in self.nominal else x <= node.threshold
        return F.when(goes, self._case(value, node.children[0])).otherwise(self._case(value, node.children[1]))

    def leaf(self) -> Column:
        return self._case(lambda n: F.lit(n.node_id))

    def predict(self) -> Column:
        return self._case(lambda n: F.lit(n.output))

    def posterior(self) -> Column:
        return self._case(lambda n: F.array(*map(F.lit, n.posterior)))

    def nodes(self) -> list[Node]:
        out, stack = [], [self.root]
        while stack:
            n = stack.pop()
            out.append(n)
            stack += n.children
        return sorted(out, key=lambda n: n.node_id)

    def importance(self) -> list[float]:
        out = [0.0] * len(self.features)
        for n in self.nodes():
            if n.children:
                out[n.feature] += n.gain
        return out


def stratified_subsample(rows: DataFrame, key: str, fraction: float, label: str = "label") -> DataFrame:
    """round(n * fraction) rows of each label, those of the least md5 of the key: the same on every engine."""
    quota = rows.groupBy(label).agg(F.round(F.count(F.lit(1)) * fraction).alias("_quota"))
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.join(F.broadcast(quota), label).withColumn("_r", F.row_number().over(order)).where("_r <= _quota").drop("_r", "_quota")


def bootstrap(rows: DataFrame, key: str, seed: int, rate: float | list[float] = 1.0, label: str = "label") -> DataFrame:
    """A weight a row: Poisson by a hash of the key and the seed, which is what draws with replacement tend to.

    Classes are drawn apart: `rate` is one number or one for each class, the draws a row (a class of
    weight w that is to be drawn n / w times has the rate 1 / w).
    """
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)

    def drawn(mean: float) -> Column:
        weight, p, total = F.lit(0), math.exp(-mean), math.exp(-mean)
        for k in range(1, 12 + int(4 * mean)):
            weight = weight + (u > total).cast("int")
            p *= mean / k
            total += p
        return weight

    if not isinstance(rate, (list, tuple)):
        return rows.withColumn("weight", drawn(rate))
    return rows.withColumn("weight", F.coalesce(*[F.when(F.col(label) == k, drawn(r)) for k, r in enumerate(rate)], F.lit(0)))


def votes(predictions: DataFrame, key: str) -> DataFrame:
    """(key, predicted) by unweighted majority of (key, tree, label), ties to the lowest label."""
    n = predictions.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("predicted"))


def out_of_bag(rows: DataFrame, sampled: DataFrame, key: str, predicted: str, label: str = "label") -> DataFrame:
    """(oob, correct, accuracy) over rows that were not drawn; 1.0 without any."""
    rest = rows.join(sampled.select(key), key, "left_anti")
    correct = F.coalesce(F.sum((F.col(predicted) == F.col(label)).cast("long")), F.lit(0).cast("long"))
    n = F.count(F.lit(1))
    return rest.agg(n.alias("oob"), correct.alias("correct"), F.when(n == 0, 1.0).otherwise(correct / F.nullif(n, F.lit(0))).alias("accuracy"))


@dataclass
class Forest:
    """Trees on bootstrap weights; `mllib` grows many level by level in one set of jobs."""

    trees: list[Tree]
    #: How each tree's sample is drawn, for out-of-bag rows.
    draw: tuple = ()

    @staticmethod
    def fit(rows: DataFrame, features: list[str], key: str, label: str = "label", trees: int = 10, max_nodes: int = 100, node_size: int = 5, rule: str = "GINI", seed: int = 0, class_weight: list[float] | None = None, mtry: int | None = None, nominal: tuple = ()) -> "Forest":
        """Every split looks at `mtry` features (the root of their number, rounded down); a class is drawn n / class_weight times a tree."""
        if trees < 1:
            raise ValueError(f"Invalid number of trees: {trees}")
        rate = 1.0 if class_weight is None else [1 / w for w in class_weight]
        mtry = mtry or max(1, int(len(features) ** 0.5))
        grown = []
        for t in range(trees):
            sample = bootstrap(rows, key, seed * 1_000_003 + t, rate, label).where("weight > 0")
            grown.append(Tree.fit(sample, features, label, max_nodes, rule, node_size, nominal, mtry, seed * 1_000_003 + t))
        return Forest(grown, (key, seed, rate, label))

    def out_of_bag(self, rows: DataFrame, classes: int) -> DataFrame:
        """(oob, correct, accuracy) of the majority of those trees whose sample a row was not in."""
        key, seed, rate, label = self.draw
        said = []
        for t, tree in enumerate(self.trees):
            rows = bootstrap(rows, key, seed * 1_000_003 + t, rate, label).withColumn(f"_t{t}", F.when(F.col("weight") == 0, tree.predict())).drop("weight")
            said.append(f"_t{t}")
        count = lambda k: sum((F.coalesce(F.col(c) == k, F.lit(False)).cast("int") for c in said), F.lit(0))
        best = -F.array_max(F.array(*[F.struct(count(k).alias("n"), F.lit(-k).alias("k")) for k in range(classes)]))["k"]
        judged = rows.withColumn("_said", F.when(F.coalesce(*said).isNotNull(), best)).where("_said IS NOT NULL")
        n, correct = F.count(F.lit(1)), F.coalesce(F.sum((F.col("_said") == F.col(label)).cast("long")), F.lit(0).cast("long"))
        return judged.agg(n.alias("oob"), correct.alias("correct"), F.when(n == 0, 1.0).otherwise(correct / F.nullif(n, F.lit(0))).alias("accuracy"))

    def predict(self, classes: int) -> Column:
        """The majority of the trees as one expression: no shuffle."""
        each = F.array(*[t.predict() for t in self.trees])
        count = lambda k: F.size(F.filter(each, lambda x: x == k))
        return -F.array_max(F.array(*[F.struct(count(k).alias("n"), F.lit(-k).alias("k")) for k in range(classes)]))["k"]

    @staticmethod
    def mllib(rows: DataFrame, features: str = "features", label: str = "label", trees: int = 100, seed: int = 0, node_size: int = 5):
        ready = rows.withColumn("_v", array_to_vector(features))
        return RandomForestClassifier(featuresCol="_v", labelCol=label, numTrees=trees, featureSubsetStrategy="sqrt", minInstancesPerNode=node_size, seed=seed).fit(ready)
