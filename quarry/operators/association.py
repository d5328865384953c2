"""Frequent itemsets and association rules over (txn_id, items) baskets."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F


def item_frequency(baskets: DataFrame) -> DataFrame:
    return baskets.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("freq"))


def item_order(baskets: DataFrame, min_support: int) -> DataFrame:
    """Frequent items by falling count, equal ones by item (the header table; one row an item)."""
    from pyspark.sql import Window

    kept = item_frequency(baskets).where(F.col("freq") >= min_support)
    return kept.withColumn("position", F.row_number().over(Window.orderBy(F.desc("freq"), "item")) - 1)


def support_count(minimum: float, transactions: int) -> int:
    """A count stays; a fraction below 1 becomes ceil(fraction * transactions)."""
    if minimum <= 0:
        raise ValueError(f"Invalid minimum support: {minimum}")
    return math.ceil(round(minimum * transactions, 9)) if minimum < 1 else int(minimum)


def power_set(items: Column) -> Column:
    """All subsets, the empty one first; items of any type."""
    start = F.array(F.slice(items, 1, 0))
    return F.aggregate(items, start, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))


def prepared(baskets: DataFrame, min_support: int) -> DataFrame:
    """(items, n): infrequent items out, sorted, equal baskets counted once: what the miners share."""
    frequent = item_frequency(baskets).where(F.col("freq") >= min_support).select("item")
    long = baskets.select("txn_id", F.explode(F.array_distinct("items")).alias("item"))
    kept = long.join(frequent, "item", "left_semi").groupBy("txn_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return kept.groupBy("items").agg(F.count(F.lit(1)).alias("n"))


def frequent_itemsets(baskets: DataFrame, min_support: int, longest: int | None = None) -> DataFrame:
    """(items, support): sorted itemsets in at least min_support baskets.

    Baskets of `longest` items at most are enumerated, which is one aggregate; if one keeps more frequent
    items, or without that bound, the distributed FP-growth is used.
    """
    if longest is not None and (kept := prepared(baskets, min_support)).where(F.size("items") > longest).isEmpty():
        subsets = kept.select(F.explode(power_set(F.col("items"))).alias("items"), "n").where(F.size("items") > 0)
        return subsets.groupBy("items").agg(F.sum("n").alias("support")).where(F.col("support") >= min_support)
    total = baskets.count()
    if total < min_support:
        return baskets.limit(0).select("items", F.lit(0).cast("long").alias("support"))
    # Half a basket less, so that rounding of the fraction cannot raise the count.
    model = FPGrowth(itemsCol="items", minSupport=(min_support - 0.5) / total, minConfidence=0.9).fit(baskets.select(F.array_distinct("items").alias("items")))
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))


def support_lookup(itemsets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(items, support) for the wanted itemsets, 0 where there is none."""
    keyed = wanted.withColumn("items", F.array_sort("items"))
    return keyed.join(itemsets, "items", "left").withColumn("support", F.coalesce("support", F.lit(0).cast("long")))


def association_rules(itemsets: DataFrame, transactions: int, confidence: float) -> DataFrame:
    """antecedent, consequent, support (of all transactions), confidence: every split of every itemset into two parts."""
    whole = itemsets.where(F.size("items") > 1)
    split = whole.select("items", "support", F.explode(power_set(F.col("items"))).alias("antecedent"))
    split = split.where((F.size("antecedent") > 0) & (F.size("antecedent") < F.size("items")))
    parts = itemsets.select(F.col("items").alias("antecedent"), F.col("support").alias("below"))
    ruled = split.join(parts, "antecedent").withColumn("confidence", F.col("support") / F.col("below"))
    return ruled.where(F.col("confidence") >= confidence).select("antecedent", F.array_except("items", "antecedent").alias("consequent"), (F.col("support") / transactions).alias("support"), "confidence")


class Miner:
    """Baskets that may grow; every result is computed from all of them."""

    def __init__(self, baskets: DataFrame, minimum: float, longest: int | None = None):
        self.baskets, self.minimum, self.longest = baskets, minimum, longest

    def add(self, more: DataFrame) -> "Miner":
        return Miner(self.baskets.unionByName(more), self.minimum, self.longest)

    def size(self) -> int:
        return self.baskets.count()

    def itemsets(self) -> DataFrame:
        return frequent_itemsets(self.baskets, support_count(self.minimum, self.size()), self.longest)

    def learn(self) -> int:
        return self.itemsets().count()

    def support(self, wanted: DataFrame) -> DataFrame:
        return support_lookup(self.itemsets(), wanted)

    def rules(self, confidence: float) -> DataFrame:
        return association_rules(self.itemsets(), self.size(), confidence)
