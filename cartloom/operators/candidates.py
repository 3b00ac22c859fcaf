"""Candidate itemsets from frequent ones: joins and the all-subsets prune. Itemsets are sorted arrays in column itemset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Items in a block of the pair join.
PAIR_BLOCK = 1000


def candidate_pairs(frequent1: DataFrame, found: int | None = None) -> DataFrame:
    """All pairs of frequent items (itemset of one), item < item: this is the operator itself, not a shortcut.

    Items are dealt to blocks, and blocks meet by an equi-join, so no side is broadcast and no task has more than a
    block of either side. found: the number of items, if known.
    """
    met = item_pairs(frequent1.select(F.get("itemset", F.lit(0)).alias("item")), frequent1.count() if found is None else found)
    return met.select(F.array("a.item", "b.item").alias("cand"))


def item_pairs(items: DataFrame, found: int) -> DataFrame:
    """a and b, structs of the rows of items (item, ...), for all pairs with a.item < b.item."""
    blocks = max(1, -(-found // PAIR_BLOCK))
    row, own = F.struct(*items.columns), F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("long")
    each = F.expr(f"explode(sequence(0L, {blocks - 1}L))")
    left = items.select(row.alias("a"), own.alias("_left"), each.alias("_right"))
    right = items.select(row.alias("b"), own.alias("_right"), each.alias("_left"))
    return left.join(right.hint("shuffle_hash"), ["_left", "_right"]).filter("a.item < b.item").select("a", "b")


def candidate_join(frequent: DataFrame, k: int, found: int | None = None) -> DataFrame:
    """Candidates of k items: two frequent itemsets that agree in all but their last item, by an equi-join on these."""
    if k == 2:
        return candidate_pairs(frequent, found)
    head = F.slice("itemset", 1, k - 2)
    a = frequent.select(head.alias("head"), "itemset", F.element_at("itemset", -1).alias("x"))
    b = frequent.select(head.alias("head"), F.element_at("itemset", -1).alias("y"))
    return a.join(b, (a["head"] == b["head"]) & (F.col("x") < F.col("y"))).select(F.concat("itemset", F.array("y")).alias("cand"))


def difference_join(frequent: DataFrame, k: int) -> DataFrame:
    """Candidates of k items, each once: unions of two frequent itemsets that differ in one item of each.

    Such itemsets share one of their subsets of k - 2 items, so these are the keys of an equi-join. It
    gives all that candidate_join does and others that the prune drops.
    """
    if k == 2:
        return candidate_pairs(frequent)
    keyed = lambda name: frequent.select(F.explode(subsets_without_one("itemset", k - 1)).alias("shared"), F.col("itemset").alias(name))
    return keyed("a").join(keyed("b"), "shared").filter("a < b").select(F.array_sort(F.array_union("a", "b")).alias("cand")).distinct()


def subsets_without_one(array: str, k: int):
    """The k subsets of k - 1 items, in order."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.filter(F.col(array), lambda _, j: j != i))


def prune(candidates: DataFrame, frequent: DataFrame, k: int) -> DataFrame:
    """Candidates of which every subset of k - 1 items is frequent, each once. Two subsets are known from the join."""
    if k <= 2:
        return candidates
    each = candidates.distinct().select("cand", F.explode(subsets_without_one("cand", k)).alias("itemset"))
    found = each.join(frequent.select("itemset"), "itemset", "left_semi")
    return found.groupBy("cand").agg(F.count("*").alias("n")).filter(F.col("n") == k).select("cand")


def next_candidates(frequent: DataFrame, k: int, found: int | None = None) -> DataFrame:
    return prune(candidate_join(frequent, k, found), frequent, k)


def lattice_size(n: int) -> int:
    return n * (n - 1) // 2
