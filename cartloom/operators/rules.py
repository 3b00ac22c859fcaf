"""Association rules from frequent itemsets: all splits of small itemsets, growing consequents for large ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.sources.shared import observed

#: Itemsets up to this size are split in all ways at once; larger ones grow their consequents. Both give the same rules.
SPLIT_ITEMS = 10


def _splits(itemsets: DataFrame) -> DataFrame:
    """itemset, antecedent, consequent, support: every subset but the empty one and the whole is an antecedent."""
    pick = lambda m, bit: F.filter("itemset", lambda _, j: F.getbit(m, j) == bit)
    each = itemsets.select("support", "itemset", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, k) - 2"))).alias("m"))
    return each.select(pick(F.col("m"), 1).alias("antecedent"), pick(F.col("m"), 0).alias("consequent"), "support")


def grown_consequents(itemsets: DataFrame, known: DataFrame, min_confidence: float) -> DataFrame:
    """antecedent, consequent and support of the splits of itemsets (k, itemset, support) that reach min_confidence.

    Moving an item from the antecedent to the consequent can't raise the confidence, so a consequent of m
    items is tried only if all of its subsets of m - 1 items have passed: two that agree in all but their last item are joined, and
    the others are looked up. known (itemset, support) has the antecedents' supports; a split whose antecedent isn't there is no rule.
    """
    supports = known.select(F.col("itemset").alias("antecedent"), F.col("support").alias("_base"))
    one = itemsets.select("itemset", "support", F.explode(F.transform("itemset", lambda x: F.array(x))).alias("consequent"))
    levels, m = [], 1
    while True:
        tried = one.withColumn("antecedent", F.array_except("itemset", "consequent")).join(supports, "antecedent")
        passed = tried.filter(F.col("support") / F.col("_base") >= min_confidence).select("itemset", "antecedent", "consequent", "support", F.size("itemset").alias("k"))
        level, seen = observed(passed, "rule-consequents", {"n": F.count(F.lit(1)), "most": F.max("k")})
        levels.append(level)
        m += 1
        if not seen["n"] or seen["most"] <= m:
            break
        wide = level.filter(F.col("k") > m)
        head = F.slice("consequent", F.lit(1), F.lit(m - 2)) if m > 2 else F.array().cast(level.schema["consequent"].dataType)
        a = wide.select("itemset", "support", head.alias("head"), F.col("consequent").alias("a"))
        b = wide.select(F.col("itemset").alias("of"), head.alias("with"), F.element_at("consequent", -1).alias("y"))
        joined = a.join(b, (F.col("itemset") == F.col("of")) & (F.col("head") == F.col("with")) & (F.element_at("a", -1) < F.col("y")))
        grown = joined.select("itemset", "support", F.concat("a", F.array("y")).alias("consequent"))
        if m > 2:
            subsets = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.filter("consequent", lambda _, j: j != i))
            each = grown.select("itemset", "support", F.col("consequent").alias("whole"), F.explode(subsets).alias("consequent"))
            found = each.join(wide.select("itemset", "consequent"), ["itemset", "consequent"], "left_semi")
            grown = found.groupBy("itemset", "support", "whole").agg(F.count("*").alias("n")).filter(F.col("n") == m).select("itemset", "support", F.col("whole").alias("consequent"))
        one = grown
    return reduce(DataFrame.unionByName, levels).select("antecedent", "consequent", "support")


def association_rules(itemsets: DataFrame, metric: str = "lift", least: float = 1.0, min_confidence: float = 0.0) -> DataFrame:
    """antecedent, consequent, their supports, support, confidence and lift, for itemsets (k, itemset, support).

    Rules have metric at least least and confidence at least min_confidence, with consequents of any size. Supports of both
    sides are looked up by equi-joins on the sorted arrays; a split with a side that isn't among itemsets is no rule. An
    itemset of k items has 2**k - 2 splits: for large ones set min_confidence (or metric "confidence"), which cuts off what can't reach it.
    """
    if metric not in ("lift", "confidence", "support"):
        raise ValueError(f"unknown metric {metric}")
    floor = max(min_confidence, least) if metric == "confidence" else min_confidence
    sides = _splits(itemsets.filter(F.col("k").between(2, SPLIT_ITEMS)))
    large = itemsets.filter(F.col("k") > SPLIT_ITEMS).select("k", "itemset", "support")
    if not large.isEmpty():
        sides = sides.unionByName(grown_consequents(large, itemsets.select("itemset", "support"), floor))
    of = lambda side: itemsets.select(F.col("itemset").alias(side), F.col("support").alias(f"{side}_support"))
    found = sides.join(of("antecedent"), "antecedent").join(of("consequent"), "consequent")
    confidence = F.col("support") / F.col("antecedent_support")
    rules = found.select(
        "antecedent", "consequent", "antecedent_support", "consequent_support", "support", confidence.alias("confidence"), (confidence / F.col("consequent_support")).alias("lift")
    )
    return rules.filter((F.col(metric) >= least) & (F.col("confidence") >= floor))


def sorted_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("lift"), F.desc("support"), "antecedent", "consequent")


def top_rules(rules: DataFrame, n: int = 5) -> DataFrame:
    return rules.orderBy(F.desc(F.round("lift", 9)), F.desc(F.round("support", 9)), "antecedent", "consequent").limit(n)
