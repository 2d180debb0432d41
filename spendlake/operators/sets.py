"""Set operations (SET1 to SET4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.core import ratio
from spendlake.operators.similar import mask, missing


def union_all(*frames: DataFrame) -> DataFrame:
    """SET1 and SET3: one report from several detectors or generators, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_outliers(outliers: DataFrame) -> DataFrame:
    """SET2: one row per user, category and amount: the newest receipt of that amount."""
    newest = F.max(F.struct("date", "receipt_id")).alias("_n")
    kept = outliers.groupBy("user_id", "category", "amount").agg(newest)
    return kept.select("user_id", "category", "amount", F.col("_n.receipt_id").alias("receipt_id"))


def tokens(text: Column) -> Column:
    """Distinct lower-case words."""
    words = F.split(F.trim(F.lower(text)), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def jaccard(left: Column, right: Column) -> Column:
    """SET4: shared tokens over all tokens; 0 when either side has none."""
    a, b = tokens(left), tokens(right)
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def similar_names(items: DataFrame, at_least: float = 0.5) -> DataFrame:
    """SET4: pairs of distinct names whose token sets overlap by ``at_least``.

    Prefix filtering: order every token set by (document frequency, token).
    Two sets with Jaccard ``s`` must share a token inside their first
    ``size - ceil(s * size) + 1`` tokens, so only those rare tokens become join
    keys and no frequent word gathers all names.  Sizes, the places of the
    shared token and bit masks of the sets rule pairs out; a pair counts at its
    first common token only, so it is compared once.
    """
    pairs = _possible_pairs(items, at_least)
    score = ratio(F.size(F.array_intersect("_a", "_b")), F.size(F.array_union("_a", "_b")))
    first = F.get(F.array_intersect("_a", "_b"), F.lit(0)) == F.col("_key")
    return pairs.filter(first).withColumn("similarity", score).filter(F.col("similarity") >= at_least).select("name_a", "name_b", "similarity")


def _possible_pairs(items: DataFrame, at_least: float) -> DataFrame:
    """Pairs of names, with their token sets, at each token that can be their first common one."""
    names = items.select("name").distinct().withColumn("_t", F.explode(tokens(F.col("name"))))
    frequency = names.groupBy("_t").agg(F.count(F.lit(1)).alias("_f"))
    sets = (
        names.join(frequency, "_t")
        .groupBy("name")
        .agg(F.sort_array(F.collect_list(F.struct("_f", "_t"))).alias("_o"))
        .withColumn("_o", F.col("_o._t"))
    )
    size = F.size("_o")
    keep = size - F.ceil(size * F.lit(at_least) - 1e-9).cast("int") + 1
    keyed = sets.select("name", "_o", size.alias("_n"), *[mask(F.col("_o"), h).alias(f"_m{h}") for h in (0, 1)], F.posexplode(F.slice("_o", F.lit(1), keep)).alias("_at", "_key"))
    a, b = (
        keyed.select("_key", F.col("name").alias(f"name_{x}"), F.col("_o").alias(f"_{x}"), F.col("_n").alias(f"n_{x}"), F.col("_at").alias(f"at_{x}"), *[F.col(f"_m{h}").alias(f"mask{h}_{x}") for h in (0, 1)])
        for x in "ab"
    )
    needed = F.ceil((F.col("n_a") + F.col("n_b")) * (at_least / (1 + at_least)) - 1e-9)
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    shared = F.least(F.col("n_a") - missing("a", "b"), F.col("n_b") - missing("b", "a"))
    return a.join(b, "_key").filter((F.col("name_a") < F.col("name_b")) & (left >= needed) & (shared >= needed))
