"""Similar short texts by an inverted index of their letters.

The measure is the share of matching blocks, as for products and vendors.  Matching
blocks are common letters, so a pair that reaches a threshold has enough letters in
common, occurrences counted.  A text's letters with their occurrence numbers are put
into one fixed order, rare ones first; of a pair that reaches the threshold the first
few of both have one in common.  Only those are joined, together with the length that
the other text can have, then positions and counts rule out most pairs, and what is
left is compared exactly.  No pair is lost.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters by rising frequency; any other character counts as rarer.  The order decides speed, not results.
RARE_FIRST = "wkxjqzyvhgfbpmdcutlnsriaoe "
#: Ranks that each further occurrence of a letter goes back.
AGAIN = 7


@lru_cache(maxsize=100_000)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts; Spark has no built-in with this definition."""
    return pd.Series([None if a is None or b is None else _ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def letters(text: Column) -> Column:
    """Letters with their occurrence numbers, in the fixed order; a further occurrence is as rare as a letter some ranks before."""
    chars = F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))

    def cell(c: Column, i: Column) -> Column:
        again = i - F.array_position(chars, c).cast("int") + 1
        return F.struct((F.instr(F.lit(RARE_FIRST), c) - AGAIN * again).alias("rank"), c.alias("c"), again.alias("again"))

    return F.transform(F.sort_array(F.transform(chars, cell)), lambda s: F.concat(s["c"], s["again"].cast("string")))


def _least(own: Column, threshold: float) -> Column:
    """Common letters that a text of ``own`` letters needs with any partner."""
    return F.ceil(own * (threshold / (2 - threshold)) - 1e-9)


def needed(one: Column, two: Column, threshold: float) -> Column:
    """Common letters that two texts of these lengths need."""
    return F.ceil((one + two) * (threshold / 2) - 1e-9)


def mask(tokens: Column, half: int) -> Column:
    """One bit for each token, 64 of 128; tokens that share a bit only make two sets look more alike."""
    bits = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(128)).cast("int"))
    mine = F.filter(bits, lambda b: (b >= 64 * half) & (b < 64 * half + 64))
    return F.aggregate(mine, F.lit(0).cast("long"), lambda mask, b: mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b - 64 * half)))


def missing(one: str, two: str) -> Column:
    """At least so many tokens of ``one`` are not in ``two``, by the columns ``mask0_`` and ``mask1_`` of both."""
    return sum((F.bit_count(F.col(f"mask{h}_{one}").bitwiseAND(F.bitwise_not(F.col(f"mask{h}_{two}")))) for h in (0, 1)), F.lit(0))


def _indexed(texts: DataFrame, name: str, threshold: float) -> DataFrame:
    rows = texts.select(name, letters(F.col(name)).alias("_all")).withColumn(f"n_{name}", F.size("_all")).filter(f"n_{name} > 0")
    rows = rows.select("*", *[mask(F.col("_all"), half).alias(f"mask{half}_{name}") for half in (0, 1)])
    first = F.slice("_all", 1, (F.col(f"n_{name}") - _least(F.col(f"n_{name}"), threshold) + 1).cast("int"))
    return rows.select("*", F.posexplode(first).alias(f"at_{name}", "_letter")).drop("_all")


def candidates(asked: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs ``a, b`` of ``asked(a)`` and ``entries(b)`` whose letters allow the threshold.

    Texts without a character are in no pair; nulls neither.
    """
    left = _indexed(asked.select("a").distinct(), "a", threshold)
    right = _indexed(entries.select("b").distinct(), "b", threshold)
    shortest, longest = F.ceil(F.col("n_a") * (threshold / (2 - threshold)) - 1e-9), F.floor(F.col("n_a") * ((2 - threshold) / threshold) + 1e-9)
    # the length is part of the key, so a common letter does not gather all texts
    left = left.withColumn("n_b", F.explode(F.sequence(shortest.cast("int"), longest.cast("int"))))
    wanted = needed(F.col("n_a"), F.col("n_b"), threshold)

    met = left.join(right, ["_letter", "n_b"]).filter(F.least(F.col("n_a") - missing("a", "b"), F.col("n_b") - missing("b", "a")) >= wanted)
    # the first common letter is the first of both
    pairs = met.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))
    return pairs.filter(F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= wanted).select("a", "b")


def similar_pairs(asked: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of all pairs of different texts that reach the threshold."""
    return candidates(asked, entries, threshold).select("a", "b", similarity("a", "b").alias("similarity")).filter(F.col("similarity") >= threshold)


def most_similar(asked: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of pairs that reach the threshold, with every pair that is the best of its ``a``.

    Unmatched characters are at least the edit distance, which Spark computes by
    itself: ``1 - distance / both lengths`` bounds the similarity.  The entry at
    the smallest distance is compared first, and then only those whose bound
    does not lie below its similarity.
    """
    room = F.length("a") + F.length("b")
    pairs = candidates(asked, entries, threshold).withColumn("bound", 1 - F.levenshtein("a", "b") / room).filter(F.col("bound") >= threshold - 1e-9)
    first = pairs.groupBy("a").agg(F.max_by("b", "bound").alias("first"))
    reached = first.select("a", similarity("a", "first").alias("reached"))
    rest = pairs.join(reached, "a").filter(F.col("bound") >= F.col("reached") - 1e-9)
    return rest.select("a", "b", similarity("a", "b").alias("similarity")).filter(F.col("similarity") >= threshold)
