"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are summed by membership pattern (the set of sources they belong to).
The flow routes word capacity from patterns to source quotas; the first, second
and third copy of a pattern are edges of rising cost, so texts repeat only where
a quota needs it.  Within a pattern a seeded order decides which documents take
the last, partial copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlake.llm.common import documents, free_name, materialise
from spendlake.llm.flow import Network

#: Words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Price of each further copy of a document; convex, one entry for each copy allowed.
COPY_COSTS = (1, 3, 5)


def cyclic_weight(rank: int) -> int:
    """1, 2, 3, repeating."""
    return rank % 3 + 1


def order_sources(names) -> list:
    """By code point, null last."""
    return sorted(names, key=lambda s: (s is None, s or ""))


def targets(sizes: dict, weight: Callable[[int], float], copies: int) -> dict:
    """Share the sum of ``sizes`` by weight; none above ``copies`` times its size, the excess goes to the others.

    >>> targets({"a": 90, "b": 10}, cyclic_weight, 3)
    {'a': 70.0, 'b': 30.0}
    """
    weights = {s: weight(i) for i, s in enumerate(order_sources(sizes))}
    total, fixed, free = float(sum(sizes.values())), {}, set(sizes)
    while free:
        left, share = total - sum(fixed.values()), sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / share > copies * sizes[s]]
        if not over:
            return {s: float(fixed[s]) if s in fixed else left * weights[s] / share for s in sizes}
        fixed |= {s: copies * sizes[s] for s in over}
        free -= set(over)
    return {s: float(fixed[s]) for s in sizes}


def route(patterns: dict, quotas: dict) -> dict:
    """Words that each pattern gives; ``patterns``: (capacity, sources) by key, ``quotas``: words by source."""
    keys, names = list(patterns), list(quotas)
    place = {s: len(keys) + i for i, s in enumerate(names)}
    source, sink = len(keys) + len(names), len(keys) + len(names) + 1
    network = Network(sink + 1)
    copies = {}
    for i, key in enumerate(keys):
        capacity, members = patterns[key]
        copies[key] = [network.edge(source, i, capacity, cost) for cost in COPY_COSTS]
        for s in members:
            network.edge(i, place[s], capacity * len(COPY_COSTS), 0)
    for s in names:
        network.edge(place[s], sink, round(quotas[s]), 0)
    network.send(source, sink)
    return {key: sum(network.used(e) for e in copies[key]) for key in keys}


def mix(rows: DataFrame, order: list, weight: Callable[[int], float] = cyclic_weight, seed: int = 5, blocks: int = 256, max_patterns: int = 100_000) -> DataFrame:
    """Rows with ``size`` and ``sources`` (array), plus ``copies`` and ``taken``; also ``source_size`` and ``target`` of the first source.

    A row in no source is never taken.  ``order`` are columns that fix a row's
    seeded place; rows equal in all of it change places freely.  Sums over
    patterns reach the driver, at most ``max_patterns``; beyond that the call
    fails instead of leaving any out.
    """
    spark = rows.sparkSession
    held = rows.withColumn("_pattern", F.to_json(F.struct("sources"))).withColumn("_block", F.pmod(F.xxhash64(*order, F.lit(seed)), F.lit(blocks)))
    sums = held.groupBy("_pattern", "_block").agg(F.sum("size").alias("_sum"), F.first("sources").alias("_sources"))
    found = sums.groupBy("_pattern").agg(F.sum("_sum"), F.first("_sources")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {r[0]: (r[1], list(dict.fromkeys(r[2] or []))) for r in found}
    sizes: dict = {}
    for capacity, members in patterns.values():
        for s in members:
            sizes[s] = sizes.get(s, 0) + capacity
    wanted = targets(sizes, weight, len(COPY_COSTS))
    given = route(patterns, wanted)
    plan = []
    for key, (capacity, members) in patterns.items():
        whole, rest = divmod(given[key], capacity) if capacity else (0, 0)
        first = members[0] if members else None
        plan.append((key, int(whole), int(rest), sizes.get(first, 0), wanted.get(first, 0.0)))
    plan = spark.createDataFrame(plan, "_pattern string, _whole long, _rest long, source_size long, target double")
    before = F.sum("_sum").over(Window.partitionBy("_pattern").orderBy("_block")) - F.col("_sum")
    parts = sums.select("_pattern", "_block", before.alias("_before")).join(plan, "_pattern")
    line = Window.partitionBy("_pattern", "_block").orderBy(F.xxhash64(F.lit(seed), *order), *order)
    middle = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before") - F.col("size") / 2
    copies = F.col("_whole") + (middle < F.col("_rest")).cast("long")
    done = held.join(parts, ["_pattern", "_block"])
    done = done.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return done.drop("_pattern", "_block", "_before", "_whole", "_rest")


def sized(docs: DataFrame, *more) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
    return docs.select("doc_id", "source", words.cast("long").alias("size"), *more)


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` of documents with one source each."""
    rows = sized(docs).withColumn("sources", F.array("source"))
    return mix(rows, ["doc_id", "source", "size"]).drop("sources")


def mixing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take go.

    Rows are told apart by a number written with them, so rows that share id and
    source are taken one by one.  A null text has size 0, a null source is a
    source of its own.  Further columns come back unchanged, whatever their
    names; an empty table gives an empty one.
    """
    number, times = (free_name(docs.columns, n) for n in ("_row", "_copies"))
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    sizes = sized(rows, F.col(number).alias("row")).withColumn("sources", F.array("source"))
    chosen = mix(sizes, ["doc_id", "source", "size"]).filter("copies > 0").select(F.col("row").alias(number), F.col("copies").cast("int").alias(times))
    joined = rows.join(chosen, number)
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op5_flow_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document.

    A null text has size 0, a null source is a source of its own, repeated rows
    each count.
    """
    return mixed(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
