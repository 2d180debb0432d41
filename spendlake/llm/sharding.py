"""Resharding by minimum-cost flow.

Old shard sizes and new capacities form a transport problem in which a byte that
stays costs nothing and a byte that moves costs one.  Its cheapest solution says
how many bytes go from which old shard to which new one.  Every old shard is laid
out in a fixed seeded order of blocks and rows, the amounts cut that line into
intervals, and each row follows the interval that holds its middle byte, so a
shard misses its capacity by less than one row at each cut.

Only block totals (old shards x blocks) reach the driver.  The law is ``bytes``:
sizes near equal.  Equal texts are not kept together, since one group of copies
may be larger than a shard.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlake.llm.common import documents, materialise
from spendlake.llm.flow import Network
from spendlake.session import checkpoint_dir

#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def transfers(sizes: dict[int, int], capacities: dict[int, int]) -> dict[int, dict[int, int]]:
    """Bytes from every old shard to every new one that move the fewest bytes.

    >>> transfers({0: 10, 1: 2}, {0: 6, 1: 6})
    {0: {0: 6, 1: 4}, 1: {1: 2}}
    """
    olds, news = sorted(sizes), sorted(capacities)
    network = Network(len(olds) + len(news) + 2)
    source, sink = len(olds) + len(news), len(olds) + len(news) + 1
    edges = {}
    for i, old in enumerate(olds):
        network.edge(source, i, sizes[old], 0)
        for j, new in enumerate(news):
            edges[old, new] = network.edge(i, len(olds) + j, sizes[old], int(old != new))
    for j, new in enumerate(news):
        network.edge(len(olds) + j, sink, capacities[new], 0)
    network.send(source, sink)
    return {old: {new: used for new in news if (used := network.used(edges[old, new]))} for old in olds}


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def reshard(rows: DataFrame, order: list, shards: int, blocks: int = 256, capacities: dict[int, int] | None = None) -> DataFrame:
    """Rows with ``size`` and ``old_shard``, plus ``shard`` and ``slot``.

    ``order`` (columns that depend on nothing but the row) fixes the line on
    which an old shard is cut; rows equal in all of it change places freely.
    ``size`` must be positive.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    laid = rows.withColumn("_block", F.pmod(F.xxhash64(*order, F.lit(10)), F.lit(blocks)).cast("int"))
    totals = {(r[0], r[1]): r[2] for r in laid.groupBy("old_shard", "_block").agg(F.sum("size")).collect()}
    sizes: dict[int, int] = {}
    starts = []
    for old, block in sorted(totals):
        starts.append((old, block, sizes.get(old, 0)))
        sizes[old] = sizes.get(old, 0) + totals[old, block]
    plan = transfers(sizes, capacities or equal_capacities(sum(sizes.values()), shards))
    cuts = {}
    for old, parts in plan.items():
        at, line = 0, []
        for new in sorted(parts, key=lambda j: (j != old, j)):
            at += parts[new]
            line.append({"until": at, "shard": new})
        if line:
            line[-1]["until"] = 2**62
        cuts[old] = line
    kind = "old_shard int, _block int, _start long, _cuts array<struct<until: long, shard: int>>"
    # old shards x blocks rows at most, whatever the input is
    table = F.broadcast(spark.createDataFrame([(old, block, start, cuts[old]) for old, block, start in starts], kind))
    keys = Window.partitionBy("old_shard", "_block")
    line = keys.orderBy(F.xxhash64(*order), *order)
    middle = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_start") - (F.col("size") / 2).cast("long")
    placed = laid.join(table, ["old_shard", "_block"]).withColumn("_middle", middle)
    placed = placed.withColumn("shard", F.filter("_cuts", lambda c: F.col("_middle") <= c["until"])[0]["shard"])
    inner = Window.partitionBy("old_shard", "_block", "shard").orderBy("_middle")
    placed = materialise(placed.withColumn("_place", F.row_number().over(inner)).drop("_cuts", "_start", "_middle"), "placed")
    counts = placed.groupBy("shard", "old_shard", "_block").agg(F.count("*")).collect()  # as bounded as the totals
    seen: dict[int, int] = {}
    offsets = []
    for shard, old, block, n in sorted(counts):
        offsets.append((shard, old, block, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + n
    table = F.broadcast(spark.createDataFrame(offsets, "shard int, old_shard int, _block int, _offset long"))
    return placed.join(table, ["shard", "old_shard", "_block"]).withColumn("slot", F.col("_offset") + F.col("_place") - 1).drop("_offset", "_place", "_block")


def affected_shards(rows: DataFrame) -> list[int]:
    """Shards that gain or lose a row, from ``old_shard`` and ``shard``."""
    moved = rows.filter("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()
    return sorted(r[0] for r in moved.collect())  # shard numbers


def rewrite(rows: DataFrame, root: str, version: str, affected: list[int] | None = None, dealt: bool = False) -> list[int]:
    """Write the files of every shard that gained or lost rows to ``root/version``; returns those shards.

    ``rows`` carry ``old_shard``, ``shard`` and the payload.  Files of other
    shards stay where an earlier version wrote them.  ``affected`` saves looking
    for them again; ``dealt`` rows already lie by blocks of few shards each and
    are written from where they are.
    """
    if affected is None:
        affected = affected_shards(rows)
    kept = rows.filter(F.col("shard").isin(affected)) if affected else rows.limit(0)
    if not dealt:
        # several tasks write one shard, so no task holds a whole one
        kept = kept.repartition("shard", F.pmod(F.col("slot"), F.lit(16)) if "slot" in rows.columns else F.pmod(F.xxhash64(*rows.columns), F.lit(16)))
    kept.write.option("compression", "zstd").partitionBy("shard").parquet(f"{root}/{version}")
    return affected


def resharded(docs: DataFrame, old_shards: int, shards: int) -> DataFrame:
    """``doc_id, text, old_shard, shard, slot`` of all rows: shards that changed from their rewritten files, the others as they were.

    The text goes with its row into the block of the old shard, the one time that
    it is shuffled; from there the blocks are written to the new shards.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    old = F.pmod(F.crc32(key), F.lit(old_shards)).cast("int").alias("old_shard")
    sizes = docs.select("doc_id", "text", old, size_of("text").alias("size"), crc_of("text").alias("text_crc32"))
    columns = ["doc_id", "text", "old_shard", "shard", "slot"]
    placed = reshard(sizes, ["doc_id", "text_crc32", "size"], shards).select(*columns)
    affected = affected_shards(placed)
    if not affected:
        return placed
    root, version = f"{checkpoint_dir(spark)}/resharded", uuid.uuid4().hex
    rewrite(placed, root, version, affected, dealt=True)
    back = spark.read.schema("doc_id long, text string, old_shard int, slot long, shard int").parquet(f"{root}/{version}")
    return back.select(*columns).unionByName(placed.filter(~F.col("shard").isin(affected)))


def size_of(text: str):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def crc_of(text: str):
    return F.crc32(F.coalesce(F.col(text), F.lit("")))


def op10_flow_resharding(spark: SparkSession, folder: str, old_shards: int = 32, shards: int = 40) -> DataFrame:
    """All documents, first dealt to 32 shards by crc32 of the id, moved to 40 of near-equal bytes; from the files of the shards.

    A null text has size 16 and crc32 0; a null id is dealt like an empty one.
    Repeated rows each get a slot; an empty table gives no rows.
    """
    docs = documents(spark, folder)
    done = resharded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), old_shards, shards)
    return done.select("doc_id", size_of("text").alias("size"), crc_of("text").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
