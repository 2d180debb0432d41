"""Connected blocks of occupied grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.session import checkpoint_dir


def connected_blocks(cells: DataFrame, key: str, y: str = "cy", x: str = "cx") -> DataFrame:
    """``key, y, x`` with ``block_y, block_x``: the smallest cell reachable over neighbours, diagonal ones included, of the same key.

    Every round takes the smallest label around and then the label of that label,
    so labels jump ever further; rounds end in the checkpoint folder.  Only
    occupied cells move, never what lies in them.  ``key`` has no nulls.
    """
    checkpoint_dir(cells.sparkSession)
    own = cells.select(key, F.col(y).alias("y"), F.col(x).alias("x")).distinct().checkpoint()
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = own.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
    around = around.select(key, "y", "x", (F.col("y") + F.col("_dy")).alias("ny"), (F.col("x") + F.col("_dx")).alias("nx"))
    other = own.select(key, F.col("y").alias("ny"), F.col("x").alias("nx"))
    edges = around.join(other, [key, "ny", "nx"]).checkpoint()
    labels = own.withColumn("label", F.struct("y", "x"))
    while True:
        seen = labels.select(key, F.col("y").alias("ny"), F.col("x").alias("nx"), "label")
        least = edges.join(seen, [key, "ny", "nx"]).groupBy(key, "y", "x").agg(F.min("label").alias("label")).checkpoint()
        jump = least.select(key, F.struct("y", "x").alias("label"), F.col("label").alias("further"))
        following = least.join(jump, [key, "label"]).select(key, "y", "x", F.col("further").alias("label"))
        both = following.join(labels.withColumnRenamed("label", "before"), [key, "y", "x"]).checkpoint()
        labels = both.select(key, "y", "x", "label")
        if both.filter("label <> before").isEmpty():
            return labels.select(key, F.col("y").alias(y), F.col("x").alias(x), F.col("label.y").alias("block_y"), F.col("label.x").alias("block_x"))
