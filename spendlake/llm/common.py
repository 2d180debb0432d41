"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.session import checkpoint_dir

#: Stands for a missing id while rows are compared; it sorts before every real id.
NO_ID = -(2**63)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    The lineage ends there, so a lost executor costs only the tasks it ran, and
    results that depend on how rows met in a task stay as they were written.
    The files go when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written for one computation, dropped as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As :func:`materialise`."""
        out = materialise(df, name)
        self.paths[id(out)] = (out, out.inputFiles()[:1])
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of frames that :meth:`write` returned."""
        for frame in frames:
            _, files = self.paths.pop(id(frame), (None, []))
            if files:
                delete(self.spark, files[0].rsplit("/", 1)[0])

    def clear(self) -> None:
        self.drop(*(frame for frame, _ in list(self.paths.values())))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def free_name(columns: list[str], wish: str) -> str:
    """``wish`` with as many underscores before it as make it none of ``columns``, whose case doesn't count."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def held_out(fold: int, folds: int, id_col: str = "doc_id"):
    """True where crc32 of the id, written as text, falls into ``fold``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def id_key(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def id_back(column):
    """The id again, null for :data:`NO_ID`."""
    return F.when(column != F.lit(NO_ID), column)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Rows regrouped so that ``column`` holds about ``limit`` bytes in each table."""
    held, size = [], 0
    for batch in batches:
        lengths = batch.column(column)
        sizes = np.diff(np.frombuffer(lengths.buffers()[1], dtype=np.int32, count=len(lengths) + lengths.offset + 1)[lengths.offset :]) if len(lengths) else np.zeros(0, dtype=np.int32)
        total, first = np.cumsum(sizes.astype(np.int64)), 0
        while first < len(sizes):
            before = int(total[first - 1]) if first else 0
            last = max(int(np.searchsorted(total, before + limit - size, side="right")), first + (0 if held else 1))
            if last > first:
                held.append(batch.slice(first, last - first))
                size += int(total[last - 1]) - before
            if last < len(sizes):
                yield pa.Table.from_batches(held)
                held, size = [], 0
            first = last
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``; root is the smallest node reachable.

    Alternating large and small stars: every round connects a node's larger
    neighbours, then its smaller ones, to the smallest of them.  A node with
    very many neighbours is only ever aggregated and joined, never gathered,
    and each round is written to the shared folder, where the one before it goes.
    Nodes without an edge to another node do not appear.
    """
    scratch = Scratch(edges.sparkSession)
    current = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    seen = None
    while True:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = small.unionAll(smallest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, current = current, scratch.write(following, "stars")
        scratch.drop(old)
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


class Forest:
    """Union-find over positions 0..n-1 in numpy; used for the links of one task."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Link the pairs; returns those that joined two trees."""
        new = []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                new.append((x, y))
        return new
