"""SimHash near-duplicates by segment popcounts.

A fingerprint of 64 bits is mapped to the bit counts of 32 segments of two bits.
Their Manhattan distance never exceeds the Hamming distance of the fingerprints,
so it bounds it from below.  Counts are kept in thermometer code (0, 1, 2 as 00, 01,
11), where the Manhattan distance is the number of differing bits.

Range join: if two count vectors are at distance ``radius`` or less, at most
``radius`` of the grid's coordinate groups differ, so with ``radius + 3`` groups
three are equal.  Every choice of three groups is a grid; distinct fingerprints
meet in the cells of each, pairs within the distance are verified exactly on the
bits, and each cell passes on only the links that join two of its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm.common import Forest, components, documents, id_back, id_key, materialise

SHINGLE = 4
SEED = 42
RADIUS = 4
EQUAL_GROUPS = 3


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text; 0 for a text without words."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(flat, SEED)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends)], ends[shingle - 1 :])], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for first in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[first : first + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``id, print`` of ``rows(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "print"])

    return rows.mapInArrow(run, "id long, print long")


def group_masks(radius: int) -> list[int]:
    """Bit masks of the coordinates that each grid looks at."""
    groups = radius + EQUAL_GROUPS
    parts = [sum(3 << 2 * s for s in range(32) if s % groups == g) for g in range(groups)]
    return [sum(parts[g] for g in chosen) for chosen in combinations(range(groups), EQUAL_GROUPS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def thermometer(column):
    """The 32 segment counts of a fingerprint, in thermometer code."""
    low = F.lit(0x5555555555555555)
    up = F.shiftrightunsigned(column, 1)
    return column.bitwiseOR(up).bitwiseAND(low).bitwiseOR(F.shiftleft(column.bitwiseAND(up).bitwiseAND(low), 1))


def cell_links(cell: np.ndarray, counts: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions of linked rows of a cell (rows sorted by cell), enough to connect all that are linked."""
    n = len(cell)
    forest, links = Forest(n), []
    left, step = np.flatnonzero(cell[:-1] == cell[1:]), 1
    labels = np.arange(n)
    while len(left):
        right = left + step
        near = np.flatnonzero(labels[left] != labels[right])
        near = near[np.bitwise_count(counts[left[near]] ^ counts[right[near]]) <= radius]  # lower bound
        near = near[np.bitwise_count(prints[left[near]] ^ prints[right[near]]) <= radius]
        if len(near):
            links += forest.join(left[near], right[near])
            labels = forest.parent
            while (up := labels[labels]) is not labels and (up != labels).any():
                labels = up
        step += 1
        left = left[left + step < n]
        left = left[cell[left] == cell[left + step]]
    return links


def _cells(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def linked(columns):
            pairs = cell_links(columns[0], columns[1].view(np.uint64), columns[2].view(np.uint64), radius)
            a, b = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(columns[2][a]), pa.array(columns[2][b])], names=["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(3)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last cell may go on
                if cut:
                    yield linked([x[:cut] for x in held])
                    held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield linked(held)

    return run


def print_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: of the different fingerprints in ``print``, links that connect all that lie within ``radius`` bits."""
    counts = thermometer(F.col("print"))
    masks = [F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(group_masks(radius))]
    cells = distinct.withColumn("counts", counts).select(F.explode(F.array(*masks)).alias("cell"), "counts", "print")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; links are ``radius`` or fewer differing bits.

    ``component_id`` is the smallest id reachable by links, null ids below all
    others.  A null or wordless text has fingerprint zero and links like any
    other; rows with equal fingerprints are one component.
    """
    rows = docs.select(id_key(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    prints = materialise(fingerprints(rows), "prints")
    distinct = prints.groupBy("print").agg(F.min("id").alias("first"))
    rooted = distinct.join(components(print_links(distinct, radius)), distinct["print"] == F.col("node"), "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select(F.col("print").alias("_print"), "component")
    return prints.join(named, F.col("print") == F.col("_print")).select(
        id_back(F.col("id")).alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), id_back(F.col("component")).alias("component_id")
    )


def op8_popcount_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicates among all documents by SimHash of four-word shingles."""
    return near_duplicates(documents(spark, folder))
