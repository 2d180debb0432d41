"""Exact deduplication by Grace hashing.

Two levels.  A map task folds its rows into an open-addressing table that compares
complete contents, so a group of copies leaves the task as one content plus ids.
The contents are then dealt out by hash, and each partition runs Grace hashing:
contents that no longer fit the table go to spill files by further hash bits, and
every spill file is treated the same way until all fit.  Spill files belong to one
task, lie in its temporary folder and go when they are read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm.common import NO_ID, documents, free_name, id_back, id_key, materialise

FANOUT_BITS = 4
HASH_BITS = 64


class ContentTable:
    """Open addressing with linear probing over complete contents."""

    def __init__(self, limit: int):
        self.limit, self.bytes = limit, 0
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[Any] = []

    def _slot(self, code: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        i = code & mask
        while (at := self.slots[i]) >= 0 and (self.hashes[at] != code or self.contents[at] != content):
            i = (i + 1) & mask
        return i

    def find(self, code: int, content: bytes) -> int:
        """Place of the content, or -1."""
        return self.slots[self._slot(code, content)]

    def add(self, code: int, content: bytes, value) -> int | None:
        """Enter a new content; None if the table has no room for it."""
        if self.bytes + len(content) > self.limit and self.contents:
            return None
        if 2 * len(self.contents) >= len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for at, known in enumerate(self.hashes):
                i = known & mask
                while self.slots[i] >= 0:
                    i = (i + 1) & mask
                self.slots[i] = at
        at = self.slots[self._slot(code, content)] = len(self.contents)
        self.hashes.append(code)
        self.contents.append(content)
        self.values.append(value)
        self.bytes += len(content)
        return at


def grace(records: Iterator[tuple[int, bytes, Any]], combine, limit: int, level: int = 0) -> Iterator[tuple[bytes, Any]]:
    """Each distinct content once with its combined value, within ``limit`` bytes of contents at a time.

    ``combine(old, new)`` returns the value that replaces ``old``.  The contents
    met first stay in the table; the others are spilled by bits of their hash
    that earlier levels have not used, and each spill file is a run of its own.
    Every level settles at least one content, so it ends for any input.
    """
    table = ContentTable(limit)
    spilled: dict[int, tempfile._TemporaryFileWrapper] = {}
    shift = HASH_BITS - FANOUT_BITS * (level % (HASH_BITS // FANOUT_BITS) + 1)
    try:
        for code, content, value in records:
            at = table.find(code, content)
            if at >= 0:
                table.values[at] = combine(table.values[at], value)
            elif spilled or table.add(code, content, value) is None:
                bucket = code >> shift & (1 << FANOUT_BITS) - 1
                if bucket not in spilled:
                    spilled[bucket] = tempfile.TemporaryFile()
                pickle.dump((code, content, value), spilled[bucket])
        yield from zip(table.contents, table.values)
        del table
        for file in spilled.values():
            file.seek(0)
            yield from grace(_read(file), combine, limit, level + 1)
    finally:
        for file in spilled.values():
            file.close()


def _read(file) -> Iterator[tuple[int, bytes, Any]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


LOCAL = pa.schema([("chunk", pa.string()), ("idx", pa.int32()), ("id", pa.int64()), ("code", pa.int64()), ("content", pa.binary()), ("n", pa.int64())])
GROUPS = pa.schema([("chunk", pa.string()), ("idx", pa.int32()), ("keep", pa.int64()), ("keeper", pa.bool_()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def _fold(limit: int):
    """Rows of a task as one row for each content and one for each further copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, members = None, 0
        chunk = ""

        def flush():
            rows = [(chunk, at, v[0], code - (1 << 63), content, v[1]) for at, (code, content, v) in enumerate(zip(table.hashes, table.contents, table.values))]
            for first in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[first : first + 2000]), LOCAL)], schema=LOCAL)

        copies: list[tuple[str, int, int]] = []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content = (text or b"").lower()  # bytes: A-Z only
                code = xxhash.xxh64_intdigest(content)
                if table is None:
                    table, chunk = ContentTable(limit), uuid.uuid4().hex
                at = table.find(code, content)
                if at < 0:
                    at = table.add(code, content, [key, 1])
                    if at is None:
                        yield from flush()
                        table, chunk = ContentTable(limit), uuid.uuid4().hex
                        table.add(code, content, [key, 1])
                    continue
                value = table.values[at]
                copies.append((chunk, at, min(value[0], key)))
                value[0], value[1] = max(value[0], key), value[1] + 1
            if copies:
                a, b, c = zip(*copies)
                none = [None] * len(a)
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((a, b, c, none, none, none), LOCAL)], schema=LOCAL)
                copies.clear()
        if table is not None:
            yield from flush()

    return run


def _settle(limit: int):
    """Grace hashing of one partition's contents."""

    def combine(old, new):
        # (largest id, its chunk and place, copies), and everyone who has the content
        old[2].extend(new[2])
        return max(old[0], new[0]), old[1] + new[1], old[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for chunk, idx, key, code, content, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    who = (key, chunk, idx)
                    yield code + (1 << 63), content, (who, n, [(chunk, idx)])

        out: list[tuple] = []
        for content, (best, n, members) in grace(records(), combine, limit):
            digest = hashlib.sha256(content).hexdigest()
            out += [(chunk, idx, best[0], (chunk, idx) == best[1:], n, digest) for chunk, idx in members]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), GROUPS)], schema=GROUPS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), GROUPS)], schema=GROUPS)

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 32 << 20) -> DataFrame:
    """One row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the largest id stays, null below all others; of rows that
    share text and id exactly one is kept.  ``table_bytes`` bounds the contents
    that a task holds at once.
    """
    rows = docs.select(id_key(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    local = materialise(rows.mapInArrow(_fold(table_bytes), "chunk string, idx int, id long, code long, content binary, n long"), "contents")
    groups = (
        local.filter("content IS NOT NULL")
        .select("chunk", "idx", "id", "code", "content", "n")
        .repartition("code")
        .mapInArrow(_settle(table_bytes), "chunk string, idx int, keep long, keeper boolean, group_size long, text_sha256 string")
    )
    members = local.select("chunk", "idx", "id", F.col("content").isNotNull().alias("first"))
    return members.join(groups, ["chunk", "idx"]).select(
        id_back(F.col("id")).alias("doc_id"),
        id_back(F.col("keep")).alias("keep_id"),
        "group_size",
        (F.col("keeper") & F.col("first")).alias("kept"),
        "text_sha256",
    )


def exact_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without exact copies; the copy with the largest id stays, null below all others.

    Null counts as empty text, and of rows that share id and text one stays.
    Further columns come back unchanged, whatever their names; an empty table
    gives an empty one.
    """
    key, print_ = (free_name(docs.columns, n) for n in ("_key", "_digest"))
    kept = exact_duplicates(docs).filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(key), F.col("text_sha256").alias(print_))
    digest = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    named = docs.withColumn(key, id_key("doc_id")).withColumn(print_, digest)
    # repeated rows fall together on the keys of the join, so the texts move once
    return named.join(kept, [key, print_], "left_semi").dropDuplicates([key, print_]).select(*docs.columns)


def op3_grace_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Copies among all documents, dropped ones included; see :func:`exact_duplicates` for nulls and repeats.  An empty table gives no rows."""
    return exact_duplicates(documents(spark, folder))


#: The same in SQL.
OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""
