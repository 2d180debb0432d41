"""Substring deduplication by super-k-mer partitioning of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm.common import documents, id_back
from spendlake.llm.windows import Kind, covered, identified, repeats, with_marks

WINDOW = 20
MINIMISER = 3
KIND = Kind(words=True, size=WINDOW, gram=MINIMISER, first_stays=True)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, text, starts, windows in zip(*(batch.column(i).to_pylist() for i in range(4))):
            words = text.split()
            if starts:
                gone = covered(len(words), list(zip(starts, windows)), WINDOW)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out.append((key, len(words), int(gone.sum()), kept.decode()))
            else:
                out.append((key, len(words), 0, b" ".join(words).decode()))
        for first in range(0, len(out), 500):
            columns = zip(*out[first : first + 500])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: Kind = KIND) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row.

    A word goes if a window of 20 words covers it whose words also start earlier:
    in a row of smaller id, or in the same row further to the front.  A null id
    sorts first.  Null texts have no words; texts under 20 words lose none.
    Rows that share their id are the same document, none earlier than the other.
    """
    rows = identified(docs, id_col, text_col)
    done = with_marks(rows, repeats(rows, kind), _kept, "id long, n_words long, n_removed long, kept string")
    return done.select(id_back(F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")


def op2_superkmer_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated 20-word passages of all documents."""
    return without_repeats(documents(spark, folder)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
