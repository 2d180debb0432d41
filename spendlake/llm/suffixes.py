"""Suffix-array deduplication by bucket-pointer refinement.

The suffixes that must be compared over 200 bytes are first dealt to the buckets of
their windows' minimisers, where equal ones meet; in a bucket they start as q-gram
buckets of eight bytes and are refined by sorting on the bucket identifiers of later
offsets (:func:`spendlake.llm.windows.window_classes`), each round's identifiers
serving the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm.common import documents, id_back
from spendlake.llm.windows import Kind, covered, identified, repeats, with_marks

LENGTH = 200
MINIMISER = 24
KIND = Kind(words=False, size=LENGTH, gram=MINIMISER, first_stays=False)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        out = []
        for key, text, starts, windows in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if starts:
                gone = covered(len(text), list(zip(starts, windows)), LENGTH)
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                out.append((key, len(text), int(gone.sum()), spans, np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()))
            else:
                out.append((key, len(text), 0, 0, text))
        for first in range(0, len(out), 500):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[first : first + 500]), kinds)], names=names)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: Kind = KIND) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row.

    A byte goes if it is covered by a 200-byte string that also starts anywhere
    else, in this row or another one; first occurrences go as well.  Null texts
    are empty, texts under 200 bytes stay whole, and repeated rows repeat each
    other.  ``kept`` are bytes, since a cut may fall inside a character.
    """
    rows = identified(docs, id_col, text_col)
    done = with_marks(rows, repeats(rows, kind), _kept, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(id_back(F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op7_refined_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated 200-byte strings of all documents."""
    return without_repeats(documents(spark, folder)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
