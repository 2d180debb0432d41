"""Ranked lexical search over a length-stratified index.

Documents of the same length normaliser form a stratum; within it the postings of
a term are runs of equal term frequency.  All documents of a run get the same
impact, so an impact is computed once for each (stratum, frequency).  The largest
frequency of a term in a stratum bounds what it can give there; an item visits
strata by falling bound and stops below the score of its last kept document.

Items come in blocks of bounded size, each set against all documents.  A first pass
counts terms, document by document, and is written; a second one builds the index in
segments of bounded size, each task its own, and searches them.  No term, stratum or
document is gathered anywhere: only the best documents of every segment are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlake.llm.common import documents, materialise

#: Percent of the normaliser that follows a document's length.
LENGTH_PERCENT = 25
IMPACT_SCALE = 1_000_000_000
#: Stands for a missing id, which ranks last.
LAST_ID = 2**63 - 1
#: A-Z to a-z, every other ASCII character that is not a digit or a letter to a space; other bytes are part of a term.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters of a UTF-8 text, A-Z lower-cased."""
    return (text or b"").translate(_TERM_BYTES).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def normaliser(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    return 100 - LENGTH_PERCENT + LENGTH_PERCENT * lengths * n // total


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` of every ``i``, ``lengths[i]`` numbers each, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Stratified:
    """The index of one segment.

    ``docs`` and ``m`` describe documents, ``doc``, ``term``, ``tf`` the postings,
    with documents by place in ``docs``.
    """

    def __init__(self, docs: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int):
        self.docs = docs
        _, stratum = np.unique(m, return_inverse=True)
        order = np.lexsort((-tf, term, stratum[doc]))
        doc, term, tf, layer = doc[order], term[order], tf[order], stratum[doc[order]]
        new_pair = np.ones(len(doc), dtype=bool)
        new_pair[1:] = (layer[1:] != layer[:-1]) | (term[1:] != term[:-1])
        new_run = new_pair.copy()
        new_run[1:] |= tf[1:] != tf[:-1]
        runs = np.flatnonzero(new_run)
        run_impact = IMPACT_SCALE * tf[runs] // (1000 * tf[runs] + 12 * m[doc[runs]])
        self.doc, self.impact = doc, np.repeat(run_impact, np.diff(np.append(runs, len(doc))))
        pairs = np.flatnonzero(new_pair)
        by_term = np.argsort(term[pairs], kind="stable")
        self.start = pairs[by_term]
        self.length = np.diff(np.append(pairs, len(doc)))[by_term]
        self.layer, self.best = layer[self.start], self.impact[self.start]
        self.of_term = np.searchsorted(term[self.start], np.arange(n_terms + 1))
        self.layers = int(stratum.max()) + 1 if len(stratum) else 0

    def search(self, query: np.ndarray, weights: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``top`` documents, equal scores by smaller id; ``weights`` go with the terms ``query``."""
        counts = self.of_term[query + 1] - self.of_term[query]
        pairs, heavy = ranges(self.of_term[query], counts), np.repeat(weights, counts)
        found, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not len(pairs):
            return found, scores
        bound = np.bincount(self.layer[pairs], weights=heavy * self.best[pairs], minlength=self.layers)
        visits = np.argsort(-bound, kind="stable")
        place = np.empty_like(visits)
        place[visits] = np.arange(len(visits))
        order = np.argsort(place[self.layer[pairs]], kind="stable")
        pairs, heavy = pairs[order], heavy[order]
        begins = np.searchsorted(place[self.layer[pairs]], np.arange(self.layers + 1))
        first, step = 0, 1
        while first < self.layers and bound[visits[first]] > 0:
            floor = scores[top - 1] if len(scores) >= top else 1
            last = first
            while last < min(first + step, self.layers) and bound[visits[last]] >= floor:
                last += 1
            if last == first:
                break
            span = slice(begins[first], begins[last])
            rows = ranges(self.start[pairs[span]], self.length[pairs[span]])
            given = self.impact[rows] * np.repeat(heavy[span], self.length[pairs[span]])
            met, at = np.unique(self.doc[rows], return_inverse=True)
            sums = np.bincount(at, weights=given).astype(np.int64)
            good = sums >= floor
            found, scores = np.concatenate([found, met[good]]), np.concatenate([scores, sums[good]])
            best = np.lexsort((self.docs[found], -scores))[:top]
            found, scores = found[best], scores[best]
            first, step = last, step * 2
        return found, scores


def _forward(vocabulary: dict[bytes, int]):
    """Length of every document with terms, and its counts of the terms in ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for batch in batches:
            keep, lengths, codes, counts = [], [], [], []
            for at, text in enumerate(batch.column(1)):
                found = terms(text.as_py())
                if found:
                    seen, n = np.unique(np.array([c for c in map(known, found) if c is not None], dtype=np.int32), return_counts=True)
                    keep.append(at)
                    lengths.append(len(found))
                    codes.append(seen)
                    counts.append(n.astype(np.int64))
            if keep:
                ends = np.cumsum([0, *map(len, codes)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x))) for x in (codes, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(lengths, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])

    return run


def _searched(queries: list[tuple[int, np.ndarray, np.ndarray]], n_terms: int, n: int, total: int, top: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            docs, lengths = (table.column(i).to_numpy() for i in (0, 1))
            codes, tfs = (table.column(i).combine_chunks() for i in (2, 3))
            per = np.diff(codes.offsets.to_numpy())
            index = Stratified(docs, normaliser(lengths, n, total), np.repeat(np.arange(len(docs)), per), codes.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy(), n_terms)
            for first in range(0, len(queries), 512):
                parts = [(item, *index.search(query, weights, top)) for item, query, weights in queries[first : first + 512]]
                items = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(docs[np.concatenate([p[1] for p in parts])]), pa.array(np.concatenate([p[2] for p in parts]))], names=["item", "doc", "score"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(2).flatten()) + batch.num_rows
            if size >= segment:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def ranked(docs: DataFrame, items: DataFrame, item_col: str = "item_id", top: int = 20, block_bytes: int = 8 << 20, segment: int = 2_000_000) -> DataFrame:
    """``item_col, rank, doc_id, score``: the ``top`` documents of every row of ``items`` with a score above 0.

    Both frames need a column ``text``, ``docs`` also ``doc_id``; further columns
    are not read.  A null or empty text has no terms: such a document is in no
    result and not counted, such an item has no rows.  Every row is a document or
    an item of its own, repeated rows and ids included.  Equal scores rank by
    smaller id, null ids last.  Empty tables give an empty result.

    Items are worked on in blocks of about ``block_bytes`` of text, which bounds
    the terms and weights that each task gets; a single longer item is a block.
    A task holds up to about ``segment`` postings besides one batch.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("name"), F.col("text").cast("binary").alias("body"))
    blocks = 1 + (asked.agg(F.sum(F.length("body"))).first()[0] or 0) // block_bytes
    asked = asked.withColumn("block", F.pmod(F.xxhash64("name", "body"), F.lit(blocks)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.col("text").cast("binary").alias("body"))
    results = None
    for block in range(blocks):
        wanted = asked.filter(F.col("block") == block).select("name", "body").collect()
        vocabulary: dict[bytes, int] = {}
        counted = []
        for item, row in enumerate(wanted):
            codes = [vocabulary.setdefault(t, len(vocabulary)) for t in terms(row["body"])]
            counted.append((item, *np.unique(np.array(codes, dtype=np.int64), return_counts=True)))
        forward = materialise(rows.mapInArrow(_forward(vocabulary), "doc long, n long, terms array<int>, tfs array<long>"), "forward")
        n, total = forward.agg(F.count("*"), F.sum("n")).first()
        held = dict(forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # at most one row for each term of the block
        weights = np.array([weight(n, held.get(t, 0)) for t in range(len(vocabulary))], dtype=np.int64)
        queries = [(item, codes, times * weights[codes]) for item, codes, times in counted if len(codes)]
        hits = forward.mapInArrow(_searched(queries, len(vocabulary), n, total or 1, top, segment), "item long, doc long, score long")
        line = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc"))
        best = hits.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r["name"]) for i, r in enumerate(wanted)], f"item long, {item_col} {items.schema[item_col].dataType.simpleString()}")
        part = best.join(names, "item").select(item_col, "rank", F.nullif(F.col("doc"), F.lit(LAST_ID)).alias("doc_id"), "score")
        part = materialise(part, "ranked") if blocks > 1 else part
        results = part if results is None else results.unionAll(part)
    return results


def op12_stratified_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item; see :func:`ranked` for nulls, ties and repeats."""
    return ranked(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


#: The same in SQL.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), docs AS (SELECT row, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM docs),
postings AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY ALL),
frequency AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM frequency, corpus),
i AS (
  SELECT row_number() OVER () AS item, item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), items AS (SELECT item, item_id, term, count(*) AS times FROM i GROUP BY ALL),
lengths AS (SELECT row, doc_id, 100 - 25 + ((25 * n * docs) // total) AS m FROM docs, corpus),
scores AS (
  SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (row)
  GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 20
"""
