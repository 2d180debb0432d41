"""Ranked search against SQL and against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from spendlake.llm import lexical
from tests.conftest import SMALL
from tests.llm.conftest import odd_rows, words
from tests.oracle import compare, connect

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, top=20):
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for name, text in items:
        rows = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(name, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(rows)[:top], 1)]
    return Counter(out)


def test_equals_sql(spark):
    assert compare(lexical.op12_stratified_search(spark, SMALL), connect(SMALL), lexical.OP12_SQL) is None


def test_odd_rows_blocks_and_segments(spark, odd, clashing, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rng = random.Random(8)
    base = odd_rows()[4][1]
    asked = [(0, None), (1, ""), (2, base), (2, base), (None, "straße İstanbul x 1234"), (3, words(rng, 40)), (4, "ΣΊΣΥΦΟΣ la LA la"), (5, "--- !!")]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("block", lexical.F.lit(7))
    want = brute(docs, asked)
    for frame, kwargs in ((odd, {}), (clashing, {"block_bytes": 1500}), (clashing, {"segment": 3})):
        assert Counter(map(tuple, lexical.ranked(frame, items, **kwargs).collect())) == want
    assert lexical.ranked(empty, items).collect() == []
    assert lexical.ranked(odd, items.limit(0)).collect() == []


def test_bounds_keep_every_winner():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, n_terms = int(rng.integers(1, 300)), 30
        docs, m = rng.permutation(n).astype(np.int64), rng.integers(75, 90, n)
        table = rng.integers(0, 4, (n, n_terms)) * (rng.random((n, n_terms)) < rng.random(n_terms))
        doc, term = np.nonzero(table)
        index = lexical.Stratified(docs, m, doc, term, table[doc, term], n_terms)
        query = np.unique(rng.integers(0, n_terms, 6))
        weights = rng.integers(0, 9000, len(query))
        impact = 10**9 * table // (1000 * table + 12 * m[:, None])
        scores = impact[:, query] @ weights
        want = sorted((-s, d) for s, d in zip(scores.tolist(), docs.tolist()) if s > 0)[:7]
        found, got = index.search(query, weights, 7)
        assert [(-s, d) for s, d in zip(got.tolist(), docs[found].tolist())] == want
