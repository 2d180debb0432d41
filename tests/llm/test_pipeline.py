"""The pipeline's stages against plain models of what they decide."""

from collections import Counter

import corpus_pipeline
from spendlake.llm import bpe
from tests.conftest import SMALL
from tests.llm.conftest import SCHEMA
from tests.llm.test_simple_operators import brute_exact, check_bpe
from tests.llm.test_whole_stages import brute_components


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    by = dict(corpus_pipeline.STAGES)
    known = by["language"](spark, docs, SMALL).cache()
    assert known.columns == names
    left, right = Counter(r["doc_id"] for r in docs.collect()), Counter(r["doc_id"] for r in known.collect())
    assert not right - left and sum(right.values()) >= 0.95 * sum(left.values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(any(c.isalpha() for c in texts[i] or "") for i in right)

    once = by["exact_dedup"](spark, known, SMALL).cache()
    want = {max(ids) for ids in brute_exact(r.asDict() for r in known.collect()).values()}
    assert once.columns == names and Counter(r["doc_id"] for r in once.collect()) == Counter(want)

    near = by["near_dedup"](spark, once, SMALL).cache()
    rows = sorted((r.asDict() for r in once.collect()), key=lambda d: d["doc_id"])
    want = {rows[i]["doc_id"] for i in brute_components(rows)}
    assert near.columns == names and Counter(r["doc_id"] for r in near.collect()) == Counter(want)

    mixed = by["mixing"](spark, near, SMALL).cache()
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == names and max(copies.values()) <= 3 and not copies.keys() - want

    done = by["bpe"](spark, mixed, SMALL)
    check_bpe(bpe.encode(mixed), [r.asDict() for r in mixed.collect()])
    assert Counter(r["doc_id"] for r in done.collect()) == copies
    assert Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == Counter(map(tuple, done.collect()))


def test_stages_return_further_columns_unchanged(spark, clashing):
    names = ["_key", "_digest", "_node", "_row", "_language", "_copy", "_copies", "_source", "_ID", "_pattern", "_block", "node", "label"]
    frame = clashing.select("*", *(clashing["n_chars"].alias(n) for n in names if n.lower() not in map(str.lower, clashing.columns))).cache()
    rows = set(map(tuple, frame.collect()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, frame, SMALL)
        assert done.columns == frame.columns
        found = list(map(tuple, done.collect()))
        assert found and not set(found) - rows


def test_rows_of_one_id_are_kept_and_mixed_one_by_one(spark):
    texts = [(1, "a b c"), (1, "A b C"), (1, "d e f g"), (None, "a b c"), (None, None), (None, ""), (2, "a B c")]
    frame = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(texts)], SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in stages["exact_dedup"](spark, frame, SMALL).collect()]
    assert sorted(kept, key=str) == sorted([(2, "a b c"), (1, "d e f g"), (None, "")], key=str)
    mixed = Counter(r["n_chars"] for r in stages["mixing"](spark, frame, SMALL).collect())
    assert mixed == dict.fromkeys(range(7), 1)


def test_stages_take_odd_rows(spark, odd, empty):
    for frame in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SMALL).columns == frame.columns
            assert stage(spark, frame, SMALL).count() <= 3 * frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SMALL).count() == frame.count()
