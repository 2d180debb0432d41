"""Item consensus: groups against a plain model, and values that are worked out once."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from spendlake.operators import consensus


def plain_groups(names, prices):
    def like(a, b):
        return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()

    def close(a, b, p, q):
        if not a or not b:
            return False
        price = max(0.0, 1.0 - abs(p - q) / max(p, q) * 5) if p > 0 and q > 0 else 1.0
        return a == b if price == 0.0 else like(a, b) * 0.7 + price * 0.3 >= 0.7

    group = [-1] * len(names)
    for i in range(len(names)):
        if group[i] < 0:
            group[i] = i
            for j in range(i + 1, len(names)):
                if group[j] < 0 and close(names[i], names[j], prices[i], prices[j]):
                    group[j] = i
    own = [[j for j in range(len(names)) if group[j] == g] for g in group]
    return group, [sum(like(names[i], names[j]) for j in js) / len(js) for i, js in enumerate(own)]


def test_groups_equal_a_plain_model():
    rng = random.Random(4)
    for _ in range(800):
        letters, longest = rng.choice(["ab", "abc ", "abcdef"]), rng.choice([3, 8, 20, 260])
        names = ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(rng.randint(1, 6))]
        names += [n[1:] for n in names] + names[:1]
        prices = [rng.choice([0.0, float("nan"), -1.0, 10.0, 10.5, 11.0, 14.0]) for _ in names]
        assert consensus._groups(names, prices) == plain_groups(names, prices)


def amounts(spark, cells):
    return spark.createDataFrame([(c,) for c in cells], "c array<struct<amount: double, confidence: double>>")


def test_resolved_amounts(spark):
    frame = amounts(spark, [[(10.0, 0.5)], [(10.0, 0.5), (12.0, 0.5), (500.0, 0.9)], [(-5.0, 0.4), (-6.0, 0.6)], [(10.0, 0.2), (20.0, 0.6)]])
    got = [tuple(r.r) for r in frame.select(consensus.resolve_amounts(F.col("c")).alias("r")).collect()]
    assert got == [(10.0, 0.5), (11.0, 0.5), (-6.0, 0.6), (pytest.approx(17.5), 0.4)]


def test_merged_amounts_equal_the_resolved_ones(spark):
    """The sums that a receipt's items are merged by, against the column form; nulls and NaN included."""
    rng = random.Random(7)
    values = [None, float("nan"), -3.0, 0.0, 0.01, 10.0, 10.5, 11.0, 12.0, 130.0]
    cells = [[(rng.choice(values), rng.choice([None, 0.3, 0.5, 0.9])) for _ in range(rng.randint(1, 5))] for _ in range(2000)]
    want = [tuple(r.r) for r in amounts(spark, cells).select(consensus.resolve_amounts(F.col("c")).alias("r")).collect()]
    sums = spark.createDataFrame([(i, *consensus._sums(*map(list, zip(*c)))) for i, c in enumerate(cells)], "i int, s double, w double, n long")
    amount = F.when(F.col("n").isNull(), F.col("s")).otherwise(F.bround(F.col("s") / F.col("w"), 2))
    sure = F.when(F.col("n").isNull(), F.col("w")).otherwise(F.col("w") / F.col("n"))
    got = [tuple(r) for r in sums.orderBy("i").select(amount, sure).collect()]
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]


def test_items_are_merged_where_they_are_gathered(spark):
    """One shuffle to gather a receipt's items, none to merge them."""
    items = spark.createDataFrame([], "receipt_id long, engine string, line long, product_name string, quantity double, unit_price double, line_total double, confidence double")
    found = consensus.item_consensus(items)
    assert found._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2
    assert found.collect() == []


def test_values_are_worked_out_once(spark):
    """One median, sorted once, however often the amounts are used."""
    plan = amounts(spark, []).select(consensus.resolve_amounts(F.col("c")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") == 1


def test_a_line_without_a_name_keeps_its_receipt(spark):
    rows = [(1, e, 1, n, 2.0, 10.0, 20.0, 0.6) for e, n in (("tesseract", "bread"), ("easyocr", "BREAD"), ("paddleocr", None))]
    items = spark.createDataFrame(rows, "receipt_id long, engine string, line long, product_name string, quantity double, unit_price double, line_total double, confidence double")
    found = consensus.item_consensus(items)
    assert sorted((r.product_name or "", r.sources, r.confidence) for r in found.collect()) == [("", 1, 0.6), ("bread", 2, 0.6)]
    one = spark.createDataFrame([(1, 0.5)], "receipt_id long, confidence double")
    total = consensus.overall_confidence(one, one, one, found, items.select("receipt_id", "engine")).collect()[0]
    assert total.items_confidence == pytest.approx(0.6) and total.consensus_confidence == pytest.approx(0.62)
