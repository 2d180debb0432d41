"""Small tables with answers worked out by hand: rules, fuel, anomalies, limits, series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlake.functions.core import running
from spendlake.operators import anomalies, fuel, insights, joins, limits, rules, series, sets
from spendlake.operators.rules import Condition, Rule

DAY = dt.datetime(2024, 5, 10, 12, 0)
RECEIPT = "receipt_id long, user_id long, company_name string, description string, category string, date timestamp, total_amount decimal(18,2)"


def receipts(spark, rows):
    frame = spark.createDataFrame(
        [(i, u, v, d, c, when, float(a)) for i, u, v, d, c, when, a in rows], RECEIPT.replace("decimal(18,2)", "double")
    )
    return frame.withColumn("total_amount", F.col("total_amount").cast("decimal(18,2)")).withColumn("created_at", F.col("date"))


def known(spark, amount=100000, category="Oficina"):
    frame = receipts(spark, [(1, 1, "Mi Oficina SA", "papel", category, DAY, amount)])
    users = spark.createDataFrame([(1, "employee", "a@b.c")], "user_id long, role string, email string")
    return rules.facts(frame, users).withColumn("workflow_id", F.lit(1).cast("long"))


@pytest.mark.parametrize("amount, action", [(30000, "approve"), (300000, "require_approval"), (800000, "escalate")])
def test_basic_template(spark, amount, action):
    table = rules.workflow_table(spark, {1: (rules.BASIC, "require_approval")})
    row = rules.evaluate(known(spark, amount), table).first()
    assert (row.action, row.auto_approved) == (action, action == "approve")
    assert row.confidence > 0.5


@pytest.mark.parametrize(
    "field, operator, value, expected",
    [
        ("category", "equals", "Oficina", True),
        ("amount", "equals", 100000, True),
        ("amount", "greater_than", 50000, True),
        ("amount", "less_than", 50000, False),
        ("category", "contains", "Ofi", True),
        ("category", "not_contains", "ofi", False),
        ("category", "in", ["Oficina", "Viajes"], True),
        ("category", "not_in", ["Viajes"], True),
        ("category", "greater_than", 1, False),
        ("missing", "equals", "x", False),
        ("missing", "not_equals", "x", True),
        ("missing", "in", ["x"], False),
        ("category", "no_such_operator", "x", False),
    ],
)
def test_condition_operators(spark, field, operator, value, expected):
    table = rules.workflow_table(spark, {1: ([Rule("r", "r", "approve", 1, [Condition(field, operator, value)])], "reject")})
    assert rules.condition_results(known(spark), table).first().holds is expected


def test_priority_logic_and_default(spark):
    either = Rule("any", "any", "escalate", 10, [Condition("amount", "less_than", 1), Condition("month", "equals", 5)], "OR", "boss")
    both = Rule("all", "all", "reject", 20, [Condition("amount", "less_than", 1), Condition("month", "equals", 5)])
    row = rules.evaluate(known(spark), rules.workflow_table(spark, {1: ([either, both], "approve")})).first()
    assert (row.applied_rule_id, row.next_approver_role) == ("any", "boss")
    assert row.confidence == pytest.approx(0.9)
    none = rules.evaluate(known(spark), rules.workflow_table(spark, {1: ([both], "approve")})).first()
    assert (none.applied_rule_id, none.action, none.confidence) == (None, "approve", 0.5)


@pytest.mark.parametrize("km, vehicle, litres", [(150.0, "economico", 10.0), (100.0, "intermedio", 10.0), (80.0, "suv", 10.0), (-5.0, "suv", 0.0), (10.0, "tren", 0.0)])
def test_litres(spark, km, vehicle, litres):
    frame = spark.createDataFrame([(km, vehicle)], "distance_km double, vehicle_type string")
    assert frame.select(fuel.litres(F.col("distance_km"), F.col("vehicle_type"))).first()[0] == pytest.approx(litres)


def test_vehicle_comparison(spark):
    rows = {(r.vehicle, r.other): r for r in fuel.vehicle_comparison(spark).collect()}
    pair = rows[("economico", "suv")]
    assert (pair.more_efficient, pair.difference, pair.percentage_diff) == ("economico", 7, 88)
    assert (pair.footprint, pair.other_footprint) == ("low", "high")


def test_duplicate_severity(spark):
    rows = [
        (1, 1, "Lider", "almuerzo", None, DAY, 1000),
        (2, 1, "Lider", "almuerzo", None, DAY - dt.timedelta(minutes=30), 1000),
        (3, 1, "Lider", "almuerzo", None, DAY - dt.timedelta(hours=5), 800),
        (4, 1, "Jumbo", "cena", None, DAY - dt.timedelta(hours=6), 1000),
        (5, 1, "Lider", "almuerzo", None, DAY - dt.timedelta(hours=30), 1000),
    ]
    found = {(r.receipt_id, r.related_receipt_id): (r.severity, round(r.similarity, 4)) for r in anomalies.duplicates(receipts(spark, rows)).collect()}
    assert found == {(1, 2): ("high", 1.0), (1, 3): ("medium", 0.87), (2, 3): ("medium", 0.87)}


def test_duplicates_cross_bucket_borders(spark):
    start = dt.datetime(2024, 1, 1, 23, 50)
    rows = [(i, 1, "A", "x", None, start + dt.timedelta(hours=23 * i), 10) for i in range(6)]
    frame = receipts(spark, rows)
    pairs = {(r.a.receipt_id, r.b.receipt_id) for r in joins.near_pairs(frame).collect()}
    assert pairs == {(i + 1, i) for i in range(5)}
    assert joins.near_pairs(frame, newest_rows=2).count() == 1


def test_oldest_receipts_of_a_busy_user_count(spark):
    rows = [(i, 1, "A", "x", "Comida", DAY - dt.timedelta(days=i), 100 + i % 5) for i in range(5000)]
    rows += [(9000 + i, 1, "A", "x", "Comida", DAY - dt.timedelta(days=6000, minutes=i), 9000) for i in range(2)]
    frame = receipts(spark, rows)
    assert {9000, 9001} == {r.receipt_id for r in anomalies.outliers(frame).collect()}
    assert (9000, 9001) in {(r.receipt_id, r.related_receipt_id) for r in anomalies.duplicates(frame).collect()}
    assert insights.profile(joins.user_history(frame, frame.select("receipt_id", "category", F.col("date").alias("created_at")))).first().receipts == 5002


def test_quartiles_match_percentile(spark):
    amounts = [-7.0, 0.0, 0.5, 1.0, 1.0, 3.25, 8.0, 8.0, 64.0, 1e6, 2e6, 2e6 + 0.01]
    rows = [("a", "x", v) for v in amounts] + [("b", "x", 5.0)] + [("c", "y", float(v)) for v in range(4)]
    frame = spark.createDataFrame(rows + [("a", "x", None)], "k string, category string, amount double")
    expected = {
        r.k: r.q
        for r in frame.groupBy("k").agg(F.percentile("amount", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()
    }
    found = {r.k: [r._q1, r._q2, r._q3] for r in anomalies._quartiles(frame, ["k", "category"]).collect()}
    assert found.keys() == expected.keys()
    for k, values in found.items():
        assert all(abs(x - y) < 1e-6 for x, y in zip(values, expected[k]))


def test_z_score_branch(spark):
    rows = [(i, 1, "A", "x", "Comida", DAY - dt.timedelta(days=i), 100 + i % 3) for i in range(20)] + [(99, 1, "A", "x", "Comida", DAY, 900)]
    found = anomalies.outliers(receipts(spark, rows)).collect()
    assert [(r.receipt_id, r.by_z_score, r.by_quartiles) for r in found] == [(99, True, True)]
    one = anomalies.unusual_amounts(receipts(spark, rows)).first()
    assert (one.severity, one.above_typical) == ("high", False)


def test_busy_day_default(spark):
    rows = [(i, 1, "A", "x", None, DAY, 40000) for i in range(6)] + [(10 + i, 2, "A", "x", None, DAY, 90000) for i in range(5)]
    found = anomalies.busy_days(receipts(spark, rows), "2024-05-20").collect()
    assert [(r.user_id, r.receipts_count, float(r.amount)) for r in found] == [(1, 6, 240000.0)]


def test_risk_score(spark):
    rows = [(1, "duplicate_receipt", "high"), (1, "unusual_amount", "low"), (2, "suspicious_pattern", "critical")]
    scores = {r.user_id: r for r in anomalies.risk_scores(spark.createDataFrame(rows, "user_id long, type string, severity string")).collect()}
    assert scores[1].risk_score == pytest.approx(23.0)
    assert (scores[1].risk_level, scores[2].risk_level) == ("low", "high")
    assert len(scores[2].recommendations) == 3


def test_running_matches_a_plain_window(spark):
    rows = [(i, i % 2, DAY + dt.timedelta(minutes=7 * (i % 50)), float(i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, k long, ts timestamp, v double")
    got = running(frame, ["k"], "ts", [F.col("ts"), F.col("id")], {"s": F.col("v")})
    plain = {}
    for key in (0, 1):
        total = 0.0
        for n, row in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])), 1):
            total += row[3]
            plain[row[0]] = (n, total)
    assert {r.id: (r.rn, r.s) for r in got.collect()} == plain


def test_forecast_needs_thirty(spark):
    few = receipts(spark, [(i, 1, "A", "x", None, DAY - dt.timedelta(days=i), 100) for i in range(29)])
    row = series.forecast(few, "2024-03-01", 30).first()
    assert (row.method, row.total_amount, row.confidence) == ("mock", pytest.approx(20000 * 30 * 1.15), 0.6)
    more = receipts(spark, [(i, 1, "A", "x", None, DAY - dt.timedelta(days=i), 100 if i < 7 else 50) for i in range(30)])
    row = series.forecast(more, "2024-12-01", 10).first()
    assert row.total_amount == pytest.approx((7 * 100 + 23 * 50) / 30 * 1.25 * 10)
    assert (row.direction, row.monthly_growth) == ("increasing", pytest.approx(100.0))


def test_limit_periods(spark):
    row = spark.range(1).select(*[limits.period_start(k, "2024-05-10").cast("string").alias(k) for k in ("daily", "weekly", "monthly", "yearly", "other")]).first()
    assert [row[k][:10] for k in ("daily", "weekly", "monthly", "yearly", "other")] == ["2024-05-10", "2024-05-06", "2024-05-01", "2024-01-01", "2024-05-01"]


def test_insights_of_one_user(spark):
    rows = [(i, 1, "A", "x", "Retail", dt.datetime(2024, 11, 4 + 7 * (i % 3), 22), 100000) for i in range(6)]
    rows += [(10 + i, 1, "A", "x", "Comida", dt.datetime(2024, 9 + i, 20, 9), 1000) for i in range(2)]
    found = {(r.type, r.category) for r in insights.all_insights(receipts(spark, rows), "2024-11-30").collect()}
    assert ("spending_pattern", "temporal") in found
    assert ("spending_pattern", "quincena") in found
    assert ("chile_specific", "eventos_comerciales") in found
    assert ("category_comparison", "Retail") in found
    assert ("seasonal_pattern", "mensual") in found


def test_similar_names_match_brute_force(spark):
    names = ["red big ring", "red ring", "big red ring", "blue ring", "blue gear", "small gear", "gear", "odd"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    brute = set()
    for a in names:
        for b in names:
            x, y = set(a.split()), set(b.split())
            if a < b and len(x & y) / len(x | y) >= 0.5:
                brute.add((a, b))
    assert {(r.name_a, r.name_b) for r in sets.similar_names(frame, 0.5).collect()} == brute
