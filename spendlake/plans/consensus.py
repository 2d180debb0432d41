"""Queries CON1 to CON8."""

from pyspark.sql import functions as F

from spendlake.operators import consensus as ops
from spendlake.plans.bindings import r
from spendlake.plans.registry import query


@query("con1_vendor_consensus")
def vendor_consensus(t):
    return ops.vendor_consensus(t.engine_results)


@query("con1_settled_vendors", "engine_results", f"""WITH e AS (SELECT *, CASE engine WHEN 'tesseract' THEN 0 WHEN 'easyocr' THEN 1 ELSE 2 END AS place FROM engine_results),
 s AS (SELECT receipt_id, max(confidence) AS top, arg_max(vendor, confidence) AS surest FROM e GROUP BY 1),
 g AS (SELECT receipt_id, upper(trim(vendor)) AS k, count(*) AS n, min(place) AS p, sum(confidence * weight) / sum(weight) AS c, arg_min(vendor, place) AS v FROM e GROUP BY receipt_id, upper(trim(vendor))),
 m AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY n DESC, p) = 1)
 SELECT s.receipt_id, CASE WHEN top > 0.7 THEN surest ELSE v END AS vendor, {r('CASE WHEN top > 0.7 THEN least(1.0, top * 1.1) ELSE least(1.0, c * 1.1) END')} AS confidence,
 CASE WHEN top > 0.7 THEN 'high_confidence_priority' ELSE 'exact_match' END AS consensus_type, CASE WHEN top > 0.7 THEN 3 ELSE n END AS engines
 FROM s JOIN m ON s.receipt_id = m.receipt_id WHERE top > 0.7 OR n >= 2""")
def settled_vendors(t):
    rows = ops.vendor_consensus(t.engine_results)
    return rows.filter(F.col("consensus_type").isin("high_confidence_priority", "exact_match"))


@query("con2_amount_consensus", "engine_results", f"""WITH e AS (SELECT receipt_id, total_amount::double AS a, confidence AS c FROM engine_results),
 m AS (SELECT receipt_id, median(a) AS med, max(a) AS hi, min(a) AS lo FROM e GROUP BY 1),
 j AS (SELECT e.*, med, (hi - lo) / hi <= 0.05 AS near FROM e JOIN m ON e.receipt_id = m.receipt_id)
 SELECT receipt_id, {r('round_even(sum(a * c) / sum(c), 2)')} AS amount, {r('avg(c)')} AS confidence, CASE WHEN near THEN 'weighted_average' ELSE 'conflict_resolved' END AS consensus_type
 FROM j WHERE near OR a BETWEEN 0.1 * med AND 10 * med GROUP BY receipt_id, near""")
def amount_consensus(t):
    return ops.amount_consensus(t.engine_results)


DATES = """d AS (SELECT receipt_id, confidence, CASE WHEN engine = 'easyocr' THEN date ELSE substring(date, 9, 2) || '/' || substring(date, 6, 2) || '/' || substring(date, 1, 4) END AS nd FROM engine_results)"""


@query("con3_date_consensus", "engine_results", f"""WITH {DATES} SELECT receipt_id, nd AS date, {r('0.6 + avg(confidence) * 0.4')} AS confidence FROM d GROUP BY receipt_id, nd""")
def date_consensus(t):
    return ops.date_consensus(t.engine_results)


def item_readings(t):
    """Three readings of every order line: exact, capitals and a little dearer, first letter lost."""
    lines, parts = t.raw("lineitem"), t.raw("part")
    name, price, total = F.col("p_name"), F.round("p_retailprice", 2), F.col("l_extendedprice")
    far = F.when(F.col("l_orderkey") % 13 == 0, price * 12).otherwise(price)

    def reading(engine, label, unit, amount, confidence):
        return F.struct(
            F.lit(engine).alias("engine"),
            label.alias("product_name"),
            F.col("l_quantity").alias("quantity"),
            unit.alias("unit_price"),
            amount.alias("line_total"),
            F.lit(confidence).alias("confidence"),
        )

    readings = F.array(
        reading("tesseract", name, price, total, 0.62),
        reading("easyocr", F.upper(name), price * 1.01, total * 1.01, 0.68),
        reading("paddleocr", F.expr("substring(p_name, 2)"), far, total, 0.55),
    )
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    line = F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")
    return joined.select(F.col("l_orderkey").alias("receipt_id"), line.alias("line"), F.explode(readings).alias("r")).select("receipt_id", "line", "r.*")


@query("con4_item_consensus")
def item_consensus(t):
    return ops.item_consensus(item_readings(t))


def confidences(t):
    readings = t.engine_results
    return ops.overall_confidence(
        ops.vendor_consensus(readings),
        ops.amount_consensus(readings),
        ops.date_consensus(readings),
        ops.item_consensus(item_readings(t)),
        readings.select("receipt_id", "engine").distinct(),
    )


@query("con5_overall_confidence")
def overall_confidence(t):
    return confidences(t)


def merged_lines(t):
    """Consensus lines as they would come out of CON4, one per order line, some with a wrong total."""
    k = F.col("l_orderkey") % 4
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    total = F.when(k == 0, F.col("l_extendedprice") * 2).otherwise(F.col("l_extendedprice"))
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("receipt_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("sku"),
        F.col("l_quantity").alias("quantity"), unit.alias("unit_price"), total.alias("line_total"),
    )


@query("con6_corrected_items", "", f"""SELECT l_orderkey AS receipt_id, l_linenumber AS line, l_partkey AS sku, {r('l_quantity')} AS quantity, {r('l_extendedprice / l_quantity')} AS unit_price,
 {r('CASE WHEN off THEN round_even(l_extendedprice / l_quantity * l_quantity, 2) WHEN l_orderkey % 4 = 0 THEN l_extendedprice * 2 ELSE l_extendedprice END')} AS line_total, off AS is_corrected
 FROM (SELECT *, l_orderkey % 4 = 0 AND l_extendedprice > greatest(l_extendedprice * 0.05, 10) AS off FROM lineitem)""")
def corrected_items(t):
    return ops.corrected_items(merged_lines(t))


@query("con6_corrected_totals", "receipts", f"""WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1), j AS (SELECT receipt_id, total_amount::double AS a, s,
 coalesce(abs(s - total_amount::double) > greatest(total_amount::double * 0.1, 50), false) AS off FROM receipts LEFT JOIN s ON l_orderkey = receipt_id)
 SELECT receipt_id, {r('CASE WHEN off THEN round_even(s, 2) ELSE a END')} AS amount, off AS is_corrected FROM j""")
def corrected_totals(t):
    amounts = t.receipts.select("receipt_id", F.col("total_amount").cast("double").alias("amount"))
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("receipt_id"), F.col("l_extendedprice").alias("line_total"))
    return ops.corrected_totals(amounts, lines)


def corrected_parts(t):
    """Lines, totals and the dates of one engine after correction."""
    amounts = t.receipts.select("receipt_id", F.col("total_amount").cast("double").alias("amount"))
    items = ops.corrected_items(merged_lines(t))
    read = t.engine_results.filter(F.col("engine") == "tesseract").select("receipt_id", "date")
    return items, ops.corrected_totals(amounts, items), ops.corrected_dates(read)


@query("con6_corrected_dates", "engine_results", """SELECT receipt_id, engine, CASE WHEN date LIKE '____-__-__' THEN strftime(strptime(date, '%Y-%m-%d'), '%d/%m/%Y') ELSE date END AS date,
 date LIKE '____-__-__' AS is_corrected FROM engine_results""")
def corrected_dates(t):
    return ops.corrected_dates(t.engine_results.select("receipt_id", "engine", "date"))


@query("con6_applied_corrections", "receipts", """WITH l AS (SELECT l_orderkey AS k, count(*) FILTER (off) AS n, sum(CASE WHEN off THEN round_even(l_extendedprice, 2) WHEN k4 THEN l_extendedprice * 2 ELSE l_extendedprice END) AS s
 FROM (SELECT *, l_orderkey % 4 = 0 AS k4, l_orderkey % 4 = 0 AND l_extendedprice > greatest(l_extendedprice * 0.05, 10) AS off FROM lineitem) GROUP BY 1),
 j AS (SELECT receipt_id, coalesce(n, 0) AS n, coalesce(abs(s - total_amount::double) > greatest(total_amount::double * 0.1, 50), false) AS t FROM receipts LEFT JOIN l ON k = receipt_id)
 SELECT receipt_id, repeat('line_total_calculation|', n) || CASE WHEN t THEN 'total_amount_reconciliation|' ELSE '' END || 'date_normalization' AS corrections, cast(n + t::int + 1 AS int) AS corrections_applied FROM j""")
def applied_corrections(t):
    return ops.applied_corrections(*corrected_parts(t))


@query("con7_disagreements", "engine_results", """WITH s AS (SELECT receipt_id, count(DISTINCT vendor) AS v, max(total_amount)::double AS hi, min(total_amount)::double AS lo FROM engine_results GROUP BY 1)
 SELECT receipt_id, array_to_string(list_filter([CASE WHEN v > 1 THEN 'vendor_disagreement' END, CASE WHEN (hi - lo) / hi > 0.1 THEN 'total_amount_disagreement' END], lambda x: x IS NOT NULL), '|') AS disagreements,
 CASE WHEN receipt_id % 5 < 2 THEN 'low_vendor_confidence' ELSE '' END AS low_confidence FROM s""")
def disagreements(t):
    k = F.col("receipt_id")
    known = t.receipts.select(
        "receipt_id",
        F.when(k % 5 < 2, 0.4).otherwise(0.6).alias("vendor_confidence"),
        F.lit(0.7).alias("amount_confidence"),
        F.lit(0.9).alias("items_confidence"),
    )
    return ops.disagreements(t.engine_results, known)


@query("con8_final_confidence", "receipts", f"""WITH s AS (SELECT receipt_id, least(1.0, (receipt_id % 101)::double / 100 * 0.4 + CASE WHEN receipt_id % 3 = 0 THEN 0.6 ELSE 0.9 END * 0.3
 + CASE WHEN receipt_id % 4 = 0 THEN 0.5 ELSE 0.95 END * 0.2 + least((receipt_id % 6) * 0.05, 0.15) + CASE WHEN receipt_id % 2 = 0 THEN 0.1 ELSE 0 END) AS f FROM receipts)
 SELECT receipt_id, {r('f')} AS final_confidence, f >= 0.8501 AS fully_automated FROM s""")
def final_confidence(t):
    k = F.col("receipt_id")
    results = t.receipts.select(
        "receipt_id",
        ((k % 101) / 100.0).alias("confidence"),
        F.when(k % 3 != 0, 0.9).alias("validation_confidence"),
        F.when(k % 4 != 0, 0.95).alias("category_confidence"),
        (k % 6).alias("corrections_applied"),
        (k % 2 == 0).alias("validation_passed"),
    )
    return ops.final_confidence(results, 0.8501)
