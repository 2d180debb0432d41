"""Queries REC1 to REC3.

Order totals and line prices of the given tables are unrelated, so the declared
total is derived from the lines: exact, 3 % off, 8 % off or far off by receipt.
"""

from pyspark.sql import functions as F

from spendlake.operators import reconcile as ops
from spendlake.plans.bindings import r
from spendlake.plans.registry import query


def declared(t):
    """Receipts whose declared total is the line sum times a factor; some have no products at all."""
    factor = F.element_at(F.array(*[F.lit(x).cast("decimal(3,2)") for x in ("1.00", "1.03", "0.92", "1.15", "2.00")]), (F.col("receipt_id") % 5 + 1).cast("int"))
    sums = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("receipt_id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("_s"))
    rows = t.receipts.select("receipt_id").join(sums, "receipt_id", "left")
    amount = F.coalesce(F.col("_s"), F.lit(5000)).cast("decimal(18,2)") * factor
    return rows.select("receipt_id", amount.cast("decimal(18,2)").alias("total_amount"))


DECLARED = """declared AS (SELECT r.receipt_id, cast(coalesce(s, 5000)::decimal(14,2) * CASE r.receipt_id % 5 WHEN 0 THEN 1.00 WHEN 1 THEN 1.03
 WHEN 2 THEN 0.92 WHEN 3 THEN 1.15 ELSE 2.00 END::decimal(3,2) AS decimal(18,2)) AS declared FROM receipts r LEFT JOIN
 (SELECT l_orderkey AS receipt_id, sum(cast(l_extendedprice AS decimal(18,2))) AS s FROM lineitem GROUP BY 1) l ON r.receipt_id = l.receipt_id),
 items AS (SELECT receipt_id, sum(total_price) AS calc, count(*) AS n, avg(confidence) AS conf FROM receipt_products GROUP BY 1)"""


@query("rec1_validated_totals", "receipts receipt_products", f"""WITH {DECLARED}, j AS (SELECT d.receipt_id, declared, coalesce(calc, 0) AS calc, coalesce(n, 0) AS n,
 coalesce(conf, 0) AS conf, abs(coalesce(calc, 0)::double - declared::double) AS gap FROM declared d LEFT JOIN items i ON d.receipt_id = i.receipt_id),
 s AS (SELECT *, CASE WHEN declared > 0 THEN gap / declared::double * 100 ELSE 100 END AS share FROM j)
 SELECT receipt_id, {r('declared')} AS declared_total, {r('calc')} AS calculated_total, {r('gap')} AS difference, {r('share')} AS difference_percentage,
 n AS products_count, {r('conf')} AS average_confidence, share <= 5 AS is_valid, CASE WHEN n = 0 THEN 'No se encontraron productos extraídos'
 WHEN calc = 0 THEN 'No se pudieron calcular precios de productos' WHEN share > 10 THEN 'Diferencia significativa entre productos y total' ELSE '' END AS issues,
 CASE WHEN share <= 5 AND conf > 0.8 THEN 'auto_approve' ELSE 'manual_review' END AS recommendation FROM s""")
def validated_totals(t):
    return ops.validated_totals(declared(t), t.receipt_products)


ITEMS = f"{DECLARED}, j AS (SELECT p.*, declared::double AS d, calc::double AS c FROM receipt_products p JOIN declared d ON p.receipt_id = d.receipt_id JOIN items i ON p.receipt_id = i.receipt_id)"


@query("rec2_proportional", "receipts receipt_products", f"""WITH {ITEMS} SELECT receipt_id, line,
 {r('CASE WHEN abs(c - d) > d * 0.1 AND c > 0 AND total_price <> 0 THEN round_even(total_price::double * (d / c), 0) ELSE total_price END')} AS total_price,
 {r('CASE WHEN abs(c - d) > d * 0.1 AND c > 0 AND unit_price <> 0 THEN round_even(unit_price::double * (d / c), 0) ELSE unit_price END')} AS unit_price,
 abs(c - d) > d * 0.1::double AS reconciliation_needed, {r('d - c')} AS difference FROM j""")
def proportional(t):
    return ops.proportional(declared(t), t.receipt_products)


@query("rec3_bounded", "receipts receipt_products", f"""WITH {ITEMS} SELECT receipt_id, line,
 {r('CASE WHEN abs(d - c) < d * 0.1 AND c > 0 THEN total_price::double + total_price::double / c * (d - c) ELSE total_price END')} AS total_price,
 abs(d - c) < d * 0.1::double AS success, {r('CASE WHEN abs(d - c) < d * 0.1 THEN d - c END')} AS adjustment_applied FROM j""")
def bounded(t):
    return ops.bounded(declared(t), t.receipt_products)


@query("rec3_factor_bounded", "receipts receipt_products", f"""WITH {ITEMS} SELECT receipt_id, line,
 {r('CASE WHEN d / c BETWEEN 0.8 AND 1.2 THEN total_price::double * (d / c) ELSE total_price END')} AS total_price,
 d / c BETWEEN 0.8 AND 1.2 AS success, {r('d / c')} AS factor FROM j""")
def factor_bounded(t):
    return ops.factor_bounded(declared(t), t.receipt_products)
