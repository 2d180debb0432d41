"""Queries LIM1 to LIM7."""

from pyspark.sql import functions as F

from spendlake.operators import limits as ops
from spendlake.plans.bindings import d, r
from spendlake.plans.registry import query

# A Wednesday in the second half of a month, so that all periods differ.
NOW = "2001-06-20"
NOW_SQL = "timestamp '2001-06-20'"


@query("lim1_limit_periods", "spending_limits", f"""SELECT limit_id, limit_type, CASE limit_type WHEN 'weekly' THEN '2001-06-18 00:00:00'
 WHEN 'yearly' THEN '2001-01-01 00:00:00' ELSE '2001-06-01 00:00:00' END AS period_start FROM spending_limits""")
def limit_periods(t):
    return ops.period_table(t.spending_limits, NOW).select("limit_id", "limit_type", "period_start")


@query("lim2_usage", "receipts users", f"""WITH c AS (SELECT user_id, coalesce(category, 'Otros') AS category, sum(total_amount) AS s, count(*) AS n FROM receipts
 WHERE created_at BETWEEN timestamp '2001-06-01' AND {NOW_SQL} GROUP BY ALL),
 w AS (SELECT *, sum(s) OVER (PARTITION BY user_id) AS whole FROM c),
 u AS (SELECT user_id, sum(s) AS s, sum(n) AS n, string_agg(category || '=' || s || '=' || cast(round_even(s::double / whole::double * 100, 2) AS varchar), '|' ORDER BY category) AS cats
 FROM w GROUP BY 1)
 SELECT users.user_id, name, {r('coalesce(s, 0)')} AS total_spent, cast(coalesce(n, 0) AS bigint) AS transaction_count, coalesce(cats, '') AS categories
 FROM users LEFT JOIN u ON users.user_id = u.user_id""")
def usage(t):
    cell = lambda c: F.concat_ws("=", c["category"], c["amount"].cast("string"), c["percentage"].cast("string"))
    rows = ops.usage(t.receipts_between(since="2001-06-01"), t.users, NOW)
    return rows.withColumn("categories", F.transform("categories", cell))


USED = f"""used AS (SELECT user_id, coalesce(sum(total_amount) FILTER (created_at >= timestamp '2001-06-18'), 0) AS weekly,
 coalesce(sum(total_amount) FILTER (created_at >= timestamp '2001-06-01'), 0) AS monthly, sum(total_amount) AS yearly FROM receipts
 WHERE created_at BETWEEN timestamp '2001-01-01' AND {NOW_SQL} GROUP BY 1),
 lim AS (SELECT l.*, coalesce(CASE limit_type WHEN 'weekly' THEN weekly WHEN 'monthly' THEN monthly ELSE yearly END, 0) AS spent
 FROM spending_limits l LEFT JOIN used ON employee_id = used.user_id WHERE is_active)"""


@query("lim3_limit_status", "receipts spending_limits", f"""WITH {USED}, s AS (SELECT *, CASE WHEN limit_amount > 0 THEN spent::double / limit_amount::double * 100 ELSE 0 END AS p FROM lim)
 SELECT limit_id, employee_id, limit_type, {r('limit_amount')} AS limit_amount, {r('spent')} AS current_usage, {r('round_even(p, 2)')} AS usage_percentage,
 p > 100 AS is_exceeded, CASE limit_type WHEN 'weekly' THEN 5 WHEN 'monthly' THEN 11 ELSE 195 END AS days_until_reset FROM s""")
def limit_status(t):
    return ops.limit_status(t.receipts_between(since="2001-01-01"), t.spending_limits, NOW)


@query("lim4_transaction_validation", "receipts spending_limits", f"""WITH {USED}, a AS (SELECT r.receipt_id, limit_id, spent::double + total_amount::double AS after, limit_amount::double AS l
 FROM receipts r JOIN lim ON r.user_id = employee_id AND (NOT retail_only OR category IS NULL OR category = 'Retail')),
 g AS (SELECT receipt_id, string_agg(limit_id, '|' ORDER BY limit_id) FILTER (after > l) AS e,
 string_agg(limit_id, '|' ORDER BY limit_id) FILTER (after <= l AND CASE WHEN l > 0 THEN after / l * 100 ELSE 0 END > 80) AS w FROM a GROUP BY 1)
 SELECT r.receipt_id, user_id, {r('total_amount')} AS total_amount, coalesce(e, '') AS exceeded_limits, coalesce(w, '') AS warnings, e IS NULL AS is_valid
 FROM receipts r LEFT JOIN g ON r.receipt_id = g.receipt_id""")
def transaction_validation(t):
    return ops.validate_transactions(t.receipts, t.spending_limits, t.receipts_between(since="2001-01-01"), NOW)


@query("lim5_bulk_limits", "users receipts", f"""SELECT user_id AS employee_id, name AS employee_name, email AS employee_email, 'weekly' AS limit_type,
 {r('250000')} AS limit_amount, 'CLP' AS currency, 'Retail|Comida' AS category_restrictions, true AS is_active, employer_id AS created_by
 FROM users WHERE employer_id = 6 AND user_id IN (SELECT user_id FROM receipts WHERE total_amount > 400000)""")
def bulk_limits(t):
    requested = t.receipts.filter(F.col("total_amount") > 400_000)
    return ops.bulk_limits(requested, t.users, 6, "weekly", 250_000, ("Retail", "Comida"))


@query("lim6_limit_alerts", "receipts spending_limits", f"""WITH u AS (SELECT user_id, coalesce(sum(total_amount) FILTER (created_at >= timestamp '2001-06-01'), 0) AS m,
 coalesce(sum(total_amount) FILTER (created_at >= {NOW_SQL} - interval 7 day), 0) AS o FROM receipts WHERE created_at BETWEEN timestamp '2001-06-01' AND {NOW_SQL} GROUP BY 1),
 p AS (SELECT l.*, CASE WHEN limit_type = 'monthly' THEN m ELSE o END AS spent FROM spending_limits l JOIN u ON employee_id = user_id WHERE is_active),
 s AS (SELECT *, CASE WHEN limit_amount > 0 THEN spent::double / limit_amount::double * 100 ELSE 0 END AS share FROM p)
 SELECT limit_id, employee_id, limit_type, CASE WHEN share > 100 THEN 'high' ELSE 'medium' END AS severity, {r('limit_amount')} AS limit_amount,
 {r('spent')} AS current_usage, {r('share')} AS usage_percentage FROM s WHERE share > 90""")
def limit_alerts(t):
    return ops.limit_alerts(t.receipts_between(since="2001-06-01"), t.spending_limits, NOW)


@query("lim7_category_concentration", "receipts", f"""WITH c AS (SELECT user_id, category, sum(total_amount) AS s, count(*) AS n FROM receipts
 WHERE created_at BETWEEN {NOW_SQL} - interval 30 day AND {NOW_SQL} GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, category NULLS FIRST) AS rn FROM c),
 w AS (SELECT *, s::double / (sum(s) OVER (PARTITION BY user_id))::double AS share FROM k WHERE rn <= 3)
 SELECT user_id, category, {r('s')} AS amount, {r('share * 100')} AS percentage, n AS transaction_count FROM w WHERE rn = 1 AND share > 0.5""")
def category_concentration(t):
    return ops.category_concentration(t.receipts_between(since="2001-05-21"), NOW)
