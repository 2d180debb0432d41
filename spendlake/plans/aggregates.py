"""Queries AGG1 to AGG33."""

from pyspark.sql import functions as F

from spendlake.operators import aggregates as ops
from spendlake.operators import fuel
from spendlake.operators.joins import with_categories
from spendlake.plans.bindings import RECEIPTS_AS_OF as NOW
from spendlake.plans.bindings import r
from spendlake.plans.filters import QUEUE_SQL, queue
from spendlake.plans.registry import query
from spendlake.sources.canonical import RECEIPTS_AS_OF as AS_OF

IN_MONTH = f"date BETWEEN {NOW} - interval 30 day AND {NOW}"
COMPANY = f"base AS (SELECT r.*, u.employer_id, u.name, u.department FROM receipts r JOIN users u ON r.user_id = u.user_id WHERE {IN_MONTH})"


def recent(t, days):
    """Receipts from ``days`` before the report time on, with the day bound pushed to the scan."""
    from datetime import timedelta

    from spendlake.functions.core import moment

    return t.receipts_between(since=moment(AS_OF) - timedelta(days=days))


@query("agg1_status_stats", "receipts", f"""SELECT user_id, count(*) AS total_receipts,
 count(*) FILTER (status = 'en_revision') AS en_revision, count(*) FILTER (status = 'aceptada') AS aceptadas,
 count(*) FILTER (status = 'rechazada') AS rechazadas,
 {r("coalesce(sum(total_amount) FILTER (status = 'aceptada'), 0)")} AS total_amount FROM receipts GROUP BY user_id""")
def status_stats(t):
    return ops.status_stats(t.receipts)


@query("agg2_month_to_date", "receipts", f"""SELECT user_id, {r('sum(total_amount)')} AS total_amount, count(*) AS total_receipts,
 {r('sum(total_amount)::double / count(*)')} AS avg_amount FROM receipts WHERE date >= timestamp '2001-07-01' GROUP BY user_id""")
def month_to_date(t):
    return ops.month_to_date(t.receipts_between(since="2001-07-01"), "2001-07-31")


MONTHS_SQL = f"""months AS (SELECT r.user_id, coalesce(c.category, 'Sin categoría') AS category, year(date) AS year, month(date) AS month,
 sum(total_amount) AS total, count(*) AS n FROM receipts r LEFT JOIN categories c ON r.receipt_id = c.receipt_id
 WHERE date >= {NOW} - interval 180 day GROUP BY ALL)"""


def months(t):
    return ops.category_months(with_categories(recent(t, 180), t.categories), AS_OF)


@query("agg3_category_months", "receipts categories", f"""WITH {MONTHS_SQL} SELECT user_id, category, year, month,
 {r('total')} AS total, n AS count, {r('total::double / n')} AS average FROM months""")
def category_months(t):
    return months(t)


@query("agg4_month_growth", "receipts categories", f"""WITH {MONTHS_SQL}, steps AS (SELECT *, lag(total) OVER w AS previous,
 row_number() OVER (PARTITION BY user_id, category ORDER BY year DESC, month DESC) AS back,
 count(*) OVER (PARTITION BY user_id, category) AS data_points FROM months
 WINDOW w AS (PARTITION BY user_id, category ORDER BY year, month)),
 g AS (SELECT *, CASE WHEN previous > 0 THEN (total::double - previous::double) / previous::double * 100 ELSE 0 END AS growth
 FROM steps WHERE back = 1 AND data_points >= 2)
 SELECT user_id, category, {r('total')} AS current_month, {r('previous')} AS previous_month, {r('growth')} AS growth_percentage,
 CASE WHEN growth > 5 THEN 'increasing' WHEN growth < -5 THEN 'decreasing' ELSE 'stable' END AS trend_direction, data_points FROM g""")
def month_growth(t):
    return ops.month_growth(months(t))


PERIOD_SQL = f"""b AS (SELECT employer_id, r.user_id, total_amount, date >= {NOW} - interval 30 day AS cur, date <= {NOW} - interval 30 day AS prev
 FROM receipts r JOIN users u ON r.user_id = u.user_id WHERE date BETWEEN {NOW} - interval 60 day AND {NOW}),
 p AS (SELECT employer_id, coalesce(sum(total_amount) FILTER (cur), 0) AS cur_total, coalesce(sum(total_amount) FILTER (prev), 0) AS prev_total,
 count(*) FILTER (cur) AS receipts, count(DISTINCT user_id) FILTER (cur) AS active FROM b GROUP BY 1),
 period AS (SELECT *, CASE WHEN prev_total > 0 THEN (cur_total::double - prev_total::double) / prev_total::double * 100 ELSE 0 END AS growth FROM p)"""


@query("agg5_period_comparison", "receipts users", f"""WITH {PERIOD_SQL} SELECT employer_id, {r('cur_total')} AS total_expenses,
 {r('prev_total')} AS previous_expenses, receipts AS total_receipts, active AS active_employees, {r('growth')} AS growth_rate FROM period""")
def period_comparison(t):
    return ops.period_comparison(recent(t, 60), t.users, AS_OF)


@query("agg6_employee_ranking", "receipts users", f"""WITH {COMPANY} SELECT user_id, employer_id, name, department,
 {r('sum(total_amount)')} AS total_amount, count(*) AS receipt_count, {r('sum(total_amount)::double / count(*)')} AS avg_per_receipt
 FROM base GROUP BY user_id, employer_id, name, department QUALIFY row_number() OVER (PARTITION BY employer_id ORDER BY sum(total_amount) DESC, user_id) <= 10""")
def employee_ranking(t):
    return ops.employee_ranking(recent(t, 30), t.users, AS_OF, top=10)


@query("agg7_category_breakdown", "receipts users", f"""WITH {COMPANY} SELECT employer_id, category,
 {r('sum(total_amount)')} AS total_amount, count(*) AS receipt_count FROM base GROUP BY ALL""")
def category_breakdown(t):
    return ops.category_breakdown(recent(t, 30), t.users, AS_OF)


@query("agg8_department_summary", "receipts users", f"""WITH {COMPANY} SELECT employer_id, department,
 {r('sum(total_amount)')} AS total_amount, count(*) AS receipt_count, count(DISTINCT user_id) AS employee_count,
 {r('sum(total_amount)::double / count(DISTINCT user_id)')} AS avg_per_employee FROM base GROUP BY ALL""")
def department_summary(t):
    return ops.department_summary(recent(t, 30), t.users, AS_OF)


@query("agg9_weekly_trend", "receipts users", f"""WITH {COMPANY} SELECT employer_id, year(date) AS year,
 cast(strftime(date, '%U') AS bigint) AS week, {r('sum(total_amount)')} AS total_amount, count(*) AS receipt_count
 FROM base GROUP BY ALL""")
def weekly_trend(t):
    return ops.weekly_trend(recent(t, 30), t.users, AS_OF)


OVERVIEW_SQL = f"""{PERIOD_SQL}, overview AS (SELECT u.employer_id, u.n AS total_employees, coalesce(cur_total, 0) AS cur_total,
 coalesce(prev_total, 0) AS prev_total, coalesce(receipts, 0) AS receipts, coalesce(active, 0) AS active, coalesce(growth, 0) AS growth,
 coalesce(cur_total, 0)::double / u.n AS avg_per_employee
 FROM (SELECT employer_id, count(*) AS n FROM users GROUP BY 1) u LEFT JOIN period ON period.employer_id = u.employer_id)"""


@query("agg10_company_overview", "receipts users", f"""WITH {OVERVIEW_SQL} SELECT employer_id, total_employees,
 {r('cur_total')} AS total_expenses, {r('prev_total')} AS previous_expenses, receipts AS total_receipts,
 active AS active_employees, {r('growth')} AS growth_rate, {r('avg_per_employee')} AS avg_per_employee FROM overview""")
def company_overview(t):
    return ops.company_overview(recent(t, 60), t.users, AS_OF)


@query("agg11_company_alerts", "receipts users", f"""WITH {OVERVIEW_SQL}, top AS (SELECT employer_id, max(s) AS s FROM (
 SELECT employer_id, user_id, sum(total_amount) AS s FROM b WHERE cur GROUP BY 1, 2) GROUP BY 1)
 SELECT employer_id, 'warning' AS type, 'high' AS severity, {r('growth')} AS value FROM overview WHERE growth > 20
 UNION ALL SELECT o.employer_id, 'info', 'medium', {r('s')} FROM overview o JOIN top ON top.employer_id = o.employer_id
 WHERE s::double > avg_per_employee * 2""")
def company_alerts(t):
    return ops.company_alerts(recent(t, 60), t.users, AS_OF)


@query("agg12_headline", "receipts users", f"""WITH {COMPANY}, cells AS (
 SELECT employer_id, 'Empleado Más Activo' AS title, name AS value, sum(total_amount) AS s FROM base GROUP BY employer_id, user_id, name
 UNION ALL SELECT employer_id, 'Categoría Principal', category, sum(total_amount) FROM base WHERE category IS NOT NULL GROUP BY 1, 3
 UNION ALL SELECT employer_id, 'Departamento Más Activo', department, sum(total_amount) FROM base GROUP BY 1, 3)
 SELECT employer_id, title, value, {r('s')} AS total_amount FROM cells
 QUALIFY row_number() OVER (PARTITION BY employer_id, title ORDER BY s DESC, value DESC) = 1""")
def headline(t):
    return ops.headline(recent(t, 30), t.users, AS_OF)


@query("agg13_employee_performance", "receipts users", f"""WITH s AS (SELECT user_id, sum(total_amount) AS s, count(*) AS n FROM receipts
 WHERE {IN_MONTH} GROUP BY 1), c AS (SELECT employer_id, sum(s)::double / count(s) AS company_avg FROM users u JOIN s ON u.user_id = s.user_id GROUP BY 1)
 SELECT u.user_id, name, department, {r('coalesce(s, 0)')} AS total_spent, coalesce(n, 0) AS receipt_count,
 {r('coalesce(s::double / n, 0)')} AS avg_per_receipt, {r('coalesce(company_avg, 0)')} AS company_avg
 FROM users u LEFT JOIN s ON u.user_id = s.user_id LEFT JOIN c ON u.employer_id = c.employer_id""")
def employee_performance(t):
    return ops.employee_performance(recent(t, 30), t.users, AS_OF)


@query("agg14_employer_facets", "receipts users", f"""WITH base AS (SELECT employer_id, r.user_id, coalesce(category, 'Sin categoría') AS category,
 strftime(date, '%Y-%m') AS month, total_amount FROM receipts r JOIN users u ON r.user_id = u.user_id WHERE date >= {NOW} - interval 90 day)
 SELECT employer_id, user_id, category, month, CASE WHEN grouping(user_id) = 0 THEN 'employee' WHEN grouping(category) = 0 THEN 'category'
 WHEN grouping(month) = 0 THEN 'month' ELSE 'general' END AS facet, count(*) AS count, {r('sum(total_amount)')} AS total,
 {r('sum(total_amount)::double / count(*)')} AS avg FROM base
 GROUP BY GROUPING SETS ((employer_id), (employer_id, user_id), (employer_id, category), (employer_id, month))""")
def employer_facets(t):
    return ops.employer_facets(recent(t, 90), t.users, AS_OF, 90)


@query("agg15_category_share", "receipts users", f"""WITH {COMPANY}, cells AS (SELECT employer_id,
 coalesce(category, 'Sin categoría') AS category, sum(total_amount) AS s, count(*) AS n FROM base GROUP BY ALL)
 SELECT employer_id, category, {r('s')} AS total_amount, n AS receipt_count,
 {r('round_even(s::double / (sum(s) OVER (PARTITION BY employer_id))::double * 100, 2)')} AS percentage FROM cells
 QUALIFY row_number() OVER (PARTITION BY employer_id ORDER BY s DESC, category) <= 10""")
def category_share(t):
    return ops.category_share(recent(t, 30), t.users, AS_OF)


@query("agg16_department_breakdown", "receipts users", f"""WITH s AS (SELECT user_id, sum(total_amount) AS s, count(*) AS n
 FROM receipts WHERE {IN_MONTH} GROUP BY 1) SELECT employer_id, department, count(*) AS employee_count,
 {r('coalesce(sum(s), 0)')} AS total_amount, cast(coalesce(sum(n), 0) AS bigint) AS receipts_count,
 {r('coalesce(sum(s), 0)::double / count(*)')} AS average_per_employee
 FROM users u LEFT JOIN s ON u.user_id = s.user_id GROUP BY ALL""")
def department_breakdown(t):
    return ops.department_breakdown(recent(t, 30), t.users, AS_OF)


@query("agg17_employee_rollup", "receipts users", f"""SELECT employer_id, u.user_id, grouping(u.user_id) = 1 AS is_total,
 count(receipt_id) AS receipt_count, {r('coalesce(sum(total_amount), 0)')} AS total_amount
 FROM users u LEFT JOIN receipts r ON u.user_id = r.user_id GROUP BY GROUPING SETS ((employer_id, u.user_id), (employer_id))""")
def employee_rollup(t):
    return ops.employee_rollup(t.receipts, t.users)


@query("agg18_categorisation_stats", "categories", """SELECT category, count(*) AS count, count(*) FILTER (user_corrected) AS corrected,
 count(*) FILTER (NOT user_corrected) AS automatic FROM categories GROUP BY category""")
def categorisation_stats(t):
    return ops.categorisation_stats(t.categories)


@query("agg19_product_stats", "receipt_products", f"""SELECT receipt_id, count(*) AS total_products,
 {r('coalesce(sum(total_price) FILTER (total_price > 0), 0)')} AS total_value, {r('avg(confidence)')} AS average_confidence,
 count(*) FILTER (extraction_method = 'advanced_parser') AS advanced_parser,
 count(*) FILTER (extraction_method = 'manual_entry') AS manual_entry,
 count(*) FILTER (extraction_method = 'manual_correction') AS manual_correction,
 array_to_string(list_sort(list(DISTINCT category)), '|') AS categories FROM receipt_products GROUP BY receipt_id""")
def product_stats(t):
    return ops.product_stats(t.receipt_products)


@query("agg20_notification_stats", "notifications", """SELECT user_id, type, priority, count(*) AS total,
 count(*) FILTER (NOT is_read) AS unread, count(*) FILTER (is_read) AS read FROM notifications
 GROUP BY GROUPING SETS ((user_id), (user_id, type), (user_id, priority))""")
def notification_stats(t):
    return ops.notification_stats(t.notifications)


@query("agg21_invitation_stats", "invitations", f"""SELECT employer_id, count(*) AS total_sent, count(*) FILTER (status = 'pending') AS pending,
 count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'expired') AS expired,
 count(*) FILTER (status = 'cancelled') AS cancelled,
 {r("round_even(count(*) FILTER (status = 'accepted')::double / count(*) * 100, 2)")} AS acceptance_rate
 FROM invitations GROUP BY employer_id""")
def invitation_stats(t):
    return ops.invitation_stats(t.invitations)


@query("agg22_budget_advice", "receipts categories", f"""WITH cells AS (SELECT r.user_id, c.category, sum(total_amount) AS s
 FROM receipts r JOIN categories c ON r.receipt_id = c.receipt_id GROUP BY ALL),
 shares AS (SELECT *, s::double / (sum(s) OVER (PARTITION BY user_id))::double * 100 AS p FROM cells)
 SELECT user_id, category, {r('s')} AS total, {r('p')} AS current_percentage,
 {r("CASE category WHEN 'Combustible' THEN 20 ELSE 25 END")} AS recommended_percentage,
 CASE category WHEN 'Combustible' THEN 'Considera usar transporte público o compartir viajes' ELSE 'Considera cocinar más en casa' END AS message
 FROM shares WHERE (category = 'Combustible' AND p > 25) OR (category = 'Comida' AND p > 30)""")
def budget_advice(t):
    return ops.budget_advice(t.receipts, t.categories)


@query("agg23_personal_dashboard", "receipts", f"""WITH s AS (SELECT user_id, count(*) AS total_receipts, sum(total_amount) AS s,
 coalesce(sum(total_amount) FILTER (date >= {NOW} - interval 30 day), 0) AS cur,
 coalesce(sum(total_amount) FILTER (date >= {NOW} - interval 60 day AND date < {NOW} - interval 30 day), 0) AS prev FROM receipts GROUP BY 1)
 SELECT user_id, total_receipts, {r('s')} AS total_amount, {r('cur')} AS this_month, {r('prev')} AS last_month,
 {r('s::double / total_receipts')} AS average_receipt, CASE WHEN cur::double > prev::double * 1.1::double THEN 'up'
 WHEN cur::double < prev::double * 0.9::double THEN 'down' ELSE 'stable' END AS monthly_trend FROM s""")
def personal_dashboard(t):
    return ops.personal_dashboard(t.receipts, AS_OF)


@query("agg23_personal_categories", "receipts", f"""WITH cells AS (SELECT user_id, coalesce(category, 'Sin categoría') AS category,
 sum(total_amount) FILTER (date >= {NOW} - interval 365 day) AS amount, count(*) FILTER (date >= {NOW} - interval 365 day) AS n,
 sum(total_amount) AS s FROM receipts GROUP BY ALL), w AS (SELECT *, sum(s) OVER (PARTITION BY user_id) AS whole FROM cells)
 SELECT user_id, category, {r('amount')} AS amount, n AS count, {r('amount::double / whole::double * 100')} AS percentage FROM w WHERE n > 0""")
def personal_categories(t):
    return ops.personal_categories(t.receipts, AS_OF, 365)


@query("agg24_approval_pivot", "approvals users", """SELECT employer_id, count(*) AS total, count(*) FILTER (status = 'aceptada') AS approved,
 count(*) FILTER (status = 'rechazada') AS rejected, count(*) FILTER (status = 'en_revision') AS pending
 FROM approvals a JOIN users u ON a.user_id = u.user_id WHERE workflow_id = 2 AND created_at >= timestamp '1999-01-01' GROUP BY 1""")
def approval_pivot(t):
    return ops.approval_pivot(t.approvals, t.users, workflow_id=2, since="1999-01-01")


def decisions(t):
    """Decision log: shipments stand for the hour a line of the order was decided."""
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("instance_id"), F.col("l_shipdate").cast("timestamp").alias("decided_at")
    )


@query("agg25_approval_times", "approvals", f"""WITH first AS (SELECT l_orderkey AS instance_id, min(l_shipdate) AS decided_at FROM lineitem GROUP BY 1)
 SELECT approver_id, count(*) AS total, count(decided_at) AS decided,
 {r('avg((epoch(decided_at) - epoch(created_at)) / 3600.0)')} AS average_approval_hours,
 {r('count(*) FILTER (escalation_count > 0)::double / count(*) * 100')} AS escalation_rate
 FROM approvals a LEFT JOIN first ON a.instance_id = first.instance_id GROUP BY 1""")
def approval_times(t):
    return ops.approval_times(t.approvals, decisions(t))


@query("agg25_approval_rates", "approvals receipts", f"""WITH b AS (SELECT coalesce(category, 'Sin categoría') AS category,
 CASE WHEN total_amount < 100000 THEN 'under_100k' WHEN total_amount <= 500000 THEN '100k_500k' ELSE 'over_500k' END AS band, a.status
 FROM approvals a JOIN receipts r ON a.receipt_id = r.receipt_id WHERE a.status IN ('aceptada', 'rechazada'))
 SELECT category, band, count(*) AS decided, {r("count(*) FILTER (status = 'aceptada')::double / count(*) * 100")} AS approval_rate
 FROM b GROUP BY GROUPING SETS ((category), (band))""")
def approval_rates(t):
    return ops.approval_rates(t.approvals, t.receipts)


@query("agg25_top_approvers", "approvals", """SELECT approver_id, count(*) AS decisions FROM approvals
 WHERE status IN ('aceptada', 'rechazada') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def top_approvers(t):
    return ops.top_approvers(t.approvals)


@query("agg26_category_report", "receipts users", f"""WITH {QUEUE_SQL} SELECT category, count(*) AS count, {r('sum(total_amount)')} AS total_amount,
 cast(floor(sum(total_amount)::double / count(*) + 0.5) AS bigint) AS average_amount,
 {r('round(count(*)::double / (sum(count(*)) OVER ())::double * 100, 1)')} AS percentage FROM queue GROUP BY category""")
def category_report(t):
    return ops.category_report(queue(t))


@query("agg27_month_report", "receipts users", f"""WITH {QUEUE_SQL} SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS count,
 {r('sum(total_amount)')} AS total_amount FROM queue GROUP BY 1""")
def month_report(t):
    return ops.month_report(queue(t))


@query("agg28_export_header", "receipts users", f"""WITH {QUEUE_SQL} SELECT count(*) AS total_approvals, {r('sum(total_amount)')} AS total_amount,
 {r('sum(total_amount)::double / count(*)')} AS avg_amount, count(DISTINCT category) AS unique_categories FROM queue""")
def export_header(t):
    return ops.export_header(queue(t))


@query("agg29_receipt_list_report", "receipts", f"""WITH p AS (SELECT l_orderkey AS receipt_id, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT user_id, {r('sum(total_amount)')} AS total_amount, cast(sum(coalesce(n, 0)) AS bigint) AS total_items, count(*) AS receipts
 FROM receipts r LEFT JOIN p ON r.receipt_id = p.receipt_id GROUP BY 1""")
def receipt_list_report(t):
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    nested = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("receipt_id")).agg(F.collect_list(item).alias("products"))
    return ops.receipt_list_report(t.receipts.join(nested, "receipt_id", "left"))


FUEL_COST_SQL = """costs AS (SELECT *, distance_km / CASE vehicle_type WHEN 'economico' THEN 15 WHEN 'intermedio' THEN 10 ELSE 8 END AS fuel_needed,
 CASE fuel_type WHEN 'gasolina_93' THEN 1267 WHEN 'gasolina_95' THEN 1305 WHEN 'gasolina_97' THEN 1335 ELSE 1074 END AS price_per_liter
 FROM fuel_expenses)"""


@query("agg30_fuel_totals", "fuel_expenses", f"""WITH {FUEL_COST_SQL} SELECT user_id, count(*) AS total_expenses,
 {r('sum(fuel_needed * price_per_liter)')} AS total_amount, {r('sum(distance_km)')} AS total_distance,
 {r('sum(fuel_needed)')} AS total_fuel_liters,
 {r('sum(fuel_needed * price_per_liter) / sum(distance_km)')} AS average_cost_per_km FROM costs GROUP BY 1""")
def fuel_totals(t):
    return ops.fuel_totals(fuel.costs(t.fuel_expenses))


def stations(t):
    """Suppliers as fuel stations: region from the nation, prices from the account balance."""
    price = F.round(900 + F.abs(F.col("s_acctbal")) / 20)
    region = F.concat(F.lit("Region "), (F.col("s_nationkey") % 7).cast("string"))
    return t.raw("supplier").select(
        F.col("s_suppkey").alias("station_id"),
        region.alias("region"),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit(0.0)).otherwise(price).alias("gasolina_93"),
        (price + 25).alias("gasolina_95"),
        F.when(F.col("s_suppkey") % 7 != 0, price + 50).alias("gasolina_97"),
        (price - 230).alias("diesel"),
    )


@query("agg31_regional_prices", "", """WITH st AS (SELECT s_suppkey AS id, 'Region ' || (s_nationkey % 7) AS region,
 round(900 + abs(s_acctbal) / 20) AS p FROM supplier), long AS (
 SELECT region, 'gasolina_93' AS fuel_type, CASE WHEN id % 5 = 0 THEN 0 ELSE p END AS price FROM st
 UNION ALL SELECT region, 'gasolina_95', p + 25 FROM st
 UNION ALL SELECT region, 'gasolina_97', CASE WHEN id % 7 <> 0 THEN p + 50 END FROM st
 UNION ALL SELECT region, 'diesel', p - 230 FROM st)
 SELECT fuel_type, cast(floor(avg(price) + 0.5) AS bigint) AS price, count(*) AS stations FROM long
 WHERE contains(lower(region), 'gion 3') AND price > 0 GROUP BY 1""")
def regional_prices(t):
    return ops.regional_prices(stations(t), "GION 3", ["gasolina_93", "gasolina_95", "gasolina_97", "diesel"])


@query("agg32_approver_digest", "approvals receipts", f"""SELECT approver_id, count(*) AS pending_count, {r('sum(total_amount)')} AS total_amount,
 count(*) FILTER (due_date < {NOW}) AS overdue_count, count(*) FILTER (total_amount > 500000) AS urgent_count
 FROM approvals a JOIN receipts r ON a.receipt_id = r.receipt_id WHERE a.status = 'en_revision' GROUP BY 1""")
def approver_digest(t):
    return ops.approver_digest(t.approvals, t.receipts, AS_OF)


def audited(t):
    """Employees beside employers, with gaps in company and employer to count."""
    employees = t.users.select(
        "role",
        F.when(F.col("user_id") % 4 != 0, F.col("department")).alias("company_name"),
        F.when(F.col("user_id") % 6 != 0, F.col("employer_id")).alias("employer_id"),
    )
    bosses = t.employers.select(F.lit("employer").alias("role"), "company_name", F.lit(None).cast("bigint").alias("employer_id"))
    return employees.unionByName(bosses)


@query("agg33_user_audit", "users employers", """WITH a AS (SELECT role, CASE WHEN user_id % 4 <> 0 THEN department END AS c,
 CASE WHEN user_id % 6 <> 0 THEN employer_id END AS e FROM users UNION ALL SELECT 'employer', company_name, NULL FROM employers)
 SELECT role, count(*) AS users, count(c) AS with_company, count(*) - count(c) AS without_company, count(e) AS with_employer,
 count(*) - count(e) AS without_employer FROM a GROUP BY role""")
def user_audit(t):
    return ops.user_audit(audited(t))
