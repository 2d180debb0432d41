"""Queries INS1 to INS10 and SET3."""

from pyspark.sql import functions as F

from spendlake.operators import insights as ops
from spendlake.operators.joins import user_history
from spendlake.plans.bindings import r
from spendlake.plans.registry import query
from spendlake.plans.series import HISTORY_SQL

NOVEMBER = "2001-11-30"


def history(t):
    return user_history(t.receipts, t.categories)


def profiles(t):
    return ops.profile(history(t))


COLUMNS = "user_id, type, category, impact, value, amount, confidence, data_points, has_context, note"
# Every generator as one SELECT over the history; each is written from the rule, not from the profile.
H = f"""{HISTORY_SQL}, h AS (SELECT *, total_amount::double AS a, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, receipt_id DESC) AS rn FROM history),
 n AS (SELECT user_id, count(*) AS n, sum(a) AS total FROM h GROUP BY 1)"""


def record(kind, category, impact, value, amount, confidence, points, context, note):
    return f"""user_id, {kind} AS type, {category} AS category, {impact} AS impact, {r(value)} AS value, {r(amount)} AS amount,
 {r(confidence)} AS confidence, cast({points} AS bigint) AS data_points, {context} AS has_context, {note} AS note"""


def peak_sql(label, share, kind, category, impact, confidence, context, note, extra="true"):
    return f"""SELECT {record(kind, category, impact, '(s - m) / m * 100', 's', confidence, 'n', context, note)} FROM (
 SELECT g.*, n.n, avg(s) OVER (PARTITION BY g.user_id) AS m, count(*) OVER (PARTITION BY g.user_id) AS k,
 row_number() OVER (PARTITION BY g.user_id ORDER BY s DESC, lab DESC) AS pos
 FROM (SELECT user_id, {label} AS lab, sum(a) AS s FROM h GROUP BY ALL) g JOIN n ON g.user_id = n.user_id) WHERE pos = 1 AND s > m * {share} AND {extra}"""


INS1 = peak_sql("dayname(date)", 1.3, "'spending_pattern'", "'temporal'", "'medium'", "0.8", "false", "lab")
INS2 = f"""SELECT {record("'spending_pattern'", "'temporal'", "'low'", 'lab', 's', '0.7', 'n', 'true', 'NULL')} FROM (
 SELECT g.*, n.n, row_number() OVER (PARTITION BY g.user_id ORDER BY s DESC, lab DESC) AS pos FROM (SELECT user_id, hour(date) AS lab, sum(a) AS s
 FROM h GROUP BY ALL) g JOIN n ON g.user_id = n.user_id) WHERE pos = 1 AND (lab < 10 OR lab > 20)"""
INS3 = f"""SELECT {record("'spending_pattern'", "'quincena'", "'medium'", 'abs(p - q) / greatest(p, q) * 100', 'NULL', '0.8', 'n', 'true',
 "CASE WHEN p > q THEN 'primera' ELSE 'segunda' END")} FROM (SELECT user_id, count(*) AS n, sum(a) FILTER (day(date) <= 15) AS p,
 sum(a) FILTER (day(date) > 15) AS q FROM h GROUP BY 1) WHERE p > 0 AND q > 0 AND abs(p - q) / greatest(p, q) * 100 > 30"""
INS4 = peak_sql("month(date)", 1.4, "'seasonal_pattern'", "'mensual'", "'high'", "0.85", "true",
 """CASE lab WHEN 3 THEN 'Mes de vuelta a clases en Chile' WHEN 5 THEN 'Mes del Cyber Day en Chile' WHEN 9 THEN 'Mes de Fiestas Patrias en Chile'
 WHEN 11 THEN 'Mes del Black Friday en Chile' WHEN 12 THEN 'Mes de Navidad en Chile' ELSE 'Mes regular' END""", "k >= 3")
WEEKS = f"""SELECT {record("'trend_analysis'", "'semanal'", "'medium'", '(l - e) / e * 100', 'NULL', '0.75', 'k', 'false', 'NULL')} FROM (
 SELECT user_id, count(*) AS k, avg(s) FILTER (up <= 2) AS e, avg(s) FILTER (down <= 2) AS l FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w) AS up,
 row_number() OVER (PARTITION BY user_id ORDER BY w DESC) AS down FROM (SELECT user_id, week(date) AS w, sum(a) AS s FROM h GROUP BY ALL)) GROUP BY 1)
 WHERE k >= 4 AND l > e * 1.2"""
AVERAGES = """(VALUES ('Supermercado', 180000), ('Combustible', 120000), ('Transporte', 80000), ('Farmacia', 45000), ('Retail', 150000), ('Comida', 120000),
 ('Salud', 100000), ('Educación', 200000), ('Entretenimiento', 80000), ('Servicios', 150000)) avgs(cat, level)"""
INS5 = f"""SELECT {record("'category_comparison'", 'category', "CASE WHEN abs(gap) > 50 THEN 'high' ELSE 'medium' END", 'gap', 's', '0.8', 'k', 'true',
 '''CASE WHEN gap > 50 THEN CASE category WHEN 'Combustible' THEN 'Considera usar transporte público o compartir viajes'
 WHEN 'Comida' THEN 'Evalúa cocinar más en casa vs delivery' WHEN 'Retail' THEN 'Revisa si las compras son necesarias o impulsivas'
 ELSE 'Analiza tus gastos en ' || category END WHEN gap < -30 THEN 'Gasto controlado en ' || category ELSE '' END''')} FROM (
 SELECT c.*, (s - level) / level * 100 AS gap FROM (SELECT user_id, category, sum(a) AS s, count(*) AS k FROM h GROUP BY ALL) c JOIN {AVERAGES} ON cat = category)
 WHERE abs(gap) > 30"""
INS6 = f"""SELECT {record("'chile_specific'", "'economia'", "CASE WHEN total / 460000 * 100 > 120 THEN 'high' ELSE 'medium' END", 'total / 460000 * 100',
 'NULL', '0.9', 'n', 'true', 'NULL')} FROM n WHERE total / 460000 * 100 > 80"""
INS7 = f"""SELECT {record("'chile_specific'", "'eventos_comerciales'", "'medium'", 's - s / 1.5', 'NULL', '0.7', 'k', 'true', "'black_friday'")} FROM (
 SELECT user_id, sum(a) AS s, count(*) AS k FROM h WHERE category = 'Retail' GROUP BY 1) WHERE s - s / 1.5 > 20000"""
INFLATION = f"""SELECT {record("'chile_specific'", "'inflacion'", "'medium'", '(l - p) / p * 100', 'NULL', '0.7', '60', 'true', 'NULL')} FROM (
 SELECT user_id, sum(a) FILTER (rn <= 30) AS l, sum(a) FILTER (rn BETWEEN 31 AND 60) AS p FROM h GROUP BY 1 HAVING count(*) >= 60)
 WHERE p > 0 AND (l - p) / p * 100 > 3.5 / 12 * 2"""
TREND = f"""SELECT {record("'trend_analysis'", 'category', "CASE WHEN abs(t) > 50 THEN 'high' ELSE 'medium' END", 't', 'NULL', '0.8', 'k',
 "t > 0 AND category IN ('Combustible', 'Supermercado', 'Retail')", 'NULL')} FROM (SELECT *, (l - e) / e * 100 AS t FROM (
 SELECT user_id, category, count(*) AS k, avg(a) FILTER (pos <= c // 2) AS e, avg(a) FILTER (pos > c // 2) AS l FROM (
 SELECT *, count(*) OVER (PARTITION BY user_id) AS alln, count(*) OVER (PARTITION BY user_id, category) AS c,
 row_number() OVER (PARTITION BY user_id, category ORDER BY date, receipt_id) AS pos FROM h) WHERE alln >= 10 AND c >= 5 GROUP BY ALL) WHERE e > 0) WHERE abs(t) > 25"""
ALL = " UNION ALL ".join([INS1, INS2, INS3, INS4, WEEKS, INS5, INS6, INS7, INFLATION, TREND])
USES = "receipts categories"


@query("ins1_peak_weekday", USES, f"WITH {H} {INS1}")
def peak_weekday(t):
    return ops.peak_weekday(profiles(t))


@query("ins2_peak_hour", USES, f"WITH {H} {INS2}")
def peak_hour(t):
    return ops.peak_hour(profiles(t))


@query("ins3_half_month_gap", USES, f"WITH {H} {INS3}")
def half_month_gap(t):
    return ops.half_month_gap(profiles(t))


@query("ins4_peak_month", USES, f"WITH {H} {INS4}")
def peak_month(t):
    return ops.peak_month(profiles(t))


@query("ins5_category_comparison", USES, f"WITH {H} {INS5}")
def category_comparison(t):
    return ops.category_comparison(profiles(t))


@query("ins6_wage_share", USES, f"WITH {H} {INS6}")
def wage_share(t):
    return ops.wage_share(profiles(t))


@query("ins7_event_excess", USES, f"WITH {H} {INS7}")
def event_excess(t):
    return ops.event_excess(profiles(t), NOVEMBER)


@query("set3_all_insights", USES, f"WITH {H} {ALL}")
def all_insights(t):
    return ops.all_insights(history(t), NOVEMBER)


PRIORITY = f"""scored AS (SELECT *, CASE impact WHEN 'high' THEN 3.0::double WHEN 'medium' THEN 2.0::double ELSE 1.0::double END
 * CASE type WHEN 'chile_specific' THEN 1.2::double WHEN 'trend_analysis' THEN 1.1::double WHEN 'category_comparison' THEN 1.0::double
 WHEN 'spending_pattern' THEN 0.9::double ELSE 0.8::double END * CASE WHEN has_context THEN 1.1::double ELSE 1.0::double END * confidence AS p FROM ({ALL}))"""


@query("ins8_top_insights", USES, f"""WITH {H}, {PRIORITY} SELECT user_id, type, category, impact, value, note, {r('p')} AS priority FROM scored
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(p, 9) DESC, type, category, value DESC, note NULLS FIRST) <= 10""")
def top_insights(t):
    rows = ops.top_insights(ops.all_insights(history(t), NOVEMBER))
    return rows.select("user_id", "type", "category", "impact", "value", "note", "priority")


@query("ins9_insight_counts", USES, f"""WITH {H} SELECT user_id, type, impact, count(*) AS count FROM ({ALL})
 WHERE type = 'category_comparison' AND category = 'Comida' GROUP BY ALL""")
def insight_counts(t):
    return ops.insight_counts(ops.all_insights(history(t), NOVEMBER), "category_comparison", "Comida")


@query("ins10_no_data", "users receipts", """SELECT user_id, 'budget_recommendation' AS type, 'general' AS category, 'low' AS impact,
 'Sube más recibos para obtener insights personalizados' AS message, 'Registra al menos 10 gastos para comenzar a ver patrones' AS recommendation
 FROM users WHERE user_id NOT IN (SELECT user_id FROM receipts)""")
def no_data(t):
    return ops.no_data(t.users, t.receipts)


@query("ins10_no_category_data", "users receipts", """SELECT user_id, 'budget_recommendation' AS type, category, 'low' AS impact,
 'Sube más recibos para obtener insights personalizados' AS message, 'Registra al menos 10 gastos para comenzar a ver patrones' AS recommendation
 FROM users CROSS JOIN (VALUES ('Combustible'), ('Supermercado'), ('Comida'), ('Retail')) c(category)
 WHERE NOT EXISTS (SELECT 1 FROM receipts r WHERE r.user_id = users.user_id AND r.category = c.category)""")
def no_category_data(t):
    categories = F.array(*[F.lit(c) for c in ("Combustible", "Supermercado", "Comida", "Retail")])
    return ops.no_data(t.users.withColumn("category", F.explode(categories)), t.receipts, by_category=True)
