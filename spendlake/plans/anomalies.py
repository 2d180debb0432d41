"""Queries ANO1 to ANO10, SET1 and SET2."""

from pyspark.sql import functions as F

from spendlake.operators import anomalies as ops
from spendlake.operators.joins import near_pairs
from spendlake.plans.bindings import RECEIPTS_AS_OF as NOW
from spendlake.plans.bindings import r
from spendlake.plans.registry import query
from spendlake.plans.series import EMP, by_employer
from spendlake.sources.canonical import RECEIPTS_AS_OF as AS_OF

PAIR_SQL = """base AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, receipt_id DESC) AS rn FROM receipts_dup),
 pairs AS (SELECT a.user_id, a.receipt_id, b.receipt_id AS related_receipt_id, a.total_amount AS amount,
 least(1.0, CASE WHEN greatest(a.total_amount, b.total_amount) > 0 THEN (1 - abs(a.total_amount::double - b.total_amount::double)
  / greatest(a.total_amount, b.total_amount)::double) * 0.4 ELSE 0 END
 + CASE WHEN lower(a.company_name) = lower(b.company_name) THEN 0.3 WHEN contains(lower(a.company_name), lower(b.company_name))
  OR contains(lower(b.company_name), lower(a.company_name)) THEN 0.15 ELSE 0 END
 + CASE WHEN lower(a.description) = lower(b.description) THEN 0.2 WHEN contains(lower(a.description), lower(b.description))
  OR contains(lower(b.description), lower(a.description)) THEN 0.1 ELSE 0 END
 + CASE WHEN a.date <= b.date + interval 1 hour THEN 0.1 WHEN a.date <= b.date + interval 6 hour THEN 0.05 ELSE 0 END) AS similarity
 FROM base a JOIN base b ON a.user_id = b.user_id AND a.rn < b.rn AND a.date <= b.date + interval 24 hour)"""


@query("ano1_pair_similarity", "receipts_dup", f"""WITH {PAIR_SQL} SELECT user_id, receipt_id, related_receipt_id, {r('similarity')} AS similarity FROM pairs""")
def pair_similarity(t):
    return ops.similarity(near_pairs(t.receipts_with_copies)).select(
        F.col("a.user_id").alias("user_id"),
        F.col("a.receipt_id").alias("receipt_id"),
        F.col("b.receipt_id").alias("related_receipt_id"),
        "similarity",
    )


@query("ano2_duplicates", "receipts_dup", f"""WITH {PAIR_SQL} SELECT user_id, 'duplicate_receipt' AS type,
 CASE WHEN similarity > 0.95 THEN 'high' ELSE 'medium' END AS severity, receipt_id, related_receipt_id, {r('amount')} AS amount,
 {r('similarity')} AS similarity FROM pairs WHERE similarity > 0.8""")
def duplicates(t):
    return ops.duplicates(t.receipts_with_copies)


def outlier_sql(key, source):
    return f"""page AS (SELECT {key}, receipt_id, date, coalesce(category, 'Sin categoría') AS category, total_amount::double AS amount
 FROM {source}),
 st AS (SELECT {key}, category, avg(amount) AS m, stddev_pop(amount) AS sd, quantile_cont(amount, 0.25) AS q1,
 quantile_cont(amount, 0.5) AS q2, quantile_cont(amount, 0.75) AS q3 FROM page GROUP BY ALL HAVING count(*) >= 5),
 found AS (SELECT p.*, sd > 0 AND abs(amount - m) / sd > 2.5 AS z, amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1) AS iqr, q2,
 abs(amount - q2) / q2 * 100 AS dev FROM page p JOIN st ON p.{key} = st.{key} AND p.category = st.category),
 outliers AS (SELECT *, row_number() OVER (PARTITION BY {key}, category, amount ORDER BY date DESC, receipt_id DESC) AS pick
 FROM found WHERE z OR iqr)"""


TYPICAL = "CASE category WHEN 'Supermercado' THEN 25000 WHEN 'Combustible' THEN 35000 WHEN 'Comida' THEN 18000 WHEN 'Retail' THEN 75000 END"


@query("ano3_outliers", "receipts", f"""WITH {outlier_sql('user_id', 'receipts')} SELECT user_id, receipt_id, category, {r('amount')} AS amount,
 z AS by_z_score, iqr AS by_quartiles, {r('q2')} AS expected_amount, {r('dev')} AS deviation_percentage FROM outliers""")
def outliers(t):
    rows = ops.outliers(t.receipts)
    return rows.drop("date")


def skewed(t):
    """Receipts with every 37th amount tenfold, so that both outlier tests fire."""
    factor = F.when(F.col("receipt_id") % 37 == 0, 10).otherwise(1)
    return by_employer(t).withColumn("total_amount", (F.col("total_amount") * factor).cast("decimal(18,2)"))


SKEWED = f"{EMP}, skewed AS (SELECT * REPLACE (total_amount * CASE WHEN receipt_id % 37 = 0 THEN 10 ELSE 1 END AS total_amount) FROM er)"


@query("ano4_unusual_amounts", "receipts users", f"""WITH {SKEWED}, {outlier_sql('employer_id', 'skewed')}
 SELECT employer_id, 'unusual_amount' AS type, CASE WHEN dev > 200 THEN 'high' WHEN dev > 100 THEN 'medium' ELSE 'low' END AS severity,
 receipt_id, category, {r('amount')} AS amount, {r('q2')} AS expected_amount, {r('dev')} AS deviation_percentage,
 coalesce(amount > 2 * {TYPICAL}, false) AS above_typical FROM outliers WHERE pick = 1""")
def unusual_amounts(t):
    return ops.unusual_amounts(skewed(t), "employer_id")


@query("set2_distinct_outliers", "receipts users", f"""WITH {SKEWED}, {outlier_sql('employer_id', 'skewed')}
 SELECT employer_id AS user_id, category, {r('amount')} AS amount, receipt_id FROM outliers WHERE pick = 1""")
def distinct_outliers(t):
    found = ops.outliers(skewed(t), "employer_id")
    return ops.distinct_outliers(found.withColumnRenamed("employer_id", "user_id"))


LAST_30 = f"date BETWEEN {NOW} - interval 30 day AND {NOW}"


@query("ano5_busy_days", "receipts users", f"""WITH {EMP} SELECT employer_id, 'suspicious_pattern' AS type, 'medium' AS severity,
 strftime(date, '%Y-%m-%d') AS day, count(*) AS receipts_count, {r('sum(total_amount)')} AS amount FROM er WHERE {LAST_30}
 GROUP BY employer_id, strftime(date, '%Y-%m-%d') HAVING count(*) > 1 AND sum(total_amount) > 200000""")
def busy_days(t):
    return ops.busy_days(by_employer(t), AS_OF, "employer_id", min_count=1)


@query("ano6_night_spend", "receipts", f"""SELECT user_id, 'unusual_time' AS type, 'medium' AS severity, receipt_id, {r('total_amount')} AS amount,
 hour(date) AS hour, isodow(date) >= 6 AS is_weekend FROM receipts WHERE {LAST_30} AND hour(date) < 6 AND total_amount > 50000""")
def night_spend(t):
    return ops.night_spend(t.receipts, AS_OF)


OFF_SQL = f"""recent AS (SELECT * FROM er WHERE date BETWEEN {NOW} - interval 60 day AND {NOW}),
 off AS (SELECT employer_id, receipt_id, total_amount, hour(date) AS hour, CASE
 WHEN NOT hour(date) BETWEEN 10 AND 20 AND total_amount > 30000 THEN 'Gasto significativo fuera de horario comercial'
 WHEN hour(date) < 6 AND total_amount > 10000 THEN 'Gasto en madrugada'
 WHEN isodow(date) >= 6 AND hour(date) < 8 AND total_amount > 20000 THEN 'Gasto temprano en fin de semana' END AS reason
 FROM (SELECT *, count(*) OVER (PARTITION BY employer_id) AS n FROM recent) WHERE n >= 10)"""


@query("ano7_off_hours", "receipts users", f"""WITH {EMP}, {OFF_SQL} SELECT employer_id, 'unusual_time' AS type,
 CASE WHEN total_amount > 50000 THEN 'medium' ELSE 'low' END AS severity, receipt_id, {r('total_amount')} AS amount, hour, reason
 FROM off WHERE reason IS NOT NULL""")
def off_hours(t):
    return ops.off_hours(by_employer(t), AS_OF, "employer_id")


# The planted copies have fewer than five receipts per user and category rarely; the union is per user.
ALL_SQL = f"""{PAIR_SQL}, {outlier_sql('user_id', 'receipts_dup')}, recent AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM receipts_dup WHERE date BETWEEN {NOW} - interval 60 day AND {NOW}),
 anomalies AS (SELECT user_id, 'duplicate_receipt' AS type, CASE WHEN similarity > 0.95 THEN 'high' ELSE 'medium' END AS severity, receipt_id,
 amount::double AS amount FROM pairs WHERE similarity > 0.8
 UNION ALL SELECT user_id, 'unusual_amount', CASE WHEN dev > 200 THEN 'high' WHEN dev > 100 THEN 'medium' ELSE 'low' END, receipt_id, amount
 FROM outliers WHERE pick = 1
 UNION ALL SELECT user_id, 'suspicious_pattern', 'medium', NULL, sum(total_amount)::double FROM receipts_dup WHERE {LAST_30}
 GROUP BY user_id, cast(date AS date) HAVING count(*) > 1 AND sum(total_amount) > 200000
 UNION ALL SELECT user_id, 'unusual_time', 'medium', receipt_id, total_amount::double FROM receipts_dup WHERE {LAST_30} AND hour(date) < 6 AND total_amount > 50000
 UNION ALL SELECT user_id, 'unusual_time', CASE WHEN total_amount > 50000 THEN 'medium' ELSE 'low' END, receipt_id, total_amount::double FROM recent
 WHERE n >= 1 AND ((NOT hour(date) BETWEEN 10 AND 20 AND total_amount > 30000) OR (hour(date) < 6 AND total_amount > 10000)
 OR (isodow(date) >= 6 AND hour(date) < 8 AND total_amount > 20000)))"""


def everything(t):
    return ops.all_anomalies(t.receipts_with_copies, AS_OF, min_count=1, at_least=1)


@query("set1_all_anomalies", "receipts_dup", f"WITH {ALL_SQL} SELECT user_id, type, severity, receipt_id, {r('amount')} AS amount FROM anomalies")
def all_anomalies(t):
    return everything(t)


RISK_SQL = f"""{ALL_SQL}, risk AS (SELECT user_id, count(*) AS n, sum(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 3 WHEN 'high' THEN 5 ELSE 10 END
 * CASE type WHEN 'duplicate_receipt' THEN 2.0 WHEN 'unusual_amount' THEN 1.5 WHEN 'suspicious_pattern' THEN 2.5 ELSE 1.0 END)::double AS w,
 bool_or(type = 'duplicate_receipt') AS d, bool_or(type = 'unusual_amount') AS u, bool_or(type = 'suspicious_pattern') AS s FROM anomalies GROUP BY 1),
 scored AS (SELECT *, least(100, w / (n * 25) * 100) AS score FROM risk)"""


@query("ano8_risk_scores", "receipts_dup users", f"""WITH {RISK_SQL} SELECT user_id, coalesce(n, 0) AS total_anomalies,
 {r('round_even(coalesce(score, 0), 1)')} AS risk_score,
 CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS risk_level FROM users LEFT JOIN scored USING (user_id)""")
def risk_scores(t):
    return ops.risk_scores(everything(t), everyone=t.users).drop("recommendations")


@query("ano9_risk_advice", "receipts_dup", f"""WITH {RISK_SQL} SELECT user_id, array_to_string(list_filter([
 CASE WHEN score >= 70 THEN 'Revisa inmediatamente los gastos marcados como anómalos' END,
 CASE WHEN score >= 70 THEN 'Considera cambiar contraseñas si hay gastos no reconocidos' END,
 CASE WHEN d THEN 'Verifica si hay recibos duplicados accidentalmente' END,
 CASE WHEN u THEN 'Revisa gastos con montos inusuales para tu patrón habitual' END,
 CASE WHEN s THEN 'Analiza días con múltiples gastos concentrados' END], lambda x: x IS NOT NULL), '|') AS recommendations FROM scored""")
def risk_advice(t):
    return ops.risk_scores(everything(t)).select("user_id", "recommendations")


@query("ano10_top_anomalies", "receipts_dup", f"""WITH {ALL_SQL} SELECT user_id, type, severity, receipt_id, {r('amount')} AS amount FROM anomalies
 WHERE severity = 'medium' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, type, receipt_id NULLS FIRST) <= 2""")
def top_anomalies(t):
    return ops.top_anomalies(everything(t), "medium", 2)


@query("ano10_anomaly_counts", "receipts_dup", f"WITH {ALL_SQL} SELECT user_id, type, count(*) AS count FROM anomalies GROUP BY ALL")
def anomaly_counts(t):
    return ops.anomaly_counts(everything(t))
