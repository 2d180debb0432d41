"""Queries MET1 to MET12 and SRC2 to SRC6."""

from pyspark.sql import functions as F

from spendlake.operators import metrics as ops
from spendlake.plans.bindings import EVENTS_AS_OF as NOW
from spendlake.plans.bindings import RECEIPTS_AS_OF, d, r
from spendlake.plans.filters import QUEUE_SQL, queue
from spendlake.plans.registry import query
from spendlake.sources import logs
from spendlake.sources.canonical import EVENTS_AS_OF as AS_OF
from spendlake.sources.canonical import RECEIPTS_AS_OF as RECEIPTS_NOW
from spendlake.sources.receipts import canonical

M = "processing_metrics"


def usage_sql(days, source=M):
    return f"""SELECT count(*) AS total_requests, count(*) FILTER (engine = 'tesseract') AS tesseract_requests,
 count(*) FILTER (engine = 'google_vision') AS google_vision_requests, count(*) FILTER (engine = 'hybrid') AS hybrid_requests,
 count(*) FILTER (cache_hit) AS cache_hits, {r('count(*) FILTER (cache_hit)::double / count(*)')} AS cache_hit_rate, {r('avg(confidence)')} AS average_confidence,
 {r('min(confidence)')} AS min_confidence, {r('max(confidence)')} AS max_confidence, count(*) FILTER (confidence < 0.7) AS below_threshold,
 {r('avg(processing_time)')} AS average_processing_time, {r('min(processing_time)')} AS min_processing_time, {r('max(processing_time)')} AS max_processing_time,
 {r('count(*) FILTER (paid_call) * 1.5 / 1000')} AS total_cost, {r(f'count(*) FILTER (paid_call) * 1.5 / 1000 / {days} * 30')} AS monthly_projection,
 count(*) FILTER (error) AS error_count, {r('count(*) FILTER (error)::double / count(*)')} AS error_rate
 FROM {source} WHERE ts BETWEEN {NOW} - interval {days} day AND {NOW}"""


@query("met1_usage", M, usage_sql(30))
def usage(t):
    return ops.usage(t.processing_metrics, AS_OF, 30)


@query("met1_error_types", M, f"""SELECT error_type, count(*) AS count FROM processing_metrics WHERE error AND ts BETWEEN {NOW} - interval 30 day AND {NOW} GROUP BY 1""")
def error_types(t):
    return ops.error_types(t.processing_metrics, AS_OF)


@query("met2_daily", M, f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total_requests, count(*) FILTER (engine = 'tesseract') AS tesseract_requests,
 count(*) FILTER (paid_call) AS google_vision_requests, count(*) FILTER (cache_hit) AS cache_hits, {r('avg(confidence)')} AS average_confidence,
 {r('avg(processing_time)')} AS average_processing_time, {r('count(*) FILTER (paid_call) * 1.5 / 1000')} AS total_cost_estimate,
 count(*) FILTER (error) AS error_count, count(DISTINCT user_id) AS unique_users FROM processing_metrics GROUP BY 1""")
def daily(t):
    return ops.daily(t.processing_metrics)


BUDGET = 3.0
COST = f"""cost AS (SELECT count(*) FILTER (paid_call) AS calls, count(*) FILTER (paid_call) * 1.5::double / 1000 AS c FROM processing_metrics
 WHERE ts BETWEEN timestamp '2024-01-01' AND {NOW})"""


@query("met3_monthly_cost", M, f"""WITH {COST} SELECT calls AS paid_calls, {r('c')} AS monthly_cost, {r('c / 3.0 * 100')} AS budget_share,
 CASE WHEN c / 3.0 * 100 > 95 THEN 'critical' WHEN c / 3.0 * 100 > 80 THEN 'high' END AS severity FROM cost""")
def monthly_cost(t):
    return ops.monthly_cost(t.processing_metrics, AS_OF, BUDGET)


ALERTS = """ev AS (SELECT event_id, ts, engine, 'low_confidence' AS type, 'medium' AS severity, confidence AS value FROM processing_metrics WHERE confidence < 0.7
 UNION ALL SELECT event_id, ts, engine, 'performance_degraded', 'low', processing_time FROM processing_metrics WHERE processing_time > 10)"""


@query("met4_event_alerts", M, f"WITH {ALERTS} SELECT event_id, {d('ev.ts')} AS ts, engine, type, severity, {r('value')} AS value FROM ev")
def event_alerts(t):
    return ops.alerts(t.processing_metrics)


@query("met5_alert_summary", M, f"""WITH {ALERTS}, {COST}, a AS (SELECT severity FROM ev UNION ALL SELECT CASE WHEN c / 3.0 * 100 > 95 THEN 'critical' ELSE 'high' END FROM cost WHERE c / 3.0 * 100 > 80)
 SELECT count(*) AS total_count, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
 count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
 CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'critical' WHEN count(*) > 0 THEN 'warning' ELSE 'healthy' END AS system_status FROM a""")
def alert_summary(t):
    return ops.alert_summary(ops.all_alerts(t.processing_metrics, AS_OF, BUDGET))


@query("met6_kpis", M, f"""WITH e AS (SELECT *, ts >= {NOW} - interval 7 day AS w FROM processing_metrics WHERE ts BETWEEN {NOW} - interval 30 day AND {NOW}),
 k AS (SELECT count(*) FILTER (w) AS r7, count(*) AS r30, avg(confidence) FILTER (w) AS c7, avg(confidence) AS c30,
 count(*) FILTER (cache_hit AND w)::double / count(*) FILTER (w) AS h7, count(*) FILTER (cache_hit)::double / count(*) AS h30,
 count(*) FILTER (error AND w)::double / count(*) FILTER (w) AS e7, count(*) FILTER (error)::double / count(*) AS e30 FROM e)
 SELECT r7 AS requests_7d, r30 AS requests_30d, {r('c7')} AS confidence_7d, {r('c30')} AS confidence_30d, {r('h7')} AS cache_hit_rate_7d, {r('h30')} AS cache_hit_rate_30d,
 {r('e7')} AS error_rate_7d, {r('e30')} AS error_rate_30d, CASE WHEN r7 > r30 / 4 THEN 'up' ELSE 'down' END AS requests_trend,
 CASE WHEN c7 > c30 THEN 'up' ELSE 'down' END AS confidence_trend, CASE WHEN h7 > h30 THEN 'up' ELSE 'down' END AS cache_trend,
 CASE WHEN e7 < e30 THEN 'down' ELSE 'up' END AS error_trend FROM k""")
def kpis(t):
    return ops.kpis(t.processing_metrics, AS_OF)


@query("met7_health", M, f"""WITH {ALERTS} SELECT strftime(date_trunc('hour', ev.ts), '%Y-%m-%d %H') AS hour, engine, count(*) AS total_alerts, 0 AS critical_alerts, 'warning' AS system_status,
 greatest(0, 100 - count(*) * 10) AS score FROM ev GROUP BY 1, 2""")
def health(t):
    """Health of every engine, hour by hour."""
    rows = ops.alerts(t.processing_metrics).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return ops.health(rows, ["hour", "engine"])


@query("met8_recommendations", M, f"""WITH m AS ({usage_sql(30)}), w AS ({usage_sql(7)}) SELECT * FROM (
 SELECT 'high' AS priority, 'cache_optimization' AS type FROM m WHERE cache_hit_rate < 0.3
 UNION ALL SELECT 'medium', 'engine_optimization' FROM m WHERE google_vision_requests::double / total_requests > 0.5
 UNION ALL SELECT 'medium', 'image_quality' FROM m WHERE average_confidence < 0.85
 UNION ALL SELECT 'low', 'usage_pattern' FROM w WHERE total_requests < 10
 UNION ALL SELECT 'high', 'engine_configuration' FROM w WHERE tesseract_requests = 0 AND google_vision_requests > 0)""")
def recommendations(t):
    return ops.recommendations(t.processing_metrics, AS_OF)


@query("met9_resolved_alerts", M, f"""WITH {ALERTS} SELECT event_id, type, event_id % 3 = 0 AND type = 'low_confidence' AS resolved,
 CASE WHEN event_id % 3 = 0 AND type = 'low_confidence' THEN '2024-01-31 00:00:00' END AS resolved_at FROM ev""")
def resolved_alerts(t):
    active = ops.alerts(t.processing_metrics)
    requests = t.processing_metrics.filter(F.col("event_id") % 3 == 0).select("event_id", F.lit("low_confidence").alias("type"))
    return ops.resolved(active, requests, AS_OF).select("event_id", "type", "resolved", "resolved_at")


@query("met10_rollout_bucket", "users", f"""WITH b AS (SELECT user_id, (('0x' || substring(md5(cast(user_id AS varchar)), 1, 8))::bigint % 10000) / 10000.0::double AS p FROM users)
 SELECT user_id, {r('p')} AS position, p < 0.35 AS in_rollout FROM b""")
def rollout_bucket(t):
    return ops.in_rollout(t.users, 0.35)


@query("met11_rollout_gate", M, f"""WITH g AS (SELECT engine, count(*) AS n, avg(confidence) AS c, count(*) FILTER (error)::double / count(*) AS e, avg(processing_time) AS s FROM processing_metrics GROUP BY 1)
 SELECT engine, n AS samples, {r('c')} AS average_confidence, {r('e')} AS error_rate, {r('s')} AS average_processing_time,
 {r('CASE WHEN n < 50 THEN 0.4 WHEN c >= 0.95 AND e <= 0.05 AND s <= 10 THEN 0.6 ELSE 0 END')} AS rollout_percentage,
 CASE WHEN n < 50 THEN 'wait' WHEN c >= 0.95 AND e <= 0.05 AND s <= 10 THEN 'advance' ELSE 'roll_back' END AS action FROM g""")
def rollout_gate(t):
    return ops.rollout(t.processing_metrics, 0.4)


@query("met12_quota", M, f"""WITH {COST} SELECT calls AS used, 1000 AS monthly_limit, greatest(0, 1000 - calls) AS remaining FROM cost""")
def quota(t):
    return ops.quota(t.processing_metrics, AS_OF)


def drifted(t):
    """Receipts in the shapes that three writers would have left, by receipt."""
    k = F.col("receipt_id") % 3
    rows = t.receipts

    def only(n, name):
        return F.when(k == n, F.col(name))

    return rows.select(
        "receipt_id",
        only(0, "user_id").alias("user"),
        only(1, "user_id").cast("string").alias("userId"),
        only(2, "user_id").alias("user_id"),
        only(0, "total_amount").cast("double").alias("totalAmount"),
        F.when(k != 0, F.col("total_amount")).alias("total_amount"),
        only(1, "created_at").alias("createdAt"),
        F.when(k != 1, F.col("created_at")).alias("created_at"),
        F.col("company_name").alias("companyName"),
        "date",
        "status",
    )


@query("src2_canonical_receipts", "receipts", f"""SELECT receipt_id, user_id, company_name, status, {d('date')} AS date, {d('receipts.created_at')} AS created_at,
 {r('total_amount')} AS total_amount FROM receipts""")
def canonical_receipts(t):
    return canonical(drifted(t)).select("receipt_id", "user_id", "company_name", "status", "date", "created_at", "total_amount")


def damaged_log(t):
    """The metrics log with cut lines, bad and missing timestamps and missing fields."""
    k = F.col("event_id")
    lines = t.processing_metrics
    text = logs.log_lines(lines.withColumn("engine", F.when(k % 17 != 0, F.col("engine"))))
    number = F.get_json_object("value", "$.event_id").cast("bigint")
    cut = F.substring("value", 1, 40)
    broken = (
        F.when(number % 19 == 0, cut)
        .when(number % 23 == 0, F.regexp_replace("value", '"timestamp":"[^"]*"', '"timestamp":"soon"'))
        .when(number % 29 == 0, F.regexp_replace("value", '"timestamp":"[^"]*",', ""))
        .otherwise(F.col("value"))
    )
    return text.select(broken.alias("value"))


@query("src3_log_scan", M, f"""SELECT event_id, {d('processing_metrics.ts')} AS ts, CASE WHEN event_id % 17 <> 0 THEN engine ELSE 'unknown' END AS engine,
 {r('confidence')} AS confidence, cache_hit, error FROM processing_metrics WHERE event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 29 <> 0""")
def log_scan(t):
    return logs.parse_lines(damaged_log(t)).select("event_id", "ts", "engine", "confidence", "cache_hit", "error")


@query("src4_log_cost", M, f"""SELECT event_id, {r('CASE WHEN paid_call THEN 0.0015 ELSE 0 END')} AS cost_estimate FROM processing_metrics""")
def log_cost(t):
    lines = logs.log_lines(t.processing_metrics)
    return lines.select(
        F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"),
        F.get_json_object("value", "$.cost_estimate").cast("double").alias("cost_estimate"),
    )


@query("src5_export_summary", M, f"""WITH u AS ({usage_sql(30)}), {ALERTS} SELECT '2024-01-31 00:00:00' AS export_timestamp, 30 AS period_days, u.*,
 (SELECT count(*) FROM ev) AS total_alerts, 0 AS critical_alerts, 'degraded' AS status FROM u""")
def export_summary(t):
    return logs.export_summary(t.processing_metrics, AS_OF)


@query("src6_approval_details", "receipts users", f"""WITH {QUEUE_SQL} SELECT receipt_id AS id, {d('created_at')} AS created, name AS requester, category, company_name AS vendor,
 {r('total_amount')} AS amount, 'CLP' AS currency, urgency, 'PENDIENTE' AS status,
 cast(ceil((epoch({RECEIPTS_AS_OF}) - epoch(created_at)) / 86400) AS bigint) AS days_pending FROM queue""")
def approval_details(t):
    return logs.approval_details(queue(t), RECEIPTS_NOW)
