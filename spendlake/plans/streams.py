"""Queries STR1 to STR5: the given tables read as file streams and run to their end."""

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from spendlake.plans.bindings import d, r
from spendlake.plans.metrics import ALERTS
from spendlake.plans.registry import query
from spendlake.plans.rules import basic_workflows
from spendlake.sources.canonical import Tables
from spendlake.session import checkpoint_dir
from spendlake.streaming import closing, jobs


def streaming(t, *names):
    return Tables(t.spark, t.folder, names)


@query("str1_alert_stream", "processing_metrics", f"WITH {ALERTS} SELECT event_id, {d('ev.ts')} AS ts, engine, type, severity, {r('value')} AS value FROM ev")
def alert_stream(t):
    return jobs.run_available(jobs.alert_stream(streaming(t, "events").processing_metrics))


@query("str2_daily_stream", "processing_metrics", f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total_requests, count(*) FILTER (engine = 'tesseract') AS tesseract_requests,
 count(*) FILTER (paid_call) AS google_vision_requests, count(*) FILTER (cache_hit) AS cache_hits, {r('avg(confidence)')} AS average_confidence,
 {r('avg(processing_time)')} AS average_processing_time, count(*) FILTER (error) AS error_count, count(DISTINCT user_id) AS unique_users FROM processing_metrics GROUP BY 1
 HAVING strftime(ts, '%Y-%m-%d')::timestamp + interval 1 day <= (SELECT max(ts) - interval 1 hour FROM processing_metrics)""")
def daily_stream(t):
    return jobs.run_available(jobs.daily_stream(streaming(t, "events").processing_metrics))


@query("str3_approval_stream", "receipts", """SELECT receipt_id AS instance_id, receipt_id, CASE WHEN total_amount <= 50000 THEN 'basic_small' WHEN total_amount <= 500000 THEN 'basic_medium' ELSE 'basic_large' END AS applied_rule_id,
 CASE WHEN total_amount <= 50000 THEN 'auto_approved' ELSE 'pending' END AS status FROM receipts""")
def approval_stream(t):
    receipts = streaming(t, "orders").receipts.withColumn("workflow_id", F.col("user_id") % 3)
    rows = jobs.run_available(jobs.approval_stream(receipts, t.users, basic_workflows(t)))
    return rows.select("instance_id", "receipt_id", "applied_rule_id", "status")


@query("str4_quality_stream", "processing_metrics", f"""WITH g AS (SELECT engine, count(*) AS n, avg(confidence) AS c, count(*) FILTER (error)::double / count(*) AS e, avg(processing_time) AS s FROM processing_metrics GROUP BY 1)
 SELECT engine, n AS samples, {r('c')} AS average_confidence, {r('e')} AS error_rate, {r('s')} AS average_processing_time,
 {r('CASE WHEN n < 50 THEN 0.4 WHEN c >= 0.95 AND e <= 0.05 AND s <= 10 THEN 0.6 ELSE 0 END')} AS rollout_percentage FROM g""")
def quality_stream(t):
    return jobs.run_updates(jobs.quality_stream(streaming(t, "events").processing_metrics, 0.4), "engine")


@query("str5_notification_stream", "receipts users", f"""SELECT receipt_id, employer_id AS recipient_id, 'receipt_' || status AS type, CASE status WHEN 'aceptada' THEN 'Recibo aceptado'
 WHEN 'rechazada' THEN 'Recibo rechazado' ELSE 'Nuevo recibo en revisión' END AS title, name || ' ' || company_name || ' ' || total_amount AS message, false AS read,
 {d('r.created_at')} AS created_at FROM receipts r LEFT JOIN users u ON r.user_id = u.user_id""")
def notification_stream(t):
    return jobs.run_available(jobs.notification_stream(streaming(t, "orders").receipts, t.users))


def closed(t, build):
    """Runs a stream over all events, then again from its checkpoint after a heartbeat past the last day, and returns what both wrote."""
    folder = f"{checkpoint_dir(t.spark)}/streams/{uuid.uuid4().hex}"
    closing.write_heartbeat(t.spark, f"{folder}/beats", datetime(1970, 1, 1, tzinfo=timezone.utc))

    def run():
        events = closing.with_heartbeats(streaming(t, "events").processing_metrics, closing.read_heartbeats(t.spark, f"{folder}/beats"))
        return jobs.run_available(build(events), folder, closing.STATE_STORE)

    run()
    last = t.processing_metrics.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
    if last is not None:
        closing.write_heartbeat(t.spark, f"{folder}/beats", closing.day_end(datetime.fromisoformat(last)))
    return run()


@query("str2_closed_days", "processing_metrics", f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total_requests, count(*) FILTER (engine = 'tesseract') AS tesseract_requests,
 count(*) FILTER (paid_call AND engine <> 'tesseract') AS google_vision_requests, count(*) FILTER (cache_hit) AS cache_hits, {r('avg(confidence)')} AS average_confidence,
 {r('avg(processing_time)')} AS average_processing_time, count(*) FILTER (error) AS error_count, count(DISTINCT user_id) AS unique_users, 0 AS late_rows FROM processing_metrics GROUP BY 1""")
def closed_days(t):
    return closing.daily_totals(closed(t, closing.closed_days))


PHASE_GATE = closing.Gate(confidence=0.42, errors=0.25, seconds=50.0)


@query("str4_phase_history", "processing_metrics", f"""WITH dy AS (SELECT engine AS key, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(confidence) AS c, count(*) FILTER (error) AS e, sum(processing_time) AS s FROM processing_metrics GROUP BY 1, 2),
 q AS (SELECT key, day, sum(n) OVER w AS n, sum(c) OVER w / sum(n) OVER w AS c, sum(e) OVER w / sum(n) OVER w AS e, sum(s) OVER w / sum(n) OVER w AS s FROM dy WINDOW w AS (PARTITION BY key ORDER BY day)),
 g AS (SELECT *, n >= 50 AND c >= 0.42 AND e <= 0.25 AND s <= 50 AS good, n >= 50 AND NOT (c >= 0.42 AND e <= 0.25 AND s <= 50) AS bad FROM q),
 u AS (SELECT *, (sum(good::int) OVER (PARTITION BY key ORDER BY day))::bigint AS ups FROM g),
 f AS (SELECT *, min(CASE WHEN bad THEN day END) OVER k AS fall, min(CASE WHEN ups = 4 THEN day END) OVER k AS whole FROM u WINDOW k AS (PARTITION BY key)),
 p AS (SELECT *, CASE WHEN fall < coalesce(whole, '9999') AND day >= fall THEN 'rollback' WHEN whole < coalesce(fall, '9999') AND day >= whole THEN 'full_deployment' ELSE 'gradual_rollout' END AS phase,
   max(CASE WHEN day = fall THEN ups END) OVER (PARTITION BY key) AS climbed FROM f)
 SELECT key, day, n::bigint AS samples, {r('c')} AS average_confidence, {r('e')} AS error_rate, {r('s')} AS average_processing_time, phase,
 CASE phase WHEN 'rollback' THEN 0.0 WHEN 'full_deployment' THEN 1.0 ELSE round(0.2 + 0.2 * ups, 6) END::double AS rollout_percentage,
 CASE phase WHEN 'rollback' THEN CASE WHEN day = fall THEN 'roll_back' ELSE 'none' END WHEN 'full_deployment' THEN CASE WHEN day = whole THEN 'advance' ELSE 'none' END ELSE CASE WHEN n < 50 THEN 'wait' ELSE 'advance' END END AS action,
 0::bigint AS late_rows, CASE phase WHEN 'rollback' THEN climbed + 1 WHEN 'full_deployment' THEN 4 ELSE ups END::int AS changes FROM p""")
def phase_history(t):
    rows = closed(t, lambda events: closing.rollout_stream(events, PHASE_GATE))
    return rows.withColumn("day", F.date_from_unix_date(F.col("day").cast("int")))
