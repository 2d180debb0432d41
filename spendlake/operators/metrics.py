"""Processing-metrics analytics (MET1 to MET12).

Whole-log figures are one aggregate each: tasks pre-aggregate their rows and a
single small row per task is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.core import AsOf, notes, num, ratio, ts

# Thresholds, budget, price of a paid call, quota and rollout gates.
LOW_CONFIDENCE = 0.70
SLOW_SECONDS = 10.0
MONTHLY_BUDGET = 50.0
WARN_SHARE, CRITICAL_SHARE = 80.0, 95.0
PAID_PER_THOUSAND = 1.50
MONTHLY_QUOTA = 1000
ENGINES = ["tesseract", "google_vision", "hybrid"]
MIN_SAMPLES, MIN_CONFIDENCE, MAX_ERRORS, MAX_SECONDS, STEP = 50, 0.95, 0.05, 10.0, 0.20


def with_cost(events: DataFrame) -> DataFrame:
    """The price of every event: a thousandth of the rate where a paid engine was called."""
    return events.withColumn("cost_estimate", F.when(F.col("paid_call"), PAID_PER_THOUSAND / 1000).otherwise(0.0))


def _since(events: DataFrame, as_of: AsOf, days: int) -> DataFrame:
    return events.filter((F.col("ts") >= ts(as_of, -days)) & (F.col("ts") <= ts(as_of)))


def usage(events: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """MET1: requests, engines, cache, confidence, time, cost and errors of the last days, in one row."""
    rows = _since(events, as_of, days)
    one = F.lit(1)
    cost = F.count_if("paid_call") * PAID_PER_THOUSAND / 1000
    return rows.agg(
        F.count(one).alias("total_requests"),
        *[F.count_if(F.col("engine") == e).alias(f"{e}_requests") for e in ENGINES],
        F.count_if("cache_hit").alias("cache_hits"),
        ratio(F.count_if("cache_hit"), F.count(one)).alias("cache_hit_rate"),
        F.avg("confidence").alias("average_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("below_threshold"),
        F.avg("processing_time").alias("average_processing_time"),
        F.min("processing_time").alias("min_processing_time"),
        F.max("processing_time").alias("max_processing_time"),
        cost.alias("total_cost"),
        (cost / days * 30).alias("monthly_projection"),
        F.count_if("error").alias("error_count"),
        ratio(F.count_if("error"), F.count(one)).alias("error_rate"),
    )


def error_types(events: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """MET1: errors by type."""
    rows = _since(events, as_of, days).filter("error")
    return rows.groupBy(F.coalesce("error_type", F.lit("unknown")).alias("error_type")).agg(F.count(F.lit(1)).alias("count"))


def daily(events: DataFrame) -> DataFrame:
    """MET2: the daily roll-up with distinct users."""
    plain = F.col("engine") == "tesseract"
    return events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(plain).alias("tesseract_requests"),
        F.count_if(~plain & F.col("paid_call")).alias("google_vision_requests"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.avg("confidence").alias("average_confidence"),
        F.avg("processing_time").alias("average_processing_time"),
        (F.count_if("paid_call") * PAID_PER_THOUSAND / 1000).alias("total_cost_estimate"),
        F.count_if("error").alias("error_count"),
        F.count_distinct("user_id").alias("unique_users"),
    )


def _month(events: DataFrame, as_of: AsOf) -> DataFrame:
    return events.filter((F.col("ts") >= F.date_trunc("month", ts(as_of))) & (F.col("ts") <= ts(as_of)))


def cost_severity(cost: Column, budget: float = MONTHLY_BUDGET) -> Column:
    share = cost / budget * 100
    return F.when(share > CRITICAL_SHARE, "critical").when(share > WARN_SHARE, "high")


def monthly_cost(events: DataFrame, as_of: AsOf, budget: float = MONTHLY_BUDGET) -> DataFrame:
    """MET3: paid calls since the first of the month, their cost, share of the budget and alert level."""
    calls = _month(events, as_of).agg(F.count_if("paid_call").alias("paid_calls"))
    cost = F.col("paid_calls") * PAID_PER_THOUSAND / 1000
    return calls.select(
        "paid_calls", cost.alias("monthly_cost"), (cost / budget * 100).alias("budget_share"), cost_severity(cost, budget).alias("severity")
    )


def alerts(events: DataFrame) -> DataFrame:
    """MET4: the threshold alerts of every event; the same expression serves the stream."""

    def alert(kind: str, severity: str, value: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), num(value).alias("value"))

    found = F.array_compact(
        F.array(
            F.when(F.col("confidence") < LOW_CONFIDENCE, alert("low_confidence", "medium", "confidence")),
            F.when(F.col("processing_time") > SLOW_SECONDS, alert("performance_degraded", "low", "processing_time")),
        )
    )
    return events.select("event_id", "ts", "engine", F.explode(found).alias("_a")).select("event_id", "ts", "engine", "_a.*")


def all_alerts(events: DataFrame, as_of: AsOf, budget: float = MONTHLY_BUDGET) -> DataFrame:
    """Event alerts and the cost alert of the month."""
    spent = monthly_cost(events, as_of, budget).filter(F.col("severity").isNotNull())
    cost = spent.select(
        F.lit(None).cast("bigint").alias("event_id"),
        ts(as_of).alias("ts"),
        F.lit(None).cast("string").alias("engine"),
        F.when(F.col("severity") == "critical", "cost_critical").otherwise("cost_warning").alias("type"),
        "severity",
        F.col("monthly_cost").alias("value"),
    )
    return alerts(events).unionByName(cost)


def status(critical: Column, total: Column) -> Column:
    return F.when(critical > 0, "critical").when(total > 0, "warning").otherwise("healthy")


def alert_summary(active: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """MET5: active alerts by severity and the system status, in all or by ``keys``."""
    levels = ["critical", "high", "medium", "low"]
    counts = active.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total_count"), *[F.count_if(F.col("severity") == s).alias(s) for s in levels]
    )
    return counts.withColumn("system_status", status(F.col("critical"), F.col("total_count")))


def kpis(events: DataFrame, as_of: AsOf) -> DataFrame:
    """MET6: the last seven against the last thirty days, in one scan."""
    rows = _since(events, as_of, 30)
    week = F.col("ts") >= ts(as_of, -7)
    one = F.lit(1)

    def pair(name: str, whole: Column, part: Column) -> list[Column]:
        return [part.alias(f"{name}_7d"), whole.alias(f"{name}_30d")]

    sums = rows.agg(
        *pair("requests", F.count(one), F.count_if(week)),
        *pair("confidence", F.avg("confidence"), F.avg(F.when(week, F.col("confidence")))),
        *pair("cache_hit_rate", ratio(F.count_if("cache_hit"), F.count(one)), ratio(F.count_if(F.col("cache_hit") & week), F.count_if(week))),
        *pair("error_rate", ratio(F.count_if("error"), F.count(one)), ratio(F.count_if(F.col("error") & week), F.count_if(week))),
    )

    def trend(test: Column, yes: str = "up", no: str = "down") -> Column:
        return F.when(test, yes).otherwise(no)

    return sums.select(
        "*",
        trend(F.col("requests_7d") > F.col("requests_30d") / 4).alias("requests_trend"),
        trend(F.col("confidence_7d") > F.col("confidence_30d")).alias("confidence_trend"),
        trend(F.col("cache_hit_rate_7d") > F.col("cache_hit_rate_30d")).alias("cache_trend"),
        trend(F.col("error_rate_7d") < F.col("error_rate_30d"), "down", "up").alias("error_trend"),
    )


def health(active: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """MET7: a score of 100 less 30 per critical alert and 10 per alert, in all or by ``keys``."""
    rows = alert_summary(active, keys)
    score = F.greatest(F.lit(0), 100 - F.col("critical") * 30 - F.col("total_count") * 10)
    return rows.select(*(keys or []), F.col("total_count").alias("total_alerts"), F.col("critical").alias("critical_alerts"), "system_status", score.alias("score"))


def recommendations(events: DataFrame, as_of: AsOf) -> DataFrame:
    """MET8: what would lower cost or raise quality, from the last thirty days and the last three days of use."""
    week = F.col("ts") >= ts(as_of, -7)
    day, one = F.to_date("ts"), F.lit(1)
    paid, plain = F.col("engine") == "google_vision", F.col("engine") == "tesseract"
    sums = _since(events, as_of, 30).agg(
        ratio(F.count_if("cache_hit"), F.count(one)).alias("hit_rate"),
        ratio(F.count_if(paid), F.count(one)).alias("paid_share"),
        F.avg("confidence").alias("confidence"),
        F.count_if(week & plain).alias("plain"),
        F.count_if(week & paid).alias("paid"),
        F.count_distinct(F.when(week, day)).alias("days"),
        F.count_if(F.datediff(ts(as_of), day) <= 3).alias("recent"),
    )
    found = notes(
        (F.col("hit_rate") < 0.3, "high:cache_optimization"),
        (F.col("paid_share") > 0.5, "medium:engine_optimization"),
        (F.col("confidence") < 0.85, "medium:image_quality"),
        ((F.col("days") >= 3) & (F.col("recent") < 10), "low:usage_pattern"),
        ((F.col("plain") == 0) & (F.col("paid") > 0), "high:engine_configuration"),
    )
    part = F.split("_n", ":")
    return sums.select(F.explode(found).alias("_n")).select(
        F.get(part, F.lit(0)).alias("priority"), F.get(part, F.lit(1)).alias("type")
    )


def resolved(active: DataFrame, requests: DataFrame, as_of: AsOf, keys: tuple[str, ...] = ("event_id", "type")) -> DataFrame:
    """MET9: the listed alerts become resolved."""
    wanted = requests.select(*keys).distinct().withColumn("_hit", F.lit(True))
    rows = active.join(wanted, list(keys), "left")
    hit = F.coalesce("_hit", F.lit(False))
    return rows.withColumn("resolved", hit).withColumn("resolved_at", F.when(hit, ts(as_of))).drop("_hit")


def bucket(user: Column) -> Column:
    """MET10: position of a user between 0 and 1, from the first 32 bits of the md5 of the id."""
    return (F.conv(F.substring(F.md5(user.cast("string")), 1, 8), 16, 10).cast("bigint") % 10000) / 10000.0


def in_rollout(users: DataFrame, share: float) -> DataFrame:
    """MET10: whether each user is inside the rollout share."""
    return users.select("user_id", bucket(F.col("user_id")).alias("position"), (bucket(F.col("user_id")) < share).alias("in_rollout"))


def gate(samples: Column, confidence: Column, errors: Column, seconds: Column, share: Column, minimum: int = MIN_SAMPLES) -> Column:
    """MET11: the next rollout share: one step up when quality holds, 0 when not, unchanged on few samples."""
    good = (confidence >= MIN_CONFIDENCE) & (errors <= MAX_ERRORS) & (seconds <= MAX_SECONDS)
    return F.when(samples < minimum, share).when(good, F.least(share + STEP, F.lit(1.0))).otherwise(F.lit(0.0))


def rollout(events: DataFrame, share: float, key: str = "engine") -> DataFrame:
    """MET11: the gate for every key from its whole log."""
    sums = events.groupBy(key).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("confidence").alias("average_confidence"),
        ratio(F.count_if("error"), F.count(F.lit(1))).alias("error_rate"),
        F.avg("processing_time").alias("average_processing_time"),
    )
    after = gate(F.col("samples"), F.col("average_confidence"), F.col("error_rate"), F.col("average_processing_time"), F.lit(share))
    action = F.when(F.col("samples") < MIN_SAMPLES, "wait").when(after > 0, "advance").otherwise("roll_back")
    return sums.select("*", after.alias("rollout_percentage"), action.alias("action"))


def quota(events: DataFrame, as_of: AsOf, limit: int = MONTHLY_QUOTA) -> DataFrame:
    """MET12: paid calls used and left this month."""
    used = _month(events, as_of).agg(F.count_if("paid_call").alias("used"))
    return used.select("used", F.lit(limit).alias("monthly_limit"), F.greatest(F.lit(0), F.lit(limit) - F.col("used")).alias("remaining"))
