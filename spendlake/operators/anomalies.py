"""Anomaly detectors and risk scores (ANO1 to ANO10, SET1, SET2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.core import AsOf, lookup, newest, notes, num, ratio, ts
from spendlake.operators.joins import near_pairs
from spendlake.operators.sets import distinct_outliers, union_all

# Mean amount by category, weights of severity and type, opening hours.
TYPICAL_AMOUNTS = {
    "Supermercado": 25000,
    "Combustible": 35000,
    "Transporte": 5000,
    "Farmacia": 15000,
    "Retail": 75000,
    "Comida": 18000,
    "Salud": 60000,
    "Educación": 80000,
    "Entretenimiento": 25000,
    "Servicios": 40000,
}
SEVERITY_WEIGHTS = {"low": 1.0, "medium": 3.0, "high": 5.0, "critical": 10.0}
TYPE_WEIGHTS = {
    "duplicate_receipt": 2.0,
    "unusual_amount": 1.5,
    "suspicious_pattern": 2.5,
    "unusual_time": 1.0,
    "unusual_frequency": 1.5,
    "category_shift": 1.0,
}
OPENING_HOURS = (10, 20)
# Advice by risk level and anomaly type.
HIGH_RISK_ADVICE = [
    "Revisa inmediatamente los gastos marcados como anómalos",
    "Considera cambiar contraseñas si hay gastos no reconocidos",
]
TYPE_ADVICE = {
    "duplicate_receipt": "Verifica si hay recibos duplicados accidentalmente",
    "unusual_amount": "Revisa gastos con montos inusuales para tu patrón habitual",
    "suspicious_pattern": "Analiza días con múltiples gastos concentrados",
}


def _text_score(left: str, right: str, same: float, within: float) -> Column:
    a, b = F.lower(F.coalesce(F.col(left), F.lit(""))), F.lower(F.coalesce(F.col(right), F.lit("")))
    contained = a.contains(b) | b.contains(a)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, same).when(contained, within).otherwise(0.0)


def similarity(pairs: DataFrame) -> DataFrame:
    """ANO1: weighted similarity of amount, vendor, description and time of each near pair."""
    one, two = num("a.total_amount"), num("b.total_amount")
    largest = F.greatest(one, two)
    amount = F.when(largest > 0, (1 - F.abs(one - two) / largest) * 0.4).otherwise(0.0)
    gap = F.col("gap_seconds")
    time = F.when(gap <= 3600, 0.1).when(gap <= 6 * 3600, 0.05).otherwise(0.0)
    score = (
        amount
        + _text_score("a.company_name", "b.company_name", 0.3, 0.15)
        + _text_score("a.description", "b.description", 0.2, 0.1)
        + time
    )
    return pairs.withColumn("similarity", F.least(F.lit(1.0), score))


def duplicates(receipts: DataFrame, newest_rows: int | None = None, key: str = "user_id") -> DataFrame:
    """ANO2: near pairs more than 80 % alike; above 95 % the severity is high.

    A pair can only pass when its amounts are within a factor of two, since
    everything else adds up to 0.6; that bound is part of the join.
    """
    pairs = near_pairs(receipts, newest_rows, key=key, within_double=True)
    scored = similarity(pairs).filter(F.col("similarity") > 0.8)
    return scored.select(
        F.col(f"a.{key}").alias(key),
        F.lit("duplicate_receipt").alias("type"),
        F.when(F.col("similarity") > 0.95, "high").otherwise("medium").alias("severity"),
        F.col("a.receipt_id").alias("receipt_id"),
        F.col("b.receipt_id").alias("related_receipt_id"),
        F.col("a.total_amount").alias("amount"),
        F.col("similarity"),
    )


def _quartiles(amounts: DataFrame, keys: list[str]) -> DataFrame:
    """Exact interpolated quartiles ``_q1``, ``_q2``, ``_q3`` of ``amount``, with no buffer that holds a whole key.

    Equal amounts are counted first.  Ranks then come in two levels: size
    classes of amounts hold counts, and only inside a class are amounts sorted.
    """
    amount = F.col("amount")
    size_class = F.floor(F.signum(amount) * F.log2(F.abs(amount) + 1) * 16)
    cells = amounts.filter(amount.isNotNull()).groupBy(*keys, "amount").agg(F.count(F.lit(1)).alias("_c"))
    cells = cells.withColumn("_class", size_class)
    by_key = Window.partitionBy(*keys)
    classes = cells.groupBy(*keys, "_class").agg(F.sum("_c").alias("_n"))
    offsets = classes.select(
        *keys,
        "_class",
        F.sum("_n").over(by_key).alias("_all"),
        F.coalesce(F.sum("_n").over(by_key.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n0"),
    )
    local = Window.partitionBy(*keys, "_class").orderBy("amount").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cells.withColumn("_upto", F.sum("_c").over(local)).join(offsets, [*keys, "_class"])
    last = F.col("_n0") + F.col("_upto")
    first = last - F.col("_c")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank < last), amount))

    wanted = {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}
    found = ranked.groupBy(*keys).agg(
        F.max("_all").alias("_all"),
        *[at(F.floor((F.col("_all") - 1) * p)).alias(f"{name}_low") for name, p in wanted.items()],
        *[at(F.ceil((F.col("_all") - 1) * p)).alias(f"{name}_high") for name, p in wanted.items()],
    )

    def between(name: str, p: float) -> Column:
        place = (F.col("_all") - 1) * p
        share = place - F.floor(place)
        return (F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * share).alias(name)

    return found.select(*keys, *[between(name, p) for name, p in wanted.items()])


def outliers(
    rows: DataFrame,
    key: str = "user_id",
    newest_rows: int | None = None,
    at_least: int = 5,
    z_over: float = 2.5,
    iqr_times: float = 1.5,
) -> DataFrame:
    """ANO3: amounts far from the rest of their category, by z-score or by quartile fences.

    The statistics are of all receipts of a key and category; ``newest_rows``
    keeps one page per key instead.
    """
    if newest_rows is not None:
        rows = newest(rows, [key], [F.col("date").desc(), F.col("receipt_id").desc()], newest_rows)
    page = rows.select(
        key, "receipt_id", "date", F.coalesce("category", F.lit("Sin categoría")).alias("category"), num("total_amount").alias("amount")
    )
    amount = F.col("amount")
    stats = page.groupBy(key, "category").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(amount).alias("_mean"), F.stddev_pop(amount).alias("_dev")
    )
    stats = stats.filter(F.col("_n") >= at_least).join(_quartiles(page, [key, "category"]), [key, "category"])
    q1, median, q3 = F.col("_q1"), F.col("_q2"), F.col("_q3")
    fence = (q3 - q1) * iqr_times
    far = F.when(F.col("_dev") > 0, F.abs(amount - F.col("_mean")) / F.col("_dev") > z_over).otherwise(False)
    outside = (amount < q1 - fence) | (amount > q3 + fence)
    deviation = ratio(F.abs(amount - median), median) * 100
    return (
        page.join(stats, [key, "category"])
        .filter(far | outside)
        .select(
            key,
            "receipt_id",
            "date",
            "category",
            "amount",
            far.alias("by_z_score"),
            outside.alias("by_quartiles"),
            median.alias("expected_amount"),
            deviation.alias("deviation_percentage"),
        )
    )


def unusual_amounts(rows: DataFrame, key: str = "user_id", newest_rows: int | None = None, at_least: int = 5) -> DataFrame:
    """ANO3 with SET2 and ANO4: one anomaly per distinct outlying amount, against the typical amount too."""
    found = outliers(rows, key, newest_rows, at_least)
    kept = distinct_outliers(found.withColumnRenamed(key, "user_id")).withColumnRenamed("user_id", key)
    full = found.join(kept.select(key, "receipt_id"), [key, "receipt_id"], "left_semi")
    deviation = F.col("deviation_percentage")
    severity = F.when(deviation > 200, "high").when(deviation > 100, "medium").otherwise("low")
    return full.select(
        key,
        F.lit("unusual_amount").alias("type"),
        severity.alias("severity"),
        "receipt_id",
        "category",
        "amount",
        "expected_amount",
        "deviation_percentage",
        above_typical(F.col("category"), F.col("amount")).alias("above_typical"),
    )


def above_typical(category: Column, amount: Column) -> Column:
    """ANO4: more than twice the fixed mean amount of the category."""
    return F.coalesce(amount > lookup(category, TYPICAL_AMOUNTS) * 2, F.lit(False))


def busy_days(
    receipts: DataFrame, as_of: AsOf, key: str = "user_id", min_count: int = 5, min_amount: float = 200_000
) -> DataFrame:
    """ANO5: days of the last thirty with more receipts and money than the thresholds."""
    recent = receipts.filter((F.col("date") >= ts(as_of, -30)) & (F.col("date") <= ts(as_of)))
    days = recent.groupBy(key, F.to_date("date").alias("day")).agg(
        F.count(F.lit(1)).alias("receipts_count"), F.sum("total_amount").alias("amount")
    )
    return days.filter((F.col("receipts_count") > min_count) & (F.col("amount") > min_amount)).select(
        key, F.lit("suspicious_pattern").alias("type"), F.lit("medium").alias("severity"), "day", "receipts_count", "amount"
    )


def night_spend(receipts: DataFrame, as_of: AsOf, key: str = "user_id", min_amount: float = 50_000) -> DataFrame:
    """ANO6: large receipts before six in the morning, last thirty days."""
    recent = receipts.filter((F.col("date") >= ts(as_of, -30)) & (F.col("date") <= ts(as_of)))
    hour = F.hour("date")
    return recent.filter((hour < 6) & (F.col("total_amount") > min_amount)).select(
        key,
        F.lit("unusual_time").alias("type"),
        F.lit("medium").alias("severity"),
        "receipt_id",
        F.col("total_amount").alias("amount"),
        hour.alias("hour"),
        (F.weekday("date") >= 5).alias("is_weekend"),
    )


# Reasons of an off-hours anomaly.
OFF_HOURS = "Gasto significativo fuera de horario comercial"
SMALL_HOURS = "Gasto en madrugada"
WEEKEND_MORNING = "Gasto temprano en fin de semana"


def off_hours(receipts: DataFrame, as_of: AsOf, key: str = "user_id", at_least: int = 10) -> DataFrame:
    """ANO7: the receipts of sixty days that fall outside usual hours; first matching reason wins."""
    recent = receipts.filter((F.col("date") >= ts(as_of, -60)) & (F.col("date") <= ts(as_of)))
    active = recent.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least).select(key)
    hour, amount, weekend = F.hour("date"), F.col("total_amount"), F.weekday("date") >= 5
    reason = (
        F.when(~hour.between(*OPENING_HOURS) & (amount > 30_000), OFF_HOURS)
        .when((hour < 6) & (amount > 10_000), SMALL_HOURS)
        .when(weekend & (hour < 8) & (amount > 20_000), WEEKEND_MORNING)
    )
    rows = recent.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return rows.join(active, key, "left_semi").select(
        key,
        F.lit("unusual_time").alias("type"),
        F.when(amount > 50_000, "medium").otherwise("low").alias("severity"),
        "receipt_id",
        amount.alias("amount"),
        hour.alias("hour"),
        "reason",
    )


def all_anomalies(receipts: DataFrame, as_of: AsOf, key: str = "user_id", min_count: int = 5, at_least: int = 10) -> DataFrame:
    """SET1: the four detectors as one report."""
    shared = [key, "type", "severity", "receipt_id", "amount"]

    def common(rows: DataFrame) -> DataFrame:
        if "receipt_id" not in rows.columns:
            rows = rows.withColumn("receipt_id", F.lit(None).cast("bigint"))
        return rows.select(*shared[:-1], num("amount").alias("amount"))

    return union_all(
        common(duplicates(receipts, key=key)),
        common(unusual_amounts(receipts, key)),
        common(busy_days(receipts, as_of, key, min_count)),
        common(night_spend(receipts, as_of, key)),
        common(off_hours(receipts, as_of, key, at_least)),
    )


def risk_scores(anomalies: DataFrame, key: str = "user_id", everyone: DataFrame | None = None) -> DataFrame:
    """ANO8 and ANO9: weighted score out of 100, its level, and advice; those of ``everyone`` without a finding score 0."""
    weight = F.coalesce(lookup(F.col("severity"), SEVERITY_WEIGHTS), F.lit(1.0)) * F.coalesce(
        lookup(F.col("type"), TYPE_WEIGHTS), F.lit(1.0)
    )
    # Counting by type first keeps the set of types out of a per-row buffer.
    kinds = [F.count_if(F.col("type") == kind).alias(f"_{kind}") for kind in TYPE_WEIGHTS]
    sums = anomalies.groupBy(key).agg(F.count(F.lit(1)).alias("total_anomalies"), F.sum(weight).alias("_w"), *kinds)
    if everyone is not None:
        sums = everyone.select(key).distinct().join(sums, key, "left").na.fill(0)
    score = F.least(F.lit(100.0), ratio(F.col("_w"), F.col("total_anomalies") * 10 * 2.5) * 100)
    level = F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")
    advice = notes(
        *[(level == "high", text) for text in HIGH_RISK_ADVICE],
        *[(F.col(f"_{kind}") > 0, text) for kind, text in TYPE_ADVICE.items()],
    )
    return sums.select(
        key,
        "total_anomalies",
        F.bround(score, 1).alias("risk_score"),
        level.alias("risk_level"),
        advice.alias("recommendations"),
    )


def top_anomalies(anomalies: DataFrame, severity: str | None = None, limit: int = 50, key: str = "user_id") -> DataFrame:
    """ANO10: at most ``limit`` anomalies per key, optionally of one severity."""
    rows = anomalies if severity is None else anomalies.filter(F.col("severity") == severity)
    order = [lookup(F.col("severity"), SEVERITY_WEIGHTS).desc(), F.col("amount").desc(), F.col("type"), F.col("receipt_id")]
    return newest(rows, [key], order, limit)


def anomaly_counts(anomalies: DataFrame, key: str = "user_id") -> DataFrame:
    """ANO10: anomalies by type."""
    return anomalies.groupBy(key, "type").agg(F.count(F.lit(1)).alias("count"))
