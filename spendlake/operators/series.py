"""Time series and window operators (WIN1 to WIN14).

``key`` is the unit a series belongs to: ``user_id`` by default, or any column
of the input such as ``employer_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.core import AsOf, clamp, growth, lookup, mean, moment, newest, num, running, total, ts

# Month factors, daily base rates by category, holidays with their windows in days.
SEASONAL_FACTORS = {3: 1.15, 9: 1.20, 12: 1.25, 1: 0.85, 2: 0.90}
BASE_RATES = {
    "Supermercado": 15000,
    "Combustible": 25000,
    "Transporte": 8000,
    "Farmacia": 12000,
    "Retail": 35000,
    "Comida": 18000,
    "Salud": 45000,
    "Educación": 30000,
    "Entretenimiento": 20000,
    "Servicios": 25000,
    "Otros": 15000,
}
GENERAL_RATE = 20000
MAIN_CATEGORIES = ["Supermercado", "Combustible", "Comida", "Retail", "Transporte"]
HOLIDAYS = [("fiestas_patrias", 9, 18, -2, 2), ("navidad", 12, 25, -7, 2), ("año_nuevo", 1, 1, -3, 2)]


def _recent_order() -> list[Column]:
    return [F.col("date").desc(), F.col("receipt_id").desc()]


def daily_series(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """WIN1: spend per key and calendar day."""
    return receipts.groupBy(*keys, F.to_date("date").alias("day")).agg(total().alias("total"), F.count(F.lit(1)).alias("receipts"))


def _recent_stats(receipts: DataFrame, keys: list[str], minimum: int) -> DataFrame:
    """Mean, sample deviation and the two last weeks of receipts, from the newest ``minimum`` rows per key."""
    rows = newest(receipts, keys, _recent_order(), minimum, rank="_r")
    amount, rank = num("total_amount"), F.col("_r")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        mean().alias("_mean"),
        F.stddev_samp(amount).alias("_dev"),
        F.avg(F.when(rank <= 7, amount)).alias("_last7"),
        F.avg(F.when(rank.between(8, 14), amount)).alias("_prior7"),
    )


def _factor(as_of: AsOf) -> float:
    return SEASONAL_FACTORS.get(moment(as_of).month, 1.0)


def _direction(change: Column) -> Column:
    return F.when(change > 5, "increasing").when(change < -5, "decreasing").otherwise("stable")


def forecast(
    receipts: DataFrame, as_of: AsOf, days: int = 30, keys: list[str] | None = None, minimum: int = 30, users: DataFrame | None = None
) -> DataFrame:
    """WIN2, WIN3 and WIN4: statistical forecast, its trend, and the base-rate fallback.

    Keys with fewer than ``minimum`` receipts get the fixed daily rate of their
    category (or the general one) instead; so do keys of ``users`` that have none.
    """
    keys = keys or ["user_id"]
    factor = _factor(as_of)
    stats = _recent_stats(receipts, keys, minimum)
    if users is not None:
        stats = users.select(*keys).distinct().join(stats, keys, "left")
    enough = F.col("_n") >= minimum
    rate = F.lit(GENERAL_RATE)
    if "category" in keys:
        rate = F.coalesce(lookup(F.col("category"), BASE_RATES), rate)
    spread = F.when(F.col("_mean") > 0, 1 - F.col("_dev") / F.col("_mean")).otherwise(0.3)
    change = growth(F.col("_last7"), F.col("_prior7"))
    return stats.select(
        *keys,
        F.when(enough, F.greatest(F.lit(0.0), F.col("_mean") * factor * days)).otherwise(num(rate) * days * factor).alias("total_amount"),
        F.when(enough, clamp(spread, 0.3, 0.9)).otherwise(0.6).alias("confidence"),
        F.when(enough, change).otherwise(2.5).alias("monthly_growth"),
        F.when(enough, _direction(change)).otherwise("stable").alias("direction"),
        F.lit(factor).alias("seasonal_factor"),
        F.when(enough, "statistical").otherwise("mock").alias("method"),
    )


def forecast_fanout(
    receipts: DataFrame, as_of: AsOf, days: int = 30, key: str = "user_id", minimum: int = 30
) -> DataFrame:
    """WIN5: horizons of 7, 30 and 90 days and the main categories, in one job.

    A forecast is linear in its horizon, so the horizons are an ``explode`` of
    one per-day figure and not three scans.
    """
    per_day = forecast(receipts, as_of, 1, [key], minimum)
    horizon = F.explode(F.array(F.lit(7), F.lit(30), F.lit(90))).alias("days")
    overall = per_day.select(key, F.lit(None).cast("string").alias("category"), horizon, "total_amount", "confidence", "method")
    chosen = receipts.filter(F.col("category").isin(MAIN_CATEGORIES))
    by_category = forecast(chosen, as_of, days, [key, "category"], minimum)
    known = by_category.select(key, "category", "total_amount", "confidence", "method")
    # A category without any receipt of the key still gets its base rate.
    grid = per_day.select(key, F.explode(F.array(*[F.lit(c) for c in MAIN_CATEGORIES])).alias("category"))
    rate = num(lookup(F.col("category"), BASE_RATES)) * days * _factor(as_of)
    filled = grid.join(known, [key, "category"], "left").select(
        key,
        "category",
        F.lit(days).alias("days"),
        F.coalesce("total_amount", rate).alias("total_amount"),
        F.coalesce("confidence", F.lit(0.6)).alias("confidence"),
        F.coalesce("method", F.lit("mock")).alias("method"),
    )
    return overall.withColumn("total_amount", F.col("total_amount") * F.col("days")).unionByName(filled)


def linear_trend(daily: DataFrame, key: str = "user_id") -> DataFrame:
    """WIN6: least-squares slope over the day index, its direction and monthly growth."""
    index = F.row_number().over(Window.partitionBy(key).orderBy("day")) - 1
    rows = daily.withColumn("_x", index).withColumn("_y", num("total"))
    fit = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("days"), F.regr_slope("_y", "_x").alias("slope"), F.avg("_y").alias("_mean")
    )
    slope, level = F.col("slope"), F.col("_mean")
    flat = F.col("days") < 2
    direction = (
        F.when(flat, "stable").when(slope > level * 0.01, "increasing").when(slope < -level * 0.01, "decreasing").otherwise("stable")
    )
    monthly = F.when(flat | (level <= 0), 0.0).otherwise(slope * 30 / level * 100)
    return fit.select(key, "days", "slope", direction.alias("direction"), monthly.alias("monthly_growth"))


def fit_confidence(daily: DataFrame, key: str = "user_id") -> DataFrame:
    """WIN7: one minus the mean absolute percentage error of the fitted line, kept within .3 and .95."""
    index = F.row_number().over(Window.partitionBy(key).orderBy("day")) - 1
    rows = daily.withColumn("_x", index).withColumn("_y", num("total"))
    line = rows.groupBy(key).agg(
        F.regr_slope("_y", "_x").alias("_b"), F.regr_intercept("_y", "_x").alias("_a"), F.count(F.lit(1)).alias("_n")
    )
    fitted = F.col("_a") + F.col("_b") * F.col("_x")
    error = F.abs(F.try_divide(F.col("_y") - fitted, F.col("_y")))
    scored = rows.join(line.filter(F.col("_n") >= 2), key).groupBy(key).agg(F.avg(error).alias("_mape"))
    return scored.select(key, clamp(1 - F.col("_mape"), 0.3, 0.95).alias("confidence"))


def weekday_pattern(receipts: DataFrame, key: str = "user_id") -> DataFrame:
    """WIN8: mean receipt by weekday."""
    return receipts.groupBy(key, F.date_format("date", "EEEE").alias("weekday")).agg(
        mean().alias("average"), F.count(F.lit(1)).alias("receipts")
    )


def half_month_pattern(receipts: DataFrame, key: str = "user_id") -> DataFrame:
    """WIN8: mean receipt of the first fifteen days and of the rest of the month."""
    early = F.dayofmonth("date") <= 15
    first, second = F.when(early, F.col("total_amount")), F.when(~early, F.col("total_amount"))

    def part(column: Column) -> Column:
        return num(F.sum(column)) / F.nullif(F.count(column), F.lit(0))

    return receipts.groupBy(key).agg(
        part(first).alias("first_half"), part(second).alias("second_half"), F.count(F.lit(1)).alias("data_points")
    )


def holiday_tags(when: Column) -> Column:
    """WIN9: names of the holidays whose window covers a day, in any year."""
    day = F.to_date(when)
    tags = []
    for name, month, dom, before, after in HOLIDAYS:
        inside = F.lit(False)
        for shift in (-1, 0, 1):
            holiday = F.make_date(F.year(day) + shift, F.lit(month), F.lit(dom))
            inside = inside | day.between(F.date_add(holiday, before), F.date_add(holiday, after))
        tags.append(F.when(inside, F.lit(name)))
    return F.array_compact(F.array(*tags))


def seasonal_factor(when: Column) -> Column:
    """WIN9: the fixed factor of a month."""
    return lookup(F.month(when), SEASONAL_FACTORS, 1.0)


def unusual_spending(receipts: DataFrame, as_of: AsOf, times: float = 1.5, key: str = "user_id") -> DataFrame:
    """WIN10: last seven days' mean receipt against the 23 days before."""
    rows = receipts.filter((F.col("created_at") >= ts(as_of, -30)) & (F.col("created_at") <= ts(as_of)))
    late = F.col("created_at") >= ts(as_of, -7)
    recent, before = F.when(late, num("total_amount")), F.when(~late, num("total_amount"))
    means = rows.groupBy(key).agg(F.avg(recent).alias("recent_average"), F.avg(before).alias("historical_average"))
    return means.filter(F.col("recent_average") > F.col("historical_average") * times).withColumn(
        "increase_percentage", growth(F.col("recent_average"), F.col("historical_average"))
    )


def week_ends_trend(history: DataFrame, key: str = "user_id", times: float = 1.2, at_least: int = 4) -> DataFrame:
    """WIN11: mean of the last two week numbers against the first two; years share a number."""
    weeks = history.groupBy(key, F.weekofyear("date").alias("week")).agg(total().alias("_t"))
    by_week = Window.partitionBy(key)
    ranked = weeks.withColumn("_up", F.row_number().over(by_week.orderBy("week"))).withColumn(
        "_down", F.row_number().over(by_week.orderBy(F.desc("week")))
    )
    amount = num("_t")
    ends = ranked.groupBy(key).agg(
        F.count(F.lit(1)).alias("weeks"),
        F.avg(F.when(F.col("_up") <= 2, amount)).alias("early_average"),
        F.avg(F.when(F.col("_down") <= 2, amount)).alias("recent_average"),
    )
    return ends.filter((F.col("weeks") >= at_least) & (F.col("recent_average") > F.col("early_average") * times)).withColumn(
        "trend_percentage", growth(F.col("recent_average"), F.col("early_average"))
    )


def split_half_trend(
    history: DataFrame, key: str = "user_id", over: float = 25.0, per_category: int = 5, per_key: int = 10
) -> DataFrame:
    """WIN12: mean of a category's first half of receipts against the rest.

    Positions come from the two-level running number and sizes from counts, so
    no task sorts a whole key.
    """
    sizes = history.groupBy(key, "category").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_all", F.sum("_n").over(Window.partitionBy(key)))
    large = sizes.filter((F.col("_all") >= per_key) & (F.col("_n") >= per_category))
    narrow = history.select(key, "category", "date", "receipt_id", "total_amount")
    rows = running(narrow, [key, "category"], "date", [F.col("date"), F.col("receipt_id")], grain="day").join(large, [key, "category"])
    early = F.col("rn") <= F.floor(F.col("_n") / 2)
    amount = num("total_amount")
    means = rows.groupBy(key, "category").agg(
        F.count(F.lit(1)).alias("data_points"),
        F.avg(F.when(early, amount)).alias("_early"),
        F.avg(F.when(~early, amount)).alias("_recent"),
    )
    change = growth(F.col("_recent"), F.col("_early"))
    return (
        means.filter(F.col("_early") > 0)
        .withColumn("trend_percentage", change)
        .filter(F.abs("trend_percentage") > over)
        .select(
            key,
            "category",
            "data_points",
            "trend_percentage",
            F.when(F.col("trend_percentage") > 0, "aumentado").otherwise("disminuido").alias("direction"),
            F.when(F.abs("trend_percentage") > 50, "high").otherwise("medium").alias("impact"),
        )
    )


ANNUAL_INFLATION = 3.5


def inflation_excess(receipts: DataFrame, key: str = "user_id", band: int = 30) -> DataFrame:
    """WIN13: newest ``band`` receipts against the ``band`` before, over twice monthly inflation."""
    rows = newest(receipts, [key], _recent_order(), 2 * band, rank="_r")
    recent = F.sum(F.when(F.col("_r") <= band, F.col("total_amount")))
    before = F.sum(F.when(F.col("_r") > band, F.col("total_amount")))
    sums = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), recent.alias("recent"), before.alias("previous"))
    monthly = ANNUAL_INFLATION / 12
    grown = sums.filter((F.col("_n") >= 2 * band) & (F.col("previous") > 0)).withColumn(
        "monthly_increase", growth(F.col("recent"), F.col("previous"))
    )
    return grown.filter(F.col("monthly_increase") > monthly * 2).select(
        key, "recent", "previous", "monthly_increase", F.lit(monthly).alias("monthly_inflation")
    )


def running_quality(events: DataFrame, key: str = "engine", rows_per_bucket: int = 1_000_000) -> DataFrame:
    """WIN14: running mean of confidence and time, and successes and failures so far; an hour of more than ``rows_per_bucket`` rows is cut."""
    order = [F.col("ts"), F.col("event_id")]
    failed = F.when(F.col("error"), 1).otherwise(0)
    rows = running(
        events,
        [key],
        "ts",
        order,
        {"_conf": F.col("confidence"), "_time": F.col("processing_time"), "failed": failed},
        rows_per_bucket=rows_per_bucket,
    )
    return rows.select(
        "event_id",
        key,
        F.col("rn").alias("samples"),
        (F.col("_conf") / F.col("rn")).alias("avg_confidence"),
        (F.col("_time") / F.col("rn")).alias("avg_processing_time"),
        (F.col("rn") - F.col("failed")).alias("successes"),
        F.col("failed").alias("failures"),
    )
