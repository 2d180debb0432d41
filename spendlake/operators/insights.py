"""Insights from each key's recent receipts (INS1 to INS10, SET3).

All generators read one profile: a single pass of grouping sets over the
receipts of every key, folded to one row per key.  An insight is then a
condition and a struct on that row, and the whole report is one ``explode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.core import AsOf, growth, lookup, moment, newest, num, total
from spendlake.operators.series import ANNUAL_INFLATION, split_half_trend

# Reference averages, wage, retail events, month contexts, score weights.
CATEGORY_AVERAGES = {
    "Supermercado": 180000,
    "Combustible": 120000,
    "Transporte": 80000,
    "Farmacia": 45000,
    "Retail": 150000,
    "Comida": 120000,
    "Salud": 100000,
    "Educación": 200000,
    "Entretenimiento": 80000,
    "Servicios": 150000,
}
MINIMUM_WAGE = 460000
RETAIL_EVENTS = [
    ("cyber_day", 5, 1.4),
    ("cyber_monday", 5, 1.3),
    ("black_friday", 11, 1.5),
    ("navidad", 12, 1.6),
    ("fiestas_patrias", 9, 1.3),
    ("vuelta_clases", 3, 1.2),
]
MONTH_CONTEXTS = {
    3: "Mes de vuelta a clases en Chile",
    5: "Mes del Cyber Day en Chile",
    9: "Mes de Fiestas Patrias en Chile",
    11: "Mes del Black Friday en Chile",
    12: "Mes de Navidad en Chile",
}
REGULAR_MONTH = "Mes regular"
IMPACT_SCORES = {"high": 3.0, "medium": 2.0, "low": 1.0}
TYPE_SCORES = {
    "chile_specific": 1.2,
    "trend_analysis": 1.1,
    "category_comparison": 1.0,
    "spending_pattern": 0.9,
    "seasonal_pattern": 0.8,
}
CONTEXT_BONUS = 1.1
RETAIL_MONTHS = [5, 11, 12]
ADVICE = {
    "Combustible": "Considera usar transporte público o compartir viajes",
    "Comida": "Evalúa cocinar más en casa vs delivery",
    "Retail": "Revisa si las compras son necesarias o impulsivas",
}

# Grouping-id of each facet; the bits are key, weekday, hour, half, month, week, category from the left.
WHOLE, WEEKDAY, HOUR, HALF, MONTH, WEEK, CATEGORY = 63, 31, 47, 55, 59, 61, 62


def profile(history: DataFrame, key: str = "user_id", newest_rows: int | None = None) -> DataFrame:
    """One row per key with everything the generators compare; ``newest_rows`` keeps one page per key."""
    order = [F.col("date").desc(), F.col("receipt_id").desc()]
    page = history if newest_rows is None else newest(history, [key], order, newest_rows)
    names = ["weekday", "hour", "half", "month", "week", "category"]
    rows = page.select(
        key,
        F.date_format("date", "EEEE").alias("weekday"),
        F.hour("date").alias("hour"),
        F.when(F.dayofmonth("date") <= 15, "primera").otherwise("segunda").alias("half"),
        F.month("date").alias("month"),
        F.weekofyear("date").alias("week"),
        "category",
        "total_amount",
    )
    k = F.col(key)
    sets = [[k]] + [[k, F.col(n)] for n in names]
    amount = F.col("total_amount")
    cells = rows.groupingSets(sets, k, *[F.col(n) for n in names]).agg(
        F.grouping_id().alias("_g"),
        total().alias("_t"),
        F.count(F.lit(1)).alias("_n"),
    )
    # Only sixty receipts of a key leave their task for the two bands.
    latest = newest(page.select(key, "date", "receipt_id", "total_amount"), [key], order, 60, rank="_rank")
    bands = latest.groupBy(key).agg(
        num(F.sum(F.when(F.col("_rank") <= 30, amount))).alias("last30"),
        num(F.sum(F.when(F.col("_rank") > 30, amount))).alias("prior30"),
    )
    g, t = F.col("_g"), num("_t")

    def top(facet: int, label: str) -> Column:
        return F.max(F.when(g == facet, F.struct(t.alias("total"), F.col(label).alias("label"))))

    def average(facet: int) -> Column:
        return F.avg(F.when(g == facet, t))

    def pick(facet: int, value: Column) -> Column:
        return F.max(F.when(g == facet, value))

    folded = cells.groupBy(key).agg(
        pick(WHOLE, F.col("_n")).alias("receipts"),
        pick(WHOLE, t).alias("total"),
        top(WEEKDAY, "weekday").alias("weekday"),
        average(WEEKDAY).alias("weekday_mean"),
        top(HOUR, "hour").alias("hour"),
        F.max(F.when((g == HALF) & (F.col("half") == "primera"), t)).alias("first_half"),
        F.max(F.when((g == HALF) & (F.col("half") == "segunda"), t)).alias("second_half"),
        top(MONTH, "month").alias("month"),
        average(MONTH).alias("month_mean"),
        F.count_if(g == MONTH).alias("months"),
        F.sort_array(F.collect_list(F.when(g == WEEK, F.struct("week", t.alias("total"))))).alias("weeks"),
        F.sort_array(
            F.collect_list(F.when(g == CATEGORY, F.struct("category", t.alias("total"), F.col("_n").alias("n"))))
        ).alias("categories"),
    )
    return folded.join(bands, key, "left")


def _insight(kind, category, impact, value, confidence, points, amount=None, context=True, note=None) -> Column:
    """The common insight record."""

    def column(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        column(kind).alias("type"),
        column(category).cast("string").alias("category"),
        column(impact).alias("impact"),
        column(value).cast("double").alias("value"),
        column(amount).cast("double").alias("amount"),
        column(confidence).cast("double").alias("confidence"),
        column(points).cast("bigint").alias("data_points"),
        column(context).alias("has_context"),
        column(note).cast("string").alias("note"),
    )


def _peak_weekday() -> Column:
    best, level = F.col("weekday.total"), F.col("weekday_mean")
    record = _insight(
        "spending_pattern", "temporal", "medium", growth(best, level), 0.8, F.col("receipts"), best, False, F.col("weekday.label")
    )
    return F.array(F.when(best > level * 1.3, record))


def _peak_hour() -> Column:
    hour = F.col("hour.label")
    record = _insight("spending_pattern", "temporal", "low", hour, 0.7, F.col("receipts"), F.col("hour.total"))
    return F.array(F.when((hour < 10) | (hour > 20), record))


def _half_month() -> Column:
    a, b = F.col("first_half"), F.col("second_half")
    gap = F.when((a > 0) & (b > 0), F.abs(a - b) / F.greatest(a, b) * 100)
    half = F.when(a > b, "primera").otherwise("segunda")
    record = _insight("spending_pattern", "quincena", "medium", gap, 0.8, F.col("receipts"), note=half)
    return F.array(F.when(gap > 30, record))


def _peak_month() -> Column:
    best, level = F.col("month.total"), F.col("month_mean")
    context = lookup(F.col("month.label"), MONTH_CONTEXTS, REGULAR_MONTH)
    record = _insight(
        "seasonal_pattern", "mensual", "high", growth(best, level), 0.85, F.col("receipts"), best, True, context
    )
    return F.array(F.when((F.col("months") >= 3) & (best > level * 1.4), record))


def _week_trend() -> Column:
    weeks = F.col("weeks")

    def mean_of(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda s, w: s + w["total"]) / 2

    many = F.size(weeks) >= 4
    early = F.when(many, mean_of(F.slice(weeks, 1, 2)))
    recent = F.when(many, mean_of(F.slice(weeks, -2, 2)))
    record = _insight(
        "trend_analysis", "semanal", "medium", growth(recent, early), 0.75, F.size(weeks), context=False
    )
    return F.array(F.when(recent > early * 1.2, record))


def _comparisons() -> Column:
    def one(c: Column) -> Column:
        name, spent = c["category"], c["total"]
        level = num(lookup(name, CATEGORY_AVERAGES))
        gap = (spent - level) / level * 100
        impact = F.when(F.abs(gap) > 50, "high").otherwise("medium")
        advice = F.when(gap > 50, F.coalesce(lookup(name, ADVICE), F.concat(F.lit("Analiza tus gastos en "), name))).when(
            gap < -30, F.concat(F.lit("Gasto controlado en "), name)
        )
        record = _insight("category_comparison", name, impact, gap, 0.8, c["n"], spent, True, F.coalesce(advice, F.lit("")))
        return F.when(F.abs(gap) > 30, record)

    return F.transform("categories", one)


def _wage() -> Column:
    share = F.col("total") / MINIMUM_WAGE * 100
    impact = F.when(share > 120, "high").otherwise("medium")
    return F.array(F.when(share > 80, _insight("chile_specific", "economia", impact, share, 0.9, F.col("receipts"))))


def _retail_events(as_of: AsOf) -> Column:
    retail = F.get(F.filter("categories", lambda c: c["category"] == "Retail"), F.lit(0))
    records = []
    for name, month, impact in RETAIL_EVENTS:
        if month == moment(as_of).month:
            extra = retail["total"] - retail["total"] / impact
            record = _insight("chile_specific", "eventos_comerciales", "medium", extra, 0.7, retail["n"], note=name)
            records.append(F.when(extra > 20_000, record))
    return F.array(*records) if records else F.filter(_wage(), lambda r: F.lit(False))


def _inflation() -> Column:
    rise = F.when((F.col("receipts") >= 60) & (F.col("prior30") > 0), growth(F.col("last30"), F.col("prior30")))
    record = _insight("chile_specific", "inflacion", "medium", rise, 0.7, 60)
    return F.array(F.when(rise > ANNUAL_INFLATION / 12 * 2, record))


def _report(rows: DataFrame, key: str, *records: Column) -> DataFrame:
    found = F.array_compact(F.concat(*records))
    return rows.select(key, F.explode(found).alias("_i")).select(key, "_i.*")


def peak_weekday(profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """INS1: the weekday whose spend is 1.3 times the mean weekday."""
    return _report(profiles, key, _peak_weekday())


def peak_hour(profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """INS2: the hour of most spend, when it lies outside 10 to 20."""
    return _report(profiles, key, _peak_hour())


def half_month_gap(profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """INS3: halves of the month that differ by more than 30 % of the larger."""
    return _report(profiles, key, _half_month())


def peak_month(profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """INS4: the month above 1.4 times the mean month, with its context."""
    return _report(profiles, key, _peak_month())


def category_comparison(profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """INS5: categories more than 30 % off the reference average."""
    return _report(profiles, key, _comparisons())


def wage_share(profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """INS6: spend above 80 % of the minimum wage."""
    return _report(profiles, key, _wage())


def event_excess(profiles: DataFrame, as_of: AsOf, key: str = "user_id") -> DataFrame:
    """INS7: retail spend beyond the usual in the month of a retail event."""
    return _report(profiles, key, _retail_events(as_of))


def trend_insights(history: DataFrame, as_of: AsOf, key: str = "user_id") -> DataFrame:
    """WIN12 as insight records."""
    rows = split_half_trend(history, key)
    rising = F.col("trend_percentage") > 0
    watched = ["Combustible", "Supermercado"] + (["Retail"] if moment(as_of).month in RETAIL_MONTHS else [])
    context = rising & F.col("category").isin(watched)
    record = _insight(
        "trend_analysis", F.col("category"), F.col("impact"), F.col("trend_percentage"), 0.8, F.col("data_points"), context=context
    )
    return _report(rows, key, F.array(record))


def all_insights(history: DataFrame, as_of: AsOf, key: str = "user_id") -> DataFrame:
    """SET3: the five generators as one report."""
    records = [
        _peak_weekday(),
        _peak_hour(),
        _half_month(),
        _peak_month(),
        _week_trend(),
        _comparisons(),
        _wage(),
        _retail_events(as_of),
        _inflation(),
    ]
    return _report(profile(history, key), key, *records).unionByName(trend_insights(history, as_of, key))


def with_priority(insights: DataFrame) -> DataFrame:
    """INS8: impact times type, a bonus for context, times confidence."""
    score = F.coalesce(lookup(F.col("impact"), IMPACT_SCORES), F.lit(1.0)) * F.coalesce(
        lookup(F.col("type"), TYPE_SCORES), F.lit(1.0)
    )
    bonus = F.when(F.col("has_context"), CONTEXT_BONUS).otherwise(1.0)
    return insights.withColumn("priority", score * bonus * F.col("confidence"))


def top_insights(insights: DataFrame, n: int = 10, key: str = "user_id") -> DataFrame:
    """INS8: the ``n`` insights of highest priority per key."""
    order = [F.round("priority", 9).desc(), F.col("type"), F.col("category"), F.col("value").desc(), F.col("note")]
    return newest(with_priority(insights), [key], order, n)


def insight_counts(insights: DataFrame, kind: str | None = None, category: str | None = None, key: str = "user_id") -> DataFrame:
    """INS9: filtered insights counted by impact and type."""
    rows = insights
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    return rows.groupBy(key, "type", "impact").agg(F.count(F.lit(1)).alias("count"))


# The record shown to a user without receipts.
NO_DATA = {
    "message": "Sube más recibos para obtener insights personalizados",
    "recommendation": "Registra al menos 10 gastos para comenzar a ver patrones",
}


def no_data(users: DataFrame, receipts: DataFrame, by_category: bool = False) -> DataFrame:
    """INS10: the default record of every user without receipts, or of every user and ``category`` of ``users`` without any."""
    keys = ["user_id", "category"] if by_category else ["user_id"]
    empty = users.select(*keys).join(receipts.select(*keys), keys, "left_anti")
    return empty.select(
        "user_id",
        F.lit("budget_recommendation").alias("type"),
        (F.col("category") if by_category else F.lit("general")).alias("category"),
        F.lit("low").alias("impact"),
        *[F.lit(text).alias(name) for name, text in NO_DATA.items()],
    )
