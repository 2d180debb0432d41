"""Summaries, rankings, breakdowns and KPIs (AGG1 to AGG33).

Company figures are pre-aggregated per user before the join to users, so the
shuffle carries one row per user (and facet) instead of one per receipt and a
user with a third of all receipts stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.core import AsOf, growth, lookup, mean, newest, num, ratio, total, ts

PERIOD_DAYS = {"weekly": 7, "monthly": 30, "quarterly": 90}
TREND_DAYS = {"weekly": 84, "monthly": 180, "quarterly": 270}
NO_DEPARTMENT = "Sin departamento"
NO_CATEGORY = "Sin categoría"


def window(rows: DataFrame, as_of: AsOf, days: int, end_days: int = 0, column: str = "date") -> DataFrame:
    """Rows of the ``days`` before ``as_of``, both ends included."""
    return rows.filter(F.col(column).between(ts(as_of, -days), ts(as_of, -end_days)))


def status_stats(receipts: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """AGG1: receipt counts by status and the accepted amount."""
    status = F.col("status")
    accepted = F.sum(F.when(status == "aceptada", F.col("total_amount")))
    return receipts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_receipts"),
        F.count_if(status == "en_revision").alias("en_revision"),
        F.count_if(status == "aceptada").alias("aceptadas"),
        F.count_if(status == "rechazada").alias("rechazadas"),
        F.coalesce(accepted, F.lit(0)).alias("total_amount"),
    )


def month_to_date(receipts: DataFrame, as_of: AsOf) -> DataFrame:
    """AGG2: sum, count and mean since the first of the month."""
    rows = receipts.filter(F.col("date") >= F.date_trunc("month", ts(as_of)))
    return rows.groupBy("user_id").agg(
        total().alias("total_amount"), F.count(F.lit(1)).alias("total_receipts"), mean().alias("avg_amount")
    )


def category_months(rows: DataFrame, as_of: AsOf, period: str = "monthly", category: str | None = None) -> DataFrame:
    """AGG3: category by month over the look-back; ``rows`` already carries a category label."""
    rows = rows.filter(F.col("date") >= ts(as_of, -TREND_DAYS[period]))
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    return rows.groupBy("user_id", "category", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        total().alias("total"), F.count(F.lit(1)).alias("count"), mean().alias("average")
    )


def month_growth(months: DataFrame) -> DataFrame:
    """AGG4: last month against the previous month present, per user and category."""
    step = F.struct("year", "month", "total")
    steps = months.groupBy("user_id", "category").agg(F.sort_array(F.collect_list(step), asc=False).alias("_m"))
    current, previous = num(F.get("_m", F.lit(0))["total"]), num(F.get("_m", F.lit(1))["total"])
    change = growth(current, previous)
    direction = F.when(change > 5, "increasing").when(change < -5, "decreasing").otherwise("stable")
    return steps.filter(F.size("_m") >= 2).select(
        "user_id",
        "category",
        current.alias("current_month"),
        previous.alias("previous_month"),
        change.alias("growth_percentage"),
        direction.alias("trend_direction"),
        F.size("_m").alias("data_points"),
    )


def _staff(users: DataFrame) -> DataFrame:
    return users.filter(F.col("role") == "employee")


def user_spend(receipts: DataFrame, as_of: AsOf, days: int) -> DataFrame:
    """Per-user sum and count over the current window; the base of AGG6, 8, 10, 12, 13."""
    return window(receipts, as_of, days).groupBy("user_id").agg(
        total().alias("total_amount"), F.count(F.lit(1)).alias("receipt_count")
    )


def period_comparison(receipts: DataFrame, users: DataFrame, as_of: AsOf, period: str = "monthly") -> DataFrame:
    """AGG5: this and the previous period per employer, from one scan.

    Both windows include both ends, so a receipt exactly on the border counts
    in both.
    """
    days = PERIOD_DAYS[period]
    amount, when = F.col("total_amount"), F.col("date")
    now = when >= ts(as_of, -days)
    before = when <= ts(as_of, -days)
    per_user = window(receipts, as_of, 2 * days).groupBy("user_id").agg(
        F.sum(F.when(now, amount)).alias("_now"),
        F.sum(F.when(before, amount)).alias("_before"),
        F.count_if(now).alias("_receipts"),
        F.count_if(now | before).alias("_any"),
    )
    rows = per_user.join(_staff(users).select("user_id", "employer_id"), "user_id")
    sums = rows.groupBy("employer_id").agg(
        total("_now").alias("total_expenses"),
        total("_before").alias("previous_expenses"),
        F.sum("_receipts").alias("total_receipts"),
        F.count_if(F.col("_receipts") > 0).alias("active_employees"),
    )
    return sums.withColumn("growth_rate", growth(F.col("total_expenses"), F.col("previous_expenses")))


def employee_ranking(receipts: DataFrame, users: DataFrame, as_of: AsOf, days: int = 30, top: int | None = None) -> DataFrame:
    """AGG6: spend per employee with name and department; optionally the top per employer."""
    people = _staff(users).select("user_id", "employer_id", "name", "department")
    rows = user_spend(receipts, as_of, days).join(people, "user_id")
    rows = rows.withColumn("avg_per_receipt", ratio(F.col("total_amount"), F.col("receipt_count")))
    if top is None:
        return rows
    return newest(rows, ["employer_id"], [F.col("total_amount").desc(), F.col("user_id").asc()], top)


def category_breakdown(receipts: DataFrame, users: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """AGG7: spend by category per employer; a missing category stays a null group."""
    per_user = window(receipts, as_of, days).groupBy("user_id", "category").agg(
        total().alias("_t"), F.count(F.lit(1)).alias("_n")
    )
    people = _staff(users).select("user_id", "employer_id")
    return (
        per_user.join(people, "user_id")
        .groupBy("employer_id", "category")
        .agg(F.sum("_t").alias("total_amount"), F.sum("_n").alias("receipt_count"))
    )


def department_summary(receipts: DataFrame, users: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """AGG8: spend and spending employees per department."""
    people = _staff(users).select("user_id", "employer_id", "department")
    rows = user_spend(receipts, as_of, days).join(people, "user_id")
    sums = rows.groupBy("employer_id", "department").agg(
        F.sum("total_amount").alias("total_amount"),
        F.sum("receipt_count").alias("receipt_count"),
        F.count(F.lit(1)).alias("employee_count"),
    )
    return sums.withColumn("avg_per_employee", ratio(F.col("total_amount"), F.col("employee_count")))


def sunday_week(when: Column) -> Column:
    """Week of the year from 0 to 53; weeks start on Sunday, days before the first Sunday are week 0."""
    return F.floor((F.dayofyear(when) + 7 - F.dayofweek(when)) / 7)


def weekly_trend(receipts: DataFrame, users: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """AGG9: spend by Sunday-first week per employer."""
    per_user = (
        window(receipts, as_of, days)
        .groupBy("user_id", F.year("date").alias("year"), sunday_week(F.col("date")).alias("week"))
        .agg(total().alias("_t"), F.count(F.lit(1)).alias("_n"))
    )
    return (
        per_user.join(_staff(users).select("user_id", "employer_id"), "user_id")
        .groupBy("employer_id", "year", "week")
        .agg(F.sum("_t").alias("total_amount"), F.sum("_n").alias("receipt_count"))
    )


def company_overview(receipts: DataFrame, users: DataFrame, as_of: AsOf, period: str = "monthly") -> DataFrame:
    """AGG10: period KPIs with the mean over all employees, spending or not."""
    headcount = _staff(users).groupBy("employer_id").agg(F.count(F.lit(1)).alias("total_employees"))
    rows = headcount.join(period_comparison(receipts, users, as_of, period), "employer_id", "left")
    filled = rows.na.fill(
        0, ["total_expenses", "previous_expenses", "total_receipts", "active_employees", "growth_rate"]
    )
    return filled.withColumn("avg_per_employee", ratio(F.col("total_expenses"), F.col("total_employees")))


def company_alerts(
    receipts: DataFrame, users: DataFrame, as_of: AsOf, period: str = "monthly", growth_over: float = 20.0
) -> DataFrame:
    """AGG11: growth above the threshold, and a top spender above twice the mean."""
    overview = company_overview(receipts, users, as_of, period)
    rising = overview.filter(F.col("growth_rate") > growth_over).select(
        "employer_id", F.lit("warning").alias("type"), F.lit("high").alias("severity"), F.col("growth_rate").alias("value")
    )
    top = employee_ranking(receipts, users, as_of, PERIOD_DAYS[period], top=1)
    spender = (
        top.select("employer_id", "total_amount")
        .join(overview.select("employer_id", "avg_per_employee"), "employer_id")
        .filter(num("total_amount") > F.col("avg_per_employee") * 2)
        .select("employer_id", F.lit("info").alias("type"), F.lit("medium").alias("severity"), num("total_amount").alias("value"))
    )
    return rising.unionByName(spender)


def headline(receipts: DataFrame, users: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """AGG12: top employee, category and department of every employer."""

    def best(rows: DataFrame, label: str, title: str) -> DataFrame:
        order = F.struct("total_amount", label)
        picked = rows.filter(F.col(label).isNotNull()).groupBy("employer_id").agg(F.max(order).alias("_b"))
        return picked.select(
            "employer_id",
            F.lit(title).alias("title"),
            F.col(f"_b.{label}").alias("value"),
            F.col("_b.total_amount").cast("decimal(38,2)").alias("total_amount"),
        )

    return (
        best(employee_ranking(receipts, users, as_of, days), "name", "Empleado Más Activo")
        .unionByName(best(category_breakdown(receipts, users, as_of, days), "category", "Categoría Principal"))
        .unionByName(best(department_summary(receipts, users, as_of, days), "department", "Departamento Más Activo"))
    )


def employee_performance(receipts: DataFrame, users: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """AGG13: every employee's period totals beside the mean per spending employee of the company."""
    people = _staff(users).select("user_id", "employer_id", "name", "department")
    spend = people.join(user_spend(receipts, as_of, days), "user_id", "left")
    average = spend.groupBy("employer_id").agg(mean("total_amount").alias("company_avg"))
    return spend.join(average, "employer_id").select(
        "user_id",
        "name",
        F.coalesce("department", F.lit(NO_DEPARTMENT)).alias("department"),
        F.coalesce("total_amount", F.lit(0)).alias("total_spent"),
        F.coalesce("receipt_count", F.lit(0)).alias("receipt_count"),
        ratio(F.col("total_amount"), F.col("receipt_count")).alias("avg_per_receipt"),
        F.coalesce("company_avg", F.lit(0.0)).alias("company_avg"),
    )


def employer_facets(receipts: DataFrame, users: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """AGG14: overall, by employee, by category and by month, from one pass over the receipts."""
    cells = (
        receipts.filter(F.col("date") >= ts(as_of, -days))
        .groupBy(
            "user_id",
            F.coalesce("category", F.lit(NO_CATEGORY)).alias("category"),
            F.date_format("date", "yyyy-MM").alias("month"),
        )
        .agg(total().alias("_t"), F.count(F.lit(1)).alias("_n"))
        .join(_staff(users).select("user_id", "employer_id"), "user_id")
    )
    e, u, c, m = F.col("employer_id"), F.col("user_id"), F.col("category"), F.col("month")
    sets = cells.groupingSets([[e], [e, u], [e, c], [e, m]], e, u, c, m)
    # Bits from the left: employer, user, category, month; 1 means rolled up.
    facet = lookup(F.grouping_id(), {7: "general", 3: "employee", 5: "category", 6: "month"})
    return sets.agg(
        facet.alias("facet"), F.sum("_n").alias("count"), F.sum("_t").alias("total"), ratio(F.sum("_t"), F.sum("_n")).alias("avg")
    )


def category_share(receipts: DataFrame, users: DataFrame, as_of: AsOf, days: int = 30, top: int = 10) -> DataFrame:
    """AGG15: share of each category in the employer's total, two decimals, largest first."""
    rows = receipts.filter(F.col("date") >= ts(as_of, -days)).withColumn(
        "category", F.coalesce("category", F.lit(NO_CATEGORY))
    )
    cells = category_breakdown(rows, users, as_of, days)
    whole = F.sum("total_amount").over(Window.partitionBy("employer_id"))
    share = cells.withColumn("percentage", F.bround(ratio(F.col("total_amount"), whole) * 100, 2))
    return newest(share, ["employer_id"], [F.col("total_amount").desc(), F.col("category").asc()], top)


def department_breakdown(receipts: DataFrame, users: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """AGG16: departments with all their employees, with or without receipts."""
    people = _staff(users).select(
        "user_id", "employer_id", F.coalesce("department", F.lit(NO_DEPARTMENT)).alias("department")
    )
    rows = people.join(user_spend(receipts, as_of, days), "user_id", "left")
    sums = rows.groupBy("employer_id", "department").agg(
        F.count(F.lit(1)).alias("employee_count"),
        total("total_amount").alias("total_amount"),
        total("receipt_count").alias("receipts_count"),
    )
    return sums.withColumn("average_per_employee", ratio(F.col("total_amount"), F.col("employee_count")))


def employee_rollup(receipts: DataFrame, users: DataFrame) -> DataFrame:
    """AGG17: receipts per employee and the company's grand total."""
    per_user = receipts.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), total().alias("_t"))
    rows = _staff(users).select("user_id", "employer_id").join(per_user, "user_id", "left")
    sets = rows.groupingSets(
        [[F.col("employer_id"), F.col("user_id")], [F.col("employer_id")]], F.col("employer_id"), F.col("user_id")
    )
    return sets.agg(
        (F.grouping("user_id") == 1).alias("is_total"), total("_n").alias("receipt_count"), total("_t").alias("total_amount")
    )


def categorisation_stats(categories: DataFrame) -> DataFrame:
    """AGG18: per category, how many were set by hand and how many automatically."""
    return categories.groupBy("category").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if("user_corrected").alias("corrected"),
        F.count_if(~F.coalesce("user_corrected", F.lit(False))).alias("automatic"),
    )


def product_stats(products: DataFrame) -> DataFrame:
    """AGG19: per receipt: products, value, mean confidence, rows per method, categories."""
    methods = ["advanced_parser", "manual_entry", "manual_correction"]
    value = F.when(F.col("total_price") > 0, F.col("total_price"))
    return products.groupBy("receipt_id").agg(
        F.count(F.lit(1)).alias("total_products"),
        F.coalesce(F.sum(value), F.lit(0)).alias("total_value"),
        F.avg("confidence").alias("average_confidence"),
        *[F.count_if(F.col("extraction_method") == m).alias(m) for m in methods],
        F.sort_array(F.collect_set("category")).alias("categories"),
    )


def notification_stats(notifications: DataFrame) -> DataFrame:
    """AGG20: total, unread and read, overall and by type and priority, per user."""
    u, kind, priority = F.col("user_id"), F.col("type"), F.col("priority")
    sets = notifications.groupingSets([[u], [u, kind], [u, priority]], u, kind, priority)
    return sets.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("is_read")).alias("unread"),
        F.count_if(F.col("is_read")).alias("read"),
    )


def invitation_stats(invitations: DataFrame) -> DataFrame:
    """AGG21: invitations per status and the acceptance rate."""
    states = ["pending", "accepted", "expired", "cancelled"]
    rows = invitations.groupBy("employer_id").agg(
        F.count(F.lit(1)).alias("total_sent"), *[F.count_if(F.col("status") == s).alias(s) for s in states]
    )
    rate = F.bround(ratio(F.col("accepted"), F.col("total_sent")) * 100, 2)
    return rows.withColumn("acceptance_rate", rate)


# Category, share that triggers advice, recommended share, advice.
BUDGET_RULES = [
    ("Combustible", 25.0, 20.0, "Considera usar transporte público o compartir viajes"),
    ("Comida", 30.0, 25.0, "Considera cocinar más en casa"),
]


def budget_advice(receipts: DataFrame, categories: DataFrame) -> DataFrame:
    """AGG22: categories whose share of the user's whole spend passes the fixed thresholds."""
    joined = categories.select("receipt_id", "category").join(receipts.drop("category"), "receipt_id")
    cells = joined.groupBy("user_id", "category").agg(total().alias("total"))
    share = ratio(F.col("total"), F.sum("total").over(Window.partitionBy("user_id"))) * 100
    limit = lookup(F.col("category"), {c: over for c, over, _, _ in BUDGET_RULES})
    return (
        cells.withColumn("current_percentage", share)
        .filter(F.col("current_percentage") > limit)
        .select(
            "user_id",
            "category",
            "total",
            "current_percentage",
            lookup(F.col("category"), {c: to for c, _, to, _ in BUDGET_RULES}).alias("recommended_percentage"),
            lookup(F.col("category"), {c: text for c, _, _, text in BUDGET_RULES}).alias("message"),
        )
    )


def personal_dashboard(receipts: DataFrame, as_of: AsOf) -> DataFrame:
    """AGG23: totals, this against the previous 30 days, and a ten percent trend, per user."""
    amount, when = F.col("total_amount"), F.col("date")
    this = F.coalesce(F.sum(F.when(when >= ts(as_of, -30), amount)), F.lit(0))
    last = F.coalesce(F.sum(F.when((when >= ts(as_of, -60)) & (when < ts(as_of, -30)), amount)), F.lit(0))
    rows = receipts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_receipts"),
        total().alias("total_amount"),
        this.alias("this_month"),
        last.alias("last_month"),
        mean().alias("average_receipt"),
    )
    now, old = num("this_month"), num("last_month")
    trend = F.when(now > old * 1.1, "up").when(now < old * 0.9, "down").otherwise("stable")
    return rows.withColumn("monthly_trend", trend)


def personal_categories(receipts: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """AGG23: category shares of the period, against the user's all-time total."""
    recent = F.when(F.col("date") >= ts(as_of, -days), F.col("total_amount"))
    cells = receipts.groupBy("user_id", F.coalesce("category", F.lit(NO_CATEGORY)).alias("category")).agg(
        F.sum(recent).alias("amount"), F.count(recent).alias("count"), total().alias("_all")
    )
    whole = F.sum("_all").over(Window.partitionBy("user_id"))
    return cells.withColumn("percentage", ratio(F.col("amount"), whole) * 100).filter(F.col("count") > 0).drop("_all")


# The two spellings of each approval state.
APPROVED = ["aceptada", "approved"]
REJECTED = ["rechazada", "rejected"]
PENDING = ["en_revision", "pending"]


def approval_pivot(
    approvals: DataFrame, users: DataFrame, workflow_id: int | None = None, since: AsOf | None = None, until: AsOf | None = None
) -> DataFrame:
    """AGG24: approvals by state per company, over an optional workflow and date range."""
    rows = approvals
    if workflow_id is not None:
        rows = rows.filter(F.col("workflow_id") == workflow_id)
    if since is not None:
        rows = rows.filter(F.col("created_at") >= ts(since))
    if until is not None:
        rows = rows.filter(F.col("created_at") <= ts(until))
    status = F.col("status")
    per_user = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status.isin(APPROVED)).alias("approved"),
        F.count_if(status.isin(REJECTED)).alias("rejected"),
        F.count_if(status.isin(PENDING)).alias("pending"),
    )
    sums = per_user.join(users.select("user_id", "employer_id"), "user_id").groupBy("employer_id")
    return sums.agg(*[F.sum(c).alias(c) for c in ("total", "approved", "rejected", "pending")])


def amount_band(amount: Column) -> Column:
    return F.when(amount < 100_000, "under_100k").when(amount <= 500_000, "100k_500k").otherwise("over_500k")


def approval_times(approvals: DataFrame, decisions: DataFrame) -> DataFrame:
    """AGG25: mean hours to decision, escalation rate and decisions per approver."""
    first = decisions.groupBy("instance_id").agg(F.min("decided_at").alias("decided_at"))
    rows = approvals.join(first, "instance_id", "left")
    hours = (F.unix_timestamp("decided_at") - F.unix_timestamp("created_at")) / 3600
    escalated = F.count_if(F.col("escalation_count") > 0)
    return rows.groupBy("approver_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("decided_at").alias("decided"),
        F.avg(hours).alias("average_approval_hours"),
        (ratio(escalated, F.count(F.lit(1))) * 100).alias("escalation_rate"),
    )


def approval_rates(approvals: DataFrame, receipts: DataFrame) -> DataFrame:
    """AGG25: approval rate among decided instances, by category and by amount band."""
    facts = receipts.select(
        "receipt_id", F.coalesce("category", F.lit(NO_CATEGORY)).alias("category"), amount_band(F.col("total_amount")).alias("band")
    )
    decided = approvals.filter(F.col("status").isin(APPROVED + REJECTED)).select("receipt_id", "status")
    sets = decided.join(facts, "receipt_id").groupingSets(
        [[F.col("category")], [F.col("band")]], F.col("category"), F.col("band")
    )
    approved = F.count_if(F.col("status").isin(APPROVED))
    return sets.agg(
        F.count(F.lit(1)).alias("decided"), (ratio(approved, F.count(F.lit(1))) * 100).alias("approval_rate")
    )


def top_approvers(approvals: DataFrame, n: int = 5) -> DataFrame:
    """AGG25: approvers with most decided instances."""
    counts = approvals.filter(F.col("status").isin(APPROVED + REJECTED)).groupBy("approver_id").agg(F.count(F.lit(1)).alias("decisions"))
    return counts.orderBy(F.col("decisions").desc(), "approver_id").limit(n)


def category_report(queue: DataFrame) -> DataFrame:
    """AGG26: count, total, rounded mean and share of rows by category."""
    cells = queue.groupBy("category").agg(F.count(F.lit(1)).alias("count"), total().alias("total_amount"))
    rows = F.sum("count").over(Window.partitionBy())
    return cells.select(
        "category",
        "count",
        "total_amount",
        F.floor(ratio(F.col("total_amount"), F.col("count")) + 0.5).alias("average_amount"),
        F.round(ratio(F.col("count"), rows) * 100, 1).alias("percentage"),
    )


def month_report(queue: DataFrame) -> DataFrame:
    """AGG27: count and total by calendar month."""
    return queue.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("count"), total().alias("total_amount")
    )


def export_header(queue: DataFrame) -> DataFrame:
    """AGG28: count, total, mean and distinct categories in one row."""
    return queue.agg(
        F.count(F.lit(1)).alias("total_approvals"),
        total().alias("total_amount"),
        F.coalesce(mean(), F.lit(0.0)).alias("avg_amount"),
        F.count_distinct("category").alias("unique_categories"),
    )


def receipt_list_report(receipts_with_products: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """AGG29: total amount and number of nested products."""
    items = F.when(F.col("products").isNotNull(), F.size("products")).otherwise(0)
    return receipts_with_products.groupBy(*keys).agg(
        total().alias("total_amount"), F.sum(items).alias("total_items"), F.count(F.lit(1)).alias("receipts")
    )


def fuel_totals(expenses: DataFrame) -> DataFrame:
    """AGG30: totals per user and cost per kilometre as the ratio of sums."""
    rows = expenses.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_expenses"),
        total("total_cost").alias("total_amount"),
        total("distance_km").alias("total_distance"),
        total("fuel_needed").alias("total_fuel_liters"),
    )
    per_km = F.when(F.col("total_distance") > 0, num("total_amount") / F.col("total_distance")).otherwise(0.0)
    return rows.withColumn("average_cost_per_km", per_km)


def regional_prices(stations: DataFrame, region: str, fuels: list[str]) -> DataFrame:
    """AGG31: rounded mean of the positive prices per fuel in regions matching the text."""
    rows = stations.filter(F.lower("region").contains(region.lower()))
    long = rows.unpivot(["station_id"], fuels, "fuel_type", "price").filter(F.col("price") > 0)
    return long.groupBy("fuel_type").agg(
        F.floor(F.avg("price") + 0.5).alias("price"), F.count(F.lit(1)).alias("stations")
    )


def approver_digest(approvals: DataFrame, receipts: DataFrame, as_of: AsOf) -> DataFrame:
    """AGG32: per approver: pending, their amount, overdue and above 500,000."""
    pending = approvals.filter(F.col("status") == "en_revision").select("receipt_id", "approver_id", "due_date")
    rows = pending.join(receipts.select("receipt_id", "total_amount"), "receipt_id")
    return rows.groupBy("approver_id").agg(
        F.count(F.lit(1)).alias("pending_count"),
        total().alias("total_amount"),
        F.count_if(F.col("due_date") < ts(as_of)).alias("overdue_count"),
        F.count_if(F.col("total_amount") > 500_000).alias("urgent_count"),
    )


def user_audit(users: DataFrame) -> DataFrame:
    """AGG33: users per role, with and without company and employer."""
    return users.groupBy("role").agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col("company_name").isNotNull()).alias("with_company"),
        F.count_if(F.col("company_name").isNull()).alias("without_company"),
        F.count_if(F.col("employer_id").isNotNull()).alias("with_employer"),
        F.count_if(F.col("employer_id").isNull()).alias("without_employer"),
    )


