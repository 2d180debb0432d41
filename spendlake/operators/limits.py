"""Spending limits: periods, usage, status, validation and alerts (LIM1 to LIM7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.core import AsOf, newest, num, ratio, total, ts
from spendlake.operators.joins import OTHER, applicable_limits

LIMIT_TYPES = ["daily", "weekly", "monthly", "yearly"]


def period_start(kind: Column | str, as_of: AsOf) -> Column:
    """LIM1: start of the day, Monday week, month or year; month for anything else."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    now = ts(as_of)
    return (
        F.when(kind == "daily", F.date_trunc("day", now))
        .when(kind == "weekly", F.date_trunc("week", now))
        .when(kind == "yearly", F.date_trunc("year", now))
        .otherwise(F.date_trunc("month", now))
    )


def period_table(limits: DataFrame, as_of: AsOf) -> DataFrame:
    """LIM1: the current period of every limit."""
    return limits.withColumn("period_start", period_start(F.col("limit_type"), as_of))


def usage(receipts: DataFrame, users: DataFrame, as_of: AsOf, period: str = "monthly") -> DataFrame:
    """LIM2: per employee the spend, count and category breakdown of the period; idle employees count as zero."""
    rows = receipts.filter((F.col("created_at") >= period_start(period, as_of)) & (F.col("created_at") <= ts(as_of)))
    cells = rows.groupBy("user_id", F.coalesce("category", F.lit(OTHER)).alias("category")).agg(
        total().alias("amount"), F.count(F.lit(1)).alias("_n")
    )
    whole = F.sum("amount").over(Window.partitionBy("user_id"))
    share = cells.withColumn("percentage", F.bround(ratio(F.col("amount"), whole) * 100, 2))
    per_user = share.groupBy("user_id").agg(
        F.sum("amount").alias("total_spent"),
        F.sum("_n").alias("transaction_count"),
        F.sort_array(F.collect_list(F.struct("category", "amount", "percentage"))).alias("categories"),
    )
    people = users.filter(F.col("role") == "employee").select("user_id", "name")
    return people.join(per_user, "user_id", "left").select(
        "user_id",
        "name",
        F.coalesce("total_spent", F.lit(0)).alias("total_spent"),
        F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"),
        F.coalesce("categories", F.array()).alias("categories"),
    )


def period_totals(receipts: DataFrame, as_of: AsOf, start=period_start) -> DataFrame:
    """Spend per user and limit type, for all periods in one scan."""
    when = F.col("created_at")
    rows = receipts.filter((when >= start("yearly", as_of)) & (when <= ts(as_of)))
    sums = [F.coalesce(F.sum(F.when(when >= start(k, as_of), F.col("total_amount"))), F.lit(0)).alias(k) for k in LIMIT_TYPES]
    wide = rows.groupBy("user_id").agg(*sums)
    return wide.unpivot(["user_id"], LIMIT_TYPES, "limit_type", "current_usage")


def days_until_reset(kind: Column, as_of: AsOf) -> Column:
    """Whole days until the period of a limit starts again."""
    now = ts(as_of)
    day = F.to_date(now)
    return (
        F.when(kind == "daily", F.lit(1))
        .when(kind == "weekly", 7 - F.weekday(day))
        .when(kind == "monthly", F.datediff(F.last_day(day), day) + 1)
        .when(kind == "yearly", F.datediff(F.add_months(F.trunc(day, "year"), 12), day))
        .otherwise(F.lit(0))
    )


def limit_status(receipts: DataFrame, limits: DataFrame, as_of: AsOf) -> DataFrame:
    """LIM3: usage of every active limit in its own period, with percentage and days to reset."""
    used = period_totals(receipts, as_of).withColumnRenamed("user_id", "employee_id")
    rows = limits.filter("is_active").join(used, ["employee_id", "limit_type"], "left")
    spent = F.coalesce("current_usage", F.lit(0))
    share = F.when(F.col("limit_amount") > 0, num(spent) / num("limit_amount") * 100).otherwise(0.0)
    return rows.select(
        "limit_id",
        "employee_id",
        "limit_type",
        "limit_amount",
        spent.alias("current_usage"),
        F.bround(share, 2).alias("usage_percentage"),
        (share > 100).alias("is_exceeded"),
        days_until_reset(F.col("limit_type"), as_of).alias("days_until_reset"),
    )


def validate_transactions(transactions: DataFrame, limits: DataFrame, receipts: DataFrame, as_of: AsOf) -> DataFrame:
    """LIM4: which limits each transaction would exceed, which it brings above 80 %, and whether it is valid."""
    used = period_totals(receipts, as_of)
    rows = applicable_limits(transactions, limits).join(used, ["user_id", "limit_type"], "left")
    after = num(F.coalesce("current_usage", F.lit(0))) + num("total_amount")
    limit = num("limit_amount")
    over = after - limit
    share = F.when(limit > 0, after / limit * 100).otherwise(0.0)
    exceeded = F.when(over > 0, F.col("limit_id"))
    warned = F.when((over <= 0) & (share > 80), F.col("limit_id"))
    # A transaction meets at most the few limits of its own user.
    checked = rows.groupBy("receipt_id").agg(
        F.sort_array(F.collect_list(exceeded)).alias("exceeded_limits"),
        F.sort_array(F.collect_list(warned)).alias("warnings"),
    )
    kept = transactions.select("receipt_id", "user_id", "total_amount").join(checked, "receipt_id", "left")
    empty = F.array().cast("array<string>")
    return kept.select(
        "receipt_id",
        "user_id",
        "total_amount",
        F.coalesce("exceeded_limits", empty).alias("exceeded_limits"),
        F.coalesce("warnings", empty).alias("warnings"),
        (F.coalesce(F.size("exceeded_limits"), F.lit(0)) <= 0).alias("is_valid"),
    )


def bulk_limits(
    requested: DataFrame,
    users: DataFrame,
    employer_id: int,
    limit_type: str = "monthly",
    limit_amount: float = 0,
    restrictions: tuple[str, ...] = (),
    currency: str = "CLP",
) -> DataFrame:
    """LIM5: one new limit for every requested user who is an employee of the employer."""
    people = users.filter((F.col("employer_id") == employer_id) & (F.col("role") == "employee"))
    rows = people.join(requested.select("user_id").distinct(), "user_id", "left_semi")
    listed = F.array(*[F.lit(x) for x in restrictions]) if restrictions else F.array().cast("array<string>")
    return rows.select(
        F.col("user_id").alias("employee_id"),
        F.col("name").alias("employee_name"),
        F.col("email").alias("employee_email"),
        F.lit(limit_type).alias("limit_type"),
        F.lit(limit_amount).cast("decimal(18,2)").alias("limit_amount"),
        F.lit(currency).alias("currency"),
        listed.alias("category_restrictions"),
        F.lit(True).alias("is_active"),
        F.col("employer_id").alias("created_by"),
    )


def limit_alerts(receipts: DataFrame, limits: DataFrame, as_of: AsOf, over: float = 90.0) -> DataFrame:
    """LIM6: limits used above 90 %; monthly limits since the first, all others over the last seven days."""

    def start(kind: str, now: AsOf) -> Column:
        return F.date_trunc("month", ts(now)) if kind == "monthly" else ts(now, -7)

    when = F.col("created_at")
    first = F.least(start("monthly", as_of), start("other", as_of))
    rows = receipts.filter((when >= first) & (when <= ts(as_of)))
    sums = [
        F.sum(F.when(when >= start(k, as_of), F.col("total_amount"))).alias(f"_{k}") for k in ("monthly", "other")
    ]
    used = rows.groupBy(F.col("user_id").alias("employee_id")).agg(*sums)
    joined = limits.filter("is_active").join(used, "employee_id")
    spent = F.coalesce(F.when(F.col("limit_type") == "monthly", F.col("_monthly")).otherwise(F.col("_other")), F.lit(0))
    share = F.when(F.col("limit_amount") > 0, num(spent) / num("limit_amount") * 100).otherwise(0.0)
    return (
        joined.withColumn("current_usage", spent)
        .withColumn("usage_percentage", share)
        .filter(F.col("usage_percentage") > over)
        .select(
            "limit_id",
            "employee_id",
            "limit_type",
            F.when(F.col("usage_percentage") > 100, "high").otherwise("medium").alias("severity"),
            "limit_amount",
            "current_usage",
            "usage_percentage",
        )
    )


def category_concentration(receipts: DataFrame, as_of: AsOf, over: float = 0.5, top: int = 3) -> DataFrame:
    """LIM7: users whose top category holds more than half of their three top categories."""
    rows = receipts.filter((F.col("created_at") >= ts(as_of, -30)) & (F.col("created_at") <= ts(as_of)))
    cells = rows.groupBy("user_id", "category").agg(total().alias("total"), F.count(F.lit(1)).alias("transaction_count"))
    ranked = newest(cells, ["user_id"], [F.col("total").desc(), F.col("category").asc()], top, rank="_r")
    share = ratio(F.col("total"), F.sum("total").over(Window.partitionBy("user_id")))
    return (
        ranked.withColumn("_s", share)
        .filter((F.col("_r") == 1) & (F.col("_s") > over))
        .select("user_id", "category", F.col("total").alias("amount"), (F.col("_s") * 100).alias("percentage"), "transaction_count")
    )
