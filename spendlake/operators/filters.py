"""Filters, ordered feeds and top-k reports (FIL1 to FIL14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.core import AsOf, lookup, newest, ts

URGENCY_ORDER = {"high": 3, "medium": 2, "low": 1}


def _contains(columns: list[str], needle: str) -> Column:
    text = needle.strip().lower()
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.lower(F.col(name)).contains(text), F.lit(False))
    return hit


def _either(flag: str | None, column: str) -> Column:
    return F.lit(True) if flag in (None, "all") else F.col(column) == flag


def search_receipts(receipts: DataFrame, text: str = "", category: str = "all", status: str = "all") -> DataFrame:
    """FIL1: free text over vendor, folio number and description, and exact category and status."""
    rows = receipts.filter(_either(category, "category") & _either(status, "status"))
    return rows.filter(_contains(["company_name", "folio_number", "description"], text)) if text.strip() else rows


def urgency(amount: Column) -> Column:
    """Urgency label of a pending approval by its amount."""
    return F.when(amount > 500_000, "high").when(amount > 100_000, "medium").otherwise("low")


def approval_queue(
    queue: DataFrame,
    as_of: AsOf,
    text: str = "",
    level: str = "all",
    category: str = "all",
    amount: str = "all",
    age: str = "all",
) -> DataFrame:
    """FIL2: the approval queue by text, urgency, category, amount band and age."""
    total = F.col("total_amount")
    bands = {
        "under_100k": total < 100_000,
        "100k_500k": total.between(100_000, 500_000),
        "over_500k": total > 500_000,
    }
    created = F.col("created_at")
    ages = {
        "today": F.to_date(created) == F.to_date(ts(as_of)),
        "week": created >= ts(as_of, -7),
        "month": created >= ts(as_of, -30),
    }
    rows = queue.filter(_either(level, "urgency") & _either(category, "category"))
    if amount != "all":
        rows = rows.filter(bands[amount])
    if age != "all":
        rows = rows.filter(ages[age])
    return rows.filter(_contains(["name", "company_name", "category"], text)) if text.strip() else rows


def approval_order() -> list[Column]:
    """FIL3: urgency first, then oldest; the id settles ties."""
    return [lookup(F.col("urgency"), URGENCY_ORDER).desc(), F.col("created_at").asc(), F.col("receipt_id").asc()]


def distinct_categories(rows: DataFrame) -> DataFrame:
    """FIL4: the categories present, sorted."""
    return rows.filter(F.col("category").isNotNull()).select("category").distinct().orderBy("category")


def notification_feed(
    notifications: DataFrame,
    kind: str | None = None,
    priority: str | None = None,
    is_read: bool | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """FIL5: one page of the feed, newest first."""
    return (
        _feed_filter(notifications, kind, priority, is_read)
        .orderBy(F.col("created_at").desc(), F.col("notification_id").desc())
        .offset(offset)
        .limit(limit)
    )


def notification_feed_total(
    notifications: DataFrame, kind: str | None = None, priority: str | None = None, is_read: bool | None = None
) -> DataFrame:
    """FIL5: how many notifications the same filter selects."""
    return _feed_filter(notifications, kind, priority, is_read).agg(F.count(F.lit(1)).alias("total"))


def _feed_filter(rows: DataFrame, kind: str | None, priority: str | None, is_read: bool | None) -> DataFrame:
    rows = rows.filter(_either(kind, "type") & _either(priority, "priority"))
    return rows if is_read is None else rows.filter(F.col("is_read") == is_read)


def user_feed(notifications: DataFrame, unread_only: bool = False, limit: int = 20, skip: int = 0) -> DataFrame:
    """FIL6: the newest notifications of every user, with defaults for missing fields."""
    rows = notifications.filter(~F.coalesce("is_read", F.lit(False))) if unread_only else notifications
    order = [F.col("created_at").desc(), F.col("notification_id").desc()]
    page = newest(rows, ["user_id"], order, limit + skip, rank="_r").filter(F.col("_r") > skip)
    return page.select(
        "notification_id",
        "user_id",
        F.coalesce("type", F.lit("general")).alias("type"),
        F.coalesce("priority", F.lit("medium")).alias("priority"),
        F.coalesce("is_read", F.lit(False)).alias("is_read"),
        "created_at",
    )


FUEL_TEXT = ["purpose", "description", "origin", "destination", "vehicle_type", "fuel_type"]


def search_fuel(expenses: DataFrame, text: str = "", status: str | None = None) -> DataFrame:
    """FIL7: free text over the six text columns present, and an exact status."""
    rows = expenses.filter(_either(status, "status"))
    columns = [c for c in FUEL_TEXT if c in expenses.columns]
    return rows.filter(_contains(columns, text)) if text.strip() else rows


def latest_per_user(expenses: DataFrame) -> DataFrame:
    """FIL8: the most recent expense of every user."""
    row = F.struct(*expenses.columns)
    picked = expenses.groupBy("user_id").agg(F.max_by(row, F.struct("created_at", "expense_id")).alias("_row"))
    return picked.select("_row.*")


def recent_receipts(receipts: DataFrame, n: int = 5) -> DataFrame:
    """FIL9: the ``n`` newest receipts of every user with display labels."""
    labelled = receipts.select(
        "user_id",
        "receipt_id",
        F.coalesce("date", "created_at").alias("date"),
        F.coalesce("total_amount", F.lit(0)).alias("amount"),
        F.coalesce("company_name", F.lit("Proveedor desconocido")).alias("vendor"),
        F.coalesce("category", F.lit("Sin categoría")).alias("category"),
    )
    return newest(labelled, ["user_id"], [F.col("date").desc(), F.col("receipt_id").desc()], n)


def located(
    locations: DataFrame, since: AsOf | None = None, until: AsOf | None = None, categories: list[str] | None = None
) -> DataFrame:
    """FIL10 and FIL11: located rows in an optional, possibly one-sided, date range and category list."""
    rows = locations.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    if since is not None:
        rows = rows.filter(F.col("date") >= ts(since))
    if until is not None:
        rows = rows.filter(F.col("date") <= ts(until))
    return rows.filter(F.col("category").isin(categories)) if categories else rows


def pending_approvals(
    approvals: DataFrame,
    users: DataFrame,
    employer_id: int,
    approver_id: int | None = None,
    approver_role: str | None = None,
) -> DataFrame:
    """FIL12: pending approvals of one company, by approver id or else by role."""
    rows = approvals.filter(F.col("status") == "en_revision")
    if approver_id is not None:
        rows = rows.filter(F.col("approver_id") == approver_id)
    elif approver_role is not None:
        rows = rows.filter(F.col("approver_role") == approver_role)
    staff = users.filter(F.col("employer_id") == employer_id).select("user_id")
    return rows.join(staff, "user_id", "left_semi")


def invitation_list(invitations: DataFrame, employer_id: int, status: str | None = None, limit: int = 50) -> DataFrame:
    """FIL13: one employer's invitations by status, newest first."""
    return (
        invitations.filter((F.col("employer_id") == employer_id) & _either(status, "status"))
        .orderBy(F.col("created_at").desc(), F.col("invitation_id").desc())
        .limit(limit)
    )


def retraining_sample(feedback: DataFrame, newest_rows: int = 50, at_least: int = 5) -> DataFrame:
    """FIL14: newest feedback rows that carry text, or nothing when there are too few.

    The cut comes before the text filter, and the guard counts what is left.
    """
    page = feedback.orderBy(F.col("created_at").desc(), F.col("receipt_id").desc()).limit(newest_rows)
    usable = page.filter(F.length(F.trim(F.coalesce("receipt_text", F.lit("")))) > 0)
    # The page is at most ``newest_rows`` long, so counting it in one task is bounded.
    counted = usable.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return counted.filter(F.col("_n") >= at_least).drop("_n")
