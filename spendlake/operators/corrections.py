"""Batch corrections: a table and its corrections in, the new table out (UPD1 to UPD6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions.core import AsOf, ts


def roles_backfilled(users: DataFrame, as_of: AsOf, old: str = "client", new: str = "employee") -> DataFrame:
    """UPD1: one role renamed, with the time and the old role kept on the rows that change."""
    hit = F.col("role") == old
    return users.select(
        *[c for c in users.columns if c != "role"],
        F.when(hit, new).otherwise(F.col("role")).alias("role"),
        F.when(hit, ts(as_of)).alias("migrated_at"),
        F.when(hit, F.col("role")).alias("migration_from"),
    )


def role_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """UPD1: users per role before and after."""
    tagged = before.select("role", F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(
        after.select("role", F.lit(0).alias("_b"), F.lit(1).alias("_a"))
    )
    return tagged.groupBy("role").agg(F.sum("_b").alias("before"), F.sum("_a").alias("after"))


def emails_verified(users: DataFrame, as_of: AsOf) -> DataFrame:
    """UPD2: a missing or false verification flag becomes true, with the time."""
    pending = ~F.coalesce("email_verified", F.lit(False))
    return users.withColumn("migrated_at", F.when(pending, ts(as_of))).withColumn("email_verified", F.lit(True))


def verification_counts(users: DataFrame) -> DataFrame:
    """UPD2: all users and those still unverified."""
    pending = ~F.coalesce("email_verified", F.lit(False))
    return users.agg(F.count(F.lit(1)).alias("total_users"), F.count_if(pending).alias("unverified_users"))


def invitations_expired(invitations: DataFrame, as_of: AsOf) -> DataFrame:
    """UPD3: pending invitations past their expiry become expired."""
    late = (F.col("status") == "pending") & (F.col("expires_at") < ts(as_of))
    return invitations.withColumn("status", F.when(late, "expired").otherwise(F.col("status")))


def marked_read(notifications: DataFrame, requests: DataFrame, as_of: AsOf) -> DataFrame:
    """UPD4: the listed notifications, where the requesting user owns them, become read."""
    wanted = requests.select("notification_id", "user_id").distinct().withColumn("_hit", F.lit(True))
    rows = notifications.join(wanted, ["notification_id", "user_id"], "left")
    hit = F.coalesce("_hit", F.lit(False)) & ~F.coalesce("is_read", F.lit(False))
    return (
        rows.withColumn("read_at", F.when(hit, ts(as_of)))
        .withColumn("is_read", F.coalesce("is_read", F.lit(False)) | hit)
        .drop("_hit")
    )


def _latest(corrections: DataFrame, key: str, value: list[str], order: list[str]) -> DataFrame:
    """The last correction per key, found by an aggregate that combines before the shuffle."""
    picked = corrections.groupBy(key).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("_c"))
    return picked.select(key, *[F.col(f"_c.{v}").alias(f"_{v}") for v in value])


def categories_corrected(categories: DataFrame, corrections: DataFrame) -> DataFrame:
    """UPD5: corrections laid over the categories; a receipt without a category gets a new row."""
    latest = _latest(corrections, "receipt_id", ["category", "user_id"], ["corrected_at", "category"])
    rows = categories.join(latest, "receipt_id", "full_outer")
    touched = F.col("_category").isNotNull()
    return rows.select(
        "receipt_id",
        F.coalesce("user_id", "_user_id").alias("user_id"),
        F.coalesce("_category", "category").alias("category"),
        (touched | F.coalesce("user_corrected", F.lit(False))).alias("user_corrected"),
        F.col("category").isNull().alias("is_new"),
    )


def category_feedback(categories: DataFrame, corrections: DataFrame) -> DataFrame:
    """UPD5: a feedback row for every category that really changes."""
    latest = _latest(corrections, "receipt_id", ["category", "user_id"], ["corrected_at", "category"])
    rows = categories.join(latest, "receipt_id").filter(F.col("category") != F.col("_category"))
    return rows.select(
        "receipt_id", F.col("category").alias("original_category"), F.col("_category").alias("corrected_category")
    )


def products_corrected(products: DataFrame, corrections: DataFrame) -> DataFrame:
    """UPD6: the last correction of every product replaces name and prices and marks the method."""
    fields = ["name", "quantity", "total_price"]
    keys = ["receipt_id", "line", "sku"]  # line numbers may repeat on a receipt
    latest = corrections.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), F.struct("corrected_at", "correction_id")).alias("_c")
    )
    rows = products.join(latest, keys, "left")
    touched = F.col("_c").isNotNull()
    return rows.select(
        *keys,
        *[F.coalesce(F.col(f"_c.{f}"), F.col(f)).alias(f) for f in fields],
        F.when(touched, "manual_correction").otherwise(F.col("extraction_method")).alias("extraction_method"),
    )
