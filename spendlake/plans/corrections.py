"""Queries UPD1 to UPD6."""

from pyspark.sql import functions as F

from spendlake.functions.core import lookup
from spendlake.operators import corrections as ops
from spendlake.plans.bindings import d, r
from spendlake.plans.registry import query

NOW = "2001-07-31"
STAMP = "'2001-07-31 00:00:00'"


def old_users(t):
    """Users before the migration: a third still have the old role, half no verification flag."""
    k = F.col("user_id")
    return t.users.select(
        "user_id",
        "name",
        F.when(k % 3 == 0, "client").otherwise(F.col("role")).alias("role"),
        F.when(k % 4 == 0, F.lit(False)).when(k % 4 == 1, F.lit(True)).alias("email_verified"),
    )


@query("upd1_roles_backfilled", "users", f"""SELECT user_id, name, 'employee' AS role, CASE WHEN user_id % 3 = 0 THEN {STAMP} END AS migrated_at,
 CASE WHEN user_id % 3 = 0 THEN 'client' END AS migration_from FROM users""")
def roles_backfilled(t):
    return ops.roles_backfilled(old_users(t).drop("email_verified"), NOW)


@query("upd1_role_counts", "users", """SELECT role, cast(sum(b) AS bigint) AS before, cast(sum(a) AS bigint) AS after FROM (
 SELECT CASE WHEN user_id % 3 = 0 THEN 'client' ELSE 'employee' END AS role, 1 AS b, 0 AS a FROM users UNION ALL SELECT 'employee', 0, 1 FROM users) GROUP BY 1""")
def role_counts(t):
    before = old_users(t)
    return ops.role_counts(before, ops.roles_backfilled(before, NOW))


@query("upd2_emails_verified", "users", f"""SELECT user_id, true AS email_verified, CASE WHEN user_id % 4 <> 1 THEN {STAMP} END AS migrated_at FROM users""")
def emails_verified(t):
    return ops.emails_verified(old_users(t), NOW).select("user_id", "email_verified", "migrated_at")


@query("upd2_verification_counts", "users", "SELECT count(*) AS total_users, count(*) FILTER (user_id % 4 <> 1) AS unverified_users FROM users")
def verification_counts(t):
    return ops.verification_counts(old_users(t))


@query("upd3_invitations_expired", "invitations", f"""SELECT invitation_id, CASE WHEN status = 'pending' AND invitations.expires_at < timestamp '2001-07-31' THEN 'expired' ELSE status END AS status,
 {d('expires_at')} AS expires_at FROM invitations""")
def invitations_expired(t):
    return ops.invitations_expired(t.invitations, NOW).select("invitation_id", "status", "expires_at")


def read_requests(t):
    """Requests to mark notifications as read; every fifth names a notification of someone else."""
    k = F.col("notification_id")
    owner = F.when(k % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    return t.notifications.filter(F.col("type") == "purchase").select("notification_id", owner.alias("user_id"))


@query("upd4_marked_read", "notifications", f"""SELECT notification_id, user_id, is_read OR (type = 'purchase' AND notification_id % 5 <> 0) AS is_read,
 CASE WHEN NOT is_read AND type = 'purchase' AND notification_id % 5 <> 0 THEN {STAMP} END AS read_at FROM notifications""")
def marked_read(t):
    return ops.marked_read(t.notifications, read_requests(t), NOW).select("notification_id", "user_id", "is_read", "read_at")


def category_corrections(t):
    """Corrections from the order lines: the last line of a receipt with a returned flag decides."""
    names = {0: "Retail", 1: "Comida", 2: "Combustible", 3: "Supermercado", 4: "Salud"}
    return t.raw("lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("receipt_id"),
        (F.col("l_orderkey") % 100).alias("user_id"),
        lookup(F.col("l_linenumber") % 5, names).alias("category"),
        F.col("l_shipdate").alias("corrected_at"),
    )


CORR = """corr AS (SELECT l_orderkey AS receipt_id, CASE l_linenumber % 5 WHEN 0 THEN 'Retail' WHEN 1 THEN 'Comida' WHEN 2 THEN 'Combustible'
 WHEN 3 THEN 'Supermercado' ELSE 'Salud' END AS category, l_orderkey % 100 AS user_id, l_shipdate FROM lineitem WHERE l_returnflag = 'R'),
 latest AS (SELECT * FROM corr QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY l_shipdate DESC, category DESC) = 1)"""


@query("upd5_categories_corrected", "categories", f"""WITH {CORR} SELECT coalesce(c.receipt_id, l.receipt_id) AS receipt_id, coalesce(c.user_id, l.user_id) AS user_id,
 coalesce(l.category, c.category) AS category, l.category IS NOT NULL OR coalesce(user_corrected, false) AS user_corrected, c.category IS NULL AS is_new
 FROM categories c FULL OUTER JOIN latest l ON c.receipt_id = l.receipt_id""")
def categories_corrected(t):
    return ops.categories_corrected(t.categories, category_corrections(t))


@query("upd5_category_feedback", "categories", f"""WITH {CORR} SELECT c.receipt_id, c.category AS original_category, l.category AS corrected_category
 FROM categories c JOIN latest l ON c.receipt_id = l.receipt_id WHERE c.category <> l.category""")
def category_feedback(t):
    return ops.category_feedback(t.categories, category_corrections(t))


def product_corrections(t):
    """Corrections of discounted lines; the line also identifies the correction."""
    return t.raw("lineitem").filter(F.col("l_discount") > 0.07).select(
        F.col("l_orderkey").alias("receipt_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("sku"),
        F.concat(F.lit("corrected "), F.col("l_partkey").cast("string")).alias("name"),
        F.lit(None).cast("double").alias("quantity"),
        (F.col("l_extendedprice").cast("decimal(18,2)") * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(18,2)").alias("total_price"),
        F.col("l_shipdate").alias("corrected_at"),
        F.col("l_suppkey").alias("correction_id"),
    )


@query("upd6_products_corrected", "receipt_products", f"""WITH latest AS (SELECT l_orderkey, l_linenumber, l_partkey, 'corrected ' || l_partkey AS name,
 cast(cast(l_extendedprice AS decimal(14,2)) * 0.5::decimal(2,1) AS decimal(18,2)) AS price FROM lineitem WHERE l_discount > 0.07 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey
 ORDER BY l_shipdate DESC, l_suppkey DESC) = 1)
 SELECT receipt_id, line, sku, coalesce(l.name, p.name) AS name, {r('quantity')} AS quantity, {r('coalesce(price, total_price)')} AS total_price,
 CASE WHEN price IS NOT NULL THEN 'manual_correction' ELSE extraction_method END AS extraction_method
 FROM receipt_products p LEFT JOIN latest l ON receipt_id = l_orderkey AND line = l_linenumber AND sku = l_partkey""")
def products_corrected(t):
    return ops.products_corrected(t.receipt_products, product_corrections(t))
