"""Queries FIL1 to FIL14."""

from pyspark.sql import functions as F

from spendlake.operators import filters as ops
from spendlake.plans.bindings import d, r
from spendlake.plans.registry import query
from spendlake.sources.canonical import RECEIPTS_AS_OF as AS_OF

RECEIPT_COLUMNS = ["receipt_id", "user_id", "company_name", "category", "status", "date", "total_amount"]
RECEIPT_SQL = f"receipt_id, user_id, company_name, category, status, {d('date')} AS date, {r('total_amount')} AS total_amount"


def queue(t):
    """Pending approvals with the receipt, the requester and an urgency label."""
    receipts = t.receipts.select("receipt_id", "user_id", "company_name", "category", "total_amount", "created_at", "status")
    pending = receipts.filter(F.col("status") == "en_revision")
    names = t.users.select("user_id", "name")
    return pending.join(names, "user_id").withColumn("urgency", ops.urgency(F.col("total_amount")))


QUEUE_SQL = """queue AS (SELECT receipt_id, r.user_id, company_name, category, total_amount, created_at, name,
 CASE WHEN total_amount > 500000 THEN 'high' WHEN total_amount > 100000 THEN 'medium' ELSE 'low' END AS urgency
 FROM receipts r JOIN users u ON r.user_id = u.user_id WHERE status = 'en_revision')"""
QUEUE_COLUMNS = ["receipt_id", "user_id", "name", "company_name", "category", "urgency", "total_amount", "created_at"]
QUEUE_OUT = f"""receipt_id, user_id, name, company_name, category, urgency, {r('total_amount')} AS total_amount,
 {d('created_at')} AS created_at"""


@query("src1_receipt_scan", "receipts", f"SELECT {RECEIPT_SQL} FROM receipts WHERE user_id IN (1, 2, 3, 5, 8)")
def receipt_scan(t):
    return t.receipts.filter(F.col("user_id").isin(1, 2, 3, 5, 8)).select(RECEIPT_COLUMNS)


@query("fil1_receipt_search", "receipts", f"""SELECT {RECEIPT_SQL} FROM receipts
 WHERE (contains(lower(company_name), 'vendor 1') OR contains(lower(description), 'vendor 1'))
 AND category = 'Comida' AND status = 'aceptada'""")
def receipt_search(t):
    return ops.search_receipts(t.receipts, " VENDOR 1", "Comida", "aceptada").select(RECEIPT_COLUMNS)


@query("fil1_folio_search", "receipts", f"""SELECT {RECEIPT_SQL} FROM receipts
 WHERE contains(lower(company_name), 'f12') OR contains(lower(folio_number), 'f12') OR contains(lower(description), 'f12')""")
def folio_search(t):
    return ops.search_receipts(t.receipts, "f12").select(RECEIPT_COLUMNS)


@query("fil2_approval_queue", "receipts users", f"""WITH {QUEUE_SQL} SELECT {QUEUE_OUT} FROM queue
 WHERE (contains(lower(name), 'vendor 1') OR contains(lower(company_name), 'vendor 1') OR contains(lower(coalesce(category, '')), 'vendor 1'))
 AND urgency = 'medium' AND total_amount BETWEEN 100000 AND 500000
 AND created_at >= timestamp '2001-08-02' - interval 30 day""")
def approval_queue(t):
    rows = ops.approval_queue(queue(t), AS_OF, "vendor 1", "medium", "all", "100k_500k", "month")
    return rows.select(QUEUE_COLUMNS)


@query("fil3_approval_order", "receipts users", f"""WITH {QUEUE_SQL} SELECT {QUEUE_OUT} FROM queue
 ORDER BY CASE urgency WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, queue.created_at, receipt_id""")
def approval_order(t):
    return queue(t).orderBy(*ops.approval_order()).select(QUEUE_COLUMNS)


@query("fil4_distinct_categories", "receipts", """SELECT DISTINCT category FROM receipts
 WHERE category IS NOT NULL ORDER BY category""")
def distinct_categories(t):
    return ops.distinct_categories(t.receipts)


FEED_SQL = f"notification_id, user_id, type, priority, is_read, {d('n.created_at')} AS created_at"
FEED_COLUMNS = ["notification_id", "user_id", "type", "priority", "is_read", "created_at"]


@query("fil5_notification_feed", "notifications", f"""SELECT {FEED_SQL} FROM notifications n
 WHERE type = 'purchase' AND priority = 'high' AND NOT is_read
 ORDER BY n.created_at DESC, notification_id DESC LIMIT 50 OFFSET 10""")
def notification_feed(t):
    return ops.notification_feed(t.notifications, "purchase", "high", False, 50, 10).select(FEED_COLUMNS)


@query("fil5_notification_feed_total", "notifications", """SELECT count(*) AS total FROM notifications
 WHERE type = 'purchase' AND priority = 'high' AND NOT is_read""")
def notification_feed_total(t):
    return ops.notification_feed_total(t.notifications, "purchase", "high", False)


@query("fil6_user_feed", "notifications", f"""SELECT {FEED_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY user_id
 ORDER BY created_at DESC, notification_id DESC) AS rn FROM notifications WHERE NOT is_read) n WHERE rn BETWEEN 6 AND 25""")
def user_feed(t):
    return ops.user_feed(t.notifications, unread_only=True, limit=20, skip=5)


FUEL_SQL = f"expense_id, user_id, distance_km, vehicle_type, fuel_type, origin, destination, status, {d('f.created_at')} AS created_at"
FUEL_COLUMNS = ["expense_id", "user_id", "distance_km", "vehicle_type", "fuel_type", "origin", "destination", "status", "created_at"]


@query("fil7_fuel_search", "fuel_expenses", f"""SELECT {FUEL_SQL} FROM fuel_expenses f WHERE status = 'approved' AND
 (contains(lower(origin), 'city 3') OR contains(lower(destination), 'city 3') OR contains(vehicle_type, 'city 3')
 OR contains(fuel_type, 'city 3'))""")
def fuel_search(t):
    return ops.search_fuel(t.fuel_expenses, "City 3", "approved").select(FUEL_COLUMNS)


@query("fil8_latest_fuel", "fuel_expenses", f"""SELECT {FUEL_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY user_id
 ORDER BY created_at DESC, expense_id DESC) AS rn FROM fuel_expenses) f WHERE rn = 1""")
def latest_fuel(t):
    return ops.latest_per_user(t.fuel_expenses).select(FUEL_COLUMNS)


@query("fil9_recent_receipts", "receipts", f"""SELECT user_id, receipt_id, {d('date')} AS date, {r('total_amount')} AS amount,
 company_name AS vendor, coalesce(category, 'Sin categoría') AS category FROM (SELECT *, row_number() OVER (
 PARTITION BY user_id ORDER BY date DESC, receipt_id DESC) AS rn FROM receipts) WHERE rn <= 5""")
def recent_receipts(t):
    return ops.recent_receipts(t.receipts)


LOCATED_COLUMNS = ["receipt_id", "user_id", "category", "lat", "lng"]
LOCATED_SQL = f"receipt_id, user_id, category, {r('lat')} AS lat, {r('lng')} AS lng"


@query("fil10_located_receipts", "locations", f"""SELECT {LOCATED_SQL} FROM locations WHERE date BETWEEN
 timestamp '2000-01-01' AND timestamp '2000-12-31' AND category IN ('Comida', 'Retail')""")
def located_receipts(t):
    return ops.located(t.locations, "2000-01-01", "2000-12-31", ["Comida", "Retail"]).select(LOCATED_COLUMNS)


@query("fil11_one_sided_range", "locations", f"""SELECT {LOCATED_SQL} FROM locations
 WHERE date >= timestamp '2001-01-01' AND category = 'Combustible'""")
def one_sided_range(t):
    return ops.located(t.locations, since="2001-01-01", categories=["Combustible"]).select(LOCATED_COLUMNS)


PENDING_SQL = f"instance_id, a.user_id, approver_id, approver_role, {d('created_at')} AS created_at"
PENDING_COLUMNS = ["instance_id", "user_id", "approver_id", "approver_role", "created_at"]


@query("fil12_pending_by_approver", "approvals users", f"""SELECT {PENDING_SQL} FROM approvals a JOIN users u
 ON a.user_id = u.user_id WHERE employer_id = 7 AND status = 'en_revision' AND approver_id = 11""")
def pending_by_approver(t):
    return ops.pending_approvals(t.approvals, t.users, 7, approver_id=11).select(PENDING_COLUMNS)


@query("fil12_pending_by_role", "approvals users", f"""SELECT {PENDING_SQL} FROM approvals a JOIN users u
 ON a.user_id = u.user_id WHERE employer_id = 7 AND status = 'en_revision' AND approver_role = 'manager'""")
def pending_by_role(t):
    return ops.pending_approvals(t.approvals, t.users, 7, approver_role="manager").select(PENDING_COLUMNS)


@query("fil13_invitation_list", "invitations", f"""SELECT invitation_id, status, {d('i.created_at')} AS created_at
 FROM invitations i WHERE employer_id = 4 AND status = 'pending'
 ORDER BY i.created_at DESC, invitation_id DESC LIMIT 50""")
def invitation_list(t):
    return ops.invitation_list(t.invitations, 4, "pending").select("invitation_id", "status", "created_at")


def feedback(t):
    """Category corrections as feedback rows; the receipt text is the vendor and description."""
    text = F.when(F.col("receipt_id") % 3 != 0, F.concat_ws(" ", "company_name", "description"))
    corrected = t.categories.filter("user_corrected").select("receipt_id", "category")
    return t.receipts.select("receipt_id", "created_at", text.alias("receipt_text")).join(corrected, "receipt_id")


@query("fil14_retraining_sample", "receipts categories", """WITH page AS (SELECT r.receipt_id, c.category,
 CASE WHEN r.receipt_id % 3 <> 0 THEN company_name || ' ' || description END AS receipt_text
 FROM receipts r JOIN categories c ON r.receipt_id = c.receipt_id WHERE user_corrected
 ORDER BY r.created_at DESC, r.receipt_id DESC LIMIT 50),
 usable AS (SELECT * FROM page WHERE length(trim(coalesce(receipt_text, ''))) > 0)
 SELECT receipt_id, category, receipt_text FROM usable WHERE (SELECT count(*) FROM usable) >= 5""")
def retraining_sample(t):
    return ops.retraining_sample(feedback(t)).select("receipt_id", "category", "receipt_text")
