"""Queries JOI1 to JOI12."""

from pyspark.sql import functions as F

from spendlake.operators import joins as ops
from spendlake.plans.bindings import d, r
from spendlake.plans.registry import query


@query("joi1_receipts_with_categories", "receipts categories", f"""SELECT r.receipt_id, r.user_id,
 coalesce(c.category, 'Sin categoría') AS category, {r('total_amount')} AS total_amount
 FROM receipts r LEFT JOIN categories c ON r.receipt_id = c.receipt_id""")
def receipts_with_categories(t):
    return ops.with_categories(t.receipts, t.categories).select("receipt_id", "user_id", "category", "total_amount")


@query("joi2_category_history", "receipts categories", f"""SELECT r.user_id, r.receipt_id, c.category, {d('date')} AS date,
 {r('total_amount')} AS total_amount FROM receipts r JOIN categories c ON r.receipt_id = c.receipt_id
 WHERE c.category = 'Combustible'""")
def category_history(t):
    return ops.category_history(t.receipts, t.categories, "Combustible")


@query("joi3_user_history", "receipts categories", f"""SELECT r.user_id, r.receipt_id, coalesce(c.category, 'Otros') AS category,
 {d('date')} AS date, {r('total_amount')} AS total_amount FROM receipts r LEFT JOIN categories c ON r.receipt_id = c.receipt_id""")
def user_history(t):
    rows = ops.user_history(t.receipts, t.categories)
    return rows.select("user_id", "receipt_id", "category", "date", "total_amount")


@query("joi4_staff_receipts", "receipts users", f"""SELECT receipt_id, user_id, {r('total_amount')} AS total_amount
 FROM receipts WHERE user_id IN (SELECT user_id FROM users WHERE employer_id = 3 AND role = 'employee')""")
def staff_receipts(t):
    return ops.staff_receipts(t.receipts, t.users, 3).select("receipt_id", "user_id", "total_amount")


@query("joi5_roster", "users employers", """SELECT u.employer_id, company_name, user_id, name, email, department
 FROM users u JOIN employers e ON u.employer_id = e.employer_id WHERE role = 'employee'""")
def roster(t):
    return ops.roster(t.users, t.employers)


@query("joi6_employee_receipts", "receipts users", f"""SELECT receipt_id, r.user_id, employer_id, name, department, email,
 {d('date')} AS date, {r('total_amount')} AS total_amount FROM receipts r JOIN users u ON r.user_id = u.user_id""")
def employee_receipts(t):
    rows = ops.employee_receipts(t.receipts, t.users)
    return rows.select("receipt_id", "user_id", "employer_id", "name", "department", "email", "date", "total_amount")


@query("joi7_limits_with_names", "spending_limits users", f"""SELECT limit_id, employee_id, name, email, limit_type,
 {r('limit_amount')} AS limit_amount, {d('l.created_at')} AS created_at
 FROM spending_limits l JOIN users u ON employee_id = user_id""")
def limits_with_names(t):
    rows = ops.limits_with_names(t.spending_limits, t.users)
    return rows.select("limit_id", "employee_id", "name", "email", "limit_type", "limit_amount", "created_at")


@query("joi8_near_pairs", "receipts_dup", """WITH base AS (SELECT *, row_number() OVER (PARTITION BY user_id
 ORDER BY date DESC, receipt_id DESC) AS rn FROM receipts_dup)
 SELECT a.user_id, a.receipt_id, b.receipt_id AS related_receipt_id,
 cast(date_diff('second', b.date, a.date) AS bigint) AS gap_seconds
 FROM base a JOIN base b ON a.user_id = b.user_id AND a.rn < b.rn
 AND a.date <= b.date + interval 24 hour""")
def near_pairs(t):
    return ops.near_pairs(t.receipts_with_copies).select(
        F.col("a.user_id").alias("user_id"),
        F.col("a.receipt_id").alias("receipt_id"),
        F.col("b.receipt_id").alias("related_receipt_id"),
        "gap_seconds",
    )


def branches(t):
    """Known branches of a brand: the distinct places of each vendor, numbered in reading order."""
    point = F.format_string("%.2f,%.2f", "lat", "lng")
    return (
        t.locations.groupBy(F.col("company_name").alias("brand"), point.alias("branch_id"))
        .agg(F.min("lat").alias("branch_lat"), F.min("lng").alias("branch_lng"))
    )


BRANCH_SQL = """branches AS (SELECT company_name AS brand, printf('%.2f,%.2f', lat, lng) AS branch_id, min(lat) AS branch_lat,
 min(lng) AS branch_lng FROM locations GROUP BY 1, 2)"""
KM_SQL = """2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({2}) - radians({0})) / 2), 2)
 + cos(radians({0})) * cos(radians({2})) * pow(sin((radians({3}) - radians({1})) / 2), 2))))"""


def km(*columns):
    return KM_SQL.format(*columns)


NEAR_SQL = f"""points AS (SELECT receipt_id, company_name AS brand, lat + 0.02 AS lat, lng FROM locations WHERE category = 'Retail'
 UNION ALL SELECT receipt_id, company_name, lat + 0.2, lng FROM locations WHERE category IS DISTINCT FROM 'Retail'),
 dist AS (SELECT p.receipt_id, p.brand, branch_id, branch_lat, branch_lng, {km('lat', 'lng', 'branch_lat', 'branch_lng')} AS km
 FROM points p JOIN branches b ON p.brand = b.brand),
 near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY km, branch_id) AS rn FROM dist) WHERE rn = 1),
 firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY branch_id) AS rn FROM branches) WHERE rn = 1)"""


@query("joi9_nearest_branch", "locations", f"""WITH {BRANCH_SQL}, {NEAR_SQL}
 SELECT n.receipt_id, n.brand, {r('CASE WHEN n.km < 5 THEN n.km END')} AS km, n.km < 5 AS is_near,
 {r('CASE WHEN n.km < 5 THEN n.branch_lat ELSE f.branch_lat END')} AS branch_lat,
 {r('CASE WHEN n.km < 5 THEN n.branch_lng ELSE f.branch_lng END')} AS branch_lng
 FROM near n JOIN firsts f ON n.brand = f.brand""")
def nearest_branch(t):
    shift = F.when(F.col("category") == "Retail", F.lit(0.02)).otherwise(F.lit(0.2))
    points = t.locations.select(
        "receipt_id", F.col("company_name").alias("brand"), (F.col("lat") + shift).alias("lat"), "lng"
    )
    return ops.nearest_branch(points, branches(t)).select("receipt_id", "brand", "km", "is_near", "branch_lat", "branch_lng")


@query("joi10_best_location", "locations", f"""WITH {BRANCH_SQL},
 geocodes AS (SELECT address, min(lat) AS lat, min(lng) AS lng FROM locations WHERE address < 'City 2' GROUP BY 1),
 mentions AS (SELECT receipt_id, CASE WHEN receipt_id % 3 <> 0 THEN company_name END AS brand, address FROM locations),
 dist AS (SELECT m.receipt_id, m.brand, branch_id, branch_lat, branch_lng, g.lat AS glat,
  {km('g.lat', 'g.lng', 'branch_lat', 'branch_lng')} AS km
  FROM mentions m LEFT JOIN geocodes g USING (address) JOIN branches b ON m.brand = b.brand),
 near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY km NULLS FIRST, branch_id) AS rn FROM dist) WHERE rn = 1),
 firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY branch_id) AS rn FROM branches) WHERE rn = 1),
 picked AS (SELECT n.receipt_id, CASE WHEN n.km < 5 THEN n.branch_lat ELSE f.branch_lat END AS blat,
  CASE WHEN n.km < 5 THEN n.branch_lng ELSE f.branch_lng END AS blng FROM near n JOIN firsts f ON n.brand = f.brand)
 SELECT m.receipt_id, m.brand, m.address, CASE WHEN blat IS NOT NULL AND g.lat IS NOT NULL THEN 'brand_address'
 WHEN blat IS NOT NULL THEN 'brand' WHEN g.lat IS NOT NULL THEN 'address' ELSE 'none' END AS source,
 {r('coalesce(blat, g.lat)')} AS best_lat, {r('coalesce(blng, g.lng)')} AS best_lng
 FROM mentions m LEFT JOIN geocodes g USING (address) LEFT JOIN picked p ON m.receipt_id = p.receipt_id""")
def best_location(t):
    brand = F.when(F.col("receipt_id") % 3 != 0, F.col("company_name"))
    mentions = t.locations.select("receipt_id", brand.alias("brand"), "address")
    geocodes = (
        t.locations.filter(F.col("address") < "City 2").groupBy("address").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    )
    return ops.best_location(mentions, branches(t), geocodes)


@query("joi11_applicable_limits", "receipts spending_limits", f"""SELECT receipt_id, user_id, limit_id, limit_type,
 {r('limit_amount')} AS limit_amount FROM receipts JOIN spending_limits ON user_id = employee_id
 WHERE is_active AND (NOT retail_only OR category IS NULL OR category = 'Retail')""")
def applicable_limits(t):
    rows = ops.applicable_limits(t.receipts, t.spending_limits)
    return rows.select("receipt_id", "user_id", "limit_id", "limit_type", "limit_amount")


@query("joi12_nearby_places", "locations", f"""WITH places AS (SELECT company_name || '@' || printf('%.3f,%.3f', lat, lng) AS place_id,
 min(lat) AS plat, min(lng) AS plng FROM locations GROUP BY 1),
 homes AS (SELECT user_id, min(lat) AS lat, min(lng) AS lng FROM locations GROUP BY 1)
 SELECT user_id, place_id, {r(km('lat', 'lng', 'plat', 'plng'))} AS km FROM homes
 JOIN places ON abs(plat - lat) < 0.02 AND {km('lat', 'lng', 'plat', 'plng')} <= 1.0""")
def nearby_places(t):
    place = F.concat_ws("@", "company_name", F.format_string("%.3f,%.3f", "lat", "lng"))
    places = t.locations.groupBy(place.alias("place_id")).agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    homes = t.locations.groupBy("user_id").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    return ops.nearby(homes, places, 1.0).select("user_id", "place_id", "km")


@query("joi12_nearest_places", "locations", f"""WITH places AS (SELECT company_name || '@' || printf('%.3f,%.3f', lat, lng) AS place_id,
min(lat) AS plat, min(lng) AS plng FROM locations GROUP BY 1),
homes AS (SELECT user_id, min(lat) AS lat, min(lng) AS lng FROM locations GROUP BY 1),
near AS (SELECT user_id, place_id, {km('lat', 'lng', 'plat', 'plng')} AS km FROM homes JOIN places ON abs(plat - lat) < 0.1 AND {km('lat', 'lng', 'plat', 'plng')} <= 5.0)
SELECT user_id, place_id, {r('km')} AS km FROM near QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY km, place_id) <= 3""")
def nearest_places(t):
    place = F.concat_ws("@", "company_name", F.format_string("%.3f,%.3f", "lat", "lng"))
    places = t.locations.groupBy(place.alias("place_id")).agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    homes = t.locations.groupBy("user_id").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    return ops.nearby(homes, places, 5.0, nearest=3).select("user_id", "place_id", "km")
