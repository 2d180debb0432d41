"""Queries GEO1 to GEO11."""

from pyspark.sql import functions as F

from spendlake.functions.geo import haversine
from spendlake.operators import geo as ops
from spendlake.plans.bindings import d, r
from spendlake.plans.joins import km
from spendlake.plans.registry import query

PLACE = "printf('%.4f,%.4f', lat, lng)"
SANTIAGO = (-33.4489, -70.6693)


@query("geo1_distance", "locations", f"""SELECT receipt_id, {r(km('-33.4489', '-70.6693', 'lat', 'lng'))} AS km FROM locations""")
def distance(t):
    return t.locations.select("receipt_id", haversine(F.lit(SANTIAGO[0]), F.lit(SANTIAGO[1]), F.col("lat"), F.col("lng")).alias("km"))


def gaps(t):
    """Locations with some coordinates and addresses missing."""
    k = F.col("receipt_id")
    return t.locations.select(
        "receipt_id",
        F.when(k % 4 != 0, F.col("lat")).alias("lat"),
        "lng",
        F.when(k % 8 != 0, F.col("address")).alias("address"),
    )


@query("geo2_place_keys", "locations", f"""SELECT receipt_id, CASE WHEN receipt_id % 4 <> 0 THEN {PLACE} WHEN receipt_id % 8 <> 0 THEN address
 ELSE 'unknown_location' END AS place FROM locations""")
def place_keys(t):
    return ops.keyed(gaps(t)).select("receipt_id", "place")


@query("geo3_place_stats", "locations", f"""WITH c AS (SELECT user_id, {PLACE} AS place, category, sum(total_amount) AS s, count(*) AS n, min(date) AS a, max(date) AS b
 FROM locations GROUP BY ALL), p AS (SELECT user_id, place, sum(s) AS s, cast(sum(n) AS bigint) AS n, string_agg(category || '=' || s, '|' ORDER BY category) AS cats,
 min(a) AS a, max(b) AS b FROM c GROUP BY user_id, place), g AS (SELECT *, floor((epoch(b) - epoch(a)) / 86400) AS days FROM p)
 SELECT user_id, place, {r('s')} AS total_expenses, n AS expense_count, {r('s::double / n')} AS avg_expense, coalesce(cats, '') AS categories,
 {d('a')} AS first_visit, {d('b')} AS last_visit, {r('CASE WHEN days > 0 THEN n::double / days * 30 ELSE 0 END')} AS visit_frequency FROM g""")
def place_stats(t):
    cell = lambda c: F.concat_ws("=", c["category"], c["amount"].cast("string"))
    return ops.place_stats(t.locations).withColumn("categories", F.transform("categories", cell))


@query("geo4_heat_grid", "locations", f"""WITH c AS (SELECT *, floor(lat / (0.5::double / 111.0)) AS cy FROM locations),
 g AS (SELECT *, floor(lng / ((0.5::double / 111.0) / cos(radians(cy * (0.5::double / 111.0))))) AS cx FROM c)
 SELECT cast(cy AS bigint) AS cell_lat, cast(cx AS bigint) AS cell_lng, {r('avg(lat)')} AS lat, {r('avg(lng)')} AS lng, {r('sum(total_amount)')} AS value, count(*) AS count,
 {r('least(sum(total_amount)::double / 50000, 1.0)')} AS intensity FROM g GROUP BY cy, cx""")
def heat_grid(t):
    return ops.heat_grid(t.locations)


@query("geo4_heat_clusters", "locations")
def heat_clusters(t):
    return ops.heat_clusters(t.locations)


@query("geo5_bounds", "locations", f"""SELECT user_id, {r('max(lat)')} AS north, {r('min(lat)')} AS south, {r('max(lng)')} AS east, {r('min(lng)')} AS west,
 {r('avg(lat)')} AS center_lat, {r('avg(lng)')} AS center_lng FROM locations GROUP BY 1""")
def bounds(t):
    return ops.bounds(t.locations, ("user_id",))


@query("geo5_padded_bounds", "locations", f"""WITH b AS (SELECT user_id, max(lat) AS n, min(lat) AS s, max(lng) AS e, min(lng) AS w, avg(lat) AS cy, avg(lng) AS cx FROM locations GROUP BY 1),
 p AS (SELECT *, CASE WHEN n = s THEN 0.01 ELSE (n - s) * 0.1 END AS ph, CASE WHEN e = w THEN 0.01 ELSE (e - w) * 0.1 END AS pw FROM b)
 SELECT user_id, {r('n + ph')} AS north, {r('s - ph')} AS south, {r('e + pw')} AS east, {r('w - pw')} AS west, {r('cy')} AS center_lat, {r('cx')} AS center_lng FROM p""")
def padded_bounds(t):
    return ops.bounds(t.locations, ("user_id",), padding=True)


HOMES = """votes AS (SELECT user_id, printf('%.3f,%.3f', lat, lng) AS spot, sum(CASE WHEN hour(date) >= 19 OR hour(date) <= 7 OR isodow(date) >= 6 THEN 3 ELSE 1 END) AS w
 FROM locations GROUP BY user_id, printf('%.3f,%.3f', lat, lng)),
 homes AS (SELECT user_id, cast(split_part(spot, ',', 1) AS double) AS home_lat, cast(split_part(spot, ',', 2) AS double) AS home_lng, cast(w AS bigint) AS weight
 FROM votes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY w DESC, spot DESC) = 1)"""


@query("geo6_homes", "locations", f"""WITH {HOMES} SELECT user_id, {r('home_lat')} AS home_lat, {r('home_lng')} AS home_lng, weight FROM homes""")
def homes(t):
    return ops.homes(t.locations)


TRIPS = f"""{HOMES}, days AS (SELECT l.user_id, cast(date AS date) AS day, bool_or({km('lat', 'lng', 'home_lat', 'home_lng')} > 20) AS away
 FROM locations l JOIN homes h ON l.user_id = h.user_id GROUP BY ALL),
 marked AS (SELECT *, NOT away AND coalesce(lag(away) OVER w, false) AND day - lag(day) OVER w <= 1 AS closes FROM days WINDOW w AS (PARTITION BY user_id ORDER BY day)),
 trip_days AS (SELECT user_id, day, trip FROM (SELECT *, cast(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day) AS bigint) AS trip FROM marked) WHERE away)"""


@query("geo7_trip_days", "locations", f"""WITH {TRIPS} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, trip FROM trip_days""")
def trip_days(t):
    return ops.trip_days(t.locations, ops.homes(t.locations))


TRIP_ROWS = f"""{TRIPS}, x AS (SELECT l.*, d.day, d.trip, home_lat, home_lng FROM locations l JOIN trip_days d ON l.user_id = d.user_id AND cast(l.date AS date) = d.day
 JOIN homes h ON h.user_id = l.user_id), dist AS (SELECT user_id, trip, count(*) AS destinations, avg({km('lat', 'lng', 'home_lat', 'home_lng')}) AS km FROM (
 SELECT DISTINCT user_id, trip, lat, lng, home_lat, home_lng FROM x) GROUP BY ALL),
 trips AS (SELECT x.user_id, x.trip, min(day) AS a, max(day) AS b, sum(total_amount) AS s, count(*) AS n, any_value(destinations) AS destinations, any_value(km) AS km,
 coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)), '|'), '') AS categories
 FROM x JOIN dist ON x.user_id = dist.user_id AND x.trip = dist.trip GROUP BY x.user_id, x.trip HAVING count(*) >= 2)"""


@query("geo8_trips", "locations", f"""WITH {TRIP_ROWS} SELECT user_id, trip, strftime(a, '%Y-%m-%d') AS start_date, strftime(b, '%Y-%m-%d') AS end_date, {r('s')} AS total_expenses,
 n AS expense_count, destinations, {r('km')} AS avg_distance_km, categories, {r('s::double / destinations')} AS share_per_destination,
 {r('CASE WHEN b - a BETWEEN 1 AND 7 THEN 0.3 WHEN b - a > 7 THEN 0.2 ELSE 0 END + CASE WHEN n >= 5 THEN 0.3 WHEN n >= 3 THEN 0.2 ELSE 0 END + CASE WHEN km > 50 THEN 0.4 WHEN km > 20 THEN 0.2 ELSE 0 END')} AS confidence FROM trips""")
def trips(t):
    return ops.trips(t.locations)


@query("geo9_overview", "locations", f"""WITH {TRIP_ROWS}, o AS (SELECT user_id, count(DISTINCT {PLACE}) AS places, sum(total_amount) AS s, count(*) AS n FROM locations GROUP BY 1),
 top AS (SELECT user_id, category FROM locations WHERE category IS NOT NULL GROUP BY user_id, category
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sum(total_amount) DESC, category DESC) = 1),
 k AS (SELECT user_id, count(*) AS trips FROM trips GROUP BY 1)
 SELECT o.user_id, places AS total_locations, {r('s')} AS total_spent, coalesce(category, 'Desconocido') AS most_frequent_category, coalesce(trips, 0) AS trips,
 {r('coalesce(trips, 0)::double / n * 100')} AS business_trip_percentage FROM o LEFT JOIN top ON top.user_id = o.user_id LEFT JOIN k ON k.user_id = o.user_id""")
def overview(t):
    return ops.overview(t.locations)


@query("geo9_top_places", "locations", f"""SELECT user_id, {PLACE} AS place, {r('sum(total_amount)')} AS total_expenses FROM locations GROUP BY user_id, {PLACE}
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sum(total_amount) DESC, {PLACE}) <= 3""")
def top_places(t):
    return ops.top_places(t.locations, 3).select("user_id", "place", "total_expenses")


BANDS = " ".join(f"WHEN lat > {b} THEN '{n.replace(chr(39), chr(39) * 2)}'" for b, n in ops.REGION_BANDS)


@query("geo10_regions", "locations", f"""SELECT receipt_id, lat BETWEEN -56 AND -17 AND lng BETWEEN -110 AND -66 AS in_country, CASE {BANDS} ELSE 'Magallanes' END AS region FROM locations""")
def regions(t):
    return t.locations.select(
        "receipt_id", ops.in_country(F.col("lat"), F.col("lng")).alias("in_country"), ops.region(F.col("lat")).alias("region")
    )


D = km("home_lat", "home_lng", "lat", "lng")


@query("geo11_distance_checks", "locations", f"""WITH {HOMES}, x AS (SELECT receipt_id, {D} AS km FROM locations l JOIN homes h ON l.user_id = h.user_id)
 SELECT receipt_id, {r('km')} AS km, CASE WHEN km <= 0 THEN 'La distancia debe ser mayor a 0' WHEN km < 0.5 THEN 'La distancia es muy corta para justificar gasto de combustible'
 WHEN km > 1000 THEN 'La distancia parece excesiva para un viaje de trabajo' WHEN km > 500 THEN 'Distancia larga - considere si es necesario para el trabajo' END AS warning,
 km BETWEEN 0.5 AND 1000 AS is_reasonable, km >= 0.1 AS is_different, {r('km / CASE WHEN km > 100 THEN 65 WHEN km < 10 THEN 25 ELSE 45 END * 60')} AS minutes FROM x""")
def distance_checks(t):
    legs = t.locations.join(ops.homes(t.locations), "user_id").select(
        "receipt_id", F.col("home_lat").alias("lat1"), F.col("home_lng").alias("lng1"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2")
    )
    return ops.distance_checks(legs).select("receipt_id", "km", "warning", "is_reasonable", "is_different", "minutes")
