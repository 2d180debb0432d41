"""Places, heat maps and trips with answers worked out by hand or by brute force."""

import datetime as dt
import random
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from spendlake.operators import geo, joins
from spendlake.sources.canonical import Tables

SCHEMA = "receipt_id long, user_id long, category string, date timestamp, total_amount double, lat double, lng double, address string"
DAY = dt.datetime(2024, 5, 10, 12, 0)
HOME = (-33.4489, -70.6693)


def places(spark, rows):
    full = [(i, 1, "Comida", DAY + dt.timedelta(days=d), float(a), lat, lng, None) for i, (d, a, lat, lng) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def km(a, b):
    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * asin(sqrt(h))


def test_three_visits_to_one_place(spark):
    row = geo.place_stats(places(spark, [(0, 15000, *HOME), (1, 16000, *HOME), (2, 17000, *HOME)])).first()
    assert (row.total_expenses, row.expense_count, row.avg_expense) == (48000, 3, 16000)
    assert row.visit_frequency == pytest.approx(45.0)


def test_heat_map_of_three_points(spark):
    frame = places(spark, [(0, 25000, *HOME), (1, 15000, -33.4520, -70.6650), (2, 30000, -33.4100, -70.5800)])
    clusters = geo.heat_clusters(frame).collect()
    assert sum(c.value for c in clusters) == 70000
    box = geo.bounds(frame).first()
    assert box.north > box.south and box.east > box.west
    assert sum(c.value for c in geo.heat_grid(frame).collect()) == 70000


def test_clusters_match_the_sequential_rule(spark):
    rows = [(i, 100 + i, -33.4 + (i * 37 % 101) * 0.0013, -70.6 + (i * 53 % 97) * 0.0017) for i in range(400)]
    centres = []
    for _, amount, lat, lng in rows:
        hit = next((c for c in centres if km(c["at"], (lat, lng)) <= 0.5), None)
        if hit is None:
            hit = {"at": (lat, lng), "sum": 0.0, "n": 0}
            centres.append(hit)
        hit["sum"] += amount
        hit["n"] += 1
    got = {(round(r.center_lat, 9), round(r.center_lng, 9)): (r.value, r["count"]) for r in geo.heat_clusters(places(spark, rows)).collect()}
    assert got == {(round(c["at"][0], 9), round(c["at"][1], 9)): (c["sum"], c["n"]) for c in centres}


def test_clusters_of_all_users_match_the_sequential_rule(spark):
    """Every user of the table, block by block, and a chain of cells longer than any jump."""
    located = Tables(spark, "/root/testdata/sf0.01").locations
    chain = [(i, 1, -33.0 + i * 0.004, -70.0) for i in range(150)] + [(900 + i, None, 10.0, 20.0 + 0.001 * i) for i in range(20)]
    frame = spark.createDataFrame([(i, u, DAY + dt.timedelta(minutes=i * 37 % 151), 1.0, lat, lng) for i, u, lat, lng in chain], "receipt_id long, user_id long, date timestamp, total_amount double, lat double, lng double")
    for rows in (located, frame):
        centres = {}
        for row in rows.select("user_id", "lat", "lng", "date", "receipt_id", F.col("total_amount").cast("double").alias("amount")).orderBy("date", "receipt_id").collect():
            mine = centres.setdefault(row.user_id, [])
            hit = next((c for c in mine if km(c[0], (row.lat, row.lng)) <= 0.5), None)
            if hit is None:
                hit = [(row.lat, row.lng), 0.0, 0]
                mine.append(hit)
            hit[1] += row.amount
            hit[2] += 1
        want = sorted((str(u), round(c[0][0], 9), round(c[0][1], 9), round(c[1], 2), c[2]) for u, cs in centres.items() for c in cs)
        got = sorted((str(r.user_id), round(r.center_lat, 9), round(r.center_lng, 9), round(r.value, 2), r["count"]) for r in geo.heat_clusters(rows).collect())
        assert got == want


def test_nearest_places_match_brute_force(spark):
    rng = random.Random(4)
    spots = [(f"p{i}", -33.4 + rng.gauss(0, 0.001), -70.6 + rng.gauss(0, 0.001)) for i in range(500)]  # a dense core
    spots += [(f"q{i}", -33.4 + rng.uniform(-0.05, 0.05), -70.6 + rng.uniform(-0.05, 0.05)) for i in range(150)]
    spots += [(f"r{i}", -33.41, -70.61) for i in range(60)]  # many at one point
    origins = [(i, -33.4 + rng.uniform(-0.04, 0.04), -70.6 + rng.uniform(-0.04, 0.04)) for i in range(60)] + [(100 + i, *spots[i][1:]) for i in range(30)] + [(999, 0.0, 0.0)]
    one, two = spark.createDataFrame(origins, "user_id long, lat double, lng double"), spark.createDataFrame(spots, "place_id string, lat double, lng double")
    for n in (1, 4, 25):
        want = set()
        for i, *at in origins:
            near = sorted((km(tuple(at), p[1:]), p[0]) for p in spots)
            want |= {(i, name, round(d, 9)) for d, name in near[:n] if d <= 2.0}
        found = joins.nearby(one, two, 2.0, nearest=n).collect()
        assert {(r.user_id, r.place_id, round(r.km, 9)) for r in found} == want and len(found) == len(want)


def test_one_trip(spark):
    frame = places(
        spark,
        [(-10, 10000, *HOME), (-9, 10000, *HOME), (-7, 25000, -33.0458, -71.6197), (-6, 25000, -33.0458, -71.6197), (-5, 25000, -33.0458, -71.6197)],
    )
    home = spark.createDataFrame([(1, *HOME)], "user_id long, home_lat double, home_lng double")
    trip = geo.trips(frame, home).collect()
    assert [(t.expense_count, t.total_expenses) for t in trip] == [(3, 75000.0)]
    assert trip[0].confidence > 0.5


def test_trip_closing_rule(spark):
    away = (-33.0458, -71.6197)
    days = {1: HOME, 3: away, 4: away, 5: HOME, 9: away, 14: HOME, 15: away, 16: HOME}
    frame = places(spark, [(d, 100, *p) for d, p in days.items()])
    home = spark.createDataFrame([(1, *HOME)], "user_id long, home_lat double, home_lng double")
    rows = geo.trip_days(frame, home).collect()
    found = {}
    for r in rows:
        found.setdefault(r.trip, []).append((r.day - DAY.date()).days)
    assert sorted(sorted(v) for v in found.values()) == [[3, 4], [9, 15]]


def test_nearby_matches_brute_force(spark):
    spots = [(i, -33.4 + (i * 29 % 41) * 0.004, -70.6 + (i * 31 % 43) * 0.004) for i in range(120)]
    origins = spark.createDataFrame([(i, a, b) for i, a, b in spots[:15]], "user_id long, lat double, lng double")
    targets = spark.createDataFrame(spots, "place_id long, lat double, lng double")
    brute = {(o[0], p[0]) for o in spots[:15] for p in spots if km(o[1:], p[1:]) <= 1.0}
    assert {(r.user_id, r.place_id) for r in joins.nearby(origins, targets, 1.0).collect()} == brute


def test_regions(spark):
    frame = spark.createDataFrame([(-33.0, -71.0), (-34.5, -70.0), (-54.0, -70.0), (10.0, 10.0)], "lat double, lng double")
    rows = frame.select(geo.region(F.col("lat")).alias("r"), geo.in_country(F.col("lat"), F.col("lng")).alias("c")).collect()
    assert [(r.r, r.c) for r in rows] == [("Valparaíso", True), ("Región Metropolitana", True), ("Magallanes", True), ("Arica y Parinacota", False)]
