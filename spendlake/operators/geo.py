"""Location statistics, heat maps, home inference and trips (GEO1 to GEO11)."""

from __future__ import annotations

from collections.abc import Iterator
from math import asin, cos, floor, radians, sin, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.blocks import connected_blocks
from spendlake.functions.core import newest, num, ratio, total
from spendlake.functions.geo import EARTH_KM, haversine, place_key

# Full heat, distances in km, country box, regions from north to south, speeds in km/h.
FULL_HEAT = 50_000
CLUSTER_KM = 0.5
AWAY_KM = 20.0
COUNTRY_BOX = {"lat": (-56, -17), "lng": (-110, -66)}
REGION_BANDS = [
    (-18.5, "Arica y Parinacota"),
    (-21.4, "Tarapacá"),
    (-26.1, "Antofagasta"),
    (-29.1, "Atacama"),
    (-32.2, "Coquimbo"),
    (-34.2, "Valparaíso"),
    (-35.0, "Región Metropolitana"),
    (-36.0, "O'Higgins"),
    (-36.5, "Maule"),
    (-38.5, "Ñuble"),
    (-39.4, "Biobío"),
    (-40.6, "Araucanía"),
    (-44.0, "Los Ríos"),
    (-46.0, "Los Lagos"),
    (-49.0, "Aysén"),
]
SOUTHMOST = "Magallanes"
SPEEDS = {"city": 25, "mixed": 45, "road": 65}


def keyed(locations: DataFrame) -> DataFrame:
    """GEO2: rows with their place key."""
    return locations.withColumn("place", place_key(F.col("lat"), F.col("lng"), F.col("address")))


def place_stats(locations: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """GEO3: totals, mean, categories, first and last visit and visits per month of every place.

    Categories are summed first, so the second level handles one row per place
    and category.
    """
    cells = (
        keyed(locations)
        .groupBy(*keys, "place", "category")
        .agg(total().alias("_t"), F.count(F.lit(1)).alias("_n"), F.min("date").alias("_a"), F.max("date").alias("_b"))
    )
    named = F.when(F.col("category").isNotNull(), F.struct("category", F.col("_t").alias("amount")))
    places = cells.groupBy(*keys, "place").agg(
        F.sum("_t").alias("total_expenses"),
        F.sum("_n").alias("expense_count"),
        F.sort_array(F.collect_list(named)).alias("categories"),
        F.min("_a").alias("first_visit"),
        F.max("_b").alias("last_visit"),
    )
    days = F.floor((F.unix_timestamp("last_visit") - F.unix_timestamp("first_visit")) / 86400)
    return places.withColumn("avg_expense", ratio(F.col("total_expenses"), F.col("expense_count"))).withColumn(
        "visit_frequency", F.when(days > 0, F.col("expense_count") / days * 30).otherwise(0.0)
    )


def _heat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("intensity", F.least(num("value") / FULL_HEAT, F.lit(1.0)))


def heat_grid(locations: DataFrame, keys: tuple[str, ...] = (), cell_km: float = CLUSTER_KM) -> DataFrame:
    """GEO4, scalable form: one point per grid cell of ``cell_km``, at the mean position."""
    lat_step = cell_km / 111.0
    cell_lat = F.floor(F.col("lat") / lat_step)
    lng_step = F.lit(lat_step) / F.cos(F.radians(cell_lat * lat_step))
    cells = locations.withColumn("cell_lat", cell_lat).withColumn("cell_lng", F.floor(F.col("lng") / lng_step))
    points = cells.groupBy(*keys, "cell_lat", "cell_lng").agg(
        F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), total().alias("value"), F.count(F.lit(1)).alias("count")
    )
    return _heat(points)


def _leaders(radius_km: float, top_lat: float):
    """Streams points sorted by block and first visit; each goes to the first leader in reach, else becomes one.

    Only the leaders of the block at hand are held, in a grid, so memory does not
    grow with the points of a block.
    """
    lat_step = radius_km / 111.0
    lng_step = radius_km / (111.0 * cos(radians(top_lat)))

    def reach(lat1: float, lng1: float, lat2: float, lng2: float) -> bool:
        a, b = radians(lat1), radians(lat2)
        h = sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(radians(lng2 - lng1) / 2) ** 2
        return 2 * EARTH_KM * asin(sqrt(min(1.0, h))) <= radius_km

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, leaders, grid = None, [], {}
        for batch in batches:
            lats, lngs = [], []
            for *block, lat, lng in zip(batch["_k"], batch["block_y"], batch["block_x"], batch["lat"], batch["lng"]):
                if block != current:
                    current, leaders, grid = block, [], {}
                y, x = floor(lat / lat_step), floor(lng / lng_step)
                near = [j for dy in (-1, 0, 1) for dx in (-1, 0, 1) for j in grid.get((y + dy, x + dx), ())]
                hit = next((j for j in sorted(near) if reach(*leaders[j], lat, lng)), None)
                if hit is None:
                    hit = len(leaders)
                    leaders.append((lat, lng))
                    grid.setdefault((y, x), []).append(hit)
                lats.append(leaders[hit][0])
                lngs.append(leaders[hit][1])
            yield batch[["_k", "value", "count"]].assign(center_lat=lats, center_lng=lngs)

    return assign


def heat_clusters(
    locations: DataFrame, key: str = "user_id", radius_km: float = CLUSTER_KM, top_lat: float = 60.0
) -> DataFrame:
    """GEO4, exact form: a receipt joins the first earlier cluster centre in reach, else opens one.

    Receipts at one coordinate always share a cluster, so the sequential part
    sees only the distinct coordinates of a key, already summed.  A centre
    reaches no further than the neighbouring cells of a grid as wide as the
    radius, so blocks of connected occupied cells are independent, and the rule
    runs block by block: a key with most rows is as many tasks as it has blocks.
    """
    lat_step, lng_step = radius_km / 111.0, radius_km / (111.0 * cos(radians(top_lat)))
    points = locations.groupBy(key, "lat", "lng").agg(
        num(F.sum("total_amount")).alias("value"),
        F.count(F.lit(1)).alias("count"),
        F.min(F.struct("date", "receipt_id")).alias("_first"),
    )
    # the key as text, which a null key has too
    points = points.filter("lat IS NOT NULL AND lng IS NOT NULL").withColumn("_k", F.to_json(F.struct(key)))
    points = points.withColumn("cy", F.floor(F.col("lat") / lat_step)).withColumn("cx", F.floor(F.col("lng") / lng_step))
    placed = points.join(connected_blocks(points, "_k"), ["_k", "cy", "cx"])
    block = ["_k", "block_y", "block_x"]
    ordered = placed.repartition(*block).sortWithinPartitions(*block, "_first", "lat", "lng").select(*block, "lat", "lng", "value", "count")
    assigned = ordered.mapInPandas(_leaders(radius_km, top_lat), "_k string, value double, count long, center_lat double, center_lng double")
    clusters = assigned.groupBy("_k", "center_lat", "center_lng").agg(
        F.sum("value").alias("value"), F.sum("count").alias("count")
    )
    named = clusters.withColumn(key, F.from_json("_k", points.select(key).schema)[key])
    return _heat(named.select(key, "center_lat", "center_lng", "value", "count"))


def bounds(points: DataFrame, keys: tuple[str, ...] = (), padding: bool = False) -> DataFrame:
    """GEO5: bounding box and centroid; the padded box grows by a tenth, or .01 where it is flat."""
    box = points.groupBy(*keys).agg(
        F.max("lat").alias("north"),
        F.min("lat").alias("south"),
        F.max("lng").alias("east"),
        F.min("lng").alias("west"),
        F.avg("lat").alias("center_lat"),
        F.avg("lng").alias("center_lng"),
    )
    if not padding:
        return box

    def pad(high: str, low: str) -> Column:
        size = (F.col(high) - F.col(low)) * 0.1
        return F.when(size == 0, 0.01).otherwise(size)

    tall, wide = pad("north", "south"), pad("east", "west")
    return box.select(
        *keys,
        (F.col("north") + tall).alias("north"),
        (F.col("south") - tall).alias("south"),
        (F.col("east") + wide).alias("east"),
        (F.col("west") - wide).alias("west"),
        "center_lat",
        "center_lng",
    )


def homes(locations: DataFrame, key: str = "user_id") -> DataFrame:
    """GEO6: the place at three decimals with most weight; evenings and weekends weigh three."""
    hour = F.hour("date")
    weight = F.when((hour >= 19) | (hour <= 7) | (F.weekday("date") >= 5), 3).otherwise(1)
    spot = F.format_string("%.3f,%.3f", "lat", "lng")
    votes = locations.groupBy(key, spot.alias("_spot")).agg(F.sum(weight).alias("_w"))
    best = votes.groupBy(key).agg(F.max(F.struct("_w", "_spot")).alias("_b"))
    part = F.split("_b._spot", ",")
    return best.select(
        key,
        F.get(part, F.lit(0)).cast("double").alias("home_lat"),
        F.get(part, F.lit(1)).cast("double").alias("home_lng"),
        F.col("_b._w").alias("weight"),
    )


def trip_days(locations: DataFrame, home: DataFrame, key: str = "user_id") -> DataFrame:
    """GEO7: away days with the number of the trip they belong to.

    A day is away when any receipt lies more than 20 km from home.  A home day
    at most one day after an away day closes the trip; any later home day does
    not, and the next away day extends it.  The window runs over days, not
    receipts.
    """
    far = haversine(F.col("lat"), F.col("lng"), F.col("home_lat"), F.col("home_lng")) > AWAY_KM
    days = (
        locations.join(home, key)
        .groupBy(key, F.to_date("date").alias("day"))
        .agg(F.max(far).alias("away"))
    )
    order = Window.partitionBy(key).orderBy("day")
    closes = (~F.col("away")) & F.lag("away").over(order) & (F.datediff("day", F.lag("day").over(order)) <= 1)
    numbered = days.withColumn("_c", F.when(F.coalesce(closes, F.lit(False)), 1).otherwise(0)).withColumn(
        "trip", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.filter("away").select(key, "day", "trip")


def trips(locations: DataFrame, home: DataFrame | None = None, key: str = "user_id", at_least: int = 2) -> DataFrame:
    """GEO8: trips with their span, spend, categories, destinations and confidence."""
    home = homes(locations, key) if home is None else home
    cells = locations.groupBy(key, F.to_date("date").alias("day"), "lat", "lng", "category").agg(
        total().alias("_t"), F.count(F.lit(1)).alias("_n")
    )
    rows = cells.join(trip_days(locations, home, key), [key, "day"])
    places = rows.groupBy(key, "trip", "lat", "lng").agg(
        F.sum("_t").alias("_t"),
        F.sum("_n").alias("_n"),
        F.min("day").alias("_a"),
        F.max("day").alias("_b"),
        F.collect_set("category").alias("_c"),
    )
    distance = haversine(F.col("lat"), F.col("lng"), F.col("home_lat"), F.col("home_lng"))
    sums = (
        places.join(home, key)
        .groupBy(key, "trip")
        .agg(
            F.min("_a").alias("start_date"),
            F.max("_b").alias("end_date"),
            F.sum("_t").alias("total_expenses"),
            F.sum("_n").alias("expense_count"),
            F.count(F.lit(1)).alias("destinations"),
            F.avg(distance).alias("avg_distance_km"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_c")))).alias("categories"),
        )
        .filter(F.col("expense_count") >= at_least)
    )
    days = F.datediff("end_date", "start_date")
    count, far = F.col("expense_count"), F.col("avg_distance_km")
    confidence = (
        F.when(days.between(1, 7), 0.3).when(days > 7, 0.2).otherwise(0.0)
        + F.when(count >= 5, 0.3).when(count >= 3, 0.2).otherwise(0.0)
        + F.when(far > 50, 0.4).when(far > 20, 0.2).otherwise(0.0)
    )
    return sums.withColumn("share_per_destination", ratio(F.col("total_expenses"), F.col("destinations"))).withColumn(
        "confidence", F.least(F.lit(1.0), confidence)
    )


def overview(locations: DataFrame, key: str = "user_id") -> DataFrame:
    """GEO9: places, spend, category of most spend and trips per hundred receipts."""
    cells = keyed(locations).groupBy(key, "place", "category").agg(total().alias("_t"), F.count(F.lit(1)).alias("_n"))
    by_category = cells.groupBy(key, "category").agg(
        F.sum("_t").alias("_t"), F.sum("_n").alias("_n")
    )
    named = F.when(F.col("category").isNotNull(), F.struct("_t", "category"))
    sums = by_category.groupBy(key).agg(
        F.sum("_t").alias("total_spent"), F.sum("_n").alias("receipts"), F.max(named)["category"].alias("_top")
    )
    places = cells.groupBy(key).agg(F.count_distinct("place").alias("total_locations"))
    found = trips(locations, key=key).groupBy(key).agg(F.count(F.lit(1)).alias("trips"))
    rows = sums.join(places, key).join(found, key, "left")
    trips_found = F.coalesce("trips", F.lit(0))
    return rows.select(
        key,
        "total_locations",
        "total_spent",
        F.coalesce("_top", F.lit("Desconocido")).alias("most_frequent_category"),
        trips_found.alias("trips"),
        (ratio(trips_found, F.col("receipts")) * 100).alias("business_trip_percentage"),
    )


def top_places(locations: DataFrame, n: int = 10, key: str = "user_id") -> DataFrame:
    """GEO9: the places of most spend."""
    return newest(place_stats(locations, (key,)), [key], [F.col("total_expenses").desc(), F.col("place").asc()], n)


def in_country(lat: Column, lng: Column) -> Column:
    """GEO10: inside the bounding box of the country."""
    return lat.between(*COUNTRY_BOX["lat"]) & lng.between(*COUNTRY_BOX["lng"])


def region(lat: Column) -> Column:
    """GEO10: region by latitude band."""
    result = None
    for border, name in REGION_BANDS:
        result = F.when(lat > border, name) if result is None else result.when(lat > border, name)
    return result.otherwise(SOUTHMOST)


def distance_warning(km: Column) -> Column:
    """GEO11: why a trip distance looks wrong, or null."""
    return (
        F.when(km <= 0, "La distancia debe ser mayor a 0")
        .when(km < 0.5, "La distancia es muy corta para justificar gasto de combustible")
        .when(km > 1000, "La distancia parece excesiva para un viaje de trabajo")
        .when(km > 500, "Distancia larga - considere si es necesario para el trabajo")
    )


def distance_checks(legs: DataFrame) -> DataFrame:
    """GEO11: distance, sanity, minimal separation and travel minutes of every leg."""
    km = haversine(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    rows = legs.withColumn("km", km)
    d = F.col("km")
    speed = F.when(d > 100, SPEEDS["road"]).when(d < 10, SPEEDS["city"]).otherwise(SPEEDS["mixed"])
    return rows.select(
        "*",
        distance_warning(d).alias("warning"),
        (d.between(0.5, 1000)).alias("is_reasonable"),
        (d >= 0.1).alias("is_different"),
        (d / speed * 60).alias("minutes"),
    )
