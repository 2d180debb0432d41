"""Joins between receipts, categories, people, limits and places (JOI1 to JOI12).

Big-to-big joins carry no hint: Spark picks broadcast only where its own size
statistics allow it and otherwise shuffles on the key, splitting skewed
partitions under AQE.
"""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.core import newest, num
from spendlake.functions.geo import haversine

NO_CATEGORY = "Sin categoría"
OTHER = "Otros"


def with_categories(receipts: DataFrame, categories: DataFrame, label: str | None = NO_CATEGORY) -> DataFrame:
    """JOI1: receipts with every category row; unmatched receipts keep a default label."""
    right = categories.select("receipt_id", F.col("category").alias("_category"))
    rows = receipts.drop("category").join(right, "receipt_id", "left")
    column = F.col("_category") if label is None else F.coalesce("_category", F.lit(label))
    return rows.withColumn("category", column).drop("_category")


def category_history(receipts: DataFrame, categories: DataFrame, category: str) -> DataFrame:
    """JOI2: dated amounts of one category."""
    chosen = categories.filter(F.col("category") == category).select("receipt_id", "category")
    return receipts.drop("category").join(chosen, "receipt_id").select("user_id", "receipt_id", "category", "date", "total_amount")


def user_history(
    receipts: DataFrame, categories: DataFrame, newest_rows: int | None = None, key: str = "user_id"
) -> DataFrame:
    """JOI3: every receipt with its first category, default ``Otros``; ``newest_rows`` keeps one page per user."""
    page = receipts.drop("category")
    if newest_rows is not None:
        page = newest(page, [key], [F.col("date").desc(), F.col("receipt_id").desc()], newest_rows)
    first = categories.groupBy("receipt_id").agg(F.min_by("category", F.struct("created_at", "category")).alias("category"))
    rows = page.join(first, "receipt_id", "left")
    return rows.withColumn("category", F.coalesce("category", F.lit(OTHER)))


def staff(users: DataFrame, employer_id: int | None = None) -> DataFrame:
    rows = users.filter(F.col("role") == "employee")
    return rows if employer_id is None else rows.filter(F.col("employer_id") == employer_id)


def staff_receipts(receipts: DataFrame, users: DataFrame, employer_id: int) -> DataFrame:
    """JOI4: receipts of one employer's employees."""
    return receipts.join(staff(users, employer_id).select("user_id"), "user_id", "left_semi")


def roster(users: DataFrame, employers: DataFrame) -> DataFrame:
    """JOI5: every employee with the employing company."""
    return staff(users).join(employers, "employer_id").select(
        "employer_id", "company_name", "user_id", "name", "email", "department"
    )


def employee_receipts(receipts: DataFrame, users: DataFrame) -> DataFrame:
    """JOI6: receipts with the attributes of the employee who filed them."""
    people = staff(users).select("user_id", "employer_id", "name", "department", "email")
    return receipts.join(people, "user_id")


def limits_with_names(limits: DataFrame, users: DataFrame) -> DataFrame:
    """JOI7: limits with the employee's display name and e-mail."""
    people = users.select(F.col("user_id").alias("employee_id"), "name", "email")
    return limits.join(people, "employee_id")


def near_pairs(
    receipts: DataFrame, newest_rows: int | None = None, hours: int = 24, key: str = "user_id", within_double: bool = False
) -> DataFrame:
    """JOI8: pairs of one user's receipts at most ``hours`` apart, the newer one first.

    The interval join becomes an equi join on ``(user, time bucket)``: buckets
    are as wide as the interval, so a partner sits in the same bucket or a
    neighbouring one.  The older side is sent to its own and the next bucket,
    never to all.  All receipts are compared; ``newest_rows`` keeps one page per
    user instead.  ``within_double`` asks only for pairs of positive amounts less
    than a factor of two apart and adds the amount's size class to the join key,
    so that a busy day is not compared all against all.
    """
    fields = [key, "receipt_id", "date", "total_amount", "company_name", "description"]
    rows = receipts.select(*dict.fromkeys(fields))
    if newest_rows is not None:
        rows = newest(rows, [key], [F.col("date").desc(), F.col("receipt_id").desc()], newest_rows)
    bucket = F.floor(F.unix_timestamp("date") / (hours * 3600))
    size_class, classes = F.lit(0), F.array(F.lit(0))
    if within_double:
        rows = rows.filter(F.col("total_amount") > 0)
        # A little wider than a factor of two, so that rounding never parts neighbours.
        size_class = F.floor(F.log2(num("total_amount")) / 1.01).cast("int")
        classes = F.array(size_class - 1, size_class, size_class + 1)
    record = F.struct(*rows.columns)
    left = rows.select(F.col(key).alias("_k"), bucket.alias("_b"), size_class.alias("_s"), record.alias("a"))
    right = rows.select(F.col(key).alias("_k"), F.array(bucket, bucket + 1).alias("_bs"), classes.alias("_ss"), record.alias("b"))
    right = right.select("_k", F.explode("_bs").alias("_b"), "_ss", "b").select("_k", "_b", F.explode("_ss").alias("_s"), "b")
    older = (F.col("b.date") < F.col("a.date")) | (
        (F.col("b.date") == F.col("a.date")) & (F.col("b.receipt_id") < F.col("a.receipt_id"))
    )
    gap = F.unix_timestamp("a.date") - F.unix_timestamp("b.date")
    near = older
    if within_double:
        one, two = num("a.total_amount"), num("b.total_amount")
        near = older & (F.least(one, two) * 2 > F.greatest(one, two))
    return left.join(right, ["_k", "_b", "_s"]).filter(near & (gap <= hours * 3600)).select("a", "b", gap.alias("gap_seconds"))


def _cells(radius_km: float, top_lat: float, lat: str, lng: str) -> tuple[Column, Column]:
    """Grid cell of a point; a cell is at least ``radius_km`` wide up to latitude ``top_lat``."""
    lat_step = radius_km / 111.0
    lng_step = radius_km / (111.0 * cos(radians(top_lat)))
    return F.floor(F.col(lat) / lat_step), F.floor(F.col(lng) / lng_step)


def _around(rows: DataFrame, cell: tuple[Column, Column]) -> DataFrame:
    """Each row nine times: in its own grid cell and the eight around it."""
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = rows.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
    return spread.withColumn("_cy", cell[0] + F.col("_dy")).withColumn("_cx", cell[1] + F.col("_dx")).drop("_dy", "_dx")


def nearest_branch(points: DataFrame, branches: DataFrame, accept_km: float = 5.0, top_lat: float = 60.0) -> DataFrame:
    """JOI9: the nearest branch of the brand within ``accept_km``, else the brand's first branch.

    Only branches inside the accepted distance can win, so the join is on brand
    and grid cell with the branch table spread over neighbouring cells; a brand
    with a third of all points is split by place.
    """
    point_cell = _cells(accept_km, top_lat, "lat", "lng")
    spread = _around(branches, _cells(accept_km, top_lat, "branch_lat", "branch_lng"))
    distance = haversine(F.col("lat"), F.col("lng"), F.col("branch_lat"), F.col("branch_lng"))
    near = (
        points.select("receipt_id", "brand", "lat", "lng", point_cell[0].alias("_cy"), point_cell[1].alias("_cx"))
        .join(spread, ["brand", "_cy", "_cx"])
        .withColumn("_km", distance)
        .filter(F.col("_km") < accept_km)
        .groupBy("receipt_id")
        .agg(F.min(F.struct("_km", "branch_id", "branch_lat", "branch_lng")).alias("_near"))
    )
    first = branches.groupBy("brand").agg(F.min(F.struct("branch_id", "branch_lat", "branch_lng")).alias("_first"))
    rows = points.select("receipt_id", "brand").join(first, "brand").join(near, "receipt_id", "left")
    found = F.col("_near").isNotNull()

    def pick(name: str) -> Column:
        return F.coalesce(F.col(f"_near.{name}"), F.col(f"_first.{name}")).alias(name)

    return rows.select(
        "receipt_id",
        "brand",
        F.col("_near._km").alias("km"),
        found.alias("is_near"),
        pick("branch_id"),
        pick("branch_lat"),
        pick("branch_lng"),
    )


def best_location(mentions: DataFrame, branches: DataFrame, geocodes: DataFrame) -> DataFrame:
    """JOI10: brand and address, else brand alone, else the geocoded address.

    ``mentions`` holds receipt, brand and address text; ``geocodes`` maps an
    address to a point and takes the place of a geocoding service.
    """
    places = geocodes.select("address", F.col("lat"), F.col("lng"))
    located = mentions.join(places, "address", "left")
    branded = nearest_branch(located.filter(F.col("brand").isNotNull()), branches).select(
        "receipt_id", "branch_id", "branch_lat", "branch_lng"
    )
    has_branch = F.col("branch_id").isNotNull()
    has_point = F.col("lat").isNotNull()
    source = (
        F.when(has_branch & has_point, "brand_address")
        .when(has_branch, "brand")
        .when(has_point, "address")
        .otherwise("none")
    )
    return located.join(branded, "receipt_id", "left").select(
        "receipt_id",
        "brand",
        "address",
        source.alias("source"),
        F.coalesce("branch_lat", "lat").alias("best_lat"),
        F.coalesce("branch_lng", "lng").alias("best_lng"),
    )


def limit_applies(restrictions: Column, category: Column) -> Column:
    """JOI11: no restrictions, no category, or the category is listed."""
    return (F.size(restrictions) == 0) | category.isNull() | F.array_contains(restrictions, category)


def applicable_limits(transactions: DataFrame, limits: DataFrame) -> DataFrame:
    """JOI11: every active limit that governs a transaction."""
    active = limits.filter("is_active").select(
        F.col("employee_id").alias("user_id"), "limit_id", "limit_type", "limit_amount", "category_restrictions"
    )
    return transactions.join(active, "user_id").filter(limit_applies(F.col("category_restrictions"), F.col("category")))


#: Grids of the nearest-places join, each half as wide as the one before.
LEVELS = 9


def nearby(
    origins: DataFrame, places: DataFrame, radius_km: float = 1.0, category: str | None = None, top_lat: float = 60.0, nearest: int | None = None, origin: str = "user_id"
) -> DataFrame:
    """JOI12: places within ``radius_km`` of each origin, with ``nearest`` only so many of them, equally far ones by id.

    Both sides get a grid cell at least one radius wide; an origin looks into
    its own cell and the eight around it, then the exact distance decides.
    ``top_lat`` is the greatest absolute latitude in the data and sizes the
    longitude cells; at ``top_lat`` of 60 cells are up to twice as wide as high.

    With ``nearest``, cells split where places are dense: an origin whose own
    cell of a grid four times finer holds enough places has them all within one
    finer cell width, and looks no further than that.  ``origin`` names an
    origin; rows that share it are one.
    """
    targets = places if category is None else places.filter(F.col("category") == category)
    targets = targets.select("place_id", F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng"))
    distance = haversine(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng"))
    if nearest is None:
        cell = _cells(radius_km, top_lat, "place_lat", "place_lng")
        targets = targets.withColumn("_cy", cell[0]).withColumn("_cx", cell[1])
        seekers = _around(origins, _cells(radius_km, top_lat, "lat", "lng"))
        return seekers.join(targets, ["_cy", "_cx"]).withColumn("km", distance).filter(F.col("km") <= radius_km).drop("_cy", "_cx")
    # of places at one point only the first can be among the nearest
    same = Window.partitionBy("place_lat", "place_lng").orderBy("place_id")
    targets = targets.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= nearest).drop("_r")

    def celled(rows: DataFrame, lat: str, lng: str, levels: list[int]) -> DataFrame:
        cells = [F.struct(F.lit(i).alias("_level"), *(c.alias(n) for c, n in zip(_cells(radius_km / 2**i, top_lat, lat, lng), ("_cy", "_cx")))) for i in levels]
        return rows.withColumn("_cell", F.explode(F.array(*cells))).select(*rows.columns, "_cell.*")

    grids = celled(targets, "place_lat", "place_lng", list(range(LEVELS)))
    dense = grids.filter("_level >= 2").groupBy("_level", "_cy", "_cx").agg(F.count("*").alias("_n")).filter(F.col("_n") >= nearest)
    rows = origins.dropDuplicates([origin])
    # the finest grid that is enough
    own = celled(rows.select(origin, "lat", "lng"), "lat", "lng", list(range(2, LEVELS))).join(dense, ["_level", "_cy", "_cx"])
    chosen = own.groupBy(origin).agg((F.max("_level") - 2).alias("_level"))
    rows = rows.join(chosen, rows[origin].eqNullSafe(chosen[origin]), "left").select(rows["*"], F.coalesce("_level", F.lit(0)).alias("_level"))
    sizes = [_cells(radius_km / 2**i, top_lat, "lat", "lng") for i in range(LEVELS - 2)]
    at = [F.element_at(F.array(*(size[axis] for size in sizes)), (F.col("_level") + 1).cast("int")) for axis in (0, 1)]
    met = _around(rows, (at[0], at[1])).join(grids, ["_level", "_cy", "_cx"]).withColumn("km", distance).filter(F.col("km") <= radius_km)
    line = Window.partitionBy(origin).orderBy("km", "place_id")
    return met.withColumn("_r", F.row_number().over(line)).filter(F.col("_r") <= nearest).drop("_r", "_level", "_cy", "_cx")
