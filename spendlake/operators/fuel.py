"""Fuel arithmetic over expense tables (FUE1 to FUE7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlake.functions.core import fixed_table, lookup, notes, num, ratio

# Kilometres per litre, pesos per litre, kg CO2 per litre.
KM_PER_LITRE = {"economico": 15, "intermedio": 10, "suv": 8}
PRICES = {"gasolina_93": 1267, "gasolina_95": 1305, "gasolina_97": 1335, "diesel": 1074}
CO2_PER_LITRE = {"gasolina_93": 2.31, "gasolina_95": 2.31, "gasolina_97": 2.31, "diesel": 2.68}
PRICE_RANGE = (700, 1500)
PRICE_TOLERANCE = 0.15


def litres(distance_km: Column, vehicle: Column) -> Column:
    """FUE1: litres for a distance; 0 for no distance or an unknown vehicle."""
    consumption = lookup(vehicle, KM_PER_LITRE)
    usable = (distance_km > 0) & consumption.isNotNull()
    return F.when(usable, distance_km / consumption).otherwise(F.lit(0.0))


def cost(fuel: Column, price: Column) -> Column:
    return F.when((fuel > 0) & (price > 0), num(fuel * price)).otherwise(F.lit(0.0))


def costs(expenses: DataFrame) -> DataFrame:
    """FUE1: litres, price, cost and cost per kilometre of every expense."""
    rows = expenses.withColumn("fuel_needed", litres(F.col("distance_km"), F.col("vehicle_type")))
    if "price_per_liter" not in expenses.columns:
        rows = rows.withColumn("price_per_liter", lookup(F.col("fuel_type"), PRICES))
    rows = rows.withColumn("total_cost", cost(F.col("fuel_needed"), F.col("price_per_liter")))
    per_km = F.when(F.col("distance_km") > 0, F.col("total_cost") / F.col("distance_km")).otherwise(0.0)
    return rows.withColumn("cost_per_km", per_km)


def validated(expenses: DataFrame) -> DataFrame:
    """FUE2: the errors of declared distance, litres, cost and price."""
    distance, fuel = F.col("distance_km"), F.col("fuel_needed")
    price, declared = F.col("price_per_liter"), F.col("total_cost")
    errors = notes(
        (distance <= 0, "La distancia debe ser mayor a 0"),
        (distance > 2000, "La distancia parece excesiva (>2000km)"),
        (
            F.abs(fuel - litres(distance, F.col("vehicle_type"))) > 0.1,
            "El combustible calculado no coincide con la distancia y vehículo",
        ),
        (F.abs(declared - cost(fuel, price)) > 1, "El costo total no coincide con el combustible y precio"),
        (~price.between(*PRICE_RANGE), "El precio por litro está fuera del rango esperado"),
    )
    return expenses.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def savings(expenses: DataFrame, base_price: Column) -> DataFrame:
    """FUE3: saving or excess against a base price for the same litres."""
    base = base_price * F.col("fuel_needed")
    saved = base - F.col("total_cost")
    share = F.when(base > 0, saved / base * 100).otherwise(0.0)
    return expenses.select(
        "*",
        F.abs(saved).alias("difference"),
        F.abs(share).alias("percentage_diff"),
        (saved > 0).alias("is_savings"),
    )


def emissions(expenses: DataFrame) -> DataFrame:
    """FUE4: kilograms of CO2 by fuel type."""
    return expenses.withColumn("co2_kg", F.col("fuel_needed") * lookup(F.col("fuel_type"), CO2_PER_LITRE))


def cheapest_fuel(prices: DataFrame) -> DataFrame:
    """FUE5: the cheapest fuel of every region and how far the dearest lies above it."""
    order = F.struct("price", "fuel_type")
    return prices.groupBy("region").agg(
        F.min(order)["fuel_type"].alias("fuel_type"),
        F.min("price").alias("price"),
        (F.max("price") - F.min("price")).alias("savings"),
    )


def cheapest_region(prices: DataFrame) -> DataFrame:
    """FUE5: the cheapest region of every fuel."""
    return prices.groupBy("fuel_type").agg(
        F.min(F.struct("price", "region"))["region"].alias("region"), F.min("price").alias("price")
    )


def price_ranking(prices: DataFrame) -> DataFrame:
    """FUE6: fuels ranked by price in every region, with the plausibility of each price."""
    base = lookup(F.col("fuel_type"), PRICES)
    fair = F.col("price").between(base * (1 - PRICE_TOLERANCE), base * (1 + PRICE_TOLERANCE))
    rank = F.row_number().over(Window.partitionBy("region").orderBy("price", "fuel_type"))
    return prices.select("region", "fuel_type", "price", rank.alias("rank"), fair.alias("is_reasonable"))


def footprint(consumption: Column) -> Column:
    return F.when(consumption >= 12, "low").when(consumption >= 9, "medium").otherwise("high")


def vehicle_comparison(spark: SparkSession) -> DataFrame:
    """FUE7: efficiency of the fixed vehicle kinds, pair by pair."""
    kinds = list(KM_PER_LITRE.items())
    rows = [(a, ka, b, kb) for i, (a, ka) in enumerate(kinds) for b, kb in kinds[i + 1 :]]
    table = fixed_table(spark, "vehicle string, km int, other string, other_km int", rows)
    return _compared(table)


def _compared(rows: DataFrame) -> DataFrame:
    km, other = F.col("km"), F.col("other_km")
    gap = F.abs(km - other)
    return rows.select(
        "vehicle",
        "other",
        F.when(km > other, F.col("vehicle")).otherwise(F.col("other")).alias("more_efficient"),
        gap.alias("difference"),
        F.floor(ratio(gap, F.least(km, other)) * 100 + 0.5).alias("percentage_diff"),
        footprint(km).alias("footprint"),
        footprint(other).alias("other_footprint"),
    )


def user_efficiency(expenses: DataFrame) -> DataFrame:
    """FUE7: kilometres by vehicle for every user beside the vehicle's efficiency and footprint."""
    km = lookup(F.col("vehicle_type"), KM_PER_LITRE)
    sums = expenses.groupBy("user_id", "vehicle_type").agg(F.sum("distance_km").alias("distance_km"))
    best = max(KM_PER_LITRE.values())
    return sums.select(
        "user_id",
        "vehicle_type",
        "distance_km",
        footprint(km).alias("footprint"),
        (F.lit(best) - km).alias("difference"),
        F.floor(ratio(F.lit(best) - km, km) * 100 + 0.5).alias("percentage_diff"),
    )
