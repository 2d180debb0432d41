"""Queries FUE1 to FUE7."""

from pyspark.sql import functions as F

from spendlake.operators import fuel as ops
from spendlake.plans.aggregates import FUEL_COST_SQL, stations
from spendlake.plans.bindings import r
from spendlake.plans.registry import query


def declared(t):
    """Expenses as declared: some distances, litres, costs and prices are off."""
    rows = ops.costs(t.fuel_expenses)
    k = F.col("expense_id")
    return rows.select(
        "expense_id",
        "user_id",
        "vehicle_type",
        "fuel_type",
        F.when(k % 13 == 0, F.lit(0.0)).when(k % 17 == 0, F.col("distance_km") * 10).otherwise(F.col("distance_km")).alias("distance_km"),
        F.when(k % 7 == 0, F.col("fuel_needed") + 0.5).otherwise(F.col("fuel_needed")).alias("fuel_needed"),
        F.when(k % 11 == 0, F.col("price_per_liter") * 2).otherwise(F.col("price_per_liter")).alias("price_per_liter"),
        "total_cost",
    )


DECLARED_SQL = f"""{FUEL_COST_SQL}, declared AS (SELECT expense_id, user_id, vehicle_type, fuel_type,
 CASE WHEN expense_id % 13 = 0 THEN 0 WHEN expense_id % 17 = 0 THEN distance_km * 10 ELSE distance_km END AS distance_km,
 CASE WHEN expense_id % 7 = 0 THEN fuel_needed + 0.5 ELSE fuel_needed END AS fuel_needed,
 CASE WHEN expense_id % 11 = 0 THEN price_per_liter * 2 ELSE price_per_liter END AS price_per_liter,
 fuel_needed * price_per_liter AS total_cost FROM costs)"""


@query("fue1_fuel_costs", "fuel_expenses", f"""WITH {FUEL_COST_SQL} SELECT expense_id, {r('fuel_needed')} AS fuel_needed, price_per_liter,
 {r('fuel_needed * price_per_liter')} AS total_cost, {r('fuel_needed * price_per_liter / distance_km')} AS cost_per_km FROM costs""")
def fuel_costs(t):
    return ops.costs(t.fuel_expenses).select("expense_id", "fuel_needed", "price_per_liter", "total_cost", "cost_per_km")


@query("fue2_fuel_validation", "fuel_expenses", f"""WITH {DECLARED_SQL}, checked AS (SELECT expense_id, list_filter([
 CASE WHEN distance_km <= 0 THEN 'La distancia debe ser mayor a 0' END,
 CASE WHEN distance_km > 2000 THEN 'La distancia parece excesiva (>2000km)' END,
 CASE WHEN abs(fuel_needed - distance_km / CASE vehicle_type WHEN 'economico' THEN 15 WHEN 'intermedio' THEN 10 ELSE 8 END) > 0.1
  THEN 'El combustible calculado no coincide con la distancia y vehículo' END,
 CASE WHEN abs(total_cost - fuel_needed * price_per_liter) > 1 THEN 'El costo total no coincide con el combustible y precio' END,
 CASE WHEN price_per_liter NOT BETWEEN 700 AND 1500 THEN 'El precio por litro está fuera del rango esperado' END],
 lambda x: x IS NOT NULL) AS e FROM declared)
 SELECT expense_id, array_to_string(e, '|') AS errors, len(e) = 0 AS is_valid FROM checked""")
def fuel_validation(t):
    return ops.validated(declared(t)).select("expense_id", "errors", "is_valid")


@query("fue3_fuel_savings", "fuel_expenses", f"""WITH {DECLARED_SQL}, s AS (SELECT *, 1200 * fuel_needed AS base,
 1200 * fuel_needed - total_cost AS saved FROM declared)
 SELECT expense_id, {r('abs(saved)')} AS difference, {r('abs(CASE WHEN base > 0 THEN saved / base * 100 ELSE 0 END)')} AS percentage_diff,
 saved > 0 AS is_savings FROM s""")
def fuel_savings(t):
    rows = ops.savings(declared(t), F.lit(1200))
    return rows.select("expense_id", "difference", "percentage_diff", "is_savings")


@query("fue4_emissions", "fuel_expenses", f"""WITH {FUEL_COST_SQL} SELECT user_id, fuel_type,
 {r("sum(fuel_needed * CASE fuel_type WHEN 'diesel' THEN 2.68::double ELSE 2.31::double END)")} AS co2_kg FROM costs GROUP BY ALL""")
def emissions(t):
    rows = ops.emissions(ops.costs(t.fuel_expenses))
    return rows.groupBy("user_id", "fuel_type").agg(F.sum("co2_kg").alias("co2_kg"))


FUELS = ["gasolina_93", "gasolina_95", "gasolina_97", "diesel"]


def prices(t):
    """Mean positive price per region and fuel."""
    long = stations(t).unpivot(["station_id", "region"], FUELS, "fuel_type", "price").filter(F.col("price") > 0)
    return long.groupBy("region", "fuel_type").agg(F.floor(F.avg("price") + 0.5).alias("price"))


PRICES_SQL = """st AS (SELECT s_suppkey AS id, 'Region ' || (s_nationkey % 7) AS region, round(900 + abs(s_acctbal) / 20) AS p FROM supplier),
 long AS (SELECT region, 'gasolina_93' AS fuel_type, CASE WHEN id % 5 = 0 THEN 0 ELSE p END AS price FROM st
 UNION ALL SELECT region, 'gasolina_95', p + 25 FROM st UNION ALL SELECT region, 'gasolina_97', CASE WHEN id % 7 <> 0 THEN p + 50 END FROM st
 UNION ALL SELECT region, 'diesel', p - 230 FROM st),
 prices AS (SELECT region, fuel_type, cast(floor(avg(price) + 0.5) AS bigint) AS price FROM long WHERE price > 0 GROUP BY ALL)"""


@query("fue5_cheapest_fuel", "", f"""WITH {PRICES_SQL} SELECT p.region, fuel_type, price, savings FROM prices p JOIN
 (SELECT region, max(price) - min(price) AS savings FROM prices GROUP BY 1) g ON p.region = g.region
 QUALIFY row_number() OVER (PARTITION BY p.region ORDER BY price, fuel_type) = 1""")
def cheapest_fuel(t):
    return ops.cheapest_fuel(prices(t))


@query("fue5_cheapest_region", "", f"""WITH {PRICES_SQL} SELECT fuel_type, region, price FROM prices
 QUALIFY row_number() OVER (PARTITION BY fuel_type ORDER BY price, region) = 1""")
def cheapest_region(t):
    return ops.cheapest_region(prices(t))


@query("fue6_price_ranking", "", f"""WITH {PRICES_SQL}, b AS (SELECT *, CASE fuel_type WHEN 'gasolina_93' THEN 1267 WHEN 'gasolina_95' THEN 1305
 WHEN 'gasolina_97' THEN 1335 ELSE 1074 END AS base FROM prices)
 SELECT region, fuel_type, price, row_number() OVER (PARTITION BY region ORDER BY price, fuel_type) AS rank,
 price BETWEEN base * 0.85 AND base * 1.15 AS is_reasonable FROM b""")
def price_ranking(t):
    return ops.price_ranking(prices(t))


@query("fue7_user_efficiency", "fuel_expenses", f"""WITH s AS (SELECT user_id, vehicle_type, sum(distance_km) AS km,
 CASE vehicle_type WHEN 'economico' THEN 15 WHEN 'intermedio' THEN 10 ELSE 8 END AS k FROM fuel_expenses GROUP BY ALL)
 SELECT user_id, vehicle_type, {r('km')} AS distance_km, CASE WHEN k >= 12 THEN 'low' WHEN k >= 9 THEN 'medium' ELSE 'high' END AS footprint,
 15 - k AS difference, cast(floor((15 - k)::double / k * 100 + 0.5) AS bigint) AS percentage_diff FROM s""")
def user_efficiency(t):
    return ops.user_efficiency(t.fuel_expenses)
