"""Products against declared totals (REC1 to REC3).

Receipts are summed first and joined once; the item-level variants bring the
two totals back to the items by the receipt key, under which products already
lie together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.core import notes, num, ratio


def product_totals(products: DataFrame) -> DataFrame:
    priced = F.when(F.col("total_price").isNotNull(), F.col("total_price"))
    return products.groupBy("receipt_id").agg(
        F.coalesce(F.sum(priced), F.lit(0)).alias("calculated_total"),
        F.count(F.lit(1)).alias("products_count"),
        F.avg("confidence").alias("average_confidence"),
    )


def validated_totals(receipts: DataFrame, products: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """REC1: difference between products and the declared total, issues and a recommendation."""
    rows = receipts.select("receipt_id", F.col("total_amount").alias("declared_total")).join(
        product_totals(products), "receipt_id", "left"
    )
    calculated = F.coalesce("calculated_total", F.lit(0))
    count = F.coalesce("products_count", F.lit(0))
    confidence = F.coalesce("average_confidence", F.lit(0.0))
    declared = num("declared_total")
    gap = F.abs(num(calculated) - declared)
    share = F.when(declared > 0, gap / declared * 100).otherwise(100.0)
    valid = share <= tolerance
    issues = notes(
        (count == 0, "No se encontraron productos extraídos"),
        ((count > 0) & (calculated == 0), "No se pudieron calcular precios de productos"),
        ((count > 0) & (calculated != 0) & (share > 10), "Diferencia significativa entre productos y total"),
    )
    return rows.select(
        "receipt_id",
        "declared_total",
        calculated.alias("calculated_total"),
        gap.alias("difference"),
        share.alias("difference_percentage"),
        count.alias("products_count"),
        confidence.alias("average_confidence"),
        valid.alias("is_valid"),
        issues.alias("issues"),
        F.when(valid & (confidence > 0.8), "auto_approve").otherwise("manual_review").alias("recommendation"),
    )


def _with_totals(receipts: DataFrame, products: DataFrame) -> DataFrame:
    totals = receipts.select("receipt_id", num("total_amount").alias("_declared")).join(
        product_totals(products).select("receipt_id", num("calculated_total").alias("_items")), "receipt_id"
    )
    return products.join(totals, "receipt_id")


def proportional(receipts: DataFrame, products: DataFrame, off_by: float = 0.1) -> DataFrame:
    """REC2: items scaled to the declared total when the sum is off by more than 10 %; whole pesos, half to even."""
    rows = _with_totals(receipts, products)
    declared, items = F.col("_declared"), F.col("_items")
    needed = F.abs(items - declared) > declared * off_by
    factor = F.when(needed & (items > 0), declared / items)

    def scaled(name: str) -> Column:
        price = num(name)
        return F.when(factor.isNotNull() & (price != 0), F.bround(price * factor)).otherwise(price).alias(name)

    return rows.select(
        "receipt_id",
        "line",
        scaled("total_price"),
        scaled("unit_price"),
        needed.alias("reconciliation_needed"),
        (declared - items).alias("difference"),
    )


def bounded(receipts: DataFrame, products: DataFrame, within: float = 0.1) -> DataFrame:
    """REC3: the difference spread over the items by price, only if it is below 10 % of the total."""
    rows = _with_totals(receipts, products)
    declared, items, price = F.col("_declared"), F.col("_items"), num("total_price")
    gap = declared - items
    success = F.abs(gap) < declared * within
    adjusted = price + ratio(price, items) * gap
    return rows.select(
        "receipt_id",
        "line",
        F.when(success & (items > 0), adjusted).otherwise(price).alias("total_price"),
        success.alias("success"),
        F.when(success, gap).alias("adjustment_applied"),
    )


def factor_bounded(receipts: DataFrame, products: DataFrame, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """REC3, first form: items scaled by a factor that must lie between .8 and 1.2."""
    rows = _with_totals(receipts, products)
    declared, items, price = F.col("_declared"), F.col("_items"), num("total_price")
    factor = F.when(items > 0, declared / items)
    success = F.coalesce(factor.between(low, high), F.lit(False))
    return rows.select(
        "receipt_id",
        "line",
        F.when(success, price * factor).otherwise(price).alias("total_price"),
        success.alias("success"),
        factor.alias("factor"),
    )
