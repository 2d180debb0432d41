"""Receipt scan over drifted shapes (SRC1, SRC2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical column: spellings in order of preference, type.
SHAPES = {
    "receipt_id": (["receipt_id", "_id", "id"], "bigint"),
    "user_id": (["user_id", "user", "userId"], "bigint"),
    "company_name": (["company_name", "companyName"], "string"),
    "folio_number": (["folio_number", "folioNumber"], "string"),
    "description": (["description"], "string"),
    "category": (["category"], "string"),
    "status": (["status"], "string"),
    "date": (["date"], "timestamp"),
    "created_at": (["created_at", "createdAt"], "timestamp"),
    "total_amount": (["total_amount", "totalAmount"], "decimal(18,2)"),
}


def canonical(rows: DataFrame) -> DataFrame:
    """SRC2: one schema out of the spellings that different writers used."""

    def pick(names: list[str], kind: str) -> Column:
        present = [F.col(f"`{n}`").try_cast(kind) for n in names if n in rows.columns]
        return F.coalesce(*present) if present else F.lit(None).cast(kind)

    return rows.select(*[pick(names, kind).alias(name) for name, (names, kind) in SHAPES.items()])


def scan(spark: SparkSession, path: str, owners: list[int] | None = None) -> DataFrame:
    """SRC1: stored receipts, optionally of some owners; the filter reaches the Parquet scan."""
    rows = canonical(spark.read.parquet(path))
    return rows if owners is None else rows.filter(F.col("user_id").isin(owners))
