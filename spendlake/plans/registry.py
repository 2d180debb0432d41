"""Registry of named queries: a Spark plan and, where SQL can say it, the same in SQL.

A query is a function of :class:`~spendlake.sources.canonical.Tables`.  Its SQL
text is written independently over the common table expressions in
:mod:`spendlake.plans.bindings`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.plans.bindings import BINDINGS
from spendlake.sources.canonical import Tables

Plan = Callable[[Tables], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def with_bindings(sql: str, uses: str) -> str:
    """Prefix ``sql`` with the bindings it names, and those they build on."""
    needed: list[str] = []

    def add(name: str) -> None:
        parents, _ = BINDINGS[name]
        for parent in parents:
            add(parent)
        if name not in needed:
            needed.append(name)

    for name in uses.split():
        add(name)
    if not needed:
        return sql
    body = sql.strip()
    head = ",\n".join(f"{name} AS ({BINDINGS[name][1]})" for name in needed)
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, uses: str = "", sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = with_bindings(sql, uses)
        return plan

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Report form of a result: plain numbers, strings and booleans only.

    Money becomes double, doubles are rounded to six digits, times become ISO
    text and arrays of text are joined, so two engines print equal values.  The
    nudge before rounding keeps exact halves on one side: two engines that add
    in another order differ in the last bit and would split them.
    """
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double") + F.lit(1e-9), 6)
        elif isinstance(kind, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: comparable(plan(Tables(spark, folder)))

    return {name: bind(plan) for name, plan in QUERIES.items()}
