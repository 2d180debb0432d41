"""Column helpers shared by all operators.

Everything returns JVM-side expressions, so the calling plan stays inside
whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AsOf = str | date | datetime


def moment(as_of: AsOf) -> datetime:
    """``as_of`` as a naive datetime."""
    if isinstance(as_of, datetime):
        return as_of
    if isinstance(as_of, date):
        return datetime(as_of.year, as_of.month, as_of.day)
    return datetime.fromisoformat(as_of)


def ts(as_of: AsOf, days: int = 0) -> Column:
    """Timestamp literal ``as_of`` shifted by whole days; folded by Catalyst."""
    value = moment(as_of) + timedelta(days=days)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def num(column: Column | str) -> Column:
    """Double view of a numeric column."""
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def ratio(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """``numerator / denominator`` as double, ``default`` where that is undefined."""
    bottom = num(denominator)
    return F.when(bottom.isNotNull() & (bottom != 0), num(numerator) / bottom).otherwise(F.lit(default))


def growth(current: Column, previous: Column) -> Column:
    """Percentage change; 0 where there is no positive previous value."""
    base = num(previous)
    return F.when(base > 0, (num(current) - base) / base * 100).otherwise(F.lit(0.0))


def clamp(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), column))


def total(column: str = "total_amount") -> Column:
    """Sum that is 0 on no rows."""
    return F.coalesce(F.sum(column), F.lit(0))


def mean(column: str = "total_amount") -> Column:
    """Mean taken from the exact sum, so the order of rows cannot change it."""
    return num(F.sum(column)) / F.count(column)


def lookup(column: Column, table: dict, default=None) -> Column:
    """A small fixed table as a ``CASE``; no join, no shuffle."""
    result = None
    for key, value in table.items():
        hit = column == F.lit(key)
        result = F.when(hit, F.lit(value)) if result is None else result.when(hit, F.lit(value))
    return result if default is None else result.otherwise(F.lit(default))


def notes(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the messages whose condition holds, in the order given."""
    items = [
        F.when(condition, message if isinstance(message, Column) else F.lit(message))
        for condition, message in pairs
    ]
    return F.array_compact(F.array(*items))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once.

    A costly value that an array function repeats for every element (a whole
    text in lower case, say) would otherwise be computed each time, since the
    optimizer inlines projections.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order``; ``rank`` keeps the position under that name.

    The rank filter sits directly on the window, so Spark prunes each key to
    ``n`` rows before the shuffle; a hot key therefore never travels whole.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn("_rank", position).filter(F.col("_rank") <= n)
    return kept.withColumnRenamed("_rank", rank) if rank else kept.drop("_rank")


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value) + ("D" if isinstance(value, float) else "")
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def fixed_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A constant table written in code, as a local relation of known size.

    Its size is fixed by the source text, which is what makes the broadcast
    hint safe here and nowhere else.
    """
    fields = [f.strip().split(" ", 1) for f in columns.split(",")]
    names = ", ".join(f[0] for f in fields)
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    frame = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return F.broadcast(frame.select(*[F.col(n).cast(t).alias(n) for n, t in fields]))


def _cut_buckets(base: DataFrame, keys: list[str], time: str, limit: int) -> DataFrame:
    """``base`` with ``_bucket`` moved to the last second at which its bucket was cut."""
    second = F.date_trunc("second", F.col(time))
    cells = base.groupBy(*keys, "_bucket", second.alias("_second")).agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy(*keys, "_bucket").orderBy("_second").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = cells.withColumn("_upto", F.sum("_n").over(line))
    cut = F.floor((F.col("_upto") - F.col("_n")) / limit) > F.floor((F.col("_upto") - F.col("_n") - F.lag("_n").over(Window.partitionBy(*keys, "_bucket").orderBy("_second"))) / limit)
    # as many cuts as the rows fill buckets
    cuts = upto.withColumn("_cut", cut).filter("_cut").groupBy(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_bucket").alias("_c_bucket")).agg(F.array_sort(F.collect_list("_second")).alias("_cuts"))
    same = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys] + [F.col("_bucket").eqNullSafe(F.col("_c_bucket"))]
    joined = base.join(cuts, reduce(lambda a, b: a & b, same), "left")
    last = F.array_max(F.filter("_cuts", lambda c: c <= F.col(time)))
    return joined.withColumn("_bucket", F.coalesce(last, F.col("_bucket"))).drop("_cuts", "_c_bucket", *[f"_c_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: list[str],
    time: str,
    order: list[Column],
    sums: dict[str, Column] | None = None,
    grain: str = "hour",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Exact running row number and sums per key, in two levels.

    A plain window would sort a whole key in one task.  Here rows are windowed
    inside ``(key, time bucket)`` only, and each bucket starts from the totals
    of the earlier buckets, which are computed on pre-aggregated rows.  Adds
    ``rn`` and one column per entry of ``sums``.  ``order`` must start with
    the ascending time column and end in a unique column.

    With ``rows_per_bucket`` a bucket with more rows is cut again at the seconds
    where its count passes a multiple of that, so a rush hour is as many tasks as
    it has rows to fill; the cuts are exact, from counts by second.
    """
    sums = sums or {}
    base = df.withColumn("_bucket", F.date_trunc(grain, F.col(time)))
    if rows_per_bucket:
        base = _cut_buckets(base, keys, time, rows_per_bucket)
    for name, column in sums.items():
        base = base.withColumn(f"_v_{name}", column)
    cells = base.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in sums]
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_s0_{name}") for name in sums],
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = base.withColumn("_rn", F.row_number().over(local))
    for name in sums:
        inner = inner.withColumn(f"_r_{name}", F.sum(f"_v_{name}").over(upto))
    joined = inner.join(offsets, [*keys, "_bucket"])
    return joined.select(
        *df.columns,
        (F.col("_rn") + F.col("_n0")).alias("rn"),
        *[(F.col(f"_r_{name}") + F.col(f"_s0_{name}")).alias(name) for name in sums],
    )
