"""Consensus between several readings of one receipt (CON1 to CON8).

Readings of a receipt are a handful of rows, gathered once into an ordered
array; precedence and weighting are built-in array functions.  Text similarity
is the only step in Python, on the pairs that reach it.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate
from math import nan

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.functions.core import let, notes, num, ratio
from spendlake.functions.text import first
from spendlake.operators.similar import similarity

ENGINE_ORDER = ["tesseract", "easyocr", "paddleocr"]


def _place(engine: Column) -> Column:
    result = None
    for i, name in enumerate(ENGINE_ORDER):
        result = F.when(engine == name, i) if result is None else result.when(engine == name, i)
    return result.otherwise(len(ENGINE_ORDER))


def _sum(cells: Column, value) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda s, c: s + value(c))


def _weighted(group: Column) -> Column:
    return _sum(group, lambda c: c["confidence"] * c["weight"]) / _sum(group, lambda c: c["weight"])


def vendor_consensus(readings: DataFrame) -> DataFrame:
    """CON1: a reading above .7 wins; else an exact majority; else the best similar group; else confidence times weight.

    The bonus of a winner is capped at 1.
    """
    valid = readings.filter(F.trim("vendor") != "")
    cell = F.struct(_place(F.col("engine")).alias("place"), F.col("vendor").alias("text"), "confidence", "weight")
    base = valid.groupBy("receipt_id").agg(F.sort_array(F.collect_list(cell)).alias("e"))
    same = lambda x: F.filter("e", lambda y: F.upper(F.trim(y["text"])) == F.upper(F.trim(x["text"])))

    def top(key) -> Column:
        """First reading of the greatest key."""
        return F.array_max(F.transform("e", lambda x: F.struct(key(x).alias("k"), (-x["place"]).alias("p"), x.alias("x"))))

    ranked = base.select(
        "receipt_id",
        "e",
        F.size("e").alias("n"),
        top(lambda x: x["confidence"]).alias("surest"),
        top(lambda x: F.size(same(x))).alias("common"),
        top(lambda x: x["confidence"] * x["weight"]).alias("heaviest"),
    )
    group = F.filter("e", lambda y: F.upper(F.trim(y["text"])) == F.upper(F.trim(F.col("common.x.text"))))
    open_cases = ranked.filter((F.col("n") > 1) & (F.col("surest.k") <= 0.7) & (F.col("common.k") < 2))
    one = open_cases.select("receipt_id", "e", F.explode("e").alias("a")).select("receipt_id", "a", F.explode("e").alias("b"))
    pairs = one.filter(F.col("a.place") != F.col("b.place")).withColumn("s", similarity(F.lower("a.text"), F.lower("b.text")))
    near = pairs.filter(F.col("s") > 0.9).groupBy("receipt_id", "a").agg(
        F.count(F.lit(1)).alias("m"),
        F.sum("s").alias("ss"),
        F.sum("b.weight").alias("w"),
        F.sum(F.col("b.confidence") * F.col("b.weight")).alias("cw"),
    )
    size, mean = F.col("m") + 1, (F.col("ss") + 1) / (F.col("m") + 1)
    conf = (F.col("cw") + F.col("a.confidence") * F.col("a.weight")) / (F.col("w") + F.col("a.weight"))
    similar = near.groupBy("receipt_id").agg(
        F.max(
            F.struct(
                (mean * conf * size).alias("score"),
                (-F.col("a.place")).alias("p"),
                F.col("a.text").alias("text"),
                F.least(F.lit(1.0), conf * mean).alias("confidence"),
                size.alias("size"),
            )
        ).alias("near")
    )
    rows = ranked.join(similar, "receipt_id", "left")
    bonus = lambda c: F.least(F.lit(1.0), c * 1.1)

    def answer(text: Column, confidence: Column, method: str, engines: Column) -> Column:
        return F.struct(text.alias("vendor"), confidence.alias("confidence"), F.lit(method).alias("consensus_type"), engines.cast("int").alias("engines"))

    only = F.get("e", F.lit(0))
    n = F.col("n")
    picked = (
        F.when(n == 1, answer(only["text"], only["confidence"], "single_engine", n))
        .when(F.col("surest.k") > 0.7, answer(F.col("surest.x.text"), bonus(F.col("surest.k")), "high_confidence_priority", n))
        .when(F.col("common.k") >= 2, answer(F.col("common.x.text"), bonus(_weighted(group)), "exact_match", F.size(group)))
        .when(F.col("near").isNotNull(), answer(F.col("near.text"), F.col("near.confidence"), "high_similarity", F.col("near.size")))
        .otherwise(answer(F.col("heaviest.x.text"), F.col("heaviest.x.confidence"), "weighted_confidence", n))
    )
    return rows.select("receipt_id", picked.alias("_p")).select("receipt_id", "_p.*")


def _median(values: Column) -> Column:
    n = F.size(values)
    half = F.floor((n - 1) / 2).cast("int")
    return let(F.array_sort(values), lambda ordered: (F.get(ordered, half) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def resolve_amounts(cells: Column) -> Column:
    """Conflict between amounts: those within a tenth and ten times the median, weighted by confidence; two decimals.

    ``cells`` are structs of ``amount`` and ``confidence``.  When every amount
    is out of range the surest one stands.
    """
    # every value that is used several times is worked out once
    amounts = F.transform(cells, lambda c: c["amount"])
    within = lambda middle: F.filter(cells, lambda c: c["amount"].between(middle * 0.1, middle * 10))
    surest = F.array_max(F.transform(cells, lambda c: F.struct(c["confidence"].alias("c"), c["amount"].alias("a"))))
    lone = F.get(cells, F.lit(0))

    def weighted(kept: Column, weight: Column) -> Column:
        amount = F.bround(_sum(kept, lambda c: c["amount"] * c["confidence"]) / weight, 2)
        return F.struct(amount.alias("amount"), (weight / F.size(kept)).alias("confidence"))

    def several(kept: Column) -> Column:
        best = let(surest, lambda s: F.struct(s["a"].alias("amount"), s["c"].alias("confidence")))
        return F.when(F.size(kept) == 0, best).otherwise(let(_sum(kept, lambda c: c["confidence"]), lambda weight: weighted(kept, weight)))

    return F.when(F.size(cells) == 1, F.struct(lone["amount"].alias("amount"), lone["confidence"].alias("confidence"))).otherwise(
        let(let(_median(amounts), within), several)
    )


def amount_consensus(readings: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """CON2: a spread of at most 5 % gives the weighted mean; otherwise the conflict is resolved."""
    cell = F.struct(_place(F.col("engine")).alias("place"), num("total_amount").alias("amount"), "confidence")
    gathered = readings.filter(F.col("total_amount").isNotNull()).groupBy("receipt_id").agg(
        F.sort_array(F.collect_list(cell)).alias("c"), F.max(num("total_amount")).alias("hi"), F.min(num("total_amount")).alias("lo")
    )
    close = (F.col("hi") == 0) | (ratio(F.col("hi") - F.col("lo"), F.col("hi")) <= tolerance)
    weight = _sum(F.col("c"), lambda c: c["confidence"])
    mean = F.bround(_sum(F.col("c"), lambda c: c["amount"] * c["confidence"]) / weight, 2)
    resolved = resolve_amounts(F.col("c"))
    return gathered.select(
        "receipt_id",
        F.when(close, mean).otherwise(resolved["amount"]).alias("amount"),
        F.when(close, weight / F.size("c")).otherwise(resolved["confidence"]).alias("confidence"),
        F.when(close, "weighted_average").otherwise("conflict_resolved").alias("consensus_type"),
    )


def normal_date(text: Column) -> Column:
    """A date as ``dd/mm/yyyy``: year-first text is recognised as such, two-digit years below 50 are in this century."""
    iso, local = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"

    def join(day: Column, month: Column, year: Column) -> Column:
        short = F.when(year.try_cast("int") < 50, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
        full = F.when(F.length(year) == 4, year).otherwise(short)
        return F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), full)

    return (
        F.when(text.rlike(iso), join(first(text, iso, 3), first(text, iso, 2), first(text, iso, 1)))
        .when(text.rlike(local), join(first(text, local, 1), first(text, local, 2), first(text, local, 3)))
        .otherwise(text)
    )


def date_consensus(readings: DataFrame) -> DataFrame:
    """CON3: the most frequent normalised date; .6 by its frequency and .4 by its mean confidence."""
    rows = readings.filter(F.coalesce("date", F.lit("")) != "").withColumn("_d", normal_date(F.col("date")))
    counts = rows.groupBy("receipt_id", "_d").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.min(_place(F.col("engine"))).alias("p")
    )
    best = counts.groupBy("receipt_id").agg(
        F.max(F.struct("n", (-F.col("p")).alias("p"), F.col("_d").alias("date"), "c")).alias("b"), F.sum("n").alias("all")
    )
    return best.select(
        "receipt_id",
        F.col("b.date").alias("date"),
        (F.col("b.n") / F.col("all") * 0.6 + F.col("b.c") * 0.4).alias("confidence"),
    )


#: A merged line.  Of each amount ``x`` that are the sum ``xs``, the weight ``xw`` and the number ``xn`` of
#: what is weighed; without a number, the amount as it is and its confidence.
MERGED = T.ArrayType(
    T.StructType(
        [T.StructField("group", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("product_name", T.StringType())]
        + [T.StructField("score", T.DoubleType()), T.StructField("own", T.DoubleType())]
        + [T.StructField(f"{x}{y}", T.LongType() if y == "n" else T.DoubleType()) for x in "qut" for y in "swn"]
    )
)


@lru_cache(maxsize=100_000)
def _likeness(a: str, b: str) -> float:
    """Matching share of two names; a name within the other matches whole, unless the matcher skips what is common in a long one."""
    if a == b:
        return 1.0
    if len(b) < 200 and (a in b or b in a):
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b))
    return SequenceMatcher(None, a, b).ratio()


@lru_cache(maxsize=100_000)
def _letters(name: str) -> dict[str, int]:
    """The places of each letter as bits."""
    places: dict[str, int] = {}
    for i, letter in enumerate(name):
        places[letter] = places.get(letter, 0) | 1 << i
    return places


@lru_cache(maxsize=100_000)
def _common(name: str, other: str) -> int:
    """Longest common subsequence of two names; matching blocks are one, so they are never longer."""
    places, n = _letters(name), len(name)
    whole = left = (1 << n) - 1
    for letter in other:
        if met := left & places.get(letter, 0):
            left = (left + met | left - met) & whole
    return n - left.bit_count()


def _groups(names: list[str], prices: list[float]) -> tuple[list[int], list[float]]:
    """Group and agreement of each item; items are alike from .7 of the name's and .3 of the price's likeness.

    What is cheap to know goes first: prices, lengths and common letters bound the likeness from above.
    """
    group, agreement = list(range(len(names))), [1.0] * len(names)
    left, sizes = list(range(len(names))), list(map(len, names))
    while left:
        i, rest, members = left[0], [], [left[0]]
        a, p, n = names[i], prices[i], sizes[i]
        for j in left[1:]:
            b, q, m = names[j], prices[j], sizes[j]
            if not n or not m:
                rest.append(j)
                continue
            price = 1.0
            if p > 0 and q > 0:
                price = max(0.0, 1.0 - abs(p - q) / (p if p > q else q) * 5)
            if a == b:
                alike = price == 0.0 or 0.7 + price * 0.3 >= 0.7
            elif price == 0.0 or 2.0 * (n if n < m else m) / (n + m) * 0.7 + price * 0.3 < 0.7:
                alike = False
            elif a not in b and b not in a and 2.0 * _common(a, b) / (n + m) * 0.7 + price * 0.3 < 0.7:
                alike = False
            else:
                alike = _likeness(a, b) * 0.7 + price * 0.3 >= 0.7
            if alike:
                group[j] = i
                members.append(j)
            else:
                rest.append(j)
        left = rest
        if len(members) > 1:
            own = [names[j] for j in members]
            for j, name in zip(members, own):
                agreement[j] = sum([_likeness(name, other) for other in own]) / len(own)
    return group, agreement


def _rank(x: float | None) -> tuple:
    """Order of amounts as in Spark: null, numbers, NaN."""
    return (0, 0.0) if x is None else (2, 0.0) if x != x else (1, x)


def _sums(amounts: list[float | None], confidences: list[float | None]) -> tuple[float | None, float | None, int | None]:
    """What :func:`resolve_amounts` divides: sum and weight of the amounts near the median, and their number.

    Without a number these are the amount itself and its confidence: that of a
    lone reading, or of the surest one if none is near.
    """
    n = len(amounts)
    if n == 1:
        return amounts[0], confidences[0], None
    known = [a for a in amounts if a is not None and a == a]
    known = sorted(known) + [nan for a in amounts if a != a]  # NaN is above all numbers
    kept = []
    if len(known) > n // 2:  # nulls are last, and a null median has nothing near
        middle = (known[(n - 1) // 2] + known[n // 2]) / 2
        low, high = middle * 0.1, middle * 10
        kept = [i for i, a in enumerate(amounts) if a is not None and (a != a or low <= a) and (a <= high or high != high)]
    if not kept:
        best = max(range(n), key=lambda i: (_rank(confidences[i]), _rank(amounts[i])))
        return amounts[best], confidences[best], None
    total = weight = 0.0
    for i in kept:
        confidence = confidences[i]
        if confidence is None:
            return None, None, len(kept)
        total += amounts[i] * confidence
        weight += confidence
    return total, weight, len(kept)


def _merged(names: list[str | None], amounts: list[list[float | None]], confidences: list[float | None]) -> list[tuple]:
    """The lines of a receipt in the form of :data:`MERGED`; ``amounts`` are quantities, unit prices and totals."""
    prices = [t if u is None or u == 0 else u for u, t in zip(*amounts[1:])]
    group, agreement = _groups([(n or "").lower() for n in names], [nan if p is None else p for p in prices])
    members: dict[int, list[int]] = {}
    for i, g in enumerate(group):
        members.setdefault(g, []).append(i)
    out = []
    for g, own in members.items():
        sure = [confidences[i] for i in own]
        scores = [None if c is None else agreement[i] * c for i, c in zip(own, sure)]
        best = scores.index(max(scores, key=_rank)) if len(own) > 1 else 0  # the first of equal ones
        q, u, t = [_sums([column[i] for i in own], sure) for column in amounts]
        out.append((g, len(own), names[own[best]], scores[best], sure[0], *q, *u, *t))
    return out


@F.arrow_udf(MERGED)
def merged_lines(names: pa.Array, quantities: pa.Array, units: pa.Array, totals: pa.Array, confidences: pa.Array) -> pa.Array:
    """Groups and merges the few items of each receipt in reading order."""
    starts = [0, *accumulate(names.value_lengths().to_pylist())]
    name, *amounts, confidence = (column.flatten().to_pylist() for column in (names, quantities, units, totals, confidences))
    ends, rows = [0], []
    for a, b in zip(starts, starts[1:]):
        rows += _merged(name[a:b], [column[a:b] for column in amounts], confidence[a:b])
        ends.append(len(rows))
    types = [pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), *[pa.float64(), pa.float64(), pa.int64()] * 3]
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows) if rows else [()] * len(types), types)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=MERGED.elementType.names))


def item_consensus(items: DataFrame, keep_over: float = 0.3) -> DataFrame:
    """CON4: like items of all engines merged field by field; items of one source keep their own values.

    ``items``: ``receipt_id, engine, line, product_name, quantity,
    unit_price, line_total, confidence``.
    """
    cell = F.struct(_place(F.col("engine")).alias("place"), "line", "product_name", "quantity", "unit_price", "line_total", "confidence")
    gathered = items.groupBy("receipt_id").agg(F.sort_array(F.collect_list(cell)).alias("i"))
    # a receipt's items are together, so they are merged where they are
    columns = [F.col(f"i.{name}").cast("array<double>") for name in ("quantity", "unit_price", "line_total", "confidence")]
    rows = gathered.select("receipt_id", F.explode(merged_lines(F.col("i.product_name"), *columns)).alias("m")).select("receipt_id", "m.*")

    def amount(x: str) -> Column:
        return F.when(F.col(f"{x}n").isNull(), F.col(f"{x}s")).otherwise(F.bround(F.col(f"{x}s") / F.col(f"{x}w"), 2))

    def sure(x: str) -> Column:
        return F.when(F.col(f"{x}n").isNull(), F.col(f"{x}w")).otherwise(F.col(f"{x}w") / F.col(f"{x}n"))

    mean = (F.least(F.lit(1.0), F.col("score")) + sure("q") + sure("u") + sure("t")) / 4
    confidence = F.when(F.col("n") == 1, F.col("own")).otherwise(mean)
    return rows.select(
        "receipt_id",
        "group",
        "product_name",
        amount("q").alias("quantity"),
        amount("u").alias("unit_price"),
        amount("t").alias("line_total"),
        confidence.alias("confidence"),
        F.when(F.col("n") == 1, "single_source").otherwise("multi_engine").alias("consensus_type"),
        F.col("n").alias("sources"),
    ).filter(F.col("confidence") > keep_over)


def overall_confidence(vendor: DataFrame, amount: DataFrame, date: DataFrame, items: DataFrame, engines: DataFrame) -> DataFrame:
    """CON5: mean of vendor, amount, date and item confidence and of engines over three."""

    def named(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("receipt_id", F.col("confidence").alias(name))

    item = items.groupBy("receipt_id").agg(F.avg("confidence").alias("confidence"))
    joined = (
        engines.groupBy("receipt_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(named(vendor, "vendor_confidence"), "receipt_id", "left")
        .join(named(amount, "amount_confidence"), "receipt_id", "left")
        .join(named(date, "date_confidence"), "receipt_id", "left")
        .join(named(item, "items_confidence"), "receipt_id", "left")
        .na.fill(0.0)
    )
    parts = ["vendor_confidence", "amount_confidence", "date_confidence", "items_confidence"]
    total = sum((F.col(p) for p in parts), F.lit(0.0)) + F.col("_n") / 3
    return joined.select("receipt_id", *parts, (total / 5).alias("consensus_confidence"))


def corrected_items(items: DataFrame) -> DataFrame:
    """CON6: a line total more than 5 % (and 10) off quantity times price is recomputed."""
    expected = F.col("quantity") * F.col("unit_price")
    off = F.abs(expected - F.col("line_total")) > F.greatest(expected * 0.05, F.lit(10.0))
    return items.withColumn("is_corrected", off).withColumn(
        "line_total", F.when(off, F.bround(expected, 2)).otherwise(F.col("line_total"))
    )


def corrected_totals(amount: DataFrame, items: DataFrame) -> DataFrame:
    """CON6: a total more than 10 % (and 50) off the sum of its lines becomes that sum."""
    sums = items.groupBy("receipt_id").agg(F.sum("line_total").alias("_s"))
    rows = amount.join(sums, "receipt_id", "left")
    off = F.coalesce(F.abs(F.col("_s") - F.col("amount")) > F.greatest(F.col("amount") * 0.1, F.lit(50.0)), F.lit(False))
    return rows.select(
        "receipt_id", F.when(off, F.bround("_s", 2)).otherwise(F.col("amount")).alias("amount"), off.alias("is_corrected")
    )


def corrected_dates(dates: DataFrame) -> DataFrame:
    """CON6: dates in the normal form, and which of them that changed."""
    normal = normal_date(F.col("date"))
    return dates.withColumn("_d", normal).select(
        *[c for c in dates.columns if c != "date"], F.col("_d").alias("date"), F.coalesce(F.col("_d") != F.col("date"), F.lit(False)).alias("is_corrected")
    )


def applied_corrections(items: DataFrame, totals: DataFrame, dates: DataFrame) -> DataFrame:
    """CON6: the corrections that a receipt took, from the results of the three operators above.

    One entry for each corrected line, then the total, then the date; receipts
    without any do not appear.
    """
    parts = [("line_total_calculation", items), ("total_amount_reconciliation", totals), ("date_normalization", dates)]
    counts = [
        rows.filter("is_corrected").groupBy("receipt_id").agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("kind", F.lit(kind)).withColumn("place", F.lit(i))
        for i, (kind, rows) in enumerate(parts)
    ]
    # three rows of a receipt at most
    gathered = counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "n"))).alias("k"))
    return gathered.select(
        "receipt_id",
        F.array_join(F.flatten(F.transform("k", lambda k: F.array_repeat(k["kind"], k["n"]))), "|").alias("corrections"),
        F.aggregate("k", F.lit(0), lambda n, k: n + k["n"]).alias("corrections_applied"),
    )


def disagreements(readings: DataFrame, confidences: DataFrame) -> DataFrame:
    """CON7: where engines differ in vendor or amount (above 10 %), and which fields are below .5."""
    spread = readings.groupBy("receipt_id").agg(
        F.count_distinct("vendor").alias("_v"), F.max(num("total_amount")).alias("_hi"), F.min(num("total_amount")).alias("_lo")
    )
    rows = spread.join(confidences, "receipt_id", "left")
    low = lambda name: F.coalesce(F.col(name) < 0.5, F.lit(False))
    return rows.select(
        "receipt_id",
        notes(
            (F.col("_v") > 1, "vendor_disagreement"),
            (ratio(F.col("_hi") - F.col("_lo"), F.col("_hi")) > 0.1, "total_amount_disagreement"),
        ).alias("disagreements"),
        notes(
            (low("vendor_confidence"), "low_vendor_confidence"),
            (low("amount_confidence"), "low_total_confidence"),
            (low("items_confidence"), "low_line_items_confidence"),
        ).alias("low_confidence"),
    )


AUTOMATIC_FROM = 0.95


def final_confidence(results: DataFrame, automatic_from: float = AUTOMATIC_FROM) -> DataFrame:
    """CON8: .4 reading, .3 validation, .2 category, bonuses for corrections and validation; automatic from the threshold."""
    bonus = F.least(F.col("corrections_applied") * 0.05, F.lit(0.15))
    passed = F.when(F.coalesce("validation_passed", F.lit(False)), 0.1).otherwise(0.0)
    score = (
        F.coalesce("confidence", F.lit(0.0)) * 0.4
        + F.coalesce("validation_confidence", F.lit(0.6)) * 0.3
        + F.coalesce("category_confidence", F.lit(0.5)) * 0.2
        + bonus
        + passed
    )
    final = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return results.select("receipt_id", final.alias("final_confidence"), (final >= automatic_from).alias("fully_automated"))
