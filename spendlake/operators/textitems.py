"""Receipt text to product lines, and the checks on them (TXT12 to TXT16, TXT28, TXT30, TXT31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.core import let, notes, num, ratio
from spendlake.functions.text import clean, contains_any, every, first, first_of, lines, peso_price, undotted

# Line filters, price and quantity patterns, name repairs and brands of the line parser.
SKIP_LINES = [
    r"^(fecha|date|hora|time|rut|folio|bol)",
    r"^(total|subtotal|iva|descuento|cambio|vuelt)",
    r"^(caja|cajero|vendedor|cliente)",
    r"^(gracias|muchas gracias|vuelva pronto)",
    r"^\s*$",
]
PRICES = [r"\$\s*(\d{1,3}(?:\.\d{3})*)", r"\$\s*(\d+)", r"(\d{1,3}(?:\.\d{3})*)\s*\$?"]
QUANTITIES = [r"(\d+)[xX]", r"(?i)(\d+)\s*UND", r"(?i)(\d+)\s*KG", r"(?i)(\d+,?\d*)\s*X"]
#: What every quantity has.
MARKED = r"(?i)\d,?\s*[xuk]"
BARCODE = r"\b(\d{7,13})\b"
PRICE_RANGE = (10, 1_000_000)
NAME_REPAIRS = [
    ("BENED", "AGUA BENEDICTINO"),
    ("CACHANT", "AGUA CACHANTUN"),
    ("COC COL", "COCA COLA"),
    ("C COLA", "COCA COLA"),
    ("GALLET", "GALLETAS"),
    ("PAN MOL", "PAN MOLDE"),
    ("LEC ENT", "LECHE ENTERA"),
]
LINE_BRANDS = [
    "BENEDICTINO", "CACHANTUN", "DASANI", "COCA COLA", "PEPSI", "FANTA", "SPRITE", "SOPROLE", "COLUN", "SURLAT",
    "IDEAL", "BIMBO", "QUIX", "MR MUSCULO", "CONFORT",
]


def text_lines(texts: DataFrame) -> DataFrame:
    """Each line of each text with its position."""
    rows = texts.select("receipt_id", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    return rows.withColumn("pos", F.col("pos").cast("int"))


def product_lines(texts: DataFrame) -> DataFrame:
    """TXT12: lines with a price or code that are not headers or footers, parsed one by one."""
    # one anchor for all, so that places after the first fail at once
    skipped = F.lower(F.trim("line")).rlike(f"^(?:{'|'.join(p.removeprefix('^') for p in SKIP_LINES)})")
    kept = text_lines(texts).filter(F.col("line").rlike(r"\d") & ~skipped)

    def repaired(name: Column) -> Column:
        result = None
        for part, full in NAME_REPAIRS:
            hit = name.contains(part)
            result = F.when(hit, full) if result is None else result.when(hit, full)
        return result.otherwise(name)

    # Each value is a column of its own, worked out once and in compiled code; a pattern is tried only where its letters occur.
    line = F.col("line")
    code = F.regexp_extract(line, r"(?=\d)" + BARCODE, 1)
    coded = kept.withColumn("_code", code).withColumn("barcode", F.when(F.col("_code") != "", F.col("_code")))
    counts = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in QUANTITIES]
    counts = [F.replace(c, F.lit(","), F.lit(".")).try_cast("double") for c in counts]
    quantity = F.when(line.rlike(MARKED), F.coalesce(*counts, F.lit(1.0))).otherwise(1.0)
    bare = F.trim(F.replace(F.trim(line), F.coalesce("barcode", F.lit("\n")), F.lit("")))
    bare = F.regexp_replace(bare, r"\$\s*\d+[,.]?\d*", "")
    bare = F.regexp_replace(bare, r"^\d+[xX]\s*", "")
    # Exploding a one-element array fixes the name: the filter does not work it out again.
    read = coded.select("receipt_id", "pos", "line", "barcode", F.explode(F.array(F.upper(F.trim(F.regexp_replace(bare, r"[^a-zA-ZáéíóúÁÉÍÓÚñÑ0-9]+", " "))))).alias("_name"))
    signed = F.when(line.contains("$"), F.concat(*[every(line, p) for p in PRICES if p.startswith(r"\$")])).otherwise(F.array().cast("array<string>"))
    found = F.transform(F.array_distinct(F.concat(signed, *[every(line, p) for p in PRICES if not p.startswith(r"\$")])), undotted)
    prices = F.array_sort(F.array_distinct(F.filter(found, lambda p: p.between(*PRICE_RANGE))))
    parsed = read.filter((F.col("_name") != "") | F.col("barcode").isNotNull()).select(
        "receipt_id", "pos", F.trim(line).alias("raw_line"), "barcode", quantity.alias("quantity"), repaired(F.col("_name")).alias("name"), prices.alias("prices")
    )
    n = F.size("prices")
    lowest, highest = F.array_min("prices"), F.array_max("prices")
    priced = parsed.withColumn(
        "unit_price", F.when(n == 1, ratio(highest, F.col("quantity"))).when(n == 2, lowest)
    ).withColumn("total_price", F.when(n >= 1, highest))
    unit, total = F.col("unit_price"), F.col("total_price")
    fits = (unit > 0) & (F.abs(F.try_divide(F.col("quantity") * unit - total, total)) < 0.1)
    confidence = (
        F.lit(0.3)
        + F.when(F.col("barcode").isNotNull(), 0.2).otherwise(0.0)
        + F.when(F.length("name") > 2, 0.2).otherwise(0.0)
        + F.when(F.coalesce(fits, F.lit(False)), 0.2).otherwise(0.0)
        + F.when(contains_any(F.col("name"), LINE_BRANDS), 0.1).otherwise(0.0)
    )
    return priced.withColumn("confidence", F.least(F.lit(1.0), confidence)).drop("prices")


# Product layouts over several lines, in order of precedence.
STACKED_COUNTED = r"(?i)(\d+)X(\d{1,3}(?:\.\d{3})*)\s*\n\s*([A-Z\s\d]+?)\s*\n\s*\$\s*(\d{1,3}(?:\.\d{3})*)"
STACKED_CODED = r"(?i)(\d{13})\s+([A-Z\s\d]+?)\s*\n\s*\$\s*(\d{1,3}(?:\.\d{3})*)"
STACKED_PLAIN = r"(?i)([A-Z\s\d]{5,30})\s*\n\s*\n\s*(\d{1,3}(?:\.\d{3})*)"


def stacked_products(texts: DataFrame) -> DataFrame:
    """TXT13: products spread over lines; the first pattern and place claims a name within the receipt."""
    text = F.col("text")

    def matches(pattern: str, needs: str, **groups: int) -> Column:
        """Each match as a struct of its groups.

        A text without what every match holds is not searched; the others are searched once, and the groups come from the short match.
        """
        whole = F.when(text.rlike(needs), every(text, pattern, 0)).when(text.isNotNull(), F.array().cast("array<string>"))
        return F.transform(whole, lambda m: F.struct(*[F.regexp_extract(m, pattern, g).alias(name) for name, g in groups.items()]))

    def title(name: Column) -> Column:
        bare = F.regexp_replace(name, r"^\d{13}\s*", "")
        return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"[$\n\r]+$", "")))

    def item(name, quantity, unit, total, confidence, barcode=None) -> Column:
        return F.struct(
            title(name).alias("name"),
            quantity.cast("int").alias("quantity"),
            unit.alias("unit_price"),
            total.alias("total_price"),
            confidence.alias("confidence"),
            (F.lit(None) if barcode is None else barcode).cast("string").alias("barcode"),
        )

    counted = F.transform(
        matches(STACKED_COUNTED, r"(?i)\dX\d", q=1, u=2, n=3, t=4),
        lambda m: item(m["n"], m["q"], peso_price(m["u"]), peso_price(m["t"]), F.lit(0.95)),
    )
    coded = F.transform(
        matches(STACKED_CODED, r"\d{13}\s", b=1, n=2, t=3),
        lambda m: item(m["n"], F.lit(1), peso_price(m["t"]), peso_price(m["t"]), F.lit(0.9), m["b"]),
    )

    def loose(m: Column) -> Column:
        amount = peso_price(m["t"])
        small = amount < 100
        price = F.when(small, 0.0).otherwise(amount)
        return item(m["n"], F.when(small, amount).otherwise(1), price, price, F.when(small, 0.7).otherwise(0.8))

    plain = F.transform(matches(STACKED_PLAIN, r"\n\s*\n\s*\d", n=1, t=2), loose)
    longer = lambda size: lambda i: F.length(i["name"]) > size
    ranked = F.concat(F.filter(counted, longer(2)), F.filter(coded, longer(2)), F.filter(plain, longer(3)))
    rows = texts.select("receipt_id", F.posexplode(ranked).alias("_p", "_i"))
    first_of_name = rows.groupBy("receipt_id", F.col("_i.name").alias("_n")).agg(F.min_by("_i", "_p").alias("_i"))
    return first_of_name.select("receipt_id", "_i.*")


# Generic item layouts by confidence; (tier, fields in group order, pattern).
WORDS = r"A-Za-záéíóúñ"
LAYOUTS = [
    ("high", "name quantity unit price total", rf"([{WORDS}\s]{{3,40}})\s+(\d+(?:[.,]\d+)?)\s*([a-z]{{1,5}})?\s+\$?\s*(\d+(?:[.,]\d+)?)\s+\$?\s*(\d+(?:[.,]\d+)?)"),
    ("high", "quantity unit name total", rf"(\d+\.\d+)\s+(kg|g|l|ml)\s+([{WORDS}\s]{{2,30}})\s+\$\s*(\d+\.\d{{3}})"),
    ("high", "code name total", rf"(\d{{4,}})\s+([{WORDS}\s]{{3,40}})\s+\$?\s*(\d+(?:[.,]\d+)?)"),
    ("high", "quantity name total", rf"(\d+)\s*x\s*([{WORDS}\s]{{3,30}})\s+\$?\s*(\d+\.\d{{3}})"),
    ("high", "code name total", rf"(\d{{7,10}})\s+([{WORDS}\s0-9]+)\s+\$\s*(\d+\.\d{{3}})"),
    ("medium", "name total", rf"^([{WORDS}\s]{{5,40}})\s+\$?\s*(\d+(?:[.,]\d+)?)$"),
    ("medium", "quantity name total", rf"^(\d+)\s+([{WORDS}\s]{{3,30}})\s+\$?\s*(\d+(?:[.,]\d+)?)$"),
    ("medium", "name quantity unit total", rf"([{WORDS}\s]{{3,30}})\s+(\d+(?:[.,]\d+)?)\s*([a-z]{{1,5}})\s+\$?\s*(\d+(?:[.,]\d+)?)"),
    ("low", "name total", rf"([{WORDS}\s]{{3,50}})\s+(\d+[.,]\d{{2}})"),
    ("low", "name total", rf"([{WORDS}\s]{{3,40}})\s+.*?(\d+[.,]\d{{2}})"),
]
#: What a line needs for the layouts that open with a run of letters, by their place; cheap to look for.
LAYOUT_NEEDS = {
    0: r"\d\s*[A-Za-z]{0,5}\s+\$?\s*\d+(?:[.,]\d+)?\s+\$?\s*\d",
    7: r"\d\s*[A-Za-z]{1,5}\s+\$?\s*\d",
    8: r"\s\d+[.,]\d{2}",
    9: r"\d[.,]\d{2}",
}
TIER_CONFIDENCE = {"high": 0.9, "medium": 0.7, "low": 0.5}
NOT_ITEMS = ["total", "subtotal", "iva", "tax", "fecha", "hora", "rut", "direccion"]
LINE_PRICES = r"\$\s*(\d+\.\d{3}|\d+[.,]\d{2})|(\d+\.\d{3})\s*\$"
LINE_QUANTITIES = [r"(?i)(\d+\.\d+)\s+(kg|g|l|ml|lt)\s+", r"(?i)(\d+)\s*x\s+", r"(?i)(\d+)\s+(unid|pza|paq)\s+"]
SKUS = [r"^(\d{6,12})\s+", r"\b(\d{8})\b", r"#([A-Z0-9-]{4,15})", r"\s#(\d+)\s", r"^([A-Z]+-\d+)\s", r"^([A-Z][A-Z0-9]+-\d+)\s"]
UNITS = [
    "kg", "kilo", "kilos", "kilogramo", "kilogramos", "g", "gr", "gram", "gramo", "gramos", "lb", "libra", "libras", "oz", "onza", "onzas",
    "l", "lt", "ltr", "litro", "litros", "ml", "mililitro", "mililitros", "cc", "cm3", "unid", "unidad", "unidades", "pza", "pieza", "piezas",
    "paq", "paquete", "paquetes", "caja", "cajas", "bolsa", "bolsas", "lata", "latas", "botella", "botellas", "m", "mt", "metro", "metros",
    "cm", "centimetro", "centimetros", "mm", "milimetro", "milimetros",
]


def peso_number(text: Column) -> Column:
    """A number whose dot parts thousands when three digits follow, and is decimal otherwise."""
    bare = F.regexp_replace(text, r"[$\s]", "")
    thousands = bare.rlike(r"\.\d{3}$")
    return F.when(thousands, F.replace(bare, F.lit("."), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit("."))).try_cast("double")


def _shown_price(text: Column) -> Column:
    """A price as printed; a small decimal number is meant in thousands."""
    value = peso_number(text)
    implied = (value < 100) & text.rlike(r"[.,]")
    return F.when(implied, value * 1000).otherwise(value)


def generic_items(texts: DataFrame) -> DataFrame:
    """TXT14: items of any layout: tiered patterns, code, quantity, unit, price and adjusted confidence."""
    rows = text_lines(texts.withColumn("text", clean(F.col("text"))))
    line, low = F.col("line"), F.lower("line")
    shaped = line.rlike(r"\$?\s*\d+[.,]\d{2}") | line.rlike(rf"[{WORDS}]{{3,}}\s+\d+")
    lines_kept = rows.filter((F.length(F.trim(line)) >= 5) & ~contains_any(low, NOT_ITEMS) & line.rlike(r"\d") & shaped)

    def record(found: Column, tier: str, names: list[str], full: str) -> Column:
        def group(name: str) -> Column:
            return first(found, full, names.index(name) + 1) if name in names else F.lit(None).cast("string")

        # Four digits are too short for a code and count as a quantity.
        short_code = (F.length(group("code")) <= 4) if "code" in names else F.lit(False)
        quantity = F.when(short_code, group("code")).otherwise(group("quantity"))
        cells = F.struct(
            F.initcap(F.regexp_replace(F.trim(group("name")), r"\s+", " ")).alias("description"),
            F.coalesce(peso_number(quantity), F.lit(1.0)).alias("quantity"),
            F.coalesce(group("unit"), F.lit("unid")).alias("unit"),
            peso_number(group("price")).alias("unit_price"),
            peso_number(group("total")).alias("total_price"),
            F.lit(TIER_CONFIDENCE[tier]).alias("base"),
        )
        return F.when(found != "", cells)

    def option(place: int) -> Column:
        """The line is searched once for a layout; the groups come from the short match, which no layout looks beyond."""
        tier, fields, pattern = LAYOUTS[place]
        full = "(?i)" + pattern
        found = let(F.regexp_extract(line, full, 0), lambda match: record(match, tier, fields.split(), full))
        return F.when(line.rlike(LAYOUT_NEEDS[place]), found) if place in LAYOUT_NEEDS else found

    chosen = F.coalesce(*map(option, range(len(LAYOUTS))))
    # Exploding fixes a value: a filter on it would move below and search the line again.
    matched = lines_kept.select("receipt_id", "pos", "line", F.explode(F.array_compact(F.array(chosen))).alias("_i"))

    shown = F.array_compact(F.transform(every(line, LINE_PRICES, 0), lambda p: _shown_price(F.regexp_replace(p, r"[$\s]", ""))))
    counts = [first(line, p) for p in LINE_QUANTITIES]
    count = F.coalesce(*counts).try_cast("double")
    count_unit = F.lower(F.coalesce(first(line, LINE_QUANTITIES[0], 2), F.when(counts[1].isNotNull(), F.lit("unid")), first(line, LINE_QUANTITIES[2], 2)))
    priced = matched.select("*", F.explode(F.array(shown)).alias("_shown"))
    found = priced.select(
        "receipt_id",
        "pos",
        "line",
        F.col("_i.description").alias("description"),
        F.coalesce(count, F.col("_i.quantity")).alias("quantity"),
        F.coalesce(count_unit, F.col("_i.unit")).alias("unit"),
        F.coalesce(F.try_element_at("_shown", F.lit(-1)), F.col("_i.total_price")).alias("total_price"),
        F.when(F.size("_shown") == 0, F.col("_i.unit_price")).alias("stated_unit_price"),
        first_of(line, *SKUS).alias("sku"),
        F.col("_i.base").alias("base"),
    )
    unit_price = F.coalesce("stated_unit_price", ratio(F.col("total_price"), F.col("quantity")))
    rows = found.withColumn("unit_price", unit_price)
    size, price = F.length("description"), F.col("total_price")
    exact = F.abs(F.col("unit_price") * F.col("quantity") - price)

    def plus(condition: Column, value: float) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0.0)

    confidence = (
        F.col("base")
        + plus(exact < 0.01, 0.1)
        + plus(size.between(5, 40), 0.05)
        + plus(F.lower("unit").isin(UNITS), 0.05)
        + plus(price.between(0.1, 10_000), 0.05)
        - plus(size < 3, 0.2)
        + plus(F.col("sku").isNotNull(), 0.1)
        + plus(F.col("quantity") != 1, 0.05)
        + plus(F.col("unit") != "unid", 0.05)
        - plus(exact > 0.1, 0.1)
    )
    valid = (F.length(F.trim("description")) >= 2) & (price > 0)
    return rows.filter(valid).select(
        "receipt_id",
        "pos",
        "description",
        "sku",
        "quantity",
        "unit",
        "unit_price",
        "total_price",
        F.greatest(F.lit(0.1), F.least(F.lit(1.0), confidence)).alias("confidence"),
    )


def distinct_products(items: DataFrame) -> DataFrame:
    """TXT15: one item per name, barcode and total within a receipt: the surest, then the earliest."""
    order = F.struct(F.col("confidence"), (-F.col("pos")).alias("_p"))
    row = F.struct(*items.columns)
    kept = items.groupBy(
        "receipt_id", F.upper(F.trim("name")).alias("_n"), F.coalesce("barcode", F.lit("")).alias("_b"), F.coalesce("total_price", F.lit(0.0)).alias("_t")
    ).agg(F.max_by(row, order).alias("_r"))
    return kept.select("_r.*")


def _alike(a: Column, b: Column) -> Column:
    """Same text, all long words of the shorter in the longer, or same price and a long word in common."""
    one, two = F.trim(F.lower(a["description"])), F.trim(F.lower(b["description"]))
    long_words = lambda text: F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 3)
    first_words, second_words = long_words(one), long_words(two)
    covered = F.when(
        F.size(first_words) < F.size(second_words),
        (F.size(first_words) >= 1) & F.forall(first_words, lambda w: two.contains(w)),
    ).otherwise((F.size(second_words) >= 1) & F.forall(second_words, lambda w: one.contains(w)))
    sized = (F.length(one) > 6) & (F.length(two) > 6)
    priced = (a["total_price"] != 0) & (F.abs(a["total_price"] - b["total_price"]) < 0.01)
    return (one == two) | (sized & covered) | F.coalesce(priced & F.arrays_overlap(first_words, second_words), F.lit(False))


def merged_items(items: DataFrame) -> DataFrame:
    """TXT15, fuzzy form: items folded in reading order; a look-alike replaces the kept item only if surer.

    The fold is a built-in array aggregate over the items of one receipt.
    """
    fields = ["pos", "description", "total_price", "confidence"]
    record = F.struct(*fields)
    kind = items.select(F.array(record)).schema[0].dataType.simpleString()
    gathered = items.groupBy("receipt_id").agg(F.sort_array(F.collect_list(record)).alias("_i"))

    def fold(kept: Column, item: Column) -> Column:
        twin = F.get(F.filter(kept, lambda k: _alike(item, k)), F.lit(0))
        swapped = F.array_append(F.filter(kept, lambda k: k["pos"] != twin["pos"]), item)
        return (
            F.when(twin.isNull(), F.array_append(kept, item)).when(item["confidence"] > twin["confidence"], swapped).otherwise(kept)
        )

    survivors = F.aggregate("_i", F.array().cast(kind), fold)
    return gathered.select("receipt_id", F.explode(survivors).alias("_k")).select("receipt_id", "_k.*")


def repaired_items(items: DataFrame) -> DataFrame:
    """TXT16: a quantity that is not positive becomes 1; a missing unit or total price is derived."""
    rows = items.filter((F.coalesce("name", F.lit("")) != "") | F.col("barcode").isNotNull())
    quantity = F.when(F.col("quantity") <= 0, 1.0).otherwise(F.col("quantity"))
    rows = rows.withColumn("quantity", quantity)
    no_unit = F.coalesce("unit_price", F.lit(0)) == 0
    no_total = F.coalesce("total_price", F.lit(0)) == 0
    return rows.withColumn(
        "unit_price", F.when(no_unit & ~no_total, F.col("total_price") / F.col("quantity")).otherwise(F.col("unit_price"))
    ).withColumn(
        "total_price", F.when(no_total & ~no_unit, F.col("unit_price") * F.col("quantity")).otherwise(F.col("total_price"))
    )


def line_consistency(items: DataFrame, fix_below: float = 0.05) -> DataFrame:
    """TXT28: quantity times unit price against the total; a drift below the bound is corrected.

    The line extractor corrects below 5 %, the item validator below 10 %.
    """
    quantity, unit, total = num("quantity"), num("unit_price"), num("total_price")
    expected = quantity * unit
    checked = F.coalesce((quantity > 0) & (unit > 0), F.lit(False))
    off = checked & (F.abs(expected - total) > 0.1)
    small = off & (F.abs(expected - total) / F.greatest(expected, total) < fix_below)
    return items.select(
        "receipt_id",
        "pos",
        F.when(small, expected).otherwise(total).alias("total_price"),
        expected.alias("expected_total"),
        (~off).alias("is_consistent"),
        small.alias("is_corrected"),
    )


def consistency_report(checked: DataFrame) -> DataFrame:
    """TXT28: whether all items of a receipt fit, and which positions do not."""
    issue = F.when(~F.col("is_consistent"), F.col("pos"))
    return checked.groupBy("receipt_id").agg(
        F.bool_and("is_consistent").alias("consistent"),
        F.sort_array(F.collect_list(issue)).alias("issues"),
        F.count_if("is_corrected").alias("corrections_applied"),
    )


def extraction_quality(items: DataFrame, report: DataFrame) -> DataFrame:
    """TXT30: confidence of a receipt's items with bonuses, and its grade."""
    means = items.groupBy("receipt_id").agg(F.avg("confidence").alias("avg_item_confidence"), F.count(F.lit(1)).alias("lines_count"))
    rows = means.join(report, "receipt_id", "left")
    # Every line carries the receipt's correction count, so the bonus grows with lines times corrections.
    steps = F.coalesce("corrections_applied", F.lit(0)) * F.col("lines_count")
    passed = F.when(F.coalesce("consistent", F.lit(False)), 0.1).otherwise(0.0)
    # Rounded far below any step, so that the order of adding cannot move a value across a grade's border.
    total = F.round(F.least(F.lit(1.0), F.col("avg_item_confidence") + passed + F.least(steps * 0.02, F.lit(0.1))), 9)
    grade = F.when(total >= 0.95, "excellent").when(total >= 0.85, "good").when(total >= 0.70, "fair").otherwise("poor")
    return rows.select("receipt_id", "lines_count", "avg_item_confidence", total.alias("confidence"), grade.alias("extraction_quality"))


def receipt_totals(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """TXT31: derived subtotal and total, savings, effective unit price, and validation errors.

    ``items``: ``receipt_id, quantity, total_price, original_price,
    discount_amount, is_valid``; ``receipts``: ``receipt_id, merchant,
    subtotal, total_amount, tax_amount, tip_amount, discount_amount``.
    """
    saved = F.when(
        (F.coalesce("original_price", F.lit(0)) != 0) & (F.coalesce("total_price", F.lit(0)) != 0),
        num("original_price") - num("total_price"),
    ).otherwise(num(F.coalesce("discount_amount", F.lit(0))))
    sums = items.groupBy("receipt_id").agg(
        num(F.sum("total_price")).alias("_sum"),
        F.sum(saved).alias("_saved"),
        F.sum("quantity").alias("_units"),
        F.count(F.lit(1)).alias("item_count"),
        F.count_if(~F.coalesce("is_valid", F.lit(True))).alias("_bad"),
    )
    rows = receipts.join(sums, "receipt_id", "left")

    def zero(name: str) -> Column:
        return num(F.coalesce(F.col(name), F.lit(0)))

    derived = F.col("_sum") + zero("tax_amount") + zero("tip_amount") - zero("discount_amount")
    subtotal = F.coalesce(num("subtotal"), F.when(F.col("_sum") > 0, F.col("_sum")))
    total = F.coalesce(num("total_amount"), F.when(derived > 0, derived))
    errors = notes(
        (F.col("merchant").isNull() & (F.coalesce(total, F.lit(0.0)) == 0), "Recibo sin información básica (comerciante o total)"),
        (total < 0, "Total no puede ser negativo"),
        (subtotal > total, "Subtotal no puede ser mayor que el total"),
        (F.col("_bad") > 0, "Ítems no válidos"),
    )
    return rows.select(
        "receipt_id",
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
        subtotal.alias("subtotal"),
        total.alias("total_amount"),
        (F.coalesce("_saved", F.lit(0.0)) + zero("discount_amount")).alias("total_savings"),
        ratio(F.col("_sum"), F.col("_units")).alias("effective_unit_price"),
        errors.alias("errors"),
    )
