"""Receipt text to fields: header, transaction, payment, dates, vendor and place (TXT1 to TXT3, TXT10, TXT11, TXT17 to TXT22).

Patterns run as built-in regular expressions on whole texts; one pass per text,
no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.core import AsOf, let, ts
from spendlake.functions.text import (
    clean,
    contains_any,
    every,
    first,
    first_of,
    is_upper,
    lines,
    mean_of,
    nfkd,
    peso_price,
    plain,
    undotted,
)

# Patterns of the header, the transaction, the store and the payment.
NUMBER = r"(\d{1,3}(?:\.\d{3})*)"
TOTALS = [r"TOTAL\s*\$?\s*" + NUMBER, r"TOTAL.*?" + NUMBER, r"IMPORTE\s*\$?\s*" + NUMBER]
TAXABLE = r"AFECTO.*?" + NUMBER
VAT = r"IVA.*?" + NUMBER
FOLIOS = [r"BOL.*?(\d{8,})", r"FOLIO.*?(\d{8,})", r"N[ÚU]MERO.*?(\d{8,})"]
TAX_IDS = [r"RUT.*?(\d{1,2}\.\d{3}\.\d{3}-[\dkK])", r"(\d{1,2}\.\d{3}\.\d{3}-[\dkK])"]
DATES = [r"FECHA:?\s*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})", r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"]
TRANSACTION = {
    "total": r"(?i)TOTAL\s*\$?\s*" + NUMBER,
    "taxable": r"(?i)TOTAL\s+AFECTO\s*\$?\s*" + NUMBER,
    "subtotal": r"(?i)SUBTOTAL\s*" + NUMBER,
    "rated_vat": r"(?i)TOTAL\s+IVA\s*\(([\d\.]+)%\)\s*\n?\s*" + NUMBER,
    "vat": r"(?i)IVA\s*\$?\s*" + NUMBER,
    "items": r"(?i)TOTAL\s+NUMERO\s+DE\s+ARTIC\s+VEND\s*=\s*(\d+)",
    "payment": r"(?i)(EFECTIVO|DEBITO|CREDITO|DEBIT/PREPAG|TRANSFERENCIA)",
    "change": r"(?i)VUELTO\s*\$?\s*" + NUMBER,
}
STORE = {
    "tax_id": r"(?i)RUT[:.]?\s*(\d{1,2}\.?\d{3}\.?\d{3}-[\dkK])",
    "date": r"(?i)Fecha[:.]?\s*(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})",
    "time": r"(?i)Hora[:.]?\s*(\d{1,2}):(\d{2})(?::(\d{2}))?",
    "receipt": r"(?i)Bol\.?\s*Electronica[:.]?\s*(\d{8,15})",
    "address": r"(?i)SUC[:.]?\s*([^\n]{10,100})",
    "city": r"(?i)([A-Za-z\.]+(?:\s+[A-Za-z\.]+)*)-([A-Za-z\.]+(?:\s+[A-Za-z\.]+)*)",
    "register": r"(?i)Caja[:.]?\s*(\d+)",
}
PAYMENTS = [
    ("cash", r"\b(?:efectivo|cash|contado)\b"),
    ("card", r"\b(?:tarjeta|card|visa|mastercard|amex)\b"),
    ("debit", r"\b(?:débito|debit)\b"),
    ("credit", r"\b(?:crédito|credit)\b"),
    ("transfer", r"\b(?:transferencia|transfer|wire)\b"),
    ("check", r"\b(?:cheque|check)\b"),
]
CARD_DIGITS = r"(?i)(?:x{4}|\*{4})\s*(\d{4})"
AUTHORISATION = [r"(?i)(?:auth|authorization|autorizaci[óo]n)[\s#:]+(\w+)", r"(?i)(?:aprobaci[óo]n|approval)[\s#:]+(\w+)"]
RECEIPT_NUMBERS = [
    r"(?i)(?:recibo|receipt|factura|invoice|ticket)[\s#:]*(\w+)",
    r"(?i)(?:no|num|number|número)[\s#:]*(\w+)",
    r"#(\d+)",
    r"(\d{6,})",
]
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6,
    "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}


def cleaned(documents: DataFrame) -> DataFrame:
    """TXT1: texts cleaned line by line."""
    return documents.withColumn("clean_text", clean(F.col("text")))


def normalised(documents: DataFrame) -> DataFrame:
    """TXT1: decomposed, lower-case, symbol-free texts for matching."""
    return documents.withColumn("plain_text", plain(nfkd(F.col("text"))))


def iso_date(text: Column) -> Column:
    """``d/m/y`` or ``d-m-y`` as ISO text; two-digit years are in this century."""
    parts = F.split(text, r"[/\-]")
    year = F.get(parts, F.lit(2))
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.concat_ws("-", full, F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0"))


def header(texts: DataFrame) -> DataFrame:
    """TXT10: vendor, total, taxable amount, VAT, folio, date and tax id; the first pattern that matches wins."""
    text, upper = F.col("text"), F.upper("text")
    top = F.transform(lines(text, 5), lambda line: F.upper(F.trim(line)))
    vendor = F.get(F.filter(top, lambda line: (F.length(line) > 3) & ~line.rlike(r"^\d")), F.lit(0))
    found = first_of(text, *DATES)
    return texts.select(
        "receipt_id",
        vendor.alias("vendor"),
        undotted(first_of(upper, *TOTALS)).alias("total_amount"),
        undotted(first(upper, TAXABLE)).alias("subtotal"),
        undotted(first(upper, VAT)).alias("vat_amount"),
        first_of(upper, *FOLIOS).alias("folio"),
        F.when(found.isNotNull(), iso_date(found)).alias("date"),
        first_of(text, *TAX_IDS).alias("tax_id"),
    )


def transaction(texts: DataFrame) -> DataFrame:
    """TXT11: totals, VAT, items, payment, change, store fields, and the mean confidence of what was found."""
    text = F.col("text")

    def price(key: str, group: int = 1) -> Column:
        return peso_price(first(text, TRANSACTION[key], group))

    def weight(found: Column, value: float) -> Column:
        return F.when(found.isNotNull(), value)

    total, taxable, subtotal = price("total"), price("taxable"), price("subtotal")
    rate, rated = first(text, TRANSACTION["rated_vat"]), price("rated_vat", 2)
    vat, change = price("vat"), price("change")
    items, payment = first(text, TRANSACTION["items"]), F.upper(first(text, TRANSACTION["payment"]))
    money = mean_of(
        weight(total, 0.95),
        F.when(total.isNull() & taxable.isNotNull(), 0.9),
        weight(subtotal, 0.9),
        F.coalesce(weight(rated, 0.95), weight(vat, 0.85)),
        weight(items, 0.9),
        weight(payment, 0.8),
        weight(change, 0.8),
    )

    top = F.transform(lines(text, 5), F.trim)
    named = lambda line: (F.length(line) >= 5) & is_upper(line) & ~contains_any(F.lower(line), ["rut", "fecha", "boleta"])
    store = F.get(F.filter(top, named), F.lit(0))
    tax_id, receipt = first(text, STORE["tax_id"]), first(text, STORE["receipt"])
    part = [first(text, STORE["date"], i) for i in (1, 2, 3)]
    day = F.try_to_timestamp(F.concat_ws("-", part[2], F.lpad(part[1], 2, "0"), F.lpad(part[0], 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    clock = [first(text, STORE["time"], i) for i in (1, 2, 3)]
    time = F.concat_ws(":", F.lpad(clock[0], 2, "0"), clock[1], clock[2])
    # a match that began inside a word would have begun with the word
    address, city, register = F.trim(first(text, STORE["address"])), F.trim(first(text, r"(?<![A-Za-z.])" + STORE["city"])), first(text, STORE["register"])
    place = mean_of(
        weight(store, 0.9),
        weight(tax_id, 0.95),
        weight(day, 0.95),
        weight(clock[0], 0.9),
        weight(receipt, 0.9),
        weight(address, 0.85),
        weight(city, 0.8),
        weight(register, 0.8),
    )
    return texts.select(
        "receipt_id",
        F.coalesce(total, taxable).alias("total_amount"),
        subtotal.alias("subtotal"),
        F.when(rated.isNotNull(), rate.try_cast("double")).when(vat.isNotNull(), 19.0).alias("vat_rate"),
        F.coalesce(rated, vat).alias("vat_amount"),
        items.cast("int").alias("total_items"),
        payment.alias("payment_method"),
        change.alias("change_amount"),
        money.alias("transaction_confidence"),
        store.alias("store_name"),
        tax_id.alias("tax_id"),
        day.alias("transaction_date"),
        F.when(clock[0].isNotNull(), time).alias("transaction_time"),
        receipt.alias("receipt_number"),
        address.alias("address"),
        city.alias("city"),
        register.alias("register"),
        place.alias("location_confidence"),
    )


def parse_confidence(parsed: DataFrame) -> DataFrame:
    """TXT17: the three confidence scores of a parse.

    ``parsed`` has ``vendor, total_amount, date, subtotal, vat_amount, folio,
    payment_method, address, items, needs_reconciliation,
    products_confidence, transaction_confidence, location_confidence``.
    """

    def bonus(condition: Column, value: float) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0.0)

    def has(name: str) -> Column:
        return F.col(name).isNotNull()

    paid = F.col("total_amount") > 0
    listed = F.col("items") > 0
    structured = (
        bonus(has("vendor"), 0.15)
        + bonus(paid, 0.20)
        + bonus(has("date"), 0.10)
        + bonus(listed, 0.25)
        + F.least(F.col("items") * 0.05, F.lit(0.15))
        + bonus(~F.col("needs_reconciliation"), 0.15)
    )
    weighted = (
        F.col("products_confidence") * 0.4 + F.col("transaction_confidence") * 0.4 + F.col("location_confidence") * 0.2
    )
    general = (
        F.lit(0.3)
        + bonus(has("vendor"), 0.15)
        + bonus(paid, 0.20)
        + bonus(has("date"), 0.10)
        + bonus(listed, 0.15)
        + bonus(has("folio"), 0.05)
        + bonus(has("payment_method"), 0.05)
        + bonus(has("subtotal"), 0.05)
        + bonus(has("vat_amount"), 0.05)
        + bonus(has("address"), 0.05)
    )
    one = F.lit(1.0)
    return parsed.select(
        "receipt_id",
        F.least(one, structured).alias("structured_confidence"),
        (F.bround(weighted * 100, 2) / 100).alias("weighted_confidence"),
        F.least(one, general).alias("general_confidence"),
    )


def amount_consistency(amounts: DataFrame) -> DataFrame:
    """TXT18: confidences lowered where total, subtotal, tax and discount do not fit together."""
    total, subtotal = F.col("total"), F.col("subtotal")
    tax, discount = F.coalesce("tax", F.lit(0.0)), F.coalesce("discount", F.lit(0.0))
    both = (total != 0) & (subtotal != 0)
    off = F.coalesce(both & (F.abs(F.try_divide(total - (subtotal + tax - discount), total)) > 0.05), F.lit(False))
    above = F.coalesce(both & (subtotal > total), F.lit(False))
    heavy = F.coalesce((subtotal != 0) & (discount > subtotal), F.lit(False))
    penalty = F.when(off, 0.8).otherwise(1.0)
    return amounts.select(
        "receipt_id",
        (~off).alias("is_consistent"),
        (F.col("total_confidence") * penalty).alias("total_confidence"),
        (F.col("subtotal_confidence") * penalty * F.when(above, 0.5).otherwise(1.0)).alias("subtotal_confidence"),
        (F.col("discount_confidence") * F.when(heavy, 0.5).otherwise(1.0)).alias("discount_confidence"),
    )


def payment(texts: DataFrame) -> DataFrame:
    """TXT19: payment method, last card digits, authorisation code and receipt number."""
    text, lower = F.col("text"), F.lower("text")
    method = None
    for name, pattern in PAYMENTS:
        # a first letter rules a place out sooner than a word boundary
        starts = "".join(dict.fromkeys(word[0] for word in pattern[len(r"\b(?:") : -len(r")\b")].split("|")))
        hit = lower.rlike(f"(?U)(?=[{starts}]){pattern}")
        method = F.when(hit, name) if method is None else method.when(hit, name)
    return texts.select(
        "receipt_id",
        method.alias("method"),
        first(text, CARD_DIGITS).alias("card_last_digits"),
        first_of(text, *AUTHORISATION).alias("authorization_code"),
        first_of(text, *RECEIPT_NUMBERS).alias("receipt_number"),
    )


def _day(year: Column, month: Column, day: Column) -> Column:
    """A valid date or null; two-digit years below 50 are in this century."""
    y = year.try_cast("int")
    full = F.when(F.length(year) <= 2, F.when(y < 50, y + 2000).otherwise(y + 1900)).otherwise(y)
    text = F.format_string("%04d-%02d-%02d", full, month.try_cast("int"), day.try_cast("int"))
    return F.when(full.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


# Date forms (method, confidence, pattern, groups of year, month and day; "local" is day and month in the language's order).
DATE_FORMS = [
    ("numeric", 0.9, r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})\b", "local"),
    ("numeric", 0.9, r"\b(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})\b", (1, 2, 3)),
    ("numeric", 0.9, r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2})\b", "local"),
    ("month_name", 0.85, r"(?U)\b(\d{1,2})\s+(?:de\s+)?(\p{L}+)\s+(?:del?\s+)?(\d{2,4})\b", (3, 2, 1)),
    ("month_name", 0.85, r"(?U)\b(\p{L}+)\s+(\d{1,2}),?\s+(\d{2,4})\b", (3, 1, 2)),
    ("month_name", 0.85, r"(?U)\b(\d{1,2})[/\-.](\p{L}+)[/\-.](\d{2,4})\b", (3, 2, 1)),
    ("spaced", 0.7, r"\b(\d{1,2})\s+(\d{1,2})\s+(\d{4})\b", "local"),
    ("spaced", 0.7, r"\b(\d{4})\s+(\d{1,2})\s+(\d{1,2})\b", (1, 2, 3)),
    ("compact", 0.5, r"\b(\d{2})(\d{2})(\d{4})\b", "local"),
    ("compact", 0.5, r"\b(\d{4})(\d{2})(\d{2})\b", (1, 2, 3)),
]
# First three letters of the months, and the languages that write the month before the day.
MONTH_STARTS = {
    "spa": "ene feb mar abr may jun jul ago sep oct nov dic",
    "eng": "jan feb mar apr may jun jul aug sep oct nov dec",
    "por": "jan fev mar abr mai jun jul ago set out nov dez",
}
MONTH_FIRST = ["eng"]
#: Confidence of day and month in the other order, against that of the language's own.
SWAPPED = 2 / 3


def receipt_date(texts: DataFrame, as_of: AsOf, language: str = "spa") -> DataFrame:
    """TXT20: the surest date of a receipt, within ten years back and a day ahead.

    Every match of every form is a candidate, so an invalid one does not hide a
    later one; of equally sure ones the form listed first wins, then the match
    read first.  Day and month are also tried in the other order, less surely.
    """
    low = F.lower(clean(F.col("text")))
    starts = F.array(*[F.lit(start) for start in MONTH_STARTS[language].split()])

    def month(word: Column, how: str) -> Column:
        return F.array_position(starts, F.substring(word, 1, 3)).cast("string") if how == "month_name" else word

    def found(place: int, how: str, sure: float, pattern: str, order: tuple[int, int, int]) -> Column:
        def record(match: Column, i: Column) -> Column:
            year, mid, day = [first(match, pattern, g) for g in order]
            return F.struct(F.lit(sure).alias("confidence"), F.lit(-place).alias("place"), (-i).alias("i"), _day(year, month(mid, how), day).alias("date"), F.lit(how).alias("method"))

        # The text is searched once per form; the groups come from the short match.
        return F.transform(every(low, pattern, 0), record)

    options = []
    for how, sure, pattern, order in DATE_FORMS:
        orders = [(order, sure)]
        if order == "local":
            pair = [(3, 2, 1), (3, 1, 2)]
            own, other = reversed(pair) if language in MONTH_FIRST else pair
            orders = [(own, sure), (other, round(sure * SWAPPED, 2))]
        options += [found(len(options) + k, how, c, pattern, o) for k, (o, c) in enumerate(orders)]
    earliest, latest = F.to_date(ts(as_of, -3650)), F.to_date(ts(as_of, 1))
    best = F.array_max(F.filter(F.concat(*options), lambda d: d["date"].between(earliest, latest)))
    return texts.select("receipt_id", best.alias("_b")).select(
        "receipt_id",
        F.col("_b.date").alias("date"),
        F.coalesce("_b.method", F.lit("no_date_found")).alias("method"),
        F.coalesce("_b.confidence", F.lit(0.0)).alias("confidence"),
    )


# Words that speak for and against a vendor line.
BUSINESS_WORDS = ["store", "shop", "market", "restaurant", "cafe", "company", "tienda", "restaurante", "café", "empresa", "comercial", "loja"]
OTHER_WORDS = ["total", "subtotal", "tax", "iva", "receipt", "recibo", "date", "fecha", "time", "hora", "thank", "gracias"]


def vendor_score(text: Column) -> Column:
    """TXT21: how much a line looks like a vendor's name."""
    size, low = F.length(text), F.lower(text)
    score = (
        F.when(size.between(5, 40), 0.3).when(size.between(3, 50), 0.1).otherwise(0.0)
        + F.when(is_upper(text), 0.2).when(text == F.initcap(text), 0.15).otherwise(0.0)
        + F.when(~text.rlike(r"\d"), 0.15).otherwise(0.0)
        + F.when(~text.rlike(r"[$€£¥₹]"), 0.1).otherwise(0.0)
        + F.when(contains_any(low, BUSINESS_WORDS), 0.1).otherwise(0.0)
        - F.when(contains_any(low, OTHER_WORDS), 0.2).otherwise(0.0)
    )
    return F.when(size < 3, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def vendor_lines(texts: DataFrame, top: int = 5) -> DataFrame:
    """TXT21: the first lines of each text with their score."""
    rows = texts.select("receipt_id", F.posexplode(lines(F.col("text"), top)).alias("pos", "line"))
    trimmed = rows.withColumn("line", F.trim("line"))
    return trimmed.select("receipt_id", F.col("pos").cast("int").alias("pos"), "line", vendor_score(F.col("line")).alias("score"))


def vendor_vote(candidates: DataFrame) -> DataFrame:
    """TXT21: the value two strategies agree on, with .1 more confidence up to .9, else the surest candidate."""
    valid = candidates.filter((F.col("value") != "") & (F.col("confidence") > 0.2))
    groups = valid.groupBy("receipt_id", F.lower("value").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("confidence", "value")).alias("_b")
    )
    agreed = F.when(F.col("_n") > 1, F.struct(F.col("_n"), F.col("_b.confidence").alias("c"), F.col("_b.value").alias("v")))
    best = groups.groupBy("receipt_id").agg(F.max(agreed).alias("_a"), F.max("_b").alias("_b"))
    together = F.col("_a").isNotNull()
    return best.select(
        "receipt_id",
        F.coalesce("_a.v", "_b.value").alias("vendor"),
        F.when(together, F.least(F.lit(0.9), F.col("_a.c") + 0.1)).otherwise(F.col("_b.confidence")).alias("confidence"),
        F.when(together, "combined_consensus").otherwise("combined_best").alias("method"),
    )


# Address and phone patterns, communes, place words and brands with known branches.
ADDRESSES = [
    (r"(?:av\.|avenida|calle|pasaje|camino)\s+([^,\n]+?)\s+(?:n[°º]?\s*)?(\d+)(?:\s*[-,]\s*([^,\n]+))?", 3),
    (
        r"([^,\n]+?)\s+(\d+)(?:\s*[-,]\s*([^,\n]+))?,\s*"
        r"(las\s+condes|providencia|santiago|ñuñoa|vitacura|lo\s+barnechea|maipú|puente\s+alto|san\s+miguel)",
        4,
    ),
    (r"([a-záéíóúñ\s]+)\s+(\d+),\s*([a-záéíóúñ\s]+)", 3),
    (r"(mall|centro\s+comercial)\s+([^,\n]+)", 2),
    (r"([^,\n]+?)\s+(\d+)(?:\s*[-,]\s*([^,\n]+))?,?\s*(\d{7})", 4),
]
RUN_STARTS = {1: r"(?:\G|(?<=[,\n]))", 4: r"(?:\G|(?<=[,\n]))"}
# The third pattern in the form it is searched by: its matches begin and end with whole runs of letters and spaces,
# and the digits follow the first run, so nothing is tried twice.
LETTERS = r"[a-záéíóúñ\s]"
WHOLE_RUNS = rf"(?<!{LETTERS}){LETTERS}++(?<={LETTERS}\s)\d++,{LETTERS}++"
SEARCHES = [WHOLE_RUNS if i == 2 else RUN_STARTS.get(i, "") + pattern for i, (pattern, _) in enumerate(ADDRESSES)]
PHONES = [
    r"\+56\s*[2-9]\s*\d{4}\s*\d{4}",
    r"\(\+56\)\s*[2-9]\s*\d{4}\s*\d{4}",
    r"56\s*[2-9]\s*\d{4}\s*\d{4}",
    r"[2-9]\s*\d{4}\s*\d{4}",
    r"[2-9]\d{8}",
    r"\(\d{1,2}\)\s*\d{4}[-\s]?\d{4}",
]
COMMUNES = [
    "las condes", "providencia", "santiago", "ñuñoa", "vitacura", "lo barnechea", "maipú", "puente alto", "san miguel", "la reina",
    "peñalolén", "macul", "san joaquín", "la florida", "la cisterna", "el bosque", "pedro aguirre cerda", "lo espejo", "cerro navia",
    "quinta normal", "estación central", "independencia", "recoleta", "huechuraba", "quilicura", "renca", "conchalí", "cerrillos",
]
PLACE_WORDS = [
    "mall", "centro comercial", "plaza", "paseo", "galería", "terminal", "aeropuerto", "estación", "metro", "hospital",
    "clínica", "universidad", "colegio", "parque", "estadio",
]
PLACED_BRANDS = [
    "jumbo", "lider", "santa isabel", "copec", "shell", "petrobras", "cruz verde", "salcobrand", "ahumada",
    "falabella", "ripley", "mcdonalds", "burger king", "subway",
]


def _addresses(text: Column) -> Column:
    """Addresses as ``street number[, rest]`` in lower case, distinct and sorted."""
    def build(pattern: str, groups: int):
        def address(match: Column) -> Column:
            bits = F.filter(F.array(*[F.trim(F.regexp_extract(match, pattern, g)) for g in range(1, groups + 1)]), lambda b: b != "")

            def join(parts: Column) -> Column:
                one, two, three = [F.get(parts, F.lit(i)) for i in (0, 1, 2)]
                numbered = F.concat(one, F.lit(" "), two, F.when(three.isNotNull(), F.concat(F.lit(", "), three)).otherwise(""))
                return F.when(F.size(parts) >= 2, F.when(two.rlike(r"^\d+$"), numbered).otherwise(F.array_join(parts, " ")))

            return let(bits, join)

        return address

    # The text is searched once per pattern; the groups come from the short match.  A pattern that opens with a
    # run of characters can only match leftmost from the start of such a run or where the last match ended, so
    # the search is tied to those places and stays linear in the text.
    found = [F.transform(every(text, search, 0), build(pattern, groups)) for search, (pattern, groups) in zip(SEARCHES, ADDRESSES)]
    street = r"\b(?:av|avenida|calle|pasaje|camino)\b"
    valid = lambda a: a.isNotNull() & a.rlike(r"\d") & (a.rlike(street) | F.length(a).between(10, 100))
    return F.array_sort(F.array_distinct(F.filter(F.concat(*found), valid)))


def _phones(text: Column) -> Column:
    """Phone numbers in the form ``+56`` and nine digits, distinct and sorted."""
    raw = F.concat(*[every(text, p, 0) for p in PHONES])

    def normal(phone: Column) -> Column:
        bare = F.regexp_replace(phone, r"[\s()\-]", "")
        return (
            F.when(bare.startswith("+56"), bare)
            .when(bare.startswith("56") & (F.length(bare) == 11), F.concat(F.lit("+"), bare))
            .when(bare.rlike(r"^[2-9].{8}$"), F.concat(F.lit("+56"), bare))
            .otherwise(bare)
        )

    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, normal), lambda p: p.rlike(r"^\+56[2-9]\d{8}$"))))


def _words(text: Column, words: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def place_mentions(texts: DataFrame, key: str = "receipt_id") -> DataFrame:
    """TXT22: addresses, phones, brands and place words of a text, with confidence and method."""

    def look(low: Column) -> Column:
        return F.struct(
            _addresses(low).alias("addresses"),
            _phones(low).alias("phones"),
            _words(low, PLACED_BRANDS).alias("brands"),
            _words(low, PLACE_WORDS + COMMUNES).alias("place_words"),
        )

    rows = texts.select(key, F.explode(F.transform(F.array(F.trim(F.lower("text"))), look)).alias("_m")).select(key, "_m.*")

    def part(name: str, weight: float, full: int) -> Column:
        return F.least(F.size(name) / full, F.lit(1.0)) * weight

    confidence = part("addresses", 0.4, 2) + part("brands", 0.3, 2) + part("phones", 0.2, 2) + part("place_words", 0.1, 3)
    some = lambda name: F.size(name) > 0
    method = (
        F.when(some("brands") & some("addresses"), "brand_and_address")
        .when(some("brands"), "brand_matched")
        .when(some("addresses"), "address_extracted")
        .when(some("phones"), "phone_based")
        .otherwise("keyword_based")
    )
    return rows.select("*", F.least(F.lit(1.0), confidence).alias("confidence"), method.alias("extraction_method"))
