"""Product and vendor dictionaries with fuzzy matching (TXT24 to TXT27)."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.functions.core import lookup
from spendlake.operators.similar import most_similar

# Product key, category, names, known misreadings.
PRODUCTS = [
    ("coca_cola", "bebidas", ["coca cola", "coca-cola", "cocacola", "coke", "cc"], ["ccca ccla", "coca ccla", "ceca cola", "coca c0la"]),
    ("pepsi", "bebidas", ["pepsi", "pepsi cola"], ["pepsl", "peps1", "pep5i"]),
    ("sprite", "bebidas", ["sprite", "7up"], ["5prite", "sprlte", "spr1te"]),
    ("leche_soprole", "lacteos", ["leche soprole", "soprole", "leche"], ["1eche", "leche s0pr0le", "sopr0le"]),
    ("yogurt", "lacteos", ["yogurt", "yoghurt", "yogur"], ["y0gurt", "yogu rt", "y0gur"]),
    ("pan_hallulla", "panaderia", ["hallulla", "pan hallulla", "pan"], ["ha11u11a", "hallul1a", "hal1ulla"]),
    ("pan_marraqueta", "panaderia", ["marraqueta", "pan marraqueta", "pan frances"], ["marraq ueta", "marraqu3ta", "marraq"]),
    ("pollo", "carnes", ["pollo", "pechuga", "trutro", "muslo"], ["p0llo", "pol1o", "pechug a"]),
    ("carne_vacuno", "carnes", ["lomo", "asado", "posta", "carne"], ["l0mo", "asad0", "p0sta"]),
    ("tomate", "frutas_verduras", ["tomate", "tomates"], ["t0mate", "tomat e", "tom ate"]),
    ("palta", "frutas_verduras", ["palta", "paltas", "aguacate"], ["pa1ta", "pal ta", "p4lta"]),
    ("platano", "frutas_verduras", ["platano", "banana", "plátano"], ["p1atano", "platan0", "banan a"]),
    ("arroz", "abarrotes", ["arroz", "arroz grado 1", "arroz grado 2"], ["arr0z", "arrcz", "arr oz"]),
    ("aceite", "abarrotes", ["aceite", "aceite maravilla", "aceite oliva"], ["ace1te", "acelte", "ace ite"]),
    ("azucar", "abarrotes", ["azucar", "azúcar", "azucar blanca"], ["azuc ar", "azuc4r", "4zucar"]),
]
# Price ranges of every product by size; the first one counts where the size is unknown.
PRICE_RANGES = {
    "coca_cola": {"350ml": (800, 1500), "500ml": (1000, 2000), "1.5L": (1500, 3000)},
    "pepsi": {"350ml": (700, 1400), "500ml": (900, 1800), "1.5L": (1400, 2800)},
    "sprite": {"350ml": (800, 1500), "500ml": (1000, 2000)},
    "leche_soprole": {"1L": (800, 1500), "200ml": (300, 600)},
    "yogurt": {"125g": (400, 800), "150g": (500, 900), "1kg": (2000, 4000)},
    "pan_hallulla": {"unidad": (150, 400)},
    "pan_marraqueta": {"unidad": (100, 300)},
    "pollo": {"kg": (2500, 5000)},
    "carne_vacuno": {"kg": (5000, 12000)},
    "tomate": {"kg": (800, 2500)},
    "palta": {"kg": (1500, 4000)},
    "platano": {"kg": (800, 2000)},
    "arroz": {"1kg": (800, 1800), "5kg": (3500, 8000)},
    "aceite": {"1L": (1500, 3500), "900ml": (1300, 3000)},
    "azucar": {"1kg": (600, 1500), "5kg": (2500, 6000)},
}
# Vendor spellings and known misreadings.
VENDORS = [
    "jumbo", "hiper jumbo", "jumbo kennedy", "lider", "hiper lider", "express lider", "santa isabel", "santa isa", "sta isabel",
    "tottus", "hipermercado tottus", "unimarc", "hiper unimarc", "copec", "estacion copec", "copec pronto", "shell", "estacion shell",
    "shell select", "esso", "estacion esso", "petrobras", "estacion petrobras", "cruz verde", "farmacia cruz verde", "salcobrand",
    "farmacia salcobrand", "ahumada", "farmacia ahumada", "falabella", "saga falabella", "ripley", "tiendas ripley", "paris",
    "tiendas paris", "sodimac", "homecenter sodimac", "easy", "easy homecenter",
]
VENDOR_MISREADINGS = {
    "jumb0": "jumbo", "j umbo": "jumbo", "jum bo": "jumbo", "1ider": "lider", "l1der": "lider", "li der": "lider", "c0pec": "copec",
    "cop ec": "copec", "c opec": "copec", "she11": "shell", "sh ell": "shell", "cruz verd e": "cruz verde", "cruz v erde": "cruz verde",
    "salc0brand": "salcobrand", "salco brand": "salcobrand", "fa1abella": "falabella", "falabe11a": "falabella", "rip1ey": "ripley",
    "ripl ey": "ripley", "par1s": "paris", "pa ris": "paris", "s0dimac": "sodimac", "sodi mac": "sodimac", "ea5y": "easy", "e asy": "easy",
}
# Characters and what they are misread as.
CONFUSIONS = {
    "0": ["O", "o", "Q"], "1": ["I", "l", "|", "i"], "5": ["S", "s"], "6": ["G", "b"], "8": ["B"], "a": ["4", "@"], "e": ["3"],
    "i": ["1", "l", "|"], "o": ["0", "O"], "s": ["5", "$"], "t": ["7", "+"], "u": ["v", "n"], " ": ["_", "-", "."],
    "ñ": ["n", "fi", "ri"], "á": ["a", "4"], "é": ["e", "3"], "í": ["i", "1"], "ó": ["o", "0"], "ú": ["u", "v"],
}


def comparable(text: Column) -> Column:
    """Lower case, symbols removed, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s]", ""), r"(?U)\s+", " "))


def _entries(spark: SparkSession) -> DataFrame:
    """The dictionary: every name and known misreading, in order."""
    rows = []
    for key, category, names, misread in PRODUCTS:
        rows += [(key, category, n, n, False) for n in names]
        rows += [(key, category, m, names[0], True) for m in misread]
    kind = "place int, product string, category string, b string, corrected_name string, was_variation boolean"
    return spark.createDataFrame([(-i, *row) for i, row in enumerate(rows)], kind)


def match_products(names: DataFrame, threshold: float = 0.6, learned: DataFrame | None = None) -> DataFrame:
    """TXT24: the dictionary entry most like each name, at or above the threshold; no product and confidence 0 without one.

    Each distinct name is compared once, and only with entries whose letters
    allow the threshold (:mod:`spendlake.operators.similar`).  ``learned`` adds
    pairs of ``learned_name`` and ``corrected_name`` seen before, of any number;
    the dictionary goes before them where both are as similar.
    """
    entries = _entries(names.sparkSession)
    if learned is not None:
        entries = entries.unionByName(
            learned.select(
                F.lit(-100_000).alias("place"), F.lit("learned").alias("product"), F.coalesce("category", F.lit("unknown")).alias("category"),
                F.lower("learned_name").alias("b"), "corrected_name", F.lit(False).alias("was_variation"),
            )
        )
    unique = names.select("name").distinct().withColumn("_q", comparable(F.col("name")))
    close = most_similar(unique.select(F.col("_q").alias("a")), entries, threshold)
    found = F.struct(F.col("similarity").alias("confidence"), "place", "product", "corrected_name", "category", "was_variation")
    best = close.join(entries, "b").groupBy("a").agg(F.max(found).alias("_m"))
    return unique.join(best, unique["_q"] == best["a"], "left").select(
        "name",
        "_m.product",
        F.coalesce("_m.corrected_name", "name").alias("corrected_name"),
        "_m.category",
        F.coalesce("_m.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("_m.was_variation", F.lit(False)).alias("was_variation"),
    )


def correct_vendors(texts: DataFrame, over: float = 0.7) -> DataFrame:
    """TXT25: vendor names: a known misreading at .9, else the most similar spelling above .7, else unchanged at .3."""
    unique = texts.select("vendor").distinct().withColumn("_q", comparable(F.col("vendor")))
    direct = lookup(F.col("_q"), VENDOR_MISREADINGS)
    rows = unique.withColumn("_d", direct)
    spellings = texts.sparkSession.createDataFrame([(-i, v) for i, v in enumerate(VENDORS)], "place int, b string")
    close = most_similar(rows.filter(F.col("_d").isNull()).select(F.col("_q").alias("a")), spellings, over).filter(F.col("similarity") > over)
    best = close.join(spellings, "b").groupBy(F.col("a").alias("_q")).agg(F.max(F.struct(F.col("similarity").alias("_r"), "place", F.col("b").alias("spelling"))).alias("_b"))
    joined = rows.join(best, "_q", "left")
    return joined.select(
        "vendor",
        F.initcap(F.coalesce("_d", "_b.spelling")).alias("corrected_name"),
        F.when(F.col("_d").isNotNull(), 0.9).otherwise(F.coalesce("_b._r", F.lit(0.3))).alias("confidence"),
        F.when(F.col("_d").isNotNull(), "direct_ocr_correction").when(F.col("_b").isNotNull(), "fuzzy_matching").otherwise("none").alias("method"),
    )


def _best_ratio(text: str) -> float:
    """Similarity of a name to its most similar dictionary entry."""
    plain = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", text.lower())).strip()
    matcher, best = SequenceMatcher(None), 0.0
    for _, _, names, misread in PRODUCTS:
        for entry in names + misread:
            matcher.set_seqs(plain, entry)
            if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
                best = max(best, matcher.ratio())
    return best


@F.pandas_udf(T.StructType([T.StructField("repaired", T.StringType()), T.StructField("confidence", T.DoubleType())]))
def _repair(names: pd.Series) -> pd.DataFrame:
    known: dict[str, float] = {}

    def ratio(text: str) -> float:
        if text not in known:
            known[text] = _best_ratio(text)
        return known[text]

    rows = []
    for text in names:
        for right, wrongs in CONFUSIONS.items() if text is not None else ():
            for wrong in wrongs:
                if wrong in text and ratio(other := text.replace(wrong, right)) > ratio(text):
                    text = other
        rows.append((text, None if text is None else ratio(text)))
    return pd.DataFrame(rows, columns=["repaired", "confidence"])


def repair_characters(names: DataFrame) -> DataFrame:
    """TXT26: a name after every confusion repair that improves its dictionary match, each tried on what the ones before it left.

    Repairs build on each other, so each distinct name takes them in table order
    in an Arrow batch, where texts met before are not compared again.
    """
    unique = names.select("name").distinct().withColumn("_r", _repair(F.col("name")))
    return unique.select("name", "_r.repaired", "_r.confidence", (~F.col("_r.repaired").eqNullSafe(F.col("name"))).alias("is_repaired"))


def price_check(items: DataFrame, matches: DataFrame) -> DataFrame:
    """TXT27: whether a price lies in the product's range, and a tenfold or mid-range suggestion if not.

    A column ``size`` of ``items`` picks the range of that size; without one, or
    for a size that the product lacks, its first range counts.
    """
    sure = matches.filter(F.col("confidence") >= 0.7).select("name", "product")
    rows = items.join(sure, "name", "left")

    def bound(end: int) -> Column:
        general = lookup(F.col("product"), {k: next(iter(v.values()))[end] for k, v in PRICE_RANGES.items()})
        if "size" not in items.columns:
            return general
        sized = lookup(F.concat_ws(" ", "product", "size"), {f"{k} {z}": x[end] for k, v in PRICE_RANGES.items() for z, x in v.items()})
        return F.coalesce(sized, general)

    low, high = bound(0), bound(1)
    price, middle = F.col("price"), (low + high) / 2
    valid = F.coalesce(price.between(low, high), F.lit(True))
    tenth, tenfold = price / 10, price * 10
    suggested = (
        F.when((price > high * 5) & tenth.between(low, high), tenth)
        .when((price < low / 5) & tenfold.between(low, high), tenfold)
        .otherwise(middle)
    )
    confidence = F.when(low.isNull(), 0.3).when(valid, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(price - middle) / (high - low)))
    return rows.select(
        *items.columns, "product", valid.alias("is_valid"), confidence.alias("confidence"), F.when(~valid, suggested).alias("suggested_price")
    )
