"""Language of a text by votes (TXT23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.text import whole_words

# Words that speak for a language, and scripts that settle it, in order of precedence.
LANGUAGE_WORDS = {
    "spa": [
        "total", "subtotal", "iva", "descuento", "cantidad", "precio", "fecha", "factura", "boleta",
        "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
        "lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo",
    ],
    "eng": [
        "total", "subtotal", "tax", "discount", "quantity", "price", "date", "invoice", "receipt",
        "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
        "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    ],
    "por": [
        "total", "subtotal", "imposto", "desconto", "quantidade", "preço", "data", "fatura", "recibo",
        "janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
        "segunda", "terça", "quarta", "quinta", "sexta", "sábado", "domingo",
    ],
    "fra": [
        "total", "taxe", "remise", "quantité", "prix", "date", "facture", "reçu",
        "janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre",
        "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche",
    ],
    "ita": [
        "totale", "subtotale", "tassa", "sconto", "quantità", "prezzo", "data", "fattura", "ricevuta",
        "gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre",
        "lunedì", "martedì", "mercoledì", "giovedì", "venerdì", "sabato", "domenica",
    ],
    "deu": [
        "gesamt", "zwischensumme", "steuer", "rabatt", "menge", "preis", "datum", "rechnung", "beleg",
        "januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember",
        "montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag",
    ],
}
# Scripts in order, with the code of their language.
SCRIPTS = [
    ("chi_sim", r"[一-鿿]"),
    ("jpn", r"[぀-ゟ゠-ヿ]"),
    ("kor", r"[가-힯]"),
    ("ara", r"[؀-ۿ]"),
    ("rus", r"[Ѐ-ӿ]"),
    ("tha", r"[฀-๿]"),
]
ANY_SCRIPT = "[" + "".join(pattern[1:-1] for _, pattern in SCRIPTS) + "]"
FALLBACK = "spa+eng"


def letters_only(text: Column) -> Column:
    """Digits and symbols blanked, spaces collapsed."""
    return F.trim(F.regexp_replace(text, r"(?U)(?:[^\p{L}\p{N}_]|[0-9])+", " "))


def _script(letters: Column) -> Column:
    """Language code of the first script, in order, that the text has a letter of."""
    result = None
    for name, pattern in SCRIPTS:
        hit = letters.rlike(pattern)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return F.when(letters.rlike(ANY_SCRIPT), result)


def _voted(texts: DataFrame, key: str) -> DataFrame:
    """Word votes and script of every text, in one pass over it."""
    known = sorted({w for words in LANGUAGE_WORDS.values() for w in words})
    # Exploding a one-element array fixes the value: it is not computed again where it is used.
    rows = texts.select(key, (F.length(F.trim("text")) >= 10).alias("_ok"), F.explode(F.array(letters_only(F.col("text")))).alias("_l"))
    voting = rows.select(key, "_ok", _script(F.col("_l")).alias("_script"), whole_words(F.lower("_l"), known).alias("_w"))

    def count(listed: list[str]) -> Column:
        return F.size(F.filter("_w", lambda w: w.isin(listed)))

    return voting.select(key, "_script", "_ok", *[count(ws).alias(name) for name, ws in LANGUAGE_WORDS.items()])


def word_votes(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """TXT23: how many words of each text speak for each language.

    Symbols are gone before the vote, so every pattern is a whole word and
    counting is membership in a fixed list.
    """
    return _voted(texts, key).select(key, *LANGUAGE_WORDS)


def detect(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """TXT23: the language of most word votes (at least two; close ones are joined), else the script, else the default."""
    cells = [F.struct((-F.col(n)).alias("v"), F.lit(i).alias("p"), F.lit(n).alias("lang")) for i, n in enumerate(LANGUAGE_WORDS)]
    ranked = _voted(texts, key).withColumn("_r", F.array_sort(F.array(*cells)))
    top = -F.get("_r", F.lit(0))["v"]
    close = F.filter("_r", lambda c: (-c["v"] > 0) & (-c["v"] >= top * 0.7))
    by_words = F.when(F.col("_ok") & (top >= 2), F.array_join(F.transform(F.slice(close, 1, 2), lambda c: c["lang"]), "+"))
    return ranked.select(key, by_words.alias("by_words"), F.when(F.col("_ok"), F.col("_script")).alias("by_script")).withColumn(
        "language", F.coalesce("by_words", "by_script", F.lit(FALLBACK))
    )
