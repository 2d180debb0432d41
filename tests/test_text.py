"""Receipt texts, dictionaries and consensus on literal input."""

import random
import re
import time
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from spendlake.functions.text import beginnings, locale_amount, peso_price, words_found, words_within
from spendlake.operators import catalogue, categorise, consensus, language, textfields, textitems
from spendlake.sources.canonical import Tables

STANDARD = """SUPERMERCADO EJEMPLO
RUT: 93.834.000-5
FECHA: 15/07/2024
PAN INTEGRAL 1KG          $2.590
LECHE ENTERA 1LT          $2.090
ARROZ GRADO 1             $2.290
ACEITE MARAVILLA          $2.890
TOTAL                     $14.411
AFECTO                    12.110
IVA                       2.301
"""
QUANTITIES = """2 x COCA COLA 2L          $4.790
1.5 kg PALTA HASS         $6.850
3 x YOGURT NATURAL        $1.350
"""
STACKED = "2X1.000\nBEN AGUA PER\n$ 2.000\n7803468005005 MOLD INT 630\n$ 2.890\nGALLETAOBSE\n\n1.000\n"


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "receipt_id long, text string")


def test_header_fields(spark):
    row = textfields.header(texts(spark, STANDARD)).first()
    assert (row.vendor, row.total_amount, row.subtotal, row.vat_amount) == ("SUPERMERCADO EJEMPLO", 14411.0, 12110.0, 2301.0)
    assert (row.date, row.tax_id) == ("2024-07-15", "93.834.000-5")


def test_generic_items(spark):
    items = {r.description: r for r in textitems.generic_items(texts(spark, STANDARD)).collect()}
    assert len(items) >= 4
    assert all(r.total_price > 1000 for r in items.values())
    rows = textitems.generic_items(texts(spark, QUANTITIES)).orderBy("pos").collect()
    assert [(r.quantity, r.unit, r.total_price) for r in rows] == [(2.0, "unid", 4790.0), (1.5, "kg", 6850.0), (3.0, "unid", 1350.0)]
    coded = textitems.generic_items(texts(spark, "84756382 PARACETAMOL 500MG 16COMP $2.490")).first()
    assert (coded.sku, coded.total_price) == ("84756382", 2490.0)


def test_stacked_products(spark):
    rows = {r.name: r for r in textitems.stacked_products(texts(spark, STACKED)).collect()}
    first = rows["Ben Agua Per"]
    assert (first.quantity, first.unit_price, first.total_price) == (2, 1000.0, 2000.0)
    assert rows["Mold Int 630"].barcode == "7803468005005"


def test_line_parser_counts(spark):
    row = textitems.product_lines(texts(spark, "2X1.000 BEN AGUA PER $ 2.000")).first()
    assert (row.quantity, row.unit_price, row.total_price) == (2.0, 1000.0, 2000.0)


@pytest.mark.parametrize(
    "text, value",
    [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("123,45", 123.45), ("1,234", 1234.0), ("-$ 12.5", -12.5), ("2,000,000", None), ("abc", None)],
)
def test_locale_amounts(spark, text, value):
    assert spark.range(1).select(locale_amount(F.lit(text))).first()[0] == value


@pytest.mark.parametrize("text, value", [("1.000", 1000.0), ("$ 12.345.678", 12345678.0), ("1.5", 1.5), ("1.2.3", 0.0), ("990", 990.0)])
def test_peso_prices(spark, text, value):
    assert spark.range(1).select(peso_price(F.lit(text))).first()[0] == value


def test_normalised_text(spark):
    import re

    raw = "Café  Ｎ°1\t¡Olé! ﬁn_1 50% $2.5-3"
    model = re.sub(r"[^\w\s\.\,\-\$\%]", " ", unicodedata.normalize("NFKD", raw).lower())
    got = textfields.normalised(texts(spark, raw)).first().plain_text
    assert got == re.sub(r"\s+", " ", model).strip()


def test_places_in_text(spark):
    row = textfields.place_mentions(texts(spark, "Jumbo Kennedy\nAv. Kennedy 9001, Las Condes\nFono +56 2 2345 6789 mall")).first()
    assert any("9001" in a for a in row.addresses)
    assert "+56223456789" in row.phones
    assert (row.brands, row.extraction_method) == (["jumbo"], "brand_and_address")


def test_vote_and_probabilities(spark):
    frame = texts(spark, "compra en lider y jumbo", "copec bencina 20 litros", "nada")
    counted = categorise.votes(frame)
    best = {r.receipt_id: r for r in categorise.vote_predictions(counted).collect()}
    assert (best[0].brand_category, round(best[0].brand_confidence, 2)) == ("Supermercado", 0.85)
    assert best[1].word_category == "Combustible"
    totals = categorise.vote_probabilities(counted).groupBy("receipt_id").agg(F.sum("probability").alias("p")).collect()
    assert all(r.p == pytest.approx(1.0) for r in totals)


def test_language_votes(spark):
    frame = spark.createDataFrame([(1, "fecha boleta precio lunes total"), (2, "Rechnung Datum Preis Menge"), (3, "итого сумма и ещё"), (4, "x")], "doc_id long, text string")
    got = {r.doc_id: r.language for r in language.detect(frame).collect()}
    assert got == {1: "spa", 2: "deu", 3: "ru", 4: "spa+eng"}


def test_matches_equal_brute_force(spark):
    names = ["c0ca cola", "pan hallul1a", "lech3 soprole", "martillo", "YOGUR natural", "arroz"]
    entries = [(key, e) for key, _, ns, ms in catalogue.PRODUCTS for e in ns + ms]
    brute = {}
    for name in names:
        score, key = max(((SequenceMatcher(None, name.lower(), e).ratio(), -i) for i, (_, e) in enumerate(entries)))
        brute[name] = (entries[-key][0], round(score, 9)) if score >= 0.6 else (None, 0.0)
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: (r.product, round(r.confidence, 9)) for r in catalogue.match_products(frame).collect()} == brute
    learned = spark.createDataFrame([("martillo", "Martillo Grande", "ferreteria")], "learned_name string, corrected_name string, category string")
    again = {r.name: r.corrected_name for r in catalogue.match_products(frame, learned=learned).collect()}
    assert again["martillo"] == "Martillo Grande"


def test_vendor_corrections(spark):
    frame = spark.createDataFrame([("C0PEC",), ("Jumbo Kenedy",), ("zzzz",)], "vendor string")
    got = {r.vendor: (r.corrected_name, r.method) for r in catalogue.correct_vendors(frame).collect()}
    assert got == {"C0PEC": ("Copec", "direct_ocr_correction"), "Jumbo Kenedy": ("Jumbo Kennedy", "fuzzy_matching"), "zzzz": (None, "none")}


def test_character_repair_only_improves(spark):
    frame = spark.createDataFrame([("c0ca c0la",), ("c0c4 c0l4",), ("pollo",), ("",), (None,)], "name string")
    got = {r.name: (r.repaired, r.is_repaired) for r in catalogue.repair_characters(frame).collect()}
    want = {"c0ca c0la": ("coca cola", True), "c0c4 c0l4": ("coca cola", True), "pollo": ("pollo", False), "": ("", False), None: (None, False)}
    assert got == want


def test_names_without_a_product_stay(spark):
    frame = spark.createDataFrame([("zzzzqqqq",), ("pollo",)], "name string")
    got = {r.name: (r.product, r.corrected_name, r.confidence, r.was_variation) for r in catalogue.match_products(frame).collect()}
    assert got == {"zzzzqqqq": (None, "zzzzqqqq", 0.0, False), "pollo": ("pollo", "pollo", 1.0, False)}


def test_price_range_by_size(spark):
    rows = [("arroz", 5000.0, "5kg"), ("arroz", 5000.0, "1kg"), ("arroz", 1000.0, "9kg"), ("arroz", 10000.0, None), ("zzzzqqqq", 1.0, "1kg")]
    frame = spark.createDataFrame(rows, "name string, price double, size string")
    got = [(r.price, r["size"], r.is_valid, r.suggested_price) for r in catalogue.price_check(frame, catalogue.match_products(frame.select("name"))).collect()]
    assert sorted(got, key=str) == sorted(
        [(5000.0, "5kg", True, None), (5000.0, "1kg", False, 1300.0), (1000.0, "9kg", True, None), (10000.0, None, False, 1000.0), (1.0, "1kg", True, None)], key=str
    )


@pytest.mark.parametrize(
    "language, text, date, method, confidence",
    [
        ("spa", "99/99/2024 y luego 05/03/2024", "2024-03-05", "numeric", 0.9),
        ("eng", "05/03/2024", "2024-05-03", "numeric", 0.9),
        ("spa", "05/13/2024", "2024-05-13", "numeric", 0.6),
        ("spa", "15-may-2024", "2024-05-15", "month_name", 0.85),
        ("spa", "septiembre 3, 2023", "2023-09-03", "month_name", 0.85),
        ("eng", "Date: December 24, 2023", "2023-12-24", "month_name", 0.85),
        ("por", "7 de fevereiro de 2024", "2024-02-07", "month_name", 0.85),
        ("spa", "2024 02 29", "2024-02-29", "spaced", 0.7),
        ("spa", "folio 20240131", "2024-01-31", "compact", 0.5),
        ("spa", "31/12/1999", None, "no_date_found", 0.0),
        ("spa", None, None, "no_date_found", 0.0),
    ],
)
def test_receipt_dates(spark, language, text, date, method, confidence):
    frame = spark.createDataFrame([(1, text)], "receipt_id long, text string")
    got = textfields.receipt_date(frame, "2024-06-01", language).first()
    assert (got.date and got.date.isoformat(), got.method, got.confidence) == (date, method, confidence)


def test_classifiers_beat_the_majority_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL")
    rows = docs.select("doc_id", "text", F.col("lang").alias("category")).na.fill("", ["text"])
    inside = categorise.in_training(F.col("doc_id"))
    train, test = rows.filter(inside), rows.filter(~inside).cache()
    majority = test.groupBy("category").count().agg(F.max("count")).first()[0] / test.count()
    half = categorise.in_training(F.col("doc_id"), 40)
    models = [categorise.train_classifier(train), categorise.retrain(train.filter(half), train.filter(~half))]
    for model in models:
        scored = categorise.classify(model, test).collect()
        right = sum(r.category == r.predicted_category for r in scored) / len(scored)
        assert right > majority + 0.3
        for r in scored:
            assert sum(r.probabilities.values()) == pytest.approx(1.0)
            assert r.confidence == max(r.probabilities.values())


def test_merged_items_follow_the_fold(spark):
    rows = [(1, 0, "Leche Entera", 1000.0, 0.5), (1, 1, "Leche Entera Larga Vida", 1200.0, 0.9), (1, 2, "Arroz", 800.0, 0.7), (1, 3, "Pan Molde", 800.0, 0.7)]
    frame = spark.createDataFrame(rows, "receipt_id long, pos int, description string, total_price double, confidence double")
    assert sorted(r.description for r in textitems.merged_items(frame).collect()) == ["Arroz", "Leche Entera Larga Vida", "Pan Molde"]


READING = "receipt_id long, engine string, weight double, vendor string, total_amount double, confidence double, date string"


def test_vendor_consensus_branches(spark):
    w = {"tesseract": 0.25, "easyocr": 0.6, "paddleocr": 0.15}
    cases = {
        1: [("tesseract", "Lider", 0.75), ("easyocr", "Jumbo", 0.5)],
        2: [("tesseract", "Lider", 0.6), ("easyocr", "LIDER", 0.5), ("paddleocr", "x", 0.7)],
        3: [("tesseract", "supermercado lider", 0.6), ("easyocr", "supermercado 1ider", 0.5), ("paddleocr", "x", 0.65)],
        4: [("tesseract", "aaa", 0.6), ("easyocr", "bbb", 0.5), ("paddleocr", "ccc", 0.65)],
        5: [("easyocr", "solo", 0.4)],
    }
    rows = [(k, e, w[e], v, 1.0, c, "") for k, cells in cases.items() for e, v, c in cells]
    got = {r.receipt_id: r for r in consensus.vendor_consensus(spark.createDataFrame(rows, READING)).collect()}
    assert [got[k].consensus_type for k in sorted(got)] == ["high_confidence_priority", "exact_match", "high_similarity", "weighted_confidence", "single_engine"]
    assert got[1].confidence == pytest.approx(0.825)
    assert got[2].confidence == pytest.approx((0.6 * 0.25 + 0.5 * 0.6) / 0.85 * 1.1)
    ratio = SequenceMatcher(None, "supermercado lider", "supermercado 1ider").ratio()
    assert got[3].confidence == pytest.approx((0.6 * 0.25 + 0.5 * 0.6) / 0.85 * (1 + ratio) / 2)
    assert (got[4].vendor, got[5].vendor) == ("bbb", "solo")


def test_amount_and_date_consensus(spark):
    rows = [
        (1, "tesseract", 0.25, "a", 100.0, 0.5, "2024-05-10"), (1, "easyocr", 0.6, "a", 102.0, 0.5, "10/05/2024"), (1, "paddleocr", 0.15, "a", 101.0, 0.5, "11/05/24"),
        (2, "tesseract", 0.25, "a", 100.0, 0.5, ""), (2, "easyocr", 0.6, "a", 110.0, 0.5, ""), (2, "paddleocr", 0.15, "a", 5000.0, 0.9, ""),
    ]
    frame = spark.createDataFrame(rows, READING)
    amounts = {r.receipt_id: (r.amount, r.consensus_type) for r in consensus.amount_consensus(frame).collect()}
    assert amounts == {1: (101.0, "weighted_average"), 2: (105.0, "conflict_resolved")}
    date = consensus.date_consensus(frame).first()
    assert (date.date, date.confidence) == ("10/05/2024", pytest.approx(0.6 * 2 / 3 + 0.4 * 0.5))


def test_item_consensus(spark):
    rows = [
        (1, "tesseract", 1, "Pan Molde", 1.0, 1000.0, 1000.0, 0.6), (1, "easyocr", 1, "PAN MOLDE", 1.0, 1010.0, 1010.0, 0.8),
        (1, "paddleocr", 1, "an Molde", 1.0, 1000.0, 1000.0, 0.5), (1, "tesseract", 2, "Leche", 2.0, 500.0, 1000.0, 0.6),
    ]
    schema = "receipt_id long, engine string, line int, product_name string, quantity double, unit_price double, line_total double, confidence double"
    got = sorted((r.sources, r.product_name) for r in consensus.item_consensus(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "Leche"), (3, "PAN MOLDE")]


def test_every_word_at_every_place_is_found(spark):
    rng = random.Random(6)
    words = ["gas", "gasolina", "gasolinera", "sol", "lina", "h&m", "a", "as", "casa & ideas", "asa", "metro", "tro", "i.v"]
    texts = ["".join(rng.choice(["gas", "olin", "era", "a", "s", "h&m", " ", "metr", "o", "cas", "& ideas", "x", "i.v", "ixv"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate([*texts, None])), "receipt_id long, text string")
    got = {r.receipt_id: r.found for r in frame.select("receipt_id", words_found(F.col("text"), words).alias("found")).collect()}
    for i, text in enumerate(texts):
        assert {b for w in got[i] for b in beginnings(w, words)} == {w for w in words if w in text}
    assert got[len(texts)] is None
    places = {r.receipt_id: r.place for r in frame.select("receipt_id", categorise.first_place(F.col("text"), words).alias("place")).collect()}
    assert [places[i] for i in range(len(texts))] == [next((n for n, w in enumerate(words) if w in t), None) for t in texts]


def test_words_within_texts_of_any_batch(spark):
    words = ["gas", "gasolina", "ñu", "a", "as", "h&m", "gas", "bip", "z"]
    numbers = [5, 3, 1, 0, 7, 3, 9, 2, 5]
    rng = random.Random(8)
    texts = ["".join(rng.choice(["gas", "olina", "ñ", "u", "a", "h&", "m", " ", "bi", "p", "z", "é"]) for _ in range(rng.randrange(14))) for _ in range(400)]
    texts += [None, "", "gas" * 100, None, "b", "ip"]
    frame = spark.createDataFrame(list(enumerate(texts)), "receipt_id long, text string").repartition(3)
    text = F.col("text")
    got = {r.receipt_id: (r.p, r.n) for r in frame.select("receipt_id", words_within(text, words).alias("p"), words_within(text, words, numbers, 40).alias("n")).collect()}
    for i, t in enumerate(texts):
        places = None if t is None else [k for k, w in enumerate(words) if w in t]
        assert got[i] == (places, None if t is None else sorted({numbers[k] for k in places}))


def test_brands_are_looked_for_without_a_pattern(spark, capsys):
    """A pattern tries every first letter at every place; all texts of a batch are searched together instead."""
    rows = spark.createDataFrame([(1, "LIDER gas"), (2, None), (3, "nada")], "receipt_id long, text string")
    for frame in (categorise.flags(rows), categorise.votes(rows)):
        frame.explain()
        assert "ArrowEvalPython" in capsys.readouterr().out
    assert [(r.receipt_id, r.known_brand) for r in categorise.flags(rows).sort("receipt_id").collect()] == [(1, "lider"), (2, None), (3, None)]


def physical(frame, capsys) -> str:
    capsys.readouterr()
    frame.explain()
    return capsys.readouterr().out


def test_stacked_patterns_are_searched_once(spark, capsys):
    """One search a pattern, not one for each of its groups; a text that cannot match is left out."""
    rows = texts(spark, STACKED, None, "", "12X5 nada", "7803468005005 MOLD", "PAN\n\nx")
    found = textitems.stacked_products(rows)
    assert physical(found, capsys).count("regexp_extract_all(") == 3
    assert {(r.receipt_id, r.name, r.quantity, r.total_price) for r in found.collect()} == {(0, "Ben Agua Per", 2, 2000.0), (0, "Mold Int 630", 1, 2890.0), (0, "890 Galletaobse", 1, 1000.0)}


def test_product_lines_are_parsed_by_columns(spark, capsys):
    """No line is parsed by an interpreted lambda; odd quantities, codes and prices stay as they were."""
    rows = texts(spark, "5,X ALGO 1.500", "12345678 LECHE  2 KG $ 1.990", "x 3und pan $5", "$ 990 $1.980", None, "TOTAL 5", "  Fecha 3", "ño-ñ 20\ta")
    found = textitems.product_lines(rows)
    assert "transform(array(" not in physical(found, capsys)
    got = {r.receipt_id: (r.barcode, r.quantity, r.name, r.unit_price, r.total_price) for r in found.collect()}
    assert got == {
        0: (None, 5.0, "5 X ALGO 1 500", 300.0, 1500.0),
        1: ("12345678", 2.0, "LECHE 2 KG", None, 1990.0),
        2: (None, 3.0, "X 3UND PAN", None, None),
        7: (None, 1.0, "ÑO Ñ 20 A", 20.0, 20.0),
    }


def test_payment_words_begin_with_a_letter(spark, capsys):
    rows = texts(spark, "pago con Tarjeta", "xcash", "cash", "CRÉDITO", "transferencia visa", None)
    found = textfields.payment(rows)
    assert "(?=[" in physical(found, capsys)
    assert [r.method for r in found.sort("receipt_id").collect()] == ["card", None, "cash", "credit", "card", None]


def test_city_of_a_long_word(spark):
    """A place inside a word is no start; trying all of them took the square of its length."""
    rows = texts(spark, "x" * 200_000, "1abc San  Juan-Los Andes 2")
    start = time.monotonic()
    assert [r.city for r in textfields.transaction(rows).sort("receipt_id").select("city").collect()] == [None, "abc San  Juan"]
    assert time.monotonic() - start < 15


def test_language_by_script_has_language_codes(spark):
    rows = ["Привет, как дела?", "こんにちは世界です日", "안녕하세요 반갑습니다", "مرحبا بكم جميعا", "สวัสดีครับทุกคน", "你好你好你好你好你好", "русский", "gracias por su compra 12", None]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.by_script for r in language.detect(frame).collect()}
    assert [got[i] for i in range(len(rows))] == ["rus", "chi_sim", "kor", "ara", "tha", "chi_sim", None, None, None]


def places(text):
    """Addresses, phones, brands, place words, confidence and method of one text, by plain loops."""
    low = text.lower().strip(" ")
    addresses, phones = set(), set()
    for pattern, _ in textfields.ADDRESSES:
        for match in re.finditer(pattern, low, re.ASCII):
            bits = [g.strip(" ") for g in match.groups() if g and g.strip(" ")]
            if len(bits) < 2:
                continue
            if re.fullmatch(r"[0-9]+", bits[1]):
                address = f"{bits[0]} {bits[1]}" + (f", {bits[2]}" if len(bits) > 2 else "")
            else:
                address = " ".join(bits)
            if re.search(r"[0-9]", address) and (re.search(r"\b(?:av|avenida|calle|pasaje|camino)\b", address) or 10 <= len(address) <= 100):
                addresses.add(address)
    for pattern in textfields.PHONES:
        for match in re.finditer(pattern, low, re.ASCII):
            phone = re.sub(r"[\s()\-]", "", match.group(0), flags=re.ASCII)
            if phone.startswith("56") and len(phone) == 11:
                phone = "+" + phone
            elif re.fullmatch(r"[2-9].{8}", phone):
                phone = "+56" + phone
            if re.fullmatch(r"\+56[2-9][0-9]{8}", phone):
                phones.add(phone)
    brands, words = ([w for w in known if w in low] for known in (textfields.PLACED_BRANDS, textfields.PLACE_WORDS + textfields.COMMUNES))
    part = lambda found, weight, full: min(len(found) / full, 1.0) * weight
    confidence = min(1.0, part(addresses, 0.4, 2) + part(brands, 0.3, 2) + part(phones, 0.2, 2) + part(words, 0.1, 3))
    method = "brand_and_address" if brands and addresses else "brand_matched" if brands else "address_extracted" if addresses else "phone_based" if phones else "keyword_based"
    return sorted(addresses), sorted(phones), brands, words, round(confidence, 9), method


def test_all_places_of_all_receipts(spark):
    texts = Tables(spark, "/root/testdata/sf0.001").receipt_texts
    got = {r.receipt_id: r for r in textfields.place_mentions(texts).collect()}
    for row in texts.select("receipt_id", "text").collect():
        r = got[row.receipt_id]
        assert (r.addresses, r.phones, r.brands, r.place_words, round(r.confidence, 9), r.extraction_method) == places(row.text)


def test_vendor_candidates_print_the_texts_twice_at_most(spark):
    from spendlake.plans.text import candidates

    plan = candidates(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[l_orderkey", plan)) == 2


def test_classifier_deals_a_single_split_to_all_tasks(spark):
    rows = spark.createDataFrame([(i, text, lang) for i in range(12) for text, lang in ((f"el precio de la casa {i}", "es"), (f"the price of a house {i}", "en"))], "doc_id long, text string, category string").coalesce(1)
    model = categorise.train_classifier(rows, features=50, iterations=20)
    scored = categorise.classify(model, rows)
    assert len(model.stages) == 7
    assert "Repartition" in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.filter("category = predicted_category").count() == 24


def test_vocabulary_is_that_of_counting_every_word_and_pair(spark):
    """Ties too are decided by the texts, not by how their rows meet; what a fit keeps goes with it."""
    rng, kept = random.Random(8), spark.sparkContext._jsc.getPersistentRDDs().size()
    for kinds, length, features in ((60, 12, 40), (9, 30, 50), (5, 1, 20)):
        texts = [" ".join(f"w{min(rng.randrange(kinds), rng.randrange(kinds))}" for _ in range(length)) for _ in range(60)]
        words = [text.split() for text in texts]
        counted = {(0, w): sum(x.count(w) for x in words) for w in {w for x in words for w in x}}
        for pair in (p for x in words for p in zip(x, x[1:])):
            counted[1, " ".join(pair)] = counted.get((1, " ".join(pair)), 0) + 1
        want = [term for (_, term), _ in sorted(counted.items(), key=lambda c: (-c[1], c[0]))][:features]
        assert categorise.vocabulary(spark.createDataFrame([(x,) for x in [*words, [], None]], "words array<string>"), features) == want
    rows = spark.createDataFrame([(text, "en" if i % 2 else "es") for i, text in enumerate([*texts, "", "x"])], "text string, category string")
    for parts in (1, 5):
        assert categorise.train_classifier(rows.repartition(parts), features, iterations=1).stages[4].vocabulary == want
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_no_filter_searches_the_layouts_again(spark):
    frame = textitems.generic_items(texts(spark, "LECHE ENTERA 2 kg $ 1.990 $ 3.980"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [step for step in plan if step.lstrip(" +-:").startswith("Filter") and "{3,40}" in step]
    assert [(r.description, r.quantity, r.unit) for r in frame.collect()] == [("Leche Entera", 2.0, "kg")]


def test_addresses_are_searched_by_whole_runs(spark):
    """Each address pattern is searched in a cheaper form, which finds what the pattern itself finds."""
    rng = random.Random(22)
    parts = ["los aromos", "ñuñoa", " ", "\n", " 12", "7", ",", ", ", "santiago", ".", "-", "é", "av. ", "n° ", "1234567", "\t", " 3,"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + ["a 1, b 2, c 3, d", "x 12,3 4, y", " 5, z", "b 5,\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for search, (pattern, _) in zip(textfields.SEARCHES, textfields.ADDRESSES):
        found = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (search, pattern)]
        assert frame.filter(~found[0].eqNullSafe(found[1])).collect() == []
