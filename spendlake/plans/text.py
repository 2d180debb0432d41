"""Queries TXT1 to TXT31.

Receipt texts are printed by Spark from orders and their lines, so the SQL side
either applies the same rule to the same text or knows the answer from the
tables.  Prose comes from ``documents``.
"""

from pyspark.sql import functions as F

from spendlake.functions.core import lookup
from spendlake.functions.text import locale_amount, peso_price, plain
from spendlake.operators import catalogue, categorise, language, textfields, textitems
from spendlake.plans.bindings import r
from spendlake.plans.registry import query
from spendlake.sources.canonical import dotted

SPACE = r"[\s\x0b\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
CLEAN = rf"""array_to_string(list_transform(string_split(text, chr(10)),
 lambda l: trim(regexp_replace(regexp_replace(l, '{SPACE}', ' ', 'g'), '[\x00-\x1f\x7f-\x9f]', '', 'g'), ' ')), chr(10))"""
PLAIN = rf"""trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s\x0b\x85\xa0.,\-$%]', ' ', 'g'), '{SPACE}', ' ', 'g'), ' ')"""


@query("txt1_clean_text", "", f"SELECT doc_id, {CLEAN} AS clean_text FROM documents")
def clean_text(t):
    return textfields.cleaned(t.documents).select("doc_id", "clean_text")


@query("txt1_plain_text", "", f"SELECT doc_id, {PLAIN} AS plain_text FROM documents")
def plain_text(t):
    return t.documents.select("doc_id", plain(F.col("text")).alias("plain_text"))


@query("txt1_normalised_text")
def normalised_text(t):
    return textfields.normalised(t.documents).select("doc_id", "plain_text")


def printed_amounts(t):
    """Line prices as printed in six locales."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    us = F.format_number(price, 2)
    style = F.col("l_orderkey") % 6
    text = (
        F.when(style == 0, us)
        .when(style == 1, F.translate(us, ",.", ".,"))
        .when(style == 2, F.replace(price.cast("string"), F.lit("."), F.lit(",")))
        .when(style == 3, F.format_number(F.floor(price), 0))
        .when(style == 4, F.concat(F.lit("-$ "), us))
        .otherwise((price * 100).cast("decimal(18,2)").cast("string"))
    )
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"))


@query("txt2_locale_amounts", "", f"""WITH p AS (SELECT *, cast(l_extendedprice AS decimal(18,2)) AS p, l_orderkey % 6 AS style FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('CASE style WHEN 3 THEN floor(p) WHEN 4 THEN -p WHEN 5 THEN CASE WHEN p * 100 <= 1000000 THEN p * 100 END ELSE p END')} AS amount FROM p""")
def locale_amounts(t):
    return printed_amounts(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", locale_amount(F.col("text")).alias("amount"))


@query("txt3_peso_prices", "", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('CASE WHEN l_orderkey % 2 = 0 THEN floor(l_extendedprice) * 37 ELSE floor(l_extendedprice) % 1000 END')} AS price
 FROM lineitem""")
def peso_prices(t):
    whole = F.floor("l_extendedprice")
    number = F.when(F.col("l_orderkey") % 2 == 0, whole * 37).otherwise(whole % 1000)
    text = F.concat(F.lit("$ "), dotted(number))
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", peso_price(text).alias("price"))


def receipts_and_prose(t):
    """Receipt texts and documents under one key."""
    prose = t.documents.select((F.col("doc_id") + 100_000_000).alias("receipt_id"), "text")
    return t.receipt_texts.select("receipt_id", "text").unionByName(prose)


BOTH = "texts AS (SELECT receipt_id, text FROM receipt_texts UNION ALL SELECT doc_id + 100000000, text FROM documents)"


def word_rows(words):
    rows = [(c, w) for c, ws in words.items() for w in ws]
    return ", ".join(f"({i}, '{c}', '{w}')" for i, (c, w) in enumerate(rows))


FLAGS = rf"""{BOTH}, brands(place, category, word) AS (VALUES {word_rows(categorise.CATEGORY_WORDS)}),
 hits AS (SELECT receipt_id, min(place) AS place FROM texts JOIN brands ON contains(lower(text), word) GROUP BY 1),
 flags AS (SELECT t.receipt_id, nullif(regexp_extract(text, '\b(\d{{1,2}}(?:\.\d{{3}}){{2}}-[\dkK])\b', 1), '') AS tax_id,
 CASE WHEN contains(regexp_extract(lower(text), '{categorise.DOCUMENT}', 1), 'factura') THEN 'factura'
  WHEN regexp_matches(lower(text), '{categorise.DOCUMENT}') THEN 'boleta' END AS document_type,
 regexp_matches(lower(text), '{categorise.VAT_MENTION}') AS vat_mentioned, word AS known_brand, category AS brand_category
 FROM texts t LEFT JOIN hits h ON t.receipt_id = h.receipt_id LEFT JOIN brands b ON h.place = b.place)"""


@query("txt4_flags", "receipt_texts", f"WITH {FLAGS} SELECT * FROM flags")
def flags(t):
    return categorise.flags(receipts_and_prose(t))


@query("txt5_rule_category", "receipt_texts", f"""WITH {FLAGS} SELECT receipt_id, coalesce(brand_category, 'Otros') AS rule_category,
 {r('CASE WHEN brand_category IS NULL THEN 0.3 ELSE 0.9 END')} AS rule_confidence FROM flags""")
def rule_category(t):
    return categorise.rule_category(categorise.flags(receipts_and_prose(t))).select("receipt_id", "rule_category", "rule_confidence")


VOTES = f"""{BOTH}, vb(place, category, word) AS (VALUES {word_rows(categorise.VOTE_BRANDS)}), vw(place, category, word) AS (VALUES {word_rows(categorise.VOTE_WORDS)}),
 v AS (SELECT receipt_id, category, 1 AS brand, 2 AS score FROM texts JOIN vb ON contains(lower(text), word) OR contains(lower(text), replace(word, ' ', ''))
 OR contains(lower(text), replace(word, '-', ' ')) UNION ALL SELECT receipt_id, category, 0, 1 FROM texts JOIN vw ON contains(lower(text), word)),
 counted AS (SELECT receipt_id, category, cast(sum(brand) AS bigint) AS brands, cast(sum(score) AS bigint) AS score FROM v GROUP BY ALL)"""
ORDER = "list_position(['Supermercado', 'Combustible', 'Retail', 'Farmacia', 'Restaurante', 'Transporte'], category)"
PREDICTED = f"""{VOTES}, pb AS (SELECT * FROM counted WHERE brands > 0 QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY brands DESC, {ORDER}) = 1),
 pk AS (SELECT *, sum(score) OVER (PARTITION BY receipt_id) AS whole FROM counted QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY score DESC, {ORDER}) = 1),
 predicted AS (SELECT pk.receipt_id, pb.category AS brand_category, least(0.95, 0.75 + pb.brands * 0.05)::double AS brand_confidence, pk.category AS word_category,
 least(0.7, 0.4 + pk.score::double / pk.whole::double * 0.3)::double AS word_confidence FROM pk LEFT JOIN pb ON pk.receipt_id = pb.receipt_id)"""


@query("txt6_votes", "receipt_texts", f"WITH {VOTES} SELECT * FROM counted")
def votes(t):
    return categorise.votes(receipts_and_prose(t))


@query("txt6_vote_predictions", "receipt_texts", f"""WITH {PREDICTED} SELECT receipt_id, brand_category, CASE WHEN brand_category IS NOT NULL THEN {r('brand_confidence')} END AS brand_confidence,
 word_category, {r('word_confidence')} AS word_confidence FROM predicted""")
def vote_predictions(t):
    return categorise.vote_predictions(categorise.votes(receipts_and_prose(t)))


@query("txt6_vote_probabilities", "receipt_texts", f"""WITH {VOTES}, b AS (SELECT *, sum(brands) OVER (PARTITION BY receipt_id) AS whole, count(*) OVER (PARTITION BY receipt_id) AS k
 FROM counted WHERE brands > 0) SELECT receipt_id, category, {r('brands::double / whole')} AS probability FROM b WHERE k > 1
 UNION ALL SELECT receipt_id, category, {r('0.9')} FROM b WHERE k = 1 UNION ALL SELECT receipt_id, 'Otros', {r('0.06')} FROM b WHERE k = 1
 UNION ALL SELECT receipt_id, CASE WHEN category = 'Supermercado' THEN 'Combustible' ELSE 'Supermercado' END, {r('0.04')} FROM b WHERE k = 1""")
def vote_probabilities(t):
    return categorise.vote_probabilities(categorise.votes(receipts_and_prose(t)))


MODEL = "CASE receipt_id % 3 WHEN 0 THEN 'Salud' WHEN 1 THEN 'Retail' ELSE 'Servicios' END AS model_category, (receipt_id % 100)::double / 100 AS model_confidence"


def with_model(rows):
    """A stand-in for model output: category and confidence by receipt."""
    k = F.col("receipt_id")
    return rows.withColumn("model_category", lookup(k % 3, {0: "Salud", 1: "Retail", 2: "Servicios"})).withColumn("model_confidence", (k % 100) / 100.0)


@query("txt7_cascade", "receipt_texts", f"""WITH {FLAGS}, p AS (SELECT receipt_id, coalesce(brand_category, 'Otros') AS rc, CASE WHEN brand_category IS NULL THEN 0.3 ELSE 0.9 END AS rf, {MODEL} FROM flags)
 SELECT receipt_id, CASE WHEN model_confidence >= 0.7 OR (rf < 0.7 AND model_confidence >= rf) THEN model_category ELSE rc END AS final_category,
 {r('CASE WHEN model_confidence >= 0.7 OR (rf < 0.7 AND model_confidence >= rf) THEN model_confidence ELSE rf END')} AS final_confidence,
 CASE WHEN model_confidence >= 0.7 THEN 'ml_prediction' WHEN rf >= 0.7 THEN 'rule_based' WHEN model_confidence >= rf THEN 'ml_prediction_low_confidence' ELSE 'rule_based_low_confidence' END AS method FROM p""")
def cascade(t):
    rows = with_model(categorise.rule_category(categorise.flags(receipts_and_prose(t))))
    return categorise.cascade(rows).select("receipt_id", "final_category", "final_confidence", "method")


@query("txt7_vote_cascade", "receipt_texts", f"""WITH {PREDICTED}, voted AS (SELECT receipt_id, brand_category, word_category, CASE WHEN brand_category IS NOT NULL THEN brand_confidence END AS brand_confidence,
 word_confidence FROM predicted), p AS (SELECT *, {MODEL} FROM (SELECT receipt_id FROM texts) LEFT JOIN voted USING (receipt_id)),
 m AS (SELECT *, CASE WHEN brand_confidence > 0.7 THEN 'brand_detection' WHEN word_confidence > 0.6 THEN 'keyword_analysis' WHEN model_confidence > 0.5 THEN 'ml_ensemble'
 WHEN word_confidence >= model_confidence THEN 'keyword_analysis' WHEN model_confidence > 0 THEN 'ml_ensemble' ELSE 'fallback' END AS method FROM p)
 SELECT receipt_id, method, CASE method WHEN 'brand_detection' THEN brand_category WHEN 'keyword_analysis' THEN word_category WHEN 'ml_ensemble' THEN model_category ELSE 'Otros' END AS final_category,
 {r("CASE method WHEN 'brand_detection' THEN brand_confidence WHEN 'keyword_analysis' THEN word_confidence WHEN 'ml_ensemble' THEN model_confidence ELSE 0.3 END")} AS final_confidence FROM m""")
def vote_cascade(t):
    """Every text has a row; those without a vote are left to the model or the fallback."""
    texts = receipts_and_prose(t)
    rows = with_model(texts.select("receipt_id").join(categorise.vote_predictions(categorise.votes(texts)), "receipt_id", "left"))
    return categorise.vote_cascade(rows).select("receipt_id", "final_category", "final_confidence", "method")


def labelled(t):
    """Documents with their language as the class to learn."""
    return t.documents.select("doc_id", "text", F.col("lang").alias("category"))


def shares(scored):
    """The probability of each class as a column of its own."""
    return [F.col("probabilities")[c].alias(f"probability_{c}") for c in ("de", "en", "es", "fr")]


@query("txt8_classifier")
def classifier(t):
    rows = labelled(t)
    model = categorise.train_classifier(rows.filter(categorise.in_training(F.col("doc_id"))))
    scored = categorise.classify(model, rows)
    return scored.select("doc_id", "category", "predicted_category", "confidence", *shares(scored), categorise.in_training(F.col("doc_id")).alias("in_training"))


@query("txt9_retrained_classifier")
def retrained_classifier(t):
    rows = labelled(t)
    feedback = t.labels.filter(F.col("quality") == 1).select("doc_id").join(rows, "doc_id")
    base = rows.filter(categorise.in_training(F.col("doc_id"), 50))
    scored = categorise.classify(categorise.retrain(base, feedback), rows)
    return scored.select("doc_id", "category", "predicted_category", "confidence", *shares(scored))


@query("txt10_header", "receipt_texts", rf"""SELECT receipt_id, string_split(text, chr(10))[1] AS vendor, {r('total')} AS total_amount,
 {r(r"replace(regexp_extract(upper(text), 'AFECTO.*?(\d{1,3}(?:\.\d{3})*)', 1), '.', '')::double")} AS subtotal,
 {r(r"replace(regexp_extract(upper(text), 'IVA.*?(\d{1,3}(?:\.\d{3})*)', 1), '.', '')::double")} AS vat_amount,
 lpad(receipt_id::varchar, 10, '0') AS folio, strftime(receipt_texts.date, '%Y-%m-%d') AS date, substring(string_split(text, chr(10))[2], 6) AS tax_id FROM receipt_texts""")
def header(t):
    return textfields.header(t.receipt_texts)


@query("txt11_transaction", "receipt_texts", rf"""SELECT receipt_id, {r('total')} AS total_amount, {r('total')} AS subtotal, {r('19')} AS vat_rate, {r('total * 19 // 119')} AS vat_amount, n AS total_items,
 ['EFECTIVO', 'DEBITO', 'CREDITO', NULL, 'TRANSFERENCIA'][receipt_id % 5 + 1] AS payment_method, {r('receipt_id % 7 * 100')} AS change_amount,
 {r('(0.95 + 0.9 + CASE WHEN receipt_id % 3 = 1 THEN 0.95 ELSE 0.85 END + 0.9 + 0.8 + CASE WHEN receipt_id % 5 = 3 THEN 0 ELSE 0.8 END) / CASE WHEN receipt_id % 5 = 3 THEN 5 ELSE 6 END')} AS transaction_confidence,
 string_split(text, chr(10))[1] AS store_name, substring(string_split(text, chr(10))[2], 6) AS tax_id, strftime(receipt_texts.date, '%Y-%m-%d') AS transaction_date,
 strftime(receipt_texts.date, '%H:%M:%S') AS transaction_time, lpad(receipt_id::varchar, 10, '0') AS receipt_number, substring(string_split(text, chr(10))[3], 6) AS address,
 nullif(trim(regexp_extract(text, '(?i)([A-Za-z\.]+(?:\s+[A-Za-z\.]+)*)-([A-Za-z\.]+(?:\s+[A-Za-z\.]+)*)', 1)), '') AS city,
 lpad((receipt_id % 90)::varchar, 4, '0') AS register,
 {r("CASE WHEN nullif(trim(regexp_extract(text, '(?i)([A-Za-z.]+(?:[ ]+[A-Za-z.]+)*)-([A-Za-z.]+)', 1)), '') IS NULL THEN (0.9 + 0.95 + 0.95 + 0.9 + 0.9 + 0.85 + 0.8) / 7 ELSE (0.9 + 0.95 + 0.95 + 0.9 + 0.9 + 0.85 + 0.8 + 0.8) / 8 END")} AS location_confidence FROM receipt_texts""")
def transaction(t):
    return textfields.transaction(t.receipt_texts)


LINES = r"""ls AS (SELECT receipt_id, cast(pos - 1 AS int) AS pos, l AS line FROM (SELECT receipt_id, string_split(text, chr(10)) AS a FROM receipt_texts), unnest(a) WITH ORDINALITY u(l, pos)),
 kept AS (SELECT * FROM ls WHERE regexp_matches(line, '\d') AND NOT regexp_matches(lower(trim(line)),
 '^(fecha|date|hora|time|rut|folio|bol|total|subtotal|iva|descuento|cambio|vuelt|caja|cajero|vendedor|cliente|gracias|muchas gracias|vuelva pronto)')),
 p AS (SELECT *, nullif(regexp_extract(line, '\b(\d{7,13})\b', 1), '') AS barcode,
 coalesce(try_cast(nullif(regexp_extract(line, '(\d+)[xX]', 1), '') AS double), try_cast(nullif(regexp_extract(line, '(?i)(\d+)\s*UND', 1), '') AS double),
  try_cast(nullif(regexp_extract(line, '(?i)(\d+)\s*KG', 1), '') AS double), try_cast(replace(nullif(regexp_extract(line, '(?i)(\d+,?\d*)\s*X', 1), ''), ',', '.') AS double), 1) AS quantity,
 list_sort(list_distinct(list_filter(list_transform(list_concat(list_concat(regexp_extract_all(line, '\$\s*(\d{1,3}(?:\.\d{3})*)', 1), regexp_extract_all(line, '\$\s*(\d+)', 1)),
  regexp_extract_all(line, '(\d{1,3}(?:\.\d{3})*)\s*\$?', 1)), lambda x: replace(x, '.', '')::double), lambda x: x BETWEEN 10 AND 1000000))) AS ps FROM kept),
 q AS (SELECT *, upper(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN barcode IS NULL THEN trim(line) ELSE trim(replace(trim(line), barcode, '')) END,
 '\$\s*\d+[,.]?\d*', '', 'g'), '^\d+[xX]\s*', ''), '[^a-zA-ZáéíóúÁÉÍÓÚñÑ0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS name,
 CASE WHEN len(ps) = 1 THEN ps[1] / quantity WHEN len(ps) = 2 THEN ps[1] END AS unit_price, CASE WHEN len(ps) >= 1 THEN ps[len(ps)] END AS total_price FROM p),
 items AS (SELECT receipt_id, pos, trim(line) AS raw_line, barcode, quantity, name, unit_price, total_price, least(1.0, 0.3 + CASE WHEN barcode IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN length(name) > 2 THEN 0.2 ELSE 0 END
 + CASE WHEN unit_price > 0 AND abs(quantity * unit_price - total_price) / total_price < 0.1 AND (quantity * unit_price - total_price) / total_price < 0.1 THEN 0.2 ELSE 0 END)::double AS confidence
 FROM q WHERE name <> '' OR barcode IS NOT NULL)"""
ITEM_OUT = f"receipt_id, pos, barcode, {r('quantity')} AS quantity, name, {r('unit_price')} AS unit_price, {r('total_price')} AS total_price, {r('confidence')} AS confidence"
ITEM_COLUMNS = ["receipt_id", "pos", "barcode", "quantity", "name", "unit_price", "total_price", "confidence"]


@query("txt12_product_lines", "receipt_texts", f"WITH {LINES} SELECT {ITEM_OUT} FROM items")
def product_lines(t):
    return textitems.product_lines(t.receipt_texts).select(ITEM_COLUMNS)


STACK = r"""raw AS (SELECT receipt_id, 1 AS kind, regexp_extract_all(text, '(?i)(\d+)X(\d{1,3}(?:\.\d{3})*)\s*\n\s*([A-Z\s\d]+?)\s*\n\s*\$\s*(\d{1,3}(?:\.\d{3})*)') AS m FROM receipt_texts
 UNION ALL SELECT receipt_id, 2, regexp_extract_all(text, '(?i)(\d{13})\s+([A-Z\s\d]+?)\s*\n\s*\$\s*(\d{1,3}(?:\.\d{3})*)') FROM receipt_texts
 UNION ALL SELECT receipt_id, 3, regexp_extract_all(text, '(?i)([A-Z\s\d]{5,30})\s*\n\s*\n\s*(\d{1,3}(?:\.\d{3})*)') FROM receipt_texts),
 one AS (SELECT receipt_id, kind, pos, s FROM raw, unnest(m) WITH ORDINALITY u(s, pos)),
 f AS (SELECT *, CASE kind WHEN 1 THEN regexp_extract(s, '(?i)^(\d+)X(\d{1,3}(?:\.\d{3})*)\s*\n\s*([A-Z\s\d]+?)\s*\n\s*\$\s*(\d{1,3}(?:\.\d{3})*)', 3)
 WHEN 2 THEN regexp_extract(s, '(?i)^(\d{13})\s+([A-Z\s\d]+?)\s*\n\s*\$\s*', 2) ELSE regexp_extract(s, '(?i)^([A-Z\s\d]{5,30})\s*\n\s*\n\s*(\d{1,3}(?:\.\d{3})*)', 1) END AS raw_name,
 replace(regexp_extract(s, '(\d{1,3}(?:\.\d{3})*)$', 1), '.', '')::double AS price FROM one),
 g AS (SELECT *, upper(trim(regexp_replace(regexp_replace(raw_name, '^\d{13}\s*', ''), '\s+', ' ', 'g'))) AS name FROM f),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY receipt_id, name ORDER BY kind, pos) AS rn FROM g WHERE length(name) > CASE WHEN kind = 3 THEN 3 ELSE 2 END)"""


@query("txt13_stacked_products", "receipt_texts", rf"""WITH {STACK} SELECT receipt_id, name, cast(CASE WHEN kind = 1 THEN regexp_extract(s, '^(\d+)', 1)::int WHEN kind = 3 AND price < 100 THEN price ELSE 1 END AS bigint) AS quantity,
 {r("CASE kind WHEN 1 THEN replace(regexp_extract(s, '(?i)^[0-9]+X([0-9]{1,3}(?:[.][0-9]{3})*)', 1), '.', '')::double WHEN 3 THEN CASE WHEN price < 100 THEN 0 ELSE price END ELSE price END")} AS unit_price,
 {r('CASE WHEN kind = 3 AND price < 100 THEN 0 ELSE price END')} AS total_price, {r('CASE kind WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 ELSE CASE WHEN price < 100 THEN 0.7 ELSE 0.8 END END')} AS confidence,
 CASE WHEN kind = 2 THEN left(s, 13) END AS barcode FROM ranked WHERE rn = 1""")
def stacked_products(t):
    rows = textitems.stacked_products(t.receipt_texts)
    return rows.select("receipt_id", F.upper("name").alias("name"), "quantity", "unit_price", "total_price", "confidence", "barcode")


@query("txt14_generic_items")
def generic_items(t):
    return textitems.generic_items(t.receipt_texts)


@query("txt15_distinct_products", "receipt_texts", f"""WITH {LINES} SELECT {ITEM_OUT} FROM items
 QUALIFY row_number() OVER (PARTITION BY receipt_id, upper(trim(name)), coalesce(barcode, ''), coalesce(total_price, 0) ORDER BY confidence DESC, pos) = 1""")
def distinct_products(t):
    return textitems.distinct_products(textitems.product_lines(t.receipt_texts)).select(ITEM_COLUMNS)


@query("txt15_merged_items")
def merged_items(t):
    items = textitems.product_lines(t.receipt_texts).withColumnRenamed("name", "description")
    return textitems.merged_items(items)


@query("txt16_repaired_items", "receipt_texts", f"""WITH {LINES}, g AS (SELECT receipt_id, pos, CASE WHEN pos % 5 = 0 THEN 0 ELSE quantity END AS quantity, CASE WHEN pos % 4 = 1 THEN NULL ELSE unit_price END AS unit_price,
 CASE WHEN pos % 4 = 2 THEN 0 ELSE total_price END AS total_price FROM items), h AS (SELECT *, CASE WHEN quantity <= 0 THEN 1 ELSE quantity END AS qty FROM g),
 u AS (SELECT *, CASE WHEN coalesce(unit_price, 0) = 0 AND coalesce(total_price, 0) <> 0 THEN total_price / qty ELSE unit_price END AS unit2 FROM h)
 SELECT receipt_id, pos, {r('qty')} AS quantity, {r('unit2')} AS unit_price, {r('CASE WHEN coalesce(total_price, 0) = 0 AND coalesce(unit2, 0) <> 0 THEN unit2 * qty ELSE total_price END')} AS total_price FROM u""")
def repaired_items(t):
    p = F.col("pos")
    damaged = textitems.product_lines(t.receipt_texts).select(
        "receipt_id",
        "pos",
        "name",
        "barcode",
        F.when(p % 5 == 0, 0.0).otherwise(F.col("quantity")).alias("quantity"),
        F.when(p % 4 != 1, F.col("unit_price")).alias("unit_price"),
        F.when(p % 4 == 2, 0.0).otherwise(F.col("total_price")).alias("total_price"),
    )
    return textitems.repaired_items(damaged).select("receipt_id", "pos", "quantity", "unit_price", "total_price")


def parsed(t):
    """Header, transaction and item figures of every receipt text, with gaps by receipt."""
    k = F.col("receipt_id")
    head, pay = textfields.header(t.receipt_texts), textfields.transaction(t.receipt_texts)
    rows = head.join(pay.select("receipt_id", "payment_method", "address", "transaction_confidence", "location_confidence"), "receipt_id")
    return rows.select(
        "receipt_id",
        F.when(k % 7 != 0, F.col("vendor")).alias("vendor"),
        "total_amount",
        F.when(k % 4 != 0, F.col("date")).alias("date"),
        "subtotal",
        "vat_amount",
        "folio",
        "payment_method",
        F.when(k % 3 != 0, F.col("address")).alias("address"),
        (k % 5).alias("items"),
        (k % 2 == 0).alias("needs_reconciliation"),
        ((k % 10) / 10.0).alias("products_confidence"),
        ((k % 9) / 10.0).alias("transaction_confidence"),
        ((k % 8) / 10.0).alias("location_confidence"),
    )


@query("txt17_parse_confidence", "receipt_texts", f"""SELECT receipt_id, {r('''least(1.0, CASE WHEN receipt_id % 7 <> 0 THEN 0.15 ELSE 0 END + 0.2 + CASE WHEN receipt_id % 4 <> 0 THEN 0.1 ELSE 0 END
 + CASE WHEN receipt_id % 5 > 0 THEN 0.25 ELSE 0 END + least((receipt_id % 5) * 0.05, 0.15) + CASE WHEN receipt_id % 2 = 0 THEN 0 ELSE 0.15 END)''')} AS structured_confidence,
 {r('round_even(((receipt_id % 10) * 0.04::double + (receipt_id % 9) * 0.04::double + (receipt_id % 8) * 0.02::double) * 100, 2) / 100')} AS weighted_confidence,
 {r('''least(1.0, 0.3 + CASE WHEN receipt_id % 7 <> 0 THEN 0.15 ELSE 0 END + 0.2 + CASE WHEN receipt_id % 4 <> 0 THEN 0.1 ELSE 0 END + CASE WHEN receipt_id % 5 > 0 THEN 0.15 ELSE 0 END + 0.05
 + CASE WHEN receipt_id % 5 = 3 THEN 0 ELSE 0.05 END + 0.1 + CASE WHEN receipt_id % 3 <> 0 THEN 0.05 ELSE 0 END)''')} AS general_confidence FROM receipt_texts""")
def parse_confidence(t):
    return textfields.parse_confidence(parsed(t))


def amounts(t):
    """Total, subtotal, tax and discount of each text, some of them misread."""
    k = F.col("receipt_id")
    rows = textfields.header(t.receipt_texts)
    return rows.select(
        "receipt_id",
        F.when(k % 6 == 0, F.col("total_amount") * 2).when(k % 6 == 1, F.col("subtotal") / 2).otherwise(F.col("total_amount")).alias("total"),
        "subtotal",
        (F.col("total_amount") - F.col("subtotal")).alias("tax"),
        F.when(k % 6 == 2, F.col("subtotal") * 2).alias("discount"),
        F.lit(0.9).alias("total_confidence"),
        F.lit(0.8).alias("subtotal_confidence"),
        F.lit(0.7).alias("discount_confidence"),
    )


@query("txt18_amount_consistency", "receipt_texts", f"""WITH a AS (SELECT receipt_id, total AS t, total - total * 19 // 119 AS s FROM receipt_texts),
 b AS (SELECT receipt_id, CASE receipt_id % 6 WHEN 0 THEN t * 2 WHEN 1 THEN s / 2 ELSE t END AS total, s, t - s AS tax, CASE WHEN receipt_id % 6 = 2 THEN s * 2 ELSE 0 END AS d FROM a),
 c AS (SELECT *, abs(total - (s + tax - d)) / abs(total) > 0.05 AS off FROM b)
 SELECT receipt_id, NOT off AS is_consistent, {r('0.9 * CASE WHEN off THEN 0.8 ELSE 1 END')} AS total_confidence,
 {r('0.8 * CASE WHEN off THEN 0.8 ELSE 1 END * CASE WHEN s > total THEN 0.5 ELSE 1 END')} AS subtotal_confidence, {r('0.7 * CASE WHEN d > s THEN 0.5 ELSE 1 END')} AS discount_confidence FROM c""")
def amount_consistency(t):
    return textfields.amount_consistency(amounts(t))


@query("txt19_payment", "receipt_texts", """SELECT receipt_id, ['cash', NULL, NULL, 'card', 'transfer'][receipt_id % 5 + 1] AS method,
 CASE WHEN receipt_id % 5 = 3 THEN '4321' END AS card_last_digits, CASE WHEN receipt_id % 5 = 3 THEN '998877' END AS authorization_code,
 coalesce(nullif(regexp_extract(text, '(?i)(?:recibo|receipt|factura|invoice|ticket)[\\s#:]*(\\w+)', 1), ''), nullif(regexp_extract(text, '(?i)(?:no|num|number|número)[\\s#:]*(\\w+)', 1), '')) AS receipt_number
 FROM receipt_texts""")
def payment(t):
    return textfields.payment(t.receipt_texts)


def dated(t):
    """Receipt dates printed in six forms."""
    style, day = F.col("o_orderkey") % 6, F.col("o_orderdate").cast("timestamp")
    months = list(textfields.MONTHS)
    month = F.element_at(F.array(*[F.lit(m) for m in months]), F.month(day))
    text = (
        F.when(style == 0, F.date_format(day, "'Fecha' dd/MM/yyyy"))
        .when(style == 1, F.date_format(day, "'emitida' yyyy-MM-dd"))
        .when(style == 2, F.date_format(day, "dd-MM-yy"))
        .when(style == 3, F.concat(F.dayofmonth(day).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(day).cast("string")))
        .when(style == 4, F.date_format(day, "dd MM yyyy"))
        .otherwise(F.lit("sin fecha"))
    )
    return t.raw("orders").select(F.col("o_orderkey").alias("receipt_id"), text.alias("text"))


@query("txt20_receipt_dates", "", f"""SELECT o_orderkey AS receipt_id, CASE WHEN ok THEN strftime(o_orderdate, '%Y-%m-%d') WHEN turned THEN strftime(swapped, '%Y-%m-%d') END AS date,
 CASE WHEN NOT ok AND NOT turned THEN 'no_date_found' WHEN o_orderkey % 6 < 3 THEN 'numeric' WHEN o_orderkey % 6 = 3 THEN 'month_name' ELSE 'spaced' END AS method,
 {r('CASE WHEN NOT ok AND NOT turned THEN 0 WHEN turned AND o_orderkey % 6 < 3 THEN 0.6 WHEN turned THEN 0.47 WHEN o_orderkey % 6 < 3 THEN 0.9 WHEN o_orderkey % 6 = 3 THEN 0.85 ELSE 0.7 END')} AS confidence
 FROM (SELECT *, NOT ok AND o_orderkey % 6 IN (0, 2, 4) AND coalesce(swapped BETWEEN date '2005-06-01' - 3650 AND date '2005-06-02', false) AS turned
 FROM (SELECT *, o_orderkey % 6 < 5 AND o_orderdate BETWEEN date '2005-06-01' - 3650 AND date '2005-06-02' AS ok,
 CASE WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END AS swapped FROM orders))""")
def receipt_dates(t):
    return textfields.receipt_date(dated(t), "2005-06-01")


SCORE = r"""greatest(0.0, least(1.0, CASE WHEN length(l) < 3 THEN -1 ELSE CASE WHEN length(l) BETWEEN 5 AND 40 THEN 0.3 WHEN length(l) BETWEEN 3 AND 50 THEN 0.1 ELSE 0 END
 + CASE WHEN l = upper(l) AND l <> lower(l) THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(l, '\d') THEN 0 ELSE 0.15 END + CASE WHEN regexp_matches(l, '[$€£¥₹]') THEN 0 ELSE 0.1 END
 + CASE WHEN regexp_matches(lower(l), 'store|shop|market|restaurant|cafe|company|tienda|restaurante|café|empresa|comercial|loja') THEN 0.1 ELSE 0 END
 - CASE WHEN regexp_matches(lower(l), 'total|subtotal|tax|iva|receipt|recibo|date|fecha|time|hora|thank|gracias') THEN 0.2 ELSE 0 END END))"""


@query("txt21_vendor_lines", "receipt_texts", f"""WITH ls AS (SELECT receipt_id, cast(pos - 1 AS int) AS pos, trim(l) AS l FROM (SELECT receipt_id, string_split(text, chr(10))[1:5] AS a FROM receipt_texts),
 unnest(a) WITH ORDINALITY u(l, pos)) SELECT receipt_id, pos, l AS line, {r(SCORE)} AS score FROM ls""")
def vendor_lines(t):
    return textfields.vendor_lines(t.receipt_texts)


def candidates(t):
    """Vendor candidates of three strategies; the third one is a different reading for every third receipt."""
    first_line = textfields.header(t.receipt_texts).select("receipt_id", F.col("vendor").alias("value"), F.lit(0.6).alias("confidence"))
    scored = textfields.vendor_lines(t.receipt_texts).groupBy("receipt_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("_p"), "line")).alias("_b"))
    best_line = scored.select("receipt_id", F.col("_b.line").alias("value"), F.col("_b.score").alias("confidence"))
    k = F.col("receipt_id")
    other = F.when(k % 3 == 0, F.lower("value")).otherwise(F.lit("TIENDA"))
    # both strategies of one pass over the texts
    cells = F.array(F.when(k % 4 != 0, F.struct("value", "confidence")), F.struct(other.alias("value"), ((k % 10) / 10.0).alias("confidence")))
    headed = first_line.select("receipt_id", F.explode(F.array_compact(cells)).alias("_c")).select("receipt_id", "_c.value", "_c.confidence")
    return headed.unionByName(best_line.filter(k % 5 != 0))


@query("txt21_vendor_vote", "receipt_texts", f"""WITH v AS (SELECT receipt_id, string_split(text, chr(10))[1] AS vendor, CASE WHEN receipt_id % 5 = 4 THEN 0.85 ELSE 0.75 END::double AS s FROM receipt_texts),
 c AS (SELECT receipt_id, vendor AS value, 0.6::double AS conf FROM v WHERE receipt_id % 4 <> 0 UNION ALL SELECT receipt_id, vendor, s FROM v WHERE receipt_id % 5 <> 0
 UNION ALL SELECT receipt_id, CASE WHEN receipt_id % 3 = 0 THEN lower(vendor) ELSE 'TIENDA' END, (receipt_id % 10)::double / 10 FROM v),
 ok AS (SELECT * FROM c WHERE conf > 0.2 AND value <> ''), g AS (SELECT receipt_id, lower(value) AS lv, count(*) AS n, max((conf, value)) AS b FROM ok GROUP BY ALL),
 w AS (SELECT receipt_id, max(CASE WHEN n > 1 THEN (n, b) END) AS a, max(b) AS b FROM g GROUP BY 1)
 SELECT receipt_id, CASE WHEN a IS NOT NULL THEN a[2][2] ELSE b[2] END AS vendor, {r('CASE WHEN a IS NOT NULL THEN least(0.9, a[2][1] + 0.1) ELSE b[1] END')} AS confidence,
 CASE WHEN a IS NOT NULL THEN 'combined_consensus' ELSE 'combined_best' END AS method FROM w""")
def vendor_vote(t):
    return textfields.vendor_vote(candidates(t))


@query("txt22_place_mentions", "receipt_texts", r"""SELECT receipt_id, '+562' || '2' || lpad((receipt_id % 1000)::varchar, 3, '0') || lpad((receipt_id * 3 % 10000)::varchar, 4, '0') AS main_phone,
 array_to_string(list_filter(['jumbo', 'lider', 'santa isabel', 'copec', 'shell', 'petrobras', 'cruz verde', 'salcobrand', 'ahumada', 'falabella', 'ripley', 'mcdonalds', 'burger king', 'subway'],
 lambda b: contains(lower(text), b)), '|') AS brands, CASE WHEN receipt_id % 4 = 0 THEN 'los aromos ' ELSE 'providencia ' END || (receipt_id % 900 + 100) || ', santiago' AS main_address FROM receipt_texts""")
def place_mentions(t):
    rows = textfields.place_mentions(t.receipt_texts)
    k = F.col("receipt_id")
    street = F.when(k % 4 == 0, "los aromos ").otherwise("providencia ")
    expected = F.concat(street, (k % 900 + 100).cast("string"), F.lit(", santiago"))
    phone = F.filter("phones", lambda p: p.startswith("+5622"))
    # The address and phone that were printed must be among those found.
    return rows.select(
        "receipt_id",
        F.get(F.filter("addresses", lambda a: a == expected), F.lit(0)).alias("main_address"),
        F.get(F.filter(phone, lambda p: p.endswith(F.lpad((k * 3 % 10000).cast("string"), 4, "0"))), F.lit(0)).alias("main_phone"),
        "brands",
    )


@query("txt22_prose_places")
def prose_places(t):
    return textfields.place_mentions(t.documents, "doc_id")


def language_rows():
    rows = [(i, lang, w) for i, (lang, ws) in enumerate(language.LANGUAGE_WORDS.items()) for w in ws]
    return ", ".join(f"({i}, '{lang}', '{w}')" for i, lang, w in rows)


WORDS = rf"""lw(place, lang, word) AS (VALUES {language_rows()}),
 tok AS (SELECT doc_id, unnest(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '\d+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\x0b\x85\xa0]', ' ', 'g'), '{SPACE}', ' ', 'g'), ' ')), ' ')) AS w FROM documents),
 counts AS (SELECT doc_id, place, lang, count(*) AS n FROM tok JOIN lw ON w = word GROUP BY ALL)"""


@query("txt23_language_votes", "", f"""WITH {WORDS} SELECT d.doc_id, {', '.join(f"coalesce(max(n) FILTER (c.lang = '{x}'), 0) AS {x}" for x in language.LANGUAGE_WORDS)}
 FROM documents d LEFT JOIN counts c ON d.doc_id = c.doc_id GROUP BY d.doc_id""")
def language_votes(t):
    return language.word_votes(t.documents)


@query("txt23_language", "", rf"""WITH {WORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) AS rn, max(n) OVER (PARTITION BY doc_id) AS top FROM counts),
 b AS (SELECT doc_id, string_agg(lang, '+' ORDER BY rn) AS lang FROM k WHERE top >= 2 AND n >= top * 0.7 AND rn <= 2 GROUP BY 1),
 s AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]') THEN 'chi_sim' WHEN regexp_matches(text, '[\x{{3040}}-\x{{30ff}}]') THEN 'jpn' WHEN regexp_matches(text, '[\x{{ac00}}-\x{{d7af}}]') THEN 'kor'
 WHEN regexp_matches(text, '[\x{{0620}}-\x{{064a}}]') THEN 'ara' WHEN regexp_matches(text, '[\x{{0400}}-\x{{0481}}\x{{048a}}-\x{{04ff}}]') THEN 'rus' WHEN regexp_matches(text, '[\x{{0e01}}-\x{{0e30}}]') THEN 'tha' END AS script FROM documents WHERE length(trim(text)) >= 10)
 SELECT d.doc_id, b.lang AS by_words, s.script AS by_script, coalesce(b.lang, s.script, 'spa+eng') AS language FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN s ON d.doc_id = s.doc_id""")
def detected_language(t):
    return language.detect(t.documents).select("doc_id", "by_words", "by_script", "language")


@query("txt24_product_matches")
def product_matches(t):
    return catalogue.match_products(t.noisy_names)


def noisy_vendors(t):
    """Vendor names as read: known misreadings, spellings with noise, and unknown names."""
    spellings = list(catalogue.VENDOR_MISREADINGS) + catalogue.VENDORS
    k = F.col("o_orderkey")
    base = F.element_at(F.array(*[F.lit(v) for v in spellings]), (k % len(spellings) + 1).cast("int"))
    noisy = F.when(k % 4 == 0, F.upper(base)).when(k % 4 == 1, F.translate(base, "e", "3")).when(k % 4 == 2, F.concat(base, F.lit(" "), (k % 50).cast("string"))).otherwise(base)
    return t.raw("orders").select(noisy.alias("vendor"))


@query("txt25_vendor_corrections")
def vendor_corrections(t):
    return catalogue.correct_vendors(noisy_vendors(t))


@query("txt26_character_repairs")
def character_repairs(t):
    return catalogue.repair_characters(t.noisy_names)


@query("txt27_price_check")
def price_check(t):
    sizes = F.array(*[F.lit(z) for z in ("350ml", "500ml", "1L", "1kg", "5kg", "kg", "unidad")])
    size = F.element_at(sizes, (F.col("p_size") % 7 + 1).cast("int"))
    sized = t.raw("part").select(F.col("p_partkey").alias("sku"), size.alias("size"))
    return catalogue.price_check(t.noisy_names.join(sized, "sku"), catalogue.match_products(t.noisy_names))


def declared_lines(t):
    """Product lines with a stated unit price: exact, slightly off or far off."""
    k = F.col("l_orderkey") % 4
    exact = F.col("l_extendedprice") / F.col("l_quantity")
    unit = F.when(k == 0, exact).when(k == 1, exact * 1.02).when(k == 2, exact * 1.08).otherwise(exact * 1.5)
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("receipt_id"),
        (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("pos"),
        F.col("l_quantity").alias("quantity"),
        unit.alias("unit_price"),
        F.col("l_extendedprice").alias("total_price"),
        (1 - F.col("l_discount")).alias("confidence"),
    )


DRIFT = "CASE l_orderkey % 4 WHEN 0 THEN 1.0::double WHEN 1 THEN 1.02::double WHEN 2 THEN 1.08::double ELSE 1.5::double END"
CHECKED = f"""e AS (SELECT l_orderkey AS receipt_id, l_linenumber * 100000 + l_partkey AS pos, l_extendedprice AS t, l_extendedprice * {DRIFT} AS x, 1 - l_discount AS conf FROM lineitem),
 checked AS (SELECT *, abs(x - t) > 0.1 AS off, abs(x - t) > 0.1 AND abs(x - t) / greatest(x, t) < 0.05 AS fixed FROM e)"""


@query("txt28_line_consistency", "", f"""WITH {CHECKED} SELECT receipt_id, pos, {r('CASE WHEN fixed THEN x ELSE t END')} AS total_price, {r('x')} AS expected_total, NOT off AS is_consistent, fixed AS is_corrected FROM checked""")
def line_consistency(t):
    return textitems.line_consistency(declared_lines(t))


@query("txt28_consistency_report", "", f"""WITH {CHECKED} SELECT receipt_id, NOT bool_or(off) AS consistent, coalesce(string_agg(pos::varchar, '|' ORDER BY pos) FILTER (off), '') AS issues, count(*) FILTER (fixed) AS corrections_applied
 FROM checked GROUP BY 1""")
def consistency_report(t):
    return textitems.consistency_report(textitems.line_consistency(declared_lines(t)))


@query("txt29_product_category", "noisy_names", """SELECT sku, CASE WHEN regexp_matches(lower(name), 'leche|yogurt|queso|mantequilla') THEN 'lacteos' WHEN regexp_matches(lower(name), 'coca|pepsi|sprite|jugo|agua') THEN 'bebidas'
 WHEN regexp_matches(lower(name), 'pan|hallulla|marraqueta') THEN 'panaderia' WHEN regexp_matches(lower(name), 'pollo|carne|vacuno|cerdo') THEN 'carnes'
 WHEN regexp_matches(lower(name), 'tomate|palta|platano|manzana') THEN 'frutas_verduras' ELSE 'abarrotes' END AS category FROM noisy_names""")
def product_category(t):
    return t.noisy_names.select("sku", categorise.product_category(F.col("name")).alias("category"))


@query("txt30_extraction_quality", "", f"""WITH {CHECKED}, g AS (SELECT receipt_id, count(*) AS n, avg(conf) AS c, NOT bool_or(off) AS good, count(*) FILTER (fixed) AS k FROM checked GROUP BY 1),
 s AS (SELECT *, least(1.0, c + CASE WHEN good THEN 0.1 ELSE 0 END + least(k * n * 0.02, 0.1)) AS f FROM g)
 SELECT receipt_id, n AS lines_count, {r('c')} AS avg_item_confidence, {r('f')} AS confidence,
 CASE WHEN f >= 0.95 - 1e-12 THEN 'excellent' WHEN f >= 0.85 - 1e-12 THEN 'good' WHEN f >= 0.70 - 1e-12 THEN 'fair' ELSE 'poor' END AS extraction_quality FROM s""")
def extraction_quality(t):
    items = declared_lines(t)
    return textitems.extraction_quality(items, textitems.consistency_report(textitems.line_consistency(items)))


def discounted(t):
    """Items with original prices and discounts, and receipts with gaps in their totals."""
    items = t.raw("lineitem").select(
        F.col("l_orderkey").alias("receipt_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("total_price"),
        F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_extendedprice") * 2).cast("decimal(18,2)")).alias("original_price"),
        F.when(F.col("l_linenumber") % 2 == 1, F.lit(100)).alias("discount_amount"),
        (F.col("l_linenumber") != 7).alias("is_valid"),
    )
    k = F.col("receipt_id")
    receipts = t.receipts.select(
        "receipt_id",
        F.when(k % 9 != 0, F.col("company_name")).alias("merchant"),
        F.when(k % 4 == 0, F.col("total_amount")).alias("subtotal"),
        F.when(k % 3 == 0, F.col("total_amount")).alias("total_amount"),
        F.lit(500).alias("tax_amount"),
        F.lit(None).cast("int").alias("tip_amount"),
        F.lit(50).alias("discount_amount"),
    )
    return items, receipts


@query("txt31_receipt_totals", "receipts", f"""WITH i AS (SELECT l_orderkey, sum(cast(l_extendedprice AS decimal(18,2)))::double AS s, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE 100 END) AS saved,
 sum(l_quantity) AS q, count(*) AS n, count(*) FILTER (l_linenumber = 7) AS bad FROM lineitem GROUP BY 1),
 j AS (SELECT receipt_id, CASE WHEN receipt_id % 9 <> 0 THEN company_name END AS merchant, coalesce(CASE WHEN receipt_id % 4 = 0 THEN total_amount END::double, s) AS sub,
 coalesce(CASE WHEN receipt_id % 3 = 0 THEN total_amount END::double, s + 450) AS tot, coalesce(saved, 0) + 50 AS saved, s / q AS u, coalesce(n, 0) AS n, bad
 FROM receipts LEFT JOIN i ON l_orderkey = receipt_id)
 SELECT receipt_id, n AS item_count, {r('sub')} AS subtotal, {r('tot')} AS total_amount, {r('saved')} AS total_savings, {r('coalesce(u, 0)')} AS effective_unit_price,
 array_to_string(list_filter([CASE WHEN merchant IS NULL AND coalesce(tot, 0) = 0 THEN 'Recibo sin información básica (comerciante o total)' END,
 CASE WHEN sub > tot THEN 'Subtotal no puede ser mayor que el total' END, CASE WHEN bad > 0 THEN 'Ítems no válidos' END], lambda x: x IS NOT NULL), '|') AS errors FROM j""")
def receipt_totals(t):
    items, receipts = discounted(t)
    return textitems.receipt_totals(items, receipts)
