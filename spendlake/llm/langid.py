"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of words holds a Bloom filter for each language: bit ``l`` of a row is
that row of language ``l``'s filter, so ANDing the rows of an n-gram's hash
positions returns all languages that contain it at once.  Per document the bits
are counted for each language and corrected for that filter's false-positive rate;
the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlake.llm.common import documents, free_name, held_out

UNDETERMINED = "und"
#: Bits of the mask, thus languages at most.
MAX_LANGUAGES = 64
#: Leading bits of the id hash by which the learning sample is counted.
RANGE_BITS = 10
#: Folds by crc32 of the id; fold 1 of 3 is held out.
FOLD, FOLDS = 1, 3


@dataclass(frozen=True)
class Settings:
    """``per_language`` bounds the labelled documents that a language is learnt from.

    An n-gram enters a language's filter if its share there is ``min_share`` or
    more (so at most 1 / min_share of them do) and ``contrast`` times its share in
    the language where it is commonest or more.  ``log_rows`` and ``probes`` are
    the size of the filters and the hash positions of an n-gram.
    """

    per_language: int = 5000
    min_share: float = 2e-5
    contrast: float = 0.2
    log_rows: int = 20
    probes: int = 3


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    rates: np.ndarray
    settings: Settings


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """True for code points of letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams of lower-cased letters, a blank for anything else at a word's ends.

    Returns the packed n-grams, the place of each one's text, and for each text
    whether it holds a letter.  N-grams never reach across two words or texts.
    """
    padded = [f" {t.lower()} " if t else "  " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    sizes = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    starts = np.cumsum(sizes) - sizes
    has = np.add.reduceat(letter, starts) > 0 if len(texts) else np.zeros(0, dtype=bool)
    if len(codes) < 4:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), has
    inner = letter[1:-2] & letter[2:-1]
    at = np.flatnonzero(inner)
    c = np.where(letter, codes, 0x20).astype(np.uint64) & np.uint64(0xFFFF)
    key = c[at] << np.uint64(48) | c[at + 1] << np.uint64(32) | c[at + 2] << np.uint64(16) | c[at + 3]
    return key, np.searchsorted(starts, at, side="right") - 1, has


def positions(keys: np.ndarray, settings: Settings) -> list[np.ndarray]:
    """Hash positions of n-grams, one array for each probe."""
    with np.errstate(over="ignore"):
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        step = (h >> np.uint64(40)) | np.uint64(1)
        return [((h + np.uint64(i) * step) & np.uint64((1 << settings.log_rows) - 1)).astype(np.int64) for i in range(settings.probes)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by: dict[str, list] = {}
        for lang, text in zip(langs, texts):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            for first in range(0, len(own), 500):
                keys, n = np.unique(grams(own[first : first + 500])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of smallest id hash of every language.

    Counts by the hash's leading bits say which ranges hold them; only those rows
    are ranked, range by range, so a language with most rows is in no single task.
    """
    held = rows.withColumn("_range", F.shiftright(F.xxhash64("id"), 64 - RANGE_BITS))
    counts = held.groupBy("lang", "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("lang").orderBy("_range")) - F.col("_n")
    needed = counts.select("lang", "_range", (F.lit(n) - before).alias("_room")).filter("_room > 0")
    near = held.join(F.broadcast(needed), ["lang", "_range"])  # languages x ranges rows at most
    rank = F.row_number().over(Window.partitionBy("lang", "_range").orderBy(F.xxhash64("id"), "id"))
    return near.withColumn("_rank", rank).filter("_rank <= _room").select("lang", "id")


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Learn from the rows of ``docs`` that have a label.

    A language is learnt from the ``per_language`` documents of smallest id hash.
    At most 64 languages; more raise an error.  No labelled row gives a model
    without languages, which calls every text undetermined.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang")).filter("lang IS NOT NULL")
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chosen = _smallest(rows.select("lang", "id"), settings.per_language).select("lang", F.col("id").alias("_id")).distinct()
    sample = rows.join(F.broadcast(chosen.withColumnRenamed("lang", "_lang")), (F.col("lang") == F.col("_lang")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    top = F.max("share").over(Window.partitionBy("gram"))
    features = share.withColumn("_top", top).filter((F.col("share") >= settings.min_share) & (F.col("share") >= settings.contrast * F.col("_top")))
    place = {lang: i for i, lang in enumerate(languages)}
    table = np.zeros(1 << settings.log_rows, dtype=np.uint64)
    found = features.select("lang", "gram").toPandas()  # 1 / min_share rows a language at most
    for lang, own in found.groupby("lang"):
        for at in positions(own["gram"].to_numpy().view(np.uint64), settings):
            table[at] |= np.uint64(1 << place[lang])
    filled = np.array([((table >> np.uint64(i)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, table, filled**settings.probes, settings)


def corrected_counts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts x languages) counts of n-grams after correction; n-grams and presence of a letter by text."""
    keys, owner, has = grams(texts)
    n = np.bincount(owner, minlength=len(texts)).astype(np.float64)
    mask = np.full(len(keys), ~np.uint64(0), dtype=np.uint64)
    for at in positions(keys, model.settings):
        mask &= model.table[at]
    hits = np.zeros((len(texts), len(model.languages)))
    for i in range(len(model.languages)):
        hits[:, i] = np.bincount(owner[(mask >> np.uint64(i) & np.uint64(1)).astype(bool)], minlength=len(texts))
    return np.maximum(0.0, (hits - n[:, None] * model.rates) / (1 - model.rates)), n, has


def _predictor(shared):
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model: Model = shared.value
        for texts in series:
            texts, parts = texts.tolist(), []
            first, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size > 500_000 or i == len(texts) - 1:
                    parts.append(_decide(model, texts[first : i + 1]))
                    first, size = i + 1, 0
            yield pd.concat(parts) if parts else _decide(model, [])

    return F.pandas_udf(run, "lang_pred string, score double")


def _decide(model: Model, texts: list[str | None]) -> pd.DataFrame:
    if not model.languages or not texts:
        return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts)})
    counts, n, has = corrected_counts(model, texts)
    names = [model.languages[b] if h else UNDETERMINED for b, h in zip(counts.argmax(axis=1), has)]
    score = np.where(has, np.minimum(1.0, counts.max(axis=1) / np.maximum(n, 1)), 0.0)
    return pd.DataFrame({"lang_pred": names, "score": score})


def predict(docs: DataFrame, model: Model, text_col: str = "text", name: str = "_language") -> DataFrame:
    """``docs`` with a struct ``name`` of ``lang_pred`` and ``score``, from each whole text alone.

    ``score`` is the share of the text's n-grams that the language contains.  A
    null text or one without a letter is ``und`` with score 0; of equal counts
    the language first in order wins.  No row moves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 bytes times 2 ** log_rows
    return docs.withColumn(name, _predictor(shared)(F.col(text_col)))


def identified(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return predict(docs, fit(docs.filter(~held_out(FOLD, FOLDS)), settings))


#: Texts of whose n-grams no language knows this share are rejected by the stage.
KNOWN_SHARE = 0.1


def _lettered(texts: pd.Series) -> pd.Series:
    return pd.Series([any(map(str.isalpha, t or "")) for t in texts], dtype=bool)


def language_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a language; texts without letters, and those hardly any of whose n-grams a language knows, go.

    Where no n-gram could be learnt (no row outside the held-out fold has a label
    and a text with letters), only texts without letters go.  A null text has no
    letters; repeated rows share their lot, further columns come back unchanged,
    an empty table gives an empty one.
    """
    model = fit(docs.filter(~held_out(FOLD, FOLDS)))
    if not model.table.any():
        return docs.filter(F.pandas_udf(_lettered, "boolean")(F.col("text")))
    name = free_name(docs.columns, "_language")
    found = predict(docs, model, name=name)
    return found.filter((F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.score") >= KNOWN_SHARE)).select(*docs.columns)


def op1_bloom_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from the documents that are not held out.

    A null text, or one without a letter, is ``und`` with score 0.  Repeated rows
    have a row each, a null id counts as empty text for the fold; an empty table
    gives no rows.
    """
    rows = documents(spark, folder).select("doc_id", "text", "lang")
    return identified(rows).select("doc_id", held_out(FOLD, FOLDS).alias("held_out"), "_language.lang_pred", "_language.score")
