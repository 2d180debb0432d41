"""Text column expressions: cleaning, number formats and first-match extraction."""

from __future__ import annotations

import re

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.functions.core import let

SPACES = r"(?U)\s+"
CONTROL = r"[\x00-\x1f\x7f-\x9f]"


def lines(text: Column, top: int | None = None) -> Column:
    """The lines of a text, or its first ``top`` ones, for which the rest is not split."""
    return F.split(text, "\n") if top is None else F.slice(F.split(text, "\n", top + 1), 1, top)


def clean(text: Column) -> Column:
    """TXT1: whitespace collapsed and control characters removed, line by line."""
    tidy = lambda line: F.trim(F.regexp_replace(F.regexp_replace(line, SPACES, " "), CONTROL, ""))
    return F.array_join(F.transform(lines(text), tidy), "\n")


@F.pandas_udf(T.StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition; Spark has no built-in for it."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))


def plain(text: Column) -> Column:
    """TXT1: lower case with symbols other than ``. , - $ %`` blanked and spaces collapsed."""
    kept = F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s.,\-$%]", " ")
    return F.trim(F.regexp_replace(kept, SPACES, " "))


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null; the text is searched once."""
    return let(F.regexp_extract(text, pattern, group), lambda found: F.when(found != "", found))


def first_of(text: Column, *patterns: str) -> Column:
    """The first group of the first pattern that matches."""
    return F.coalesce(*[first(text, p) for p in patterns])


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def undotted(number: Column) -> Column:
    """Digits with thousands dots as a double."""
    return F.replace(number, F.lit("."), F.lit("")).try_cast("double")


def locale_amount(text: Column, limit: float = 1_000_000) -> Column:
    """TXT2: an amount written ``1.234,56``, ``1,234.56``, ``123,45`` or ``1,234``; null beyond the limit."""
    kept = F.regexp_replace(text, r"[^\d.,\-]", "")
    negative = kept.startswith("-")
    body = F.when(negative, F.substr(kept, F.lit(2))).otherwise(kept)
    no_dots, no_commas = F.replace(body, F.lit("."), F.lit("")), F.replace(body, F.lit(","), F.lit(""))
    european = body.rlike(r"\..*,[^.]*$")
    decimal_comma = body.rlike(r"^[^,]*,[^,]{0,2}$")
    number = (
        F.when(body.contains(",") & body.contains("."), F.when(european, F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas))
        .when(body.contains(","), F.when(decimal_comma, F.replace(body, F.lit(","), F.lit("."))).otherwise(no_commas))
        .otherwise(body)
        .try_cast("double")
    )
    value = F.when(negative, -number).otherwise(number)
    return F.when(F.abs(value) <= limit, value)


def peso_price(text: Column) -> Column:
    """TXT3: a price whose dots part thousands (``1.000`` is a thousand); 0 where it cannot be read."""
    kept = F.regexp_replace(text, r"[^\d.]", "")
    thousands = kept.rlike(r"^\d+(\.\d{3}){1,2}$")
    number = F.when(thousands, F.replace(kept, F.lit("."), F.lit(""))).otherwise(kept).try_cast("double")
    return F.when(text.isNotNull(), F.coalesce(number, F.lit(0.0)))


def mean_of(*factors: Column) -> Column:
    """Mean of the factors that are not null; 0 without any."""
    count = sum((F.when(f.isNotNull(), 1).otherwise(0) for f in factors), F.lit(0))
    total = sum((F.coalesce(f, F.lit(0.0)) for f in factors), F.lit(0.0))
    return F.when(count > 0, total / count).otherwise(F.lit(0.0))


def is_upper(text: Column) -> Column:
    """Has letters, none of them lower case."""
    return (text == F.upper(text)) & (text != F.lower(text))


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def _trie_pattern(words: list[str]) -> str:
    """A pattern that matches the longest of ``words`` at a place, branching letter by letter."""
    ends = "" in words
    branches = []
    for letter in dict.fromkeys(w[0] for w in words if w):
        branches.append(re.escape(letter) + _trie_pattern([w[1:] for w in words if w and w[0] == letter]))
    if not branches:
        return ""
    body = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})"
    return f"{body}?" if ends else body


def words_found(text: Column, words: list[str]) -> Column:
    """The distinct longest words at every place of ``text`` as an array, overlapping ones included.

    All other words at a place are beginnings of the one found there, see
    :func:`beginnings`, so one pass over the text finds every word.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_trie_pattern(sorted(set(words)))}))"), 1))


#: Bytes of text that are searched for words at once.
PIECE = 4 << 20


def _pieces(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """First and last row of runs of at most ``size`` bytes; a longer text is a run of its own."""
    cuts, row = [], 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        cuts.append((row, end))
        row = end
    return cuts


def words_within(text: Column, words: list[str], numbers: list[int] | None = None, size: int = PIECE) -> Column:
    """The distinct ``numbers`` (places by default), in order, of those ``words`` that ``text`` contains; null for a null text.

    The texts of a batch are one run of bytes: a table of letter pairs rules out
    most places at once, and only what is left is compared with the words.
    """
    codes, numbers = [w.encode() for w in words], numbers or list(range(len(words)))
    known, starts = np.zeros(1 << 16, dtype=bool), {}
    for code, number in zip(codes, numbers):
        pairs = range(code[0], 1 << 16, 1 << 8) if len(code) == 1 else [code[0] | code[1] << 8]
        known[list(pairs)] = True
        for pair in pairs:
            starts.setdefault(pair, []).append((code, number))

    def piece(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of the words in the texts between ``offsets``."""
        data = np.append(data[offsets[0] : offsets[-1]], np.uint8(0))
        ends, cells = offsets[1:] - offsets[0], [np.zeros(0, dtype=np.int64)]
        pair = data[:-1] | data[1:].astype(np.uint16) << np.uint16(8)
        at = np.flatnonzero(known[pair])
        pair = pair[at]
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        firsts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(at) else at
        for first_at, last_at in zip(firsts, [*firsts[1:], len(at)]):
            own = at[first_at:last_at]
            for code, number in starts[int(pair[first_at])]:
                left = own[own <= len(data) - 1 - len(code)]
                for i in range(2, len(code)):
                    left = left[data[left + i] == code[i]]
                row = np.searchsorted(ends, left, "right")
                cells.append(row[left + len(code) <= ends[row]] << 16 | number)
        cells = np.unique(np.concatenate(cells))
        return cells >> 16, cells & 0xFFFF

    def run(texts: pa.Array) -> pa.Array:
        flat = texts.cast(pa.large_binary())
        offsets = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
        data = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)
        counts, found = [], []
        for begin, end in _pieces(offsets, size):
            rows, hits = piece(data, offsets[begin : end + 1])
            counts.append(np.bincount(rows, minlength=end - begin))
            found.append(hits)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts or [[]]))]).astype(np.int32)
        hits = np.concatenate(found or [[]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(hits), mask=texts.is_null())

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(text)


def whole_words(text: Column, words: list[str]) -> Column:
    """Every occurrence, in order, of one of ``words`` between single spaces or the ends of ``text``."""
    return F.regexp_extract_all(text, F.lit(f"(?<![^ ])({_trie_pattern(sorted(set(words)))})(?![^ ])"), 1)


def beginnings(word: str, words: list[str]) -> list[str]:
    """The words that ``word`` begins with, itself included, in their order."""
    return [w for w in words if word.startswith(w)]


def literal_map(entries: dict) -> Column:
    """A map of fixed strings to fixed values."""
    return F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for pair in entries.items() for x in pair])
