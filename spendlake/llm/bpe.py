"""Byte-pair encoding and decoding in batched numpy merge rounds.

The words of a batch that are not known yet lie one after another in a flat array
of symbols.  In each round every word's lowest-rank pair is found by binary search
over the sorted pair keys, and all its occurrences are merged, left to right; words
without a mergeable pair leave the array.  That equals merging one pair at a time,
because a pair that contains a merged symbol always ranks behind the merge that made
it; :class:`Vocabulary` checks this.

Implements the tokenizer files of the ``tokenizers`` format with: NFC, white space to
a blank, lower case; the word pattern below; byte-level symbols; an end-of-word
suffix; special tokens matched in the raw text.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm.common import documents

# White space, and the word pattern of the vocabulary file.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words remembered by a worker; the oldest go when there are more.
REMEMBERED = 150_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in plain}
    others = (b for b in range(256) if b not in symbols)
    symbols |= {b: chr(256 + i) for i, b in enumerate(others)}
    return [symbols[b] for b in range(256)]


class Vocabulary:
    """Symbols, merges in rank order and special tokens of one tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if steps[0]["pattern"]["Regex"] != PATTERN or model["dropout"] or model["byte_fallback"] or spec["decoder"]:
            raise ValueError("a tokenizer of another kind")
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max(*ids.values(), *self.special.values()) + 1)
        for name, i in {**ids, **self.special}.items():
            self.names[i] = name
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], dtype=np.int64)
        self.last = np.array([ids[s + suffix] for s in symbols], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        rank = np.arange(len(pairs))
        first = np.full(len(self.names), -1)
        first[made] = rank
        if len(np.unique(made)) < len(made) or (first[left] >= rank).any() or (first[right] >= rank).any():
            raise ValueError("merges out of order")
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], rank[order], made
        self.known: dict[str, tuple[str, int, str]] = {}

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of every (non-empty) word."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.made)
        while len(symbols):
            rank = np.full(len(symbols), none)
            keys = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = (self.keys[at] == keys) & (owner[:-1] == owner[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            wanted = np.repeat(best, counts)
            merge = np.flatnonzero((rank == wanted) & (rank < none))
            # of overlapping occurrences (a run of one symbol) every other one merges
            if len(merge):
                head = np.r_[True, np.diff(merge) > 1]
                place = np.arange(len(merge))
                since = place - place[head][np.cumsum(head) - 1]
                merge = merge[since % 2 == 0]
                symbols[merge] = self.made[rank[merge]]
            drop = np.zeros(len(symbols), dtype=bool)
            drop[merge + 1] = True
            ready = np.repeat(best == none, counts)
            if ready.any():
                done.append((owner[ready], symbols[ready]))
            stay = ~(drop | ready)
            symbols, owner = symbols[stay], owner[stay]
        owners, ids = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, dtype=np.int64) for k in (0, 1))
        order = np.argsort(owners, kind="stable")
        return np.split(ids[order], np.cumsum(np.bincount(owners, minlength=len(words)))[:-1]) if words else []

    def learn(self, words: list[str]) -> dict[str, tuple[str, int, str]]:
        """(ids in decimal joined by blanks, their number, names joined by blanks) of the words."""
        result = {}
        for first in range(0, len(words), 50_000):
            part = words[first : first + 50_000]
            for word, ids in zip(part, self.encode_words([w.encode() for w in part])):
                result[word] = (" ".join(map(str, ids.tolist())), len(ids), " ".join([self.names[i] for i in ids.tolist()]))
        return result

    def decode(self, ids: list[int]) -> str:
        """The names of the ids joined by blanks, as the file asks for no decoder; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if 0 <= i < len(self.names))

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens stand for themselves."""
        parts = [text]
        if any(s in text for s in self.special):
            parts = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)
        words: list[str] = []
        for part in parts:
            if part in self.special:
                words.append(part)
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part)
                part = BLANKS.sub(" ", part).replace("Σ", "σ").lower()  # letter by letter, so no final sigma
                words += WORDS.findall(part)
        return words

    def batch(self, texts: list[str | None]) -> tuple[list[list[str]], dict[str, tuple[str, int, str]]]:
        """Words of each text, and what is known of every word among them."""
        split = [self.split(t) if t else [] for t in texts]
        new = {w for words in split for w in words}.difference(self.known)
        for token in new & self.special.keys():
            self.known[token] = (str(self.special[token]), 1, token)
        learnt = self.learn(sorted(new - self.special.keys()))
        if len(self.known) + len(learnt) > REMEMBERED:
            known = {**self.known, **learnt}
            self.known = dict(list(learnt.items())[:REMEMBERED]) if len(learnt) > REMEMBERED // 2 else learnt
            return split, known
        self.known |= learnt
        return split, self.known


BLANKS = regex.compile(WHITE + "+")
WORDS = regex.compile(PATTERN.replace(r"\s", " "))
_LOADED: dict[str, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """One vocabulary for each worker, with the words it remembers."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(text)
    return _LOADED[key]


FULL = "id long, n_tokens long, ids array<int>, decoded string"
DIGEST = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Text characters that are worked on at once.
SLICE = 4_000_000


def _run(spec, digest: bool):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] if digest else [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string()]
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["id", "n_tokens", "ids", "decoded"]
    schema = pa.schema(list(zip(names, kinds)))

    def slices(texts: list) -> Iterator[tuple[int, int]]:
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size > SLICE:
                yield first, i + 1
                first, size = i + 1, 0
        if first < len(texts):
            yield first, len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(spec.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in slices(texts):
                out = []
                for key, words in zip(ids[first:last], (got := vocab.batch(texts[first:last]))[0]):
                    known = [got[1][w] for w in words]
                    codes = " ".join([k[0] for k in known])
                    decoded = " ".join([k[2] for k in known])
                    n = sum([k[1] for k in known])
                    if digest:
                        out.append((key, n, hashlib.sha256(codes.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                    else:
                        out.append((key, n, list(map(int, codes.split())), decoded))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], schema=schema)

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` and ``ids, decoded``, or with ``digest`` their SHA-256, of every whole text.

    ``path`` is a vocabulary file on the driver, which sends it to the workers
    once (its size is that of the file).  Null counts as empty: no ids and an
    empty decoded text.  Repeated rows give repeated results; a null id stays.
    """
    spark = docs.sparkSession
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(spec, digest), DIGEST if digest else FULL).withColumnRenamed("id", "doc_id")


def bpe_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Digests of the token ids and of the text decoded from them, for each document; nulls and repeats as in :func:`encode`, an empty table gives no rows."""
    return encode(docs, digest=True)


def op6_bpe_batched(spark: SparkSession, folder: str) -> DataFrame:
    """Encoding and decoding of all documents with the word BPE vocabulary."""
    return encode(documents(spark, folder), digest=True)
