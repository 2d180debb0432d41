"""Language-model scoring by a subword lattice.

The pieces of an existing vocabulary span a lattice over each word: every way to
write the word as pieces is a path, weighted by the pieces' unigram probabilities.
A forward recursion in log space sums all paths, which gives the marginal
probability of the word; a document's probability is the product over its words
and an end.  The vocabulary file orders its pieces by rank only, so ranks give the
starting scores and expected counts over the distinct training words
(forward-backward over the same lattice) re-estimate them.  The lattice of a word
seen in training has one more edge, the whole word as a piece of its own with its
discounted relative frequency; what the discount leaves over is the weight of all
other paths, so that the model sums to one and unseen words are spelled out.

Words are counted once for the corpus.  A task turns a chunk of documents into
word numbers and sends each distinct word of the chunk once; counts and marginals
come back to the chunk, where documents are summed.  Nothing whole is gathered:
only the piece scores (a vocabulary's worth) reach the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm.common import chunks, documents, held_out, id_back, id_key, materialise

#: Fold by crc32 of the id; fold 1 of 5 is held out.
FOLD, FOLDS = 1, 5
#: Bytes of text that share one list of distinct words.
CHUNK_BYTES = 16 << 20
#: Expected count that every piece has besides those from the corpus.
FLOOR = 0.1
#: Bytes of words whose lattices are built at once.
LATTICE_BYTES = 200_000


def vocabulary_pieces(path: str | None = None) -> list[bytes]:
    """Distinct pieces of a sentencepiece file in rank order, as UTF-8; the 256 single bytes are among them."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        name = model.id_to_piece(i)
        piece = bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.encode()
        # byte pieces stand first in the file but rank behind all others
        pieces.setdefault(piece, (model.is_byte(i), -model.get_score(i)))
    return sorted(pieces, key=lambda p: (pieces[p], p))


@dataclass
class Trie:
    """The pieces by length: sorted transitions ``state * 256 + byte`` and the piece that ends there, or -1."""

    keys: list[np.ndarray]
    piece: list[np.ndarray]

    @classmethod
    def of(cls, pieces: list[bytes]) -> Trie:
        states: dict[bytes, int] = {b"": 0}
        keys, ends = [], []
        place = {p: i for i, p in enumerate(pieces)}
        for length in range(1, max(map(len, pieces)) + 1):
            prefixes = {p[:length] for p in pieces if len(p) >= length}
            ordered = sorted((states[p[:-1]] * 256 + p[-1], p) for p in prefixes)
            states = {p: i for i, (_, p) in enumerate(ordered)}
            keys.append(np.array([k for k, _ in ordered], dtype=np.int64))
            ends.append(np.array([place.get(p, -1) for _, p in ordered], dtype=np.int64))
        return cls(keys, ends)

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Node of each word's start, and start node, end node and piece of every edge; a word of n bytes has n + 1 nodes."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first = np.cumsum(lengths + 1) - lengths - 1
        raw = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8).astype(np.int64)
        ends = np.repeat(first + lengths, lengths + 1)
        at = np.flatnonzero(np.arange(len(raw)) < ends)
        state = np.zeros(len(at), dtype=np.int64)
        starts, stops, pieces = [], [], []
        for length, (keys, piece) in enumerate(zip(self.keys, self.piece), 1):
            inside = at + length <= ends[at]
            at, state = at[inside], state[inside]
            key = state * 256 + raw[at + length - 1]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            at, state = at[hit], place[hit]
            whole = piece[state] >= 0
            starts.append(at[whole])
            stops.append(at[whole] + length)
            pieces.append(piece[state[whole]])
            if not len(at):
                break
        return first, np.concatenate(starts), np.concatenate(stops), np.concatenate(pieces)


def _recursion(nodes: int, depth: np.ndarray, from_: np.ndarray, to: np.ndarray, weight: np.ndarray, known: np.ndarray) -> np.ndarray:
    """log sum over all paths into each node; nodes in ``known`` start with 0, layers are taken in order of ``depth[to]``."""
    total = np.full(nodes, -np.inf)
    total[known] = 0.0
    order = np.lexsort((to, depth[to]))
    from_, to, weight = from_[order], to[order], weight[order]
    level = depth[to]
    bounds = np.flatnonzero(np.r_[True, level[1:] != level[:-1], True]) if len(level) else np.zeros(1, dtype=np.int64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        target = to[a:b]
        heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        total[target[heads]] = np.logaddexp.reduceat(total[from_[a:b]] + weight[a:b], heads)
    return total


def forward(trie: Trie, scores: np.ndarray, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of each word's marginal probability; with ``counts`` also the expected count of every piece."""
    if not words:
        return np.zeros(0), None if counts is None else np.zeros(len(scores))
    first, from_, to, piece = trie.edges(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    nodes = int(first[-1] + lengths[-1] + 1)
    depth = np.arange(nodes) - np.repeat(first, lengths + 1)
    last = first + lengths
    ahead = _recursion(nodes, depth, from_, to, scores[piece], first)
    marginal = ahead[last]
    if counts is None:
        return marginal, None
    behind = _recursion(nodes, np.repeat(lengths, lengths + 1) - depth, to, from_, scores[piece], last)
    owner = np.repeat(np.arange(len(words)), lengths + 1)[from_]
    share = np.exp(ahead[from_] + scores[piece] + behind[to] - marginal[owner])
    return marginal, np.bincount(piece, weights=share * counts[owner], minlength=len(scores))


WORD_START = "▁".encode()


def _portions(words: list[bytes]) -> Iterator[np.ndarray]:
    """Places of words of similar length, few bytes at a time; a very long word comes alone."""
    order = np.argsort(np.fromiter(map(len, words), dtype=np.int64, count=len(words)), kind="stable")
    sizes = np.cumsum(np.array([len(words[i]) + 4 for i in order.tolist()]))
    first = 0
    while first < len(order):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + LATTICE_BYTES, side="right")))
        yield order[first:last]
        first = last


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as word numbers of their chunk, and the chunk's distinct words with their training counts."""
    squeeze = zstandard.ZstdCompressor(level=1)
    names = ["chunk", "id", "held", "n", "payload", "idx", "word", "seen"]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for table in chunks(batches, "text", CHUNK_BYTES):
        chunk, numbers, out = uuid.uuid4().hex, {}, []
        seen = np.zeros(1024, dtype=np.int64)
        for key, held, text in zip(*(table.column(c).to_pylist() for c in ("id", "held", "text"))):
            own = [numbers.setdefault(w, len(numbers)) for w in text.lower().split()]  # bytes: ASCII only
            idx, times = np.unique(np.array(own, dtype=np.int32), return_counts=True)
            if len(numbers) > len(seen):
                seen = np.r_[seen, np.zeros(max(len(seen), len(numbers)), dtype=np.int64)]
            if not held:
                seen[idx] += times
            out.append((chunk, key, held, len(own), squeeze.compress(np.diff(idx, prepend=np.int32(0)).tobytes() + times.astype(np.int32).tobytes()), None, None, None))
        yield batch(out)
        words = list(numbers)
        for a in range(0, len(words), 50_000):
            part = words[a : a + 50_000]
            none = [None] * len(part)
            yield batch(list(zip([chunk] * len(part), none, none, none, none, range(a, a + len(part)), part, seen[a : a + len(part)].tolist())))


def _expected(shared, scores: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = shared.value, np.zeros(len(scores))
        for batch in batches:
            words = [WORD_START + w for w in batch.column(0).to_pylist()]
            counts = np.ones(len(words))  # spelling serves new words, so each known one counts once
            for portion in _portions(words):
                total += forward(trie, scores, [words[i] for i in portion.tolist()], counts[portion])[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "n"])

    return run


def _marginals(shared, scores: np.ndarray, total: int, discount: float, spelled: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            words = [WORD_START + w for w in batch.column(0).to_pylist()]
            found = np.zeros(len(words))
            for portion in _portions(words):
                found[portion] = forward(trie, scores, [words[i] for i in portion.tolist()])[0]
            whole = np.maximum(batch.column(1).to_numpy() - discount, 0.0) / max(total, 1)
            with np.errstate(divide="ignore"):
                found = np.logaddexp(found + log(spelled), np.log(whole))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found / log(10))], names=["word", "c", "marginal"])

    return run


def _scored(train_tokens: int, vocabulary: int, ends: int, end_score: float):
    def run(key, docs: pa.Table, words: pa.Table) -> pa.Table:
        loosen = zstandard.ZstdDecompressor()
        idx = words.column("idx").to_numpy()
        count, marginal = np.zeros(len(idx)), np.zeros(len(idx))
        count[idx] = words.column("c").to_numpy()
        marginal[idx] = words.column("marginal").to_numpy()
        width = np.log10(train_tokens + 0.5 * (vocabulary + 1))
        base = np.log10(count + 0.5) - width
        end_base = np.log10(ends + 0.5) - width
        out = []
        for i, held, n, payload in zip(*(docs.column(c).to_pylist() for c in ("id", "held", "n", "payload"))):
            body = np.frombuffer(loosen.decompress(payload), dtype=np.int32)
            own, times = np.cumsum(body[: len(body) // 2]), body[len(body) // 2 :]
            known = int(times[count[own] > 0].sum()) + (ends > 0)
            out.append((i, held, n + 1, known, float(times @ base[own]) + end_base, float(times @ marginal[own]) + end_score))
        frame = pd.DataFrame(out, columns=["id", "held", "n_tokens", "n_known", "base_score", "score"])
        return pa.Table.from_pandas(frame, preserve_index=False)

    return run


def score(docs: DataFrame, path: str | None = None, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Trained on the rows outside the held-out fold; null texts are empty and have
    the end as their only token.  ``rounds`` re-estimate the pieces.  Without
    training rows all counts are 0 and the pieces keep the scores of their ranks.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(id_key(id_col).alias("id"), held_out(FOLD, FOLDS, id_col).alias("held"), text.alias("text"))
    parts = materialise(rows.mapInArrow(_split, "chunk string, id long, held boolean, n long, payload binary, idx int, word binary, seen long"), "lattice-parts")
    words = parts.filter("word IS NOT NULL").select("chunk", "idx", "word", "seen")
    texts = parts.filter("payload IS NOT NULL").select("chunk", "id", "held", "n", "payload")
    counts = materialise(words.groupBy("word").agg(F.sum("seen").alias("c")), "word-counts")
    sums = counts.filter("c > 0").agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    ends = texts.filter("NOT held").count()
    total, kinds = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    discount = (sums[2] or 0.5) / ((sums[2] or 0.5) + 2 * (sums[3] or 0.5))
    spelled = discount * sums[1] / total if sums[1] else 0.5
    end_score = np.log10(ends / total) if ends else np.log10(0.5)

    pieces = vocabulary_pieces(path)
    shared = spark.sparkContext.broadcast(Trie.of(pieces))
    weights = 1.0 / np.arange(1, len(pieces) + 1)
    scores = np.log(weights / weights.sum())
    for _ in range(rounds if sums[1] else 0):
        found = counts.filter("c > 0").select("word").mapInArrow(_expected(shared, scores), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # a row for each piece at most
        expected = np.full(len(pieces), FLOOR)
        expected[found["piece"].to_numpy()] += found["n"].to_numpy()
        scores = np.log(expected / expected.sum())
    known = counts.mapInArrow(_marginals(shared, scores, total, discount, spelled), "word binary, c long, marginal double")
    back = words.select("chunk", "idx", "word").join(known, "word").select(F.col("chunk").alias("of"), "idx", "c", "marginal")
    done = texts.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(
        _scored(total, kinds, ends, float(end_score)), "id long, held boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return done.select(id_back(F.col("id")).alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lattice_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every document, beside the word-count base."""
    return score(documents(spark, folder))
