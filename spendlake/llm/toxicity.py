"""Toxicity: misspelled lexicon terms by Levenshtein automata, quotation told from abuse by context.

The lexicon is learnt from labelled documents: terms, each also the stem of longer
words, whose share of a document's words is far higher in toxic ones.  The terms form a
trie; the automata of all terms, each up to the edits that its length allows, are
intersected with the trie and made deterministic as words are read, so a word costs one
look-up a character and most words leave the automaton after a few of them.

Every hit is weighed by its window: quote marks on both sides and words that go with
quoted use lower it.  Numbers and shares of a document's hits go into a logistic model:
terms that clean documents don't use, their misspellings, and terms that they use now
and then.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm.common import documents, held_out, id_back, id_key, materialise

#: Marks that can open or close a quotation; fixed values.
QUOTES = "\"'“”„‟‘’‚‛«»‹›「」『』"
#: Marks that are taken off both ends of a word; fixed values.
EDGES = QUOTES + ".,;:!?()[]{}<>*_-–—…¡¿/\\|&%$#@+=~^`"


@dataclass(frozen=True)
class Settings:
    """Bounds and thresholds of the fit; scoring has none."""

    #: Labelled documents that the model learns from, a random sample where there are more.
    sample: int = 12_000
    #: Candidate terms that the driver holds counts of.
    candidates: int = 20_000
    #: Lengths of stems.
    shortest: int = 4
    longest: int = 12
    #: Toxic documents of the sample that have to hold a term: a share, and at least so many.
    support: float = 0.01
    least: int = 3
    #: How often as high the share of a term is in toxic documents.
    ratio: float = 12.0
    #: Share of the clean documents that may hold a strong term, or a misspelling of it.
    clean: float = 0.002
    #: Words on each side of a hit that are its context.
    window: int = 4
    #: What a hit between quote marks counts.
    quoted: float = 0.2
    #: Model before any label is seen: constant; number of strong hits, of misspelled ones, share of both; number and share of weak hits.
    prior: tuple = (-3.0, 3.0, 2.0, 1.0, 0.5, 0.5)
    #: Weight of that prior.
    ridge: float = 1.0
    threshold: float = 0.3


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Speller:
    """Trie of the lexicon, intersected with the Levenshtein automata of its terms.

    A state is the set of (trie node, edits) that the characters read so far can
    lead to, each node with its fewest edits.  States and steps are kept as they are
    met; beyond ``limit`` steps the automaton starts afresh, with the same answers.
    """

    def __init__(self, terms: list[str], limit: int = 500_000):
        self.limit = limit
        self.children: list[dict[str, int]] = [{}]
        self.reach, self.term, self.allowed = [0], [-1], [0]
        for at, term in enumerate(terms):
            node, allowed = 0, edits_allowed(term)
            self.reach[0] = max(self.reach[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                    self.term.append(-1)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], allowed)
            self.term[node], self.allowed[node] = at, allowed
        self._fresh()

    def _fresh(self) -> None:
        start = self._closed({0: 0})
        self.states, self.numbers = [start], {start: 0}
        self.accepts = [self._accept(start)]
        self.steps: list[dict[str, int]] = [{}]
        self.size = 0

    def _closed(self, found: dict[int, int]) -> tuple:
        """With the nodes that skipped characters of a term lead to."""
        todo = list(found)
        while todo:
            node = todo.pop()
            edits = found[node] + 1
            for child in self.children[node].values():
                if edits <= self.reach[child] and edits < found.get(child, 99):
                    found[child] = edits
                    todo.append(child)
        return tuple(sorted(found.items()))

    def _accept(self, state: tuple) -> tuple[int, int] | None:
        """Nearest term and its edits; of equally near terms the first."""
        ends = [(edits, self.term[node]) for node, edits in state if self.term[node] >= 0 and edits <= self.allowed[node]]
        return min(ends)[::-1] if ends else None

    def _step(self, state: int, c: str) -> int:
        """Number of the next state, -1 where no term can be reached any more."""
        found: dict[int, int] = {}
        for node, edits in self.states[state]:
            for letter, child in self.children[node].items():
                cost = edits + (letter != c)
                if cost <= self.reach[child] and cost < found.get(child, 99):
                    found[child] = cost
            if edits < self.reach[node] and edits + 1 < found.get(node, 99):
                found[node] = edits + 1
        if not found:
            return -1
        new = self._closed(found)
        at = self.numbers.setdefault(new, len(self.states))
        if at == len(self.states):
            self.states.append(new)
            self.accepts.append(self._accept(new))
            self.steps.append({})
        return at

    def find(self, word: str) -> tuple[int, int] | None:
        """(place of the nearest term, edits) if one is near enough."""
        if self.size > self.limit:
            self._fresh()
        state, steps = 0, self.steps
        for c in word:
            following = steps[state].get(c)
            if following is None:
                following = steps[state][c] = self._step(state, c)
                self.size += 1
            if following < 0:
                return None
            state = following
        return self.accepts[state]


STRONG, WRONG, WEAK = range(3)


@dataclass
class Model:
    #: Terms that clean documents don't use; and those that they do now and then, whose misspellings say nothing.
    strong: list[str] = field(default_factory=list)
    weak: list[str] = field(default_factory=list)
    #: Strong terms of which misspellings count.
    spelt: list[str] = field(default_factory=list)
    #: Spellings that clean documents use, which are no misspellings.
    innocent: frozenset = frozenset()
    #: Log-odds of toxic against clean by context word, where negative.
    context: dict[str, float] = field(default_factory=dict)
    weights: tuple = Settings.prior
    settings: Settings = Settings()


def bare(word: str) -> str:
    return word.strip(EDGES)


def stems(word: str, settings: Settings) -> list[str]:
    """The word's beginnings, itself included, of the lengths that terms have."""
    return [word[:n] for n in range(settings.shortest, min(len(word), settings.longest) + 1)]


#: A hit: place in the text, kind, spelling, place of the term and window of raw words.
Hit = tuple[int, int, str, int, list[str]]


class Finder:
    """Hits of one model in texts."""

    def __init__(self, model: Model):
        self.model, self.speller = model, Speller(model.spelt)
        self.terms = {t: (kind, at) for kind, terms in ((WEAK, model.weak), (STRONG, model.strong)) for at, t in enumerate(terms)}
        self.cache: dict[str, tuple[int, str, int] | None] = {}

    def known(self, raw: str) -> tuple[int, str, int] | None:
        """Kind, spelling and term of a word: by its shortest stem, else as a misspelling."""
        word = bare(raw)
        for stem in stems(word, self.model.settings):
            if stem in self.terms:
                kind, at = self.terms[stem]
                return kind, word, at
        found = self.speller.find(word) if word and word not in self.model.innocent else None
        return found and (WRONG, word, found[0])

    def hits(self, text: str | None) -> tuple[int, list[Hit]]:
        """Number of words and all hits."""
        words = (text or "").lower().split()
        if len(self.cache) > 200_000:
            self.cache.clear()
        cache = self.cache
        near = set()
        for raw in set(words):
            if raw not in cache:
                cache[raw] = self.known(raw)
            if cache[raw] is not None:
                near.add(raw)
        if not near:
            return len(words), []
        w = self.model.settings.window
        return len(words), [(at, *cache[raw], words[max(at - w, 0) : at + w + 1]) for at, raw in enumerate(words) if raw in near]

    def count(self, place: int, window: list[str]) -> float:
        """What a hit counts: less between quote marks or beside words of quotation."""
        settings = self.model.settings
        middle = min(place, settings.window)
        before, word, after = window[:middle], window[middle], window[middle + 1 :]
        core = bare(word)
        cut = word.find(core)
        opened = any(c in QUOTES for c in word[:cut]) or any(w[0] in QUOTES for w in before)
        closed = any(c in QUOTES for c in word[cut + len(core) :]) or any(w[-1] in QUOTES for w in after)
        lean = sum(self.model.context.get(bare(w), 0.0) for w in before + after)
        return (settings.quoted if opened and closed else 1.0) / (1.0 + math.exp(-2.0 - max(lean, -8.0)))

    def features(self, n: int, hits: list[Hit]) -> tuple[float, ...]:
        """Of a text of ``n`` words."""
        sums = [0.0, 0.0, 0.0]
        for place, kind, _, _, window in hits:
            sums[kind] += self.count(place, window)
        strong, wrong, weak = sums
        part = 100.0 / n if n else 0.0
        return 1.0, math.log1p(strong), math.log1p(wrong), math.log1p(part * (strong + wrong)), math.log1p(weak), math.log1p(part * weak)

    def score(self, text: str | None) -> tuple[float, int]:
        """Score and number of hits."""
        n, hits = self.hits(text)
        z = sum(a * b for a, b in zip(self.model.weights, self.features(n, hits)))
        return 1.0 / (1.0 + math.exp(-max(min(z, 500.0), -500.0))), len(hits)


def logistic(x: np.ndarray, y: np.ndarray, prior, ridge: float) -> np.ndarray:
    """Newton steps on the log-likelihood with a Gaussian prior around ``prior``; a feature that would lower scores gets no weight."""
    prior = np.array(prior, dtype=float)
    used = np.ones(len(prior), dtype=bool)
    while True:
        w, part = prior[used], x[:, used]
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -500, 500)))
            slope = part.T @ (p - y) + ridge * (w - prior[used])
            bend = (part * (p * (1 - p))[:, None]).T @ part + ridge * np.eye(len(w))
            step = np.linalg.solve(bend, slope)
            w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        out = np.zeros(len(prior))
        out[used] = w
        if (out[1:] >= 0).all():
            return out
        used[1:] &= out[1:] > 0


def _shares(keep: dict[str, None] | None, settings: Settings):
    """Of a task's documents: how many hold each stem and the sum of its shares, at most 2 % each; only of ``keep`` if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, share = Counter(), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), pa.array(list(number.values()), pa.int64()), pa.array([share[t] for t in number], pa.float64())], names=["term", "n", "share"])

        for batch in batches:
            for text in batch.column(0):
                words = (text.as_py() or "").lower().split()
                mine = Counter()
                for raw, times in Counter(words).items():
                    for stem in stems(bare(raw), settings):
                        if keep is None or stem in keep:
                            mine[stem] += times
                number.update(mine.keys())
                for stem, times in mine.items():
                    share[stem] += min(100.0 * times / len(words), 2.0)
                if len(number) > 1_000_000:
                    yield out()
                    number, share = Counter(), Counter()
        yield out()

    return run


def _first_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest hash of a text's five-word shingles: near copies mostly share it."""
    import xxhash

    for batch in batches:
        keys = []
        for text in batch.column(1):
            words = (text.as_py() or "").encode().lower().split()
            keys.append(min(xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 3) for i in range(max(len(words) - 4, 1))) >> 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["toxic", "text", "copy"])


def _observed(model: Model):
    """Label, number of words and hits of each document."""
    hit = pa.struct([("place", pa.int32()), ("kind", pa.int32()), ("word", pa.string()), ("term", pa.int32()), ("window", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for batch in batches:
            seen = [finder.hits(t) for t in batch.column(1).to_pylist()]
            rows = [[dict(zip(("place", "kind", "word", "term", "window"), h)) for h in hits] for _, hits in seen]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in seen], pa.int64()), pa.array(rows, pa.list_(hit))], names=["toxic", "n", "hits"])

    return run


def lexicon(bad: dict[str, tuple[int, float]], good: dict[str, tuple[int, float]], n_bad: int, n_good: int, settings: Settings) -> tuple[list[str], list[str]]:
    """Strong and weak terms from documents and shares of each stem in toxic and clean documents.

    Of stems that continue each other the shortest fit one stays, written out as
    long as (nearly) all its toxic documents go with it.
    """
    chosen: dict[str, None] = {}
    for term in sorted(bad, key=lambda t: (len(t), t)):
        n, share = bad[term]
        clean = good.get(term, (0, 0.0))[1]
        if n < max(settings.least, settings.support * n_bad) or share / n_bad < settings.ratio * (clean + 0.5) / (n_good + 1):
            continue
        shorter = next((term[:k] for k in range(settings.shortest, len(term)) if term[:k] in chosen), None)
        if shorter is None:
            chosen[term] = None
        elif n >= 0.95 * bad[shorter][0]:
            del chosen[shorter]
            chosen[term] = None
    strong = [t for t in chosen if good.get(t, (0, 0.0))[0] <= settings.clean * n_good]
    return strong, [t for t in chosen if t not in set(strong)]


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, fold: int = 2, folds: int = 4) -> DataFrame:
    """``toxic, text`` of at most ``settings.sample`` labelled documents outside the held-out fold, by a hash of the id.

    A document labelled more than once is toxic if any label says so; a null label
    says nothing.  Rows without an id are not learnt from, of rows that share one
    the least text is, of near copies with one label mostly one.
    """
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    taken = marks.filter(~held_out(fold, folds)).orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(settings.sample)
    # at most settings.sample rows of a few bytes
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    keyed = rows.select("toxic", "text").mapInArrow(_first_shingle, "toxic int, text string, copy long")
    return keyed.groupBy("copy", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Lexicon, innocent spellings, context and weights from labelled rows.

    The driver gets counts of at most ``settings.candidates`` stems, and of at most
    ``settings.sample`` documents the windows of their hits.  Without toxic rows the
    lexicon is empty, without rows the prior stays.
    """
    rows = materialise(training_rows(docs, labels, settings), "labelled")
    counts = "term string, n long, share double"

    def summed(label: int, keep: dict[str, None] | None) -> DataFrame:
        found = rows.filter(F.col("toxic") == label).select("text").mapInArrow(_shares(keep, settings), counts)
        return found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("share").alias("share"))

    n_good, n_bad = (rows.filter(F.col("toxic") == label).count() for label in (0, 1))
    floor = max(settings.least, settings.support * n_bad)
    bad = {r["term"]: (r["n"], r["share"]) for r in summed(1, None).filter(F.col("n") >= floor).orderBy(F.desc("share"), "term").limit(settings.candidates).collect()}
    good = {r["term"]: (r["n"], r["share"]) for r in summed(0, dict.fromkeys(bad)).collect()}
    strong, weak = lexicon(bad, good, n_bad, n_good, settings)
    model = Model(strong, weak, strong, settings=settings)
    seen = [(r["toxic"] == 1, r["n"], [tuple(h) for h in r["hits"]]) for r in rows.mapInArrow(_observed(model), "toxic int, n long, hits array<struct<place:int,kind:int,word:string,term:int,window:array<string>>>").toLocalIterator()]
    if not seen:
        return model
    # misspellings: terms that clean documents come near to are left out, spellings that they use too
    near, spelt = Counter(), (Counter(), Counter())
    for toxic, _, hits in seen:
        wrong = {(term, word) for _, kind, word, term, _ in hits if kind == WRONG}
        spelt[toxic].update({word for _, word in wrong})
        near.update(set() if toxic else {term for term, _ in wrong})
    model.spelt = [t for at, t in enumerate(strong) if near[at] <= settings.clean * n_good]
    model.innocent = frozenset(w for w, n in spelt[0].items() if n >= spelt[1][w])
    finder = Finder(model)
    kept = []
    for toxic, n, hits in seen:
        again = [(hit, finder.known(hit[2])) for hit in hits]
        kept.append((toxic, n, [(hit[0], *found, hit[4]) for hit, found in again if found]))
    beside, holders = (Counter(), Counter()), [0, 0]
    for toxic, _, hits in kept:
        windows = [{bare(w) for at, w in enumerate(window) if at != min(place, settings.window)} for place, kind, _, _, window in hits if kind != WEAK]
        holders[toxic] += bool(windows)
        beside[toxic].update(set().union(*windows) if windows else ())
    # a context word counts once clean documents show it beside a hit often enough to tell
    for word, n in beside[0].items():
        odds = math.log((beside[1][word] + 1) / (holders[1] + 2)) - math.log((n + 1) / (holders[0] + 2))
        if word and n >= settings.least and odds < 0:
            model.context[word] = odds
    x = np.array([finder.features(n, hits) for _, n, hits in kept])
    model.weights = tuple(logistic(x, np.array([t for t, _, _ in kept], dtype=float), settings.prior, settings.ridge).tolist())
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for batch in batches:
            found = [finder.score(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())], names=["id", "score", "n_hits"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_hits`` of every row; only ``doc_id`` and ``text`` are read.

    A null, empty or wordless text has the score of a document without hits.
    Repeated rows and ids have a row each, a null id stays null; an empty table
    gives none.
    """
    rows = docs.select(id_key("doc_id").alias("id"), "text").mapInArrow(_scored(model), "id long, score double, n_hits long")
    named = rows.select(id_back(F.col("id")).alias("doc_id"), "score", "n_hits")
    predicted = (F.col("score") >= model.settings.threshold).cast("int").alias("predicted")
    return named.select("doc_id", held_out(2, 4).alias("held_out"), "score", predicted, "n_hits")


def op13_levenshtein_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole text, learnt outside the held-out fold; see :func:`fit` and :func:`scored`."""
    docs = documents(spark, folder)
    return scored(docs, fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))
