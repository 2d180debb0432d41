"""Toxicity: the automaton against edit distances, held-out accuracy, quotation and misspellings."""

import random
import zlib

import pytest

from spendlake.llm import toxicity
from spendlake.llm.toxicity import Finder, Model, Speller, edits_allowed
from tests.conftest import SMALL
from tests.llm.conftest import words

TENTH = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    terms = ["ab", "abba", "babab", "abcabc", "cabbages", "bacabcabc", "abcabcabcabc", "ccccc"]
    spellers = [Speller(terms), Speller(terms, limit=20)]
    for _ in range(6000):
        word = list(rng.choice(terms)) if rng.random() < 0.7 else [rng.choice("abc") for _ in range(rng.randrange(1, 14))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "c", "x"])
        word = "".join(word)
        near = [(distance(word, t), i) for i, t in enumerate(terms) if distance(word, t) <= edits_allowed(t)]
        want = min(near)[::-1] if near else None
        assert [s.find(word) for s in spellers] == [want, want]


def test_no_terms_find_nothing():
    assert Speller([]).find("word") is None
    assert Finder(Model()).score("some words")[0] == pytest.approx(1 / (1 + 2.718281828**3), rel=1e-6)


def test_quotation_counts_less_and_misspellings_count():
    both = ["moron", "worthless"]
    finder = Finder(Model(both, spelt=both))
    plain, wrong, clean = (finder.score(f"you are a {w} and that is all there is to say")[0] for w in ("moron!", "mor0n", "mormon"))
    assert finder.score("you are a worthlss and that is all there is to say")[0] == wrong
    assert finder.score("you are a morons, and that is all there is to say")[0] == plain  # a stem
    quoted = [finder.score(f"the word {w} is there, and that is all there is to say")[0] for w in ('"moron"', "“moron”", "« moron »", '("moron"),')]
    none = finder.score("you are a marons and that is all there is to say")[0]
    assert plain > wrong > max(quoted[:2]) and plain > max(quoted) and min(quoted) > none
    assert clean == wrong  # one edit away, as long as no clean document shows the spelling
    assert Finder(Model(both, spelt=both, innocent=frozenset(["mormon"]))).score("a mormon")[1] == 0


def test_context_words_lower_a_hit():
    model = Model(["moron"], context={"reads": -4.0})
    assert Finder(model).score("the sign reads moron in red")[0] < Finder(model).score("the sign shows moron in red")[0]


@pytest.fixture(scope="module")
def tenth(spark):
    docs, labels = (spark.read.parquet(f"{TENTH}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    return docs, labels, model, toxicity.scored(docs, model).toPandas()


def test_held_out_accuracy(tenth):
    docs, labels, model, found = tenth
    assert len(found) == docs.count()
    joined = found.merge(labels.toPandas(), on="doc_id")
    joined = joined[joined["held_out"]]
    assert (joined["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in joined["doc_id"]]).all()
    right = joined["predicted"] == joined["toxic"]
    bad = joined[joined["toxic"] == 1]
    # some labels are noise: toxic documents that hold none of the words
    assert len(joined) > 900 and right.mean() > 0.98 and bad["predicted"].mean() > 0.85
    assert joined[joined["toxic"] == 0]["predicted"].mean() < 0.005
    assert found["score"].between(0, 1).all() and ((found["score"] >= 0.3) == (found["predicted"] == 1)).all()


def test_planted_misspellings_are_caught(spark, tenth):
    docs, _, model, found = tenth
    rng = random.Random(7)
    clean = [r["text"] for r in docs.filter("lang = 'en' AND n_chars BETWEEN 400 AND 3000").join(spark.createDataFrame(found[found["n_hits"] == 0][["doc_id"]]), "doc_id").limit(60).collect()]
    terms = [t for t in model.spelt if len(t) > 4]
    rows = []
    for i, text in enumerate(clean):
        body = text.split()
        for _ in range(4):
            word = list(rng.choice(terms))
            word[rng.randrange(1, len(word))] = rng.choice("xyzq0")
            body.insert(rng.randrange(len(body)), "".join(word))
        rows += [(2 * i, text), (2 * i + 1, " ".join(body))]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(0, len(rows), 2)] == [0] * len(clean)
    assert sum(got[i] for i in range(1, len(rows), 2)) >= 0.95 * len(clean)


def test_odd_rows_and_empty_tables(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(4, None, 1), (4, None, 0), (None, 1, 1), (8, 1, None), (9, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(clashing, labels)
    rows = toxicity.scored(clashing, model).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1
    assert toxicity.fit(empty, labels).strong == [] and toxicity.fit(odd, labels.limit(0)).strong == []
    assert toxicity.scored(empty, model).collect() == []
    fold = toxicity.training_rows(odd, labels, toxicity.Settings()).collect()
    assert len(fold) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in (4, 9))


def test_query(spark):
    found = toxicity.op13_levenshtein_toxicity(spark, SMALL)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and found.count() == 200
