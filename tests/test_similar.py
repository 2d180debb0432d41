"""The letter index against comparisons of all pairs."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from spendlake.operators import catalogue, sets, similar
from spendlake.sources.canonical import Tables

HUNDREDTH = "/root/testdata/sf0.01"


def noisy(rng, text):
    out = list(text)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(2)] = rng.choice(["", "a", "0", "x", " "])
    return "".join(out)


def test_no_pair_is_lost(spark):
    rng = random.Random(5)
    words = ["leche", "pan", "coca cola", "aceite oliva", "ñandú", "aaa", "a", "tomate", "mote", "metato", "yogurt 1kg", ""]
    left = sorted({noisy(rng, rng.choice(words)) for _ in range(120)})
    right = sorted({noisy(rng, rng.choice(words)) for _ in range(120)})
    one, two = (spark.createDataFrame([(t,) for t in [*x, None]], f"{n} string") for x, n in ((left, "a"), (right, "b")))
    for threshold in (0.5, 0.6, 0.75, 0.9, 1.0):
        want = {(a, b) for a in left for b in right if a and b and SequenceMatcher(None, a, b).ratio() >= threshold}
        found = similar.similar_pairs(one, two, threshold).collect()
        assert {(r.a, r.b) for r in found} == want and len(found) == len(want)
        best = {a: max(SequenceMatcher(None, a, b).ratio() for x, b in want if x == a) for a, _ in want}
        most = similar.most_similar(one, two, threshold).collect()
        assert {(r.a, r.b) for r in most} <= want
        assert {(r.a, r.b) for r in most if r.similarity == best[r.a]} == {(a, b) for a, b in want if SequenceMatcher(None, a, b).ratio() == best[a]}


def test_thousands_of_learned_names(spark):
    """All names of the table against the dictionary and 3,000 learned names; a sample of them by brute force."""
    tables = Tables(spark, HUNDREDTH)
    parts = [r[0] for r in tables.raw("part").select("p_name").distinct().collect()]
    rng = random.Random(2)
    learned = rng.sample(sorted({f"{rng.choice(parts)} {rng.choice(catalogue.PRODUCTS)[2][0]} {i % 700}"[: rng.randrange(6, 30)].strip().lower() for i in range(16000)}), 3000)
    assert len(learned) == 3000
    frame = spark.createDataFrame([(n, n.title(), None) for n in learned], "learned_name string, corrected_name string, category string")
    names = tables.noisy_names.select("name").distinct()
    got = {r.name: r for r in catalogue.match_products(names, learned=frame).collect()}
    assert len(got) == names.count()
    entries = [e for _, _, ns, ms in catalogue.PRODUCTS for e in ns + ms]
    cleaned = {r.name: r.q for r in names.select("name", catalogue.comparable(F.col("name")).alias("q")).collect()}
    for name in rng.sample(sorted(got), 25):
        best, matcher = 0.0, SequenceMatcher(None, autojunk=True)
        matcher.set_seq1(cleaned[name])
        for entry in entries + learned:
            matcher.set_seq2(entry)
            if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
                best = max(best, matcher.ratio())
        assert got[name].confidence == (best if best >= 0.6 else 0.0)
    asked = spark.createDataFrame([(q,) for q in set(cleaned.values())], "a string")
    tried = similar.candidates(asked, frame.select(F.col("learned_name").alias("b")), 0.6).count()
    assert tried < 0.5 * len(set(cleaned.values())) * len(learned)


def test_token_sets_against_all_pairs(spark):
    rng = random.Random(8)
    names = sorted({" ".join(rng.choice("red blue small hot ring bolt gear steel brand12 brand13 xl".split()) for _ in range(rng.randrange(1, 9))) for _ in range(150)})
    frame = spark.createDataFrame([(n,) for n in [*names, *names[:20], "", None]], "name string")
    for at_least in (0.3, 0.5, 0.8, 1.0):
        want = {}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                one, two = set(a.split()), set(b.split())
                if len(one & two) / len(one | two) >= at_least:
                    want[a, b] = len(one & two) / len(one | two)
        found = sets.similar_names(frame, at_least).collect()
        assert {(r.name_a, r.name_b): r.similarity for r in found} == want and len(found) == len(want)
        assert sets._possible_pairs(frame, at_least).count() <= 3 * max(len(want), 1)
