"""The pipeline's stages do the whole job: near copies by Jaccard similarity, against brute force."""

import random

import numpy as np

from spendlake.llm import nearsets, simhash
from spendlake.llm.common import Scratch
from spendlake.llm.langid import language_stage
from tests.conftest import SMALL
from tests.llm.conftest import SCHEMA, words


def brute_components(rows):
    """Place of the first similar row for each row, by comparing all pairs of five-word shingle sets."""
    sets = []
    for d in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"] or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def copies():
    """Texts with words replaced, of all sizes; groups whose members are similar only through others."""
    rng = random.Random(11)
    texts = []
    for n in (4, 5, 6, 9, 13, 24, 25, 60, 150, 400):
        base = words(rng, n, 10**6).split()
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 3, 5, 8):
            other = base[:]
            for at in rng.sample(range(n), min(changes, n)):
                other[at] = f"changed{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    chain = words(rng, 300, 10**6).split()
    for _ in range(40):
        chain = chain[7:] + words(rng, 7, 10**6).split()
        texts.append(" ".join(chain))
    hub = words(rng, 200, 10**6).split()
    for _ in range(60):
        other = hub[:]
        for at in rng.sample(range(200), 4):
            other[at] = f"changed{rng.randrange(10**6)}"
        texts.append(" ".join(other))
    return [(1000 - i, t, "en", "s", i) for i, t in enumerate(texts)]


def test_near_stage_equals_brute_force(spark):
    frame = spark.createDataFrame(copies(), SCHEMA).repartition(4)
    for docs in (frame, spark.read.parquet(f"{SMALL}/documents.parquet").dropDuplicates(["text"]).cache()):
        rows = sorted((r.asDict() for r in docs.collect()), key=lambda d: d["doc_id"])
        want = [rows[i]["doc_id"] for i in sorted(set(brute_components(rows)))]
        assert len(want) < len(rows)
        assert sorted(r["doc_id"] for r in nearsets.near_stage(spark, docs, SMALL).collect()) == want


def test_near_stage_compares_what_op8_links(spark, monkeypatch):
    """op8's search is a step of the stage; a link counts only if the texts are similar, and the exact search goes on from there."""
    rng = random.Random(9)
    base = words(rng, 400, 10**6).split()
    texts = [" ".join(base), " ".join(base[:-1] + ["end"]), " ".join(base).upper(), " ".join(base[:200]), words(rng, 400, 10**6)]
    nodes = spark.createDataFrame(list(enumerate(t.encode() for t in texts)), "node long, text binary")
    prints = [simhash.fingerprint(t.encode(), nearsets.SHINGLE) for t in texts]
    scratch = Scratch(spark)
    found = {tuple(r) for r in nearsets.simhash_pairs(nodes, scratch).collect()}
    scratch.clear()
    assert (0, 2) in found and prints[0] == prints[2]
    assert all((prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS for a, b in found)
    assert {a for pair in found for a in pair} == {a for a in range(5) for b in range(5) if a != b and (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS}
    # a pair that op8 links in error stays apart
    asked = []
    monkeypatch.setattr(nearsets, "simhash_pairs", lambda rows, _: asked.append(rows.count()) or rows.sparkSession.createDataFrame([(0, 3), (0, 1)], "a long, b long"))
    linked = {r["node"]: r["root"] for r in nearsets.similar_links(nodes).collect()}
    assert asked == [3] and linked | {0: 0} == {0: 0, 1: 0, 2: 0}


def test_similar_sets_share_a_signature():
    rng = random.Random(5)
    for turn in range(2000):
        a = {rng.getrandbits(64) for _ in range(1 + turn % 170)}
        b = set(a)
        while True:
            c = set(b)
            if rng.random() < 0.5 and len(c) > 1:
                c.remove(min(c))
            if rng.random() < 0.6:
                c.add(rng.getrandbits(64))
            if 5 * len(a & c) < 4 * len(a | c):
                break
            b = c
        left, right = (nearsets.signatures(np.array(sorted(x), dtype=np.uint64)) for x in (a, b))
        assert np.isin(left, right).any()


def test_sides_of_a_shingle_bound_what_is_common(spark):
    """What is before and after a kept shingle never rules out a similar pair, but pairs that meet in one passage only."""
    rng = random.Random(12)
    passage = words(rng, 60, 10**6)
    texts = [row[1] for row in copies()] + [f"{words(rng, 6, 10**6)} {passage} {words(rng, k, 10**6)}" for k in range(2, 12)]
    nodes = spark.createDataFrame(list(enumerate(t.encode() for t in texts)), "node long, text binary")
    scratch = Scratch(spark)
    kept = nearsets.rarest(nodes.mapInArrow(nearsets._shingle_signs, nearsets.SIGNS), scratch).collect()
    scratch.clear()
    sets, met = [set(nearsets.shingles(t.encode())) for t in texts], {}
    for row in kept:
        met.setdefault(row["sig"], []).append(row)
    ruled_out = 0
    for rows in met.values():
        for x in rows:
            for y in rows:
                if x["node"] < y["node"]:
                    most = min(x["before"], y["before"]) + 1 + min(x["after"], y["after"])
                    assert most >= len(sets[x["node"]] & sets[y["node"]])
                    ruled_out += 9 * most < 4 * (x["dealing"] + y["dealing"])
    assert ruled_out


def test_null_and_repeated_ids_keep_one_row_of_a_group(spark):
    rng = random.Random(6)
    base, other, alone = words(rng, 200, 10**6), words(rng, 200, 10**6), words(rng, 200, 10**6)
    texts = [(None, base), (None, base + " end"), (None, base + " another end"), (7, other), (7, other + " end"), (7, other + " end"), (8, other + " last"), (7, alone)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], SCHEMA).repartition(3)
    kept = [(r["doc_id"], r["text"].split()[0]) for r in nearsets.near_stage(spark, frame, SMALL).collect()]
    assert sorted(kept, key=str) == sorted([(None, base.split()[0]), (7, other.split()[0]), (7, alone.split()[0])], key=str)


def test_language_stage_without_labels_drops_only_texts_without_letters(spark):
    texts = ["some words", None, "", "12 -- 34", "été", "漢字"]
    for lang in (None, "en"):
        frame = spark.createDataFrame([(i, t if lang is None else f"{i} --", lang, "s", 1) for i, t in enumerate(texts)], SCHEMA)
        want = [0, 4, 5] if lang is None else []
        assert sorted(r["doc_id"] for r in language_stage(spark, frame, SMALL).collect()) == want
