"""Operators 4 and 9 against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from spendlake.llm import covertree, lattice
from spendlake.llm.registry import QUERIES
from tests.conftest import SMALL

LOW = -(2**63)


def low(x):
    return LOW if x is None else x


# -- 4: language model

PIECES = [b"a", b"b", b"ab", b"ba", b"abb", "▁".encode(), "▁a".encode(), "▁ab".encode()] + [bytes([i]) for i in range(256) if i not in b"ab"]


def paths(word, scores):
    """Sum over all segmentations, one by one."""
    if not word:
        return 1.0
    return sum(math.exp(scores[i]) * paths(word[len(p) :], scores) for i, p in enumerate(PIECES) if word.startswith(p))


def test_marginal_sums_all_segmentations():
    rng = random.Random(1)
    scores = np.log(np.array([rng.random() for _ in PIECES]))
    words = [lattice.WORD_START + w for w in (b"", b"a", b"abba", b"abbab", b"ba", "aé".encode(), b"aab")]
    trie = lattice.Trie.of(PIECES)
    counts = np.array([1.0, 2, 3, 4, 5, 6, 7])
    found, expected = lattice.forward(trie, scores, words, counts)
    assert np.allclose(found, [math.log(paths(w, scores)) for w in words])
    moved = scores.copy()
    for piece in (0, 2, 7):  # the expected count is the derivative of the log likelihood
        moved[piece] += 1e-6
        slope = (counts @ lattice.forward(trie, moved, words)[0] - counts @ found) / 1e-6
        assert expected[piece] == pytest.approx(slope, rel=1e-3)
        moved[piece] -= 1e-6


def check_scores(rows, docs):
    split = [(d["text"] or "").encode().lower().split() for d in docs]
    held = [zlib.crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode()) % 5 == 1 for d in docs]
    counts = Counter(w for words, h in zip(split, held) if not h for w in words)
    ends = sum(not h for h in held)
    total, kinds = sum(counts.values()) + ends, len(counts) + (ends > 0)
    base = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    want = sorted((low(d["doc_id"]), h, len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), total, round(sum(base(counts[x]) for x in w) + base(ends), 5)) for d, w, h in zip(docs, split, held))
    got = sorted((low(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows)
    for x, y in zip(got, want, strict=True):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], rel=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_scores_of_the_tables(spark):
    rows = QUERIES["op4_lattice_likelihood"](spark, SMALL).collect()
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_scores(rows, docs)
    order = {r["doc_id"]: r for r in rows}
    words = {d["doc_id"]: (d["text"] or "").encode().lower().split() for d in docs}
    real = [d for d in words if len(words[d]) > 50]
    # a text in which each word is spelt backwards is far less probable a word
    turned = spark.createDataFrame([(d, " ".join((w.decode()[::-1] + "q") for w in words[d])) for d in real] + [(10_000 + i, t["text"]) for i, t in enumerate(docs)], "doc_id long, text string")
    other = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lattice.score(turned).collect()}
    assert sum(other[d] < order[d]["score"] / order[d]["n_tokens"] for d in real if order[d]["held_out"]) >= 0.9 * sum(order[d]["held_out"] for d in real)


def test_scores_of_odd_rows(odd, empty, clashing):
    docs = [r.asDict() for r in odd.collect()]
    check_scores(lattice.score(clashing).collect(), docs)
    assert lattice.score(empty).count() == 0
    only_held = odd.filter("crc32(cast(doc_id as string)) % 5 = 1")
    check_scores(lattice.score(only_held).collect(), [r.asDict() for r in only_held.collect()])


# -- 9: embeddings

def brute_vectors(rows, cosine=0.95):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    vectors = [np.array(v, dtype=np.float64) if usable(v) else None for _, v in rows]
    vectors = [None if v is None else v / np.abs(v).max() for v in vectors]
    n = len(rows)
    links, component = [0] * n, [low(i) for i, _ in rows]
    pairs = []
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if component[i] != component[j]:
                component[i] = component[j] = min(component[i], component[j])
                changed = True
    return Counter((low(r[0]), l, c, low(r[0]) == c) for r, l, c in zip(rows, links, component))


def of(frame):
    return Counter((low(r["vec_id"]), r["n_links"], low(r["component_id"]), r["kept"]) for r in frame.collect())


def test_vectors_of_the_tables(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert of(QUERIES["op9_covertree_embeddings"](spark, SMALL)) == brute_vectors(rows)


@pytest.mark.parametrize("block", [4096, 40])
def test_odd_vectors(spark, block):
    rng = np.random.default_rng(block)
    base = rng.normal(size=(60, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (v * 3 + rng.normal(size=12) * 0.15).tolist()) for i, v in enumerate(base)]
    rows += [(200 + i, (base[0] + rng.normal(size=12) * s).tolist()) for i, s in enumerate(np.repeat([0.001, 0.03, 0.1, 0.2], 25))]
    rows += [(300 + i, base[1].tolist()) for i in range(30)]
    rows += [(400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] * 12), (404, [1.0] * 11 + [float("inf")]), (405, [1.0] * 11 + [None]), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (None, base[2].tolist()), (5, base[5].tolist()), (5, base[7].tolist()), (408, (base[3] * 1e300).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as first", "3 as weight", "4 as vector")
    assert of(covertree.near_vectors(frame, block=block)) == brute_vectors(rows)
    assert of(covertree.near_vectors(frame.limit(0))) == Counter()


@pytest.mark.parametrize("n", [1, 5, 60, 500])
def test_blocks_are_sent_once_for_each_stripe(n):
    """Every pair of blocks meets in one square, and no block goes to more squares than there are stripes."""
    rng = np.random.default_rng(n)
    parts = rng.integers(1, 4, n).tolist()
    near = rng.random((n, n)) < 0.3
    for partners in (np.ones((n, n), dtype=bool), near | near.T | np.eye(n, dtype=bool)):
        count, first, meets = covertree.stripes(parts, partners)
        total = sum(parts)
        assert count <= max(covertree.STRIPES, -(-total // covertree.HELD)) and max(map(len, meets)) <= count
        own = [[b * count // total for b in range(f, f + k)] for f, k in zip(first, parts)]
        assert np.bincount(sum(own, [])).max() <= covertree.HELD
        for i, j in zip(*np.nonzero(partners)):
            assert set(own[j]) <= set(meets[i]) and set(own[i]) <= set(meets[j])


def test_blocks_keep_vectors_as_given():
    rng = np.random.default_rng(3)
    for vectors in (rng.normal(size=(50, 6)), rng.normal(size=(50, 6)).astype(np.float32).astype(np.float64), rng.normal(size=(50, 6)) * 1e300):
        block = covertree.Block.unpack(covertree.Block.pack(np.arange(50), np.ones(50), vectors))
        assert (block.unit == covertree.units(vectors)).all() and sorted(block.tree.order.tolist()) == list(range(50))


def test_trees_nest_and_cover():
    rng = np.random.default_rng(5)
    points = covertree.units(np.r_[rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(3, 8)), 60, axis=0) + rng.normal(size=(180, 8)) * 0.02])
    tree = covertree.Tree.of(points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for n in range(len(tree.centre)):
        own = tree.order[tree.first[n] : tree.last[n]]
        assert covertree.distances(points[own], points[tree.centre[n]][None]).max() <= tree.radius[n] + 1e-3
        kids = range(tree.kids_first[n], tree.kids_last[n])
        if len(kids):
            assert tree.centre[kids[0]] == tree.centre[n] and sum(tree.last[k] - tree.first[k] for k in kids) == len(own)
