"""Operators 2 and 7 against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest

from spendlake.llm import suffixes, superkmers, windows
from spendlake.llm.registry import QUERIES
from tests.conftest import SMALL

LOW = -(2**63)


def table(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def low(x):
    return LOW if x is None else x


def brute_words(rows, n=20):
    first = {}
    split = [(d["text"] or "").encode().split() for d in rows]
    for d, words in zip(rows, split):
        for s in range(len(words) - n + 1):
            window = b" ".join(words[s : s + n])
            place = (low(d["doc_id"]), s)
            if window not in first or place < first[window]:
                first[window] = place
    out = Counter()
    for d, words in zip(rows, split):
        gone = np.zeros(len(words), dtype=bool)
        for s in range(len(words) - n + 1):
            if first[b" ".join(words[s : s + n])] < (low(d["doc_id"]), s):
                gone[s : s + n] = True
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[d["doc_id"], len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def brute_bytes(rows, n=200):
    seen = Counter()
    texts = [(d["text"] or "").encode() for d in rows]
    for t in texts:
        seen.update(hashlib.md5(t[s : s + n]).digest() for s in range(len(t) - n + 1))
    out = Counter()
    for d, t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for s in range(len(t) - n + 1):
            if seen[hashlib.md5(t[s : s + n]).digest()] > 1:
                gone[s : s + n] = True
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[d["doc_id"], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def of_words(frame, **options):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in superkmers.without_repeats(frame, **options).collect())


def of_bytes(frame, **options):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffixes.without_repeats(frame, **options).collect())


def test_word_windows_equal_brute_force(spark):
    got = Counter(tuple(r) for r in QUERIES["op2_superkmer_substrings"](spark, SMALL).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute_words(table(spark))


def test_byte_strings_equal_brute_force(spark):
    got = Counter(tuple(r) for r in QUERIES["op7_refined_suffixes"](spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute_bytes(table(spark))


def test_odd_rows(odd, empty, clashing):
    rows = [r.asDict() for r in odd.collect()]
    assert of_words(clashing) == brute_words(rows)
    assert of_bytes(clashing) == brute_bytes(rows)
    assert of_words(empty) == of_bytes(empty) == Counter()


@pytest.mark.parametrize("seed", range(4))
def test_segments_and_periods(spark, seed):
    """Long documents in many overlapping segments, periodic and shared passages."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice("abcdefgh") for _ in range(90))
    rows = []
    for i in range(25):
        parts = [" ".join(rng.choice(["xx", "yy", "z", "word", "ü"]) for _ in range(rng.randrange(120)))]
        parts += [passage] * rng.randrange(3) + ["la " * rng.randrange(150)] + [passage[rng.randrange(60) :]]
        rows.append((i % 20, " ".join(parts) if i else None))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = [{"doc_id": a, "text": b} for a, b in rows]
    assert of_words(frame, kind=replace(superkmers.KIND, segment=64)) == brute_words(plain)
    assert of_bytes(frame, kind=replace(suffixes.KIND, segment=300)) == brute_bytes(plain)


def test_classes_by_refinement():
    rng = np.random.default_rng(0)
    strings = [bytes(rng.integers(97, 99, 60).astype(np.uint8)) for _ in range(30)] + [b"ab" * 40, b"ba" * 40]
    for kind in (windows.Kind(False, 20, 5, False), windows.Kind(False, 13, 5, False)):
        ids, ends, owner, width = windows._units(kind, strings)
        at, classes = windows.window_classes(ids, ends, width, kind.size)
        flat, by = b"".join(strings), defaultdict(list)
        for i in range(len(flat)):
            if i + kind.size <= ends[i]:
                by[flat[i : i + kind.size]].append(i)
        want = sorted(sorted(v) for v in by.values() if len(v) > 1)
        got = defaultdict(list)
        for i, c in zip(at.tolist(), classes.tolist()):
            got[c].append(i)
        assert sorted(sorted(v) for v in got.values()) == want
