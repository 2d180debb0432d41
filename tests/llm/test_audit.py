"""Conversation repair against plain string programs and against an enumeration of edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from spendlake.llm import audit
from tests.conftest import SMALL

LEGAL = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def applied(rows, edits):
    """Roles and texts after the edits, or None where they do not fit."""
    out, at = [], 0
    for e in edits:
        if e == "I":
            out.append((None, ""))
            continue
        role, text = rows[at][:2]
        at += 1
        if e != "D":
            out.append((role if e == "K" else None, text))
    system = bool(out) and out[0][0] is not None and out[0][0][:1] == "s"
    done = []
    for i, (role, text) in enumerate(out):
        want = "s" if system and i == 0 else "ua"[(i - system) % 2]
        if role is not None and role[:1] != want:
            return None
        done.append((role if role is not None else {"u": "user", "a": "assistant"}.get(want), text))
    return done if LEGAL.fullmatch("".join(r[:1] for r, _ in done)) and all(r for r, _ in done) else None


def price(rows, edits):
    total, at = 0, 0
    for e in edits:
        total += {"K": 0, "R": 2, "D": 3, "I": 2}[e]
        if e != "I":
            fault, at = rows[at][2], at + 1
            if e != "D":
                if fault in ("blank", "duplicate"):
                    return None
                total += fault == "truncated"
    return total


def enumerated(rows):
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            if sum(gaps) > 3:
                continue
            text = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
            cost = price(rows, text)
            if cost is not None and (best is None or (cost, text) < best) and applied(rows, text) is not None:
                best = (cost, text)
    return best


def strings(rows):
    """The same by whole strings for each state, for longer conversations."""
    ways = {"": (0, "")}
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}

    def insert(ways):
        for _ in range(4):
            for state, (cost, text) in list(ways.items()):
                for to in steps[state].replace("s", ""):
                    ways[to] = min(ways.get(to, (10**9, "")), (cost + 2, text + "I"))
        return ways

    for role, _, fault in rows:
        new = {}
        for state, (cost, text) in insert(ways).items():
            new[state] = min(new.get(state, (10**9, "")), (cost + 3, text + "D"))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                for to in steps[state]:
                    if role[:1] == to:
                        new[to] = min(new.get(to, (10**9, "")), (cost + late, text + "K"))
                    if to != "s":
                        new[to] = min(new.get(to, (10**9, "")), (cost + 2 + late, text + "R"))
        ways = new
    ways = insert(ways)
    return min(ways[s] for s in ("", "a") if s in ways)


def model(table):
    """Expected rows of the query over (conv, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        rows = groups[conv]
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        rows += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faulty = set(), []
        for _, role, text in rows:
            body = text.strip(WHITE)
            faulty.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, edits = strings(faulty)
        turns = {r[0] for r in rows} - {None}
        initials = [r[1][:1] for r in rows]
        body = "\n".join(f"{r}:{t}" for r, t in applied(faulty, edits))
        counts = Counter(f for _, _, f in faulty)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits, hashlib.sha256(body.encode()).hexdigest(),
        ))
    return Counter(out)


def rows_of(rng, n):
    out = []
    for _ in range(n):
        role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""])
        out.append((role, rng.choice(["a.", "b.", "c", " ", "d!"]), rng.choice(["", "", "", "blank", "duplicate", "truncated"])))
    return out


def test_string_program_equals_enumeration():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 3, 3, 3, 4, 4):
        for _ in range(12 if n < 4 else 6):
            rows = rows_of(rng, n)
            assert strings(rows) == enumerated(rows)


@pytest.mark.parametrize("modulus", [audit.MODULUS, 3])
def test_blocks_equal_the_string_program(monkeypatch, modulus):
    """With a modulus of 3 most hashes collide and have to be verified."""
    monkeypatch.setattr(audit, "MODULUS", modulus)
    rng = random.Random(9)
    for turn in range(150):
        rows = rows_of(rng, rng.randrange(0, 40))
        size = rng.choice([1, 2, 5, 100])
        chain = audit.Repair(1)
        for first in range(0, len(rows), size):
            block = audit.Block(1, first, "", b"", first, first == 0 and turn % 2 == 0)
            for at, (role, _, fault) in enumerate(rows[first : first + size]):
                block.add(first + at, role, fault == "blank", fault == "truncated", fault == "duplicate")
            chain.chain(*block.row()[-5:])
        chain.settle()
        assert (chain.cost, chain.audit) == strings(rows)


def test_paths_compare_as_strings():
    rng = random.Random(1)
    trails, texts = audit.Trails(), {0: ""}
    for _ in range(3000):
        parent, letter = rng.choice(list(texts)[-40:]), rng.choice("DIK")
        texts[trails.add(parent, letter)] = texts[parent] + letter
    nodes = list(texts)
    for _ in range(4000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert trails.less(a, b) == (texts[a] < texts[b])
        depth = rng.randrange(len(texts[a]) + 1)
        assert texts[trails.ancestor(a, depth)] == texts[a][:depth]


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert Counter(map(tuple, audit.op11_persistent_audit(spark, SMALL).collect())) == model(map(tuple, rows.collect()))


def test_odd_rows_and_small_blocks(spark, tmp_path):
    rng = random.Random(12)
    table = [(None, 1, "user", "hi."), (None, None, None, None), (None, 2, "assistant", "yes."), (5, None, "user", "a."), (5, None, "user", "a."), (6, 3, "", "x"), (6, 3, "tool", "x."), (6, 9, "user", "long " * 40000)]
    for conv in range(10, 60):
        table += [(conv, rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "bot"]), rng.choice(["a.", "b?", "c", "", " \t", None, "été ! ", "x\n"])) for _ in range(rng.randrange(1, 14))]
    table += [(99, t, ("user", "assistant")[t % 2], f"text {t % 50}.") for t in range(700)]
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumn("conv", audit.F.lit(1)).withColumn("copies", audit.F.lit(2))
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    want = model(table)
    assert Counter(map(tuple, audit.op11_persistent_audit(spark, str(tmp_path)).collect())) == want
    rows, names = audit.damaged(frame), frame.select(audit.F.col("conv_id").alias("conv"))
    assert Counter(map(tuple, audit.repair(rows, names, 3).collect())) == want
    none = frame.limit(0)
    assert audit.repair(audit.damaged(none), none.select(audit.F.col("conv_id").alias("conv"))).collect() == []
