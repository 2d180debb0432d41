"""Conversation structure repair: the cheapest edits that give legal roles.

Legal roles are, by their initials, ``(s?(ua)+)?``.  A dynamic program over the
automaton of that pattern keeps for each of its states the cheapest edits so far,
ties by their initials.  Edits are linked nodes that share prefixes; a node knows
its ancestors at powers of two and a rolling hash of its path, so two paths are
compared at their first difference, found by a longest-common-prefix search.  Equal
hashes are verified along the paths down to a node that both share.

Of two equally cheap ways to one state neither path continues the other: the rest
would be insertions only, which cost something.  So the least path of every state
is all that has to be kept, and blocks of a conversation can be worked on apart: a
block gives the cheapest path from each state to each state.  A conversation may
therefore hold any share of all rows.  Sorted blocks, cut by range, are the first
pass; the second one chains a conversation's blocks, and releases the edits that all
states have in common.  Texts move once, and are hashed as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm.common import materialise

BLANK = r"\A[\x20\x09-\x0D]*\z"
#: The last visible character is no end of a sentence.
TRUNCATED = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"

#: States of the pattern: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: Steps by initial: (from, to).
STEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
WRITTEN = STEPS["u"] + STEPS["a"]  # what an edit can write
LEGAL = {"su", "ua", "au"}
INSERT, REROLE, DELETE = 2, 2, 3

MODULUS = (1 << 61) - 1
BASE = 1_000_003


class Trails:
    """Paths of edits as linked nodes; node 0 is the empty path."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, parent: int, letter: str) -> int:
        above, at = [parent], parent
        while len(self.up[at]) >= len(above):
            at = self.up[at][len(above) - 1]
            above.append(at)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(letter)) % MODULUS)
        self.up.append(tuple(above))
        return len(self.letter) - 1

    def extend(self, parent: int, letters: str) -> int:
        for letter in letters:
            parent = self.add(parent, letter)
        return parent

    def ancestor(self, node: int, depth: int) -> int:
        """The part of the path that is ``depth`` edits long."""
        while self.depth[node] > depth:
            for above in reversed(self.up[node]):
                if self.depth[above] >= depth:
                    node = above
                    break
        return node

    def path(self, node: int, above: int = 0) -> str:
        """Edits after ``above``, an ancestor."""
        out = []
        while node != above:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _same(self, a: int, b: int) -> bool:
        """Whether two paths of one length are equal, edit by edit down to a shared node."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether path ``a`` stands before path ``b`` in the order of strings."""
        short = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, short), self.ancestor(b, short)
        if self.hash[x] == self.hash[y] and self._same(x, y):
            return self.depth[a] < self.depth[b]
        if self.hash[x] == self.hash[y]:  # a collision of the whole paths
            return self.path(x) < self.path(y)
        # hashes differ here; go up as long as they do
        while True:
            for p, q in zip(reversed(self.up[x]), reversed(self.up[y])):
                if self.hash[p] != self.hash[q]:
                    x, y = p, q
                    break
            else:
                break
        p, q = self.up[x][0], self.up[y][0]
        if not self._same(p, q):  # a collision further up hid the first difference
            return self.path(p) < self.path(q)
        return self.letter[x] < self.letter[y]

    def common(self, nodes: list[int]) -> int:
        """Deepest node on all paths."""
        nodes = list(set(nodes))
        while len(nodes) > 1:
            least = min(self.depth[n] for n in nodes)
            level = {self.ancestor(n, least) for n in nodes}
            if len(level) > 1:
                level = {self.up[n][0] for n in level}
            nodes = list(level)
        return nodes[0]


#: The cheapest way to each state: (cost, node), or None where there is none.
Ways = list


def _better(trails: Trails, ways: Ways, state: int, cost: int, parent: int, letters: str) -> bool:
    """Enter a way if it is cheaper, or as cheap and before the one that is there."""
    old = ways[state]
    if old is not None and (old[0] < cost or (old[0] == cost and trails.up[old[1]][:1] == (parent,) and trails.letter[old[1]] == letters)):
        return False
    node = trails.extend(parent, letters)
    if old is not None and old[0] == cost and not trails.less(node, old[1]):
        return False
    ways[state] = (cost, node)
    return True


def inserted(trails: Trails, ways: Ways) -> None:
    """Allow any insertions here."""
    changed = True
    while changed:
        changed = False
        for a, b in WRITTEN:
            if ways[a] is not None:
                changed |= _better(trails, ways, b, ways[a][0] + INSERT, ways[a][1], "I")


def edited(trails: Trails, ways: Ways, initial: str, must_go: bool, truncated: bool) -> Ways:
    """The ways after one more row, insertions before it included."""
    inserted(trails, ways)
    out: Ways = [None] * 4
    for state, way in enumerate(ways):
        if way is not None:
            _better(trails, out, state, way[0] + DELETE, way[1], "D")
    if not must_go:
        for a, b in STEPS.get(initial, ()):
            if ways[a] is not None:
                _better(trails, out, b, ways[a][0] + truncated, ways[a][1], "K")
        for a, b in WRITTEN:
            if ways[a] is not None:
                _better(trails, out, b, ways[a][0] + REROLE + truncated, ways[a][1], "R")
    return out


BLOCKS = pa.schema(
    [("conv", pa.int64()), ("kind", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("seq", pa.int64()), ("text", pa.string()), ("copies", pa.int64())]
    + [("ways", pa.list_(pa.string())), ("costs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ends", pa.list_(pa.string())), ("turns", pa.list_(pa.int64()))]
)
BLOCK_DDL = (
    "conv long, kind int, turn long, role string, digest binary, seq long, text string, copies long, "
    "ways array<string>, costs array<long>, counts array<long>, ends array<string>, turns array<long>"
)


class Block:
    """A run of a conversation's rows: counts, and the cheapest ways from each state."""

    def __init__(self, conv, turn, role, digest, seq, first: bool):
        self.key = (conv, 1, turn, role, digest, seq)
        self.conv, self.trails, self.rows = conv, Trails(), 0
        self.ways: list[Ways] = [[(0, 0) if s == t else None for t in range(4)] for s in ([START] if first else range(4))]
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.head, self.tail = None, None
        self.turns: list = []  # smallest, largest, number of different ones

    def add(self, turn, role: str, blank: bool, truncated: bool, duplicate: bool) -> None:
        initial = role[:1]
        if self.tail is None:
            self.head = initial
        elif self.tail + initial not in LEGAL:
            self.illegal += 1
        self.tail = initial
        duplicate = duplicate and not blank
        truncated = truncated and not blank and not duplicate
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns = [self.turns[0], turn, self.turns[2] + 1]
        self.ways = [edited(self.trails, ways, initial, blank or duplicate, truncated) for ways in self.ways]
        self.rows += 1

    def row(self) -> tuple:
        ways = [w for start in self.ways for w in start]
        return (
            *self.key, None, None,
            [None if w is None else self.trails.path(w[1]) for w in ways], [None if w is None else w[0] for w in ways],
            [self.blank, self.duplicate, self.truncated, self.illegal], [self.head, self.tail], self.turns,
        )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), BLOCKS)], schema=BLOCKS)


def _blocks(size: int):
    """Rows sorted by conversation and place, as blocks of at most ``size`` rows.

    A content's first place comes as a row of its own without copies, next to the
    row of the same place.
    """

    def merged(batches: Iterator[pa.RecordBatch]):
        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and row[:4] == last[:4]:
                    last = (*row[:4], last[4] + row[4], last[5] or row[5], last[6] or row[6], last[7] or row[7])
                else:
                    if last is not None:
                        yield last
                    last = row
        if last is not None:
            yield last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, block, seq, held = [], None, 0, 0
        for at, (conv, turn, role, digest, copies, blank, truncated, first) in enumerate(merged(batches)):
            for copy in range(copies):
                if block is None or block.conv != conv or block.rows >= size:
                    if block is not None:
                        out.append(block.row())
                        held += block.rows
                    # where a task begins, an earlier one may hold the head of the conversation
                    opens = at > 0 and (block is None or block.conv != conv)
                    block, seq = Block(conv, turn, role, digest, seq, opens), seq + 1
                    if held >= 10_000:
                        yield _batch(out)
                        out, held = [], 0
                block.add(turn, role, blank, truncated, copy > 0 or not first)
        if block is not None:
            out.append(block.row())
        if out:
            yield _batch(out)

    return run


class Repair:
    """Chains a conversation's blocks, then hashes its rows as edited."""

    def __init__(self, conv):
        self.conv, self.trails = conv, Trails()
        self.ways: Ways = [(0, 0), None, None, None]
        self.done: list[str] = []
        self.counts, self.tail, self.turns, self.cost = [0, 0, 0, 0], None, [], 0
        self.audit: str | None = None
        self.at = self.written = 0
        self.system = False
        self.hash = hashlib.sha256()

    def chain(self, ways, costs, counts, ends, turns) -> None:
        out: Ways = [None] * 4
        for i, (letters, cost) in enumerate(zip(ways, costs)):
            start, state = divmod(i, 4)
            if cost is not None and self.ways[start] is not None:
                _better(self.trails, out, state, self.ways[start][0] + cost, self.ways[start][1], letters)
        base = self.trails.common([w[1] for w in out if w])
        self.done.append(self.trails.path(base))
        fresh = Trails()
        self.ways = [w and (w[0], fresh.extend(0, self.trails.path(w[1], base))) for w in out]
        self.trails = fresh
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        if self.tail is not None and self.tail + ends[0] not in LEGAL:
            self.counts[3] += 1
        self.tail = ends[1]
        if turns and self.turns:
            self.turns = [self.turns[0], turns[1], self.turns[2] + turns[2] - (self.turns[1] == turns[0])]
        else:
            self.turns = turns or self.turns

    def settle(self) -> None:
        if self.audit is None:
            inserted(self.trails, self.ways)
            best = None
            for state in FINAL:
                way = self.ways[state]
                if way and (best is None or (way[0] < best[0]) or (way[0] == best[0] and self.trails.less(way[1], best[1]))):
                    best = way
            self.cost, self.audit = best[0], "".join(self.done) + self.trails.path(best[1])
            self.done = []

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.written or self.system else ''}{role}:{text}".encode())

    def _insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._turn("")
            self.at += 1

    def _turn(self, text: str) -> None:
        self._write(("user", "assistant")[self.written % 2], text)
        self.written += 1

    def pass_by(self, role: str, text: str) -> None:
        """The next row of the conversation."""
        self.settle()
        self._insertions()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            self._turn(text)
        elif edit == "K":
            if role[:1] == "s":
                self._write(role, text)
                self.system = True
            else:
                self._write(role, text)
                self.written += 1

    def row(self) -> tuple:
        self.settle()
        self._insertions()
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return (self.conv, gaps, *self.counts, self.cost, self.audit, self.hash.hexdigest())


RESULT = pa.schema(
    [("conv", pa.int64())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every conversation a mark, its blocks in order, then its rows in order."""
    current, out = None, []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv", "kind", "role", "text", "copies", "ways", "costs", "counts", "ends", "turns")]
        for conv, kind, role, text, copies, *block in zip(*columns):
            if kind == 0:
                if current is not None:
                    out.append(current.row())
                current = Repair(conv)
            elif kind == 1:
                current.chain(*block)
            else:
                for _ in range(copies):
                    current.pass_by(role, text)
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), RESULT)], schema=RESULT)
            out = []
    if current is not None:
        out.append(current.row())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), RESULT)], schema=RESULT)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, copies`` after the damage that crc32 of conversation and turn decides; nulls read as one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
        (kind == 0).alias("gone"),
    ).filter("NOT gone").drop("gone")


def repair(rows: DataFrame, conversations: DataFrame, block_rows: int = 2048) -> DataFrame:
    """Faults, cheapest edits and a digest of the repaired rows, one row for each of ``conversations(conv)``.

    ``rows`` are ``conv, turn, role, text, copies`` without nulls but in ``conv``
    and ``turn``; ``copies`` equal rows stand next to each other.  A conversation's
    rows are in the order of their turns, null before all others; rows of one turn
    by role, then by the SHA-256 of their text, equal rows together.  A null
    conversation is one of its own.  A role that is empty or begins with none of
    s, u, a can't be kept.  One without rows has zeros, no edits and the digest of
    the empty string.  An empty ``conversations`` gives no rows.

    ``block_rows`` bounds the rows whose edits a task holds as linked nodes.
    """
    body = F.col("text")
    facts = rows.select(
        "conv", "turn", "role", F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), "copies", body.rlike(BLANK).alias("blank"), body.rlike(TRUNCATED).alias("truncated")
    )
    fine = facts.groupBy("conv", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.bool_or("blank").alias("blank"), F.bool_or("truncated").alias("truncated"))
    fine = materialise(fine.withColumn("first", F.lit(False)), "facts")
    # where a content stands first: a struct, as a null turn is the smallest there
    firsts = fine.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("at"))
    firsts = firsts.select("conv", F.col("at.turn").alias("turn"), "role", "digest", F.lit(0).cast("long").alias("copies"), F.lit(False).alias("blank"), F.lit(False).alias("truncated"), F.lit(True).alias("first"))
    place = ["conv", "turn", "role", "digest"]
    line = fine.unionByName(firsts).repartitionByRange(*place).sortWithinPartitions(*place)
    blocks = materialise(line.mapInArrow(_blocks(block_rows), BLOCK_DDL), "audits")
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in blocks.schema}

    def shaped(frame: DataFrame, **given) -> DataFrame:
        return frame.select(*(given[n].alias(n) if n in given else empty[n] for n in blocks.columns))

    marks = shaped(conversations.select("conv").distinct(), conv=F.col("conv"), kind=F.lit(0))
    digest = F.unhex(F.sha2(body.cast("binary"), 256))
    texts = shaped(rows, kind=F.lit(2), digest=digest, **{c: F.col(c) for c in ("conv", "turn", "role", "text", "copies")})
    order = ["conv", "kind", "turn", "role", "digest", "seq"]
    streams = marks.unionByName(blocks).unionByName(texts).repartition("conv").sortWithinPartitions(*order)
    kinds = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return streams.mapInArrow(_repaired, kinds)


def op11_persistent_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Repair of every conversation after the given damage.

    Null conversations, turns, roles and texts read as one space in the damage's
    key and in roles and texts; such a text is blank, such a role illegal.  Repeated
    rows are duplicates of each other.  See :func:`repair` for order and empty input.
    """
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    return repair(damaged(rows), rows.select(F.col("conv_id").cast("long").alias("conv"))).withColumnRenamed("conv", "conv_id")
