"""Near-duplicate embeddings by dual traversal of cover trees.

Unit vectors at cosine ``c`` are at distance sqrt(2 - 2c), so links are pairs within
a distance.  The top level of the tree are pivots with exact covering radii, found
by one pass over all vectors; pairs of pivots further apart than their radii and
the threshold are dropped.  The vectors of a pivot form blocks of bounded size,
each with a cover tree of its own: nested levels of centres with halving radii.
Blocks are dealt to stripes, and a task takes the square of two stripes: it holds the
blocks of one and reads those of the other one by one, so a block is sent once for
each stripe, not for each block that it meets.  Two blocks meet by walking both
trees together.  The walk drops a pair of nodes by the covering radii, takes a pair
whole where the radii prove that all of its vectors link, and compares the rest in
double precision.

Equal vectors are one point with a weight, so a group of copies costs nothing.
Where vectors are spread out evenly in many dimensions no bound can separate the
pivots and all blocks meet: the number of block pairs then grows with the square
of the vectors, as for any exact method.  What is sent does not, up to ``STRIPES``
times ``HELD`` blocks; beyond, a ``HELD``-th of the pairs counts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm.common import Forest, Scratch, components, id_back, id_key, materialise

COSINE = 0.95
#: Points of a block, and pivots at most.
BLOCK = 4096
PIVOTS = 1024
#: Stripes that blocks are dealt to, more only where a stripe would have more blocks than a task holds.
STRIPES = 8
HELD = 64
#: Points of a leaf, and the radius below which nodes are not divided.
LEAF = 16
FINEST = 2.0**-12
#: Pairs of points that a matrix product compares in the time of one step from node to node.
STEP = 4000
#: Room for rounding in bounds on distances.
SLACK = 2e-3


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


@dataclass
class Tree:
    """Nodes as arrays: centre, covering radius, members ``order[first:last]``, and children ``child[kids_first:kids_last]``."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    kids_first: np.ndarray
    kids_last: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Tree:
        """Nested nets: a node's centre is also the first centre of the level below it."""
        points = points.astype(np.float32)
        order, nodes = np.arange(len(points)), []
        # (members' place, centre, radius of the level); children stand together, behind their parents
        todo = [(0, len(points), 0, 2.0)]
        while todo:
            following = []
            for first, last, centre, level in todo:
                members = order[first:last]
                gap = distances(points[members], points[centre][None])[:, 0]
                node = [centre, float(gap.max()), first, last, 0, 0]
                nodes.append(node)
                if last - first > LEAF and level > FINEST and node[1] > FINEST:
                    following.append((node, first, members, centre, level / 2))
            todo = []
            base = len(nodes)
            for node, first, members, centre, level in following:
                own = points[members]
                centres, near, best = [], np.zeros(len(members), dtype=np.int64), np.full(len(members), np.inf, dtype=np.float32)
                free = np.ones(len(members), dtype=bool)
                pick = int(np.flatnonzero(members == centre)[0])
                while True:
                    gap = distances(own, own[pick][None])[:, 0] if len(members) > BLOCK else _row(own, pick)
                    better = gap < best
                    near[better], best[better] = len(centres), gap[better]
                    near[pick] = len(centres)
                    best[pick] = -1.0
                    centres.append(int(members[pick]))
                    free &= gap > level
                    free[pick] = False
                    left = np.flatnonzero(free)
                    if not len(left):
                        break
                    pick = int(left[0])
                shuffle = np.argsort(near, kind="stable")
                order[first : first + len(members)] = members[shuffle]
                ends = first + np.cumsum(np.bincount(near, minlength=len(centres)))
                node[4] = base + len(todo)
                todo += [(a, z, c, level) for a, z, c in zip([first, *ends[:-1].tolist()], ends.tolist(), centres)]
                node[5] = base + len(todo)
        table = list(zip(*nodes))
        return cls(order, *(np.array(table[i], dtype=np.float64 if i == 1 else np.int64) for i in range(6)))


    def cut(self, root: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The subtree as nodes within ``radius`` and single points: centres, radii, and the node or -1."""
        centres, radii, nodes, todo = [], [], [], [root]
        while todo:
            n = todo.pop()
            if self.last[n] - self.first[n] > 1 and 2 * self.radius[n] + SLACK <= 2 * radius:
                centres.append(self.centre[n : n + 1])
                radii.append(self.radius[n : n + 1])
                nodes.append(np.array([n]))
            elif self.kids_last[n] > self.kids_first[n]:
                todo += range(self.kids_first[n], self.kids_last[n])
            else:
                own = self.order[self.first[n] : self.last[n]]
                centres.append(own)
                radii.append(np.zeros(len(own)))
                nodes.append(np.full(len(own), -1))
        return np.concatenate(centres), np.concatenate(radii), np.concatenate(nodes)


def _row(points: np.ndarray, i: int) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (points @ points[i]), 0.0))


@dataclass
class Block:
    node: np.ndarray
    weight: np.ndarray
    unit: np.ndarray
    tree: Tree

    @staticmethod
    def pack(node: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> bytes:
        """The points as they were given, in single precision if that holds them, with their tree."""
        tree = Tree.of(units(vectors))
        short = Tree(*(x if x.dtype.kind == "f" else x.astype(np.int32) for x in vars(tree).values()))
        with np.errstate(over="ignore"):
            single = vectors.astype(np.float32)
        given = single if (single == vectors).all() else vectors
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((node, weight, given, short), protocol=5))

    @staticmethod
    def unpack(payload: bytes) -> Block:
        node, weight, given, short = pickle.loads(zstandard.ZstdDecompressor().decompress(payload))
        tree = Tree(*(x if x.dtype.kind == "f" else x.astype(np.int64) for x in vars(short).values()))
        return Block(node, weight, units(given.astype(np.float64)), tree)


def traverse(a: Block, b: Block | None, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links between two blocks, or within one if ``b`` is None.

    Returns for the points of ``a``, and of ``b``, the weight of the points they
    link with, and pairs of points (``b``'s behind ``a``'s) that connect all linked ones.
    """
    limit = sqrt(2 - 2 * cosine)
    same = b is None
    b = a if same else b
    na = len(a.node)
    offset = 0 if same else na
    found = np.zeros(na), np.zeros(len(b.node))
    forest, edges = Forest(na if same else na + len(b.node)), []
    small = a.unit.astype(np.float32), b.unit.astype(np.float32)

    def connect(x: np.ndarray, y: np.ndarray):
        labels = forest.parent
        fresh = labels[x] != labels[y]
        if fresh.any():
            edges.extend(forest.join(x[fresh], y[fresh]))

    def whole(p: np.ndarray, q: np.ndarray):
        """All pairs of the two lists link."""
        found[0][p] += b.weight[q].sum()
        found[1][q] += a.weight[p].sum()
        connect(np.full(len(q), p[0]), q + offset)
        connect(p, np.full(len(p), q[0] + offset))

    def compare(x: np.ndarray, y: np.ndarray):
        """Pairs of points one by one, in double precision."""
        for first in range(0, len(x), 1 << 17):
            p, q = x[first : first + (1 << 17)], y[first : first + (1 << 17)]
            hit = np.einsum("ij,ij->i", a.unit[p], b.unit[q]) >= cosine
            p, q = p[hit], q[hit]
            if not len(p):
                continue
            np.add.at(found[0], p, b.weight[q])
            np.add.at(found[1], q, a.weight[p])
            connect(p, q + offset)

    def block(p: np.ndarray, q: np.ndarray, own: bool):
        """All pairs of two lists of points; of a list with itself each pair once."""
        for first in range(0, len(p), 1024):
            gap = distances(small[0][p[first : first + 1024]], small[1][q]) <= limit + SLACK
            if own:
                gap &= np.arange(first, first + len(gap))[:, None] < np.arange(len(q))[None]
            i, j = np.nonzero(gap)
            compare(p[first + i], q[j])

    def near(x, y, rx, ry):
        """Bounds of a list of nodes against another: which pairs may link."""
        reach = rx.astype(np.float32)[:, None] + ry.astype(np.float32)[None] + np.float32(limit + SLACK)
        reach *= reach
        return small[0][x] @ small[1][y].T >= 1 - reach / 2

    def dense(n: int, m: int, own: bool):
        """The finest useful nodes of two subtrees, all against all."""
        (x, rx, nx), (y, ry, ny) = a.tree.cut(n, limit / 2), b.tree.cut(m, limit / 2)
        for first in range(0, len(x), 1024):
            part = slice(first, first + 1024)
            hit = near(x[part], y, rx[part], ry)
            if own:
                hit &= np.arange(first, first + len(hit))[:, None] <= np.arange(len(y))[None]
            i, j = np.nonzero(hit)
            i += first
            single = (nx[i] < 0) & (ny[j] < 0)
            apart = single & ~(own & (i == j))
            compare(x[i[apart]], y[j[apart]])
            for k, l in zip(i[~single].tolist(), j[~single].tolist()):
                p = members(a, nx[k]) if nx[k] >= 0 else x[k : k + 1]
                q = members(b, ny[l]) if ny[l] >= 0 else y[l : l + 1]
                if own and k == l:
                    inside(p)
                elif sqrt(max(0.0, 2 - 2 * float(small[0][x[k]] @ small[1][y[l]]))) + rx[k] + ry[l] + SLACK <= limit:
                    whole(p, q)
                else:
                    block(p, q, False)

    def inside(p: np.ndarray):
        """Points of a node of at most half the limit's radius all link with each other."""
        if len(p) > 1:
            block(p, p, True) if len(p) <= LEAF else spread(p)

    def spread(p: np.ndarray):
        found[0][p] += a.weight[p].sum() - a.weight[p]
        connect(np.full(len(p), p[0]), p)

    members = lambda side, n: side.tree.order[side.tree.first[n] : side.tree.last[n]]
    stack = [(0, 0)] if na and len(b.node) else []
    while stack:
        n, m = stack.pop()
        own = same and n == m
        p, q = members(a, n), members(b, m)
        ra, rb = a.tree.radius[n], b.tree.radius[m]
        if own and 2 * ra + SLACK <= limit:
            spread(p)
            continue
        if not own:
            gap = float(distances(small[0][a.tree.centre[n]][None], small[1][b.tree.centre[m]][None])[0, 0])
            if gap > ra + rb + limit + SLACK:
                continue
            if gap + ra + rb + SLACK <= limit:
                whole(p, q)
                continue
        kids_a = np.arange(a.tree.kids_first[n], a.tree.kids_last[n])
        kids_b = np.arange(b.tree.kids_first[m], b.tree.kids_last[m])
        if len(p) * len(q) <= LEAF * LEAF or not (len(kids_a) or len(kids_b)):
            block(p, q, own)
            continue
        kids_a = kids_a if len(kids_a) else np.array([n])
        kids_b = kids_b if len(kids_b) else np.array([m])
        x, y = a.tree.centre[kids_a], b.tree.centre[kids_b]
        rx, ry = a.tree.radius[kids_a], b.tree.radius[kids_b]
        # where bounds at this level prune little, walking pair by pair costs more than the finest nodes at once
        some = np.arange(0, len(kids_a), max(1, len(kids_a) // 128))
        walk = near(x[some], y, rx[some], ry).mean() * len(kids_a) * len(kids_b)
        if walk > 64 + len(p) * len(q) / STEP:
            dense(n, m, own)
            continue
        hit = near(x, y, rx, ry)
        if own:
            hit &= kids_a[:, None] <= kids_b[None]
        i, j = np.nonzero(hit)
        stack += zip(kids_a[i].tolist(), kids_b[j].tolist())
    return (found[0] + found[1] if same else found[0]), found[1], edges


def _double(column):
    return F.transform(column, lambda x: x.cast("double"))


def _usable(vector):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _assign(pivots: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Nearest pivot of the same dimension, and the distance to it; -1 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, weights = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                vectors = flat[starts[at][:, None] + np.arange(size)]
                numbers, centres = pivots.get(size, (np.array([-1]), None))
                if centres is None:
                    best, gap = np.full(len(at), -1), np.full(len(at), 2.0)
                else:
                    gaps = distances(units(vectors), centres)
                    place = gaps.argmin(axis=1)
                    best, gap = numbers[place], gaps[np.arange(len(at)), place]
                raw = [v.tobytes() for v in vectors]
                columns = [nodes[at], weights[at], np.full(len(at), size), best, gap, raw]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["node", "weight", "dim", "pivot", "gap", "raw"])

    return run


def _plant(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One block with its tree."""
    vectors = np.stack([np.frombuffer(r, dtype=np.float64) for r in table.column("raw").to_pylist()])
    payload = Block.pack(table.column("node").to_numpy(), table.column("weight").to_numpy().astype(np.float64), vectors)
    return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "payload": pa.array([payload], pa.binary())})


def stripes(parts: list[int], partners: np.ndarray) -> tuple[int, list[int], list[list[int]]]:
    """How many stripes there are, each cell's first block, and the stripes that a cell's blocks meet.

    ``parts`` are the blocks of each cell, ``partners`` which cells can hold a link.
    Block ``i`` of all ``n`` blocks is in stripe ``i * stripes // n``.
    """
    total = sum(parts)
    count = min(total, max(STRIPES, ceil(total / HELD)))
    first = [end - n for end, n in zip(accumulate(parts), parts)]
    covers = [range(f * count // total, (f + n - 1) * count // total + 1) for f, n in zip(first, parts)]
    meets = [sorted({s for j in np.flatnonzero(row).tolist() for s in covers[j]}) for row in partners]
    return count, first, meets


def _links(a: Block, b: Block | None, cosine: float) -> pa.RecordBatch:
    left, right, edges = traverse(a, b, cosine)
    nodes, links = a.node, left
    if b is not None:
        nodes, links = np.r_[a.node, b.node], np.r_[left, right]
    some = links > 0
    x, y = (nodes[np.array([e[k] for e in edges], dtype=np.int64)] for k in (0, 1))
    none = np.full(len(x), None)
    columns = [pa.array(np.r_[nodes[some], x], pa.int64()), pa.array([None] * int(some.sum()) + y.tolist(), pa.int64()), pa.array(links[some].astype(np.int64).tolist() + none.tolist(), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])


def _squares(cosine: float, partners: np.ndarray):
    """All pairs of blocks of each square ``(lo, hi)``; its rows come together, stripe ``lo`` first, which is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, held = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                lo, hi, side, cell = (batch.column(i)[row].as_py() for i in range(4))
                if (lo, hi) != square:
                    square, held = (lo, hi), []
                block = Block.unpack(batch.column(4)[row].as_py())
                if side or lo == hi:
                    yield from (_links(other, block, cosine) for place, other in held if partners[place, cell])
                if lo == hi:
                    yield _links(block, None, cosine)
                if not side:
                    held.append((cell, block))

    return run


def near_vectors(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors link at cosine ``cosine`` or more.  Null, empty and zero vectors, and
    those with null or non-finite components, link with nothing; neither do
    vectors of different length.  ``component_id`` is the smallest id reachable,
    null ids below all others.  Rows that share an id are told apart by vector.
    """
    spark = rows.sparkSession
    held = rows.select(id_key(id_col).alias("id"), _double(F.col(vector_col)).alias("vector")).withColumn("usable", _usable(F.col("vector")))
    points = held.filter("usable").groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    points = materialise(points.withColumn("node", F.monotonically_increasing_id()), "points")
    count = points.count()
    wanted = min(PIVOTS, ceil(count / block))
    sample = points.orderBy(F.xxhash64("first"), "node").limit(wanted).select("vector").collect()
    by_size: dict[int, list[tuple[int, list[float]]]] = {}
    for i, r in enumerate(sample):
        by_size.setdefault(len(r[0]), []).append((i, r[0]))
    pivots = {size: (np.array([i for i, _ in own]), units(np.array([v for _, v in own]))) for size, own in by_size.items()}
    scratch = Scratch(spark)
    assigned = scratch.write(points.select("node", "weight", "vector").mapInArrow(_assign(pivots), "node long, weight long, dim int, pivot int, gap double, raw binary"), "assigned")
    # at most one row for each pivot and each length of vectors
    cells = assigned.groupBy("dim", "pivot").agg(F.max("gap"), F.count("*")).collect()
    cells = sorted((r[0], r[1], r[2], ceil(r[3] / block)) for r in cells)
    limit = sqrt(2 - 2 * cosine)
    centre = {(size, int(i)): c for size, (numbers, cs) in pivots.items() for i, c in zip(numbers, cs)}
    partners = np.zeros((len(cells), len(cells)), dtype=bool)
    for i, (dim, pivot, radius, _) in enumerate(cells):
        for j, (other_dim, other, other_radius, _) in enumerate(cells):
            partners[i, j] = dim == other_dim and (i == j or float(distances(centre[dim, pivot][None], centre[dim, other][None])[0, 0]) <= radius + other_radius + limit + SLACK)
    # rounding is no reason to meet on one side only
    partners |= partners.T
    total = sum(c[3] for c in cells)
    count, first, meets = stripes([c[3] for c in cells], partners) if cells else (1, [], [])
    plan = [(dim, pivot, i, parts, first[i], meets[i]) for i, (dim, pivot, _, parts) in enumerate(cells)]
    plan = F.broadcast(spark.createDataFrame(plan, "dim int, pivot int, cell int, parts int, first int, meets array<int>"))  # a row for each cell, as bounded as the cells
    dealt = assigned.join(plan.select("dim", "pivot", "cell", "parts"), ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    trees = scratch.write(dealt.select("cell", "part", "node", "weight", "raw").groupBy("cell", "part").applyInArrow(_plant, "cell int, part int, payload binary"), "trees")
    scratch.drop(assigned)
    stripe = F.expr(f"cast((first + part) * {count}L DIV {max(total, 1)}L AS int)")
    sent = trees.join(plan.select("cell", "first", "meets"), "cell").select("cell", "payload", stripe.alias("own"), F.explode("meets").alias("other"))
    sent = sent.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cell", "payload")
    sent = sent.repartition(count * (count + 1), "lo", "hi").sortWithinPartitions("lo", "hi", "side")
    met = materialise(sent.mapInArrow(_squares(cosine, partners), "a long, b long, n long"), "links")
    scratch.clear()
    roots = components(met.filter("b IS NOT NULL").select("a", "b"))
    links = met.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("of"), "n")
    known = points.join(links, F.col("node") == F.col("of"), "left").drop("of")
    known = known.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("vector", "first", "weight", "n", F.coalesce("root", "node").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("component"))
    known = known.join(least, "root").select(F.col("vector").alias("_vector"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    joined = held.withColumn("vector", F.when(F.col("usable"), F.col("vector"))).join(known, F.col("vector") == F.col("_vector"), "left")
    component = F.coalesce("component", "id")
    return joined.select(id_back(F.col("id")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), id_back(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def op9_covertree_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicates among all embeddings."""
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
