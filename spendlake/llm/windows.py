"""Repeated windows of a fixed length, found in minimiser buckets.

A document is a sequence of units (words or bytes); a window is ``size`` units in
a row.  Each window has a minimiser, the smallest hash of the ``gram`` units long
pieces inside it, which depends on the window's content alone, so equal windows
share it.  Consecutive windows with the same minimiser travel together as one packed
string to the bucket of that hash.

Map side: packed strings that a task has met before leave it as marks at once, so a
group of copies sends each string once per task.  Bucket side: equal strings are found
in a table of complete contents, and the different strings that share a minimiser
are compared window by window (:func:`window_classes`), exactly.  What comes out
are marks: runs of windows that are repeats.

Memory: a task holds one chunk of text and its strings, or one bucket; the number
of buckets grows with the text.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import chunks, id_key

#: Bytes of text that a map task packs at a time, and those of one bucket (before compression).
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Bytes of different strings of a bucket that are compared at a time, whole minimisers.
COMPARED_BYTES = 2 << 20
#: Packed strings repeat the text about so many times.
EXPANSION = 3.2
POSITION_BITS = np.uint64(24)
MARKS, STRINGS = 0, 1

RECORD = np.dtype([("hash", "<u4"), ("id", "<i8"), ("key", "<i4"), ("start", "<i8"), ("windows", "<i4"), ("bytes", "<i4"), ("again", "?")])
SENT = pa.schema([("bucket", pa.int64()), ("kind", pa.int8()), ("payload", pa.binary())])
MARK = pa.schema([("id", pa.int64()), ("key", pa.int32()), ("start", pa.int64()), ("windows", pa.int32())])


@dataclass(frozen=True)
class Kind:
    """What a window is made of.

    ``words`` says whether units are the blank-separated words of a text or its bytes.  ``first_stays``: of equal windows
    the first one (smallest id, then start) is no repeat.  Documents of more than
    ``segment`` windows are taken in overlapping segments.
    """

    words: bool
    size: int
    gram: int
    first_stays: bool
    segment: int = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    """Hash of 64-bit values, one to one."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each word of a flat byte array; equal words have equal ones."""
    lengths = ends - starts
    within = np.arange(len(flat)) - np.repeat(np.r_[starts, len(flat)][:-1], np.diff(np.r_[starts, len(flat)]))
    weights = mixed(np.arange(1, 257, dtype=np.uint64))
    values = mixed(flat.astype(np.uint64) + np.uint64(1)) * (weights[within & 255] + (within >> 8).astype(np.uint64))
    values[ends[:-1]] = 0  # blanks
    return np.add.reduceat(values, starts) + mixed(lengths.astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def packed_strings(kind: Kind, segments: list[tuple[bytes, int]]) -> tuple[bytes, np.ndarray]:
    """Packed strings of segments ``(canonical bytes, number of units)``.

    Returns the bytes they are slices of and rows of (segment, first unit, windows,
    byte from, byte to, minimiser, whether the minimiser lies there more than once).
    """
    flat = b" ".join(s for s, _ in segments)
    raw = np.frombuffer(flat, dtype=np.uint8)
    n = np.array([k for _, k in segments], dtype=np.int64)
    with np.errstate(over="ignore"):
        if kind.words:
            blanks = np.flatnonzero(raw == 32)
            from_, to = np.r_[0, blanks + 1], np.r_[blanks, len(raw)]
            units = word_hashes(raw, from_, to)
            first = np.cumsum(n) - n
        else:
            from_ = np.arange(len(raw))
            to = from_ + 1
            units = raw.astype(np.uint64)
            first = np.cumsum(n + 1) - n - 1  # a blank lies between segments
        if len(units) < kind.size:
            return flat, np.zeros((0, 7), dtype=np.int64)
        grams, have, factor = mixed(units + np.uint64(1)), 1, np.uint64(0xD6E8FEB86659FD93)
        while have < kind.gram:  # a gram's hash from those of its two halves, which may overlap
            step = min(have, kind.gram - have)
            grams = grams[:-step] * factor + grams[step:]
            have, factor = have + step, factor * factor + np.uint64(2)
        grams = mixed(grams)
        tag = (grams >> POSITION_BITS << POSITION_BITS) | (np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << 24) - 1))
    least = sliding_min(tag, kind.size - kind.gram + 1)
    valid = np.repeat(first, np.maximum(n - kind.size + 1, 0))
    at = valid + np.arange(len(valid)) - np.repeat(np.cumsum(np.maximum(n - kind.size + 1, 0)) - np.maximum(n - kind.size + 1, 0), np.maximum(n - kind.size + 1, 0))
    if not len(at):
        return flat, np.zeros((0, 7), dtype=np.int64)
    owner = np.repeat(np.arange(len(n)), np.maximum(n - kind.size + 1, 0))
    least = least[at]
    value = least >> POSITION_BITS
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
    moved = np.cumsum(np.r_[False, least[1:] != least[:-1]])
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(at)] - 1
    again = (moved[tail] != moved[head]) | (len(grams) >= 1 << 24)
    rows = np.stack([owner[head], at[head] - first[owner[head]], tail - head + 1, from_[at[head]], to[at[tail] + kind.size - 1], value[head].astype(np.int64), again.astype(np.int64)], axis=1)
    return flat, rows


def segments_of(kind: Kind, text: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(canonical bytes, units, offset of the first unit) for each segment of a text."""
    units = text.split() if kind.words else text  # bytes: ASCII white space only
    for offset in range(0, max(len(units) - kind.size + 1, 0), kind.segment):
        part = units[offset : offset + kind.segment + kind.size - 1]
        yield (b" ".join(part) if kind.words else part), len(part), offset


def _send(kind: Kind, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for table in chunks(batches, "text", CHUNK_BYTES):
            found: list[tuple] = []  # hash, id, key, start, windows, bytes, again
            strings: list[bytes] = []
            tags: list[int] = []
            held, owners, size = [], [], 0

            def work():
                flat, rows = packed_strings(kind, held)
                for s, unit, windows, a, b, value, again in rows.tolist():
                    key, text_key, offset = owners[s]
                    tags.append(value)
                    found.append((value & 0xFFFFFFFF, key, text_key, offset + unit, windows, b - a, again))
                    strings.append(flat[a:b])

            for key, text_key, text in zip(*(table.column(c).to_pylist() for c in ("id", "key", "text"))):
                for body, n, offset in segments_of(kind, text or b""):
                    held.append((body, n))
                    owners.append((key, text_key, offset))
                    size += len(body)
                    if size > 1 << 19:
                        work()
                        held, owners, size = [], [], 0
            if held:
                work()
            if not found:
                continue
            records = np.array(found, dtype=RECORD)
            keep, marks = first_of_equal(kind, records, strings)
            if len(marks):
                # any bucket will do for what is settled
                yield _batch([(int(marks["id"][0]) % buckets, MARKS, marks.tobytes())])
            bucket = np.array(tags, dtype=np.int64)[keep] % buckets
            order = np.argsort(bucket, kind="stable")
            keep, bucket = keep[order], bucket[order]
            heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            out = []
            for first, last in zip(heads, np.r_[heads[1:], len(bucket)]):
                own = keep[first:last]
                body = struct.pack("<I", len(own)) + columnar(records[own]) + b"".join([strings[i] for i in own.tolist()])
                out.append((int(bucket[first]), STRINGS, squeeze.compress(body)))
                if len(out) == 1000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), SENT)], schema=SENT)


def columnar(records: np.ndarray) -> bytes:
    """Column after column, which compresses better."""
    return b"".join(np.ascontiguousarray(records[name]).tobytes() for name in RECORD.names)


def from_columnar(body: bytes, n: int, at: int) -> np.ndarray:
    records = np.empty(n, dtype=RECORD)
    for name in RECORD.names:
        records[name] = np.frombuffer(body, dtype=RECORD[name], count=n, offset=at)
        at += n * RECORD[name].itemsize
    return records


def first_of_equal(kind: Kind, records: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of equal strings, by id and start, and the marks of the others.

    Every window of a later copy repeats one of the first copy.  Where the first
    is a repeat too, it is marked as well.
    """
    order = np.lexsort((records["start"], records["id"]))
    ids, keys, starts = (records[n].tolist() for n in ("id", "key", "start"))
    seen: dict[bytes, int] = {}
    firsts, later, pairs = [], [], set()
    for i in order.tolist():
        first = seen.setdefault(strings[i], i)
        if first == i:
            firsts.append(i)
        elif not kind.first_stays:
            later.append(i)
            pairs.add(first)
        elif (ids[i], starts[i]) != (ids[first], starts[first]):
            later.append(i)
        elif keys[i] != keys[first]:  # another text of the same id: neither is earlier
            firsts.append(i)
    marked = records[np.array(later + sorted(pairs), dtype=np.int64)]
    return np.array(firsts, dtype=np.int64), marked


def window_classes(ids: np.ndarray, ends: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of windows that are not alone, and their class.

    Bucket-pointer refinement: ``ids`` names each position's bucket by its first
    ``width`` units.  Positions of a bucket are told apart by sorting on the bucket
    of the position ``width`` units later, which doubles the width known; the new
    buckets serve the next round, recursively, until ``size`` units are compared.
    A position alone in its bucket needs no further look, and its bucket still tells
    others apart.  ``ends`` is the end of each position's string.
    """
    ids = ids.astype(np.uint64)
    active = np.flatnonzero(np.arange(len(ids)) + size <= ends)
    # buckets of later offsets are needed wherever a window can reach
    alive = np.flatnonzero(np.arange(len(ids)) + width <= ends)
    while width < size:
        step = min(width, size - width)
        last = width + step >= size
        todo = active if last else alive[alive + width + step <= ends[alive]]
        pair = ids[todo] << np.uint64(32) | ids[todo + step]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        fresh = np.r_[True, pair[1:] != pair[:-1]] if len(pair) else np.zeros(0, dtype=bool)
        alone = fresh & np.r_[fresh[1:], True] if len(pair) else fresh
        base = np.uint64(int(ids.max()) + 1 if len(ids) else 0)
        place = todo[order]
        renamed = ids.copy()
        renamed[place] = base + np.cumsum(fresh).astype(np.uint64)
        if int(renamed.max(initial=0)) >= 1 << 32:
            _, renamed = np.unique(renamed, return_inverse=True)
            renamed = renamed.astype(np.uint64)
        ids, width = renamed, width + step
        many = np.zeros(len(ids), dtype=bool)
        many[place[~alone]] = True
        active = active[many[active]]
        alive = alive[many[alive]]
    names, classes, counts = np.unique(ids[active], return_inverse=True, return_counts=True)
    return active[counts[classes] > 1], classes[counts[classes] > 1]


def _units(kind: Kind, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Bucket of each position by its first units, end of its string, its string, and the width compared."""
    if kind.words:
        names: dict[bytes, int] = {}
        split = [s.split(b" ") for s in strings]
        flat = [names.setdefault(w, len(names)) for words in split for w in words]
        ids, lengths, width = np.array(flat, dtype=np.int64), np.array([len(w) for w in split]), 1
    else:
        flat = b"".join(strings)
        lengths = np.array([len(s) for s in strings])
        width = 8
        eight = np.ndarray((len(flat),), dtype="<u8", buffer=flat + bytes(8), strides=(1,))
        _, ids = np.unique(eight, return_inverse=True)
    ends = np.repeat(np.cumsum(lengths), lengths)
    return ids, ends, np.repeat(np.arange(len(strings)), lengths), width


def settle(kind: Kind, records: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Marks of one bucket."""
    order = np.argsort(records["hash"], kind="stable")
    hashes = records["hash"][order]
    fresh = np.r_[True, hashes[1:] != hashes[:-1]]
    alone = fresh & np.r_[fresh[1:], True] & ~records["again"][order]
    chosen = order[~alone]
    if not len(chosen):
        return records[:0]
    records, strings = records[chosen], [strings[i] for i in chosen.tolist()]
    firsts, marks = first_of_equal(kind, records, strings)
    _, group = np.unique(records["hash"][firsts], return_inverse=True)
    several = (np.bincount(group)[group] > 1) | records["again"][firsts]
    firsts, group = firsts[several], group[several]
    order = np.argsort(group, kind="stable")
    firsts, group = firsts[order], group[order]
    found, first = [marks], 0
    sizes = np.cumsum(records["bytes"][firsts], dtype=np.int64)
    while first < len(firsts):
        enough = int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + COMPARED_BYTES, side="right"))
        last = int(np.searchsorted(group, group[min(max(enough - 1, first), len(firsts) - 1)], side="right"))
        own = firsts[first:last]
        found.append(_compare(kind, records[own], [strings[i] for i in own.tolist()]))
        first = last
    return np.concatenate(found)


def _compare(kind: Kind, records: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Marks of different strings, window by window."""
    ids, ends, owner, width = _units(kind, strings)
    at, classes = window_classes(ids, ends, width, kind.size)
    if not len(at):
        return records[:0]
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    string = owner[at]
    start = records["start"][string] + at - heads[string]
    if kind.first_stays:
        identity = records["id"][string]
        order = np.lexsort((start, identity, classes))
        c, i, s = classes[order], identity[order], start[order]
        head = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])[np.cumsum(np.r_[True, c[1:] != c[:-1]]) - 1]
        repeat = np.zeros(len(at), dtype=bool)
        repeat[order] = (i != i[head]) | (s != s[head])
        at, string, start = at[repeat], string[repeat], start[repeat]
        if not len(at):
            return records[:0]
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (string[1:] != string[:-1])]
    head = np.flatnonzero(new)
    more = records[string[head]]
    more["start"] = start[head]
    more["windows"] = np.diff(np.r_[head, len(at)])
    return more


def _receive(kind: Kind):
    def rows(marks: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(marks[n], t.type) for n, t in zip(("id", "key", "start", "windows"), MARK)], schema=MARK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        bucket, records, strings = None, [], []

        def settled():
            if records:
                yield rows(settle(kind, np.concatenate(records), strings))
                records.clear()
                strings.clear()

        for batch in batches:
            for b, what, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if what == MARKS:
                    yield rows(np.frombuffer(payload, dtype=RECORD))
                    continue
                if b != bucket:
                    yield from settled()
                    bucket = b
                body = loosen.decompress(payload)
                n = struct.unpack_from("<I", body)[0]
                own = from_columnar(body, n, 4)
                at = 4 + n * RECORD.itemsize
                ends = np.cumsum(own["bytes"]).tolist()
                strings += [body[at + a : at + z] for a, z in zip([0, *ends], ends)]
                records.append(own)
        yield from settled()

    return run


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``key`` (a hash of the text, which tells rows of one id apart) and ``text`` as bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_key(id_col).alias("id"), F.hash(text).alias("key"), text.cast("binary").alias("text"))


def repeats(rows: DataFrame, kind: Kind) -> DataFrame:
    """Marks ``id, key, start, windows`` of all repeated windows in ``rows`` (see :func:`identified`)."""
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, int(total * EXPANSION / BUCKET_BYTES))
    sent = rows.mapInArrow(_send(kind, buckets), "bucket long, kind byte, payload binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_receive(kind), "id long, key int, start long, windows int")


def covered(n: int, marks: list, size: int) -> np.ndarray:
    """True for each of ``n`` units that a marked window covers."""
    change = np.zeros(n + 1, dtype=np.int64)
    if marks:
        start, windows = np.array(marks, dtype=np.int64).T
        np.add.at(change, start, 1)
        np.add.at(change, np.minimum(start + windows + size - 1, n), -1)
    return np.cumsum(change[:-1]) > 0


def with_marks(rows: DataFrame, marks: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish`` over batches of ``id, text, starts, windows`` of every row."""
    found = marks.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    joined = rows.join(found.hint("shuffle_hash"), (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return joined.select("id", "text", F.col("marks.start").alias("starts"), F.col("marks.windows").alias("windows")).mapInArrow(finish, schema)
