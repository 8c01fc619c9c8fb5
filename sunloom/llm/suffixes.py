"""Removal of repeated 50-byte strings with sharded suffix arrays (operator 4).

Every 50-byte string holds an anchor: the gram of smallest hash in it. Around an anchor stand the bytes that can share a
string with it, its cut. Places of anchors are dealt out by gram as packed numbers, not as rows. Where cuts are equal,
those in larger documents are covered whole, and one cut stays. Different cuts of a gram meet as bytes in shards; suffix
arrays over whole shards show the strings that cuts share, and the smallest document of each.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded, clean, keep, remove, slices, table, tidied, write

#: Bytes of a string, and of an anchor gram (a power of two); bytes of cuts that are sorted together at least; cuts of a shard at most.
SPAN, GRAM, CHUNK, HOT = 50, 16, 100_000, 20_000
#: Bytes of a text that are hashed together; rounds that the anchors are dealt to.
PIECE, ROUNDS = 1 << 20, 2
SIDE = SPAN - GRAM
HALF = SIDE // 2
#: Buckets of grams, groups of documents; places that a task looks through together at least.
BUCKETS, GROUPS, MANY = 4096, 256, 400_000
_MULT = 0x9E3779B1
#: What is known of a place of an anchor: hashes of gram and cut, where it is, bytes of the cut behind the gram, hashes of the bytes next to it.
_PLACE = {"fp": "<u8", "context": "<u8", "doc": "<i8", "row": "<i8", "at": "<i4", "right": "u1", "near": "<u4"}
#: A cut that is asked for, and a removed span.
_ASK = np.dtype([("doc", "<i8"), ("row", "<i8"), ("fp", "<u8"), ("context", "<u8"), ("at", "<i4"), ("right", "<i4")])
_GONE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("a", "<i4"), ("b", "<i4")])


def _moved(x: np.ndarray, by: int) -> np.ndarray:
    """x from item `by` on, with zeros behind."""
    return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def suffixes(s: np.ndarray, k: int, depth: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array of s, for each of its items whether it differs from the one before), by the first `depth` symbols.

    Symbols are 0 to k - 1; the end counts as 0. Ranks of prefixes are doubled; of: the suffixes that are sorted, else all.
    """
    of, bits = np.arange(len(s)) if of is None else of, max(1, (k - 1).bit_length())
    key, size = s.astype(np.uint64), 1
    while size * 2 * bits <= 64 and size * 2 <= depth:
        key = key << np.uint64(size * bits) | _moved(key, size)
        size *= 2
    while size < depth:
        order = np.argsort(key)
        rank = np.empty(len(s), np.uint64)
        rank[order] = np.cumsum(_firsts(key[order]), dtype=np.uint64)
        step = min(size, depth - size)
        key, size = rank << np.uint64(32) | _moved(rank, step), size + step
    order = np.argsort(key[of])
    return of[order], _firsts(key[of][order])


def suffix_array(s: list[int], k: int) -> list[int]:
    """The suffix array of s, whose symbols are 1 to k - 1."""
    return suffixes(np.array(s, np.uint64), k, len(s))[0].tolist()


def common_prefixes(s: list[int], sa: list[int]) -> list[int]:
    """For each position of s the prefix that its suffix shares with the one before it in the suffix array."""
    n = len(s)
    before, out, h = [-1] * n, [0] * n, 0
    for a, b in zip(sa, sa[1:], strict=False):
        before[b] = a
    for i in range(n):
        j = before[i]
        if j < 0:
            h = 0
            continue
        while i + h < n and j + h < n and s[i + h] == s[j + h]:
            h += 1
        out[i] = h
        h = h - 1 if h else 0
    return out


def first_docs(data: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, cut, smallest document that has it) of each SPAN-byte string of the cuts that make up data."""
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    whole = np.flatnonzero(np.arange(len(data)) + SPAN <= ends[owner])
    order, new = suffixes(data, 256, SPAN, whole)
    first = np.flatnonzero(new)
    low = np.zeros(len(data), np.int64)
    if len(first):
        low[order] = np.repeat(np.minimum.reduceat(docs[owner[order]], first), np.diff(first, append=len(order)))
    return whole, owner[whole], low[whole]


def _slid(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (minimum or maximum) of each run of w items, by doubling."""
    n, size = len(x), 1
    while size * 2 <= w:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: n - w + 1], x[w - size : w - size + n - w + 1])


def _hashes(b: np.ndarray) -> np.ndarray:
    """Hashes over 0 of all grams of b."""
    h, size = b.astype(np.uint32) + np.uint32(1), 1
    while size < GRAM:
        h = h[:-size] * np.uint32(pow(_MULT, size, 2**32)) + h[size:]
        size *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h | np.uint32(1)


def anchors(b: np.ndarray, valid: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """Positions of grams that are the smallest of some SPAN-byte string, each place of equal ones.

    valid: which strings count, by the position where they begin.
    """
    out, edge = [np.zeros(0, np.int64)], np.zeros(SIDE, np.uint32)
    for lo in range(0, len(b) - SPAN + 1, most):  # strings depend on their own bytes only
        part = b[lo : lo + most + SPAN - 1]
        h = _hashes(part)
        # A gram is chosen if it is the minimum of one of the strings that hold it, that is of the one with the largest.
        low = _slid(h, SIDE + 1, np.minimum) * valid[lo : lo + len(part) - SPAN + 1]
        out.append(lo + np.flatnonzero(_slid(np.concatenate([edge, low, edge]), SIDE + 1, np.maximum) == h))
    return np.unique(np.concatenate(out))


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


def _hashed(b: np.ndarray, at: np.ndarray, n: int, h) -> np.ndarray:
    """A hash of the n bytes (8 at least) at each of the positions, on top of h."""
    eight = np.ndarray((len(b) - 7,), "<u8", b, strides=(1,))
    for off in (*range(0, n - 7, 8), *([n - 8] if n % 8 else [])):
        h = _mixed(eight[at + off] ^ h)
    return h


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """run(columns as lists) gives rows of columns; batches are cut to a bounded number of bytes."""
    names = [x.split()[0] for x in schema.split(",")]
    types = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}[x.split()[1]] for x in schema.split(",")]

    def go(batches):
        for b in batches:
            for lo, hi in slices(b.column(2)):
                out = run(*[c.to_pylist() for c in b.slice(lo, hi - lo).columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return df.mapInArrow(tidied(go), schema)


def _blobs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """values as binary, cut before each of the positions `first`."""
    ends = (np.r_[first, len(values)] * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def _bytes(blobs: pa.Array, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of blobs lo to hi - 1, where each of them ends)."""
    ends = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset + lo : blobs.offset + (len(blobs) if hi is None else hi) + 1]
    data = blobs.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8), ends[1:].astype(np.int64) - ends[0]


def pieces(docs: list[int], rows: list[int], texts: list[bytes], piece: int, most: int = 4_000_000):
    """Lists of some pieces (doc, row, length of the text, first string, strings, bytes) of texts, `most` bytes or one piece more.

    The bytes hold all strings of a piece and SIDE bytes on both sides, zeros where the text has none.
    """
    out, total = [], 0
    for d, r, t in zip(docs, rows, texts, strict=True):
        for lo in range(0, len(t) - SPAN + 1, piece):
            hi = min(lo + piece, len(t) - SPAN + 1)
            end = hi - 1 + SPAN + SIDE
            out.append((d, r, len(t), lo, hi - lo, b"".join([bytes(max(0, SIDE - lo)), t[max(0, lo - SIDE) : end], bytes(max(0, end - len(t)))])))
            total += end - lo
            if total >= most:
                yield out
                out, total = [], 0
    if out:
        yield out


def places(parts: list[tuple], turn: tuple[int, int]) -> dict[str, np.ndarray]:
    """The places (see _PLACE) of a round's anchors in pieces; an anchor that two pieces have comes twice, which does no harm."""
    b = np.frombuffer(b"".join(x[5] for x in parts), np.uint8)
    doc, row, length, begin, count, start = (np.array(x, np.int64) for x in (*list(zip(*parts, strict=True))[:5], [len(x[5]) for x in parts]))
    start = np.cumsum(start) - start + SIDE
    valid = np.zeros(len(b), bool)
    for s, n in zip(start.tolist(), count.tolist(), strict=True):
        valid[s : s + n] = True
    at = anchors(b, valid)
    fp = _hashed(b, at, GRAM, np.uint64(1))
    if turn[1] > 1:
        at, fp = (x[fp % np.uint64(turn[1]) == turn[0]] for x in (at, fp))
    part = np.searchsorted(start, at, "right") - 1
    own = at - start[part] + begin[part]
    left, right = np.minimum(SIDE, own), np.minimum(SIDE, length[part] - own - GRAM)
    context = _hashed(b, at + GRAM, SIDE, _hashed(b, at - SIDE, SIDE, (left * 64 + right).astype(np.uint64)))
    near = [_hashed(b, at + off, HALF, np.uint64(2)) >> np.uint64(48) for off in (-HALF, GRAM)]
    out = (fp, context, doc[part], row[part], own, right, near[0] << np.uint64(16) | near[1])
    return {k: x.astype(t) for (k, t), x in zip(_PLACE.items(), out, strict=True)}


def _dealt(turn: tuple[int, int], piece: int):
    """Rows (bucket, columns of _PLACE): the places of a slice of texts whose grams are of the bucket."""

    def go(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                for parts in pieces(*[c.to_pylist() for c in batch.slice(lo, hi - lo).columns], piece):
                    found = places(parts, turn)
                    bucket = (found["fp"] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.uint16)
                    order = np.argsort(bucket, kind="stable")
                    bucket = bucket[order]
                    first = np.flatnonzero(_firsts(bucket))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), *[_blobs(found[k][order], first) for k in _PLACE]], names=["bucket", *_PLACE])

    return go


def settled(x: dict[str, np.ndarray], last: bool) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(places that stay, spans, cuts that are asked for) of the places of whole buckets, or of a part of one if not last.

    Spans are the places whose cut is also in a smaller document. The others stay, those of a cut's smallest document. If no
    more places come, asked for are cuts that may share a string with another of their gram in another document. As a string
    that two cuts share reaches HALF bytes to the left or right of the gram in both, the bytes there agree.
    """
    order = np.argsort(x["fp"])
    same = ~_firsts(x["fp"][order])
    order = order[same | np.r_[same[1:], False]] if last else order
    x = {k: v[order] for k, v in x.items()}
    order = np.lexsort([x[k] for k in ("at", "row", "doc", "context", "fp")])
    x = {k: v[order] for k, v in x.items()}
    new = _firsts(x["fp"], x["context"])
    over = x["doc"] > x["doc"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(new) else new
    gone = np.empty(int(over.sum()), _GONE)
    for k, v in (("doc", x["doc"]), ("row", x["row"]), ("a", np.maximum(x["at"] - SIDE, 0)), ("b", x["at"] + GRAM + x["right"])):
        gone[k] = v[over]
    x = {k: v[~over] for k, v in x.items()}
    if not last:
        return x, gone, np.zeros(0, _ASK)
    new = _firsts(x["fp"], x["context"])
    first, asked = np.flatnonzero(new), np.zeros(int(new.sum()), bool)
    doc, gram = x["doc"][first], np.cumsum(_firsts(x["fp"]))[first].astype(np.uint64)
    for side in (x["near"][first] & 0xFFFF, x["near"][first] >> 16):
        key = gram << np.uint64(16) | side
        order = np.argsort(key)
        begin = np.flatnonzero(_firsts(key[order]))
        if len(begin):
            several = np.minimum.reduceat(doc[order], begin) < np.maximum.reduceat(doc[order], begin)
            asked[order] |= np.repeat(several, np.diff(begin, append=len(order)))
    mine = asked[np.cumsum(new) - 1] if len(new) else new
    asks = np.empty(int(mine.sum()), _ASK)
    for k in _ASK.names:
        asks[k] = x[k][mine]
    return {}, gone, asks


def _grouped(rows: np.ndarray, asked: bool = False) -> pa.RecordBatch:
    """Rows (grp, asked, data): rows of _GONE or _ASK by groups of documents."""
    grp = (_mixed(rows["doc"].astype(np.uint64)) % np.uint64(GROUPS)).astype(np.int32)
    order = np.argsort(grp, kind="stable")
    first = np.flatnonzero(_firsts(grp[order]))
    return pa.RecordBatch.from_arrays([pa.array(grp[order][first]), pa.array(np.full(len(first), asked)), _blobs(rows[order], first)], names=["grp", "asked", "data"])


def _settled(batches):
    """Rows (grp, asked, data) from rows of _dealt() in order of buckets; what is held of a bucket is bounded but for different cuts."""
    held, total, last, most = [], 0, None, 4 * MANY

    def joined():
        return {k: np.concatenate([x[k] for x in held]) for k in _PLACE}

    for batch in batches:
        bucket = batch.column(0).to_numpy()
        first = np.flatnonzero(_firsts(bucket))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
            if bucket[lo] != last and total >= MANY:
                _, gone, asks = settled(joined(), True)
                yield from (_grouped(gone), _grouped(asks, True))
                held, total, most = [], 0, 4 * MANY
            last = bucket[lo]
            held.append({k: _bytes(batch.column(i + 1), lo, hi)[0].view(t) for i, (k, t) in enumerate(_PLACE.items())})
            total += len(held[-1]["fp"])
            if total > most:
                left, gone, _ = settled(joined(), False)
                yield _grouped(gone)
                held, total = [left], len(left["fp"])
                most = max(most, 2 * total)
    if held:
        _, gone, asks = settled(joined(), True)
        yield from (_grouped(gone), _grouped(asks, True))


def _by_group(batches, kind: np.dtype):
    """Rows of kind in order of doc and row from rows (grp, data) in order of grp; a document's rows come together."""
    held, last = [], None

    def ended():
        rows = np.concatenate(held)
        return rows[np.lexsort((rows["row"], rows["doc"]))]

    for batch in batches:
        grp = batch.column(0).to_numpy()
        first = np.flatnonzero(_firsts(grp))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(grp)], strict=True):
            if grp[lo] != last and held:
                yield ended()
                held = []
            last = grp[lo]
            held.append(_bytes(batch.column(1), lo, hi)[0].view(kind))
    if held:
        yield ended()


def _asks(batches):
    """Rows (doc_id, row, asks): the cuts that are asked for of each document, as _ASK."""
    for rows in _by_group(batches, _ASK):
        first = np.flatnonzero(_firsts(rows["doc"], rows["row"]))
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc"][first]), pa.array(rows["row"][first]), _blobs(rows, first)], names=["doc_id", "row", "asks"])


def _cut(docs, rows, texts, asks):
    """Columns of cuts (see _lows): equal cuts of a document's gram are one, with the places of all their anchors."""
    out = ([], [], [], [], [], [], [], [])
    for d, r, t, ask in zip(docs, rows, texts, asks, strict=True):
        ask = np.frombuffer(ask, _ASK)
        ask = ask[np.lexsort((ask["at"], ask["context"], ask["fp"]))]
        first = np.flatnonzero(_firsts(ask["fp"], ask["context"]))
        at, right = ask["at"][first], ask["right"][first]
        before, n = np.minimum(SIDE, at), len(first)
        ends = np.r_[first[1:], len(ask)].tolist()
        columns = (ask["fp"][first].view(np.int64).tolist(), [0] * n, [SIDE] * n, before.tolist(), [t[a:b] for a, b in zip((at - before).tolist(), (at + GRAM + right).tolist(), strict=True)], [d] * n, [r] * n, [ask["at"][a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)])
        for c, v in zip(out, columns, strict=True):
            c += v
    return out


def _sorted_shards(batches):
    """Rows (grp, asked, data): spans found by suffix arrays over whole shards; rows (see _lows) come sorted by shard."""
    held, total, last = [], 0, None

    def flush():
        x = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        before, doc, row = (x.column(i).to_numpy() for i in (3, 5, 6))
        data, ends = _bytes(x.column(4))
        at, owner, low = first_docs(data, ends, doc)
        # The runs of strings that a smaller document has.
        at, owner = at[low < doc[owner]], owner[low < doc[owner]]
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + 1)
        first, final = np.flatnonzero(new), np.flatnonzero(np.r_[new[1:], True][: len(new)])
        where, stop = _bytes(x.column(7))
        where, stop = where.view("<i4"), stop // 4
        owner, many = owner[first], np.diff(stop, prepend=0)[owner[first]]
        # Each run comes once for each place of its cut.
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own = np.repeat(owner, many)
        base = where[(stop - np.diff(stop, prepend=0))[own] + nth] - before[own] - (ends - np.diff(ends, prepend=0))[own]
        gone = np.empty(len(own), _GONE)
        for k, v in (("doc", doc[own]), ("row", row[own]), ("a", base + np.repeat(at[first], many)), ("b", base + np.repeat(at[final], many) + SPAN)):
            gone[k] = v
        return _grouped(gone)

    for batch in batches:
        if not len(batch):
            continue
        shard = [c.to_numpy() for c in batch.columns[:3]]
        new = _firsts(*shard)
        new[0] = last != tuple(c[0] for c in shard)
        last = tuple(c[-1] for c in shard)
        ends, lo = np.r_[0, _bytes(batch.column(4))[1]].tolist(), 0
        for i in np.flatnonzero(new).tolist():
            if total + ends[i] - ends[lo] >= CHUNK:
                held.append(batch.slice(lo, i - lo))
                yield flush()
                held, total, lo = [], 0, i
        held.append(batch.slice(lo))
        total += ends[-1] - ends[lo]
    if held:
        yield flush()


def _whole(batches):
    """Rows (grp, asked, data): the spans of whole cuts."""
    for b in batches:
        before, doc, row = (b.column(i).to_numpy() for i in (3, 5, 6))
        where, stop = _bytes(b.column(7))
        own = np.repeat(np.arange(len(b)), np.diff(stop // 4, prepend=0))
        gone = np.empty(len(own), _GONE)
        a = where.view("<i4") - before[own]
        for k, v in (("doc", doc[own]), ("row", row[own]), ("a", a), ("b", a + np.diff(_bytes(b.column(4))[1], prepend=0)[own])):
            gone[k] = v
        yield _grouped(gone)


_CUT = "key long, low int, high int, before int, cut binary, doc_id long, row long, places binary"
_ROWS = "grp int, asked boolean, data binary"
_SHARD = ["key", "low", "high"]


def _halves(cuts: DataFrame) -> DataFrame:
    """Splits shards: the strings of a cut with few bytes before the anchor, and those with many, are dealt anew.

    A shard (key, low, high) has the strings that begin low to high bytes before the anchor. All of them hold the low
    bytes before it and the SIDE - high bytes behind it, so these bytes are part of the key. Strings that are equal meet
    in one shard again; a shard of one place has equal strings only, so splitting comes to an end.
    """
    mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    two = F.array(F.struct(F.col("low"), mid.alias("high")), F.struct((mid + 1).alias("low"), F.col("high")))
    rows = cuts.where("low < high").withColumn("half", F.explode(two)).withColumn("low", F.col("half.low")).withColumn("high", F.col("half.high"))
    left, right = F.least("before", "high"), F.least(F.length("cut") - F.col("before") - GRAM, SIDE - F.col("low"))
    rows = rows.withColumn("left", left).withColumn("right", right).where(f"left >= low AND right >= {SIDE} - high")
    rows = rows.withColumn("cut", F.substr("cut", F.col("before") - F.col("left") + 1, F.col("left") + F.col("right") + GRAM)).withColumn("before", F.col("left"))
    core = F.substr("cut", F.col("before") - F.col("low") + 1, F.col("low") + GRAM + SIDE - F.col("high"))
    return rows.where(f"length(cut) >= {SPAN}").withColumn("key", F.xxhash64("key", core)).select(*_SHARD, "before", "cut", "doc_id", "row", "places")


def _shared(spark: SparkSession, dealt: str) -> list[str]:
    """Paths of spans that the suffix arrays of the cuts at the path dealt show; removes that path.

    A cut has the strings that hold its anchor; places: where the anchor stands in its document. Shards of too many cuts are
    split until they are small. A part that a smaller document has as well is covered whole and split no further.
    """
    found, cuts = [], spark.read.parquet(dealt)
    while True:
        sizes = cuts.groupBy(*_SHARD).agg(F.count(F.lit(1)).alias("n"), (F.min("doc_id") < F.max("doc_id")).alias("shares"))
        hot = bounded(sizes.where(f"n > {HOT}").select(*_SHARD, "shares"))
        more = not hot.isEmpty()
        ready = cuts.join(hot, _SHARD, "left_anti") if more else cuts
        found.append(write(ready.repartition(*_SHARD).sortWithinPartitions(*_SHARD).mapInArrow(tidied(_sorted_shards), _ROWS)))
        done = dealt
        if more:
            halves, cut = _halves(cuts.join(hot.where("shares").drop("shares"), _SHARD)), [*_SHARD, "before", "cut"]
            dealt = write(halves.join(halves.groupBy(*cut).agg(F.min("doc_id").alias("first")), cut))
            halves = spark.read.parquet(dealt)
            found.append(write(halves.where("doc_id > first").select(*cuts.columns).mapInArrow(tidied(_whole), _ROWS)))
            cuts = halves.where("doc_id = first").select(*cuts.columns)
        remove(spark, done)
        if not more:
            return found


def _kept(ids, rows, texts, spans):
    out = ([], [], [], [], [])
    for i, t, s in zip(ids, texts, spans, strict=True):
        rest, end, edges = [], 0, 0
        for a, b in sorted((x["a"], x["b"]) for x in s or ()):
            if a > end or not edges:
                rest.append(t[end:a])
                edges += 1
            end = max(end, b)
        kept = b"".join([*rest, t[end:]])
        for c, v in zip(out, (i, len(t), len(t) - len(kept), edges, hashlib.sha256(kept).hexdigest()), strict=True):
            c.append(v)
    return out


def _merged(batches):
    """Rows (doc_id, row, spans) with the spans in order, and those that overlap or touch made one."""
    for batch in batches:
        lists = batch.column(2)
        owner, pairs = np.repeat(np.arange(len(lists)), np.diff(lists.offsets)), lists.flatten()
        a, b = (x.to_numpy(zero_copy_only=False) for x in pairs.flatten())
        far = int(b.max(initial=0)) + 1  # a row's spans are moved behind those of the rows before
        order = np.argsort(a + owner * far, kind="stable")
        a, b, owner = a[order], np.maximum.accumulate((b + owner * far)[order]), owner[order]
        first = np.flatnonzero(np.r_[True, (a + owner * far)[1:] > b[:-1]]) if len(a) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(a)][: len(first)] - 1
        runs = pa.StructArray.from_arrays([pa.array(a[first], pa.int64()), pa.array(b[last] - owner[last] * far, pa.int64())], names=["a", "b"])
        ends = np.r_[0, np.cumsum(np.bincount(owner[first], minlength=len(lists)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)], names=["doc_id", "row", "spans"])


def _spans_of_round(own: DataFrame, turn: tuple[int, int], piece: int) -> DataFrame:
    """(doc_id, row, spans array<(a, b)>): bytes a to b - 1 are covered by strings of smaller documents.

    A document's spans are merged. What is read more than once is written as Parquet and removed when nothing reads it any
    more, so that no shuffle outlives its step.
    """
    spark = own.sparkSession
    columns = ", ".join(f"{k} binary" for k in _PLACE)
    dealt = own.select("doc_id", "row", "data").mapInArrow(tidied(_dealt(turn, piece)), f"bucket int, {columns}")
    first = write(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_settled), _ROWS))
    del dealt
    clean(spark)

    def by_group(paths, asked):
        rows = spark.read.parquet(*paths).where("asked" if asked else "NOT asked").select("grp", "data")
        return rows.repartition("grp").sortWithinPartitions("grp")

    asks = by_group([first], True).mapInArrow(tidied(_asks), "doc_id long, row long, asks binary")
    cuts = write(_mapped(own.select("doc_id", "row", "data").join(asks, ["doc_id", "row"]).select("doc_id", "row", "data", "asks"), _cut, _CUT))
    del asks
    paths = [first, *_shared(spark, cuts)]
    spans = keep(by_group(paths, False).mapInArrow(tidied(_runs), "doc_id long, row long, spans array<struct<a:bigint,b:bigint>>"))
    for path in paths:
        remove(spark, path)
    return spans


def _runs(batches):
    """Rows (doc_id, row, spans) of each document, merged, from rows (grp, data) in order of grp."""

    def rows():
        for x in _by_group(batches, _GONE):
            first = np.flatnonzero(_firsts(x["doc"], x["row"]))
            pairs = pa.StructArray.from_arrays([pa.array(x[k].astype(np.int64)) for k in "ab"], names=["a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(x["doc"][first]), pa.array(x["row"][first]), pa.ListArray.from_arrays(pa.array(np.r_[first, len(x)], pa.int32()), pairs)], names=["doc_id", "row", "spans"])

    return _merged(rows())


def repeated(docs: DataFrame, rounds: int = ROUNDS, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each document.

    Removed is each byte covered by a SPAN-byte string that also starts in a document of smaller doc_id, judged on the
    input; texts are UTF-8 bytes and matches never cross documents. Null and empty texts have no bytes. Rows without a
    doc_id come first in no order and lose nothing. Rows of one doc_id don't take from each other; each gives a row, and
    loses what it shares with smaller documents. Other columns are neither read nor returned; an empty table gives no
    rows. A long text is held whole by one task. Anchors are dealt to rounds by their hash, so that only the places of one
    round are on disk at once.
    """
    data, doc = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.col("doc_id").cast("long").alias("doc_id")
    # Rows are told apart by their text where a doc_id comes more than once, and need no number elsewhere.
    again = bounded(docs.select(doc).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")))
    texts = docs.select(doc, data.alias("data")).join(again, "doc_id", "left").select("doc_id", F.when(F.col("again"), F.xxhash64("data")).otherwise(F.lit(0)).alias("row"), "data")
    own = texts.where("doc_id IS NOT NULL")
    gone = reduce(DataFrame.unionByName, [_spans_of_round(own, (turn, rounds), piece) for turn in range(rounds)])
    if rounds > 1:
        gone = gone.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    back = texts.join(gone, ["doc_id", "row"], "left").select("doc_id", "row", "data", "spans")
    return _mapped(back, _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c100 AS (SELECT doc_id, c, substr(h, CAST(200 * c + 1 AS BIGINT), 298) AS x FROM d, unnest(range(0, (len(h) // 2 - 50) // 100 + 1)) AS t(c) WHERE len(h) >= 100),
s AS (SELECT doc_id, 100 * c + i AS p, hash(substr(x, CAST(2 * i + 1 AS BIGINT), 100)) AS g FROM c100, unnest(range(0, least(100, len(x) // 2 - 49))) AS u(i)),
f AS (SELECT g, min(doc_id) AS low FROM s GROUP BY g),
c AS (SELECT doc_id, p, p > lag(p, 1, -100) OVER (PARTITION BY doc_id ORDER BY p) + 50 AS new FROM s JOIN f USING (g) WHERE low < doc_id),
n AS (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM c),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM n GROUP BY doc_id, k),
q AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
m AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS parts FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(parts, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id)
"""
