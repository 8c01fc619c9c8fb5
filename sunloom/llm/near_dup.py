"""MinHash near-dedup with SetSketch registers (operator 7).

Every set element is the seed of a Poisson process of points with random registers; a register holds the exponentially
spaced, truncated minimum of the points that fall on it. Registers merge by maximum and are equal with about the
probability of the Jaccard similarity. Bands of registers give candidates; a joint likelihood over larger, smaller and
equal registers estimates their similarity; exact sets confirm it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded, forget, keep, map_texts, slices, table, tidied
from .linking import blocks, connect, shared_buckets

#: Registers: BANDS * ROWS. All bands miss with probability (1 - 0.85 ** 6) ** 32 < 3e-7 at a similarity of 0.85, and
#: with (1 - 0.8 ** 6) ** 32 < 7e-5 at 0.8. Rounds in which the bands are looked up.
BANDS, ROWS, ROUNDS = 32, 6, 4
M = BANDS * ROWS
#: Base of the register scale, and the natural logarithm of the largest minimum that a register tells apart.
BASE, TOP = 1.001, 8.0
#: Bytes of texts that are sketched together.
SLICE = 250_000
#: Standard errors by which an estimate may fall short of the threshold before a pair is given up unverified.
SLACK = 7.0

_rng = np.random.default_rng(7)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> None:
    if len(_powers[0]) < n + 1:
        inverse = np.uint64(pow(int(_ODD), -1, 2**64))
        for i, base in enumerate((_ODD, inverse)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)


def shingle_sets(texts: list[str], size: int = 3) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z lower-cased, words between ASCII white space.

    A text with fewer words than `size` is one shingle, a text without words has none.
    """
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]).lower(), np.uint8)
    gap = _SPACE[data]
    edge = np.diff(gap.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    _grown(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * _powers[0][: len(data)], dtype=np.uint64)])
    words = mix((total[ends] - total[starts]) * _powers[1][starts])
    first = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        w = words[lo:hi]
        if len(w) == 0:
            out.append(w)
            continue
        k = min(size, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for j in range(k):
            h = mix(h * _ODD + w[j : len(w) - k + 1 + j])
        out.append(np.unique(h))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, uint16, a row of M for each set; those of an empty set are 0."""
    low = np.full((len(sets), M), np.inf)
    todo, limit = [i for i, s in enumerate(sets) if len(s)], math.log(M) + 6
    while todo:
        doc = np.repeat(np.array(todo), [len(sets[i]) for i in todo])
        seed = np.concatenate([sets[i] for i in todo])
        most = limit / np.array([len(s) or 1 for s in sets])[doc]
        at, step, width = np.zeros(len(seed)), 0, 8
        while len(seed):
            s = mix(seed[:, None] + _STEP * np.arange(step + 1, step + width + 1, dtype=np.uint64))
            x = at[:, None] - np.cumsum(np.log1p((s >> np.uint64(11)) * -(2.0**-53)), axis=1) / M
            hit = x <= most[:, None]
            reg = (s * _ODD >> np.uint64(40)).astype(np.int64) % M
            np.minimum.at(low.reshape(-1), (doc[:, None] * M + reg)[hit], x[hit])
            on = hit[:, -1]
            seed, doc, most, at, step = seed[on], doc[on], most[on], x[on, -1], step + width
            width = int(min(512, max(8, 200_000 // max(1, len(seed)))))
        todo, limit = [i for i in todo if np.isinf(low[i]).any()], limit * 2
    with np.errstate(invalid="ignore"):
        return np.where(np.isinf(low), 0, np.clip(np.floor((TOP - np.log(low)) / math.log(BASE)), 0, 65535)).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    """A bucket key for each band of registers; the band's number is part of it."""
    rows = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS))
    for j in range(ROWS):
        key = mix(key * _ODD + rows[:, :, j])
    return key.view(np.int64)


def likely(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, from the counts of larger, smaller and equal registers."""
    more, less = (regs_a > regs_b).sum(1), (regs_a < regs_b).sum(1)
    same, u = M - more - less, n_a / (n_a + n_b)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def fit(j):
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(x) + less * np.log(y) + same * np.log(np.clip(1 - x - y, 1e-12, 1))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = fit(a) < fit(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def _prints(sets: list[np.ndarray]) -> list[pa.Array]:
    """The size and a 128-bit fingerprint of each set."""
    sums = [[int(np.bitwise_xor.reduce(mix(s * np.uint64(k)))) - 2**63 if len(s) else 0 for s in sets] for k in (3, 5)]
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64())]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, f1, f2, keys): the size and a 128-bit fingerprint of each set, and the keys of its register bands."""

    def start():
        forget()

        def work(texts: list[str]) -> list[pa.Array]:
            sets = shingle_sets(texts, size)
            ends = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
            return [*_prints(sets), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands(registers(sets)).reshape(-1)))]

        return work

    return map_texts(docs, "doc_id", "text", start, "n long, f1 long, f2 long, keys array<long>", SLICE)


def _leaders(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(node, n, regs, text) for each of the classes (node, doc_id, n, f1, f2): one text that has its set."""

    def start():
        forget()

        def work(texts: list[str]) -> list[pa.Array]:
            sets = shingle_sets(texts, size)
            return [*_prints(sets), pa.array([r.tobytes() for r in registers(sets)], pa.binary()), pa.array(texts, pa.string())]

        return work

    ids = bounded(classes.select(F.col("doc_id").alias("d")).distinct())
    own = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "text")
    own = map_texts(own, "doc_id", "text", start, "n long, f1 long, f2 long, regs binary, text string", SLICE)
    same = [F.col(f"o.{c}") == F.col(f"c.{c}") for c in ("n", "f1", "f2")] + [F.col("o.doc_id").eqNullSafe(F.col("c.doc_id"))]
    return own.alias("o").join(bounded(classes.select("node", "doc_id", "n", "f1", "f2")).alias("c"), same).select("node", "o.n", "regs", "o.text").dropDuplicates(["node"])


def _links(key: int, parts: np.ndarray, nodes: np.ndarray, labels: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different components of a bucket's nodes, none that the others among them make needless.

    With two parts only pairs between them are compared. Pairs that share an earlier band meet in that band's bucket.
    """
    band = int(np.flatnonzero(keys[0] == key)[0])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    n, root = np.array([len(s) for s in sets]), {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    _, at, size = np.unique(labels, return_inverse=True, return_counts=True)
    two, out = len(np.unique(parts)) > 1, []
    # Of the components, the largest needs no turn of its own: each pair has an end outside it.
    for i in np.flatnonzero(at != size.argmax()):
        able = labels != labels[i]
        if two:
            able &= parts != parts[i]
        if band:
            able &= ~(keys[:, :band] == keys[i, :band]).any(1)
        if not able.any():
            continue
        lo, hi = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
        spans = hi - lo
        places = np.repeat(lo - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
        same = np.bincount(owner[places], minlength=len(sets))
        for j in np.flatnonzero(able & (same * 100 >= (n + n[i] - same) * percent)):
            a, b = find(int(labels[i])), find(int(labels[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
    return out


def across(told: DataFrame, lead: DataFrame, load: Callable[[list[tuple]], tuple[np.ndarray, list[np.ndarray]]], percent: int) -> DataFrame:
    """The links (a, b) that join components within buckets; candidate pairs are counted inside tasks, never written.

    told: rows (key, node, label, m) of buckets of m nodes. lead: (node, ...); load makes of the other columns of some
    nodes their bucket keys, a row of all bands for each node, and their sets.
    """
    parts, part = blocks()
    rows = told.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "label")
    rows = rows.join(lead, "node").select("key", "low", "high", "part", "node", "label", *[c for c in lead.columns if c != "node"])

    def run(batches):
        held, last = [], None

        def done():
            parts, nodes, labels = (np.array(c, np.int64) for c in zip(*[(x[3], x[4], x[5]) for x in held], strict=True))
            if len(np.unique(labels)) < 2:
                return None
            found = _links(last[0], parts, nodes, labels, *load([x[6:] for x in held]), percent)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"]) if found else None

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[:3] != last and held:
                    if (out := done()) is not None:
                        yield out
                    held = []
                last = row[:3]
                held.append(row)
        if held and (out := done()) is not None:
            yield out

    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node").mapInArrow(tidied(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """A row (doc_id, n_shingles, component_id, kept) for each document row.

    Documents whose sets of `size`-word shingles have 100 * intersection >= percent * union are linked; component_id is
    the smallest doc_id that links reach, kept tells whether it is the row's own. Null, empty and white texts have an
    empty set, no links and are kept. Equal sets are one class and are compared once, so repeated rows and groups of
    copies make no pairs. If a doc_id repeats with other texts, each of its rows has the component of its own text; equal
    rows are kept, or not, alike. Other columns are neither read nor returned; an empty table gives no rows. Rows without
    a doc_id link like others; a component without any doc_id is null and its rows are kept.
    """
    own = keep(sketches(docs, size))
    classes = own.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()))  # kept, so the ids stay
    shared = shared_buckets(classes.select("node", "n", "keys"), BANDS, ROUNDS)
    lead = keep(_leaders(docs, classes.join(bounded(shared.select("node").distinct()), "node"), size))
    least = percent / 100 - SLACK * math.sqrt(percent / 100 * (1 - percent / 100) / M)

    def guess(batches):
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (2, 3))
            n_a, n_c = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (4, 5))
            if len(n_a):
                yield b.select([0, 1]).filter(pa.array(likely(a, c, n_a, n_c) >= least))

    def confirm(batches):
        for b in batches:
            for lo, hi in slices(b.column(2)):
                part = b.slice(lo, hi - lo)
                sets = [shingle_sets(part.column(i).to_pylist(), size) for i in (2, 3)]
                same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)])
                total = np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)])
                yield part.select([0, 1]).filter(pa.array(same * 100 >= (total - same) * percent))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda x, *cols: lead.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
        full = pairs.join(side("a", "n"), "a").join(side("b", "n"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        full = full.select("a", "b").join(side("a", "regs", "n"), "a").join(side("b", "regs", "n"), "b")
        near = keep(full.select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(tidied(guess), "a long, b long"))
        both = near.join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(tidied(confirm), "a long, b long")

    fits = lambda a, b: F.least(f"n{a}", f"n{b}") * 100 >= F.greatest(f"n{a}", f"n{b}") * percent
    load = lambda rows: (bands(np.frombuffer(b"".join(r[0] for r in rows), np.uint16).reshape(-1, M)), shingle_sets([r[1] for r in rows], size))
    label = connect(shared, verify, fits, lambda told: across(told, lead.select("node", "regs", "text"), load, percent))
    told = classes.select("node", "f1", "f2", "n", "doc_id").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = keep(told.select("component", F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("g"), "doc_id"))
    lowest = told.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = bounded(told.drop("doc_id").join(lowest, "component").drop("component"))
    rows = own.select("doc_id", "n", "f1", "f2").join(of, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("g")), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_W} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM d JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id, n.n
"""
