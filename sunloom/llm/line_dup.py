"""Fuzzy line dedup by MinHash (operator 8).

The set of character shingles of each distinct line gets a MinHash signature, whose bands are bucket keys. Lines that
share a bucket are candidates, exact Jaccard similarity confirms them, and distributed union-find keeps one line of each
component. Signatures and confirmation are NumPy over Arrow batches, because SQL functions take too long for them; the
README has the figures. Lines, classes, buckets, components and texts are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded, forget, keep, slices, table, tidied
from .linking import connect, shared_buckets
from .near_dup import across, mix

#: Characters of a shingle, bands, and values that make up a key. At a similarity of 0.8 all bands miss with
#: (1 - 0.8 ** 6) ** 20 < 0.003, at 0.85 with less than 1e-4. Rounds in which the bands are looked up.
CHARS, BANDS, ROWS, ROUNDS = 5, 20, 6, 4
M = BANDS * ROWS
#: Bytes and lines that are hashed together; bits of a line's number there.
SLICE, LINES, BITS = 1_000_000, 1024, 10
#: Nodes of a bucket up to which all pairs across its components are written as candidates.
SMALL = 32

_SHIFT, _HASH = np.uint64(64 - BITS), np.uint64(2 ** (64 - BITS) - 1)
_STEP, _EMPTY, _VALUE = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1), np.uint64(2**48 - 1)
_ODD = np.random.default_rng(8).integers(1, 2**63, max(CHARS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _let(value: Column, body) -> Column:
    """body(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def gram_sets(lines: list[str]) -> np.ndarray:
    """The sets of shingle hashes of up to LINES lines, as sorted distinct values: the line's number, then the hash.

    A line of less than CHARS characters has no values here: no other line has its only shingle.
    """
    sizes = np.array([len(x) for x in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < CHARS:
        return np.zeros(0, np.uint64)
    at = np.repeat(np.arange(len(lines)), np.maximum(sizes - CHARS + 1, 0))
    starts = np.arange(len(at)) + (np.cumsum(sizes) - sizes - np.r_[0, np.cumsum(np.maximum(sizes - CHARS + 1, 0))[:-1]])[at]
    rolled = sum(codes[j : len(codes) - CHARS + 1 + j] * _ODD[j] for j in range(CHARS))
    values = np.sort((at.astype(np.uint64) << _SHIFT) | (mix(rolled[starts]) >> np.uint64(BITS)))
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def signatures(values: np.ndarray, count: int) -> np.ndarray:
    """MinHash signatures, a row of M values for each of `count` sets as gram_sets() gives them.

    In each turn every element falls into a random bin with a random value; a bin holds the least (turn, value). A set is
    done when none of its bins is empty, so small sets take more turns. Two sets' bins are equal with the probability of
    their Jaccard similarity, whenever each of them ended. Rows of empty sets stay empty.
    """
    low = np.full((count, M), _EMPTY)
    line, values, turn = (values >> _SHIFT).astype(np.int64), values & _HASH, 0
    while len(values):
        width = int(min(512, max(1, 100_000 // len(values))))
        turns = np.arange(turn, turn + width, dtype=np.uint64)
        # The hashes are random already, so a factor of its own is enough for a turn: high bits are the bin, low the value.
        h = values[:, None] * (mix(turns + _STEP) | np.uint64(1))
        bins = ((h >> np.uint64(48)) * np.uint64(M) >> np.uint64(16)).view(np.int64) + line[:, None] * M
        h &= _VALUE
        h |= turns << np.uint64(48)
        np.minimum.at(low.reshape(-1), bins.reshape(-1), h.reshape(-1))
        on, turn = (low == _EMPTY).any(1)[line], turn + width
        values, line = values[on], line[on]
    return low


def bucket_keys(values: np.ndarray, count: int) -> np.ndarray:
    """A bucket key for each band of the signatures; the band's number is part of it."""
    rows = signatures(values, count).reshape(count, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (count, BANDS))
    for j in range(ROWS):
        keys = mix(keys * _ODD[j] + rows[:, :, j])
    return keys.view(np.int64)


def _slices(batch: pa.RecordBatch, *texts: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most LINES / len(texts) rows and, unless they are one row, of about SLICE bytes a column."""
    parts = [batch.slice(i, LINES // len(texts)) for i in range(0, batch.num_rows, LINES // len(texts))]
    for at in texts:
        parts = [p.slice(lo, hi - lo) for p in parts for lo, hi in slices(p.column(at), SLICE)]
    return iter(parts)


def _sketched(classes: DataFrame) -> DataFrame:
    """The classes with n, the size of their line's set, and its bucket keys (null for a line that is one short shingle)."""

    def run(batches):
        forget()
        for batch in batches:
            for part in _slices(batch, batch.num_columns - 1):
                values = gram_sets(part.column(part.num_columns - 1).to_pylist())
                n = np.bincount((values >> _SHIFT).astype(np.int64), minlength=part.num_rows)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS)
                keys = pa.ListArray.from_arrays(ends, pa.array(bucket_keys(values, part.num_rows).reshape(-1)), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.maximum(n, 1).astype(np.int32)), keys], names=[*part.schema.names[:-1], "n", "keys"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields[:-1])
    return classes.mapInArrow(tidied(run), f"{fields}, n int, keys array<bigint>")


def _alike(pairs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of the rows (a, b, line_a, line_b) whose sets are as similar as percent tells."""

    def run(batches):
        forget()
        for batch in batches:
            for part in _slices(batch, 2, 3):
                sides = [gram_sets(part.column(i).to_pylist()) for i in (2, 3)]
                both = np.sort(np.concatenate(sides))
                count = lambda values: np.bincount((values >> _SHIFT).astype(np.int64), minlength=part.num_rows)  # noqa: B023, E731
                total, same = count(both), count(both[1:][both[1:] == both[:-1]])
                yield part.select([0, 1]).filter(pa.array((same > 0) & (same * 100 >= (total - same) * percent)))

    return pairs.mapInArrow(tidied(run), "a long, b long")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, at, h1, h2, line): each line that is not blank, without the white space around it, and its hashes.

    row is a hash of the text, which tells rows of one doc_id apart.
    """
    split = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    split = split.withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c"))).where("line <> ''")
    return split.select("doc_id", "row", "at", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), "line")


def _loaded(rows: list[tuple[str]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bucket keys and the sets of lines, as across() asks for them."""
    keys, sets = [], []
    for i in range(0, len(rows), LINES):
        part = [r[0] for r in rows[i : i + LINES]]
        values = gram_sets(part)
        keys.append(bucket_keys(values, len(part)))
        sets += np.split(values & _HASH, np.searchsorted(values >> _SHIFT, np.arange(1, len(part), dtype=np.uint64)))
    return np.concatenate(keys), sets


def _apart(told: DataFrame, lead: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The links (a, b) that join components, from rows (key, node, n, m, label) of buckets of m nodes.

    Buckets of up to SMALL nodes write their pairs across components, which verify() confirms; the pairs of larger ones
    are counted inside tasks.
    """
    side = lambda x: told.where(F.col("m") <= SMALL).select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n")])
    few = side("a").join(side("b"), "key").where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent))
    few = verify(keep(few.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()))
    return few.unionByName(across(told.where(F.col("m") > SMALL), lead.select("node", "line"), _loaded, percent)).distinct()


def dropped_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, row, at) of the lines that are copies, or near copies, of an earlier one.

    Lines are what stands between line feeds, without the blanks, tabs and carriage returns around; blank lines are never
    dropped. Lines whose sets of character shingles have 100 * intersection >= percent * union are linked; of the lines
    that links connect, the one of smallest (doc_id, at) stays. Equal lines are one class and are compared once. Where a
    doc_id repeats, its rows are told apart by their texts, and lines of one (doc_id, at) and class all stay. Rows
    without a doc_id come first in the order and are otherwise like others.
    """
    lines = _lines(docs)
    classes = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("line").alias("line"))
    classes = keep(_sketched(classes.select("h1", "h2", "first", "copies", "line")).withColumn("node", F.monotonically_increasing_id()))  # kept, so the ids stay
    shared = shared_buckets(classes.select("node", "n", "keys"), BANDS, ROUNDS)

    ids = bounded(classes.join(bounded(shared.select("node").distinct()), "node").select("node", "n", "h1", "h2", F.col("first.doc_id").alias("doc_id"), F.col("first.at").alias("at")))
    same = [F.col(f"l.{c}") == F.col(f"i.{c}") for c in ("h1", "h2", "at")] + [F.col("l.doc_id").eqNullSafe(F.col("i.doc_id"))]
    lead = lines.alias("l").join(ids.alias("i"), same)
    lead = keep(lead.select("node", "n", "line").dropDuplicates(["node"]))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda x, c: lead.select(F.col("node").alias(x), F.col(c).alias(f"{c}_{x}"))
        near = pairs.join(side("a", "n"), "a").join(side("b", "n"), "b").where(fits("_a", "_b")).select("a", "b")
        return _alike(near.join(side("a", "line"), "a").join(side("b", "line"), "b").select("a", "b", "line_a", "line_b"), percent)

    fits = lambda a, b: F.least(f"n{a}", f"n{b}") * 100 >= F.greatest(f"n{a}", f"n{b}") * percent
    label = connect(shared, verify, fits, lambda told: _apart(told, lead, verify, percent))
    linked = keep(classes.select("node", "first").join(label, "node"))
    best = linked.groupBy("component").agg(F.min("first").alias("best"))
    told = classes.select("node", "h1", "h2", "first", "copies").join(linked.select("node", "component").join(best, "component").drop("component"), "node", "left")
    told = told.where("copies > 1 OR best IS NOT NULL").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("best", "first").alias("best"))
    told = bounded(told.select("g1", "g2", F.col("best.doc_id").alias("best_doc"), F.col("best.at").alias("best_at")))
    rows = lines.select("doc_id", "row", "at", "h1", "h2").join(told, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    return rows.where(~(F.col("doc_id").eqNullSafe(F.col("best_doc")) & (F.col("at") == F.col("best_at")))).select("doc_id", "row", "at")


def dedup_lines(docs: DataFrame, percent: int = 80, counts: bool = True) -> DataFrame:
    """The rows of docs with, in text, only the lines that stay, as dropped_lines() tells; counts adds n_lines, n_dropped.

    A document that loses no line keeps its text (null too) as it is; all documents stay, also those without lines left.
    A null or empty text is one line. All columns of docs come through, but for columns called n_lines and n_dropped,
    which counts replaces. An empty table gives no rows.
    """
    mine = [f"{c}{'_' * max(map(len, docs.columns))}" for c in ("d", "r", "lost")]  # longer than any column's name
    d, r, lost = mine
    gone = dropped_lines(docs.select("doc_id", "text"), percent).groupBy("doc_id", "row").agg(F.collect_set("at").alias(lost)).withColumnsRenamed({"doc_id": d, "row": r})
    names = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_dropped")]
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(r)), "left")
    lines = F.split("text", "\n")
    # By sets of line numbers: looking up each line in the list of those lost would take the square of their number.
    rest = _let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(lost)), lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(rest)
    more = [F.coalesce(F.size(lines), F.lit(1)).cast("long").alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped")] if counts else []
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in names], *more)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


# The links are exact here: similar sets share one of their rarest shingles.
OP8_SQL = """
WITH RECURSIVE parts AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS raw, len(l) AS n_lines FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lines AS (SELECT * FROM (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM parts) WHERE line <> ''),
classes AS (SELECT line, min((doc_id, pos)) AS first, row_number() OVER (ORDER BY line) AS node FROM lines GROUP BY line),
sets AS (SELECT DISTINCT node, substr(line, i, 5) AS s FROM classes, unnest(range(1, greatest(length(line) - 4, 1) + 1)) AS t(i)),
sizes AS (SELECT node, count(*) AS n FROM sets GROUP BY node),
often AS (SELECT s, count(*) AS k FROM sets GROUP BY s),
rare AS (
  SELECT node, s, n FROM (SELECT node, s, n, row_number() OVER (PARTITION BY node ORDER BY k, s) AS place FROM sets JOIN often USING (s) JOIN sizes USING (node))
  WHERE place <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.node AS a, b.node AS b, a.n + b.n AS n FROM rare a JOIN rare b ON a.s = b.s AND a.node < b.node WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
links AS (SELECT a, b FROM pairs JOIN sets x ON x.node = a JOIN sets y ON y.node = b AND x.s = y.s GROUP BY a, b, n HAVING count(*) * 100 >= (n - count(*)) * 80),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, c) AS (SELECT DISTINCT a, a FROM ways UNION SELECT w.b, r.c FROM reach r JOIN ways w ON r.node = w.a WHERE r.c < w.b),
component AS (SELECT node, min(c) AS c FROM reach GROUP BY node),
best AS (SELECT node, min(first) OVER (PARTITION BY coalesce(c, -node)) AS best FROM classes LEFT JOIN component USING (node)),
gone AS (SELECT doc_id, pos FROM lines JOIN classes USING (line) JOIN best USING (node) WHERE (doc_id, pos) <> best),
kept AS (
  SELECT p.doc_id, count(g.pos) AS n_dropped, coalesce(string_agg(p.raw, chr(10) ORDER BY p.pos) FILTER (g.pos IS NULL), '') AS text
  FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 1)::BIGINT AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(k.text, d.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
