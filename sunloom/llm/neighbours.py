"""Nearest neighbours by vantage-point trees, one per shard (operator 6).

Vectors get one more coordinate that brings all to the largest norm, so the largest inner product is the smallest
distance. A bounded sample gives pivots; the vectors nearest to a pivot are its ball, and a large ball is dealt to several
shards by norm. Each shard builds a vantage-point tree and streams its queries past it in blocks. A query first visits a shard of
its nearest ball, then all shards but those that the triangle inequality rules out by their ball's radius, or the
Cauchy-Schwarz inequality by their largest norm; inside a tree,
subtrees are pruned in the same way. A relaxation factor above 1 prunes more, factor 1 is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import keep, table

#: Vectors that a shard holds about, vectors of a leaf, and queries that go down a tree together.
SHARD, LEAF, BLOCK = 4096, 256, 512
#: Vectors of the sample that pivots come from, by smallest hash of the id, and pivots at most. Every vector is searched.
SAMPLE, PIVOTS = 2048, 256
#: Ranges of norms that a ball is cut into at most.
RANGES = 64
#: Vectors of all samples together, whatever the number of lengths.
BUDGET = 16 * SAMPLE


class VpTree:
    """A vantage-point tree over rows of x (n, d), of norm `top` at most; ids (n,)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float, k: int):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        first = np.r_[True, (x[1:] != x[:-1]).any(1)] if len(x) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        # Of equal vectors only k + 1 can be among the k nearest of a query that is one of them: the smallest ids.
        rank = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
        self.ids, self.x, self.top, self.k = ids[rank <= k], x[rank <= k], top, k
        self.extra = np.sqrt(np.maximum(0, top * top - (self.x**2).sum(1)))
        self.root = self._build(np.arange(len(self.ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        v = rows[len(rows) // 2]
        dot = self.x[rows] @ self.x[v] + self.extra[rows] * self.extra[v]
        far = np.sqrt(np.maximum(0, 2 * (self.top**2 - dot)))
        radius = np.median(far)
        inside = far <= radius
        if inside.all():
            return rows
        return v, radius, self._build(rows[inside]), self._build(rows[~inside])

    def search(self, qid: np.ndarray, q: np.ndarray, factor: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), each (queries, k), best first; id -1 where there are fewer. Scores under `least` may be left out."""
        self.qid, self.q, self.least = qid, q, least
        self.norm = np.sqrt((q**2).sum(1))
        self.best = np.full((len(q), self.k), -np.inf)
        self.found = np.full((len(q), self.k), -1, np.int64)
        self._visit(self.root, np.arange(len(q)), factor)
        return self.found, self.best

    def _reach(self, at: np.ndarray) -> np.ndarray:
        """The distance of the k-th best so far, from queries scaled to the norm `top`."""
        kth = np.maximum(self.best[at, -1], self.least[at]) * (self.top / self.norm[at])
        return np.where(np.isinf(kth), np.inf, np.sqrt(np.maximum(0, 2 * (self.top**2 - kth))))

    def _visit(self, node, at: np.ndarray, factor: float) -> None:
        if not len(at):
            return
        if isinstance(node, np.ndarray):
            return self._leaf(node, at)
        v, radius, inside, outside = node
        dot = (self.q[at] @ self.x[v]) * (self.top / self.norm[at])
        gap = np.sqrt(np.maximum(0, 2 * (self.top**2 - dot))) - radius
        near, slack = gap <= 0, 1e-6 * self.top
        self._visit(inside, at[near], factor)
        self._visit(outside, at[~near], factor)
        for child, other, sign in ((inside, ~near, 1), (outside, near, -1)):
            rest = at[other]
            self._visit(child, rest[sign * gap[other] * factor <= self._reach(rest) + slack], factor)

    def _leaf(self, rows: np.ndarray, at: np.ndarray) -> None:
        rough = self.q[at] @ self.x[rows].T
        able = (rough >= np.maximum(self.best[at, -1:], self.least[at, None]) - 1e-9 * self.top * self.norm[at, None]) & (self.ids[rows][None] != self.qid[at, None])
        i, j = np.nonzero(able)
        exact = np.full(rough.shape, -np.inf)
        # One row's sum does not depend on its place, so equal vectors get equal scores.
        exact[i, j] = (self.q[at[i]] * self.x[rows[j]]).sum(1)
        scores = np.concatenate([self.best[at], exact], 1)
        ids = np.concatenate([self.found[at], np.broadcast_to(self.ids[rows], rough.shape)], 1)
        order = np.lexsort((ids, -scores), axis=-1)[:, : self.k]
        self.best[at] = np.take_along_axis(scores, order, 1)
        self.found[at] = np.where(np.isinf(self.best[at]), -1, np.take_along_axis(ids, order, 1))


def _valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k vectors of largest inner product with each query.

    Both frames have id_col and vec_col (other columns are not read). Scores are sums in double precision; ties go to
    the smaller id, a query's own id is left out. Null ids and vectors that are null, empty, zero or hold null or
    non-finite components take no part; vectors meet queries of their own length only. Repeated rows of one id count as
    rows of their own among the vectors; equal queries are asked once, and each different vector of a query id has ranks
    of its own. Empty tables give no rows. factor 1 is exact, above it prunes more.
    """
    rows = keep(_valid(vectors, id_col, vec_col))
    ask = _valid(queries, id_col, vec_col).select("id", "v", F.xxhash64("id", "v").alias("q")).dropDuplicates(["q"])
    top = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    top = (top or 1.0) * (1 + 1e-12)
    pivots = _pivots(rows, top)
    placed = keep(_placed(rows, pivots, top))
    parts = _parts(placed)
    data = _dealt(placed, parts)

    first = _searched(data, keep(_visits(ask.withColumn("least", F.lit(float("-inf"))), pivots, parts, top, factor, True)), k, top, factor)
    first = keep(first)
    bound = first.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    again = ask.join(bound, "q", "left").select("id", "v", "q", F.when(F.col("n") >= k, F.col("low")).otherwise(float("-inf")).alias("least"))
    rest = _searched(data, _visits(again, pivots, parts, top, factor, False), k, top, factor)
    found = first.unionByName(rest)
    order = W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pivots(rows: DataFrame, top: float) -> dict[int, np.ndarray]:
    """For each vector length, pivots that lie far from each other, with their further coordinate, of a bounded sample.

    A length costs a row on the driver. Only lengths of more than SHARD vectors are sampled, all in one job and BUDGET
    vectors at most; the others, and all if there are more such lengths than that, have one ball around the origin.
    """
    d = F.size("v")
    sizes = {r["d"]: r["n"] for r in rows.groupBy(d.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {n: _lifted(np.zeros((1, n)), top) for n in sizes}
    large = sorted(n for n, count in sizes.items() if count > SHARD)
    each = min(SAMPLE, BUDGET // len(large)) if large else 0
    if not each:
        return out
    # Each partition passes on its own first rows of a length only.
    first = F.row_number().over(W.partitionBy("d").orderBy("h", "id"))
    ranked = rows.select(d.alias("d"), F.xxhash64("id").alias("h"), "id", "v").where(F.col("d").isin(large)).withColumn("r", first).where(F.col("r") <= each)
    sample: dict[int, list] = {n: [] for n in large}
    for r in ranked.select("d", "h", "id", "v").collect():
        sample[r["d"]].append((r["h"], r["id"], r["v"]))
    for n, found in sample.items():
        x = _lifted(np.array([v for _, _, v in sorted(found)], float), top)
        chosen, far = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(PIVOTS, -(-sizes[n] // SHARD), len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[n] = x[chosen]
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, top * top - (x**2).sum(1)))[:, None]], 1)


def _blocks(batch: pa.RecordBatch, column: int):
    """(row numbers, vectors) of each vector length in a batch."""
    v = batch.column(column)
    flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(v.value_lengths().to_numpy())].astype(np.int64)
    size = np.diff(ends)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, flat[(ends[at][:, None] + np.arange(d)).reshape(-1)].reshape(len(at), d)


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray], top: float) -> DataFrame:
    """(id, v, d, ball, far, norm): the nearest pivot of each vector, and its distance."""

    def run(batches):
        for b in batches:
            d, ball, far, norm = np.zeros(len(b), np.int32), np.zeros(len(b), np.int32), np.zeros(len(b)), np.zeros(len(b))
            for at, x in _blocks(b, 1):
                dot = _lifted(x, top) @ pivots[x.shape[1]].T
                d[at], ball[at] = x.shape[1], dot.argmax(1)
                far[at] = np.sqrt(np.maximum(0, 2 * (top * top - dot.max(1))))
                norm[at] = _norm(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d), pa.array(ball), pa.array(far), pa.array(norm)], names=["id", "v", "d", "ball", "far", "norm"])

    return rows.mapInArrow(run, "id long, v array<double>, d int, ball int, far double, norm double")


def _norm(x: np.ndarray) -> np.ndarray:
    """The norm of each row, also where squares are beyond what a double holds."""
    big = np.abs(x).max(1, keepdims=True)
    return big[:, 0] * np.sqrt(((x / np.where(big > 0, big, 1)) ** 2).sum(1))


def _parts(placed: DataFrame) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """For each (length, ball): its radius, the norms between its ranges, each range's shards, each shard's largest norm.

    A ball of n vectors has about n / SHARD shards, in up to RANGES ranges of norms that hold about as many vectors each.
    PIVOTS rows a vector length, of RANGES numbers at most, come to the driver.
    """
    grid = [i / RANGES for i in range(1, RANGES)]
    sums = [F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm"), F.percentile_approx("norm", grid, 1000).alias("cuts")]
    out = {}
    for r in placed.groupBy("d", "ball").agg(*sums).collect():
        m = -(-r["n"] // SHARD)
        ranges = min(m, RANGES)
        upper = np.r_[[r["cuts"][-(-i * RANGES // ranges) - 1] for i in range(1, ranges)], r["norm"]]
        # Equal norms are one range, with as many shards as its share of the vectors asks for.
        cuts = np.unique(upper)[:-1]
        each = -(-m * np.bincount(np.searchsorted(cuts, upper, "left"), minlength=len(cuts) + 1) // ranges)
        out[r["d"], r["ball"]] = (r["radius"], cuts, each, np.repeat(np.r_[cuts, r["norm"]], each))
    return out


def _spread(ids: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """A number under n for each id, by a multiplicative hash."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def _dealt(placed: DataFrame, parts: dict) -> DataFrame:
    """The vectors with their shard (d, ball, part): by range of norms, and by id within one."""

    def run(batches):
        for b in batches:
            ids, d, ball, norm = (b.column(i).to_numpy() for i in (0, 2, 3, 4))
            part = np.zeros(len(b), np.int32)
            for key in set(zip(d.tolist(), ball.tolist(), strict=True)):
                at = np.flatnonzero((d == key[0]) & (ball == key[1]))
                _, cuts, each, _ = parts[key]
                own = np.searchsorted(cuts, norm[at], "left")
                part[at] = (np.cumsum(each) - each)[own] + _spread(ids[at], each[own])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b), np.int32)), b.column(2), b.column(3), pa.array(part), pa.array(np.zeros(len(b), np.int64)), b.column(0), pa.array(np.zeros(len(b))), b.column(1)], names=["kind", "d", "ball", "part", "q", "id", "least", "v"])

    return placed.select("id", "v", "d", "ball", "norm").mapInArrow(run, _SHARDED)


_SHARDED = "kind int, d int, ball int, part int, q long, id long, least double, v array<double>"


def _visits(ask: DataFrame, pivots: dict[int, np.ndarray], parts: dict, top: float, factor: float, first: bool) -> DataFrame:
    """A row for each shard that a query (id, v, q, least) visits: one of its nearest ball, or the others in reach.

    The first is one of the quarter of the ball's shards with the largest norms, by the query's hash.
    """

    def run(batches):
        for b in batches:
            least, keys = b.column(3).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            out = ([], [], [], [])
            for at, x in _blocks(b, 1):
                d = x.shape[1]
                own = [i for i in range(len(pivots.get(d, ()))) if (d, i) in parts]
                if not own:
                    continue
                norm = _norm(x)
                dot = (x @ pivots[d][own][:, :-1].T) * (top / norm)[:, None]
                gap = np.sqrt(np.maximum(0, 2 * (top * top - dot)))
                home = gap.argmin(1)
                with np.errstate(invalid="ignore"):
                    reach = np.where(np.isinf(least[at]), np.inf, np.sqrt(np.maximum(0, 2 * (top * top - least[at] * (top / norm)))))
                for j, ball in enumerate(own):
                    radius, _, _, most = parts[d, ball]
                    m = len(most)
                    mine = m - 1 - _spread(keys[at], -(-m // 4))
                    near = np.flatnonzero(home == j) if first else np.flatnonzero((gap[:, j] - radius) * factor <= reach + 1e-6 * top)
                    for part in range(m):
                        at_home = (home[near] == j) & (mine[near] == part)
                        # Factor 1 keeps every shard whose largest norm could reach the score that is to be beaten.
                        able = most[part] * norm[near] * (1 + 1e-9) >= least[at[near]] * (factor if not first else 1)
                        rows = at[near[at_home if first else ~at_home & able]]
                        out[0].append(rows), out[1].append(np.full(len(rows), d)), out[2].append(np.full(len(rows), ball)), out[3].append(np.full(len(rows), part))
            at = np.concatenate(out[0]) if out[0] else np.zeros(0, np.int64)
            whole = b.take(pa.array(at))
            d, ball, part = (pa.array(np.concatenate(c) if c else [], pa.int32()) for c in out[1:])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), d, ball, part, whole.column(2), whole.column(0), whole.column(3), whole.column(1)], names=["kind", "d", "ball", "part", "q", "id", "least", "v"])

    return ask.select("id", "v", "q", "least").mapInArrow(run, _SHARDED)


def _searched(data: DataFrame, asked: DataFrame, k: int, top: float, factor: float) -> DataFrame:
    """(q, query_id, vec_id, score): what each query finds in each shard that it visits."""
    keys = ["d", "ball", "part"]
    dealt = data.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind", "id")

    def run(batches):
        key, held, tree = None, [], None

        def pieces():
            for b in batches:
                d, ball, part, kind, q, ids, least = (b.column(b.schema.get_field_index(c)).to_numpy() for c in (*keys, "kind", "q", "id", "least"))
                flat = b.column(b.schema.get_field_index("v")).flatten().to_numpy()
                ends = np.r_[0, np.cumsum(d)]
                new = np.any([np.diff(c) != 0 for c in (kind, d, ball, part)], axis=0)
                cut = np.r_[0, np.flatnonzero(new) + 1, len(kind)] if len(kind) else [0]
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    yield (int(d[lo]), int(ball[lo]), int(part[lo])), int(kind[lo]), q[lo:hi], ids[lo:hi], least[lo:hi], flat[ends[lo] : ends[hi]].reshape(hi - lo, -1)

        for now, kind, q, ids, least, x in pieces():
            if now != key:
                key, held, tree = now, [], None
            if kind == 0:
                held.append((ids, x))
                continue
            if tree is None:
                if not held:
                    continue
                tree, held = VpTree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), top, k), []
            for lo in range(0, len(ids), BLOCK):
                own = slice(lo, lo + BLOCK)
                found, best = tree.search(ids[own], x[own], factor, least[own])
                ok = ~np.isinf(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[own], ok.sum(1))), pa.array(np.repeat(ids[own], ok.sum(1))), pa.array(found[ok]), pa.array(best[ok])], names=["q", "query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "q long, query_id long, vec_id long, score double")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


OP6_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
