"""Fuzzy memberships, their sharpening, and the mixing of experts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the smallest squared distance.
FLOOR = 1e-10


def distances(z: Sequence[Column], centres: Sequence[Sequence[float]]) -> Column:
    """Squared distances of a point to each centre, not under FLOOR."""
    return F.array(*[F.greatest(sum(((c - F.lit(float(v))) * (c - F.lit(float(v))) for c, v in zip(z, k, strict=True)), F.lit(0.0)), F.lit(FLOOR)) for k in centres])


def memberships(d: Column, m: float = 2.0) -> Column:
    """u_k = 1 / sum_j (D_k / D_j) ** (2 / (m - 1)), D squared distances."""
    e = F.lit(2.0 / (m - 1))
    return F.transform(d, lambda a: 1 / F.aggregate(d, F.lit(0.0), lambda s, b: s + F.pow(a / b, e)))


def hard_label(u: Column) -> Column:
    """The place of the largest membership; the lowest of equal ones."""
    return (F.array_position(u, F.array_max(u)) - 1).cast("int")


def _shares(a: Column) -> Column:
    return F.transform(a, lambda v: v / F.aggregate(a, F.lit(0.0), lambda s, x: s + x))


def sharpen(u: Column, temperature: float = 1.0, alpha: float = 1.0) -> Column:
    """softmax(log(u) / temperature), then powers of alpha, made to sum to 1; each is left out at 1."""
    if temperature != 1.0:
        u = _shares(F.transform(u, lambda v: F.exp(F.log(v + 1e-10) / temperature)))
    if alpha != 1.0:
        u = _shares(F.transform(u, lambda v: F.pow(v, F.lit(alpha))))
    return u


def mix(u: Column, experts: Sequence[Column]) -> Column:
    """The membership-weighted sum of the experts' forecasts of one step."""
    return sum((u[k] * e for k, e in enumerate(experts)), F.lit(0.0))


def centre_update(points: DataFrame, z: Sequence[str], k: int, m: float = 2.0) -> DataFrame:
    """(k, dim, value): sums of u**m * z over sums of u**m; one aggregation over points with u and z."""
    w = lambda i: F.pow(F.col("u")[i], F.lit(m))
    row = points.agg(*[(F.sum(w(i) * F.col(c)) / F.sum(w(i))).alias(f"c_{i}_{j}") for i in range(k) for j, c in enumerate(z)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(c).alias("dim"), F.col(f"c_{i}_{j}").alias("value")) for i in range(k) for j, c in enumerate(z)])))


def objective(points: DataFrame, z: Sequence[Column], centres: Sequence[Sequence[float]], m: float = 2.0) -> DataFrame:
    """(jm): the sum over points and centres of u ** m times the squared distance."""
    d = distances(z, centres)
    rows = points.select(d.alias("d")).withColumn("u", memberships(F.col("d"), m))
    return rows.agg(F.sum(F.aggregate(F.zip_with("u", "d", lambda u, v: F.pow(u, F.lit(m)) * v), F.lit(0.0), lambda s, v: s + v)).alias("jm"))


def fit(points: DataFrame, key: str, z: Sequence[str], k: int = 3, m: float = 2.0, starts: Sequence[int] = range(42, 52), most: int = 300, tolerance: float = 1e-5) -> dict:
    """Fuzzy centres of the start with the smallest objective: centres, jm, start, rounds, runs.

    All starts move together, in one aggregation a round over the points; only centres come to the driver. A start's
    memberships begin as hashes of (key, start, cluster), made to sum to 1, and it ends once no membership changes by
    `tolerance` or more. points should be kept, as every round reads them.
    """
    raw = lambda s, c: (F.pmod(F.xxhash64(F.col(key), F.lit(s), F.lit(c)), F.lit(1_000_003)) + 1).cast("double")
    own = [F.col(c) for c in z]
    now: dict[int, list | None] = {s: None for s in starts}
    before: dict[int, list | None] = {s: None for s in starts}
    runs: dict[int, dict] = {}
    u_of = lambda s, c: _shares(F.array(*[raw(s, i) for i in range(k)])) if c is None else memberships(distances(own, c), m)
    for turn in range(most + 1):
        active = [s for s in starts if s not in runs]
        if not active:
            break
        columns, sums = {}, []
        for s in active:
            columns |= {f"u{s}": u_of(s, now[s]), f"d{s}": distances(own, now[s]) if now[s] else F.array(*[F.lit(0.0)] * k), f"v{s}": u_of(s, before[s])}
            w = lambda i, s=s: F.pow(F.col(f"u{s}")[i], F.lit(m))
            sums += [F.sum(w(i) * F.col(c)).alias(f"s{s}_{i}_{j}") for i in range(k) for j, c in enumerate(z)] + [F.sum(w(i)).alias(f"w{s}_{i}") for i in range(k)]
            sums += [F.max(F.array_max(F.zip_with(f"u{s}", f"v{s}", lambda a, b: F.abs(a - b)))).alias(f"e{s}")]
            sums += [F.sum(sum(w(i) * F.col(f"d{s}")[i] for i in range(k))).alias(f"j{s}")]
        row = points.select(*z, *[v.alias(n) for n, v in columns.items()]).agg(*sums).first()
        for s in active:
            if row[f"w{s}_0"] is None:
                raise ValueError("no points to fit")
            done = now[s] is not None and (row[f"e{s}"] < tolerance or turn == most)
            if done:
                runs[s] = {"centres": now[s], "jm": row[f"j{s}"], "rounds": turn}
            else:
                before[s], now[s] = now[s], [[row[f"s{s}_{i}_{j}"] / row[f"w{s}_{i}"] for j in range(len(z))] for i in range(k)]
    start = min(starts, key=lambda s: runs[s]["jm"])  # the first of equal ones
    return runs[start] | {"start": start, "runs": runs}


def centre_distances(centres: DataFrame) -> DataFrame:
    """(k1, k2, distance) between all centres of a table (k, dim, value)."""
    a, b = centres.select(F.col("k").alias("k1"), "dim", F.col("value").alias("v1")), centres.select(F.col("k").alias("k2"), "dim", F.col("value").alias("v2"))
    return a.join(b, "dim").groupBy("k1", "k2").agg(F.sqrt(F.sum(F.pow(F.col("v1") - F.col("v2"), F.lit(2.0)))).alias("distance"))


def _distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def davies_bouldin(points: DataFrame, z: Sequence[str], label: str = "label") -> DataFrame:
    """(davies_bouldin): the mean over clusters of the largest (spread + spread) / distance; centroids are label means."""
    centroid = points.groupBy(label).agg(*[F.avg(c).alias(f"c_{c}") for c in z])
    spread = points.join(F.broadcast(centroid), label).groupBy(label, *[f"c_{c}" for c in z]).agg(F.avg(_distance([F.col(c) for c in z], [F.col(f"c_{c}") for c in z])).alias("spread"))
    a, b = (spread.select(*[F.col(c).alias(f"{c}_{x}") for c in spread.columns]) for x in "ab")  # a row a cluster
    pairs = a.join(F.broadcast(b), F.col(f"{label}_a") != F.col(f"{label}_b"))
    ratio = (F.col("spread_a") + F.col("spread_b")) / _distance([F.col(f"c_{c}_a") for c in z], [F.col(f"c_{c}_b") for c in z])
    return pairs.groupBy(f"{label}_a").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


#: Points of a tile: a task holds two tiles, and the distances between TILE points and ROWS others, at once.
TILE, ROWS = 4_096, 512


def distance_sums(queries: DataFrame, points: DataFrame, key: str, z: Sequence[str], label: str = "label") -> DataFrame:
    """(q, own, label, s, n): for each query, the sum of its distances to the points of each cluster, and their number.

    Both sides are packed into tiles of about TILE rows, and each pair of tiles is one row, worked on as a block: what is
    shuffled are tiles, and sums a query, tile and cluster. All pairs are looked at, which this measure asks for.
    """
    names = [f"z{i}" for i in range(len(z))]

    def tiles(df: DataFrame, n: int, at: str) -> DataFrame:
        row = F.struct(F.col(key).alias("k"), F.col(label).cast("long").alias("l"), *[F.col(c).cast("double").alias(m) for c, m in zip(z, names, strict=True)])
        return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias(at)).agg(F.collect_list(row).alias(f"r{at}"))

    n_i, n_j = (max(1, -(-df.count() // TILE)) for df in (queries, points))
    pairs = tiles(queries, n_i, "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_j - 1)).cast("array<long>"))).join(tiles(points, n_j, "j"), "j")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        side = lambda rows: (rows.field("k"), rows.field("l").to_numpy(), np.stack([rows.field(m).to_numpy(zero_copy_only=False) for m in names], 1))
        for b in batches:
            for i in range(len(b)):
                (keys, own, q), (_, labels, p) = (side(b.column(c).slice(i, 1).flatten()) for c in (0, 1))
                found, at = np.unique(labels, return_inverse=True)
                one = np.eye(len(found))[at]
                sums = np.concatenate([np.sqrt(((q[lo : lo + ROWS, None, :] - p[None]) ** 2).sum(2)) @ one for lo in range(0, len(q), ROWS)])
                for k, cluster in enumerate(found):
                    columns = [keys, pa.array(own), pa.array(np.full(len(q), cluster)), pa.array(sums[:, k]), pa.array(np.full(len(q), int(one[:, k].sum())))]
                    yield pa.RecordBatch.from_arrays(columns, names=["q", "own", "label", "s", "n"])

    blocks = pairs.select("ri", "rj").mapInArrow(run, f"q {queries.schema[key].dataType.simpleString()}, own long, label long, s double, n long")
    return blocks.groupBy("q", "own", "label").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _widths(sums: DataFrame) -> DataFrame:
    """(q, own, width): (b - a) / max(a, b) of each query; alone in a cluster counts 0."""
    mine = F.col("own") == F.col("label")
    each = sums.groupBy("q", "own").agg(F.max(F.when(mine & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("b"))
    return each.select("q", "own", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("width"))


def silhouette(points: DataFrame, key: str, z: Sequence[str], label: str = "label") -> DataFrame:
    """(silhouette): the exact mean of (b - a) / max(a, b) over all points, by Euclidean distance; keys are distinct.

    It takes the square of their number of distances; silhouette_estimate() takes a bounded number for each point.
    """
    points = points.persist()
    return _widths(distance_sums(points, points, key, z, label)).agg(F.avg("width").alias("silhouette"))


def silhouette_estimate(points: DataFrame, key: str, z: Sequence[str], label: str = "label", each: int = 500, seed: int = 0) -> DataFrame:
    """(estimate, error): the mean width from about `each` points of every cluster, and its standard error.

    A stratified sample, by hash: means of clusters are weighed by their sizes; each width is exact, against all points. A
    cluster of up to `each` points is taken whole and adds no error, nor does a point alone in its cluster.
    """
    points = points.persist()
    sizes = points.groupBy(label).agg(F.count(F.lit(1)).alias("size"))  # a row a cluster
    drawn = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = points.join(F.broadcast(sizes), label).where(drawn * F.col("size") < each).select(*points.columns)
    strata = _widths(distance_sums(sample, points, key, z, label)).groupBy("own").agg(F.avg("width").alias("m"), F.coalesce(F.var_samp("width"), F.lit(0.0)).alias("v"), F.count(F.lit(1)).alias("k"))
    strata = strata.join(F.broadcast(sizes.select(F.col(label).cast("long").alias("own"), "size")), "own")
    total = F.sum("size")
    error = F.sqrt(F.sum(F.col("size") * F.col("size") * F.col("v") / F.col("k") * (1 - F.col("k") / F.col("size")))) / total
    return strata.agg((F.sum(F.col("m") * F.col("size")) / total).alias("estimate"), error.alias("error"))


def semantic_names(train: DataFrame, power: str = "power_mean", names: Sequence[str] = ("clear", "cloudy", "low_irradiance"), *more: str) -> DataFrame:
    """(label, name, means): clusters of training rows named by falling mean power; equal ones by label."""
    from pyspark.sql import Window as W

    means = train.groupBy("label").agg(F.avg(power).alias(power), *[F.avg(c).alias(c) for c in more])
    rank = F.row_number().over(W.orderBy(F.desc(power), "label"))  # a row a cluster
    name = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in names]), rank), F.lit("unknown"))
    return means.withColumn("name", name)


def named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds name by label; unknown where there is none."""
    return rows.join(F.broadcast(names.select("label", "name")), "label", "left").withColumn("name", F.coalesce("name", F.lit("unknown")))
