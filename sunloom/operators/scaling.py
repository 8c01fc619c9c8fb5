"""Standard scores of state vectors and of windows, principal components, and the router that chains them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import routing
from .windows import FEATURES

#: Fixed value: a deviation under it is none.
LEAST = 1e-8


def moments(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, mean, std, low, high): population moments and extremes of each column, in one aggregation."""
    parts = (("m", F.avg), ("s", F.stddev_pop), ("l", F.min), ("h", F.max))
    row = rows.agg(*[f(c).alias(f"{p}_{c}") for c in names for p, f in parts])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{p}_{c}").cast("double").alias(n) for (p, _), n in zip(parts, ("mean", "std", "low", "high"), strict=True)]) for c in names])))


def weighted_moments(rows: DataFrame, names: Sequence[str], weight: str) -> DataFrame:
    """As moments(), each row counted `weight` times; a missing value counts for nothing in its column.

    Two passes over the kept rows, the second about the means of the first, so a column without deviation has exactly none
    but for the last bits of its mean.
    """
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(weight).cast("double").alias("w")).persist()
    w = lambda c: F.when(F.col(c).isNotNull(), F.col("w"))
    means = rows.agg(*[F.try_divide(F.sum(w(c) * F.col(c)), F.sum(w(c))).alias(f"m_{c}") for c in names])  # one row
    about = rows.join(F.broadcast(means), F.lit(True))
    parts = [F.struct(F.lit(c).alias("feature"), F.max(f"m_{c}").alias("mean"), F.sqrt(F.try_divide(F.sum(w(c) * F.pow(F.col(c) - F.col(f"m_{c}"), F.lit(2.0))), F.sum(w(c)))).alias("std"), F.min(c).alias("low"), F.max(c).alias("high")) for c in names]
    return about.agg(F.array(*parts).alias("all")).select(F.inline("all"))


@dataclass(frozen=True)
class Scaler:
    """Means and deviations of columns, by name."""

    mean: dict[str, float]
    std: dict[str, float]

    @staticmethod
    def of(params: DataFrame, drop: bool) -> Scaler:
        """From rows (feature, mean, std); a feature without deviation is dropped, or only centred."""
        rows = [r for r in params.collect() if r["mean"] is not None]  # a row a feature
        flat = lambda s: s is None or s <= LEAST
        own = [r for r in rows if not (drop and flat(r["std"]))]
        return Scaler({r["feature"]: r["mean"] for r in own}, {r["feature"]: 1.0 if flat(r["std"]) else r["std"] for r in own})

    def score(self, name: str, value: Column | None = None) -> Column:
        return ((F.col(name) if value is None else value) - F.lit(self.mean[name])) / F.lit(self.std[name])

    def rows(self, df: DataFrame, *keep: str) -> DataFrame:
        """The columns `keep`, and every scaled feature."""
        return df.select(*keep, *[self.score(c).alias(c) for c in self.mean])

    def windows(self, df: DataFrame) -> DataFrame:
        """x with scaled features; the other columns as they are."""
        return df.withColumn("x", F.transform("x", lambda s: F.struct(*[self.score(f, s[f]).alias(f) for f in FEATURES])))


def fit_state(train: DataFrame, names: Sequence[str]) -> Scaler:
    """The scaler of state vectors: features that don't vary are dropped."""
    return Scaler.of(moments(train, names), drop=True)


def fit_windows(train: DataFrame) -> Scaler:
    """The scaler of windows: a source row counts once for each window that holds it."""
    return Scaler.of(moments(train.select(F.inline("x")), FEATURES), drop=False)


@dataclass(frozen=True)
class Components:
    """Principal axes, a list of weights by feature for each, and the shares of variance that they explain."""

    features: list[str]
    axes: list[list[float]]
    explained: list[float]

    def columns(self) -> list[Column]:
        return [sum((F.col(f) * F.lit(w) for f, w in zip(self.features, a, strict=True)), F.lit(0.0)) for a in self.axes]

    def cumulative(self) -> list[float]:
        out: list[float] = []
        for x in self.explained:
            out.append(x + (out[-1] if out else 0.0))
        return out


def principal(scaled: DataFrame, names: Sequence[str], k: int | None = 3, share: float = 0.95, most: int = 10, fallback: int = 8) -> Components:
    """The first k axes of scaled rows; without k as many as explain `share`, or `fallback` if that takes over `most`.

    An axis has the sign that makes its weight of largest size positive.
    """
    rows = VectorAssembler(inputCols=list(names), outputCol="v").transform(scaled.select(*names)).select("v")
    model = PCA(k=k or len(names), inputCol="v", outputCol="p").fit(rows)
    matrix, explained = model.pc.toArray(), [float(x) for x in model.explainedVariance.toArray()]
    if k is None:
        total, k = 0.0, len(explained)
        for i, x in enumerate(explained):
            total += x
            if total >= share:
                k = i + 1
                break
        k = k if k <= most else min(fallback, len(explained))
    axes = [[float(x) for x in (c if max(c, key=abs) > 0 else -c)] for c in matrix.T[:k]]
    return Components(list(names), axes, explained[:k])


@dataclass(frozen=True)
class Router:
    """From state vectors to memberships: scaler, axes, centres, and the clusters' names."""

    scaler: Scaler
    components: Components
    centres: list[list[float]]
    m: float = 2.0
    names: dict[int, str] = field(default_factory=dict)

    def points(self, df: DataFrame, *keep: str) -> DataFrame:
        """The columns `keep`, and p0, p1, ... : the scaled features on the axes."""
        scaled = df.select(*keep, *[self.scaler.score(c).alias(c) for c in self.components.features])
        return scaled.select(*keep, *[c.alias(f"p{i}") for i, c in enumerate(self.components.columns())])

    def route(self, df: DataFrame, *keep: str) -> DataFrame:
        """The columns `keep`, u (memberships), label (the largest; the lowest of equal ones) and name."""
        p = self.points(df, *keep)
        u = routing.memberships(routing.distances([F.col(f"p{i}") for i in range(len(self.components.axes))], self.centres), self.m)
        rows = p.select(*keep, u.alias("u")).withColumn("label", routing.hard_label(F.col("u")))
        names = F.create_map(*[F.lit(x) for kv in self.names.items() for x in kv]) if self.names else F.create_map().cast("map<int,string>")
        return rows.withColumn("name", F.coalesce(F.try_element_at(names, F.col("label")), F.lit("unknown")))

    def text(self) -> str:
        """The router as JSON; keys of names become strings."""
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def of(text: str) -> Router:
        d = json.loads(text)
        return Router(Scaler(**d["scaler"]), Components(**d["components"]), d["centres"], d["m"], {int(k): v for k, v in d["names"].items()})

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.text(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Router:
        return Router.of(spark.read.text(path).first()["value"])  # one short document


def fit_router(g: DataFrame, key: str, names: Sequence[str], k: int = 3, dims: int | None = 3, starts: Sequence[int] = range(42, 52), most: int = 300) -> tuple[Router, dict]:
    """A router fitted on the training rows of g (key, split, features), and the report of the fit.

    The scaled points should fit in the executors' memory, where they are cached for the rounds of the fit.
    """
    train = g.where("split = 'train'")
    scaler = fit_state(train, names)
    scaled = scaler.rows(train, key)
    components = principal(scaled, list(scaler.mean), dims)
    points = scaled.select(key, *[c.alias(f"p{i}") for i, c in enumerate(components.columns())]).cache()
    try:
        found = routing.fit(points, key, [f"p{i}" for i in range(len(components.axes))], k, starts=starts, most=most)
    finally:
        points.unpersist()
    bare = Router(scaler, components, found["centres"])
    labelled = bare.route(train, key, "power_mean")
    means = routing.semantic_names(labelled).select("label", "name").collect()  # a row a cluster
    return Router(scaler, components, found["centres"], 2.0, {r["label"]: r["name"] for r in means}), found
