"""Distributed union-find and the search for links inside buckets, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bounded, keep

#: Rows of a bucket that one task compares with the others of the bucket.
SHARE = 500


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that can be reached.

    Alternates large-star and small-star steps until nothing changes; each step is two shuffles of the links, whose
    hot nodes adaptive execution can split. Loops and repeated links do no harm; no links give no rows.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = None
    while state != (state := _state(edges)):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        del both, low
        edges = keep(small.select("e.u", "e.v").where("u > v").distinct())
        del small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def shared_buckets(sketches: DataFrame, bands: int, rounds: int, placed: bool = True) -> DataFrame:
    """(key, node, n, low) of the buckets that hold several nodes; low is the smallest of them.

    sketches: a kept frame (node, n, keys), keys with a bucket key, or null, for each of `bands` bands. A part of the keys
    is looked up at a time, so that only they are shuffled, and on disk, at once: a few bands if keys are placed, which
    means that equal keys have the same place in each node's array, else those whose value falls into the round.
    """
    each, found = -(-bands // rounds), []
    for i, lo in enumerate(range(0, bands, each)):
        turn = F.slice("keys", lo + 1, each) if placed else F.filter("keys", lambda k: F.pmod(k, F.lit(-(-bands // each))) == i)  # noqa: B023
        own = sketches.select(F.explode(turn).alias("key"), "node", "n").where("key IS NOT NULL")
        ends = bounded(own.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low"))
        found.append(keep(own.join(ends, "key")))
        del own, ends
    # Few rows in the partitions of all rounds: no more of them than after a shuffle.
    return reduce(DataFrame.unionByName, found).coalesce(int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def connect(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], fits: Callable[[str, str], Column], across: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the nodes that have a verified link to another node of one of their buckets.

    shared: as shared_buckets() gives it. verify: gives those of the pairs (a, b) that are links. First each node meets
    one other, the smallest of all its buckets, which joins most of a large group at a pair a node. Of the buckets that
    then still hold more than one component, each node meets the smallest node of the smallest component. What is still
    apart compares the pairs across components, so no link that could join two components is left out; fits is a cheap
    condition on them. across, where it is given, does this last step: from the rows (key, node, n, m, label) of buckets
    of m nodes that hold several components it gives the links (a, b). The rows of a large bucket are dealt to several
    tasks.
    """
    pairs = keep(shared.groupBy("node").agg(F.min("low").alias("a")).where("a < node").select("a", F.col("node").alias("b")))
    links = keep(verify(pairs))
    told, label = _mixed(shared.drop("low"), links)

    first = told.groupBy("key").agg(F.min(F.struct("label", "node")).alias("first"))
    met = told.join(first, "key").where(F.col("label") > F.col("first.label"))
    met = met.select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    met = keep(met)
    more = keep(verify(met))
    links, pairs = links.unionByName(more), pairs.unionByName(met)
    told, label = _mixed(told.select("key", "node", "n"), links)
    del first, met, more

    if across is None:
        parts, part = blocks()
        side = lambda x, p: told.withColumn("part", p).select("key", "part", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "label")])
        both = side("a", part).join(side("b", F.explode(F.sequence(F.lit(0), parts - 1))), ["key", "part"]).where((F.col("label_a") < F.col("label_b")) & fits("_a", "_b"))
        both = keep(both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
        more = keep(verify(both))
    else:
        more = keep(across(told))
    return label if more.isEmpty() else components(links.unionByName(more))


def blocks() -> tuple[Column, Column]:
    """The number of parts of a bucket of m nodes, and the part of a node: a task compares SHARE of them or so with others."""
    parts = F.ceil(F.col("m") / SHARE).cast("int")
    return parts, F.pmod(F.xxhash64("node"), parts).cast("int")


def _mixed(shared: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, with a label, of the buckets that hold more than one component of the links; and the components."""
    label = components(links)
    told = shared.join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    mixed = told.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("m")).where("l < h").select("key", "m")
    return keep(told.join(mixed, "key")), label
