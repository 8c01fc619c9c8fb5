"""Reports of a run as documents: results, a stage's clusters, fits and routers; each is one row with JSON text.

What goes into a document is aggregated before, so a document has a row a horizon, cluster, feature or start, whatever
the size of the series. Measures have six decimals; what is missing stays as null, so a kind of document has one schema.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import HORIZONS

#: The columns of the experts' table.
MEASURES = ("MAE", "RMSE", "nRMSE")
EXPERT_COLUMNS = ("Type", "Cluster", "Semantic", "N", *(f"{h}_{m}" for h in HORIZONS for m in MEASURES), "Avg_Membership")


def number(c: str | Column) -> Column:
    """A measure as it stands in a document; what is not finite is missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < 1e29), c).cast("decimal(38,6)")


def text(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def literal(value) -> Column:
    """A plain Python value as a column: maps become structs, lists arrays."""
    if isinstance(value, Mapping):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    return F.array(*map(literal, value)) if isinstance(value, (list, tuple)) else F.lit(value)


def one(*parts: DataFrame) -> DataFrame:
    """Frames of one row each, side by side."""
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), parts)


def ordered(order: Sequence[str], value: Column) -> Column:
    """An aggregate: the values of a small group in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("value")))), lambda r: r["value"])


def entries(order: Sequence[str], key: Column, value: Column) -> Column:
    """An aggregate: a map from key to value of a small group, in order."""
    return F.map_from_entries(ordered(order, F.struct(key.alias("key"), value.alias("value"))))


def results_document(metrics: DataFrame, experiment: str, model: str, when: str, daylight: Mapping | None = None) -> DataFrame:
    """(value): point metrics with the header of their run.

    Each horizon has its steps, errors and number of samples; total_samples is the number of windows. daylight tells how
    daylight was used, {"enabled": false} without it. Metrics without rows give empty horizons and null totals.
    """
    steps = F.element_at(F.create_map(*[F.lit(v) for kv in HORIZONS.items() for v in kv]), F.col("horizon"))
    rows = metrics.withColumn("steps", F.when(F.col("horizon") != "overall", steps))
    errors = [number(c).alias(c) for c in ("mae", "rmse", "nrmse")]
    own, total = F.col("steps").isNotNull(), F.col("horizon") == "overall"
    of = F.struct("horizon", F.struct(F.col("steps").alias("horizon_steps"), *errors, F.col("n").alias("n_samples")).alias("value"))
    pairs = F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("steps", of.alias("of"))))), lambda r: r["of"])
    row = rows.agg(F.max(F.when(own, F.col("n"))).alias("total_samples"), F.map_from_entries(pairs).alias("horizons"), F.max(F.when(total, F.struct(*errors, F.col("n").alias("n_samples")))).alias("overall"))
    head = [F.lit(model).alias("model_name"), F.lit(experiment).alias("experiment_name"), F.lit(when).alias("timestamp")]
    return row.select(text(F.struct(*head, "total_samples", literal(daylight or {"enabled": False}).alias("daylight_filter"), "horizons", "overall")).alias("value"))


def expert_rows(reports: Mapping[str, DataFrame], names: DataFrame) -> DataFrame:
    """The reports of sample_report() by type (Hard, Soft) as rows of text with four decimals (half up), with the clusters' names.

    names has label and name. First what holds for all clusters together, a row a type, then each cluster's types; in the
    order of `reports`. N and Avg_Membership are "-" for all together; a horizon without rows is "-".
    """
    both = reduce(DataFrame.unionByName, [r.select(F.lit(t).alias("Type"), F.lit(i).alias("place"), "scope", "label", "horizon", "mae", "rmse", "nrmse", "samples", "mean_membership") for i, (t, r) in enumerate(reports.items())])
    four = lambda c: F.coalesce(F.when(c.isNotNull(), F.format_string("%.4f", c)), F.lit("-"))
    at = lambda h, c: F.max(F.when(F.col("horizon") == h, F.col(c)))
    wide = both.groupBy("Type", "place", "scope", "label").agg(
        F.max("samples").alias("samples"), F.max(F.when(F.col("horizon") == list(HORIZONS)[-1], F.col("mean_membership"))).alias("u"),
        *[four(at(h, m.lower())).alias(f"{h}_{m}") for h in HORIZONS for m in MEASURES],
    )
    whole = F.col("scope") == "overall"
    rows = wide.join(F.broadcast(names.select("label", F.col("name").alias("Semantic"))), "label", "left")  # a row a cluster
    rows = rows.withColumn("Cluster", F.when(whole, "Overall").otherwise(F.col("label").cast("string")))
    rows = rows.withColumn("Semantic", F.when(whole, "").otherwise(F.coalesce("Semantic", F.lit("unknown"))))
    rows = rows.withColumn("N", F.when(whole, "-").otherwise(F.col("samples").cast("string"))).withColumn("Avg_Membership", F.when(whole, "-").otherwise(four(F.col("u"))))
    return rows.orderBy(F.when(whole, 0).otherwise(1), "label", "place").select(*EXPERT_COLUMNS)


def feature_document(moments: DataFrame, order: Sequence[str], least: float) -> DataFrame:
    """(value): the names of all features, of those that vary, and of those that don't; in the given order.

    moments has feature and std; a feature that has no row there counts as one that doesn't vary.
    """
    row = moments.agg(F.collect_set(F.when(F.col("std") > least, F.col("feature"))).alias("kept"))
    every = F.array(*map(F.lit, order))
    kept = lambda yes: F.filter(every, lambda f: F.array_contains("kept", f) == F.lit(yes))
    return row.select(text(F.struct(every.alias("original"), kept(True).alias("valid"), kept(False).alias("dropped"))).alias("value"))


def variance_rows(explained: Sequence[float], cumulative: Sequence[float], spark) -> DataFrame:
    """(component, explained, cumulative): the share of variance of each axis, from 1, and the sum up to it."""
    rows = [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(explained, cumulative, strict=True))]
    return spark.createDataFrame(rows, "component int, explained double, cumulative double")


def variance_document(shares: DataFrame, mode: str) -> DataFrame:
    """(value): the shares of variance_rows() as one document; mode tells how the number of axes was chosen."""
    row = shares.agg(
        F.count(F.lit(1)).alias("n_components"), F.lit(mode).alias("mode"), number(F.max("cumulative")).alias("total_explained_variance"),
        ordered(["component"], number("explained")).alias("explained_variance_ratio"), ordered(["component"], number("cumulative")).alias("cumulative_variance_ratio"),
    )
    return row.select(text(F.struct(*row.columns)).alias("value"))


def fit_document(found: Mapping, m: float, most: int, tolerance: float) -> str:
    """A fuzzy fit as routing.fit() reports it, with every start's objective and rounds; a few numbers, so a plain string."""
    runs = [{"start": s, "jm": r["jm"], "n_iter": r["rounds"]} for s, r in sorted(found["runs"].items())]
    head = {"n_clusters": len(found["centres"]), "m": m, "max_iter": most, "tol": tolerance, "n_init": len(runs)}
    return json.dumps(head | {"best_start": found["start"], "best_jm": found["jm"], "best_n_iter": found["rounds"], "centers": found["centres"], "run_history": runs})


def router_document(stats: DataFrame, m: float, paths: Mapping[str, str], measures: Sequence[str]) -> DataFrame:
    """(value): a router's clusters with their names and statistics, and where its parameters lie.

    stats has a row a cluster: label, name, n_samples and the measures.
    """
    key = F.col("label").cast("string")
    of = F.struct("n_samples", *[number(c).alias(c) for c in measures], F.col("name").alias("semantic_label"))
    row = stats.agg(F.count(F.lit(1)).alias("n_clusters"), entries(["label"], key, F.col("name")).alias("cluster_semantic_map"), entries(["label"], key, of).alias("cluster_stats"))
    return row.select(text(F.struct("n_clusters", F.lit(m).alias("m"), *[F.lit(p).alias(k) for k, p in paths.items()], "cluster_semantic_map", "cluster_stats")).alias("value"))


def stage_document(head: Mapping, n_features: int, n_kept: DataFrame, shares: DataFrame, mode: str, scores: DataFrame, distances: DataFrame, train: DataFrame, report: DataFrame, dropped: DataFrame) -> DataFrame:
    """(value): a stage of clusters in one document.

    n_kept: one row (n_kept), the features that vary of the n_features. shares: variance_rows(). scores: one row
    (silhouette, davies_bouldin). distances: (k1, k2, distance) of all centres. train: (label, n), clusters' sizes in
    training. report: sample_report() of the tested rows; a cluster's error at the last horizon is its overall one.
    dropped: (split, n), rows that were left out.
    """
    line = distances.groupBy("k1").agg(ordered(["k2"], number("distance")).alias("line"))  # a row a cluster
    matrix = line.agg(F.count(F.lit(1)).alias("k"), ordered(["k1"], F.col("line")).alias("matrix"))
    pca = shares.agg(F.count(F.lit(1)).alias("axes"), number(F.max("cumulative")).alias("explained"))
    parts = train.groupBy().agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("label", "n"))).alias("sizes"))
    ratios = F.map_from_entries(F.transform("sizes", lambda s: F.struct(F.concat(F.lit("cluster_"), s["label"].cast("string")), number(s["n"] / F.col("all")))))
    at = lambda h: number(F.max(F.when(F.col("horizon") == h, F.col("nrmse"))))
    last = list(HORIZONS)[-1]
    cluster = report.where("scope = 'cluster'").groupBy("label").agg(
        F.max("samples").alias("n_samples"), *[at(h).alias(f"nrmse_{h}") for h in HORIZONS], at(last).alias("nrmse_overall"),
        number(F.max(F.when(F.col("horizon") == last, F.col("mean_membership")))).alias("avg_membership"),
    )
    tested = cluster.agg(ordered(["label"], F.struct(F.col("label").alias("cluster_id"), *[c for c in cluster.columns if c != "label"])).alias("tested"))
    lost = dropped.agg(*[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"lost_{s}") for s in ("train", "val", "test")])
    row = one(n_kept, pca, scores, matrix, parts, tested, lost)
    return row.select(text(F.struct(
        *[literal(v).alias(k) for k, v in head.items()], F.lit(n_features).alias("g_dim_original"), F.col("n_kept").alias("g_dim_after_scaler"),
        F.struct(F.col("axes").alias("n_components"), F.lit(mode).alias("mode"), F.col("explained").alias("total_explained_variance")).alias("pca"),
        F.struct(F.col("k").alias("n_clusters"), number("silhouette").alias("silhouette_score"), number("davies_bouldin").alias("davies_bouldin_index"), F.col("matrix").alias("center_distances")).alias("fcm"),
        ratios.alias("cluster_ratios"), F.col("tested").alias("cluster_metrics_test"), F.struct(*[F.col(f"lost_{s}").alias(s) for s in ("train", "val", "test")]).alias("dropped_samples"),
    )).alias("value"))
