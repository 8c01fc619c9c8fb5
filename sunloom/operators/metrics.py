"""Forecast errors by horizon, at one step or over all steps up to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Horizon -> steps.
HORIZONS = {"1h": 4, "2h": 8, "4h": 16}


def _errors(capacity: float) -> list:
    e = F.col("yhat") - F.col("y")
    rmse = F.sqrt(F.avg(e * e))
    return [F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(rmse, 6).alias("rmse"), F.round(rmse / capacity, 6).alias("nrmse"), F.count(F.lit(1)).alias("n")]


def _horizons(df: DataFrame) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(list(HORIZONS.items()), "horizon string, steps int"))


def point_metrics(long: DataFrame, capacity: float) -> DataFrame:
    """Errors at each horizon's own step, and over these steps together (overall)."""
    rows = long.join(_horizons(long), F.col("step") == F.col("steps"))
    return rows.rollup("horizon").agg(*_errors(capacity)).select(F.coalesce("horizon", F.lit("overall")).alias("horizon"), "mae", "rmse", "nrmse", "n")


def prefix_metrics(long: DataFrame, capacity: float, *by: str) -> DataFrame:
    """Errors over all steps up to each horizon, by further columns if given."""
    rows = long.join(_horizons(long), F.col("step") <= F.col("steps"))
    return rows.groupBy(*by, "horizon").agg(*_errors(capacity))


def sample_report(long: DataFrame, capacity: float) -> DataFrame:
    """Prefix errors by cluster and over all clusters together, with the mean membership of the own cluster.

    long has label, own (the sample's membership of its cluster), step, y, yhat. Samples have equal numbers of steps, so
    the mean over a horizon's rows is the mean over samples. Clusters without samples are left out; label is null, and
    scope overall, for all together; share is the cluster's part of the samples.
    """
    rows = long.join(_horizons(long), F.col("step") <= F.col("steps"))
    out = rows.groupingSets([["label", "horizon"], ["horizon"]], "label", "horizon").agg(
        *_errors(capacity), F.round(F.avg("own"), 6).alias("mean_membership"), F.count(F.when(F.col("step") == 1, 1)).alias("samples"), F.grouping("label").alias("g")
    )
    total = F.max("samples").over(W.partitionBy("horizon"))
    scope = F.when(F.col("g") == 1, "overall").otherwise("cluster")
    return out.select(scope.alias("scope"), "label", "horizon", "mae", "rmse", "nrmse", "n", "mean_membership", "samples", F.round(F.col("samples") / total, 6).alias("share"))


def deltas(hard: DataFrame, soft: DataFrame) -> DataFrame:
    """hard less soft nrmse for the (scope, label, horizon) that both reports have."""
    on = F.col("h.scope").eqNullSafe(F.col("s.scope")) & F.col("h.label").eqNullSafe(F.col("s.label")) & (F.col("h.horizon") == F.col("s.horizon"))
    both = hard.alias("h").join(soft.alias("s"), on)
    return both.select("h.scope", "h.label", "h.horizon", F.col("h.nrmse").alias("hard"), F.col("s.nrmse").alias("soft"), F.round(F.col("h.nrmse") - F.col("s.nrmse"), 6).alias("delta"))


def routing_deltas(long: DataFrame, capacity: float) -> DataFrame:
    """deltas() of the routings hard and soft, from long rows that tell their routing: one aggregation for both."""
    e = F.pow(F.col("yhat") - F.col("y"), F.lit(2.0))
    of = lambda r: F.round(F.sqrt(F.avg(F.when(F.col("routing") == r, e))) / capacity, 6).alias(r)
    rows = long.join(_horizons(long), F.col("step") <= F.col("steps"))
    out = rows.groupingSets([["label", "horizon"], ["horizon"]], "label", "horizon").agg(of("hard"), of("soft"), F.grouping("label").alias("g")).where("hard IS NOT NULL AND soft IS NOT NULL")
    scope = F.when(F.col("g") == 1, "overall").otherwise("cluster")
    return out.select(scope.alias("scope"), "label", "horizon", "hard", "soft", F.round(F.col("hard") - F.col("soft"), 6).alias("delta"))


def best(rows: DataFrame, score: str, *by: str) -> DataFrame:
    """The row of smallest score; of equal ones the one that comes first by the columns `by`."""
    names = [c for c in rows.columns if c not in (score, *by)]
    return rows.agg(F.min(F.struct(score, *by, *names)).alias("b")).select(*[F.col(f"b.{c}").alias(c) for c in rows.columns])


def named_rows(metrics: DataFrame) -> DataFrame:
    """Point metrics as rows of a report: Horizon, Steps, MAE, RMSE, nRMSE with four decimals, N_Samples; Overall last."""
    four = lambda c: F.format_string("%.4f", c).alias
    steps = F.element_at(F.create_map(*[F.lit(v) for kv in HORIZONS.items() for v in kv]), F.col("horizon"))
    overall = F.col("horizon") == "overall"
    rows = metrics.withColumn("steps", F.when(~overall, steps))
    return rows.select(
        F.when(overall, "Overall").otherwise(F.col("horizon")).alias("Horizon"), F.coalesce(F.col("steps").cast("string"), F.lit("-")).alias("Steps"),
        four("mae")("MAE"), four("rmse")("RMSE"), four("nrmse")("nRMSE"), F.col("n").alias("N_Samples"),
    ).orderBy(F.when(F.col("Horizon") == "Overall", 1).otherwise(0), F.length("Horizon"), "Horizon")


def pivoted(report: DataFrame, value: str = "nrmse") -> DataFrame:
    """A row for each scope and cluster with a column for each horizon."""
    return report.groupBy("scope", "label", "samples", "mean_membership").pivot("horizon", list(HORIZONS)).agg(F.first(value))
