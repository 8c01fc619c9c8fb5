"""Queries of the fitted forecasters, on the windows of the events' series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, scaling, training, windows
from ..operators.neural import Shape
from . import events
from .events import _L, CAPACITY

#: A small model and few epochs, so that the query is quick; all windows of train and val are used.
SHAPE = Shape(hidden=16, layers=2, dropout=0.1)
OPTIONS = training.Options(lr=5e-3, batch=256, epochs=10, patience=3)
WARM = training.Options(lr=5e-3 * 0.1, batch=256, epochs=3, patience=3, monitor="loss")
#: Mini-batches of the loss aggregates; epochs (days) without improvement after which a fit would stop.
BATCHES, PATIENCE = 7, 3


def loss_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of persistence errors in shares of the capacity: the mean of batch means and the mean over rows, by split.

    A batch is a multiplicative hash of the anchor's step, modulo BATCHES.
    """
    step = F.expr("unix_seconds(CAST(anchor_ts AS TIMESTAMP)) DIV 900")
    batch = F.shiftright(F.pmod(step * F.lit(2654435761), F.lit(1 << 32)), 16)
    long = events._long(spark, sf_dir).select("split", ((F.col("yhat") - F.col("y")) / CAPACITY).alias("e"), batch.alias("hash"))
    parts = [training.loss_aggregates(long.where(F.col("split") == s), F.pmod("hash", F.lit(BATCHES))).select(F.lit(s).alias("split"), "*") for s in ("train", "val", "test")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("n > 0")
    return out.select("split", F.round("loss_batches", 8).alias("loss_batches"), F.round("loss_rows", 8).alias("loss_rows"), "n", "n_batches")


def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine of early stops, over the daily persistence error by split: days are its epochs."""
    long = windows.steps(windows.persistence(events.cut(spark, sf_dir).where("status = 'ok'").select("day", "split", "x", "y")))
    days = long.groupBy("split", "day").agg(F.round(F.sqrt(F.avg((F.col("yhat") - F.col("y")) ** 2)), 6).alias("metric"))
    from pyspark.sql import Window as W

    numbered = days.select("split", F.row_number().over(W.partitionBy("split").orderBy("day")).alias("epoch"), "metric")
    return training.early_stops(numbered, PATIENCE, keys=["split"]).select("split", "epoch", "metric", "best_epoch", "best", "since")


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The routed windows with scaled inputs, and their training rows by label; both persisted."""
    routed = events.routed(spark, sf_dir).select("anchor_ts", "split", "label", "u", "x", "y")
    scaled = scaling.fit_windows(routed.where("split = 'train'")).windows(routed).persist()
    return scaled, training.examples(scaled, CAPACITY, F.col("label")).persist()


def lstm_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix errors on the splits val and test of an LSTM that is fitted on train and stopped by val."""
    scaled, rows = _rows(spark, sf_dir)
    fitted = training.fit(rows.withColumn("label", F.lit(0)), SHAPE, OPTIONS)
    long = windows.steps(training.forecast(scaled.where("split <> 'train'").select("split", "x", "y"), fitted, CAPACITY))
    return metrics.prefix_metrics(long, CAPACITY, "split")


def expert_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of experts on test, hard and soft: begun from the common model and fitted on, a cluster each."""
    scaled, rows = _rows(spark, sf_dir)
    base = training.fit(rows.withColumn("label", F.lit(0)), SHAPE, OPTIONS)
    warm = training.fit(rows, SHAPE, WARM, {k: base.weights[0] for k in range(3)} if base.weights else None)
    test = scaled.where("split = 'test'").select("label", "u", "x", "y")
    hard = windows.steps(training.forecast(test, warm, CAPACITY, label="label").where("yhat IS NOT NULL"))
    soft = windows.steps(training.forecast(test, warm, CAPACITY, soft="u"))
    both = hard.select(F.lit("hard").alias("routing"), "step", "y", "yhat").unionByName(soft.select(F.lit("soft").alias("routing"), "step", "y", "yhat"))
    return metrics.prefix_metrics(both, CAPACITY, "routing")


SQL = {
    "loss_aggregates": f"""WITH {_L}, b AS (SELECT split, e / 500 AS e, ((CAST(epoch(anchor_ts) AS BIGINT) // 900 * 2654435761) % 4294967296) // 65536 % {BATCHES} AS batch FROM l),
        m AS (SELECT split, batch, avg(e * e) AS m, count(*) AS n FROM b GROUP BY split, batch)
        SELECT split, round(avg(m), 8) AS loss_batches, round(sum(m * n) / sum(n), 8) AS loss_rows, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_batches FROM m GROUP BY split""",
    "early_stopping": f"""WITH {_L}, days AS (SELECT split, CAST(anchor_ts AS DATE) AS day, round(sqrt(avg(e * e)), 6) AS metric FROM l GROUP BY 1, 2),
        o AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY day) AS epoch, metric FROM days),
        p AS (SELECT *, min(metric) OVER (PARTITION BY split ORDER BY epoch) AS best FROM o),
        q AS (SELECT p.*, (SELECT min(o.epoch) FROM o WHERE o.split = p.split AND o.metric = p.best) AS best_epoch FROM p),
        t AS (SELECT *, epoch - best_epoch AS since FROM q)
        SELECT split, epoch, metric, best_epoch, best, since FROM t WHERE epoch <= (SELECT coalesce(min(s.epoch), 1000000) FROM t s WHERE s.split = t.split AND s.since >= {PATIENCE})""",
}
QUERIES = {"loss_aggregates": loss_aggregates, "early_stopping": early_stopping, "lstm_forecast": lstm_forecast, "expert_forecast": expert_forecast}
