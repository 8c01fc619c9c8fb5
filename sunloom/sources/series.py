"""Sources of regular series: sensor tables, and event tables bucketed to a fixed step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "15 minutes"


def read_sensor_csv(spark: SparkSession, path: str, columns: dict[str, str], fmt: str = "yyyy-MM-dd HH:mm:ss", series_id: str = "all") -> DataFrame:
    """A CSV sensor table: series_id, row_id, ts, the other columns as doubles, day.

    columns gives the file's name for each of ours, ts among them. Times are parsed strictly, so a bad one is an error; a
    number that is NaN or empty becomes NULL. row_id numbers the rows in the file's order, so equal times have an order.
    """
    raw = spark.read.csv(path, header=True)  # all strings: no pass over the file to guess types
    number = lambda c: F.col(f"`{c}`").cast("double")
    values = [F.when(~F.isnan(number(c)), number(c)).alias(n) for n, c in columns.items() if n != "ts"]
    rows = raw.select(F.lit(series_id).alias("series_id"), F.monotonically_increasing_id().alias("row_id"), F.to_timestamp_ntz(F.col(f"`{columns['ts']}`"), F.lit(fmt)).alias("ts"), *values)
    return rows.withColumn("day", F.to_date("ts"))


def from_events(events: DataFrame, step: str = STEP, series: str | None = None) -> DataFrame:
    """One row for each step that has events: ts, tsi, dni, ghi, temp, atm, power, day.

    With a column `series`, each of its values is a series of its own, in series_id.
    """
    keys = [F.col(series).alias("series_id")] if series else []
    rows = events.groupBy(*keys, F.window("ts", step).alias("w")).agg(
        F.count(F.lit(1)).cast("double").alias("tsi"), F.max("value").alias("dni"), F.min("value").alias("ghi"),
        F.avg("value").alias("temp"), F.countDistinct("user_id").cast("double").alias("atm"), F.sum("value").alias("power"),
    )
    return rows.select(*(["series_id"] if series else []), F.col("w.start").alias("ts"), "tsi", "dni", "ghi", "temp", "atm", "power", F.to_date("w.start").alias("day"))


def dense(series: DataFrame, step: str = STEP) -> DataFrame:
    """The series on a full grid of whole days, empty steps filled with zero; each series_id, if there is one, on its own."""
    keys = [c for c in ("series_id",) if c in series.columns]
    ends = series.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL")
    grid = ends.select(*keys, F.explode(F.expr(f"sequence(CAST(a AS TIMESTAMP_NTZ), CAST(date_add(b, 1) AS TIMESTAMP_NTZ) - INTERVAL {step}, INTERVAL {step})")).alias("ts"))
    names = [c for c in series.columns if c not in ("ts", "day", *keys)]
    return grid.join(series.drop("day"), [*keys, "ts"], "left").select(*keys, "ts", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names], F.to_date("ts").alias("day"))
