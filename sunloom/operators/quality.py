"""Quality reports of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .windows import LX, MINUTES, H, by_day, candidates, split_by_day


def _series(df: DataFrame) -> list[str]:
    return [c for c in ("series_id",) if c in df.columns]


def gaps_by_day(df: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """A row for each series and day: its first and last time, rows, different times, and differences that are not one step."""
    odd = F.expr(f"ts - before <> INTERVAL {minutes} MINUTES").cast("long")
    rows = df.withColumn("before", F.lag("ts").over(by_day(df)))
    return rows.groupBy(*_series(df), "day").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ts").alias("times"), F.coalesce(F.sum(odd), F.lit(0)).alias("gaps"))


def report(df: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """First and last time, rows, copies of times, and differences that are not one step; a row a series.

    Differences are counted within each day and between the days' ends, so no window spans all rows.
    """
    own = _series(df)
    days = gaps_by_day(df, minutes)
    days = days.withColumn("before", F.lag("b").over(W.partitionBy(*own).orderBy("day")))  # a row for each day only
    cross = F.coalesce(F.expr(f"a - before <> INTERVAL {minutes} MINUTES").cast("long"), F.lit(0))
    return days.groupBy(*own).agg(
        F.min("a").alias("start_ts"), F.max("b").alias("end_ts"), F.sum("n_rows").alias("total_rows"),
        (F.sum("n_rows") - F.sum("times")).alias("duplicate_count"), F.sum(F.col("gaps") + cross).alias("gap_count"),
    )


def sorted_before(df: DataFrame) -> DataFrame:
    """(is_sorted): whether times never fall in the order of row_id, as read from a file.

    row_id is a Spark row number, whose high bits are the part of the file; order is tested within parts and between
    their ends.
    """
    rows = df.select("ts", "row_id", F.shiftright("row_id", 33).alias("part"))
    rows = rows.withColumn("before", F.lag("ts").over(W.partitionBy("part").orderBy("row_id")))
    parts = rows.groupBy("part").agg(F.coalesce(F.bool_and(F.col("ts") >= F.col("before")), F.lit(True)).alias("ok"), F.min_by("ts", "row_id").alias("a"), F.max_by("ts", "row_id").alias("b"))
    parts = parts.withColumn("before", F.lag("b").over(W.orderBy("part")))  # a row for each part of the file
    return parts.agg(F.coalesce(F.bool_and(F.col("ok") & F.coalesce(F.col("a") >= F.col("before"), F.lit(True))), F.lit(True)).alias("is_sorted"))


def daylight_by_day(df: DataFrame) -> DataFrame:
    """(series_id, if there is one), day, rows and daylight rows; days without daylight count 0."""
    return df.groupBy(*[c for c in ("series_id", "day") if c in df.columns]).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("is_daylight").cast("long")).alias("daylight_rows"))


def ramps_by_day(df: DataFrame, column: str = "power") -> DataFrame:
    """(series_id, if there is one), day, and mean, 95th percentile and largest of the column's steps within the day."""
    keys = [c for c in ("series_id", "day") if c in df.columns]
    w = W.partitionBy(*keys).orderBy("ts", *[c for c in ("row_id",) if c in df.columns])
    rows = df.withColumn("ramp", F.abs(F.col(column) - F.lag(column).over(w)))
    return rows.groupBy(*keys).agg(F.avg("ramp").alias("mean_ramp"), F.expr("percentile(ramp, 0.95)").alias("p95_ramp"), F.max("ramp").alias("max_ramp"))


def daylight_stats(df: DataFrame) -> DataFrame:
    """Rows by daylight, their shares, and the smallest, median and largest number a day."""
    days = daylight_by_day(df)
    return days.agg(
        F.sum("n_rows").alias("total_rows"), F.sum("daylight_rows").alias("daylight_rows"), (F.sum("n_rows") - F.sum("daylight_rows")).alias("night_rows"),
        F.round(F.try_divide(F.sum("daylight_rows"), F.sum("n_rows")), 6).alias("daylight_ratio"), F.round(F.try_divide(F.sum("n_rows") - F.sum("daylight_rows"), F.sum("n_rows")), 6).alias("night_ratio"),
        F.min("daylight_rows").alias("daily_min"), F.expr("percentile(daylight_rows, 0.5)").alias("daily_median"), F.max("daylight_rows").alias("daily_max"),
    )


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...], parts: int = 64) -> DataFrame:
    """(share, value): exact quantiles with linear interpolation.

    Values are counted, so equal ones are one row, and dealt to parts between approximate quantiles. Each part ranks its
    own and needs only the number of rows of the parts before it, so no task holds the column.
    """
    cuts = sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.005)))
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    part = F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda x: x <= F.col("v"))) if cuts else F.lit(0)
    values = values.withColumn("part", part)
    ranked = values.withColumn("upto", F.sum("c").over(W.partitionBy("part").orderBy("v")))
    # A row for each part.
    sizes = values.groupBy("part").agg(F.sum("c").alias("size")).withColumn("base", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("size").over(W.partitionBy()))
    ranked = ranked.join(F.broadcast(sizes.select("part", "base", "n")), "part").select("v", (F.col("base") + F.col("upto") - F.col("c")).alias("lo"), (F.col("base") + F.col("upto") - 1).alias("hi"), "n")
    ask = F.broadcast(df.sparkSession.createDataFrame([(float(s),) for s in shares], "share double"))
    place = F.col("share") * (F.col("n") - 1)
    near = ranked.join(ask, (F.col("lo") <= F.ceil(place)) & (F.col("hi") >= F.floor(place)))
    at = lambda edge: F.max(F.when((F.col("lo") <= edge) & (F.col("hi") >= edge), F.col("v")))
    ends = near.groupBy("share").agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"), F.max(place - F.floor(place)).alias("w"))
    return ends.select("share", (F.col("a") + F.col("w") * (F.col("b") - F.col("a"))).alias("value"))


def profile(df: DataFrame, column: str = "power") -> DataFrame:
    """Count, mean, sample deviation, extremes, exact quantiles, and percentages above 0 and below 1."""
    at = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    r = lambda c: F.round(c, 6)
    own = df.agg(
        F.count(column).alias("n"), r(F.avg(column)).alias("mean"), r(F.stddev_samp(column)).alias("std"), r(F.min(column)).alias("min"), r(F.max(column)).alias("max"),
        r(F.avg((F.col(column) > 0).cast("int")) * 100).alias("pct_positive"), r(F.avg((F.col(column) < 1).cast("int")) * 100).alias("pct_below_1"),
    )
    found = quantiles(df, column, tuple(at.values())).agg(*[r(F.max(F.when(F.col("share") == p, F.col("value")))).alias(k) for k, p in at.items()])
    return own.join(F.broadcast(found), F.lit(True))  # one row each


def ramps(df: DataFrame, column: str = "power", above: float | None = None) -> DataFrame:
    """(n, mean_ramp, p95_ramp, max_ramp) of the sizes of steps between rows that follow each other, over days too.

    With `above`, rows of smaller values are left out first, so steps are between the rows that stay. Steps between days
    come from the days' ends, so no window spans all rows.
    """
    df = df if above is None else df.where(F.col(column) > above)
    own, w = _series(df), by_day(df)
    rows = df.withColumn("step", F.col(column) - F.lag(column).over(w))
    order = F.struct("ts", *[c for c in ("row_id",) if c in df.columns])
    days = df.groupBy(*own, "day").agg(F.min_by(column, order).alias("a"), F.max_by(column, order).alias("b"))
    days = days.withColumn("step", F.col("a") - F.lag("b").over(W.partitionBy(*own).orderBy("day")))  # a row for each day only
    both = rows.select(F.abs("step").alias("ramp")).unionByName(days.select(F.abs("step").alias("ramp"))).where("ramp IS NOT NULL").persist()  # numbers only, read four times
    p95 = quantiles(both, "ramp", (0.95,)).select(F.round("value", 6).alias("p95_ramp"))
    total = both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ramp"), 6).alias("mean_ramp"), F.round(F.max("ramp"), 6).alias("max_ramp"))
    return total.join(F.broadcast(p95), F.lit(True), "left")  # one row each


def drop_vs_mask(df: DataFrame, lx: int = LX, h: int = H) -> DataFrame:
    """(mode, split, n): windows when night rows are dropped before cutting, and when only night anchors are left out."""
    out = []
    for mode, rows in (("drop", df.where("is_daylight")), ("mask", df)):
        ok = candidates(split_by_day(rows), lx, h).where("status = 'ok'")
        out.append(ok.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "split", "n"))
    return out[0].unionByName(out[1])
