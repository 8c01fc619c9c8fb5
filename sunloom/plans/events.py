"""The queries: events in 15-minute steps play the sensor series."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import metrics, quality, routing, scaling, windows
from ..sources import series as source

#: Count of events from which a step is daylight, also of the looser flag that the comparison of masks takes, and the
#: capacity of the series.
THRESHOLD, LOOSE, CAPACITY = 3.0, 2.0, 500.0
#: Fixed centres over (tsi_mean, power_mean).
CENTRES = ((3.1, 0.3), (3.5, 0.36), (3.9, 0.42))
ALPHAS = (0.5, 1.0, 2.0, 3.0)
POINT = ("tsi_mean", "power_mean")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_events(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "value"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the series, from the times of the events alone."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("day")).distinct()


def flagged(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    return windows.flag_daylight(series(spark, sf_dir), threshold)


def cut(spark: SparkSession, sf_dir: str, capacity: float | None = None, threshold: float = THRESHOLD) -> DataFrame:
    return windows.candidates(windows.split_by_day(flagged(spark, sf_dir, threshold), days=days(spark, sf_dir)), capacity=capacity)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence errors on the test split of the dense series."""
    df = windows.flag_daylight(source.dense(series(spark, sf_dir)), THRESHOLD)
    own = windows.candidates(windows.split_by_day(df)).where("status <> 'discontinuous' AND split = 'test'")
    return metrics.point_metrics(windows.steps(windows.persistence(own.select("anchor_ts", "x", "y"))), CAPACITY)


def series_15min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("ts", "tsi", *[F.round(c, 6).alias(c) for c in ("dni", "ghi", "temp", "power")], "atm")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(series(spark, sf_dir))


def daylight_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("ts", "is_daylight")


def daylight_daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.daylight_stats(flagged(spark, sf_dir))


def drop_mode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.split_by_day(flagged(spark, sf_dir).where("is_daylight")).groupBy("split").agg(F.countDistinct("day").alias("days"), F.count(F.lit(1)).alias("n_rows"))


def split_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.split_by_day(series(spark, sf_dir)).select("day", "split").distinct()


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.split_by_day(series(spark, sf_dir)).groupBy("split").agg(F.countDistinct("day").alias("days"), F.count(F.lit(1)).alias("n_rows"))


def power_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(series(spark, sf_dir))


def ramp_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ramps_by_day(series(spark, sf_dir))
    return rows.select("day", *[F.round(c, 6).alias(c) for c in ("mean_ramp", "p95_ramp", "max_ramp")])


def window_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(spark, sf_dir).groupBy("split", "status").agg(F.count(F.lit(1)).alias("n"))


def windows_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cut(spark, sf_dir).where("status = 'ok'")
    return own.select("anchor_ts", "anchor_idx", "split", F.posexplode("x").alias("p", "r")).select("anchor_ts", "anchor_idx", "split", (F.col("p") + 1).alias("step"), F.col("r.tsi").alias("tsi"), F.round("r.power", 6).alias("power"))


def windows_all_daylight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(spark, sf_dir, threshold=LOOSE).where("status = 'ok' AND all_daylight").select("anchor_ts", "anchor_idx", "split")


def mask_added_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cut(spark, sf_dir, threshold=LOOSE).where("status = 'ok' AND NOT all_daylight")
    return own.groupBy(F.hour("anchor_ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def mask_logic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cut(spark, sf_dir, threshold=LOOSE).where("status = 'ok'").agg(F.count(F.lit(1)).alias("n_new"), F.coalesce(F.sum(F.col("all_daylight").cast("long")), F.lit(0)).alias("n_old"))
    return n.withColumn("added", F.col("n_new") - F.col("n_old")).withColumn("pct", F.round(F.try_divide(F.col("added") * 100.0, F.col("n_old")), 6))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.steps(windows.persistence(cut(spark, sf_dir).where("status = 'ok'").select("anchor_ts", "split", "x", "y")))


def persistence_point_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.point_metrics(_long(spark, sf_dir), CAPACITY)


def persistence_prefix_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.prefix_metrics(_long(spark, sf_dir), CAPACITY, "split")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(spark, sf_dir, CAPACITY).where("status = 'ok'").select("anchor_ts", "split", "x", "y", *windows.STATE)


def state_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("anchor_ts", *[F.round(c, 10).alias(c) for c in windows.STATE])


def finite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose statistics are all numbers, after every temp of daylight step 4 is made a NaN."""
    odd = flagged(spark, sf_dir).withColumn("temp", F.when(F.col("tsi") == 4, float("nan")).otherwise(F.col("temp")))
    g = windows.candidates(windows.split_by_day(odd, days=days(spark, sf_dir)), capacity=CAPACITY).where("status = 'ok'").select("split", *windows.STATE)
    kept = windows.finite(g).groupBy("split").agg(F.count(F.lit(1)).alias("n_kept"))
    return g.groupBy("split").agg(F.count(F.lit(1)).alias("n")).join(kept, "split", "left").select("split", "n", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


def scaler_g_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = scaling.moments(vectors(spark, sf_dir).where("split = 'train'"), windows.STATE)
    return long.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), (F.col("std") > scaling.LEAST).alias("kept"))


def _train_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments of the rows that training windows hold, as often as they hold them."""
    rows = windows.uses(windows.split_by_day(flagged(spark, sf_dir), days=days(spark, sf_dir)))
    return scaling.weighted_moments(rows, windows.FEATURES, "uses")


def scaler_x_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _train_moments(spark, sf_dir)
    return long.select("feature", F.round("mean", 6).alias("mean"), F.round(F.when(F.col("std") < scaling.LEAST, 1.0).otherwise(F.col("std")), 6).alias("std"))


def feature_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_moments(spark, sf_dir).select("feature", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean", "std")])


def state_vectors_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = vectors(spark, sf_dir).drop("x", "y")
    scaled = scaling.fit_state(g.where("split = 'train'"), windows.STATE).rows(g, "anchor_ts")
    return scaled.select("anchor_ts", *[F.round(c, 6).alias(c) for c in scaled.columns[1:]])


def windows_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cut(spark, sf_dir).where("status = 'ok'").select("anchor_ts", "split", "x")
    scaled = scaling.fit_windows(own.where("split = 'train'")).windows(own)
    return scaled.select("anchor_ts", F.posexplode("x").alias("p", "r")).select("anchor_ts", (F.col("p") + 1).alias("step"), *[F.round(F.col(f"r.{c}"), 6).alias(c) for c in windows.FEATURES])


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(vectors(spark, sf_dir))


def labelled(g: DataFrame) -> DataFrame:
    """Windows with memberships and label by the fixed centres."""
    g = g.select("anchor_ts", "split", "x", "y", "tsi_mean", "tsi_std", "power_mean")
    g = g.withColumn("d", routing.distances([F.col(c) for c in POINT], CENTRES)).withColumn("u", routing.memberships(F.col("d")))
    return g.withColumn("label", routing.hard_label(F.col("u")))


def fcm_membership_fixed_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select("anchor_ts", *[F.round(F.col("u")[k], 6).alias(f"u{k}") for k in range(3)], "label")


def fcm_center_update_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.centre_update(routed(spark, sf_dir).where("split = 'train'"), ("tsi_mean", "power_mean"), 3).withColumn("value", F.round("value", 6))


def cluster_sizes_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def sharpen_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = routing.sharpen(F.col("u"), 2.0, 1.5)
    return routed(spark, sf_dir).withColumn("s", s).select("anchor_ts", *[F.round(F.col("s")[k], 6).alias(f"s{k}") for k in range(3)])


def _experts() -> list:
    """Three plain forecasts of every step: the last value of the input, its mean, its first value."""
    p = F.col("x.power")
    return [F.element_at(p, -1), F.aggregate(p, F.lit(0.0), lambda s, v: s + v) / F.size(p), F.get(p, 0)]


def _flat(rows: DataFrame, value, *keep: str) -> DataFrame:
    """Long rows of a forecast that is the same for all steps."""
    return windows.steps(rows.select(*keep, "y", F.array_repeat(value, windows.H).alias("yhat")))


def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft mixtures of the experts over all alphas."""
    mixed = F.array(*[F.struct(F.lit(a).alias("alpha"), routing.mix(routing.sharpen(F.col("u"), 1.0, a), _experts()).alias("f")) for a in ALPHAS])
    long = routed(spark, sf_dir).select("y", F.explode(mixed).alias("m")).select("y", "m.alpha", "m.f")
    return metrics.prefix_metrics(_flat(long, F.col("f"), "alpha"), CAPACITY, "alpha")


def best_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best(alpha_sweep(spark, sf_dir).where("horizon = '4h'").select("nrmse", "alpha"), "nrmse", "alpha")


def hard_steps(rows: DataFrame, hard: bool = True) -> DataFrame:
    """Long rows of labelled windows: what each one's expert forecasts, or the mixture."""
    value = F.get(F.array(*_experts()), F.col("label")) if hard else routing.mix(F.col("u"), _experts())
    return _flat(rows.withColumn("own", F.col("u")[F.col("label")]), value, "label", "own")


def _report(spark: SparkSession, sf_dir: str, hard: bool) -> DataFrame:
    return metrics.sample_report(hard_steps(routed(spark, sf_dir), hard), CAPACITY)


def cluster_report_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, True)


def cluster_report_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, False)


def cluster_report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pivoted(_report(spark, sf_dir, True)).withColumnsRenamed({h: f"nrmse_{h}" for h in metrics.HORIZONS})


def soft_vs_hard_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forecasts stand on the window's row, so the windows are cut once and each row is scored under its routing."""
    hard, soft = F.get(F.array(*_experts()), F.col("label")), routing.mix(F.col("u"), _experts())
    rows = routed(spark, sf_dir).select("y", "label", F.col("u")[F.col("label")].alias("own"), F.explode(F.array(F.struct(F.lit("hard").alias("routing"), hard.alias("f")), F.struct(F.lit("soft").alias("routing"), soft.alias("f")))).alias("r"))
    long = _flat(rows.select("y", "label", "own", "r.routing", "r.f"), F.col("f"), "routing", "label", "own")
    return metrics.routing_deltas(long, CAPACITY)


def expert_union_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the union of what each expert forecasts for its own cluster."""
    rows, parts = routed(spark, sf_dir), None
    for k, e in enumerate(_experts()):
        own = _flat(rows.where(F.col("label") == k), e)
        parts = own if parts is None else parts.unionByName(own)
    return metrics.prefix_metrics(parts, CAPACITY)


def semantic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = routing.semantic_names(routed(spark, sf_dir).where("split = 'train'"), "power_mean", ("clear", "cloudy", "low_irradiance"), "tsi_mean", "tsi_std")
    return names.select("label", "name", *[F.round(c, 6).alias(c) for c in ("power_mean", "tsi_mean", "tsi_std")])


def named_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routed(spark, sf_dir).select("anchor_ts", "split", "label", "power_mean")
    names = routing.semantic_names(rows.where("split = 'train' AND label > 0"))
    return routing.named(rows, names).groupBy("split", "name").agg(F.count(F.lit(1)).alias("n"))


def cluster_sizes_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = routed(spark, sf_dir).groupBy("split").pivot("label", [0, 1, 2]).count()
    return wide.select("split", *[F.coalesce(F.col(str(k)), F.lit(0)).cast("long").alias(f"n{k}") for k in range(3)])


def fcm_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.objective(vectors(spark, sf_dir).where("split = 'train'"), [F.col(c) for c in POINT], CENTRES).select(F.round("jm", 6).alias("jm"))


def center_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the centres that one step of the fit gives."""
    return routing.centre_distances(fcm_center_update_one_step(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.davies_bouldin(routed(spark, sf_dir), POINT).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.silhouette(routed(spark, sf_dir), "anchor_ts", POINT).select(F.round("silhouette", 6).alias("silhouette"))


def intraday_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gaps_by_day(series(spark, sf_dir)).select("day", "n_rows", "gaps")


def daylight_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.daylight_by_day(flagged(spark, sf_dir))


def ramp_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ramps(series(spark, sf_dir).select("ts", "day", "power"))


def ramp_stats_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ramps(series(spark, sf_dir).select("ts", "day", "power"), above=150.0)


def sorted_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the events' times never fall in the order of their file, tested in blocks of 65,536 rows and between them."""
    at = F.col("_metadata.row_index")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.shiftleft(F.shiftright(at, 16), 33).bitwiseOR(at.bitwiseAND(F.lit(65_535))).alias("row_id"))
    return quality.sorted_before(rows)


def numeric_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes and means of every numeric column of the events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return scaling.moments(events, windows.numeric(events)).select("feature", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean")])


def drop_vs_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.drop_vs_mask(flagged(spark, sf_dir, LOOSE))


def windows_only_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that are cut when only they need daylight, but not when all their rows do."""
    ok = cut(spark, sf_dir, threshold=LOOSE).where("status = 'ok'")
    return windows.only_new(ok, ok.where("all_daylight")).select("anchor_ts", "split")


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.named_rows(persistence_point_metrics(spark, sf_dir))


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).orderBy("ts").limit(10).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "tsi", F.round("power", 6).alias("power"))


def batched_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a forecaster that runs on batches of windows: the mean power of the input."""

    def start():
        return lambda x: np.repeat(x[:, :, -1:].mean(1), windows.H, 1)

    own = cut(spark, sf_dir).where("status = 'ok'").select("anchor_ts", "x", "y")
    return metrics.point_metrics(windows.steps(windows.forecast(own, start)), CAPACITY)


_S = """s AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, CAST(count(*) AS DOUBLE) AS tsi, max(value) AS dni, min(value) AS ghi, avg(value) AS temp,
        CAST(count(DISTINCT user_id) AS DOUBLE) AS atm, sum(value) AS power FROM events GROUP BY 1),
f AS (SELECT *, CAST(ts AS DATE) AS day, coalesce(tsi >= 3, false) AS is_daylight FROM s)"""
_SPLIT = """, {name} AS (SELECT day, CASE WHEN k <= trunc(n * 0.7::DOUBLE) THEN 'train' WHEN k <= trunc(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM f {where})))"""
_D = _SPLIT.format(name="d", where="")
_W = f"""{_S}{_D},
r AS (SELECT f.*, split, row_number() OVER w AS rn, count(*) OVER (PARTITION BY f.day) AS n, coalesce(CAST(ts - lag(ts) OVER w <> INTERVAL 15 MINUTE AS INT), 0) AS brk
      FROM f JOIN d USING (day) WINDOW w AS (PARTITION BY f.day ORDER BY ts)),
c AS (SELECT *, sum(brk) OVER (PARTITION BY day ORDER BY ts) AS cb FROM r),
v AS (SELECT *, lead(cb, 15) OVER w - lag(cb, 16) OVER w AS breaks,
      min(is_daylight) OVER (PARTITION BY day ORDER BY ts ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING) AS all_daylight FROM c WINDOW w AS (PARTITION BY day ORDER BY ts)),
a AS (SELECT ts AS anchor_ts, day, split, rn, all_daylight, CASE WHEN breaks <> 0 THEN 'discontinuous' WHEN NOT is_daylight THEN 'night' ELSE 'ok' END AS status
      FROM v WHERE rn > 16 AND rn <= n - 15)"""
_LOOSE = _W.replace("tsi >= 3", "tsi >= 2")
_X = f"""{_W},
x AS (SELECT anchor_ts, a.split, CAST(b.rn - a.rn + 17 AS INT) AS step, b.tsi, b.dni, b.ghi, b.temp, b.atm, b.power, a.rn AS arn
      FROM a JOIN r b ON a.day = b.day AND b.rn BETWEEN a.rn - 16 AND a.rn - 1 WHERE status = 'ok')"""
_L = f"""{_X}, hz(horizon, steps) AS (VALUES ('1h', 4), ('2h', 8), ('4h', 16)),
y AS (SELECT anchor_ts, b.rn - a.rn + 1 AS step, b.power AS y, a.split FROM a JOIN r b ON a.day = b.day AND b.rn BETWEEN a.rn AND a.rn + 15 WHERE status = 'ok'),
l AS (SELECT y.*, x.power - y AS e FROM y JOIN x ON y.anchor_ts = x.anchor_ts AND x.step = 16)"""
_M = "round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(sqrt(avg(e * e)) / 500, 6) AS nrmse, count(*) AS n"


def _stats() -> str:
    out = []
    for c in ("tsi", "dni", "ghi"):
        out += [f"avg({c}) AS {c}_mean", f"stddev_pop({c}) AS {c}_std", f"min({c}) AS {c}_min", f"max({c}) AS {c}_max"]
        out += [f"avg(abs(d_{c})) AS {c}_dmean", f"stddev_pop(d_{c}) AS {c}_dstd", f"max(abs(d_{c})) AS {c}_dmax"]
    out += ["avg(power / 500) AS power_mean", "stddev_pop(power / 500) AS power_std", "avg(abs(d_power / 500)) AS power_dmean"]
    for c in ("temp", "atm"):
        out += [f"avg({c}) AS {c}_mean", f"stddev_pop({c}) AS {c}_std"]
    return ", ".join(out)


_NAMES = [x.rsplit(" AS ", 1)[1] for x in _stats().split(", ")]
_DIFFS = ", ".join(f"{c} - lag({c}) OVER w AS d_{c}" for c in ("tsi", "dni", "ghi", "power"))
_G = f"""{_L}, xd AS (SELECT *, {_DIFFS} FROM x WINDOW w AS (PARTITION BY anchor_ts ORDER BY step)),
g AS (SELECT anchor_ts, split, {_stats()} FROM xd GROUP BY anchor_ts, split)"""
_SQ = ", ".join(f"greatest(power(tsi_mean - {a}, 2) + power(power_mean - {b}, 2), 1e-10) AS d{k}" for k, (a, b) in enumerate(CENTRES))
_UU = ", ".join(f"1 / (power(d{k} / d0, 2) + power(d{k} / d1, 2) + power(d{k} / d2, 2)) AS u{k}" for k in range(3))
_U = f"""{_G}, q AS (SELECT anchor_ts, split, tsi_mean, tsi_std, power_mean, {_SQ} FROM g), u AS (SELECT *, {_UU} FROM q),
lab AS (SELECT *, CASE WHEN u0 >= u1 AND u0 >= u2 THEN 0 WHEN u1 >= u2 THEN 1 ELSE 2 END AS label FROM u)"""
_COUNTS = "SELECT split, count(DISTINCT day) AS days, count(*) AS n_rows FROM {0} JOIN {1} USING (day) GROUP BY split"

SQL = {
    "series_15min": f"WITH {_S} SELECT ts, tsi, round(dni, 6) AS dni, round(ghi, 6) AS ghi, round(temp, 6) AS temp, round(power, 6) AS power, atm FROM f",
    "quality_report": f"WITH {_S}, o AS (SELECT ts, ts - lag(ts) OVER (ORDER BY ts) AS d FROM f) SELECT min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS total_rows, count(*) - count(DISTINCT ts) AS duplicate_count, CAST(sum(CASE WHEN d <> INTERVAL 15 MINUTE THEN 1 ELSE 0 END) AS BIGINT) AS gap_count FROM o",
    "daylight_flag": f"WITH {_S} SELECT ts, is_daylight FROM f",
    "daylight_daily_stats": f"WITH {_S}, e AS (SELECT day, count(*) AS n, CAST(sum(CAST(is_daylight AS INT)) AS BIGINT) AS k FROM f GROUP BY day) SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(k) AS BIGINT) AS daylight_rows, CAST(sum(n) - sum(k) AS BIGINT) AS night_rows, round(sum(k) / sum(n), 6) AS daylight_ratio, round((sum(n) - sum(k)) / sum(n), 6) AS night_ratio, min(k) AS daily_min, quantile_cont(k, 0.5) AS daily_median, max(k) AS daily_max FROM e",
    "drop_mode_rows": f"WITH {_S}{_SPLIT.format(name='e', where='WHERE is_daylight')}, k AS (SELECT * FROM f WHERE is_daylight) " + _COUNTS.format("k", "e"),
    "split_days": f"WITH {_S}{_D} SELECT day, split FROM d",
    "split_counts": f"WITH {_S}{_D} " + _COUNTS.format("f", "d"),
    "power_profile": f"WITH {_S} SELECT count(power) AS n, round(avg(power), 6) AS mean, round(stddev_samp(power), 6) AS std, round(min(power), 6) AS min, round(max(power), 6) AS max, "
    + ", ".join(f"round(quantile_cont(power, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95))
    + ", round(avg(CAST(power > 0 AS INT)) * 100, 6) AS pct_positive, round(avg(CAST(power < 1 AS INT)) * 100, 6) AS pct_below_1 FROM f",
    "ramp_by_day": f"WITH {_S}, o AS (SELECT day, abs(power - lag(power) OVER (PARTITION BY day ORDER BY ts)) AS k FROM f) SELECT day, round(avg(k), 6) AS mean_ramp, round(quantile_cont(k, 0.95), 6) AS p95_ramp, round(max(k), 6) AS max_ramp FROM o GROUP BY day",
    "window_status_counts": f"WITH {_W} SELECT split, status, count(*) AS n FROM a GROUP BY ALL",
    "windows_flat": f"WITH {_X} SELECT anchor_ts, CAST(arn - 1 AS INT) AS anchor_idx, split, step, tsi, round(power, 6) AS power FROM x",
    "windows_all_daylight": f"WITH {_LOOSE} SELECT anchor_ts, CAST(rn - 1 AS INT) AS anchor_idx, split FROM a WHERE status = 'ok' AND all_daylight",
    "mask_added_by_hour": f"WITH {_LOOSE} SELECT CAST(hour(anchor_ts) AS INT) AS hour, count(*) AS n FROM a WHERE status = 'ok' AND NOT all_daylight GROUP BY 1",
    "mask_logic_counts": f"WITH {_LOOSE}, k AS (SELECT count(*) AS n_new, CAST(coalesce(sum(CAST(all_daylight AS INT)), 0) AS BIGINT) AS n_old FROM a WHERE status = 'ok') SELECT *, n_new - n_old AS added, round((n_new - n_old) * 100.0::DOUBLE / nullif(n_old, 0), 6) AS pct FROM k",
    "persistence_point_metrics": f"WITH {_L} SELECT coalesce(horizon, 'overall') AS horizon, {_M} FROM l JOIN hz ON step = steps GROUP BY ROLLUP (horizon)",
    "persistence_prefix_metrics": f"WITH {_L} SELECT split, horizon, {_M} FROM l JOIN hz ON step <= steps GROUP BY split, horizon",
    "state_vectors": f"WITH {_G} SELECT anchor_ts, " + ", ".join(f"round({c}, 10) AS {c}" for c in _NAMES) + " FROM g",
    "scaler_g_params": f"WITH {_G} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, stddev_pop({c}) > 1e-8 AS kept FROM g WHERE split = 'train'" for c in _NAMES),
    "scaler_x_params": f"WITH {_X} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) < 1e-8 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS std FROM x WHERE split = 'train'" for c in windows.FEATURES),
    "fcm_membership_fixed_centers": f"WITH {_U} SELECT anchor_ts, round(u0, 6) AS u0, round(u1, 6) AS u1, round(u2, 6) AS u2, label FROM lab",
    "fcm_center_update_one_step": f"WITH {_U} " + " UNION ALL ".join(f"SELECT {k} AS k, '{c}' AS dim, round(sum(u{k} * u{k} * {c}) / sum(u{k} * u{k}), 6) AS value FROM lab WHERE split = 'train'" for k in range(3) for c in ("tsi_mean", "power_mean")),
    "cluster_sizes_by_split": f"WITH {_U} SELECT split, label, count(*) AS n FROM lab GROUP BY ALL",
    "sharpen_membership": f"WITH {_U}, t AS (SELECT anchor_ts, power(sqrt(u0 + 1e-10), 1.5) AS a, power(sqrt(u1 + 1e-10), 1.5) AS b, power(sqrt(u2 + 1e-10), 1.5) AS c FROM lab) SELECT anchor_ts, round(a / (a + b + c), 6) AS s0, round(b / (a + b + c), 6) AS s1, round(c / (a + b + c), 6) AS s2 FROM t",
    "alpha_sweep": f"""WITH {_U}, al(alpha) AS (VALUES (0.5::DOUBLE), (1.0), (2.0), (3.0)),
        ex AS (SELECT anchor_ts, max(power) FILTER (step = 16) AS p0, avg(power) AS p1, max(power) FILTER (step = 1) AS p2 FROM x GROUP BY 1),
        mx AS (SELECT anchor_ts, alpha, (power(u0, alpha) * p0 + power(u1, alpha) * p1 + power(u2, alpha) * p2) / (power(u0, alpha) + power(u1, alpha) + power(u2, alpha)) AS f FROM lab JOIN ex USING (anchor_ts) CROSS JOIN al),
        er AS (SELECT alpha, step, f - y AS e FROM mx JOIN y USING (anchor_ts)) SELECT alpha, horizon, {_M} FROM er JOIN hz ON step <= steps GROUP BY alpha, horizon""",
}
_EX = "ex AS (SELECT anchor_ts, max(power) FILTER (step = 16) AS p0, avg(power) AS p1, max(power) FILTER (step = 1) AS p2 FROM x GROUP BY 1)"
_OWNU = "CASE label WHEN 0 THEN u0 WHEN 1 THEN u1 ELSE u2 END"
_F = {"hard": "CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END", "soft": "u0 * p0 + u1 * p1 + u2 * p2"}


def _rep(kind: str) -> str:
    """CTEs of a cluster report: rows of errors e_kind, and the report r_kind."""
    return f"""e_{kind} AS (SELECT label, {_OWNU} AS own, step, {_F[kind]} - y AS e FROM lab JOIN ex USING (anchor_ts) JOIN y USING (anchor_ts)),
        g_{kind} AS (SELECT CASE WHEN grouping(label) = 1 THEN 'overall' ELSE 'cluster' END AS scope, label, horizon, {_M}, round(avg(own), 6) AS mean_membership,
          count(*) FILTER (step = 1) AS samples FROM e_{kind} JOIN hz ON step <= steps GROUP BY GROUPING SETS ((label, horizon), (horizon))),
        r_{kind} AS (SELECT *, round(samples / max(samples) OVER (PARTITION BY horizon), 6) AS share FROM g_{kind})"""


_REP = f"WITH {_U}, {_EX}, {_rep('hard')}, {_rep('soft')}"
_TRAIN = ", ".join(f"avg({c}) FILTER (split = 'train') OVER () AS m_{c}, stddev_pop({c}) FILTER (split = 'train') OVER () AS s_{c}" for c in _NAMES)
_XT = ", ".join(f"avg({c}) FILTER (split = 'train') OVER () AS m_{c}, stddev_pop({c}) FILTER (split = 'train') OVER () AS s_{c}" for c in windows.FEATURES)
_NAMED = "(SELECT label, CASE row_number() OVER (ORDER BY p DESC, label) WHEN 1 THEN 'clear' WHEN 2 THEN 'cloudy' WHEN 3 THEN 'low_irradiance' ELSE 'unknown' END AS name, p, t, ts FROM (SELECT label, avg(power_mean) AS p, avg(tsi_mean) AS t, avg(tsi_std) AS ts FROM lab WHERE split = 'train' {0} GROUP BY label))"
_RAMP = "SELECT count(k) AS n, round(avg(k), 6) AS mean_ramp, round(quantile_cont(k, 0.95), 6) AS p95_ramp, round(max(k), 6) AS max_ramp FROM o"
_ODD = _G.replace("avg(value) AS temp", "CASE WHEN count(*) = 4 THEN 'nan'::DOUBLE ELSE avg(value) END AS temp").replace(", stddev_pop(temp) AS temp_std", "")
# Dropped night rows: the day list, the ranks and the gaps are of the rows that stay.
_DROP = _LOOSE.replace("coalesce(tsi >= 2, false) AS is_daylight FROM s)", "true AS is_daylight FROM s WHERE tsi >= 2)")
_LAST = _L.replace("x.power - y AS e FROM y JOIN x ON y.anchor_ts = x.anchor_ts AND x.step = 16", "p - y AS e FROM y JOIN (SELECT anchor_ts, avg(power) AS p FROM x GROUP BY 1) USING (anchor_ts)")
SQL |= {
    "finite_counts": f"WITH {_ODD} SELECT split, count(*) AS n, count(*) FILTER (isfinite(temp_mean)) AS n_kept FROM g GROUP BY split",
    "feature_ranges": f"WITH {_X} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(min({c}), 6) AS low, round(max({c}), 6) AS high, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM x WHERE split = 'train'" for c in windows.FEATURES),
    "state_vectors_scaled": f"WITH {_G}, t AS (SELECT *, {_TRAIN} FROM g) SELECT anchor_ts, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _NAMES) + " FROM t",
    "windows_scaled": f"WITH {_X}, t AS (SELECT *, {_XT} FROM x) SELECT anchor_ts, step, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in windows.FEATURES) + " FROM t",
    "best_alpha": f"SELECT nrmse, alpha FROM ({SQL['alpha_sweep']}) WHERE horizon = '4h' ORDER BY nrmse, alpha LIMIT 1",
    "cluster_report_hard": f"{_REP} SELECT * FROM r_hard",
    "cluster_report_soft": f"{_REP} SELECT * FROM r_soft",
    "cluster_report_pivot": f"{_REP} SELECT scope, label, samples, mean_membership, max(nrmse) FILTER (horizon = '1h') AS nrmse_1h, max(nrmse) FILTER (horizon = '2h') AS nrmse_2h, max(nrmse) FILTER (horizon = '4h') AS nrmse_4h FROM r_hard GROUP BY ALL",
    "soft_vs_hard_delta": f"{_REP} SELECT h.scope, h.label, h.horizon, h.nrmse AS hard, s.nrmse AS soft, round(h.nrmse - s.nrmse, 6) AS delta FROM r_hard h JOIN r_soft s ON h.scope = s.scope AND h.label IS NOT DISTINCT FROM s.label AND h.horizon = s.horizon",
    "expert_union_metrics": f"{_REP} SELECT horizon, mae, rmse, nrmse, n FROM r_hard WHERE scope = 'overall'",
    "semantic_labels": f"WITH {_U} SELECT label, name, round(p, 6) AS power_mean, round(t, 6) AS tsi_mean, round(ts, 6) AS tsi_std FROM {_NAMED.format('')}",
    "named_samples": f"WITH {_U} SELECT split, coalesce(name, 'unknown') AS name, count(*) AS n FROM lab LEFT JOIN {_NAMED.format('AND label > 0')} USING (label) GROUP BY 1, 2",
    "cluster_sizes_pivot": f"WITH {_U} SELECT split, " + ", ".join(f"count(*) FILTER (label = {k}) AS n{k}" for k in range(3)) + " FROM lab GROUP BY split",
    "fcm_objective": f"WITH {_U} SELECT round(sum(u0 * u0 * d0 + u1 * u1 * d1 + u2 * u2 * d2), 6) AS jm FROM lab WHERE split = 'train'",
    "center_distance_matrix": f"WITH c AS ({SQL['fcm_center_update_one_step']}) SELECT x.k AS k1, y.k AS k2, round(sqrt(sum(power(x.value - y.value, 2))), 6) AS distance FROM c x JOIN c y ON x.dim = y.dim GROUP BY 1, 2",
    "davies_bouldin": f"""WITH {_U}, mid AS (SELECT label, avg(tsi_mean) AS a, avg(power_mean) AS b FROM lab GROUP BY label),
        wide AS (SELECT label, a, b, avg(sqrt(power(tsi_mean - a, 2) + power(power_mean - b, 2))) AS s FROM lab JOIN mid USING (label) GROUP BY ALL)
        SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT x.label, max((x.s + y.s) / sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2))) AS r FROM wide x JOIN wide y ON x.label <> y.label GROUP BY 1)""",
    "silhouette": f"""WITH {_U}, p AS (SELECT q.anchor_ts AS q, q.label AS own, r.label, sum(sqrt(power(q.tsi_mean - r.tsi_mean, 2) + power(q.power_mean - r.power_mean, 2))) AS s, count(*) AS n FROM lab q, lab r GROUP BY ALL),
        ab AS (SELECT q, max(s / (n - 1)) FILTER (own = label AND n > 1) AS a, min(s / n) FILTER (own <> label) AS b FROM p GROUP BY q)
        SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM ab""",
    "intraday_gaps": f"WITH {_S}, o AS (SELECT day, ts - lag(ts) OVER (PARTITION BY day ORDER BY ts) AS d FROM f) SELECT day, count(*) AS n_rows, count(*) FILTER (d <> INTERVAL 15 MINUTE) AS gaps FROM o GROUP BY day",
    "daylight_days": f"WITH {_S} SELECT day, count(*) AS n_rows, count(*) FILTER (is_daylight) AS daylight_rows FROM f GROUP BY day",
    "ramp_stats": f"WITH {_S}, o AS (SELECT abs(power - lag(power) OVER (ORDER BY ts)) AS k FROM f) {_RAMP}",
    "ramp_stats_above": f"WITH {_S}, o AS (SELECT abs(power - lag(power) OVER (ORDER BY ts)) AS k FROM f WHERE power > 150) {_RAMP}",
    "sorted_flag": "SELECT coalesce(bool_and(ts >= b), true) AS is_sorted FROM (SELECT ts, lag(ts) OVER () AS b FROM events)",
    "numeric_ranges": " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, round(avg({c}), 6) AS mean FROM events" for c in ("event_id", "user_id", "value")),
    "drop_vs_mask_counts": f"SELECT 'drop' AS mode, split, count(*) AS n FROM (WITH {_DROP} SELECT split, status FROM a) WHERE status = 'ok' GROUP BY split UNION ALL SELECT 'mask', split, count(*) FROM (WITH {_LOOSE} SELECT split, status FROM a) WHERE status = 'ok' GROUP BY split",
    "windows_only_new": f"WITH {_LOOSE}, o AS (SELECT * FROM a WHERE status = 'ok') SELECT anchor_ts, split FROM o WHERE anchor_ts NOT IN (SELECT anchor_ts FROM o WHERE all_daylight)",
    "result_rows": f"""SELECT CASE WHEN horizon = 'overall' THEN 'Overall' ELSE horizon END AS "Horizon", CASE horizon WHEN '1h' THEN '4' WHEN '2h' THEN '8' WHEN '4h' THEN '16' ELSE '-' END AS "Steps",
        printf('%.4f', mae) AS "MAE", printf('%.4f', rmse) AS "RMSE", printf('%.4f', nrmse) AS "nRMSE", n AS "N_Samples" FROM ({SQL['persistence_point_metrics']})""",
    "first_rows": f"WITH {_S} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, tsi, round(power, 6) AS power FROM f ORDER BY ts LIMIT 10",
    "batched_forecast": f"WITH {_LAST} SELECT coalesce(horizon, 'overall') AS horizon, {_M} FROM l JOIN hz ON step = steps GROUP BY ROLLUP (horizon)",
}
_OWN = globals()
QUERIES = {name: partial(_OWN[name]) for name in SQL}
