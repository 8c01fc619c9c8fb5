"""Daylight flags, splits by day, day-bounded sliding windows and their statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

FEATURES = ("tsi", "dni", "ghi", "temp", "atm", "power")
#: Steps of input and of output.
LX, H = 16, 16
MINUTES = 15


def flag_daylight(df: DataFrame, threshold: float = 5.0, column: str = "tsi") -> DataFrame:
    """Adds is_daylight; a null or NaN irradiance is night."""
    return df.withColumn("is_daylight", F.coalesce((F.col(column) >= threshold) & ~F.isnan(column), F.lit(False)))


def split_by_day(df: DataFrame, train: float = 0.70, val: float = 0.15, test: float = 0.15, days: DataFrame | None = None) -> DataFrame:
    """Adds split by the rank of the row's day among the distinct days; shares are cut down to whole days.

    days: the frame's days, where they can be had more cheaply than from the frame. There is a row a day, so one task
    ranks them and they are broadcast.
    """
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError("the shares of the splits must sum to 1")
    days = (df if days is None else days).select("day").distinct()
    rank, n = F.row_number().over(W.orderBy("day")), F.count(F.lit(1)).over(W.partitionBy())
    ranked = days.select("day", rank.alias("rank"), n.alias("n"))
    split = F.when(F.col("rank") <= F.floor(F.col("n") * F.lit(train)), "train").when(F.col("rank") <= F.floor(F.col("n") * F.lit(train + val)), "val").otherwise("test")
    return df.join(F.broadcast(ranked.select("day", split.alias("split"))), "day")


def by_day(df: DataFrame):
    """The window of a series' day in its order: equal times by row_id, where the frame has series_id and row_id."""
    return W.partitionBy(*[c for c in ("series_id", "day") if c in df.columns]).orderBy("ts", *[c for c in ("row_id",) if c in df.columns])


def candidates(df: DataFrame, lx: int = LX, h: int = H, minutes: int = MINUTES, capacity: float | None = None) -> DataFrame:
    """Every anchor with lx rows before and h rows from it on within its series and day, with x, y, status, all_daylight.

    status is discontinuous if any of the lx + h - 1 neighbouring differences is not one step, else night if the anchor
    has no daylight, else ok. One shuffle by series and day and one sort serve every window function. With a capacity,
    the 28 statistics of the state vector come along.
    """
    w = by_day(df)
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    keys = [c for c in ("series_id", "day") if c in df.columns]
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(w) != F.expr(f"INTERVAL {minutes} MINUTES")).cast("int"), F.lit(0))
    df = df.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys))).withColumn("brk", gap)
    df = df.withColumn("cb", F.sum("brk").over(run))
    df = (
        df.withColumn("breaks", F.lead("cb", h - 1).over(w) - F.lag("cb", lx).over(w))
        .withColumn("x", F.collect_list(F.struct(*FEATURES)).over(w.rowsBetween(-lx, -1)))
        .withColumn("y", F.collect_list(F.struct("power")).over(w.rowsBetween(0, h - 1)))
        .withColumn("all_daylight", F.min("is_daylight").over(w.rowsBetween(-lx, h - 1)))
    )
    stats = {} if capacity is None else _statistics(w, lx, capacity)
    if stats:
        df = df.withColumns({f"d_{f}": F.col(f) - F.lag(f).over(w) for f in ("tsi", "dni", "ghi", "power")}).withColumns(stats)
    df = df.where((F.col("rn") > lx) & (F.col("rn") <= F.col("n") - h + 1))
    status = F.when(F.col("breaks") != 0, "discontinuous").when(~F.col("is_daylight"), "night").otherwise("ok")
    keep = [c for c in ("series_id", "split") if c in df.columns]
    return df.select(F.col("ts").alias("anchor_ts"), (F.col("rn") - 1).alias("anchor_idx"), "day", *keep, "is_daylight", "all_daylight", "x", F.col("y.power").alias("y"), status.alias("status"), *stats)


def uses(df: DataFrame, split: str = "train", lx: int = LX, h: int = H, minutes: int = MINUTES) -> DataFrame:
    """The rows that inputs of accepted windows of a split hold: series_id and row_id if there are any, ts, FEATURES, uses.

    uses is the number of windows of status ok that candidates() would give with the row among their inputs. No window is
    built: anchors are flagged, and counted over the lx rows after a row, with the same one shuffle and sort.
    """
    w = by_day(df)
    keys = [c for c in ("series_id", "day") if c in df.columns]
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(w) != F.expr(f"INTERVAL {minutes} MINUTES")).cast("int"), F.lit(0))
    rows = df.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys))).withColumn("brk", gap)
    rows = rows.withColumn("cb", F.sum("brk").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    whole = F.coalesce(F.lead("cb", h - 1).over(w) == F.lag("cb", lx).over(w), F.lit(False))
    ok = whole & F.col("is_daylight") & (F.col("split") == split) & (F.col("rn") > lx) & (F.col("rn") <= F.col("n") - h + 1)
    rows = rows.withColumn("ok", ok.cast("long")).withColumn("uses", F.coalesce(F.sum("ok").over(w.rowsBetween(1, lx)), F.lit(0)))
    keep = [c for c in ("series_id", "row_id") if c in df.columns]
    return rows.where("uses > 0").select(*keep, "ts", *FEATURES, "uses")


def _statistics(w, lx: int, capacity: float) -> dict[str, Column]:
    """The state vector's statistics of the lx rows before a row (population deviations), and of their differences."""
    rows, steps = w.rowsBetween(-lx, -1), w.rowsBetween(-(lx - 1), -1)
    out: dict[str, Column] = {}
    for f in ("tsi", "dni", "ghi"):
        out |= {f"{f}_mean": F.avg(f).over(rows), f"{f}_std": F.stddev_pop(f).over(rows), f"{f}_min": F.min(f).over(rows), f"{f}_max": F.max(f).over(rows)}
    for f in ("tsi", "dni", "ghi"):
        d = F.col(f"d_{f}")
        out |= {f"{f}_dmean": F.avg(F.abs(d)).over(steps), f"{f}_dstd": F.stddev_pop(d).over(steps), f"{f}_dmax": F.max(F.abs(d)).over(steps)}
    p = F.col("power") / capacity
    out |= {"power_mean": F.avg(p).over(rows), "power_std": F.stddev_pop(p).over(rows), "power_dmean": F.avg(F.abs(F.col("d_power") / capacity)).over(steps)}
    for f in ("temp", "atm"):
        out |= {f"{f}_mean": F.avg(f).over(rows), f"{f}_std": F.stddev_pop(f).over(rows)}
    return out


#: The statistics' names, in the order of the state vector.
STATE = tuple(f"{f}_{s}" for f in ("tsi", "dni", "ghi") for s in ("mean", "std", "min", "max")) + tuple(f"{f}_{s}" for f in ("tsi", "dni", "ghi") for s in ("dmean", "dstd", "dmax")) + ("power_mean", "power_std", "power_dmean", "temp_mean", "temp_std", "atm_mean", "atm_std")


def persistence(windows: DataFrame, h: int = H) -> DataFrame:
    """Adds yhat: the last power of the input, repeated."""
    return windows.withColumn("yhat", F.array_repeat(F.element_at("x", -1)["power"], h))


def steps(predicted: DataFrame) -> DataFrame:
    """Long rows: the frame's other columns, step from 1, y and yhat."""
    keep = [c for c in predicted.columns if c not in ("x", "y", "yhat")]
    return predicted.select(*keep, F.posexplode(F.arrays_zip("y", "yhat")).alias("p", "z")).select(*keep, (F.col("p") + 1).alias("step"), F.col("z.y").alias("y"), F.col("z.yhat").alias("yhat"))


def finite(df: DataFrame, columns: tuple[str, ...] = STATE) -> DataFrame:
    """The rows whose columns are all numbers: not null, not NaN, not infinite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    return df.where(ok)


def only_new(new: DataFrame, old: DataFrame) -> DataFrame:
    """The windows of new whose anchor is not one of old's, each series for itself; repeated ones stay."""
    keys = [c for c in ("series_id", "anchor_ts") if c in new.columns]
    return new.join(old.select(*keys), keys, "left_anti")


def resolve(columns: list[str], part: str, exact_case: bool = False) -> str | None:
    """The first column whose name holds `part`, in any case unless exact_case; None without one."""
    same = (lambda c: part in c) if exact_case else (lambda c: part.lower() in c.lower())
    return next((c for c in columns if same(c)), None)


def numeric(df: DataFrame, leave: tuple[str, ...] = ("is_daylight",)) -> list[str]:
    """The names of the numeric columns, in order."""
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in leave]


def forecast(windows: DataFrame, start: Callable[[], Callable[[np.ndarray], np.ndarray]], h: int = H) -> DataFrame:
    """Adds yhat from any model, in batches of windows.

    start() is called once in each task, for instance to load weights; it returns a function from an array (windows, lx,
    features) to an array (windows, h). Windows need not be in one place or order.
    """
    schema = T.StructType([*windows.schema.fields, T.StructField("yhat", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = start()
        for b in batches:
            x = b.column(b.schema.get_field_index("x"))
            flat = x.flatten()
            cube = np.stack([flat.field(f).to_numpy(zero_copy_only=False) for f in FEATURES], -1).reshape(len(b), -1, len(FEATURES)) if len(b) else np.zeros((0, LX, len(FEATURES)))
            out = np.asarray(model(cube), float).reshape(len(b), h)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * h), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "yhat"])

    return windows.mapInArrow(run, schema)
