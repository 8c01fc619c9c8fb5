"""Fits of LSTM forecasters on windows, data-parallel: one model, or an expert for each label, all in the same jobs.

Each epoch deals its rows out by mini-batch in one shuffle, so a step runs on the partitions of its mini-batch alone.
Executors compute gradient sums there, a row for each partition and label, and only these sums of the size of the weights
reach the driver, which holds weights and optimizer; sums over validation rows are added up in two levels. Mini-batches and
dropout depend on the rows' keys, not on where rows are, so any partitioning gives the same weights but for rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .neural import Shape, Weights, gradient, predict
from .windows import FEATURES, H

#: Windows that a task holds at once, validation rows of a label without any, and partitions whose sums are added on the driver.
SLICE, FEW, WIDE = 1_024, 100, 32
ROWS = "key long, split string, label int, x array<double>, y array<double>"


@dataclass(frozen=True)
class Options:
    """monitor: rmse (of the first `horizon` steps) or loss (the mean over validation rows); both must fall to be better."""

    lr: float = 1e-3
    batch: int = 256
    epochs: int = 100
    patience: int = 10
    seed: int = 42
    monitor: str = "rmse"
    horizon: int = 16


@dataclass
class EarlyStop:
    """Remembers the best epoch; a tie is no improvement, so the first of equal ones stays. NaN never improves."""

    patience: int
    best: float = math.inf
    best_epoch: int = 0
    since: int = 0

    def feed(self, epoch: int, value: float) -> bool:
        """Whether this epoch is the best so far."""
        if value < self.best:
            self.best, self.best_epoch, self.since = value, epoch, 0
            return True
        self.since += 1
        return False

    @property
    def stopped(self) -> bool:
        return self.since >= self.patience


@dataclass
class Adam:
    lr: float
    t: int = 0
    m: np.ndarray | float = 0.0
    v: np.ndarray | float = 0.0

    def step(self, flat: np.ndarray, grad: np.ndarray) -> np.ndarray:
        # The usual decay rates and floor.
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * grad, 0.999 * self.v + 0.001 * grad * grad
        return flat - self.lr * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


@dataclass
class Fit:
    """The best weights by label, and a row for each label and epoch; skipped are labels without training rows."""

    shape: Shape
    weights: dict[int, Weights]
    epochs: list[dict] = field(default_factory=list)
    skipped: list[int] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.epochs], "label int, epoch int, loss_batches double, loss_rows double, val_loss double, val_rmse double, best boolean, stopped boolean")


def examples(windows: DataFrame, capacity: float, label: Column | None = None) -> DataFrame:
    """(key, split, label, x, y) of windows with x, y and split: x flat, y in shares of the capacity.

    The key is a hash of anchor_ts, and of series_id if there is one; label is 0 for a single model.
    """
    keys = [c for c in ("series_id", "anchor_ts") if c in windows.columns]
    flat = F.flatten(F.transform("x", lambda s: F.array(*[s[f].cast("double") for f in FEATURES])))
    return windows.select(F.xxhash64(*keys).alias("key"), "split", (F.lit(0) if label is None else label).cast("int").alias("label"), flat.alias("x"), F.transform("y", lambda v: v / F.lit(float(capacity))).alias("y"))


def batch_of(key: str, batches: Column, *use: int) -> Column:
    """The mini-batch of a row, by a hash of its key."""
    return F.pmod(F.xxhash64(key, *map(F.lit, use)), batches)


def _by_label(values: dict[int, int]) -> Column:
    return F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in values.items()], F.lit(0))


def _cube(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1, width)


def _parts(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(label, keys, x, y) for at most SLICE rows of a label at a time, from columns label, key, x, y."""
    for b in batches:
        labels = b.column(0).to_numpy()
        for k in np.unique(labels):
            own = b.filter(pa.array(labels == k))
            for lo in range(0, len(own), SLICE):
                s = own.slice(lo, SLICE)
                yield int(k), s.column(1).to_numpy(), _cube(s.column(2), shape.inputs), _cube(s.column(3), 1)[:, :, 0]


_SUMS = "label int, n long, sums array<double>"


def _rows(sums: dict[int, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.list_(pa.float64()))], names=["label", "n", "sums"])


def _add(sums: dict[int, list], k: int, n: int, values: np.ndarray) -> None:
    if k in sums:
        sums[k][0] += n
        sums[k][1] = sums[k][1] + values
    else:
        sums[k] = [n, values]


def _total(partial: DataFrame, parts: int) -> dict[int, tuple[int, np.ndarray]]:
    """Sums by label of the rows that `parts` partitions give, over a second level if there are many."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for i in range(len(b)):
                _add(sums, b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2).slice(i, 1).flatten().to_numpy())
        if sums:
            yield _rows(sums)

    if parts > WIDE:
        partial = partial.repartition(math.ceil(math.sqrt(parts))).mapInArrow(fold, _SUMS)
    out: dict[int, list] = {}
    for r in partial.collect():  # a row for each label and at most WIDE, or the root of the number of partitions
        _add(out, r["label"], r["n"], np.array(r["sums"]))
    return {k: (n, v) for k, (n, v) in out.items()}


def _dealt(rows: DataFrame, shape: Shape, steps: int, options: Options) -> tuple[DataFrame, int]:
    """The rows (label, key, x, y, batch) with each mini-batch in partitions of its own, and how many these are.

    A row holds up to SLICE windows of a label as bytes. So a step reads its own windows, not those of the whole epoch.
    """
    width = min(WIDE, -(-options.batch // SLICE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, keys, x, y in _parts(batches, shape):
            values = [pa.array([v.tobytes()], pa.binary()) for v in (keys, x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *values], names=["label", "keys", "x", "y"])

    at = (F.col("batch") * width + F.pmod(F.xxhash64("key", F.lit("part")), F.lit(width))).cast("int")
    return rows.repartitionById(steps * width, at).select("label", "key", "x", "y").mapInArrow(run, "label int, keys binary, x binary, y binary").persist(), width


def _step(dealt: RDD, parts: Sequence[int], shape: Shape, weights: dict[int, np.ndarray], options: Options, epoch: int) -> dict[int, tuple[int, np.ndarray]]:
    """By label: rows, and the gradient of their squared errors, with dropout, and these, over some partitions of _dealt()."""

    def run(rows: Iterator[Row]) -> Iterator[tuple[int, int, np.ndarray]]:
        sums: dict[int, list] = {}
        for r in rows:
            if r["label"] not in weights:
                continue
            keys, x, y = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["x"]), np.frombuffer(r["y"])
            x, y = x.reshape(len(keys), -1, shape.inputs), y.reshape(len(keys), -1)
            loss, grad = gradient(shape, shape.named(weights[r["label"]]), x, y, shape.masks(keys, x.shape[1], options.seed, epoch))
            _add(sums, r["label"], len(x), np.append(shape.flat(grad), loss))
        return iter([(k, n, v) for k, (n, v) in sums.items()])

    out: dict[int, list] = {}
    for k, n, v in dealt.context.runJob(dealt, run, parts):  # a row for each label and of at most WIDE partitions
        _add(out, k, n, v)
    return {k: (n, v) for k, (n, v) in out.items()}


def _sums(rows: DataFrame, shape: Shape, weights: dict[int, np.ndarray], options: Options, parts: int) -> dict[int, tuple[int, np.ndarray]]:
    """By label: rows, and their squared errors over all steps and over the first `horizon`."""
    known = rows.sparkSession.sparkContext.broadcast(weights)  # as large as the weights of all labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for k, _, x, y in _parts(batches, shape):
            error = (predict(shape, shape.named(known.value[k]), x) - y) ** 2
            _add(sums, k, len(x), np.array([error.sum(), error[:, : options.horizon].sum()]))
        if sums:
            yield _rows(sums)

    try:
        return _total(rows.select("label", "key", "x", "y").mapInArrow(run, _SUMS), parts)
    finally:
        known.destroy()


def fit(rows: DataFrame, shape: Shape, options: Options = Options(), start: dict[int, Weights] | None = None, frozen: Sequence[str] = ()) -> Fit:
    """Trains a model for each label of rows (key, split, label, x, y), all labels in the same jobs.

    Each epoch goes through the rows of split train in mini-batches, one small job a step, then measures split val. A label
    stops on its own and gets back the weights of its best epoch. Labels without training rows are skipped; those without
    validation rows are measured on FEW of their training rows, the ones of smallest keys. start: weights to begin from,
    by label, or drawn anew by seed and label; with lr scaled down this is a warm start. Parameters whose names begin
    with one of `frozen` stay as they are. No epochs give back the start. rows should be persisted.
    """
    counts = {(r["split"], r["label"]): r["n"] for r in rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a split and label
    labels = sorted({k for _, k in counts})
    parts = rows.rdd.getNumPartitions()
    out = Fit(shape, {}, skipped=[k for k in labels if not counts.get(("train", k))])
    labels = [k for k in labels if k not in out.skipped]
    flat = {k: shape.flat((start or {}).get(k) or shape.initial(options.seed + k)) for k in labels}
    out.weights = {k: shape.named(v.copy()) for k, v in flat.items()}
    free = shape.flat({n: np.full(s, not n.startswith(tuple(frozen)) if frozen else True, float) for n, s in shape.parameters().items()})
    batches = {k: -(-counts["train", k] // options.batch) for k in labels}
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    for k in labels:
        if not counts.get(("val", k)):
            val = val.unionByName(train.where(F.col("label") == k).orderBy("key").limit(FEW))
    adam, stop = {k: Adam(options.lr) for k in labels}, {k: EarlyStop(options.patience) for k in labels}
    for epoch in range(1, options.epochs + 1):
        running = [k for k in labels if not stop[k].stopped]
        if not running:
            break
        losses: dict[int, list[tuple[int, float]]] = {k: [] for k in running}
        own = train.where(F.col("label").isin(running)).withColumn("batch", batch_of("key", _by_label(batches), options.seed, epoch))
        steps = max(batches[k] for k in running)
        dealt, width = _dealt(own, shape, steps, options)
        each = dealt.rdd
        for step in range(steps):
            now = _step(each, range(step * width, (step + 1) * width), shape, {k: flat[k] for k in running}, options, epoch)
            for k, (n, sums) in now.items():
                losses[k].append((n, sums[-1] / (n * shape.steps)))
                flat[k] = adam[k].step(flat[k], free * sums[:-1] / (n * shape.steps)) if frozen else adam[k].step(flat[k], sums[:-1] / (n * shape.steps))
        dealt.unpersist()
        told = _sums(val.where(F.col("label").isin(running)), shape, {k: flat[k] for k in running}, options, parts)
        for k in running:
            n, (every, first) = told[k]
            loss, rmse = every / (n * shape.steps), math.sqrt(first / (n * min(options.horizon, shape.steps)))
            best = stop[k].feed(epoch, rmse if options.monitor == "rmse" else loss)
            if best:
                out.weights[k] = shape.named(flat[k].copy())
            batch_mean, row_mean = (sum(l for _, l in losses[k]) / len(losses[k]), sum(n * l for n, l in losses[k]) / sum(n for n, _ in losses[k]))
            told_of = {"loss_batches": batch_mean, "loss_rows": row_mean, "val_loss": loss, "val_rmse": rmse}
            out.epochs.append({"label": k, "epoch": epoch, **{n: float(v) for n, v in told_of.items()}, "best": bool(best), "stopped": stop[k].stopped})
    return out


def forecast(windows: DataFrame, fitted: Fit, capacity: float, label: str | None = None, soft: str | None = None) -> DataFrame:
    """Adds yhat: of the model of the row's label (column `label`, without one 0), or the mean of all by weights `soft`.

    soft names a column of memberships, an array in the order of labels. Weights are as large as the models, whatever the
    rows are. A label without a model has null forecasts.
    """
    shape, h = fitted.shape, fitted.shape.steps
    known = windows.sparkSession.sparkContext.broadcast({k: shape.flat(w) for k, w in fitted.weights.items()})
    names = windows.columns
    schema = T.StructType([*windows.schema.fields, T.StructField("yhat", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {k: shape.named(v) for k, v in known.value.items()}
        for b in batches:
            flat = b.column(names.index("x")).flatten()
            x = np.stack([flat.field(f).to_numpy(zero_copy_only=False).astype(float) for f in FEATURES], -1).reshape(len(b), -1, len(FEATURES)) if len(b) else np.zeros((0, 1, len(FEATURES)))
            out, there = np.zeros((len(b), h)), np.ones(len(b), bool)
            if soft:
                u = _cube(b.column(names.index(soft)), 1)[:, :, 0]
                for k, w in models.items():
                    out += u[:, k : k + 1] * predict(shape, w, x) if len(b) else 0
            else:
                own = b.column(names.index(label)).to_numpy(zero_copy_only=False) if label else np.zeros(len(b), int)
                there = np.isin(own, list(models))
                for k, w in models.items():
                    if (own == k).any():
                        out[own == k] = predict(shape, w, x[own == k])
            lists = pa.array([row if ok else None for row, ok in zip(out * capacity, there, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*names, "yhat"])

    return windows.mapInArrow(run, schema)


def loss_aggregates(errors: DataFrame, batch: Column, error: str = "e") -> DataFrame:
    """(loss_batches, loss_rows, n, n_batches): the mean over batches of their mean squared errors, and that over rows."""
    each = errors.groupBy(batch.alias("batch")).agg(F.avg(F.col(error) * F.col(error)).alias("m"), F.count(F.lit(1)).alias("n"))
    return each.agg(F.avg("m").alias("loss_batches"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("loss_rows"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_batches"))


def early_stops(epochs: DataFrame, patience: int, metric: str = "metric", keys: Sequence[str] = ()) -> DataFrame:
    """The rows (keys, epoch, metric) up to where each fit stops, with best_epoch, best and since as EarlyStop has them.

    epoch counts from 1 without gaps. One window by keys; a fit without keys is ordered in one task, a row an epoch.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy("epoch")
    upto, before = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, -1)
    value = F.when(~F.isnan(metric), F.col(metric))
    better = value.isNotNull() & (F.coalesce(F.min(value).over(before), F.lit(math.inf)) > value)
    rows = epochs.withColumn("better", better).withColumn("best_epoch", F.coalesce(F.max(F.when(F.col("better"), F.col("epoch"))).over(upto), F.lit(0)))
    rows = rows.withColumn("best", F.min(value).over(upto)).withColumn("since", F.col("epoch") - F.col("best_epoch"))
    stopped = F.coalesce(F.max((F.col("since") >= patience).cast("int")).over(before), F.lit(0))
    return rows.withColumn("over", stopped).where("over = 0").drop("over", "better")
