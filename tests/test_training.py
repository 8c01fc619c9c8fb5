"""LSTM fits: gradients, partitions, early stops, experts, warm starts, and the table of weights."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.operators import training
from sunloom.operators.neural import Shape, draws, gradient, predict
from sunloom.operators.training import Adam, EarlyStop, Options, early_stops, examples, fit, forecast
from sunloom.operators.windows import FEATURES
from sunloom.sources.weights import experts, load_weights, save_weights, suffix_of, versions

SMALL = Shape(6, 4, 2, 3, 0.2)


def rows(spark, n=120, labels=2, val=True, parts=4):
    """The first step is the mean power, with a sign by label; the others are noise."""
    rng, out = np.random.default_rng(3), []
    for i in range(n):
        x = rng.normal(size=(5, 6))
        k = i % labels
        split = "val" if val and i % 5 == 0 else "train"
        out.append((int(i), split, k, x.reshape(-1).tolist(), [float(x[:, 5].mean() * (1 - 2 * k)), 0.1, float(rng.normal() * 0.01)]))
    return spark.createDataFrame(out, training.ROWS).repartition(parts).persist()


@pytest.mark.parametrize("layers", [1, 2])
def test_gradient_equals_finite_differences(layers):
    shape, rng = Shape(3, 5, layers, 4, 0.3), np.random.default_rng(0)
    w, x, y = shape.initial(1), rng.normal(size=(6, 7, 3)), rng.normal(size=(6, 4))
    masks = shape.masks(np.arange(6), 7, 1, 2)
    flat, got = shape.flat(w), shape.flat(gradient(shape, w, x, y, masks)[1])
    for i in range(len(flat)):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        want = (gradient(shape, shape.named(flat + e), x, y, masks)[0] - gradient(shape, shape.named(flat - e), x, y, masks)[0]) / 2e-6
        assert abs(want - got[i]) <= 1e-6 * max(1, abs(want))
    assert all(np.allclose(predict(shape, w, x)[i : i + 1], predict(shape, w, x[i : i + 1]), atol=1e-14) for i in range(6))
    assert gradient(shape, w, x, y)[0] == pytest.approx(((predict(shape, w, x) - y) ** 2).sum())


def test_draws_depend_on_keys_alone(spark):
    want = {k: draws([k], 3, 42, "use")[0].tolist() for k in range(-20, 20)}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(draws(b.column(0).to_numpy(), 3, 42, "use").tolist(), pa.list_(pa.float64()))], names=["k", "d"])

    for parts in (1, 7):
        assert {r["k"]: r["d"] for r in spark.range(-20, 20).repartition(parts).mapInArrow(run, "k long, d array<double>").collect()} == want
    many = draws(np.arange(2000), 50, 1)
    assert abs(many.mean() - 0.5) < 0.005 and 0 <= many.min() and many.max() < 1 and len(np.unique(many)) == many.size
    assert not np.allclose(draws([1], 5, 1), draws([1], 5, 2)) and not np.allclose(draws([1], 5, "a"), draws([1], 5, "b"))


def test_partitions_do_not_matter(spark, monkeypatch):
    options = Options(lr=0.02, batch=24, epochs=2)
    one, four, many = (fit(rows(spark, parts=p), SMALL, options) for p in (1, 4, 16))
    monkeypatch.setattr(training, "WIDE", 2)  # sums are added in two levels
    levels = fit(rows(spark, parts=16), SMALL, options)
    for other in (four, many, levels):
        for k in (0, 1):
            assert np.allclose(SMALL.flat(one.weights[k]), SMALL.flat(other.weights[k]), rtol=0, atol=1e-10)


def test_a_step_equals_one_by_hand(spark):
    df, shape = rows(spark, 40, labels=1), Shape(6, 4, 1, 3, 0.0)
    got = fit(df, shape, Options(lr=0.01, batch=1000, epochs=1))
    own = df.where("split = 'train'").collect()
    x, y = np.array([r["x"] for r in own]).reshape(len(own), 5, 6), np.array([r["y"] for r in own])
    w = shape.initial(42)
    loss, grad = gradient(shape, w, x, y)
    assert np.allclose(shape.flat(got.weights[0]), Adam(0.01).step(shape.flat(w), shape.flat(grad) / y.size), atol=1e-12)
    assert got.epochs[0]["loss_rows"] == pytest.approx(loss / y.size) == pytest.approx(got.epochs[0]["loss_batches"])


def test_experts_together_equal_each_alone(spark):
    df, options = rows(spark), Options(lr=0.02, batch=20, epochs=3, monitor="loss", patience=1)
    both = fit(df, SMALL, options)
    assert sorted(both.weights) == [0, 1] and both.skipped == []
    for k in (0, 1):
        alone = fit(df.where(F.col("label") == k), SMALL, options)
        assert np.allclose(SMALL.flat(both.weights[k]), SMALL.flat(alone.weights[k]), atol=1e-10)
        assert [r["epoch"] for r in both.epochs if r["label"] == k] == [r["epoch"] for r in alone.epochs]


def test_empty_sets(spark):
    df = rows(spark)
    odd = df.where("NOT (label = 1 AND split = 'val')").unionByName(df.where("split = 'val' AND label = 0").withColumn("label", F.lit(7)))
    got = fit(odd, SMALL, Options(epochs=1))
    assert got.skipped == [7] and sorted(got.weights) == [0, 1] and {r["label"] for r in got.epochs} == {0, 1}
    few = df.where("split = 'train' AND label = 1").orderBy("key").limit(training.FEW).collect()
    x, y = np.array([r["x"] for r in few]).reshape(len(few), 5, 6), np.array([r["y"] for r in few])
    assert next(r for r in got.epochs if r["label"] == 1)["val_loss"] == pytest.approx(((predict(SMALL, got.weights[1], x) - y) ** 2).mean())
    none = fit(df.limit(0), SMALL)
    assert none.weights == {} and none.epochs == []


def test_fit_learns_and_restores_the_best(spark):
    df = rows(spark, 200, labels=1)
    got = fit(df, Shape(6, 8, 1, 3, 0.0), Options(lr=0.03, batch=40, epochs=12, patience=2))
    best = min(got.epochs, key=lambda r: r["val_rmse"])
    assert best["val_rmse"] < 0.75 * got.epochs[0]["val_rmse"] and [r["epoch"] for r in got.epochs if r["best"]][-1] == best["epoch"]
    val = df.where("split = 'val'").collect()
    x, y = np.array([r["x"] for r in val]).reshape(len(val), 5, 6), np.array([r["y"] for r in val])
    assert math.sqrt(((predict(got.shape, got.weights[0], x) - y) ** 2).mean()) == pytest.approx(best["val_rmse"])
    assert got.table(spark).count() == len(got.epochs)


def test_early_stop(spark):
    curve = [5.0, 4.0, 4.0, float("nan"), 3.0] + [3.0] * 4 + [2.9] + [3.5] * 12 + [0.1]
    stop, told = EarlyStop(10), []
    for epoch, value in enumerate(curve, 1):
        stop.feed(epoch, value)
        told.append((epoch, stop.best_epoch, stop.since))
        if stop.stopped:
            break
    assert (stop.best_epoch, stop.best, epoch) == (10, 2.9, 20)
    df = spark.createDataFrame([(k, i, v) for k in "ab" for i, v in enumerate(curve, 1)], "model string, epoch int, metric double")
    got = early_stops(df, 10, keys=["model"]).where("model = 'b'").orderBy("epoch").collect()
    assert [(r["epoch"], r["best_epoch"], r["since"]) for r in got] == told


def windows(spark):
    rng = np.random.default_rng(1)
    data = [(i, "train" if i % 3 else "val", [tuple(map(float, rng.normal(size=6))) for _ in range(5)], [1.0, 2.0, 3.0], i % 3, [0.2, 0.8]) for i in range(30)]
    x = "array<struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">>"
    return spark.createDataFrame(data, f"anchor_ts int, split string, x {x}, y array<double>, label int, u array<double>")


def test_forecast_by_label_and_mixed(spark):
    df, shape = windows(spark), Shape(6, 4, 1, 3, 0.0)
    two = training.Fit(shape, {0: shape.initial(1), 1: shape.initial(2)})
    cube = {r["anchor_ts"]: np.array([[tuple(s) for s in r["x"]]]) for r in df.collect()}
    for r in forecast(df, two, 50.0, label="label").collect():
        assert r["yhat"] is None if r["label"] == 2 else np.allclose(r["yhat"], 50 * predict(shape, two.weights[r["label"]], cube[r["anchor_ts"]])[0])
    for r in forecast(df, two, 50.0, soft="u").collect():
        want = sum(u * predict(shape, two.weights[k], cube[r["anchor_ts"]])[0] for k, u in enumerate(r["u"]))
        assert np.allclose(r["yhat"], 50 * want)
    assert forecast(df.limit(0), two, 50.0).count() == 0


def test_warm_start(spark):
    df, shape = windows(spark), Shape(6, 4, 2, 3, 0.1)
    base, own = shape.initial(5), examples(df, 50.0, F.col("label")).persist()
    start = {k: base for k in range(3)}
    none = fit(own, shape, Options(epochs=0), start)
    want = {r["anchor_ts"]: r["yhat"] for r in forecast(df, training.Fit(shape, {0: base}), 50.0).collect()}
    assert {r["anchor_ts"]: r["yhat"] for r in forecast(df, none, 50.0, label="label").collect()} == {k: v for k, v in want.items() if k % 3 in none.weights}  | {k: None for k in want if k % 3 not in none.weights}
    warm = fit(own, shape, Options(lr=1e-3 * 0.1, epochs=1), start, frozen=("lstm.weight_ih_l0", "lstm.bias"))
    for name, value in warm.weights[1].items():
        same = name.startswith(("lstm.weight_ih_l0", "lstm.bias"))
        assert (value == base[name]).all() if same else 0 < abs(value - base[name]).max() < 1.1e-4


def test_weights_table(spark, tmp_path):
    path, shape = str(tmp_path / "weights"), Shape(6, 4, 2, 3)
    models = {f"expert_{k}": shape.initial(k) for k in range(2)}
    assert versions(spark, path) == [] and save_weights(spark, path, models) == 1
    assert save_weights(spark, path, {"expert_0_warm": shape.initial(9)}) == 2 and versions(spark, path) == [1, 2]
    back = load_weights(spark, path, shape, 1)
    assert all((back[m][n] == w[n]).all() for m, w in models.items() for n in w) and sorted(load_weights(spark, path, shape)) == ["expert_0_warm"]
    assert sorted(experts(back, [0, 1])) == [0, 1] and sorted(experts(back, [0, 1, 2], absent="train")) == [0, 1]
    with pytest.raises(FileNotFoundError, match="expert_2"):
        experts(back, [0, 1, 2])
    with pytest.raises(FileNotFoundError, match="version 5"):
        load_weights(spark, path, shape, 5)
    with pytest.raises(ValueError, match="shape"):
        load_weights(spark, path, Shape(6, 5, 2, 3), 1)
    assert [suffix_of(*x) for x in ((False, ""), (True, ""), (False, "_warm"), (True, "_own"))] == ["", "_warm", "_warm", "_own"]


def test_queries(spark):
    from sunloom.plans import QUERIES

    sf = "/root/testdata/sf0.01"
    plain = {(r["split"], r["horizon"]): r["rmse"] for r in QUERIES["persistence_prefix_metrics"](spark, sf).collect()}
    lstm = {(r["split"], r["horizon"]): r["rmse"] for r in QUERIES["lstm_forecast"](spark, sf).collect()}
    assert set(lstm) == {(s, h) for s in ("val", "test") for h in ("1h", "2h", "4h")} and all(v < plain[k] for k, v in lstm.items())
    both = QUERIES["expert_forecast"](spark, sf).collect()
    assert {(r["routing"], r["horizon"]) for r in both} == {(m, h) for m in ("hard", "soft") for h in ("1h", "2h", "4h")}
    assert all(r["rmse"] < plain["test", r["horizon"]] for r in both)


def test_a_step_runs_on_its_own_mini_batch_alone(spark):
    df, options, sc = rows(spark, parts=16), Options(lr=0.02, batch=8, epochs=1), spark.sparkContext
    df.count()
    sc.setJobGroup("steps", "a fit")
    try:
        fit(df, SMALL, options)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("steps")]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    ran = [sum(i.numCompletedTasks for s in j.stageIds if (i := sc.statusTracker().getStageInfo(s))) for j in jobs]
    steps = max(-(-r["count"] // options.batch) for r in df.where("split = 'train'").groupBy("label").count().collect())
    assert ran.count(1) >= steps - 1 > 3, ran  # the first step deals the rows out; a step once ran a task for each of the 16 partitions
