"""Windows, fits, sources and sinks against plain restatements, on small series with gaps, copies and missing values."""

import datetime
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.operators import metrics, quality, routing, scaling, windows
from sunloom.sinks import results
from sunloom.sources import artifacts, series

FIRST = datetime.datetime(2024, 3, 1)
STEP = datetime.timedelta(minutes=15)
COLUMNS = "series_id string, row_id long, ts timestamp_ntz, tsi double, dni double, ghi double, temp double, atm double, power double, day date"


def two_sites(seed=3, days=4):
    """Rows of two series: missing and repeated times, a NaN and a null irradiance."""
    rng, rows = random.Random(seed), []
    for site in "ab":
        for i in range(96 * days):
            ts = FIRST + i * STEP
            for _ in range(0 if rng.random() < 0.03 else 2 if rng.random() < 0.02 else 1):
                tsi = rng.choice([float("nan"), None]) if rng.random() < 0.02 else rng.uniform(0, 40)
                rows.append((site, len(rows), ts, tsi, *[rng.uniform(0, 10) for _ in range(4)], rng.uniform(0, 50), ts.date()))
    rng.shuffle(rows)
    return rows


def brute_windows(rows, lx, h, threshold=5.0):
    out = {}
    for site, day in {(r[0], r[-1]) for r in rows}:
        own = sorted((r for r in rows if (r[0], r[-1]) == (site, day)), key=lambda r: (r[2], r[1]))
        for i in range(lx, len(own) - h + 1):
            part = own[i - lx : i + h]
            light = [r[3] is not None and not math.isnan(r[3]) and r[3] >= threshold for r in part]
            status = "discontinuous" if any(b[2] - a[2] != STEP for a, b in zip(part, part[1:], strict=False)) else "ok" if light[lx] else "night"
            out[site, part[lx][1]] = (i, status, all(light), [r[8] for r in part[:lx]], [r[8] for r in part[lx:]])
    return out


def test_windows_of_two_series(spark):
    rows, lx, h = two_sites(), 5, 4
    df = windows.flag_daylight(spark.createDataFrame(rows, COLUMNS))
    got = windows.candidates(df, lx, h).collect()
    want = brute_windows(rows, lx, h)
    assert len(got) == len(want) and {r["status"] for r in got} == {"ok", "night", "discontinuous"}
    key = lambda v: str(v)
    ours = sorted(key((r["series_id"], r["anchor_idx"], r["status"], r["all_daylight"], [x["power"] for x in r["x"]], r["y"])) for r in got)
    assert ours == sorted(key((site, *v)) for (site, _), v in want.items())


def test_split_and_short_days(spark):
    rows = [("a", i, FIRST + datetime.timedelta(days=d) + j * STEP, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, (FIRST + datetime.timedelta(days=d)).date()) for d in range(90) for i, j in enumerate(range(2 if d else 32))]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r["split"]: r["n"] for r in windows.split_by_day(df).groupBy("split").agg(F.countDistinct("day").alias("n")).collect()}
    assert got == {"train": 62, "val": 14, "test": 14}
    assert [r["anchor_idx"] for r in windows.candidates(windows.flag_daylight(df, 0.5)).collect()] == [16]
    with pytest.raises(ValueError, match="sum to 1"):
        windows.split_by_day(df, 0.5, 0.1, 0.1)


def test_quality(spark):
    rows = two_sites()
    df = spark.createDataFrame(rows, COLUMNS)
    for r in quality.report(df).collect():
        own = sorted(x[2] for x in rows if x[0] == r["series_id"])
        assert (r["total_rows"], r["duplicate_count"]) == (len(own), len(own) - len(set(own)))
        assert r["gap_count"] == sum(b - a != STEP for a, b in zip(own, own[1:], strict=False))
    one = df.where("series_id = 'a'").drop("series_id")
    power = [x[8] for x in sorted((x for x in rows if x[0] == "a"), key=lambda x: (x[2], x[1]))]
    for above, p in ((None, power), (25.0, [x for x in power if x > 25])):
        steps, r = np.abs(np.diff(p)), quality.ramps(one, above=above).first()
        assert r["n"] == len(steps) and np.allclose([r["mean_ramp"], r["p95_ramp"], r["max_ramp"]], [steps.mean(), np.percentile(steps, 95), steps.max()], atol=1e-6)
    values = [1.0, 1.0, 2.0, 7.0, 7.0, 7.0, 9.0, None]
    got = {r["share"]: r["value"] for r in quality.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", (0.0, 0.05, 0.5, 0.9, 1.0)).collect()}
    assert all(abs(v - np.quantile(values[:-1], s)) < 1e-12 for s, v in got.items()) and len(got) == 5
    assert quality.quantiles(df.limit(0), "power", (0.5,)).count() == 0


def test_router_is_the_plain_one(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.5, (60, 4)) for c in (0.0, 3.0, 6.0)])
    x[:, 3] = 2.0  # varies nowhere
    g = spark.createDataFrame([(i, "train", *map(float, r), float(r[0])) for i, r in enumerate(x)], "id long, split string, a double, b double, c double, d double, power_mean double")
    router, report = scaling.fit_router(g, "id", ["a", "b", "c", "d"], dims=2, starts=(42, 43), most=60)
    assert list(router.scaler.mean) == ["a", "b", "c"] and len(router.components.axes) == 2
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    values, axes = np.linalg.eigh(np.cov(z.T))
    assert np.allclose(router.components.explained, (values[::-1] / values.sum())[:2], atol=1e-9)
    for i in range(2):
        assert np.isclose(abs(np.dot(router.components.axes[i], axes[:, 2 - i])), 1)
    p = z @ np.array(router.components.axes).T
    c = np.array(report["centres"])
    for _ in range(3):  # a fixed point of the plain update
        d = np.maximum(((p[:, None] - c) ** 2).sum(2), 1e-10)
        u = 1 / ((d[:, :, None] / d[:, None, :]) ** 2).sum(2)
        c = (u**2).T @ p / (u**2).sum(0)[:, None]
    assert np.allclose(c, report["centres"], atol=1e-3) and np.isclose(report["jm"], (u**2 * d).sum(), rtol=1e-3)
    rows = router.route(g, "id", "power_mean").orderBy("id").collect()
    assert [r["label"] for r in rows] == list(u.argmax(1)) and np.allclose([r["u"] for r in rows], u, atol=1e-3)
    means = {r["name"]: r["power_mean"] for r in rows}
    assert set(means) == {"clear", "cloudy", "low_irradiance"} and means["clear"] > means["cloudy"] > means["low_irradiance"]
    assert scaling.principal(scaling.fit_state(g, "abc").rows(g), "abc", None, 0.99).cumulative()[-1] >= 0.99
    with pytest.raises(ValueError, match="no points"):
        routing.fit(g.limit(0), "id", ["a"])


def test_router_is_saved_and_read(spark, tmp_path):
    router = scaling.Router(scaling.Scaler({"a": 1.0}, {"a": 2.0}), scaling.Components(["a"], [[1.0]], [1.0]), [[0.0], [5.0]], 2.0, {0: "clear"})
    router.save(spark, str(tmp_path / "router"))
    again = scaling.Router.load(spark, str(tmp_path / "router"))
    assert again == router
    got = again.route(spark.createDataFrame([(1, 1.0), (2, 11.0)], "id int, a double"), "id").orderBy("id").collect()
    assert [(r["label"], r["name"]) for r in got] == [(0, "clear"), (1, "unknown")]


def test_forecaster_gets_whole_windows(spark):
    df = windows.flag_daylight(spark.createDataFrame(two_sites(days=2), COLUMNS), 0.0)
    own = windows.candidates(df, 5, 4).where("status <> 'discontinuous'").select("series_id", "anchor_ts", "x", "y")
    got = windows.forecast(own, lambda: lambda x: np.stack([x[:, -1, 5], x[:, 0, 5], x[:, :, 5].sum(1), x[:, :, 1].min(1)], 1), 4).collect()
    assert got
    for r in got:
        p = [s["power"] for s in r["x"]]
        assert np.allclose(r["yhat"], [p[-1], p[0], sum(p), min(s["dni"] for s in r["x"])])
    assert windows.forecast(own.limit(0), lambda: lambda x: x, 4).count() == 0


def test_columns_are_resolved(spark):
    names = ["Time", "Total solar irradiance (W/m2)", "total solar again", "Power (MW)"]
    assert windows.resolve(names, "total SOLAR") == names[1] and windows.resolve(names, "total solar", True) == names[2] and windows.resolve(names, "wind") is None
    assert windows.numeric(spark.createDataFrame([], "a double, is_daylight boolean, b string, c int, d timestamp_ntz")) == ["a", "c"]


def test_sensor_csv(spark, tmp_path):
    names = {"ts": "Time(year-month-day h:m:s)", "tsi": "Total solar irradiance (W/m2)", "temp": "Air temperature  (°C) ", "power": "Power (MW)"}
    path = tmp_path / "site.csv"
    lines = ["2024-03-01 00:15:00,5.5,1,2", "2024-03-01 00:00:00,NaN,,3", "2024-03-01 00:30:00,7,8,9"]
    path.write_text("\n".join([",".join(names.values()), *lines]), encoding="utf-8")
    df = series.read_sensor_csv(spark, str(path), names)
    got = [tuple(r) for r in df.orderBy("ts").select("ts", "tsi", "temp", "power", "day").collect()]
    assert got == [(FIRST, None, None, 3.0, FIRST.date()), (FIRST + STEP, 5.5, 1.0, 2.0, FIRST.date()), (FIRST + 2 * STEP, 7.0, 8.0, 9.0, FIRST.date())]
    assert not quality.sorted_before(df).first()["is_sorted"] and quality.sorted_before(df.where("row_id <> 0")).first()["is_sorted"]
    path.write_text("\n".join([",".join(names.values()), "03/01/2024,1,1,1"]), encoding="utf-8")
    with pytest.raises(Exception, match="(?i)pars|cannot"):
        series.read_sensor_csv(spark, str(path), names).collect()


def test_config_and_artefacts(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("data:\n  time_column: T\n  minutes: 30\nsplit: {train: 0.6, val: 0.2, test: 0.2}\nodd: 1\n")
    c = artifacts.read_config(str(tmp_path / "c.yaml"))
    assert (c.time_column, c.minutes, c.train, c.capacity) == ("T", 30, 0.6, 50.0)
    (tmp_path / "e.yaml").write_text("")
    assert artifacts.read_config(str(tmp_path / "e.yaml")) == artifacts.Config()
    (tmp_path / "m.json").write_text(json.dumps({"names": {"0": "clear", "2": "cloudy"}}, indent=1))
    assert sorted(map(tuple, artifacts.read_json_map(spark, str(tmp_path / "m.json"), "names").collect())) == [(0, "clear"), (2, "cloudy")]
    table = spark.createDataFrame([(1, "x", 3.0), (0, "y", 2.0), (0, "x", 1.0), (1, "y", 4.0)], "k int, dim string, value double")
    results.write_params(table, str(tmp_path / "centres"))
    assert artifacts.read_centres(spark, str(tmp_path / "centres")) == [[1.0, 2.0], [3.0, 4.0]]


def test_results_are_written(spark, tmp_path):
    when = datetime.datetime(2024, 3, 1, 12, 30, 5)
    name = results.run_name("b0", "persistence", when, {"column": "Total solar irradiance (W/m2)", "threshold": 5.0, "mode": "mask"})
    assert name == "b0_persistence_daylight_tsi5_mask_20240301_123005" and results.run_name("b0", "m", when) == "b0_m_20240301_123005"
    long = spark.createDataFrame([(s, 1.0 * s, 2.0, k, 0.5 + k / 4) for s in range(1, 17) for k in (0, 1)], "step int, y double, yhat double, label int, own double")
    paths = results.write_results(metrics.point_metrics(long, 50.0), str(tmp_path), name)
    rows = [tuple(r) for r in spark.read.csv(paths["csv"], header=True).collect()]
    assert [r[:2] for r in rows] == [("1h", "4"), ("2h", "8"), ("4h", "16"), ("Overall", "-")] and rows[0][2] == "2.0000" and rows[-1][-1] == "6"
    results.write_report(metrics.sample_report(long, 50.0), str(tmp_path))
    docs = {d["scope"]: d["rows"] for d in (json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/report.json").collect())}
    assert len(docs["cluster"]) == 6 and len(docs["overall"]) == 3 and docs["cluster"][0]["mean_membership"] == 0.5
    wide = spark.read.csv(f"{tmp_path}/report_rounded.csv", header=True).collect()
    assert [(r["scope"], r["label"]) for r in wide] == [("cluster", "0"), ("cluster", "1"), ("overall", "-")] and len(wide[0]["4h"].split(".")[1]) == 4
    same = metrics.deltas(metrics.sample_report(long, 50.0), metrics.sample_report(long, 50.0)).collect()
    assert len(same) == 9 and all(r["delta"] == 0 for r in same)


def test_uses_count_as_windows_do(spark):
    rows = [("a", i, datetime.datetime(2024, 3, 1 + i // 80) + datetime.timedelta(minutes=15 * (i % 80 + (i % 80 > 50) + 3)), float(i % 7), 7.3, None if i == 20 else 0.5 * i) for i in range(240)]
    df = spark.createDataFrame(rows, "series_id string, row_id long, ts timestamp_ntz, tsi double, dni double, power double")
    df = windows.flag_daylight(df.select("*", F.lit(1.0).alias("ghi"), F.lit(2.0).alias("temp"), F.lit(3.0).alias("atm"), F.to_date("ts").alias("day")), 2.0)
    df = windows.split_by_day(df)
    own = windows.candidates(df).where("status = 'ok' AND split = 'train'").select(F.inline("x"))
    assert own.count() == windows.uses(df).agg(F.sum("uses")).first()[0] > 0
    want = {r["feature"]: r for r in scaling.moments(own, windows.FEATURES).collect()}
    for r in scaling.weighted_moments(windows.uses(df), windows.FEATURES, "uses").collect():
        w = want[r["feature"]]
        assert (r["low"], r["high"]) == (w["low"], w["high"]) and abs(r["mean"] - w["mean"]) < 1e-9 and abs(r["std"] - w["std"]) < 1e-9
    assert all(r["mean"] is None for r in scaling.weighted_moments(windows.uses(df.limit(0)), windows.FEATURES, "uses").collect())
