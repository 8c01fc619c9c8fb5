"""Documents of runs: headers, orders, missing values, fits."""

import json

from pyspark.sql import functions as F

from sunloom.operators import metrics, reports, routing, scaling
from sunloom.plans.reports import STORED
from sunloom.sinks import results

LONG = "label int, own double, step int, y double, yhat double"


def long_rows():
    return [(k, 0.6 + 0.1 * k, s, 10.0 + s, 10.0 + s + (k + 1) * (1 if s % 2 else -1)) for k in (0, 2) for _ in range(k + 1) for s in range(1, 17)]


def test_results_document(spark):
    rows = spark.createDataFrame([(s, y, z) for _, _, s, y, z in long_rows()], "step int, y double, yhat double")
    daylight = {"enabled": True, "column": "tsi", "threshold": 5.0, "mode": "mask"}
    d = json.loads(reports.results_document(metrics.point_metrics(rows, 50.0), "b0", "persistence", "20240301_123005", daylight).first()["value"])
    assert list(d) == ["model_name", "experiment_name", "timestamp", "total_samples", "daylight_filter", "horizons", "overall"]
    assert list(d["horizons"]) == ["1h", "2h", "4h"] and d["total_samples"] == 4 and d["daylight_filter"] == daylight
    assert d["horizons"]["1h"] == {"horizon_steps": 4, "mae": 2.5, "rmse": round(7**0.5, 6), "nrmse": round(7**0.5 / 50, 6), "n_samples": 4}
    assert d["overall"]["n_samples"] == 12
    none = json.loads(reports.results_document(metrics.point_metrics(rows.limit(0), 50.0), "b0", "m", "t").first()["value"])
    assert none["horizons"] == {} and none["total_samples"] is None and none["daylight_filter"] == {"enabled": False}


def test_documents_are_written(spark, tmp_path):
    point = metrics.point_metrics(spark.createDataFrame([(s, y, z) for _, _, s, y, z in long_rows()], "step int, y double, yhat double"), 50.0)
    document = reports.results_document(point, "b0", "m", "t")
    paths = results.write_results(point, str(tmp_path), "b0_m", document)
    assert [r["value"] for r in spark.read.text(paths["json"]).collect()] == [document.first()["value"]]
    report = metrics.sample_report(spark.createDataFrame(long_rows(), LONG), 50.0)
    results.write_experts(reports.expert_rows({"Hard": report}, spark.createDataFrame([(0, "clear")], "label int, name string")), f"{tmp_path}/e")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/e").collect()]
    assert lines[0] == ",".join(reports.EXPERT_COLUMNS) and [x.split(",")[:4] for x in lines[1:]] == [["Hard", "Overall", "", "-"], ["Hard", "0", "clear", "1"], ["Hard", "2", "unknown", "3"]]


def test_expert_rows(spark):
    report = metrics.sample_report(spark.createDataFrame(long_rows(), LONG), 50.0)
    names = spark.createDataFrame([(0, "clear")], "label int, name string")
    rows = reports.expert_rows({"Hard": report, "Soft": report.where("horizon <> '1h' OR label IS NULL")}, names).collect()
    assert rows[0].__fields__ == list(reports.EXPERT_COLUMNS)
    assert [(r.Type, r.Cluster, r.Semantic, r.N) for r in rows] == [("Hard", "Overall", "", "-"), ("Soft", "Overall", "", "-"), ("Hard", "0", "clear", "1"), ("Soft", "0", "clear", "1"), ("Hard", "2", "unknown", "3"), ("Soft", "2", "unknown", "3")]
    assert rows[2]["1h_MAE"] == "1.0000" and rows[2]["4h_nRMSE"] == "0.0200" and rows[3]["1h_MAE"] == "-"
    assert rows[0]["Avg_Membership"] == "-" and rows[4]["Avg_Membership"] == "0.8000"


def test_features_and_variance(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", None)], "feature string, std double")
    d = json.loads(reports.feature_document(rows, ["c", "b", "a", "absent"], scaling.LEAST).first()["value"])
    assert d == {"original": ["c", "b", "a", "absent"], "valid": ["a"], "dropped": ["c", "b", "absent"]}
    d = json.loads(reports.variance_document(reports.variance_rows([0.7, 0.2], [0.7, 0.9], spark), "share").first()["value"])
    assert d == {"n_components": 2, "mode": "share", "total_explained_variance": 0.9, "explained_variance_ratio": [0.7, 0.2], "cumulative_variance_ratio": [0.7, 0.9]}


def test_fit_document(spark):
    points = spark.range(60).select("id", (F.col("id") % 3 * 5 + F.col("id") / 100).alias("p0")).cache()
    found = routing.fit(points, "id", ["p0"], starts=(1, 2), most=20)
    d = json.loads(reports.fit_document(found, 2.0, 20, 1e-5))
    assert [r["start"] for r in d["run_history"]] == [1, 2] and d["best_jm"] == min(r["jm"] for r in d["run_history"])
    assert d["n_clusters"] == 3 and d["n_init"] == 2 and d["centers"] == found["centres"]


def test_router_document(spark):
    stats = spark.createDataFrame([(1, "cloudy", 4, 0.5), (0, "clear", 6, float("nan"))], "label int, name string, n_samples long, p double")
    d = json.loads(reports.router_document(stats, 2.0, {"pca_path": "pca.json"}, ["p"]).first()["value"])
    assert list(d["cluster_stats"]) == ["0", "1"] and d["cluster_semantic_map"] == {"0": "clear", "1": "cloudy"} and d["pca_path"] == "pca.json"
    assert d["cluster_stats"]["0"] == {"n_samples": 6, "p": None, "semantic_label": "clear"}


def test_stored_router_survives_its_text(spark):
    assert scaling.Router.of(STORED.text()) == STORED
