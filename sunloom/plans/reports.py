"""Queries of the reports, of routing by stored parameters, and of repeated centre updates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, reports, routing, scaling, windows
from . import events
from .events import _NAMED, _OWNU, _REP, _U, CAPACITY, CENTRES, POINT

#: The daylight filter that the results name.
DAYLIGHT = {"enabled": True, "column": "tsi", "threshold": events.THRESHOLD, "mode": "mask"}
#: A stored router: means, deviations and axes over POINT, and centres on the axes.
STORED = scaling.Router(
    scaling.Scaler(dict(zip(POINT, (3.5, 0.36), strict=True)), dict(zip(POINT, (0.4, 0.05), strict=True))),
    scaling.Components(list(POINT), [[0.8, 0.6], [-0.6, 0.8]], [0.9, 0.1]), [[-1.2, 0.1], [0.1, -0.2], [1.3, 0.2]], 2.0, {0: "low", 2: "high"},
)
ROUNDS = 3
PATHS = {"scaler_path": "scaler.json", "pca_path": "pca.json", "centers_path": "centers"}


def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.results_document(events.persistence_point_metrics(spark, sf_dir), "events", "persistence", "20240101_000000", DAYLIGHT)


def experts_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.routed(spark, sf_dir)
    names = routing.semantic_names(rows.where("split = 'train'"))
    return reports.expert_rows({"Hard": events.cluster_report_hard(spark, sf_dir), "Soft": events.cluster_report_soft(spark, sf_dir)}, names)


def feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaling.moments(events.vectors(spark, sf_dir).where("split = 'train'"), windows.STATE)
    return reports.feature_document(rows, windows.STATE, scaling.LEAST)


def _shares(points: DataFrame, k: int) -> DataFrame:
    train = points.where("split = 'train'")
    found = scaling.principal(scaling.fit_state(train, POINT).rows(train), POINT, k)
    return reports.variance_rows(found.explained, found.cumulative(), points.sparkSession)


def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of variance of the axes over the two scaled features of POINT."""
    rows = _shares(events.vectors(spark, sf_dir).select("split", *POINT).persist(), 2)
    return rows.select("component", *[F.round(c, 6).alias(c) for c in ("explained", "cumulative")])


def router_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = events.routed(spark, sf_dir).where("split = 'train'").select("label", "power_mean", "tsi_mean", "tsi_std", F.lit(1).alias("one"))
    sizes = train.groupBy("label").agg(F.count(F.lit(1)).alias("n_samples"), *[F.avg(c).alias(c) for c in ("power_mean", "tsi_mean", "tsi_std")])
    # The means of means of one row a cluster are the means themselves.
    names = routing.semantic_names(sizes, "power_mean", ("clear", "cloudy", "low_irradiance"), "tsi_mean", "tsi_std")
    return reports.router_document(names.join(F.broadcast(sizes.select("label", "n_samples")), "label"), 2.0, PATHS, ("power_mean", "tsi_mean", "tsi_std"))


def router_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships, label and name of every window by the stored router."""
    rows = STORED.route(events.vectors(spark, sf_dir), "anchor_ts")
    return rows.select("anchor_ts", *[F.round(F.col("u")[k], 6).alias(f"u{k}") for k in range(3)], "label", "name")


def fcm_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centres after ROUNDS rounds of the fuzzy fit from CENTRES, on the training windows."""
    points = events.vectors(spark, sf_dir).where("split = 'train'").select(*POINT).persist()
    now, out = [list(c) for c in CENTRES], None
    for _ in range(ROUNDS):
        out = routing.centre_update(points.withColumn("u", routing.memberships(routing.distances([F.col(c) for c in POINT], now))), POINT, 3)
        found = {(r["k"], r["dim"]): r["value"] for r in out.collect()}  # six numbers
        now = [[found[k, c] for c in POINT] for k in range(3)]
    return out.withColumn("value", F.round("value", 6))


def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage of fuzzy clusters as one document."""
    g = events.vectors(spark, sf_dir).persist()
    rows = events.labelled(windows.finite(g)).persist()
    train = rows.where("split = 'train'")
    kept = scaling.moments(g.where("split = 'train'"), windows.STATE).agg(F.count(F.when(F.col("std") > scaling.LEAST, 1)).alias("n_kept"))
    scores = reports.one(routing.silhouette(rows, "anchor_ts", POINT), routing.davies_bouldin(rows, POINT))
    distances = routing.centre_distances(routing.centre_update(train, POINT, 3))
    tested = metrics.sample_report(events.hard_steps(rows.where("split = 'test'")), CAPACITY)
    lost = g.select("split", F.lit(1).alias("n")).unionByName(rows.select("split", F.lit(-1).alias("n"))).groupBy("split").agg(F.sum("n").alias("n"))
    sizes = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return reports.stage_document({"experiment": "clusters of events"}, len(windows.STATE), kept, _shares(rows, 1), "fixed", scores, distances, sizes, tested, lost)


def _six(x: str) -> str:
    return f"coalesce(CAST(CAST(round({x}, 6) AS DECIMAL(18,6)) AS VARCHAR), 'null')"


_HALF_UP = lambda x: f"CAST(CAST(round(CAST({x} AS DECIMAL(18,6)), 4) AS DECIMAL(18,4)) AS VARCHAR)"
_FOUR = lambda h, m: f"coalesce({_HALF_UP(f'max({m}) FILTER (horizon = {chr(39)}{h}{chr(39)})')}, '-') AS \"{h}_{ {'mae': 'MAE', 'rmse': 'RMSE', 'nrmse': 'nRMSE'}[m]}\""
_WIDE = ", ".join(_FOUR(h, m) for h in metrics.HORIZONS for m in ("mae", "rmse", "nrmse"))
_ERR = f"""'"mae":' || {_six('mae')} || ',"rmse":' || {_six('rmse')} || ',"nrmse":' || {_six('nrmse')} || ',"n_samples":' || n || '}}'"""
_PCA = "WITH {u}, k AS (SELECT abs(corr(tsi_mean, power_mean)) AS r FROM lab WHERE split = 'train')"
_ROUND_U = ", ".join(f"greatest(power(tsi_mean - a{k}, 2) + power(power_mean - b{k}, 2), 1e-10) AS e{k}" for k in range(3))
_ROUND_W = ", ".join(f"power(power(e{k} / e0, 2) + power(e{k} / e1, 2) + power(e{k} / e2, 2), -2) AS w{k}" for k in range(3))
_ROUND_C = ", ".join(f"sum(w{k} * tsi_mean) / sum(w{k}) AS a{k}, sum(w{k} * power_mean) / sum(w{k}) AS b{k}" for k in range(3))


def _rounds(n: int) -> str:
    out = ["c0 AS (SELECT " + ", ".join(f"{a}::DOUBLE AS a{k}, {b}::DOUBLE AS b{k}" for k, (a, b) in enumerate(CENTRES)) + ")"]
    for i in range(n):
        out.append(f"c{i + 1} AS (SELECT {_ROUND_C} FROM (SELECT *, {_ROUND_W} FROM (SELECT tsi_mean, power_mean, {_ROUND_U} FROM lab, c{i} WHERE split = 'train')))")
    return ", ".join(out)


_P0, _P1 = (f"((tsi_mean - 3.5) / 0.4 * {a} + (power_mean - 0.36) / 0.05 * {b})" for a, b in STORED.components.axes)
_ROUTE_D = ", ".join(f"greatest(power({_P0} - ({a}), 2) + power({_P1} - ({b}), 2), 1e-10) AS e{k}" for k, (a, b) in enumerate(STORED.centres))
_ROUTE_U = ", ".join(f"1 / (power(e{k} / e0, 2) + power(e{k} / e1, 2) + power(e{k} / e2, 2)) AS v{k}" for k in range(3))
_HARD_TEST = f"""rt AS (SELECT label, horizon, count(*) FILTER (step = 1) AS samples, round(sqrt(avg(e * e)) / 500, 6) AS nrmse, round(avg(own), 6) AS own
        FROM (SELECT split, label, {_OWNU} AS own, step, p - y AS e FROM (SELECT lab.*, CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p FROM lab JOIN ex USING (anchor_ts)) JOIN (SELECT anchor_ts, step, y FROM y) USING (anchor_ts))
        JOIN hz ON step <= steps WHERE split = 'test' GROUP BY label, horizon)"""
_AT = lambda h: f"max(nrmse) FILTER (horizon = '{h}')"

SQL = {
    "results_json": f"""WITH m AS ({events.SQL['persistence_point_metrics']}), s AS (SELECT *, CASE horizon WHEN '1h' THEN 4 WHEN '2h' THEN 8 WHEN '4h' THEN 16 END AS steps FROM m)
        SELECT '{{"model_name":"persistence","experiment_name":"events","timestamp":"20240101_000000","total_samples":' || max(n) FILTER (steps IS NOT NULL)
          || ',"daylight_filter":{{"enabled":true,"column":"tsi","threshold":3.0,"mode":"mask"}},"horizons":{{'
          || string_agg('"' || horizon || '":{{"horizon_steps":' || steps || ',' || {_ERR}, ',' ORDER BY steps) FILTER (steps IS NOT NULL)
          || '}},"overall":{{' || max({_ERR}) FILTER (horizon = 'overall') || '}}' AS value FROM s""",
    "experts_csv": f"""{_REP}, n AS (SELECT label, name FROM {_NAMED.format('')}), b AS (SELECT 'Hard' AS t, * FROM r_hard UNION ALL SELECT 'Soft', * FROM r_soft),
        w AS (SELECT t, scope, label, max(samples) AS k, max(mean_membership) FILTER (horizon = '4h') AS u, {_WIDE} FROM b GROUP BY t, scope, label)
        SELECT t AS "Type", CASE scope WHEN 'overall' THEN 'Overall' ELSE CAST(w.label AS VARCHAR) END AS "Cluster", CASE scope WHEN 'overall' THEN '' ELSE coalesce(name, 'unknown') END AS "Semantic",
          CASE scope WHEN 'overall' THEN '-' ELSE CAST(k AS VARCHAR) END AS "N", {', '.join(f'"{h}_{m}"' for h in metrics.HORIZONS for m in reports.MEASURES)},
          CASE scope WHEN 'overall' THEN '-' ELSE {_HALF_UP('u')} END AS "Avg_Membership" FROM w LEFT JOIN n ON w.label = n.label""",
    "feature_report": f"""WITH p AS ({events.SQL['scaler_g_params']}), o AS (SELECT unnest([{', '.join(f"'{c}'" for c in windows.STATE)}]) AS feature, unnest(range({len(windows.STATE)})) AS i)
        SELECT '{{"original":[' || string_agg('"' || feature || '"', ',' ORDER BY i) || '],"valid":[' || coalesce(string_agg('"' || feature || '"', ',' ORDER BY i) FILTER (kept), '')
          || '],"dropped":[' || coalesce(string_agg('"' || feature || '"', ',' ORDER BY i) FILTER (NOT kept), '') || ']}}' AS value FROM o JOIN p USING (feature)""",
    "pca_explained": _PCA.format(u=_U) + " SELECT 1 AS component, round((1 + r) / 2, 6) AS explained, round((1 + r) / 2, 6) AS cumulative FROM k UNION ALL SELECT 2, round((1 - r) / 2, 6), 1.0 FROM k",
    "router_report": f"""WITH {_U}, nn AS (SELECT label, count(*) AS n FROM lab WHERE split = 'train' GROUP BY label), st AS (SELECT * FROM {_NAMED.format('')} JOIN nn USING (label))
        SELECT '{{"n_clusters":' || count(*) || ',"m":2.0,"scaler_path":"scaler.json","pca_path":"pca.json","centers_path":"centers","cluster_semantic_map":{{'
          || string_agg('"' || label || '":"' || name || '"', ',' ORDER BY label) || '}},"cluster_stats":{{'
          || string_agg('"' || label || '":{{"n_samples":' || n || ',"power_mean":' || {_six('p')} || ',"tsi_mean":' || {_six('t')} || ',"tsi_std":' || {_six('ts')} || ',"semantic_label":"' || name || '"}}', ',' ORDER BY label)
          || '}}}}' AS value FROM st""",
    "router_route": f"""WITH {_U}, z1 AS (SELECT anchor_ts, {_ROUTE_D} FROM lab), z2 AS (SELECT *, {_ROUTE_U} FROM z1), z3 AS (SELECT *, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS label FROM z2)
        SELECT anchor_ts, round(v0, 6) AS u0, round(v1, 6) AS u1, round(v2, 6) AS u2, label, CASE label WHEN 0 THEN 'low' WHEN 2 THEN 'high' ELSE 'unknown' END AS name FROM z3""",
    "fcm_rounds": f"WITH {_U}, {_rounds(ROUNDS)} " + " UNION ALL ".join(f"SELECT {k} AS k, '{c}' AS dim, round({s}{k}, 6) AS value FROM c{ROUNDS}" for k in range(3) for s, c in zip("ab", POINT, strict=True)),
    "stage_report": f"""WITH {_U}, {events._EX}, {_HARD_TEST},
        kept AS (SELECT count(*) FILTER (kept) AS n FROM ({events.SQL['scaler_g_params']})), pc AS (SELECT (1 + abs(corr(tsi_mean, power_mean))) / 2 AS s FROM lab WHERE split = 'train'),
        si AS ({events.SQL['silhouette']}), db AS ({events.SQL['davies_bouldin']}),
        ce AS (SELECT {_ROUND_C} FROM (SELECT *, u0 * u0 AS w0, u1 * u1 AS w1, u2 * u2 AS w2 FROM lab WHERE split = 'train')),
        cl AS (SELECT 0 AS k, a0 AS a, b0 AS b FROM ce UNION ALL SELECT 1, a1, b1 FROM ce UNION ALL SELECT 2, a2, b2 FROM ce),
        cd AS (SELECT x.k AS k1, '[' || string_agg({_six('sqrt(power(x.a - z.a, 2) + power(x.b - z.b, 2))')}, ',' ORDER BY z.k) || ']' AS line FROM cl x JOIN cl z ON true GROUP BY 1),
        cm AS (SELECT '[' || string_agg(line, ',' ORDER BY k1) || ']' AS m FROM cd),
        tr AS (SELECT label, count(*) AS n FROM lab WHERE split = 'train' GROUP BY label), rs AS (SELECT string_agg('"cluster_' || label || '":' || {_six('n / (SELECT sum(n) FROM tr)')}, ',' ORDER BY label) AS r FROM tr),
        ts AS (SELECT label, max(samples) AS n, {', '.join(f'{_AT(h)} AS e{h}' for h in metrics.HORIZONS)}, max(own) FILTER (horizon = '4h') AS u FROM rt GROUP BY label),
        tj AS (SELECT string_agg('{{"cluster_id":' || label || ',"n_samples":' || n || {' || '.join(f"""',"nrmse_{h}":' || {_six('e' + h)}""" for h in metrics.HORIZONS)} || ',"nrmse_overall":' || {_six('e4h')} || ',"avg_membership":' || {_six('u')} || '}}', ',' ORDER BY label) AS j FROM ts)
        SELECT '{{"experiment":"clusters of events","g_dim_original":{len(windows.STATE)},"g_dim_after_scaler":' || kept.n || ',"pca":{{"n_components":1,"mode":"fixed","total_explained_variance":' || {_six('pc.s')}
          || '}},"fcm":{{"n_clusters":3,"silhouette_score":' || {_six('si.silhouette')} || ',"davies_bouldin_index":' || {_six('db.davies_bouldin')} || ',"center_distances":' || cm.m || '}},"cluster_ratios":{{' || rs.r
          || '}},"cluster_metrics_test":[' || tj.j || '],"dropped_samples":{{"train":0,"val":0,"test":0}}}}' AS value FROM kept, pc, si, db, cm, rs, tj""",
}
QUERIES = {name: globals()[name] for name in SQL}
