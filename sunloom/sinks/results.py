"""Writes result tables as CSV and JSON, and parameters as Parquet; all are a few rows, in one file each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import named_rows, pivoted


def run_name(experiment: str, model: str, when: datetime, daylight: dict | None = None) -> str:
    """The name of a run's files: experiment, model, how daylight was used, and when.

    daylight has column, threshold and mode where daylight was used; the column is told by tsi, dni or irr.
    """
    parts = [experiment, model]
    if daylight:
        column = daylight["column"].lower()
        kind = "tsi" if "total" in column or "tsi" in column else "dni" if "direct" in column or "dni" in column else "irr"
        parts += ["daylight", f"{kind}{daylight['threshold']:g}", daylight["mode"]]
    return "_".join([*parts, when.strftime("%Y%m%d_%H%M%S")])


def write_results(metrics: DataFrame, folder: str, name: str, document: DataFrame | None = None) -> dict[str, str]:
    """Point metrics as rows of a report in CSV, and in JSON: as rows, or as the document of the run; gives the two paths."""
    paths = {kind: f"{folder}/{name}.{kind}" for kind in ("csv", "json")}
    named_rows(metrics).coalesce(1).write.mode("overwrite").csv(paths["csv"], header=True)
    if document is None:
        metrics.coalesce(1).write.mode("overwrite").json(paths["json"])
    else:
        write_document(document, paths["json"])
    return paths


def write_document(document: DataFrame, path: str) -> None:
    """A document (value), as the reports give them, as a file of text."""
    document.coalesce(1).write.mode("overwrite").text(path)


def write_experts(rows: DataFrame, path: str) -> None:
    """The table of experts as reports.expert_rows() gives it, in its order."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def report_json(report: DataFrame) -> DataFrame:
    """(value): one JSON document a scope, with its clusters and horizons in order."""
    rows = F.array_sort(F.collect_list(F.struct("label", "horizon", "mae", "rmse", "nrmse", "n", "mean_membership", "share")))
    return report.groupBy("scope").agg(rows.alias("rows")).select(F.to_json(F.struct("scope", "rows")).alias("value"))


def write_report(report: DataFrame, folder: str) -> None:
    """A cluster report as JSON documents, and with a column for each horizon as CSV: plain and with four decimals."""
    report_json(report).coalesce(1).write.mode("overwrite").text(f"{folder}/report.json")
    wide = pivoted(report).orderBy("scope", "label")
    wide.coalesce(1).write.mode("overwrite").csv(f"{folder}/report.csv", header=True)
    texts = [F.format_string("%.4f", c).alias(c) if t == "double" else F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c, t in wide.dtypes]
    wide.select(*texts).coalesce(1).write.mode("overwrite").csv(f"{folder}/report_rounded.csv", header=True)


def write_params(params: DataFrame, path: str) -> None:
    """Parameters, such as (feature, mean, std) or (k, dim, value), as Parquet."""
    params.coalesce(1).write.mode("overwrite").parquet(path)
