"""A versioned table of model weights (model, version, layer, place, value), and the lookup of experts by suffix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neural import Shape, Weights

SCHEMA = "model string, version int, layer string, place int, value double"


def save_weights(spark: SparkSession, path: str, models: dict[str, Weights]) -> int:
    """Appends models as one new version, which it returns; earlier versions stay. Readers see a version whole or not."""
    last = versions(spark, path)
    version = 1 + max(last, default=0)
    rows = [(name, version, layer, i, float(v)) for name, w in models.items() for layer, a in w.items() for i, v in enumerate(a.reshape(-1))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return version


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(SCHEMA).parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    df = _table(spark, path)
    return [] if df is None else sorted(r["version"] for r in df.select("version").distinct().collect())


def load_weights(spark: SparkSession, path: str, shape: Shape, version: int | None = None) -> dict[str, Weights]:
    """The models of a version, by default the last, by name; of another shape than asked for is an error."""
    known = versions(spark, path)
    version = version or max(known, default=0)
    if version not in known:
        raise FileNotFoundError(f"{path} has no version {version}")
    sizes, out = shape.parameters(), {}
    table = _table(spark, path).where(F.col("version") == version).toPandas()  # as large as the models
    for (model, layer), part in table.groupby(["model", "layer"]):
        values = part.sort_values("place")["value"].to_numpy()
        if layer not in sizes or len(values) != int(np.prod(sizes[layer])):
            raise ValueError(f"{model}: {layer} is not of the shape asked for")
        out.setdefault(model, {})[layer] = values.reshape(sizes[layer])
    if short := [m for m, w in out.items() if set(w) != set(sizes)]:
        raise ValueError(f"{', '.join(short)}: layers are missing")
    return out


def suffix_of(use_warm: bool, suffix: str) -> str:
    """The suffix of experts' names: one that is given counts even if warm experts are not asked for."""
    return suffix or ("_warm" if use_warm else "")


def experts(models: dict[str, Weights], labels: list[int], suffix: str = "", absent: str = "abort", base: str = "expert") -> dict[int, Weights]:
    """The weights of `base`_k`suffix` by label k. absent: abort raises if any is missing; train leaves it out.

    A label that is left out begins anew when it is passed to fit(start=...).
    """
    if absent not in ("abort", "train"):
        raise ValueError("absent must be abort or train")
    missing = [k for k in labels if f"{base}_{k}{suffix}" not in models]
    if missing and absent == "abort":
        raise FileNotFoundError(f"no weights of {', '.join(f'{base}_{k}{suffix}' for k in missing)}")
    return {k: models[f"{base}_{k}{suffix}"] for k in labels if k not in missing}
