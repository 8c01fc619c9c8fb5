"""Sources of configuration and of small artefacts: YAML, JSON maps, and tables of centres."""

from __future__ import annotations

from dataclasses import dataclass, fields

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """How a series is read, split, cut and measured. Names that a file leaves out have these values."""

    time_column: str = "ts"
    time_format: str = "yyyy-MM-dd HH:mm:ss"
    minutes: int = 15
    input_length: int = 16
    max_horizon: int = 16
    train: float = 0.70
    val: float = 0.15
    test: float = 0.15
    capacity: float = 50.0
    daylight_column: str = "tsi"
    daylight_threshold: float = 5.0
    daylight_mode: str = "mask"
    clusters: int = 3


def read_config(path: str) -> Config:
    """The configuration in a YAML file; sections are only headings. Names that Config doesn't have are left out."""
    with open(path, encoding="utf-8") as f:
        tree = yaml.safe_load(f) or {}
    flat = {}
    todo = [tree]
    while todo:
        for k, v in todo.pop().items():
            todo.append(v) if isinstance(v, dict) else flat.setdefault(k, v)
    return Config(**{f.name: type(f.default)(flat[f.name]) for f in fields(Config) if flat.get(f.name) is not None})


def read_json_map(spark: SparkSession, path: str, field: str, value: str = "string") -> DataFrame:
    """(key int, value) of a map in JSON documents, whose keys are numbers as strings, under the name `field`."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"`{field}` map<string, {value}>").alias("d"))
    return rows.select(F.explode(F.col("d").getField(field)).alias("key", "value")).withColumn("key", F.col("key").cast("int"))


def read_centres(spark: SparkSession, path: str) -> list[list[float]]:
    """The centres of a Parquet table (k, dim, value), dimensions in the order of their names; a few rows."""
    rows = spark.read.parquet(path).orderBy("k", "dim").collect()
    return [[r["value"] for r in rows if r["k"] == k] for k in sorted({r["k"] for r in rows})]
