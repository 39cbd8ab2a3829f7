"""Saving and loading trained state as Parquet tables, and the staleness check."""

from __future__ import annotations

import json
import time
from uuid import uuid4

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("atoms", "codes", "model", "item_keys")
OPTIONAL = ("vocab", "scales", "feature_config", "ann", "hyperplanes", "training_metadata", "schema")
# Tables that are only of use together.
INDEX = ("ann", "hyperplanes")


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Write a new version beside the older ones, and name it the current one last.

    A save that fails, or one that reads what an older version holds, leaves that version
    as it is.
    """
    unknown = set(tables) - set(REQUIRED) - set(OPTIONAL)
    if unknown:
        raise ValueError(f"Unknown artifacts: {sorted(unknown)}.")
    version = f"{time.time_ns():020d}-{uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/versions/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version,)], "version string").write.mode("append").parquet(f"{folder}/current")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All artifacts of the newest version; an error naming every required one that is missing."""
    versions = _table(spark, f"{folder}/current")
    newest = "none" if versions is None else versions.agg(F.max("version")).first()[0]
    found = {name: _table(spark, f"{folder}/versions/{newest}/{name}") for name in REQUIRED + OPTIONAL}
    missing = [name for name in REQUIRED if found[name] is None]
    if missing:
        raise FileNotFoundError(f"Missing artifacts in {folder}: {', '.join(missing)}. Train first.")
    if any(found[name] is None for name in INDEX):
        found |= dict.fromkeys(INDEX)
    return {name: df for name, df in found.items() if df is not None}


def key_differences(trained: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with ``side`` = 'trained' or 'current'."""
    a, b = trained.select(*keys), current.select(*keys)
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("trained")).unionByName(
        b.join(a, keys, "left_anti").withColumn("side", F.lit("current"))
    )


def require_same_items(trained: DataFrame, current: DataFrame) -> None:
    if not key_differences(trained, current, ["domain", "item_id"]).isEmpty():
        raise ValueError("The current tables differ from the trained ones. Train again.")


def matrix_table(spark: SparkSession, rows: np.ndarray, index: str, column: str) -> DataFrame:
    return spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(rows)], f"{index} int, {column} array<double>"
    )


def table_matrix(df: DataFrame, index: str, column: str) -> np.ndarray:
    return np.array([r[column] for r in df.orderBy(index).collect()])


def json_row(spark: SparkSession, value: dict) -> DataFrame:
    return spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "content string")


def read_json_row(df: DataFrame) -> dict:
    return json.loads(df.first()["content"])
