"""Registry of the queries that run the operators over whole tables.

``@query(name, sql)`` files a Spark query and, where SQL can say the same thing, the
statement that must give equal rows. ``covers`` names the inventory rows it shows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, covers: str = "") -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"Query {name!r} is registered twice.")
        REGISTRY[name] = Entry(run, sql, tuple(covers.split()))
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
