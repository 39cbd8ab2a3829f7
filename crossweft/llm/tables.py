"""Reading inputs and keeping intermediate tables where every executor can reach them."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweft.session import checkpoint_folder

#: Fixed values of the contracts: what a word is, in Java, RE2 and Python alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    Results are lazy and read these tables, so none is deleted here; all of an application
    lie in one folder of its name, to be dropped when it has ended.
    """
    return f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: its lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sampled_rows(rows: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` of the rows (_id, _text, ...), in the order of hashed ids.

    The rows are bounded, not the ids: equal rows count once, and an id that many rows share
    gives no more of them than the sample has room for.
    """
    keyed = rows.withColumn("_key", F.xxhash64("_text"))
    keys = keyed.select("_id", "_key").distinct().orderBy(F.xxhash64("_id"), "_id", "_key").limit(sample)
    return keyed.join(F.broadcast(keys), ["_id", "_key"]).dropDuplicates(["_id", "_key"]).drop("_key")


def ascii_lower(text: Column) -> Column:
    """A-Z only; null becomes empty. Pure ASCII texts take the fast built-in."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(
        F.translate(whole, UPPER, UPPER.lower())
    )


def one_by_one(column: pa.Array) -> Iterator:
    """The values of a column as Python objects, of which one at a time is held."""
    return (value.as_py() for value in column)


def give_back() -> None:
    """Return a worker's freed memory to the system when its task ends.

    Idle workers stay alive for a while beside those of the next stage.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
