"""Session defaults and the one place that decides where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "crossweft", cores: str = "*", memory: str | None = None) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory or os.environ.get("BENCH_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
            folder = tempfile.mkdtemp(prefix="crossweft-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise to the shared checkpoint folder, so losing an executor loses nothing."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
