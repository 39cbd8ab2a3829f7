"""Exact dedup as a stateful stream whose keyed state never expires.

A document becomes a narrow record: the digest of its normalised text, its ``doc_id`` and
the content locator (file and row where its bytes lie). The records stream through a keyed
aggregation with the state on disk (RocksDB) and no watermark, so a digest is remembered
for ever; state is the digest, the record that stays, and the number of hits. A restarted
stream continues from its checkpoint, and later records join the groups already known.

A digest that was hit is only a candidate. The full bytes of its texts are then compared: they
are grouped by the text itself, which each task does for its own rows before anything is
shuffled, so a group of any size costs a few rows a task. Should one digest stand for
different texts, its rows get their group from that comparison instead of from the state.

Defined cases: a null text counts as empty, and empty texts are equal to each other. Of
equal texts the largest ``doc_id`` stays, a null ``doc_id`` being smallest; among rows with
that same ``doc_id`` the one with the largest locator stays, so of repeated rows exactly
one. An empty table gives an empty result. Other columns, whatever their names, are kept
by ``drop_copies`` and ignored by ``exact_groups``.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweft.llm.registry import query
from crossweft.llm.tables import UPPER, ascii_lower, shared_path, stored, table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Bytes of records a micro-batch takes in; a long input becomes many batches.
BATCH_BYTES = 16 << 30
#: Native memory that the stores of one executor share; state beyond it is read from disk.
STATE_MEMORY_MB = "128"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``locator`` in front; a table that lies in no files is stored first."""
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select(F.struct(place["file_path"].alias("file"), place["row_index"].alias("row")).alias("locator"), F.struct(*docs.columns).alias("doc"))
    except AnalysisException:
        return located(stored(docs, "dedup-docs"))


def records(found: DataFrame, identity: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    return found.select("locator", F.col(f"doc.{identity}").alias("doc_id"), digest(ascii_lower(F.col(f"doc.{text}"))).alias("digest"))


def remember(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Run the available part of a stream of records into keyed state; return the state.

    One row a digest: digest, keeper (doc_id, locator), group_size. Calling again with the
    same ``checkpoint`` and new files in the source goes on from the state of before.
    """
    spark = stream.sparkSession
    state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    # Stores take the disk they fill; reserving space ahead costs megabytes for each partition.
    with (
        _setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB),
        _setting(spark, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false"),
        _setting(spark, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true"),
        _setting(spark, "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", STATE_MEMORY_MB),
    ):
        run = (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        try:
            run.awaitTermination()
        finally:
            run.stop()
        held = spark.read.format("statestore").load(checkpoint)
        return held.select(F.col("key.digest").alias("digest"), F.col("value.max").alias("keeper"), F.col("value.count").alias("group_size"))


def exact_groups(
    docs: DataFrame,
    identity: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row a document: locator, doc_id, digest, keep_id, group_size, kept."""
    return _groups(located(docs), identity, text, digest, batch_bytes)


def _groups(found: DataFrame, identity: str, text: str, digest: Callable[[Column], Column], batch_bytes: int) -> DataFrame:
    spark = found.sparkSession
    narrow = records(found, identity, text, digest)
    path = shared_path(spark, "dedup-records")
    narrow.write.parquet(path)
    rows = spark.read.schema(narrow.schema).parquet(path)
    stream = spark.readStream.schema(narrow.schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)
    groups = stored(remember(stream, shared_path(spark, "dedup-state")), "dedup-groups")

    hit = groups.where("group_size > 1").select("digest")
    texts = found.select("locator", F.col(f"doc.{identity}").alias("doc_id"), ascii_lower(F.col(f"doc.{text}")).alias("bytes"))
    texts = texts.withColumn("digest", digest(F.col("bytes")))
    same_bytes = (
        texts.join(hit, "digest", "left_semi")
        .groupBy("digest", "bytes")
        .agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    )
    clashes = stored(same_bytes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "dedup-clashes")
    plain = rows.join(groups, "digest")
    if not clashes.isEmpty():
        apart = same_bytes.join(clashes, "digest", "left_semi")
        plain = (
            rows.join(groups.join(clashes, "digest", "left_anti"), "digest")
            .unionByName(texts.join(apart, ["digest", "bytes"]).select("digest", "locator", "doc_id", "keeper", "group_size"))
        )
    return plain.select(
        "locator",
        "doc_id",
        "digest",
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        (F.col("locator") == F.col("keeper.locator")).alias("kept"),
    )


def drop_copies(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    found = located(docs)
    kept = _groups(found, identity, text, sha256, BATCH_BYTES).where("kept").select("locator")
    return found.join(kept, "locator", "left_semi").select("doc.*")


SQL = f"""
    WITH d AS (
      SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)"""


@query("op2_exact_dedup", SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
