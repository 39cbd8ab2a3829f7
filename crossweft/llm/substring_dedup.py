"""Substring dedup by level-wise doubling of repeated windows of words.

Level one are the seeds of half the window's length: of each window the one seed with the
smallest hash. Seeds that occur once end here, with all their windows. Repeated seeds are
extended to twice their length, the full window: equal stretches around a seed are repeats
as a whole, and where the stretches differ every window in them is a candidate of level two.
Candidates found once end there; the others are repeats, except each one's first occurrence.
At the asked length no longer windows are needed, as they cover the same words;
``longest_repeats`` goes on doubling until no candidates survive.

A window's identity at level two is 128 bits of its words. Hot seeds and hot windows are
counted where they are found before anything is shuffled, and the joins that bring counts
back are plain equi-joins, which Spark splits where a key is hot.

Defined cases: null and empty texts have no words, and the digest of the empty string. Texts
shorter than a window lose nothing. Documents are ordered by id, nulls first; rows equal in
id and text are one document and get equal rows. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossweft.llm import repeats
from crossweft.llm.registry import query
from crossweft.llm.tables import stored, table

WINDOW = 20
SEED = WINDOW // 2


def _window_rows(open_parts: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(h1, h2, doc, at) of every window of the fragments left to compare."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(repeats.unpacked(batch.column(1))):
                spans = [(p["at"], p["units"]) for p in batch.column(2)[k].as_py()]
                first, second, starts = repeats.window_hashes(repeats.word_units([raw]).values, spans, width)
                doc = batch.column(0).take(pa.array(np.full(len(starts), k)))
                columns = [pa.array(first), pa.array(second), doc, pa.array(starts.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc", "at"])

    schema = T.StructType().add("h1", "long").add("h2", "long").add("doc", rows.schema["doc"].dataType).add("at", "integer")
    texts = repeats.packed(rows).join(open_parts, "doc").select("doc", "packed", "parts")
    return texts.mapInArrow(run, schema)


def repeated_spans(rows: DataFrame, width: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc, at, units): stretches of words covered by windows that occur earlier."""
    whole, open_parts = repeats.repeated_fragments(rows, repeats.word_units, width, seed)
    windows = stored(_window_rows(open_parts, rows, width), "substring-windows")
    return whole.unionByName(repeats.not_first(windows).withColumn("units", F.lit(width)))


def drop_repeats(docs: DataFrame, width: int = WINDOW, seed: int = SEED, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_removed and the words kept, joined by a space."""
    rows = repeats.identified(docs, identity, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, out = batch.column(2), []
            for k, raw in enumerate(repeats.unpacked(batch.column(1))):
                words = raw.split()
                gone = repeats.covered(len(words), repeats.spans_of(spans, k))
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                out.append((len(words), int(gone.sum()), b" ".join(kept).decode()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept"])

    whole = repeats.by_document(rows, repeated_spans(rows, width, seed)).select("doc_id", "packed", "spans")
    schema = T.StructType().add(rows.schema["doc_id"]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return whole.mapInArrow(run, schema)


def longest_repeats(docs: DataFrame, width: int = WINDOW, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, length): the longest window of ``width * 2**k`` words that a text has in common
    with another place; found by doubling the survivors until none is left."""
    rows = repeats.identified(docs, identity, text)
    found = repeats.found_fragments(rows, repeats.word_units, width, width)
    level = stored(found.withColumn("h1", F.col("anchor")).withColumn("h2", F.col("fragment")).select("h1", "h2", "doc", "at"), "level")
    out, length = None, width
    while True:
        twice = level.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        level = stored(level.join(twice, ["h1", "h2"], "left_semi"), "level")
        if level.isEmpty():
            break
        reached = level.select("doc").distinct().withColumn("length", F.lit(length))
        out = reached if out is None else out.unionByName(reached)
        # Twice the length repeats only where both halves do.
        right = level.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "doc", (F.col("at") - length).alias("at"))
        level = level.join(right, ["doc", "at"]).select(
            F.xxhash64("h1", "r1").alias("h1"), F.xxhash64("h2", "r2", "h1").alias("h2"), "doc", "at"
        )
        length *= 2
    if out is None:
        return rows.select("doc", F.lit(0).alias("length")).limit(0)
    return out.groupBy("doc").agg(F.max("length").alias("length"))


@query("op3_substring_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeats(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
