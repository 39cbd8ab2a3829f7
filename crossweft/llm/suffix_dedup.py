"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Stretches of text that can hold repeated strings (``repeats``: first fragments whose anchor
has other fragments too) are dealt by anchor, so that equal strings meet in one task. A task
lays a bounded number of them end to end, sorts the suffixes by their first ``width`` bytes
and takes the Burrows-Wheeler transform. An interval is the rows whose suffixes share a
prefix. Starting from the longest prefixes that sorting has told apart, all intervals of one
level are extended backward at once: row ``r`` goes to the interval of (its first byte, the interval of the row that
follows it in the text), the step that the transform's last-to-first mapping gives. So
common prefixes come in increasing length, intervals of one row are dropped at once, and the
expansion stops at ``width``; longer prefixes cover the same bytes and are never derived.

An anchor with more than ``HOT_KINDS`` different fragments would not fit a task: its windows
are compared by 128-bit hashes instead, as rows that meet by their own hash.

Defined cases: null and empty texts have no bytes, and the digest of the empty string. Texts
shorter than ``width`` lose nothing. Documents are ordered by id, nulls first; rows equal in
id and text are one document and get equal rows. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossweft.llm import repeats
from crossweft.llm.registry import query
from crossweft.llm.tables import stored, table

WIDTH = 100
SEED = 32
HOT_KINDS = 32_768
#: Bytes of fragments whose suffixes are sorted together.
BATCH_BYTES = 1 << 19
SEPARATOR = 0xFF  # no byte of UTF-8


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and each key's rank, equal keys having equal ranks."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return order, rank


def suffix_rows(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, rank, known): starts of all suffixes by their first ``depth`` symbols or more.

    Prefix doubling from 8 symbols on, three ranks to a key while they fit. ``rank`` numbers
    the prefixes of ``known`` symbols, the last step that was not beyond ``depth``.
    """
    n = len(symbols)
    ahead = np.concatenate([symbols, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | ahead[k : k + n]
    order, rank = _ranked(key)
    known = reach = 8
    kept = rank
    while reach < depth:
        parts = 3 if n < 1 << 21 and reach * 2 < depth else 2
        key = rank
        for k in range(1, parts):
            after = np.zeros(n, np.int64)
            after[: max(0, n - reach * k)] = rank[reach * k :]
            key = key * (n + 1) + after
        order, rank = _ranked(key)
        reach *= parts
        if reach <= depth:
            known, kept = reach, rank
    return order, kept, known


def expand_intervals(symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, interval): suffixes that share their first ``width`` symbols with others.

    ``SEPARATOR`` is equal to nothing; the last symbol must be one. Sorting leaves the
    intervals of some length behind, from which the expansion goes on symbol by symbol.
    """
    if width < 8:
        order, held_all, known = suffix_rows(symbols, width)[0], None, 1
    else:
        order, rank, known = suffix_rows(symbols, width)
        held_all = rank[order]
    first = symbols[order]
    if held_all is None:
        held_all = np.cumsum(np.concatenate([[True], first[1:] != first[:-1]]))
    cuts = np.flatnonzero(symbols == SEPARATOR)
    room = np.repeat(cuts, np.diff(cuts, prepend=-1)) - np.arange(len(symbols))  # symbols to the next separator
    follower = np.argsort(symbols[order - 1], kind="stable").astype(np.int32)  # the row that comes next in the text

    def several(interval: np.ndarray) -> np.ndarray:
        new = np.concatenate([[True], interval[1:] != interval[:-1], [True]])
        return ~(new[:-1] & new[1:])

    rows = np.flatnonzero(room[order] >= known).astype(np.int32)
    if not len(rows):
        return order[rows], rows
    rows = rows[several(held_all[rows])]
    held = np.full(len(symbols), -1, np.int32)
    held[rows] = held_all[rows]
    for _ in range(width - known):
        behind = held[follower[rows]]
        going = behind >= 0
        now, behind = held[rows[going]], behind[going]
        held[rows] = -1
        rows = rows[going]
        if not len(rows):
            break
        new = np.concatenate([[True], (now[1:] != now[:-1]) | (behind[1:] != behind[:-1])])
        interval = np.cumsum(new, dtype=np.int32)
        more = several(interval)
        rows = rows[more]
        held[rows] = interval[more]
    return order[rows], held[rows]


def repeated_windows(pieces: list[tuple[tuple, int, bytes]], width: int) -> list[tuple[int, int, int]]:
    """(piece, at, bytes): stretches of windows that occur earlier; pieces are (doc, at, bytes)."""
    lengths = np.array([len(p[2]) + 1 for p in pieces])
    begin = np.cumsum(lengths) - lengths
    between = bytes([SEPARATOR])
    symbols = np.frombuffer(between.join(p[2] for p in pieces) + between, np.uint8)
    starts, interval = expand_intervals(symbols, width)
    if not len(starts):
        return []
    piece = np.searchsorted(begin, starts, side="right") - 1
    docs = sorted({p[0] for p in pieces})
    place_of = {d: k for k, d in enumerate(docs)}
    doc = np.array([place_of[p[0]] for p in pieces])[piece]
    at = np.array([p[1] for p in pieces])[piece] + starts - begin[piece]
    by = np.lexsort((at, doc, interval))
    interval, doc, at, piece = interval[by], doc[by], at[by], piece[by]
    new = np.concatenate([[True], interval[1:] != interval[:-1]])
    group = np.cumsum(new) - 1
    later = (doc != doc[new][group]) | (at != at[new][group])
    doc, at, piece = doc[later], at[later], piece[later]
    by = np.lexsort((at, doc))
    doc, at, piece = doc[by], at[by], piece[by]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)])) if len(doc) else []
    stop = np.concatenate([new[1:], [len(doc)]]).astype(int) if len(doc) else []
    return [(int(piece[a]), int(at[a]), int(at[b - 1] - at[a] + width)) for a, b in zip(new, stop)]


def _orderable(doc) -> tuple:
    """A document's key as a tuple that sorts as Spark sorts it, nulls first."""
    parts = doc.values() if isinstance(doc, dict) else [doc]
    return tuple((p is not None, p or 0) for p in parts)


def _pieces(open_parts: DataFrame, rows: DataFrame, width: int, hot_kinds: int) -> DataFrame:
    """(key, second, doc, at, piece): a fragment's bytes, or for hot anchors each window's hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(repeats.unpacked(batch.column(1))):
                parts = batch.column(2)[k].as_py()
                cool = [(p["anchor"], 0, p["at"], raw[p["at"] : p["at"] + p["units"]]) for p in parts if p["kinds"] <= hot_kinds]
                hot = [(p["at"], p["units"]) for p in parts if p["kinds"] > hot_kinds]
                if hot:
                    found = repeats.window_hashes(repeats.byte_units([raw]).values, hot, width)
                    cool += [(h1, h2, at, None) for h1, h2, at in zip(*(a.tolist() for a in found))]
                columns = [pa.array(c, t) for c, t in zip(zip(*cool), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))]
                doc = batch.column(0).take(pa.array(np.full(len(cool), k)))
                yield pa.RecordBatch.from_arrays([*columns[:2], doc, *columns[2:]], ["h1", "h2", "doc", "at", "piece"])

    schema = T.StructType().add("h1", "long").add("h2", "long").add("doc", rows.schema["doc"].dataType).add("at", "integer").add("piece", "binary")
    texts = repeats.packed(rows).join(open_parts, "doc").select("doc", "packed", "parts")
    return texts.mapInArrow(run, schema)


def _expand(pieces: DataFrame, width: int, batch_bytes: int) -> DataFrame:
    """(doc, at, units) of windows that occur earlier, task by task over pieces sorted by anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs: list[pa.Array] = []
        size, anchor = 0, None

        def result() -> pa.RecordBatch:
            found = repeated_windows(held, width)
            all_docs = pa.concat_arrays(docs)
            which, at, units = (list(c) for c in zip(*found)) if found else ([], [], [])
            return pa.RecordBatch.from_arrays([all_docs.take(pa.array(which, pa.int64())), pa.array(at, pa.int32()), pa.array(units, pa.int32())], ["doc", "at", "units"])

        for batch in batches:
            keys, doc_column = batch.column(0).to_pylist(), batch.column(1)
            names, ats, data = doc_column.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            taken = 0
            for k, key in enumerate(keys):
                if key != anchor and size >= batch_bytes:
                    docs.append(doc_column.slice(taken, k - taken))
                    yield result()
                    held, docs, size, taken = [], [], 0, k
                anchor = key
                held.append((_orderable(names[k]), ats[k], data[k]))
                size += len(data[k])
            docs.append(doc_column.slice(taken))
        if held:
            yield result()

    schema = T.StructType([pieces.schema["doc"]]).add("at", "integer").add("units", "integer")
    return pieces.select("h1", "doc", "at", "piece").repartition("h1").sortWithinPartitions("h1").mapInArrow(run, schema)


def repeated_spans(rows: DataFrame, width: int = WIDTH, seed: int = SEED, hot_kinds: int = HOT_KINDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc, at, units): stretches of bytes covered by strings that occur earlier."""
    whole, open_parts = repeats.repeated_fragments(rows, repeats.byte_units, width, seed)
    pieces = stored(_pieces(open_parts, rows, width, hot_kinds), "suffix-pieces")
    expanded = _expand(pieces.where("piece IS NOT NULL"), width, batch_bytes)
    hot = repeats.not_first(pieces.where("piece IS NULL").drop("piece")).withColumn("units", F.lit(width))
    return whole.unionByName(expanded).unionByName(hot)


def drop_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED, identity: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, the bytes kept and their digest."""
    rows = repeats.identified(docs, identity, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, raw in enumerate(repeats.unpacked(batch.column(1))):
                spans = repeats.spans_of(batch.column(2), k)
                kept, runs = raw, 0
                if spans:
                    gone = repeats.covered(len(raw), spans)
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out.append((len(raw), len(raw) - len(kept), runs, kept, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    whole = repeats.by_document(rows, repeated_spans(rows, width, seed, **limits)).select("doc_id", "packed", "spans")
    schema = T.StructType().add(rows.schema["doc_id"])
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary"), ("kept_sha256", "string")):
        schema.add(name, kind)
    return whole.mapInArrow(run, schema)


@query("op10_suffix_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeats(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
