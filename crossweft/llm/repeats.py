"""Shared ground of the two operators that remove repeated passages.

A text is a sequence of units (words or bytes). A *window* is ``width`` consecutive units.
In each window the ``seed`` units with the smallest hash are its anchor (the leftmost of
equals), so equal windows have equal anchors at equal places, and consecutive windows mostly
share one. The stretch of text covered by the windows of one anchor is a *fragment*; a text
has about ``2 / (width - seed + 2)`` fragments a unit. Only fragments whose anchor occurs
twice can hold repeated windows:

1. anchors are counted, and fragments of repeated anchors kept (a join Spark can split);
2. of equal fragments all but the first are repeats as a whole, whatever their number;
3. where one anchor has several different fragments, the first of each kind is compared
   window by window, by the method of the operator that calls.

A document is known by its id. Where ids are missing or not unique, the id together with a
hash of the text takes its place: rows equal in both are the same document and each gets
the row that one of them would get.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossweft.llm.tables import stored

#: Bytes of text that are hashed together, and bits of a place in them.
SLICE_BYTES = 1 << 20
_PLACE = 28
_MASK = np.uint64((1 << _PLACE) - 1)
_BASE, _WORD_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit numbers, by prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        size = 1 << max(10, int(len(values)).bit_length())
        up, self.down = _powers(base, size)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])

    def every(self, length: int) -> np.ndarray:
        """The hash of each stretch of one length."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:-length]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


@dataclass
class Units:
    """Units of several texts laid end to end: their hashes, and each text's share of them."""

    values: np.ndarray
    ends: np.ndarray


def byte_units(raws: list[bytes]) -> Units:
    return Units(_BYTE[np.frombuffer(b"".join(raws), np.uint8)], np.cumsum([0, *map(len, raws)]))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop; blanks are the six of the contract."""
    edge = np.diff(np.concatenate([[True], _BLANK[raw], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_units(raws: list[bytes]) -> Units:
    raw = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    start, stop = word_spans(raw)
    offsets = np.cumsum([0, *[len(r) + 1 for r in raws]])
    return Units(Rolling(_BYTE[raw], _WORD_BASE).of(start, stop), np.searchsorted(start, offsets))


def fragments(units: Units, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """(anchor, fragment hash, text number, first unit, units) of every anchor's fragment."""
    n = len(units.values)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none, none
    rolling = Rolling(units.values, _BASE)
    anchors = rolling.every(seed)
    span = width - seed + 1
    key = (anchors & ~_MASK) | np.arange(len(anchors), dtype=np.uint64)
    reach = 1
    while reach * 2 <= span:  # smallest of ever longer runs of places
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < span:
        key = np.minimum(key[: len(key) - (span - reach)], key[span - reach :])
    lengths = np.diff(units.ends)
    # Windows that start in the last width - 1 units of a text would leave it.
    inside = np.zeros(n + 1, np.int32)
    fits = lengths >= width
    inside[units.ends[:-1][fits]] += 1
    inside[units.ends[1:][fits] - width + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside[: len(key)]) > 0)
    if not len(starts):
        return none, none, none, none, none
    place = (key[starts] & _MASK).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    first, last = starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])]
    stop = last + width
    text = np.searchsorted(units.ends, first, side="right") - 1
    return anchors[place[new]].view(np.int64), rolling.of(first, stop).view(np.int64), text, first - units.ends[text], stop - first


def sliced(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in runs of rows of about ``SLICE_BYTES`` of text; null texts as empty."""
    raws = [(t or "").encode() for t in batch.column(column).to_pylist()]
    start, size = 0, 0
    for k, raw in enumerate(raws):
        size += len(raw)
        if size >= SLICE_BYTES or k + 1 == len(raws):
            yield batch.slice(start, k + 1 - start), raws[start : k + 1]
            start, size = k + 1, 0


def identified(docs: DataFrame, identity: str, text: str) -> DataFrame:
    """(doc, doc_id, text): ``doc`` is the id, or the id and a hash of the text if ids don't do."""
    rows = docs.select(F.col(identity).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    doubtful = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id IS NULL OR n > 1")
    doc = F.col("doc_id") if doubtful.isEmpty() else F.struct("doc_id", F.xxhash64("text").alias("tag"))
    return rows.select(doc.alias("doc"), "doc_id", "text")


def found_fragments(rows: DataFrame, cut: Callable[[list[bytes]], Units], width: int, seed: int) -> DataFrame:
    """(anchor, fragment, doc, at, units) of all fragments of all texts."""
    kind = rows.schema["doc"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raws in sliced(batch, 1):
                anchor, fragment, text, at, units = fragments(cut(raws), width, seed)
                columns = [pa.array(anchor), pa.array(fragment), part.column(0).take(pa.array(text)), pa.array(at.astype(np.int32)), pa.array(units.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "fragment", "doc", "at", "units"])

    schema = T.StructType().add("anchor", "long").add("fragment", "long").add("doc", kind).add("at", "integer").add("units", "integer")
    return rows.select("doc", "text").mapInArrow(run, schema)


def repeated_fragments(rows: DataFrame, cut: Callable[[list[bytes]], Units], width: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(whole, open): fragments that repeat an earlier one, and first ones to be compared.

    ``whole`` (doc, at, units) are repeats in every window. ``open`` (doc, parts) are the
    first fragments of their kind whose anchor has other kinds too, a list for each document.
    """
    found = found_fragments(rows, cut, width, seed)
    # Counts are stored before they are joined: Spark splits a hot key only between two shuffles.
    counts = found.select("anchor").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(counts.where("n > 1").select("anchor"), "repeat-anchors")
    kept = stored(found.join(repeated, "anchor", "left_semi"), "repeats")
    kinds = stored(
        kept.groupBy("anchor", "fragment").agg(F.min(F.struct("doc", "at", "units")).alias("first"), F.count(F.lit(1)).alias("n")), "repeat-kinds"
    )
    whole = (
        kept.join(kinds.where("n > 1").select("anchor", "fragment", "first"), ["anchor", "fragment"])
        .where((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
        .select("doc", "at", "units")
    )
    several = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "repeat-several")
    parts = kinds.join(several, "anchor").select("anchor", "kinds", "first.*")
    return whole, parts.groupBy("doc").agg(F.collect_list(F.struct("anchor", "kinds", "at", "units")).alias("parts"))


def window_hashes(units: np.ndarray, spans: list[tuple[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, start) of every window inside the spans: 128 bits that stand for its units."""
    starts = np.flatnonzero(covered(len(units), [(at, n - width + 1) for at, n in spans]))
    first, second = (Rolling(units, base).of(starts, starts + width).view(np.int64) for base in (_BASE, _SECOND))
    return first, second, starts


def not_first(windows: DataFrame) -> DataFrame:
    """(doc, at) of the windows (h1, h2, doc, at) that occur earlier too."""
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    return windows.join(stored(first.where("n > 1"), "repeat-firsts"), ["h1", "h2"]).where(F.struct("doc", "at") != F.col("first")).select("doc", "at")


def packed(rows: DataFrame) -> DataFrame:
    """(doc, doc_id, packed): texts travel compressed where they must be shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [press.compress(t.encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["doc", "doc_id", "packed"])

    schema = T.StructType().add(rows.schema["doc"]).add(rows.schema["doc_id"]).add("packed", "binary")
    return rows.mapInArrow(run, schema)


def unpacked(column: pa.Array) -> Iterator[bytes]:
    press = zstandard.ZstdDecompressor()
    return (press.decompress(data) for data in column.to_pylist())


def covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of ``n`` units lie in one of the spans (first unit, units)."""
    change = np.zeros(n + 1, np.int32)
    if spans:
        at, units = np.array(spans, np.int64).T
        np.add.at(change, at, 1)
        np.add.at(change, at + units, -1)
    return np.cumsum(change[:-1]) > 0


def spans_of(column: pa.Array, k: int) -> list[tuple[int, int]]:
    held = column[k].as_py()
    return [(s["at"], s["units"]) for s in held] if held else []


def by_document(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """(doc, doc_id, packed, spans): each text with the list of its repeats, or null."""
    spans = repeats.groupBy("doc").agg(F.collect_list(F.struct("at", "units")).alias("spans"))
    return packed(rows).join(spans, "doc", "left")
