"""All-pairs work without a cross join.

Some results need every (left, right) pair looked at: exact retrieval, relevance
counts, title matching. No pair row is ever produced. Rows travel once as Arrow
blocks, a kernel looks at a whole block pair at a time and returns only its
(small, mergeable) answer.

* left side proven small: it is broadcast and the right side is scanned in place, with no
  shuffle at all unless it lies in fewer partitions than its pairs are worth;
* otherwise both sides are hashed on their key into the rows and columns of a grid. A
  cell holds at most about ``CELL_ROWS`` rows and ``BLOCK_BYTES`` of each side whatever the
  data looks like, so no value can make one task hot. A row travels once for each cell that
  it belongs to, so cells are as large as a task can work off: it holds the right side of a
  cell, and the left side and the answers stream by in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossweft.session import durable

# Most rows and bytes of a side that may be sent to every executor.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 64 << 20
# Most rows per side that a kernel is given at once; this many 64-wide vectors are 16 MB.
BLOCK_ROWS = 32_768
# Most rows and bytes per side in one grid cell, however small the blocks. Every row travels
# once per cell across the other side, so what is shuffled depends on these alone.
CELL_ROWS = 65_536
BLOCK_BYTES = 64 << 20
# Blocks in a cell of more than one are not cut smaller: a call of the kernel has a cost of its own.
LEAST_BLOCK = 4_096
# Most rows of answers that a task builds at a time.
ANSWER_ROWS = 1 << 20
# Pairs that are worth a task of their own when a table is scanned.
TASK_PAIRS = 4_000_000
# Most pairs of a block pair that a kernel looks at in one go.
CHUNK_CELLS = 4_000_000

Kernel = Callable[[pa.Table, pa.Table], pa.Table]


def _width(field: T.StructField) -> Column:
    """Rough bytes of one value."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.octet_length(col)
    if isinstance(field.dataType, T.ArrayType):
        if isinstance(field.dataType.elementType, T.StringType):
            return F.octet_length(F.concat_ws("    ", col))
        return F.size(col) * 8
    return F.lit(8)


def extent(df: DataFrame) -> tuple[int, int]:
    """Rows and rough bytes of a frame, summed on the executors."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        total = total + F.coalesce(_width(field), F.lit(1))
    rows, volume = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return rows, volume


def bounded_arrow(df: DataFrame, max_rows: int, max_bytes: int) -> pa.Table | None:
    """The whole frame as Arrow, or None if it is larger: counted before a row is moved."""
    rows, volume = extent(df)
    return df.toArrow() if rows <= max_rows and volume <= max_bytes else None


def sent_if_small(df: DataFrame, n_rows: int | None) -> DataFrame:
    """``df``, stored and marked for broadcast if it is known to have few rows and its bytes fit."""
    if n_rows is None or n_rows > 10 * BROADCAST_ROWS:
        return df
    df = durable(df)
    return F.broadcast(df) if extent(df)[1] <= BROADCAST_BYTES else df


def in_pieces(kernel: Kernel, combine: Callable[[list[pa.Table]], pa.Table], cells: int) -> Kernel:
    """The kernel over slices of the left block, so that at most ``cells`` pairs are held at once."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        step = max(1, cells // max(1, b.num_rows))
        found = [kernel(a.slice(0, step), b)]
        for start in range(step, a.num_rows, step):
            found.append(kernel(a.slice(start, step), b))
            if len(found) >= 16:
                found = [combine(found)]
        return found[0] if len(found) == 1 else combine(found)

    return run


def in_blocks(kernel: Kernel, combine: Callable[[list[pa.Table]], pa.Table], rows: int) -> Kernel:
    """The kernel over blocks of at most ``rows`` rows of the right side."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        parts: list[pa.Table] = []
        for start in range(0, max(1, b.num_rows), rows):
            parts.append(kernel(a, b.slice(start, rows)))
            if len(parts) >= 4:
                parts = [combine(parts)]
        return combine(parts)

    return run


def dealt_in_cells(
    left: DataFrame, right: DataFrame, at: list[str], task: Column | None = None, tasks: int = 0, left_order: str | None = None
) -> DataFrame:
    """Rows of both sides by their cell ``at``; inside a cell those of the right come first.

    Cells go to the task numbered ``task``, so that all have as many, or are hashed.
    """
    l, r = (F.struct(*[c for c in side.columns if c not in at]) for side in (left, right))
    asked = left.select(*at, F.lit(1).alias("__side"), l.alias("__left"), *([F.col(left_order).alias("__order")] if left_order else []))
    held = right.select(*at, F.lit(0).alias("__side"), r.alias("__right"))
    both = held.unionByName(asked, allowMissingColumns=True)
    both = both.repartition(*at) if task is None else both.repartitionById(tasks, task)
    return both.sortWithinPartitions(*at, "__side", *(["__order"] if left_order else []))


def met_in_cells(batches: Iterator[pa.RecordBatch], at: list[str], rows: int) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(left rows, right rows): the whole right side of a cell beside at most ``rows`` of its left.

    The right side of one cell and one piece of its left are held, never a whole cell. As long
    as the cell is the same, so is the object of its right side.
    """

    def table_(parts: list[pa.StructArray]) -> pa.Table:
        names = [f.name for f in parts[0].type]
        return pa.concat_tables([pa.Table.from_arrays(p.flatten(), names=names) for p in parts]).combine_chunks()

    cell, held, right, waiting, n = None, [], None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch[c].to_numpy(zero_copy_only=False) for c in (*at, "__side")]
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            ident = tuple(k[start] for k in keys[:-1])
            if ident != cell:
                if waiting:
                    yield table_(waiting), right
                cell, held, right, waiting, n = ident, [], None, [], 0
            if keys[-1][start] == 0:
                held.append(batch["__right"].slice(start, stop - start))
                continue
            if right is None:
                if not held:
                    continue
                right, held = table_(held), []
            while start < stop:
                part = batch["__left"].slice(start, min(stop - start, rows - n))
                waiting.append(part)
                start, n = start + len(part), n + len(part)
                if n >= rows:
                    yield table_(waiting), right
                    waiting, n = [], 0
    if waiting:
        yield table_(waiting), right


def dealt_for(right: DataFrame, left_rows: int) -> DataFrame:
    """``right`` on all cores if its partitions are few for the pairs that they make.

    A small table has a partition or two, however many rows of the other side meet it.
    """
    counts = right.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    rows, most = counts[0] or 0, counts[1] or 0
    tasks = min(4 * right.sparkSession.sparkContext.defaultParallelism, math.ceil(rows * left_rows / TASK_PAIRS))
    return right.repartition(tasks) if most * tasks > 2 * rows else right


def grid_shape(
    left_rows: int, right_rows: int, block_rows: int, cores: int, left_bytes: int = 0, right_bytes: int = 0, answer_rows: int = 0
) -> tuple[int, int]:
    """Cells per side: at most ``CELL_ROWS`` rows and ``BLOCK_BYTES`` each, and cells for every core.

    Only to give every core its cells are they made smaller, down to ``block_rows`` or 512 rows, on
    the side that then has less to send: its rows once a cell, answers once a cell of the right.
    """
    n_left = max(1, math.ceil(left_rows / CELL_ROWS), math.ceil(left_bytes / BLOCK_BYTES))
    n_right = max(1, math.ceil(right_rows / CELL_ROWS), math.ceil(right_bytes / BLOCK_BYTES))
    least = min(512, block_rows)
    sent_left = max(left_bytes, left_rows) + 40 * answer_rows * left_rows
    sent_right = max(right_bytes, right_rows)
    while n_left * n_right < 2 * cores and max(left_rows / n_left, right_rows / n_right) > least:
        if right_rows / n_right <= least or (left_rows / n_left > least and n_left * sent_right <= n_right * sent_left):
            n_left += 1
        else:
            n_right += 1
    return n_left, n_right


def pair_blocks(
    left: DataFrame,
    right: DataFrame,
    kernel: Kernel,
    combine: Callable[[list[pa.Table]], pa.Table],
    schema: str,
    left_key: str,
    right_key: str,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
    chunk_cells: int | None = CHUNK_CELLS,
    answer_rows: int = 1,
) -> DataFrame:
    """Run ``kernel`` over every pair of a left and a right block.

    ``block_rows`` bounds what the kernel is given, not what a cell of the grid holds.
    ``answer_rows`` is the most rows that the kernel returns for a row of the left side.
    ``kernel`` must return rows that ``combine`` can merge in any grouping; the
    caller finishes the merge with an ordinary aggregate or window. ``chunk_cells`` None is
    for kernels that bound what they hold by themselves.
    """
    if chunk_cells:
        kernel = in_pieces(kernel, combine, chunk_cells)
    small = bounded_arrow(left, min(broadcast_rows, ANSWER_ROWS // answer_rows), broadcast_bytes)
    if small is not None:
        if small.num_rows == 0:
            return left.sparkSession.createDataFrame([], schema)
        shared = left.sparkSession.sparkContext.broadcast(small)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[pa.Table] = []
            for batch in batches:
                if batch.num_rows:
                    found.append(kernel(shared.value, pa.Table.from_batches([batch])))
                if len(found) >= 8 or sum(t.num_rows for t in found) > 2 * ANSWER_ROWS:
                    found = [combine(found)]
            if found:
                yield from combine(found).combine_chunks().to_batches()

        return dealt_for(right, small.num_rows).mapInArrow(scan, schema)

    cores = left.sparkSession.sparkContext.defaultParallelism
    left, right = durable(left), durable(right)  # sized and then dealt: two passes each
    (left_rows, left_bytes), (right_rows, right_bytes) = extent(left), extent(right)
    n_left, n_right = grid_shape(left_rows, right_rows, block_rows, cores, left_bytes, right_bytes, answer_rows)
    tasks = min(n_left * n_right, 64 * cores)
    left_cells = left.withColumn(
        "__lb", F.pmod(F.xxhash64(left_key), F.lit(n_left)).cast("int")
    ).withColumn("__rb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right_cells = right.withColumn(
        "__rb", F.pmod(F.xxhash64(right_key), F.lit(n_right)).cast("int")
    ).withColumn("__lb", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    at, block = ["__lb", "__rb"], max(block_rows, LEAST_BLOCK)
    in_cell, piece = in_blocks(kernel, combine, block), max(1, min(block, ANSWER_ROWS // answer_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, held in met_in_cells(batches, at, piece):
            yield from in_cell(asked, held).combine_chunks().to_batches()

    task = (F.col("__lb") * n_right + F.col("__rb")) % tasks
    return dealt_in_cells(left_cells, right_cells, at, task, tasks).mapInArrow(run, schema)
