"""Exact top-k by cosine similarity, optionally shifted by a per-item bias.

``score = w_sim * cosine + w_bias * bias + w_const``. The weights may differ per
query row, so steering bonuses and playlist stages rank inside the same scan.
Only ``k`` rows per query leave a block; ties go to the smaller item id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweft.operators.blocks import pair_blocks

# Scores are ranked after rounding, so the order of float additions on different
# partitionings cannot flip near-ties.
RANK_DIGITS = 6
# Most similarities held at once while scanning a block.
CHUNK_CELLS = 4_000_000
# Items that share a maximum when a block is looked through in single precision, and the share
# that may reach a row's floor, of maxima before all items are looked at, of items before all are scored.
MAXIMA_OF = 32
FEW_REACHED = 16


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal-length numeric lists as a 2-d float64 array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norms == 0.0, 1.0, norms)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that sort like the ids; text sorts by its bytes, as in Spark."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return pc.rank(flat, tiebreaker="dense").to_numpy().astype(np.int64)
    return column.to_numpy()


def best_per_row(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) pairs of each row's k largest scores, leftmost first on ties; rows may lie apart."""
    n = scores.shape[1]
    if n <= k:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
        return rows, cols
    floor = np.partition(scores, n - k, axis=1)[:, n - k]
    reached = scores >= floor[:, None]
    # Whole blocks may tie at the floor: its places are filled from the left, stretch by stretch.
    open_rows = np.flatnonzero(np.count_nonzero(reached, axis=1) > k)
    reached[open_rows] = scores[open_rows] > floor[open_rows, None]
    rows, cols = np.nonzero(reached)
    room = k - np.bincount(rows, minlength=len(scores))
    parts, start, width = [(rows, cols)], 0, 8 * k
    while len(open_rows) and start < n:
        at, cols = np.nonzero(scores[open_rows, start : start + width] == floor[open_rows, None])
        kept = np.arange(len(at)) - np.searchsorted(at, at) < room[open_rows[at]]
        rows = open_rows[at[kept]]
        parts.append((rows, cols[kept] + start))
        room -= np.bincount(rows, minlength=len(scores))
        open_rows, start, width = open_rows[room[open_rows] > 0], start + width, 4 * width
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _head_per_group(rows: np.ndarray, payload: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = place < k
    return rows[keep], payload[keep]


def keep_best(tables: list[pa.Table], k: int) -> pa.Table:
    """Merge partial answers down to k rows per query."""
    table = pa.concat_tables(tables)
    if table.num_rows == 0:
        return table
    codes = table["qid"].combine_chunks().dictionary_encode()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    rows = codes.indices.to_numpy()
    scores = np.round(table["score"].to_numpy(), RANK_DIGITS)
    order = np.lexsort((_ids(table["item_id"]), -scores, rows))
    _, picked = _head_per_group(rows[order], order, k)
    return table.take(pa.array(picked))


def prepared(items: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Items in the order of their ids, their unit vectors and their bias."""
    items = items.take(pa.array(np.argsort(_ids(items["item_id"]), kind="stable")))
    return items.select(["item_id"]), unit_rows(matrix(items["vec"])), items["bias"].to_numpy()


def score_block(queries: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """Top k of one item block for every query of one query block."""
    if not (queries.num_rows and items.num_rows):
        none = pa.array([], pa.float64())
        return pa.table(
            {
                "qid": queries["qid"].slice(0, 0),
                "item_id": items["item_id"].slice(0, 0),
                "similarity": none,
                "bias": none,
                "score": none,
            }
        )
    return score_prepared(queries, prepared(items), k)


def score_prepared(queries: pa.Table, block: tuple[pa.Table, np.ndarray, np.ndarray], k: int) -> pa.Table:
    items, catalog, bias = block
    wanted = unit_rows(matrix(queries["vec"]))
    w_sim, w_bias, w_const = (queries[c].to_numpy() for c in ("w_sim", "w_bias", "w_const"))
    parts = []
    step = max(1, CHUNK_CELLS // max(1, len(catalog)))
    rough = RoughScores(catalog, bias, k) if len(catalog) >= 2 * MAXIMA_OF * k else None
    for start in range(0, len(wanted), step):
        part = slice(start, start + step)
        asked = (wanted[part], w_sim[part], w_bias[part], w_const[part])
        found = []
        whole = np.arange(len(asked[0]))
        if rough is not None:
            rows, cols, whole = rough.reached(*asked)
            sims = np.einsum("ij,ij->i", asked[0][rows], catalog[cols])
            scores = asked[1][rows] * sims + asked[2][rows] * bias[cols] + asked[3][rows]
            order = np.lexsort((cols, -np.round(scores, RANK_DIGITS), rows))
            rows, best = _head_per_group(rows[order], order, k) if len(order) else (rows, order)
            found.append((rows, cols[best], sims[best], scores[best]))
        if len(whole):
            sims = asked[0][whole] @ catalog.T
            scores = asked[1][whole, None] * sims + asked[2][whole, None] * bias[None, :] + asked[3][whole, None]
            rows, cols = best_per_row(np.round(scores, RANK_DIGITS), k)
            found.append((whole[rows], cols, sims[rows, cols], scores[rows, cols]))
        for rows, cols, sims, scores in found:
            parts.append(
                pa.table(
                    {
                        "qid": queries["qid"].take(pa.array(rows + start)),
                        "item_id": items["item_id"].take(pa.array(cols)),
                        "similarity": sims,
                        "bias": bias[cols],
                        "score": scores,
                    }
                )
            )
    return pa.concat_tables(parts)


class RoughScores:
    """Which items of a block may be among a query's ``k`` best, from scores in single precision.

    The k-th largest of the maxima of disjoint groups of items is reached by k items, so no score
    further below it than rounding can explain is among the best. Few items are left to score.
    """

    def __init__(self, catalog: np.ndarray, bias: np.ndarray, k: int):
        self.k, self.n, self.groups = k, len(catalog), len(catalog) // MAXIMA_OF
        with np.errstate(over="ignore"):
            self.items = np.column_stack([catalog, bias, np.ones(len(catalog))]).astype(np.float32).T
        self.most_bias = np.abs(bias).max(initial=0.0)
        # Values that single precision cannot hold would come out as no number.
        self.fit = bool(np.isfinite(self.items).all() and np.isfinite(catalog).all())

    def reached(self, wanted: np.ndarray, w_sim: np.ndarray, w_bias: np.ndarray, w_const: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, columns) that may be best, and the rows for which too many may be."""
        none = np.zeros(0, np.int64)
        asked = np.column_stack([w_sim[:, None] * wanted, w_bias, w_const])
        with np.errstate(over="ignore"):
            small = asked.astype(np.float32)
        if not (self.fit and np.isfinite(small).all()):
            return none, none, np.arange(len(wanted))
        scores = small @ self.items
        grouped = scores[:, : self.groups * MAXIMA_OF].reshape(len(scores), MAXIMA_OF, self.groups)
        tops = grouped.max(axis=1)
        floor = np.partition(tops, self.groups - self.k, axis=1)[:, self.groups - self.k].astype(np.float64)
        size = np.abs(w_sim) + np.abs(w_bias) * self.most_bias + np.abs(w_const)
        error = size * asked.shape[1] * 2.0**-22 + 1e-30
        floor -= 2 * error + 2 * 10.0**-RANK_DIGITS
        # Down to the next single, so that the comparison itself does not round upward.
        floor = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None]
        groups = tops >= floor
        wide = np.flatnonzero(np.count_nonzero(groups, axis=1) * FEW_REACHED > self.groups)
        groups[wide] = False
        row, group = np.divmod(np.flatnonzero(groups), self.groups)
        hit, place = np.nonzero(grouped[row, :, group] >= floor[row])
        # Rows that reach it in many groups are looked at item by item, and beyond the last group all are.
        mask = scores[wide] >= floor[wide]
        many = np.count_nonzero(mask, axis=1) * FEW_REACHED > self.n
        mask[many] = False
        spread, at = np.nonzero(mask)
        beyond = scores[:, self.groups * MAXIMA_OF :] >= floor
        beyond[wide] = False
        rest, col = np.nonzero(beyond)
        rows = np.concatenate([row[hit], wide[spread], rest])
        cols = np.concatenate([place * self.groups + group[hit], at, col + self.groups * MAXIMA_OF])
        return rows, cols, wide[many]


def query_rows(queries: DataFrame, vec: str = "vec") -> DataFrame:
    """Queries in kernel form, with default weights where none are given."""
    defaults = {"w_sim": 1.0, "w_bias": 1.0, "w_const": 0.0}
    extra = [
        (F.col(c) if c in queries.columns else F.lit(v)).cast("double").alias(c)
        for c, v in defaults.items()
    ]
    return queries.select("qid", F.col(vec).cast("array<double>").alias("vec"), *extra)


def item_rows(catalog: DataFrame, vec: str = "vec", keep: tuple[str, ...] = ()) -> DataFrame:
    bias = F.col("bias") if "bias" in catalog.columns else F.lit(0.0)
    return catalog.select(
        "item_id",
        F.col(vec).cast("array<double>").alias("vec"),
        F.coalesce(bias.cast("double"), F.lit(0.0)).alias("bias"),
        *keep,
    )


def result_schema(queries: DataFrame, catalog: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    items = {f.name: f.dataType.simpleString() for f in catalog.schema.fields}
    return (
        f"qid {kinds['qid']}, item_id {items['item_id']}, "
        "similarity double, bias double, score double"
    )


def rank_window():
    return Window.partitionBy("qid").orderBy(F.round("score", RANK_DIGITS).desc(), "item_id")


def top_scored(queries: DataFrame, catalog: DataFrame, k: int, **block_options) -> DataFrame:
    """(qid, item_id, similarity, bias, score, rank) with rank <= k.

    ``queries`` needs ``qid, vec`` (and optional weights), ``catalog`` needs
    ``item_id, vec`` (and optional ``bias``).
    """
    q, c = query_rows(queries), item_rows(catalog)
    found = pair_blocks(
        q,
        c,
        kernel=lambda a, b: score_block(a, b, k),
        combine=lambda tables: keep_best(tables, k),
        schema=result_schema(q, c),
        left_key="qid",
        right_key="item_id",
        **{"chunk_cells": None, "answer_rows": k} | block_options,
    )
    return found.withColumn("rank", F.row_number().over(rank_window())).where(F.col("rank") <= k)
