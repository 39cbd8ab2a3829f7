"""Hard-negative mining with an STR-packed R-tree.

Vectors become whole numbers, scores are their inner products. Rows are packed by sort-tile-
recursive tiling: quantiles of the widest coordinate cut all rows into slabs, quantiles of the
next cut each slab, and so on, until a tile has about a page of rows; tiles too full, of equal
vectors, are dealt to several pages by id. Only quantiles, never rows, come together. Pages lie
in the order of their tiles, so a run of them is a subtree, and every page and subtree has a
minimum bounding box.

A box bounds each product q_i x_i by q_i lo_i and q_i hi_i, and so the score of any row in it
from both sides. Each task searches its subtrees for a block of anchors: a best-first queue
gives the box with the largest upper bound; it is left out for the anchors whose score window
it misses, and for those whose k-th result so far is strictly above its bound (a row at the
bound could still win the tie by its smaller id). Rows of the pages that remain are scored as
a matrix product. Tasks return their k best rows for each question, and a window ranks these.
No row is sampled, and the result does not depend on how the tree is packed.

First come the positives, the best rows of an anchor's own label; each then gives a score
window for rows of other labels. Anchors are sent to every executor if their rows and bytes are
counted to be few, and dealt in blocks against parts of the tree if not.

Defined cases: rows with a null id, label or vector or any null or non-finite component take
no part. Shorter vectors count as filled with zeros. Of repeated ids each row is a row of its own, but an
anchor's own id is never its positive; repeated anchors are asked once for each distinct row.
Scores that would not fit 53 bits are an error, never rounded. An empty table gives an
empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweft.llm.registry import query
from crossweft.llm.tables import give_back, shared_path, stored, table
from crossweft.operators.blocks import bounded_arrow

#: Rows of a page, and of the part of the tree that one task searches.
PAGE_ROWS = 256
PART_ROWS = 1 << 16
#: Slabs that a coordinate is cut into, at most.
SLABS = 8
#: Most anchors, and their bytes, that are sent to every executor; beyond, anchors of a block.
FEW_ANCHORS, FEW_BYTES = 20_000, 64 << 20
BLOCK = 2048
#: Scores at most that a task holds at once.
CELLS = 1 << 20
#: Results that wait to be ranked, at least.
OFFERS = 1 << 14
EXACT = 1 << 53


@dataclass(frozen=True)
class Mining:
    """Anchors: ids divisible by ``every``. Windows: ``low`` to ``high`` percent of the positive's score."""

    every: int = 100
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    page_rows: int = PAGE_ROWS
    part_rows: int = PART_ROWS


def whole_vectors(rows: DataFrame, identity: Column, label: Column, vector: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): components floor(scale * x), of rows whose components are all finite."""
    made = rows.select(identity.cast("long").alias("vec_id"), label.alias("label"), vector.cast("array<double>").alias("x"))
    good = made.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    return good.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * float(scale)).cast("double")).alias("v"))


def packed(vectors: DataFrame, mining: Mining) -> DataFrame:
    """The vectors with ``tile``, their place in the order of the tree, and ``page`` within the tile."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("norm")).first()
    n, dim = size["n"], size["dim"] or 0
    if n and (size["norm"] or 0) >= EXACT:  # |q.x| <= |q||x|, and so are all partial sums
        raise ValueError("Scores would not fit 53 bits: scale the vectors down.")
    padded = vectors.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size("v"), F.lit(0)))))
    rows = stored(padded.withColumn("tile", F.array().cast("array<int>")), "tree-rows")
    pages = max(1, math.ceil(n / mining.page_rows))
    levels = min(dim, math.ceil(math.log(pages, SLABS))) if pages > 1 else 0
    if levels:
        spread = rows.agg(*[F.stddev_pop(F.col("v")[k]).alias(str(k)) for k in range(dim)]).first()
        widest = sorted(range(dim), key=lambda k: (-(spread[k] or 0), k))[:levels]
        slabs = max(2, math.ceil(pages ** (1 / levels)))
        shares = F.array(*[F.lit(k / slabs) for k in range(1, slabs)])
        for k in widest:
            cuts = stored(rows.groupBy("tile").agg(F.percentile_approx(F.col("v")[k], shares).alias("cuts")), "tree-cuts")
            slab = F.size(F.filter("cuts", lambda c: c < F.col("v")[k]))
            rows = rows.join(cuts, "tile").select("vec_id", "label", "v", F.concat("tile", F.array(slab)).alias("tile"))
    rows = stored(rows, "tree-tiled")
    filled = stored(rows.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / (2 * mining.page_rows)).alias("pages")), "tree-tiles")
    page = F.pmod(F.xxhash64("vec_id"), F.col("pages")).cast("int")
    return rows.join(filled, "tile").select("vec_id", "label", "v", "tile", page.alias("page"))


def tree(vectors: DataFrame, mining: Mining) -> tuple[DataFrame, int]:
    """The packed rows stored in the order of the tree, and the number of parts they lie in."""
    rows = packed(vectors, mining)
    spark = vectors.sparkSession
    n = rows.count()
    parts = max(1, min(math.ceil(n / mining.page_rows), max(spark.sparkContext.defaultParallelism, math.ceil(n / mining.part_rows))))
    path = shared_path(spark, "tree")
    ranged = rows.repartitionByRange(parts, "tile", "page").sortWithinPartitions("tile", "page").withColumn("part", F.spark_partition_id())
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path), parts


class Best:
    """The k best (score, then smaller id) rows of each question, from whatever was offered."""

    def __init__(self, questions: int, k: int):
        self.k, self.kth = k, np.full(questions, -np.inf)
        self.held = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.offered: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def offer(self, question: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.offered.append((question, score, ids))
        self.waiting += len(ids)
        if self.waiting > max(OFFERS, len(self.held[0])):  # so that sorting stays in proportion
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        question, score, ids = (np.concatenate(x) for x in zip(self.held, *self.offered))
        order = np.lexsort((ids, -score, question))
        question, score, ids = question[order], score[order], ids[order]
        place = np.arange(len(question)) - np.searchsorted(question, question)
        last = place == self.k - 1
        self.kth[question[last]] = score[last]
        keep = place < self.k
        self.held, self.offered, self.waiting = (question[keep], score[keep], ids[keep]), [], 0
        return self.held


@dataclass
class Questions:
    """Anchors of a block, and for each of them some score windows: (anchor, low, high)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same_label: bool


def search(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], asked: Questions, best: Best, count: Callable[[int], None] = lambda n: None) -> None:
    """Offer the rows of the pages (ids, labels, vectors) that can be among the best; ``count``: scored cells."""
    if not pages or not len(asked.anchor):
        return
    low, high = (np.stack([getattr(v, end)(axis=0) for _, _, v in pages]) for end in ("min", "max"))
    up, down = np.maximum(asked.vectors, 0.0), np.minimum(asked.vectors, 0.0)
    most = (up @ high.T + down @ low.T)[asked.anchor]  # of each question in each page
    least = (up @ low.T + down @ high.T)[asked.anchor]
    reaches = (most >= asked.low[:, None]) & (least <= asked.high[:, None])
    alive = np.where(reaches, most, -np.inf)
    queue = [(-bound, k) for k, bound in enumerate(alive.max(axis=0)) if bound > -np.inf]
    heapq.heapify(queue)
    while queue:
        bound, k = heapq.heappop(queue)
        open_ = np.flatnonzero(reaches[:, k] & (most[:, k] >= best.kth))
        if not len(open_):
            continue
        now = -most[open_, k].max()
        if queue and now > queue[0][0]:  # its bound fell as results came in: others come first
            heapq.heappush(queue, (now, k))
            continue
        ids, labels, vectors = pages[k]
        step = max(1, CELLS // len(ids))
        for at in range(0, len(open_), step):
            some = open_[at : at + step]
            anchors, back = np.unique(asked.anchor[some], return_inverse=True)
            scores = (asked.vectors[anchors] @ vectors.T)[back]
            count(scores.size)
            floor = np.maximum(asked.low[some], best.kth[some])
            fits = (scores >= floor[:, None]) & (scores <= asked.high[some][:, None])
            equal = asked.labels[asked.anchor[some]][:, None] == labels[None, :]
            fits &= equal & (asked.ids[asked.anchor[some]][:, None] != ids[None, :]) if asked.same_label else ~equal
            row, col = np.nonzero(fits)
            if len(row):
                best.offer(some[row], scores[row, col], ids[col])


def _pages(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The batch, rows in the order of the tree, as runs of one page."""
    if not batch.num_rows:
        return []
    vectors = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
    ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    tiles = batch.column("tile").flatten().to_numpy().reshape(batch.num_rows, -1)
    page = batch.column("page").to_numpy()
    new = (page[1:] != page[:-1]) | (tiles[1:] != tiles[:-1]).any(axis=1)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    return [(ids[a:b], labels[a:b], vectors[a:b]) for a, b in zip(edges, edges[1:])]


def _asked(anchors: pa.Table, windows: bool) -> Questions:
    vectors = pa.concat_arrays(anchors["v"].chunks).flatten().to_numpy().reshape(anchors.num_rows, -1) if anchors.num_rows else np.zeros((0, 0))
    ids, labels = anchors["anchor_id"].to_numpy(), anchors["label"].to_numpy()
    if not windows:
        n = len(ids)
        return Questions(ids, labels, vectors, np.arange(n), np.full(n, -np.inf), np.full(n, np.inf), True)
    lists = pa.concat_arrays(anchors["windows"].chunks) if anchors.num_rows else pa.array([], pa.list_(pa.struct([("low", pa.float64()), ("high", pa.float64())])))
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy())) if len(ids) else np.zeros(0, np.int64)
    return Questions(ids, labels, vectors, owner, flat.field("low").to_numpy(), flat.field("high").to_numpy(), False)


def best_rows(anchors: DataFrame, rows: DataFrame, parts: int, k: int, windows: bool, few: int = FEW_ANCHORS) -> DataFrame:
    """(anchor_id, label, low, high, vec_id, score): for each question at least its k best rows of the tree.

    ``anchors`` (anchor_id, label, v[, windows]). The rows come from all parts, k from each at most.
    """
    names = ["anchor_id", "label", "low", "high", "vec_id", "score"]
    schema = f"anchor_id long, label {rows.schema['label'].dataType.simpleString()}, low double, high double, vec_id long, score long"

    def answers(asked: Questions, best: Best) -> pa.RecordBatch:
        question, score, ids = best.settle()
        anchor = asked.anchor[question]
        columns = [asked.ids[anchor], asked.labels[anchor], asked.low[question], asked.high[question], ids, score.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    small = bounded_arrow(anchors, few, FEW_BYTES)
    if small is not None:
        shared = rows.sparkSession.sparkContext.broadcast(small)

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [_asked(shared.value.slice(at, BLOCK), windows) for at in range(0, shared.value.num_rows, BLOCK)]
            bests = [Best(len(b.anchor), k) for b in blocks]
            for batch in batches:
                pages = _pages(batch)
                for asked, best in zip(blocks, bests):
                    search(pages, asked, best)
            for asked, best in zip(blocks, bests):
                yield answers(asked, best)
            give_back()

        return rows.mapInArrow(scan, schema)

    blocks = max(1, math.ceil(anchors.count() / BLOCK))
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def cell(asked: pa.Table, held: pa.Table) -> pa.Table:
        questions = _asked(asked, windows)
        best = Best(len(questions.anchor), k)
        ordered = held.sort_by([("tile_key", "ascending"), ("page", "ascending")])
        for batch in ordered.combine_chunks().to_batches():
            search(_pages(batch), questions, best)
        return pa.Table.from_batches([answers(questions, best)])

    met = met.withColumn("tile_key", F.concat_ws(".", F.transform("tile", lambda t: F.format_string("%05d", t))))
    return dealt.groupBy("block", "part").cogroup(met.groupBy("block", "part")).applyInArrow(cell, schema)


def mine(vectors: DataFrame, mining: Mining = Mining(), few: int = FEW_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of whole vectors (vec_id, label, v)."""
    rows, parts = tree(vectors, mining)
    anchors = stored(rows.where(F.pmod("vec_id", F.lit(mining.every)) == 0).select(F.col("vec_id").alias("anchor_id"), "label", "v").distinct(), "tree-anchors")
    # An anchor is its id, label and vector: the answer is joined back by all it was asked with.
    who = ["anchor_id", "label"]
    near = best_rows(anchors, rows, parts, mining.positives, False, few)
    order = Window.partitionBy(*who).orderBy(F.col("score").desc(), "vec_id")
    positives = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= mining.positives)
    # Scores are whole, so are the edges of a window.
    low, high = F.ceil(F.expr(f"{mining.low} * score / 100D")), F.floor(F.expr(f"{mining.high} * score / 100D"))
    positives = stored(positives.select(*who, F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), low.cast("double").alias("low"), high.cast("double").alias("high")), "tree-positives")
    windows = positives.where("low <= high").groupBy(*who).agg(F.collect_set(F.struct("low", "high")).alias("windows"))
    asked = stored(anchors.join(windows, who), "tree-questions")
    far = best_rows(asked, rows, parts, mining.negatives, True, few)
    order = Window.partitionBy(*who, "low", "high").orderBy(F.col("score").desc(), "vec_id")
    negatives = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mining.negatives)
    negatives = negatives.select(*who, "low", "high", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, [*who, "low", "high"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
    WITH e AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10"""


@query("op12_hard_negatives", SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(whole_vectors(rows, F.col("vec_id"), moved, F.col("embedding")))
