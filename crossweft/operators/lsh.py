"""Random-hyperplane hashing: keys, multi-probe candidate join, retrieval policy.

A probe is an equi-join on an integer key. Ring counts come from the small bucket
table, so how far each query must look, and whether it must fall back to the whole
catalog, is known before any item row is touched. Items and probes then meet in
(key, split) cells; a bucket or a probe key with many rows is split on both sides,
and each cell answers with top lists, never with pair rows. A task holds the items of a cell;
its queries and their lists stream by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweft.operators.blocks import ANSWER_ROWS, BLOCK_ROWS, dealt_in_cells, met_in_cells
from crossweft.operators.similarity import (
    item_rows,
    keep_best,
    matrix,
    prepared,
    query_rows,
    rank_window,
    result_schema,
    score_prepared,
    top_scored,
    unit_rows,
)
from crossweft.session import durable

MAX_BITS = 63
POOL_COLUMNS = ("qid", "item_id", "similarity", "bias", "score", "method", "pool_size")
# Bucket plans are five numbers a row; this many are about 40 MB.
BROADCAST_KEYS = 1_000_000
# Most probe keys spelled out per query before the pigeonhole join takes over.
MAX_MASKS = 4_096
# Rows (piece, part) of buckets that are sent to the asked keys; this many are about 130 MB.
BROADCAST_PARTS = 2_000_000
# Probe keys and compared pairs that are worth a task of their own.
TASK_PROBES = 4_000_000


def fitting_bits(n_items: int, per_bucket: int = 32, least: int = 4, most: int = 24) -> int:
    """Key bits with which a bucket holds about ``per_bucket`` items, if they spread evenly."""
    return min(most, max(least, (n_items // per_bucket).bit_length()))


def hyperplanes(n_bits: int, dim: int, seed: int = 42) -> np.ndarray:
    """Seeded Gaussian planes, one row per bit."""
    if not 1 <= n_bits <= MAX_BITS:
        raise ValueError(f"n_bits must be between 1 and {MAX_BITS}, got {n_bits}.")
    draws = np.random.default_rng(seed).standard_normal((n_bits, dim))
    return draws.astype(np.float32).astype(np.float64)


def lsh_key(vec: Column, planes: np.ndarray) -> Column:
    """Bit i is set when unit(vec) . plane_i >= 0; bit 0 is the lowest."""
    weights = np.left_shift(np.int64(1), np.arange(len(planes), dtype=np.int64))

    @F.arrow_udf("bigint")
    def key(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.int64())
        bits = (unit_rows(matrix(vectors)) @ planes.T) >= 0.0
        return pa.array(bits.astype(np.int64) @ weights, pa.int64())

    return key(vec)


def bucket_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("key").agg(F.count(F.lit(1)).alias("cnt"))


def probe_masks(n_bits: int, radius: int) -> list[tuple[int, int]]:
    """(mask, distance) of every key change within ``radius`` bits."""
    return [
        (sum(1 << b for b in bits), d)
        for d in range(radius + 1)
        for bits in combinations(range(n_bits), d)
    ]


def mask_count(n_bits: int, radius: int) -> int:
    return sum(math.comb(n_bits, d) for d in range(min(radius, n_bits) + 1))


def near_buckets(keys: DataFrame, buckets: DataFrame, n_bits: int, radius: int, n_buckets: int | None = None) -> DataFrame:
    """(qkey, key, dist, cnt): the existing buckets within ``radius`` of each distinct ``qkey``.

    Buckets of a known small number go to the keys, which then meet them where they lie.
    """
    radius = min(radius, n_bits)
    if mask_count(n_bits, radius) > MAX_MASKS:
        return _verified(piece_candidates(keys, buckets, n_bits, radius, n_buckets), radius)
    if n_buckets is not None and n_buckets <= BROADCAST_PARTS:
        buckets = F.broadcast(buckets)
    masks = _masks(probe_masks(n_bits, radius), ("mask", "dist"))
    probes = keys.select("qkey", F.explode(masks).alias("m")).select(
        "qkey", F.col("qkey").bitwiseXOR(F.col("m.mask")).alias("key"), "m.dist"
    )
    return probes.join(buckets, "key").select("qkey", "key", "dist", "cnt")


def _masks(rows: list[tuple[int, int]], names: tuple[str, str]) -> Column:
    return F.expr("array(" + ", ".join(f"struct({a}L as {names[0]}, {b} as {names[1]})" for a, b in rows) + ")")


def key_pieces(n_bits: int, radius: int) -> tuple[list[tuple[int, int]], int]:
    """((shift, bits) of each key piece, radius of a piece).

    Two keys within ``radius`` bits are within ``radius // pieces`` bits in some piece. The fewest
    pieces whose probe keys can be spelled out are taken: long pieces have short lists.
    """
    for n in range(2, n_bits + 1):
        cuts = [i * n_bits // n for i in range(n + 1)]
        pieces = [(low, high - low) for low, high in zip(cuts, cuts[1:])]
        if sum(mask_count(bits, radius // n) for _, bits in pieces) <= MAX_MASKS:
            break
    return pieces, radius // n


def piece_candidates(keys: DataFrame, buckets: DataFrame, n_bits: int, radius: int, n_buckets: int | None = None) -> DataFrame:
    """(qkey, key, cnt): buckets that agree with a key in one of its pieces, each pair once.

    An equi-join on (piece, its bits), near ones spelled out on the side of the asked keys. A pair
    that meets in several pieces is kept at the first, so no distinct is needed.
    """
    pieces, near = key_pieces(n_bits, radius)
    flips = [(i, mask << shift) for i, (shift, bits) in enumerate(pieces) for mask, _ in probe_masks(bits, near)]
    own = F.expr("CASE piece " + " ".join(f"WHEN {i} THEN {((1 << bits) - 1) << shift}L" for i, (shift, bits) in enumerate(pieces)) + " END")
    asked = (
        keys.select("qkey", F.explode(_masks([(m, i) for i, m in flips], ("flip", "piece"))).alias("m"))
        .select("qkey", "m.piece", "m.flip")
        .select("qkey", "piece", F.col("qkey").bitwiseXOR(F.col("flip")).bitwiseAND(own).alias("part"))
    )
    held = buckets.select("key", "cnt", F.explode(F.array(*[F.lit(i) for i in range(len(pieces))])).alias("piece"))
    held = held.withColumn("part", F.col("key").bitwiseAND(own))
    if n_buckets is not None and n_buckets * len(pieces) <= BROADCAST_PARTS:
        held = F.broadcast(held)
    first = F.lit(True)
    for i, (shift, bits) in enumerate(pieces):
        apart = F.bit_count(F.col("qkey").bitwiseXOR(F.col("key")).bitwiseAND(F.lit(((1 << bits) - 1) << shift))) > near
        first = first & ((F.col("piece") <= i) | apart)
    return asked.join(held, ["piece", "part"]).where(first).select("qkey", "key", "cnt")


def _verified(pairs: DataFrame, radius: int) -> DataFrame:
    dist = F.bit_count(F.col("qkey").bitwiseXOR(F.col("key")))
    return pairs.withColumn("dist", dist).where(F.col("dist") <= radius).select("qkey", "key", "dist", "cnt")


def probe_rings(keys: DataFrame, buckets: DataFrame, n_bits: int, radius: int, search_k: int) -> DataFrame:
    """``ring_cutoff`` of ``near_buckets`` by key; wide radii are reached ring by ring.

    Rings whose probe keys can be spelled out come first, from the one that holds ``search_k``
    items if they spread evenly. Only keys that found fewer are asked again, one ring further
    and, by key pieces, two. Keys are few bytes and many probes, so they are dealt to the cores.
    """
    radius = min(radius, n_bits)
    if mask_count(n_bits, radius) <= MAX_MASKS:
        return ring_cutoff(near_buckets(keys, buckets, n_bits, radius), search_k, by="qkey")
    spelled = [r for r in range(radius) if mask_count(n_bits, r) <= MAX_MASKS]
    buckets = durable(buckets)
    n_buckets, n_items = buckets.agg(F.count(F.lit(1)), F.coalesce(F.sum("cnt"), F.lit(0))).first()
    reach = max([r for r in spelled if n_items * mask_count(n_bits, r) <= search_k << n_bits], default=0)
    short, found = durable(keys), None
    while True:
        asked = short.repartition(probe_tasks(short, n_buckets, n_bits, reach), "qkey")
        near = durable(ring_cutoff(near_buckets(asked, buckets, n_bits, reach, n_buckets), search_k, by="qkey"))
        done = near if reach >= radius else near.where(F.col("pool_size") >= search_k)
        found = done if found is None else found.unionByName(done)
        if reach >= radius:
            return found
        short = durable(short.join(done.select("qkey").distinct(), "qkey", "left_anti"))
        if short.isEmpty():
            return found
        reach = reach + 1 if reach < spelled[-1] else min(radius, reach + 2)


def probe_tasks(keys: DataFrame, n_buckets: int, n_bits: int, radius: int) -> int:
    """Tasks for the keys, from their probe keys and the pairs that these make if buckets spread evenly."""
    work = mask_count(n_bits, radius)
    if work > MAX_MASKS:
        pieces, near = key_pieces(n_bits, radius)
        work = sum(mask_count(bits, near) * (1 + (n_buckets >> bits)) for _, bits in pieces)
    cores = keys.sparkSession.sparkContext.defaultParallelism
    return min(64 * cores, max(1, math.ceil(keys.count() * work / TASK_PROBES)))


def distinct_keys(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("key").alias("qkey")).distinct()


def per_query(queries: DataFrame, by_key: DataFrame) -> DataFrame:
    """Give every query the rows found for its key."""
    return queries.select("qid", F.col("key").alias("qkey")).join(by_key, "qkey").drop("qkey")


def probe_hits(queries: DataFrame, buckets: DataFrame, n_bits: int, radius: int) -> DataFrame:
    """(qid, key, dist, cnt): the existing buckets within ``radius`` of each query key."""
    return per_query(queries, near_buckets(distinct_keys(queries), buckets, n_bits, radius))


def ring_cutoff(hits: DataFrame, search_k: int, by: str = "qid") -> DataFrame:
    """Keep ring r only while the rings before it hold fewer than ``search_k`` items.

    Adds ``pool_size``, the number of candidate items each query ends up with.
    """
    nearer = (
        Window.partitionBy(by).orderBy("dist").rangeBetween(Window.unboundedPreceding, -1)
    )
    kept = hits.withColumn("before", F.coalesce(F.sum("cnt").over(nearer), F.lit(0))).where(
        F.col("before") < search_k
    )
    pool = F.sum("cnt").over(Window.partitionBy(by))
    return kept.withColumn("pool_size", pool).drop("before")


def candidates(probes: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, item_id, dist) of every item in a kept bucket; the plain candidate join."""
    return probes.join(items.select("item_id", "key"), "key").select("qid", "item_id", "dist")


def top_in_buckets(
    probes: DataFrame,
    queries: DataFrame,
    items: DataFrame,
    k: int,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top k per query among the items of its kept buckets.

    Cells are (key, item split, query split). Light keys share a cell to keep the
    number of Python calls in proportion to the data.
    """
    q = query_rows(queries)
    c = item_rows(items, keep=("key",))
    schema = result_schema(q, c)
    met = probes.groupBy("key").agg(
        F.first("cnt").alias("n_items"), F.count(F.lit(1)).alias("n_queries")
    )
    totals = met.agg(
        F.count(F.lit(1)), F.sum("n_items"), F.sum("n_queries"), F.max("n_items"), F.max("n_queries")
    ).first()
    n_keys = totals[0]
    if not n_keys:
        return q.sparkSession.createDataFrame([], schema + ", rank int")
    cores = q.sparkSession.sparkContext.defaultParallelism
    groups = min(n_keys, max(2 * cores, math.ceil(max(totals[1], totals[2]) / block_rows)))
    plan = met.select(
        "key",
        F.ceil(F.col("n_items") / block_rows).cast("int").alias("item_splits"),
        F.ceil(F.col("n_queries") / block_rows).cast("int").alias("query_splits"),
    )
    heavy = (F.col("item_splits") > 1) | (F.col("query_splits") > 1)
    plan = plan.withColumn(
        "cell", F.when(heavy, F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups)))
    ).withColumn("hot_key", F.when(heavy, F.col("key")).otherwise(F.lit(0)))
    # Same columns under fresh ids: both sides of the cogroup come from this plan.
    query_plan = plan.select(*[F.col(name).alias(name) for name in plan.columns])
    if n_keys <= BROADCAST_KEYS:
        plan, query_plan = F.broadcast(plan), F.broadcast(query_plan)

    at = ["cell", "hot_key", "i_split", "q_split"]
    item_cells = (
        c.join(plan, "key")
        .withColumn("i_split", F.pmod(F.xxhash64("item_id"), F.col("item_splits")).cast("int"))
        .withColumn("q_split", F.explode(F.sequence(F.lit(0), F.col("query_splits") - 1)))
        .select(*at, "key", "item_id", "vec", "bias")
    )
    query_cells = (
        probes.select("qid", "key")
        .join(q, "qid")
        .join(query_plan, "key")
        .withColumn("q_split", F.pmod(F.xxhash64("qid"), F.col("query_splits")).cast("int"))
        .withColumn("i_split", F.explode(F.sequence(F.lit(0), F.col("item_splits") - 1)))
        .select(*at, "key", "qid", "vec", "w_sim", "w_bias", "w_const")
    )

    def best(asked: pa.Table, keys: np.ndarray, blocks: dict) -> pa.Table:
        order = np.argsort(keys, kind="stable")
        asked, keys = asked.take(pa.array(order)), keys[order]
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        return keep_best([score_prepared(asked.slice(a, b - a), blocks[int(keys[a])], k) for a, b in zip(edges, edges[1:])], k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, blocks, sizes = None, {}, {}
        for asked, held in met_in_cells(batches, at, block_rows):
            if held is not last:
                last, held_ = held, held.sort_by("key")
                found, starts, counts = np.unique(held_["key"].to_numpy(), return_index=True, return_counts=True)
                blocks = {key: prepared(held_.slice(at_, n)) for key, at_, n in zip(found.tolist(), starts.tolist(), counts.tolist())}
                sizes = dict(zip(found.tolist(), np.minimum(counts, k).tolist()))
            keys = asked["key"].to_numpy()
            rows = np.array([sizes.get(key, 0) for key in keys.tolist()])
            asked, keys, rows = asked.filter(pa.array(rows > 0)), keys[rows > 0], rows[rows > 0]
            # Visits of a query lie together: pieces give at most about ``ANSWER_ROWS`` rows each.
            piece = np.cumsum(rows) // ANSWER_ROWS
            cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(keys)]
            for start, stop in zip(cuts, cuts[1:]):
                if stop > start:
                    yield from best(asked.slice(start, stop - start), keys[start:stop], blocks).combine_chunks().to_batches()

    found = dealt_in_cells(query_cells, item_cells, at, left_order="qid").mapInArrow(run, schema)
    return found.withColumn("rank", F.row_number().over(rank_window())).where(F.col("rank") <= k)


@dataclass(frozen=True)
class ProbePlan:
    """What probing decided before any item row is read.

    ``policy`` holds the queries with ``method``, ``pool_size`` and ``found`` (null when
    no bucket was met); ``kept`` the buckets each query will look into.
    """

    policy: DataFrame
    kept: DataFrame


def plan_probes(
    queries: DataFrame, items: DataFrame, planes: np.ndarray, search_k: int, radius: int, fallback_below: int
) -> ProbePlan:
    """Buckets per query, and which queries fall back to an exact scan.

    A query that meets no bucket scans the catalog and is still called ``ann``; one
    whose bucket count is under ``fallback_below`` is called ``exact_fallback``.
    """
    key = lsh_key(F.col("vec").cast("array<double>"), planes)
    keyed = queries.withColumn("key", key).persist()
    buckets = bucket_counts(items).persist()
    n_items = buckets.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    # What a query may look into depends on its key alone, so keys shared by many
    # queries are probed once.
    by_key = probe_rings(distinct_keys(keyed), buckets, len(planes), radius, search_k).persist()
    counts = by_key.groupBy(F.col("qkey").alias("key")).agg(F.first("pool_size").alias("found"))
    kept = per_query(keyed, by_key)
    size = F.coalesce("found", F.lit(n_items))
    method = F.when(size < fallback_below, "exact_fallback").otherwise("ann")
    policy = (
        keyed.join(counts, "key", "left")
        .withColumn("method", method)
        .withColumn("pool_size", F.when(method == "ann", size).otherwise(n_items).cast("long"))
    )
    return ProbePlan(policy.persist(), kept)


def probed_pools(
    plan: ProbePlan, items: DataFrame, pool: int, exact_k: int, with_fallback: bool = True
) -> DataFrame:
    """(qid, item_id, similarity, bias, score, method, pool_size) of the planned pools.

    ``ann`` keeps the ``pool`` most similar items and adds the bias after that, so a
    bonus cannot pull in an item from outside. Queries that need the whole catalog,
    for either reason, share one scan of it.
    """
    ann = F.col("method") == "ann"
    near = top_in_buckets(
        plan.kept.join(plan.policy.where(ann).select("qid"), "qid", "left_semi"),
        plan.policy.where(ann).withColumn("w_bias", F.lit(0.0)),
        items,
        pool,
    )
    whole = (ann & F.col("found").isNull()) | (~ann & F.lit(with_fallback))
    far_queries = plan.policy.where(whole).withColumn("w_bias", F.when(ann, 0.0).otherwise(1.0))
    far = top_scored(far_queries, items, max(pool, exact_k) if with_fallback else pool)
    found = near.unionByName(far).withColumn("score", F.col("similarity") + F.col("bias"))
    limit = F.when(ann, F.lit(pool)).otherwise(F.lit(max(pool, exact_k)))
    sized = plan.policy.select("qid", "method", "pool_size")
    return found.join(sized, "qid").where(F.col("rank") <= limit).select(*POOL_COLUMNS)


def retrieve(
    queries: DataFrame,
    items: DataFrame,
    planes: np.ndarray | None,
    top_n: int,
    search_k: int = 256,
    radius: int = 2,
    use_ann: bool = True,
) -> DataFrame:
    """The pool of items to rank for each query, hashed where possible.

    ``items`` needs ``item_id, vec`` (``key`` when ``use_ann``) and optional ``bias``.
    """
    exact_k = 10 * top_n
    if not use_ann or planes is None:
        found = top_scored(queries, items, exact_k)
        size = F.lit(items.count()).cast("long")
        return found.withColumns({"method": F.lit("exact"), "pool_size": size}).select(*POOL_COLUMNS)
    pool = max(search_k, 30 * top_n)
    plan = plan_probes(queries, items, planes, pool, radius, 5 * top_n)
    return probed_pools(plan, items, pool, exact_k)
