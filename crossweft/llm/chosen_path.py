"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is its distinct word shingles (A-Z lower-cased). Equal sets are one node of
the work. ``trees`` independent trees are grown over all sets. At a tree node every set picks
``branch`` of its tokens minwise, each by a hash function of that place in the tree, and goes
to the child of each picked token. A node with at most ``limit`` sets is a leaf and compared
exhaustively; a larger one branches on. Two sets of similarity s pick the same token with
probability s, so they stay together down to a child with p = 1 - (1 - s p)^branch, whatever
the depth: 0.9375 for s = 0.8 and two tokens. ``trees`` is the number of repetitions that
brings the chance of meeting to ``recall``.

A node that near copies keep large would never shrink. So before a node branches, all its
sets are compared with its *pivot*, the set closest to the majority of the node's sketches.
Those as similar as asked are linked to it. By the triangle inequality of the Jaccard
distance a set farther than twice the allowed distance from the pivot has no link with one
linked to it, and one linked at distance d has none with a set at d + the allowed distance or
more; linked sets that can have no further link outside leave the node. What is left
branches. A node that is still large at the last level is compared piece by piece.

Leaves are compared by 256-bit sketches (a bit of each minwise token): at similarity 0.8 bits
differ with probability 0.1, and the bound lies six deviations above, so a sketch loses
nothing that matters. Sets whose sketches are close form groups around the least member;
their sets themselves are then compared and give a spanning forest of the links, so a group
of copies yields rows in proportion to its members. All joins are equi-joins of narrow rows
whose other side is stored, so Spark splits a hot node.

Defined cases: a text with fewer words than a shingle is one shingle; a null text, or one
without words, has an empty set that is linked with nothing. ``component_id`` is the smallest
id reachable; null ids are passed over, and a group without ids has none. ``kept`` compares
id and component as equal when both are null, so repeated rows of the smallest id are all
kept. An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweft.llm.graph import components
from crossweft.llm.registry import query
from crossweft.llm.repeats import mixed
from crossweft.llm.simhash import CELL, CELL_SHINGLES, close_pairs, close_sets, pairs_in_cells, shingle_hashes
from crossweft.llm.tables import give_back, one_by_one, stored, table

#: Bits of a sketch, and 64-bit words that hold them.
BITS, LANES = 256, 4
SKETCH = [f"s{k}" for k in range(LANES)]
#: Ids, of 16 bytes, and nodes, of 50, that are sent to every executor at a time.
FEW_IDS, FEW_NODES = 1_000_000, 100_000
#: Most values of a batch of shingles under all hash functions that are held at once.
_CHUNK = 255


@dataclass(frozen=True)
class Join:
    """shingle: words; percent: least similarity; recall: chance that a pair just so similar meets.

    limit: sets of a leaf; levels: after so many, a node is compared however large it is.
    """

    shingle: int = 2
    percent: int = 80
    recall: float = 0.99999
    branch: int = 2
    limit: int = CELL
    levels: int = 8

    @property
    def trees(self) -> int:
        """Repetitions that reach the recall, from the chance that a pair stays together for ever."""
        s, p = self.percent / 100, 1.0
        for _ in range(200):
            p = 1 - (1 - s * p) ** self.branch
        return math.ceil(math.log(1 - self.recall) / math.log(1 - p))

    def first_function(self, level: int) -> int:
        """Number of hash functions that the levels before this one use."""
        return sum(self.trees * self.branch**k for k in range(1, level))

    @property
    def functions(self) -> int:
        """Hash functions of four levels; deeper ones use them again."""
        return self.first_function(5)

    def most_bits(self, similarity: float) -> int:
        """Sketch bits that differ at most at a similarity, six deviations above the mean."""
        q = (1 - similarity) / 2
        return math.floor(BITS * q + 6 * math.sqrt(BITS * q * (1 - q)))


def _factors(n: int) -> np.ndarray:
    return (mixed(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minima(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minwise token of a set under each hash function; 32 bits of the shingle's hash stand for it."""
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(small), _CHUNK):
        np.minimum(least, (small[at : at + _CHUNK, None] * factors).min(axis=0), out=least)
    return least


def sketch(least: np.ndarray) -> np.ndarray:
    """One bit of each of the first ``BITS`` tokens, as ``LANES`` numbers."""
    places = np.arange(BITS, dtype=np.uint64) << np.uint64(32)
    bits = mixed(least[:BITS].astype(np.uint64) + places) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).view(">i8").astype(np.int64)


def shingles(text: str | None, join: Join) -> np.ndarray:
    return np.unique(shingle_hashes(text, join.shingle))


def printed(rows: DataFrame, join: Join) -> DataFrame:
    """(doc_id, text, size, digest, sketch lanes, minima) of rows (doc_id, text); digest null: empty."""
    names = ["doc_id", "text", "size", "digest", *SKETCH, "minima"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(max(BITS, join.functions))
        for batch in batches:
            sizes, digests, lanes, tokens = [], [], [], []
            for text in one_by_one(batch.column(1)):
                hashes = shingles(text, join)
                least = minima(hashes, factors)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes) if len(hashes) else None)
                lanes.append(sketch(least))
                tokens.append(least[: join.functions].astype(">u4").tobytes())
            by_lane = np.array(lanes, np.int64).reshape(-1, LANES).T
            columns = [*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())]
            columns += [*map(pa.array, np.ascontiguousarray(by_lane)), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    lanes = ", ".join(f"{s} long" for s in SKETCH)
    return rows.mapInArrow(run, f"doc_id long, text string, size long, digest binary, {lanes}, minima binary")


def met(nodes: DataFrame, asked: DataFrame, kept: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``kept`` of the nodes of the uids of ``asked``, with its other columns; stored.

    Ids go to the scan, so no node moves. Many ids go in slices of about ``FEW_IDS``, one after
    the other, each with a scan of its own: what is shuffled is the same at every size.
    """
    asked = stored(asked, "path-wanted")
    slices = max(1, math.ceil(asked.count() / FEW_IDS))
    parts = [asked.where(F.pmod(F.xxhash64("uid"), F.lit(slices)) == k) for k in range(slices)]
    return reduce(DataFrame.unionByName, [stored(kept(nodes.join(F.broadcast(part), "uid")), name) for part in parts])


def sets_of(asked: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """The rows of ``asked`` (uid, key) with the whole sets of their nodes (uid, text): (key, uid, hashes), stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, join).tobytes() for text in one_by_one(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["key", "uid", "hashes"])
        give_back()

    def hashed(found: DataFrame) -> DataFrame:
        return found.select("key", "uid", "text").mapInArrow(run, "key long, uid long, hashes binary")

    return met(nodes.select("uid", "text"), asked, hashed, "path-sets")


def differing(prefix: str) -> Column:
    """Bits in which a row's sketch differs from that under ``prefix``."""
    return sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"{prefix}.{s}"))) for s in SKETCH), F.lit(0))


def children(rows: DataFrame, join: Join, level: int) -> DataFrame:
    """Each row (node, place, uid, lanes, minima) once for each token its set picks at this level."""
    start = join.first_function(level)

    def picked(k: int) -> Column:
        place = F.col("place") * join.branch + k
        token = F.substring(F.col("minima"), 4 * F.pmod(start + place, F.lit(join.functions)) + 1, F.lit(4))
        return F.struct(F.xxhash64("node", place, token).alias("node"), place.cast("int").alias("place"))

    picks = F.explode(F.array(*[picked(k) for k in range(join.branch)])).alias("pick")
    return rows.select(picks, "uid", *SKETCH).select("pick.node", "pick.place", "uid", *SKETCH)


def compared_with_pivots(large: DataFrame, nodes: DataFrame, join: Join, sent: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(links, rest): links of each node's sets with its pivot, and the rows that may have further ones.

    ``sent`` is how a table with a row for each node meets the rows.
    """
    ones = [F.sum(F.shiftrightunsigned("s0", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64)]
    counted = large.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *ones)
    # Bits are disjoint, so their sum is their union; the highest one is the sign.
    bits = [F.when(2 * F.col(f"b{k}") > F.col("n"), F.lit((1 << k) - ((1 << 64) if k == 63 else 0))).otherwise(F.lit(0)) for k in range(64)]
    majority = stored(counted.select("node", sum(bits[1:], bits[0]).cast("long").alias("usual")), "path-majorities")
    middle = F.struct(F.bit_count(F.col("s0").bitwiseXOR(F.col("usual"))).alias("off"), "uid", *SKETCH)
    pivots = stored(large.join(sent(majority), "node").groupBy("node").agg(F.min(middle).alias("pivot")), "path-pivots")

    reach = 2 * join.percent / 100 - 1  # similarity at twice the allowed distance
    close = large.join(sent(pivots), "node").where((differing("pivot") <= join.most_bits(reach)) & (F.col("uid") != F.col("pivot.uid")))
    pairs = stored(close.select("uid", F.col("pivot.uid").alias("pivot")).distinct(), "path-pivot-pairs")
    named = pairs.select(F.explode(F.array("uid", "pivot")).alias("uid")).distinct()
    sets = sets_of(named.select("uid", F.col("uid").alias("key")), nodes, join).select("uid", "hashes")
    of_pivot = sets.select(F.col("uid").alias("pivot"), F.col("hashes").alias("theirs"))

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for a, b in zip(one_by_one(batch.column(2)), one_by_one(batch.column(3))):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                n = len(np.intersect1d(a, b, assume_unique=True))
                both.append((n, len(a) + len(b) - n))
            n, union = np.array(both, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.copy()), pa.array(union.copy())], ["uid", "pivot", "shared", "union"])
        give_back()

    joined = pairs.join(sets, "uid").join(of_pivot, "pivot").select("uid", "pivot", "hashes", "theirs")
    judged = stored(joined.mapInArrow(shared, "uid long, pivot long, shared long, union long"), "path-judged")
    linked = F.expr(f"100 * shared >= {join.percent} * union")
    links = judged.where(linked).select(F.col("uid").alias("a"), F.col("pivot").alias("b"))

    itself = F.col("uid") == F.col("pivot")
    rows = large.join(sent(pivots.select("node", F.col("pivot.uid").alias("pivot"))), "node").join(judged, ["uid", "pivot"], "left")
    rows = rows.withColumn("inside", itself | F.coalesce(linked, F.lit(False))).withColumn("distance", F.when(itself, 0.0).otherwise(1 - F.col("shared") / F.col("union")))
    allowed = 1 - join.percent / 100
    ring = stored(rows.where(f"NOT inside AND distance <= {2 * allowed + 1e-9}").groupBy("node").agg(F.min("distance").alias("nearest")), "path-rings")
    rest = rows.join(sent(ring), "node", "left").where(f"NOT inside OR coalesce(distance >= nearest - {allowed + 1e-9}, false)")
    return links, rest.select("node", "place", "uid", *SKETCH)


def close_members(rows: pa.Table, marks: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Positions (leader, member): the least set of each group of close sketches in a leaf, with all of the group."""
    prints = pa.concat_arrays(rows["lanes"].chunks).flatten().to_numpy().view(np.uint64).reshape(-1, LANES)
    a, b = close_pairs(prints, marks, join.most_bits(join.percent / 100))
    order = np.argsort(rows["node"].to_numpy(), kind="stable")
    least = np.empty_like(order)
    least[order] = np.arange(len(order))
    before = None
    while before is None or not np.array_equal(before, least):
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
    linked = np.union1d(a, b)
    return order[least[linked]], linked


def leaf_groups(leaves: DataFrame, join: Join) -> DataFrame:
    """(leader, uid): sets of the leaves (node, uid, lanes) with those whose sketches are close, by their least member."""
    keyed = leaves.select(F.col("node").alias("key"), F.col("uid").alias("node"), F.array(*SKETCH).alias("lanes"))

    def grouped(rows: pa.Table, marks: np.ndarray) -> pa.RecordBatch:
        leader, member = close_members(rows, marks, join)
        uid = rows["node"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(uid[leader]), pa.array(uid[member])], ["leader", "uid"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            key = held["key"].to_numpy()
            starts = np.flatnonzero(key[1:] != key[:-1]) + 1
            if len(starts):  # the last node may go on
                last = int(starts[-1])
                yield grouped(held.slice(0, last), np.searchsorted(starts, np.arange(last), side="right"))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield grouped(held, np.zeros(held.num_rows, np.int64))
        give_back()

    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "leader long, uid long")


def stubborn_groups(rows: DataFrame, join: Join) -> DataFrame:
    """The same of nodes (node, uid, lanes, n) that are still large, compared piece by piece."""
    keyed = rows.select(F.col("node").alias("key"), F.col("uid").alias("node"), F.array(*SKETCH).alias("lanes"))
    pieces = stored(rows.select(F.col("node").alias("key"), F.ceil(F.col("n") / CELL).cast("int").alias("pieces")).distinct(), "path-pieces")
    found = pairs_in_cells(keyed, pieces, lambda rows, marks: close_members(rows, marks, join))
    return found.select(F.col("a").alias("leader"), F.col("b").alias("uid"))


def confirmed(groups: DataFrame, nodes: DataFrame, join: Join, cell: int = CELL, shingles: int = CELL_SHINGLES) -> DataFrame:
    """(a, b): a spanning forest of the links inside each group (leader, uid), by the whole sets."""
    held = sets_of(groups.select("uid", F.col("leader").alias("key")), nodes, join).withColumnRenamed("uid", "node")
    total = F.greatest(F.ceil(F.count(F.lit(1)) / cell), F.ceil(F.sum(F.octet_length("hashes")) / (8 * shingles)), F.lit(1))
    pieces = stored(held.groupBy("key").agg(total.cast("int").alias("pieces")), "path-set-pieces")

    def found(rows: pa.Table, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        start = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
        for at, stop in zip(start.tolist(), [*start[1:].tolist(), len(marks)]):
            members = [np.frombuffer(h.as_buffer(), np.uint64) for chunk in rows["hashes"].slice(at, stop - at).chunks for h in chunk]
            a, b = close_sets(np.concatenate(members), np.cumsum([0, *map(len, members)]), join.percent)
            left.append(a + at)
            right.append(b + at)
        return np.concatenate(left), np.concatenate(right)

    return pairs_in_cells(held, pieces, found)


def links(nodes: DataFrame, distinct: DataFrame, join: Join = Join()) -> DataFrame:
    """(a, b): links of the nodes (uid, text, lanes, minima) that join all that belongs together.

    ``distinct`` (uid): one node of each set.
    """
    roots = nodes.select(F.lit(0).cast("long").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(join.trees - 1))).alias("place"), "uid", *SKETCH, "minima")
    rows = met(roots, distinct, lambda found: children(found, join, 1), "path-rows")
    found, leaves, groups = [], [], []

    def large_nodes(rows: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], bool]:
        """(node, n) of those above the limit, how such a table meets the rows, and whether there is any."""
        large = stored(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(f"n > {join.limit}"), "path-large-nodes")
        count = large.count()
        return large, F.broadcast if count <= FEW_NODES else lambda df: df, count > 0

    for level in range(1, join.levels + 1):
        nodes_, sent, some = large_nodes(rows)
        leaves.append(rows.join(sent(nodes_), "node", "left_anti"))
        if some and level == join.levels:
            groups.append(stubborn_groups(rows.join(sent(nodes_), "node"), join))
        if not some or level == join.levels:
            break
        large = stored(rows.join(sent(nodes_), "node", "left_semi"), "path-large")
        with_pivot, rest = compared_with_pivots(large, nodes, join, sent)
        found.append(with_pivot)
        rest = stored(rest, "path-rest")
        nodes_, sent, some = large_nodes(rest)
        leaves.append(rest.join(sent(nodes_), "node", "left_anti"))
        if not some:
            break
        more = rest.join(sent(nodes_), "node", "left_semi")
        tokens = met(nodes.select("uid", "minima"), more.select("uid").distinct(), lambda found: found, "path-tokens")
        rows = stored(children(more.join(tokens, "uid"), join, level + 1), "path-rows")
    every = leaves[0].select("node", "uid", *SKETCH)
    for more in leaves[1:]:
        every = every.unionByName(more.select("node", "uid", *SKETCH))
    close = leaf_groups(every, join)
    for more in groups:
        close = close.unionByName(more)
    edges = confirmed(stored(close.distinct(), "path-groups"), nodes, join)
    for more in found:
        edges = edges.unionByName(more)
    return edges


def near_groups(docs: DataFrame, join: Join = Join(), identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(identity).cast("long").alias("doc_id"), F.col(text).alias("text"))
    documents = stored(printed(rows, join).withColumn("uid", F.monotonically_increasing_id()), "path-prints")
    firsts = stored(documents.where("size > 0").groupBy("digest").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least")), "path-firsts")
    roots = components(links(documents, firsts.select(F.col("node").alias("uid")), join), "path-links")
    placed = firsts.join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_digest = stored(placed.join(named, "component").select("digest", "component_id"), "path-components")
    narrow = documents.select("doc_id", F.col("size").alias("n_shingles"), "digest")
    linked = narrow.where("digest IS NOT NULL").join(of_digest, "digest").select("doc_id", "n_shingles", "component_id")
    alone = narrow.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query("op11_chosen_path")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"))
