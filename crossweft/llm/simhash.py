"""SimHash near-dedup with pigeonhole blocks.

A text's words (A-Z lower-cased) form shingles; each shingle is hashed by XXH64, and a
fingerprint bit is 1 if more than half of the hashes, repeats included, have it. Equal
fingerprints are one node. A fingerprint is split into blocks, and two nodes are compared
where they agree on ``agree`` of the blocks. If two fingerprints differ in at most ``bits``
bits, at least ``blocks - bits`` blocks are untouched, so with ``agree = blocks - bits``
every such pair meets: this is the setting of the query, exact and with 25 bits or more
to a key. The number of blocks grows with the number of nodes, so that keys stay longer
than the nodes are many.

Pairs inside a key are verified in numpy and never become rows: a key gives a spanning
forest of its close nodes. A key with more than ``CELL`` nodes is cut into pieces, and each
pair of pieces is a group of its own, so no task holds a hot key. Joins back to the
documents are equi-joins of narrow rows, which Spark splits where a fingerprint is hot.

For near copies, five-word shingles with similarity (Jaccard, of the shingle sets) 0.8 or
more, ``WIDE`` decides in two steps. Candidates meet by blocks of the 384 fingerprint bits, up
to 24 of them and each 2 bits wider than the nodes are many: every pair that differs in fewer
bits than there are blocks shares one. Similarity 0.8 is 58 bits (mean; deviation 7, small sets
beyond 100), where blocks so wide cannot meet for certain. So all nodes also meet by the heads of
their sets: of two sets that have ``need`` of n shingles in common, the first ``n - need + 1`` of
each, in one order for all, share one whatever the sets are. The order is that of the hashes, with
those that many heads hold moved to the end, so that a common passage is in few heads. Inside a
shingle sets are held against each other by how many of their hashes fall into each of a number
of buckets: the differences add up to no more than what the sets really differ in, so no similar
pair is passed over. Then each component of candidates is compared by its shingle sets themselves,
and only pairs of ``percent`` or more are linked: all of them, and no others. Sets count a repeated
shingle once, and so does a wide fingerprint; a node is one set, by a 128-bit hash of it.

Defined cases: null and empty texts have fingerprint zero, linked like any other; fewer words
than a shingle form one. ``component_id`` is the smallest id reachable; null ids are passed
over, and a group without ids has none. Of repeated rows one stays in ``drop_near_copies``,
of the smallest id. An empty table gives an empty result. All columns of the input, whatever
their names, are kept by ``drop_near_copies`` and ignored by ``near_groups``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossweft.llm.exact_dedup import located
from crossweft.llm.graph import components
from crossweft.llm.registry import query
from crossweft.llm.repeats import mixed
from crossweft.llm.tables import UPPER, give_back, one_by_one, stored, table

#: Most nodes of a key that are compared in one piece, and nodes compared without a search.
CELL = 4096
FEW = 8
#: Most shingles of a component that are compared in one piece, on the average.
CELL_SHINGLES = 1 << 19
#: Sets that a worker sends at once.
SET_ROWS = 500
#: Most blocks of a wide fingerprint; with fewer nodes they only get wider than they must be.
MOST_BLOCKS = 24
#: Sets of so many shingles are held against each other by so many buckets, larger ones by the last.
BUCKETS = ((1 << 9, 64), (1 << 11, 256), (1 << 62, 1024))
#: Heads that may hold a shingle before it is moved to the end of the order, and times that this is done.
COMMON = 1024
MOVES = 2
SEED = 42
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_RUN = 255  # rows of bits whose sums fit a byte


@dataclass(frozen=True)
class Setting:
    """shingle: words; lanes: 64-bit words of a fingerprint; bits: most that may differ.

    Nodes meet by blocks of the fingerprint. ``percent`` above 0: they also meet by the heads of
    their sets, and are linked if their sets are as similar. ``bands``: 64-bit words behind the
    fingerprint, which tell different sets apart.
    """

    shingle: int
    lanes: int
    bits: int
    percent: int = 0
    bands: int = 0


NARROW = Setting(shingle=3, lanes=1, bits=3)
WIDE = Setting(shingle=5, lanes=6, bits=100, percent=80, bands=2)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = memoryview(b" ".join(words))
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    stop = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], stop[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(start[: len(words) - size + 1].tolist(), stop[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int) -> bytes:
    """Majority bits, 8 bytes a lane, highest bit first; lane 0 has the hashes themselves."""
    out = []
    for lane in range(lanes):
        h = hashes if lane == 0 else mixed(hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64)))
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), _RUN * 256):
            bits = np.unpackbits(h[at : at + _RUN * 256].astype(">u8").view(np.uint8)).reshape(-1, 64)
            full = len(bits) // _RUN * _RUN
            counts += bits[:full].reshape(-1, _RUN, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
            counts += bits[full:].sum(0, dtype=np.uint8)
        out.append(np.packbits(2 * counts > len(h)).tobytes() if len(h) else bytes(8))
    return b"".join(out)


def needed(n: int, percent: int) -> int:
    """How many of its ``n`` shingles a set shares at least with one as similar."""
    return -(-percent * n // 100)


def head_of(hashes: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The first hashes of a set, ``common`` ones last: similar sets share one of them."""
    if not len(hashes):
        return hashes
    late = np.isin(hashes, common) if len(common) else np.zeros(len(hashes), bool)
    return np.concatenate([hashes[~late], hashes[late]])[: len(hashes) - needed(len(hashes), percent) + 1]


def views_of(hashes: np.ndarray, percent: int) -> list[bytes]:
    """How many hashes fall into each bucket, 255 at most, behind the size of the set.

    Sets of different sizes are held against each other with the buckets of the smaller one, so
    there is a view for every number of buckets that a set as similar and no larger may have.
    """
    n, out, under = len(hashes), [], 0
    for most, buckets in BUCKETS:
        if n and needed(n, percent) <= most and n > under:
            counts = np.bincount((hashes >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64), minlength=buckets)
            out.append(np.array([n], "<u4").tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes())
        under = most
    return out


def fingerprints(rows: DataFrame, setting: Setting) -> DataFrame:
    """The rows (.., text) with ``print`` in place of the text; if sets are compared, with ``head`` and ``views``."""
    kept = rows.columns[:-1]
    none = np.zeros(0, np.uint64)

    def printed(text: str | None) -> tuple[bytes, np.ndarray, list[bytes]]:
        hashes = shingle_hashes(text, setting.shingle)
        if not setting.percent:
            return fingerprint(hashes, setting.lanes), none, []
        hashes = np.unique(hashes)
        own = xxhash.xxh3_128_digest(hashes.tobytes())[: 8 * setting.bands]
        return fingerprint(hashes, setting.lanes) + own, head_of(hashes, setting.percent, none), views_of(hashes, setting.percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4 * SET_ROWS):
                batch = whole.slice(at, 4 * SET_ROWS)
                prints, heads, views = zip(*(printed(t) for t in one_by_one(batch.column(len(kept)))))
                columns = [*batch.columns[:-1], pa.array(prints, pa.binary())]
                if setting.percent:
                    columns += [_lists(heads), pa.array(views, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "print", "head", "views"][: len(columns)])
        give_back()

    schema = rows.select(*kept).schema.add("print", T.BinaryType())
    if setting.percent:
        schema = schema.add("head", T.ArrayType(T.LongType())).add("views", T.ArrayType(T.BinaryType()))
    return rows.mapInArrow(run, schema)


def _lists(values: Iterable[np.ndarray]) -> pa.ListArray:
    values = list(values)
    edges = pa.array(np.cumsum([0, *map(len, values)]), pa.int32())
    return pa.ListArray.from_arrays(edges, pa.array(np.concatenate(values).view(np.int64)))


def masks(setting: Setting, nodes: int) -> list[list[int]]:
    """For every choice of blocks that a key is made of: the mask of each lane's bits."""
    width = 64 * setting.lanes
    if setting.percent:
        blocks, agree = min(MOST_BLOCKS, width // (max(1, nodes).bit_length() + 2)), 1
    else:
        blocks = setting.bits + 2
        while (blocks - setting.bits) * width // blocks < max(1, nodes).bit_length() and blocks < 16:
            blocks += 1
        agree = blocks - setting.bits
    edges = [width * k // blocks for k in range(blocks + 1)]
    whole = [((1 << (b - a)) - 1) << (width - b) for a, b in zip(edges, edges[1:])]
    out = []
    for chosen in combinations(whole, agree):
        mask = sum(chosen)
        lanes = [(mask >> (64 * (setting.lanes - 1 - k))) & ((1 << 64) - 1) for k in range(setting.lanes)]
        out.append([x - (1 << 64) if x >> 63 else x for x in lanes])
    return out


def close_pairs(prints: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of each group's close nodes, as positions; groups lie together."""
    return _forest(group, lambda a, b: np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1) <= bits)


def _forest(group: np.ndarray, close: Callable[[np.ndarray, np.ndarray | int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = len(group)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([start, [n]]))
    small = np.repeat(size <= FEW, size)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, FEW):
        a = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        a = a[close(a, a + step)]
        left.append(a)
        right.append(a + step)
    for at, count in zip(start[size > FEW].tolist(), size[size > FEW].tolist()):
        waiting = np.arange(at, at + count)
        while len(waiting):
            front, waiting = [waiting[0]], waiting[1:]
            while front and len(waiting):
                u = front.pop()
                near = close(waiting, u)
                found = waiting[near]
                if len(found):
                    left.append(np.full(len(found), u))
                    right.append(found)
                    front.extend(found)
                    waiting = waiting[~near]
    return np.concatenate(left), np.concatenate(right)


def links(nodes: DataFrame, setting: Setting, cell: int = CELL) -> DataFrame:
    """(a, b): close pairs of the nodes (node, print) that join all that belongs together."""
    lanes = setting.lanes
    choices = masks(setting, nodes.count())
    lane = lambda k: F.conv(F.hex(F.substring("print", 8 * k + 1, 8)), 16, -10).cast("long")
    words = nodes.select("node", F.substring("print", 1, 8 * lanes).alias("print"), *[lane(k).alias(f"lane{k}") for k in range(lanes)])
    keys = [F.xxhash64(F.lit(c), *[F.col(f"lane{k}").bitwiseAND(F.lit(m)) for k, m in enumerate(mask) if m]) for c, mask in enumerate(choices)]
    keyed = words.select(F.explode(F.array(*keys)).alias("key"), "node", "print")
    # Stored, as Spark splits a hot key only between two shuffles.
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-keys")

    def found(rows: pa.Table, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = np.frombuffer(b"".join(rows["print"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)
        return close_pairs(prints, marks, setting.bits)

    return pairs_in_cells(keyed, shared.select("key", F.ceil(F.col("n") / cell).cast("int").alias("pieces")), found)


def pairs_in_cells(keyed: DataFrame, pieces: DataFrame, found: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b): what ``found`` links among the rows (key, node, value) of a key, by pairs of its pieces."""
    return met_in_pieces(keyed.join(pieces, "key"), found)


def met_in_pieces(keyed: DataFrame, found: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The same for rows (key, node, value, pieces)."""
    value = keyed.columns[2]
    met = (
        keyed.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("key", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"), "node", value)
    )
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def linked(rows: pa.Table, marks: np.ndarray) -> pa.RecordBatch:
        a, b = found(rows, marks)
        node = rows["node"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table_ = pa.Table.from_batches([batch])
            held = table_ if held is None else pa.concat_tables([held, table_])
            marks = _marks(held)
            last = int(np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))[-1]) if len(marks) else 0
            if last:
                yield linked(held.slice(0, last), marks[:last])
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield linked(held, _marks(held))
        give_back()

    groups = met.repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q")
    return groups.mapInArrow(run, "a long, b long")


def alike(nodes: DataFrame, reread: Callable[[DataFrame, np.ndarray], DataFrame], setting: Setting, cell: int = CELL, common: int = COMMON) -> DataFrame:
    """(a, b): nodes (node, head, views) of which one component holds all that may be similar.

    ``reread`` gives the heads (node, head) of nodes, with the hashes it is given moved to the end.
    """
    percent, moved = setting.percent, np.zeros(0, np.uint64)
    for turn in range(MOVES + 1):
        heads = nodes.select(F.explode("head").alias("shingle"), "node")
        counts = stored(heads.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-heads")
        many = counts.where(F.col("n") > common).select("shingle").toArrow()["shingle"].to_numpy().view(np.uint64) if turn < MOVES else moved
        fresh = np.setdiff1d(many, moved)
        if not len(fresh):
            break
        moved = np.union1d(moved, fresh)
        hot = counts.where(F.col("n") > common).select("shingle")
        touched = heads.join(F.broadcast(hot), "shingle").select("node").distinct()
        again = reread(touched, moved).withColumnRenamed("head", "again")
        nodes = stored(nodes.join(again, "node", "left").select("node", F.coalesce("again", "head").alias("head"), "views"), "simhash-nodes")
    shared = heads.join(counts, "shingle")  # narrow rows first: few shingles are in two heads
    keyed = shared.join(nodes.select("node", "views"), "node").select("shingle", "node", F.explode("views").alias("view"), "n")
    keyed = keyed.select(F.xxhash64("shingle", F.octet_length("view")).alias("key"), "node", "view", F.ceil(F.col("n") / cell).cast("int").alias("pieces"))

    def found(rows: pa.Table, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        views = rows["view"].to_pylist()
        width = np.array([len(v) for v in views], np.int64)
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            table_ = np.frombuffer(b"".join([views[k] for k in at]), np.uint8).reshape(-1, w)
            size, counts = table_[:, :4].copy().view("<u4")[:, 0].astype(np.int64), table_[:, 4:]

            def close(a, b):
                apart = (np.maximum(counts[a], counts[b]) - np.minimum(counts[a], counts[b])).sum(axis=1, dtype=np.int64)
                return (100 + percent) * apart <= (100 - percent) * (size[a] + size[b])

            a, b = _forest(marks[at], close)
            left.append(at[a])
            right.append(at[b])
        return np.concatenate(left), np.concatenate(right)

    return met_in_pieces(keyed, found)


def reread_heads(nodes: DataFrame, rows: DataFrame, setting: Setting, common: np.ndarray) -> DataFrame:
    """(node, head) of the nodes (node, locator), whose texts are in ``rows`` (locator, .., text)."""
    texts = nodes.join(rows.select("locator", rows.columns[-1]), "locator").select("node", rows.columns[-1])
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [head_of(np.unique(shingle_hashes(t, setting.shingle)), setting.percent, shared.value) for t in one_by_one(batch.column(1))]
            if heads:
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(heads)], ["node", "head"])
        give_back()

    return texts.mapInArrow(run, "node long, head array<long>")


def close_sets(flat: np.ndarray, edges: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the sets ``flat[edges[k]:edges[k + 1]]`` with that similarity or more."""
    n, size = len(edges) - 1, np.diff(edges)
    values, ids = np.unique(flat, return_inverse=True)
    seen, alive = np.zeros(len(values), bool), np.ones(n, bool)
    owner, rest = np.repeat(np.arange(n), size), ids
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(n):
        front = [first] if alive[first] else []
        alive[first] = False
        while front and alive.any():
            u = front.pop()
            keep = alive[owner]
            owner, rest = owner[keep], rest[keep]
            own = ids[edges[u] : edges[u + 1]]
            seen[own] = True
            shared = np.bincount(owner[seen[rest]], minlength=n)
            seen[own] = False
            near = np.flatnonzero(alive & (100 * shared >= percent * (size[u] + size - shared)))
            alive[near] = False
            left.append(np.full(len(near), u))
            right.append(near)
            front.extend(near.tolist())
    return np.concatenate(left), np.concatenate(right)


def similar(candidates: DataFrame, rows: DataFrame, setting: Setting, cell: int = CELL, shingles: int = CELL_SHINGLES) -> DataFrame:
    """(a, b): links of the ``candidates`` (root, node, locator) whose sets are as similar as asked.

    ``rows`` (locator, .., text) has their texts. All members of a root are compared.
    """
    texts = candidates.join(rows.select("locator", rows.columns[-1]), "locator").select(F.col("root").alias("key"), "node", rows.columns[-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SET_ROWS):  # sets are wider than their texts
                part = batch.slice(at, SET_ROWS)
                sets = [np.unique(shingle_hashes(t, setting.shingle)).tobytes() for t in one_by_one(part.column(2))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sets, pa.binary())], ["key", "node", "hashes"])
        give_back()

    sets = stored(texts.mapInArrow(run, "key long, node long, hashes binary"), "simhash-sets")
    total = F.greatest(F.ceil(F.count(F.lit(1)) / cell), F.ceil(F.sum(F.octet_length("hashes")) / (8 * shingles)), F.lit(1))
    pieces = stored(sets.groupBy("key").agg(total.cast("int").alias("pieces")), "simhash-pieces")

    def found(rows: pa.Table, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        start = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
        for at, stop in zip(start.tolist(), [*start[1:].tolist(), len(marks)]):
            members = [np.frombuffer(h.as_buffer(), np.uint64) for chunk in rows["hashes"].slice(at, stop - at).chunks for h in chunk]
            a, b = close_sets(np.concatenate(members), np.cumsum([0, *map(len, members)]), setting.percent)
            left.append(a + at)
            right.append(b + at)
        return np.concatenate(left), np.concatenate(right)

    return pairs_in_cells(sets, pieces, found)


def _marks(rows: pa.Table) -> np.ndarray:
    """The number of the group that each row belongs to."""
    columns = [rows[c].to_numpy() for c in ("key", "p", "q")]
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.cumsum(np.concatenate([[0], new.astype(np.int64)]))


def grouped(rows: DataFrame, setting: Setting) -> DataFrame:
    """The rows (locator if sets are compared, doc_id, text) with print, component (a node) and component_id."""
    printed = stored(fingerprints(rows, setting).withColumn("uid", F.monotonically_increasing_id()), "simhash-prints")
    wide = [F.first(c).alias(c) for c in ("head", "views") if setting.percent]
    nodes = stored(printed.groupBy("print").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least"), *wide), "simhash-nodes")
    near = links(nodes.select("node", "print"), setting)
    if setting.percent:
        places = printed.select(F.col("uid").alias("node"), "locator")
        near = near.unionByName(
            alike(nodes.select("node", "head", "views"), lambda some, common: reread_heads(some.join(places, "node"), rows, setting, common), setting)
        )
        loose = components(near, "simhash-candidates").join(places, "node")
        near = similar(loose, rows, setting)
    roots = components(near, "simhash-links")
    placed = nodes.join(roots, "node", "left").select("print", "least", F.coalesce("root", "node").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    # Only this table of nodes, never the documents, is grouped by component.
    of_print = stored(placed.join(named, "component").select("print", "component", "component_id"), "simhash-components")
    return printed.select(*rows.columns[:-1], "print").join(of_print, "print")


def near_groups(docs: DataFrame, setting: Setting = NARROW, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (hex), component_id."""
    rows = docs.select(F.col(identity).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return grouped(rows, setting).select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, setting: Setting = WIDE, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the smallest id stays."""
    found = located(docs)
    rows = grouped(found.select("locator", F.col(f"doc.{identity}").cast("long").alias("doc_id"), F.col(f"doc.{text}").alias("text")), setting)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "locator")).alias("f")).select("f.locator")
    return found.join(first, "locator", "left_semi").select("doc.*")


@query("op1_simhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"))
