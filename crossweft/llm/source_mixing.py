"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source is cut into shards of about ``shard_tokens`` words, every shard into blocks of
``block_tokens`` words that run across its documents in a seeded order. Seats (blocks to
take) go to sources, then to each source's shards, by highest quotients ``votes / (2j - 1)``.
Only seats near the dividing line are spelled out: with ``n`` parties, a party of share
``p`` ends within ``n * p / 2 + 1`` seats of its exact share, so about four rows a party
decide the whole allocation, however many blocks there are. A shard's seats are spread over
its blocks in whole rounds, and the rest goes to blocks in seeded order.

Defined cases: a null or empty text has size 0 and nothing is taken from it. A null source
is a source of its own, last in order. Equal quotients go to the earlier source or shard.
Repeated rows are separate documents; rows that are equal in ``doc_id`` and text are
interchangeable. Shards are dealt by id and text, so many null or repeated ids spread too. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweft.llm.exact_dedup import located
from crossweft.llm.registry import query
from crossweft.llm.tables import WORD, stored, table

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2

BLOCK_TOKENS = 32
TEXT_BLOCK_TOKENS = 256  # where texts are really cut: most documents stay in one piece
SHARD_TOKENS = 1 << 20
SEED = "mix-1"


def _hash32(*parts):
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, s_ix, source_size, target): weights in turn by name, capped and reshared.

    Resharing what is above a cap by weight until nothing is above equals one common level
    ``target = min(cap, level * weight)``. Sources reach their cap in order of cap / weight,
    so the level is read off running sums over the table of sources (one row a source).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "s_ix")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("s_ix", F.row_number().over(by_name).cast("long"))
        .withColumn("w", F.element_at(weights, F.pmod(F.col("s_ix") - 1, F.lit(len(WEIGHTS))).cast("int") + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * MAX_REPEATS)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
        .withColumn(
            "level",
            (F.sum("source_size").over(everything) * F.lit(TOTAL_SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))),
        )
        .withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
        .withColumn("level", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct("ratio", "s_ix"))).over(everything))
        .select(
            "source",
            "s_ix",
            "source_size",
            F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")), F.col("cap").cast("double")).alias("target"),
        )
    )


def apportion(parties: DataFrame, group: str, party: str, votes: str, seats: str) -> DataFrame:
    """Add ``won``: each group's ``seats`` shared among its parties by highest quotients."""
    whole = Window.partitionBy(group)
    ranked = Window.partitionBy(group).orderBy(F.col("_q").desc(), party)
    near = (
        parties.withColumn("_v", F.col(votes).cast("double"))
        .withColumn("_all", F.sum("_v").over(whole))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_ideal", F.when(F.col("_all") > 0, F.col("_v") * F.col(seats) / F.col("_all")).otherwise(0.0))
        .withColumn("_slack", F.when(F.col("_all") > 0, F.col("_n") * F.col("_v") / (2 * F.col("_all"))).otherwise(0.0) + 1)
        .withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_ideal") - F.col("_slack"))).cast("long"))
        .withColumn("_high", F.ceil(F.col("_ideal") + F.col("_slack")).cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    )
    won = (
        near.select(group, party, "_left", "_v", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_j"))
        .where("_v > 0")
        .withColumn("_q", F.col("_v") / (2 * F.col("_j") - 1))
        .withColumn("_rank", F.row_number().over(ranked))
        .where("_rank <= _left")
        .groupBy(group, party)
        .agg(F.count(F.lit(1)).alias("_more"))
    )
    return near.join(won, [group, party], "left").select(
        *[near[c] for c in parties.columns], (F.col("_low") + F.coalesce("_more", F.lit(0))).alias("won")
    )


def _allocate(rows: DataFrame, block_tokens: int, shard_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(laid, chosen) for rows (row, doc_id, source, size, digest).

    ``laid``: every document's place in its shard; ``chosen``: every block with the times it
    is taken, and the sum of those times over the blocks before it.
    """
    sizes = stored(rows, "mix-sizes")
    targets = stored(source_targets(sizes), "mix-targets")

    placed = (
        sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long"))
        .withColumn("h", _hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("digest")))
        .withColumn("shard", F.pmod("h", "shards"))
    )
    in_shard = Window.partitionBy("s_ix", "shard").orderBy("h", "doc_id", "digest", "row").rowsBetween(Window.unboundedPreceding, 0)
    laid = stored(
        placed.withColumn("stop", F.sum("size").over(in_shard))
        .withColumn("start", F.col("stop") - F.col("size"))
        .withColumn("pos", F.row_number().over(in_shard))
        .select("row", "doc_id", "source", "size", "source_size", "target", "s_ix", "shard", "pos", "start", "stop"),
        "mix-laid",
    )

    seats = targets.withColumn("all_seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_tokens).cast("long"))
    by_source = apportion(seats.withColumn("one", F.lit(0)), "one", "s_ix", "target", "all_seats").select("s_ix", F.col("won").alias("source_seats"))
    shard_sizes = laid.groupBy("s_ix", "shard").agg(F.sum("size").alias("tokens"))
    by_shard = apportion(shard_sizes.join(by_source, "s_ix"), "s_ix", "shard", "tokens", "source_seats")

    # Stored: a repartition by the keys of the join above would be optimised away.
    quotas = stored(
        by_shard.where("tokens > 0")
        .withColumn("blocks", F.ceil(F.col("tokens") / block_tokens).cast("long"))
        .withColumn("won", F.least("won", F.col("blocks") * MAX_REPEATS)),
        "mix-quotas",
    )
    lottery = Window.partitionBy("s_ix", "shard").orderBy("ticket", "block")
    in_order = Window.partitionBy("s_ix", "shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = (
        quotas.repartition(n, "s_ix", "shard")  # before blocks are spelled out: few rows make one task else
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("ticket", _hash32(*[F.col(c).cast("string") for c in ("s_ix", "shard", "block")]))
        .withColumn("draw", F.row_number().over(lottery))
        .withColumn("times", F.floor(F.col("won") / F.col("blocks")) + (F.col("draw") <= F.col("won") % F.col("blocks")).cast("long"))
        .withColumn("earlier", F.coalesce(F.sum("times").over(in_order), F.lit(0)))
        .select("s_ix", "shard", "block", "times", "earlier")
    )
    # Planned by the size of the quotas it is spelled out from, it would be sent to the driver whole.
    return laid, chosen.hint("merge")


def _sized(identity: str, text: str, source: str) -> list[Column]:
    return [
        F.col(identity).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
    ]


def mix(
    docs: DataFrame,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    identity: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken."""
    rows = docs.select(F.lit(0).alias("row"), *_sized(identity, text, source))
    laid, chosen = _allocate(rows, block_tokens, shard_tokens)
    # Words taken up to a position: whole earlier blocks, and the part of its own block.
    edge = lambda at, block, sign: F.struct(F.col(at).alias("at"), F.floor(block / block_tokens).alias("block"), F.lit(sign).alias("sign"))
    keys = ["s_ix", "shard", "pos"]
    taken = (
        laid.where("size > 0")
        .select(*keys, F.explode(F.array(edge("start", F.col("start"), -1), edge("stop", F.col("stop") - 1, 1))).alias("e"))
        .select(*keys, "e.*")
        .join(chosen, ["s_ix", "shard", "block"])
        .groupBy(*keys)
        .agg(F.sum(F.col("sign") * (F.col("earlier") * block_tokens + (F.col("at") - F.col("block") * block_tokens) * F.col("times"))).alias("taken"))
    )
    return laid.join(taken, keys, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(
    docs: DataFrame,
    block_tokens: int = TEXT_BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    identity: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken.

    A document taken whole keeps its text. Where some of its blocks are left out, the words
    of the others remain, joined by one space; a document of which nothing is taken goes.
    """
    found = located(docs)
    inner = [f"doc.{c}" for c in (identity, text, source)]
    laid, chosen = _allocate(found.select(F.col("locator").alias("row"), *_sized(*inner)), block_tokens, shard_tokens)
    spans = (
        laid.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_tokens), F.floor((F.col("stop") - 1) / block_tokens))))
        .join(chosen.where("times > 0"), ["s_ix", "shard", "block"])
        .withColumn("at", F.greatest("start", F.col("block") * block_tokens) - F.col("start"))
        .withColumn("words", F.least(F.col("stop"), (F.col("block") + 1) * block_tokens) - F.col("start") - F.col("at"))
        .groupBy("row", "size")
        .agg(F.sort_array(F.collect_list(F.struct("at", "words", "times"))).alias("spans"))
    )
    rounds = (
        found.join(spans, F.col("locator") == F.col("row"))
        .withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max("spans.times"))))
        .withColumn("spans", F.filter("spans", lambda s: s["times"] >= F.col("round")))
        .withColumn("held", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"]))
    )
    words = F.regexp_extract_all(F.col(f"doc.{text}"), F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["at"] + 1).cast("int"), s["words"].cast("int")))), " ")
    cut = F.when(F.col("held") == F.col("size"), F.col(f"doc.{text}")).otherwise(part)
    return rounds.select(*[cut.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns])


def _sql(block: int = BLOCK_TOKENS, shard: int = SHARD_TOKENS, documents: str = "documents") -> str:
    def hash32(*parts: str) -> str:
        joined = " || '|' || ".join(["'" + SEED + "'", *parts])
        return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"

    def won(name: str, parties: str, group: str, party: str, votes: str, seats: str) -> str:
        return f"""
    {name}_near AS (
      SELECT *, greatest(0, CAST(floor(ideal - slack) AS BIGINT)) AS low, CAST(ceil(ideal + slack) AS BIGINT) AS high
      FROM (SELECT *, CASE WHEN al > 0 THEN v * {seats} / al ELSE 0.0 END AS ideal,
                   CASE WHEN al > 0 THEN n * v / (2 * al) ELSE 0.0 END + 1 AS slack
            FROM (SELECT *, CAST({votes} AS DOUBLE) AS v, sum(CAST({votes} AS DOUBLE)) OVER (PARTITION BY {group}) AS al,
                         count(*) OVER (PARTITION BY {group}) AS n FROM {parties}))),
    {name}_left AS (SELECT *, {seats} - sum(low) OVER (PARTITION BY {group}) AS rest FROM {name}_near),
    {name}_more AS (
      SELECT {group}, {party}, count(*) AS more FROM (
        SELECT {group}, {party}, rest, row_number() OVER (PARTITION BY {group} ORDER BY v / (2 * j - 1) DESC, {party}) AS r
        FROM (SELECT *, unnest(range(low + 1, high + 1)) AS j FROM {name}_left) WHERE v > 0)
      WHERE r <= rest GROUP BY ALL),
    {name} AS (SELECT a.*, low + coalesce(more, 0) AS won FROM {name}_left a LEFT JOIN {name}_more b
      ON a.{group} = b.{group} AND a.{party} = b.{party})"""

    return f"""
    WITH sizes AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size, md5(coalesce(text, '')) AS digest FROM {documents}),
    named AS (
      SELECT *, [5, 2, 1][(s_ix - 1) % 3 + 1] AS w, 2 * source_size AS cap, 0 AS one FROM (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS s_ix
        FROM sizes GROUP BY source)),
    levels AS (
      SELECT *, (sum(source_size) OVER () * CAST({TOTAL_SHARE} AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM named WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, s_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (
      SELECT source, s_ix, source_size, one, coalesce(least(CAST(cap AS DOUBLE),
               (SELECT level FROM levels WHERE level * w < cap ORDER BY CAST(cap AS DOUBLE) / w, s_ix LIMIT 1) * w), CAST(cap AS DOUBLE)) AS target
      FROM levels),
    seats AS (SELECT *, CAST(round(sum(target) OVER () / {block}) AS BIGINT) AS all_seats FROM targets),
    {won('sources', 'seats', 'one', 's_ix', 'target', 'all_seats')},
    placed AS (
      SELECT *, h % greatest(1, CAST(ceil(source_size / {shard}) AS BIGINT)) AS shard FROM (
        SELECT d.doc_id, d.source, d.size, d.digest, t.source_size, t.target, t.s_ix, {hash32("coalesce(CAST(d.doc_id AS VARCHAR), 'null')", "d.digest")} AS h
        FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)),
    laid AS (
      SELECT *, CAST(sum(size) OVER w AS BIGINT) AS stop, row_number() OVER w AS pos
      FROM placed WINDOW w AS (PARTITION BY s_ix, shard ORDER BY h, doc_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    shards AS (
      SELECT a.s_ix, a.shard, a.tokens, b.won AS source_seats
      FROM (SELECT s_ix, shard, CAST(sum(size) AS BIGINT) AS tokens FROM laid GROUP BY ALL) a JOIN sources b ON a.s_ix = b.s_ix),
    {won('by_shard', 'shards', 's_ix', 'shard', 'tokens', 'source_seats')},
    quotas AS (
      SELECT s_ix, shard, blocks, least(won, 2 * blocks) AS won
      FROM (SELECT s_ix, shard, won, CAST(ceil(tokens / {block}) AS BIGINT) AS blocks FROM by_shard WHERE tokens > 0)),
    drawn AS (
      SELECT *, won // blocks + CASE WHEN row_number() OVER (PARTITION BY s_ix, shard ORDER BY
          {hash32('CAST(s_ix AS VARCHAR)', 'CAST(shard AS VARCHAR)', 'CAST(b AS VARCHAR)')}, b) <= won % blocks THEN 1 ELSE 0 END AS times
      FROM (SELECT *, unnest(range(0, blocks)) AS b FROM quotas)),
    taken AS (
      SELECT l.s_ix, l.shard, l.pos, CAST(sum(times * (least(stop, (b + 1) * {block}) - greatest(stop - size, b * {block}))) AS BIGINT) AS taken
      FROM (SELECT *, unnest(range((stop - size) // {block}, (stop - 1) // {block} + 1)) AS k FROM laid WHERE size > 0) l
      JOIN drawn d ON l.s_ix = d.s_ix AND l.shard = d.shard AND l.k = d.b GROUP BY ALL)
    SELECT l.doc_id, l.source, l.size, l.source_size, l.target, coalesce(t.taken, 0) AS taken
    FROM laid l LEFT JOIN taken t ON l.s_ix = t.s_ix AND l.shard = t.shard AND l.pos = t.pos"""


@query("op7_source_mixing", _sql())
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))
