"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once, with that speaker as
the assistant, everybody else as a named user and system messages as they are. The mask
lists the character spans to train on: the text and closing marker of the assistant's turns.

A conversation is rendered whole up to ``SEGMENT_BYTES`` bytes. A longer one is cut between
messages into segments of about that size, so one that holds a large part of all rows is many
rows and never one group: messages are dealt by key ranges, the bytes before each are summed
inside its range and shifted by the ranges before. ``n_messages`` counts a segment's own messages.

The query leaves nothing out (``whole``): every participant of the conversation has a row in every
segment, those without a word of that participant too, and the spans count from the start of the
conversation. ``rendered`` put end to end by segment is the whole dialogue, never held in one
group. Its SQL has examples of their own for the segments of a long conversation, as ``rotate``
without ``whole`` gives them: every later segment opens with the conversation's first system
message as context, and a speaker who is silent in a segment gets no example of it. Both are the
same rows wherever no conversation exceeds ``SEGMENT_BYTES``.

Defined cases: a null role is the speaker ``unknown``; a null text is empty; null turns come
last. Messages of one turn are ordered by role, then text; equal rows are messages of their
own. Rows without a conversation id are conversations of one message each. Speakers differ as
their roles differ; in the rendered name ``%``, ``<`` and white space are percent-encoded.
Markers that occur in a text are broken by a space, so a text cannot close its turn.
Conversations of system messages alone have no participant and no row. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweft.llm.registry import query
from crossweft.llm.tables import stored, table

SEGMENT_BYTES = 1 << 16
MESSAGE_BYTES = 32  # counted for the markers of a message, so that empty ones count too
START, END = "<|im_start|>", "<|im_end|>"
#: What a rendered name may not hold, and its percent code.
CODES = {c: f"%{ord(c):02X}" for c in "% <\t\n\v\f\r"}


def _head(name: Column, speaker: Column) -> Column:
    shown = name
    for char, code in CODES.items():
        shown = F.replace(shown, F.lit(char), F.lit(code))
    return (
        F.when(name == "system", F.lit(f"{START}system\n"))
        .when(name == speaker, F.lit(f"{START}assistant\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), shown, F.lit("\n")))
    )


def _segments(messages: DataFrame, segment_bytes: int) -> DataFrame:
    """``messages`` with ``before``, the bytes ahead in its conversation, and ``segment``."""
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    talk, order = ["conv_id", "alone"], ["late", "turn", "name", "text", "row"]
    dealt = stored(messages.repartitionByRange(n, *talk, *order).withColumn("slot", F.spark_partition_id()), "chat-messages")
    ahead = Window.partitionBy(*talk).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    # Conversations that go on from an earlier range: at most one a range, so they travel.
    offsets = (
        dealt.where("conv_id is not null")
        .groupBy(*talk, "slot")
        .agg(F.sum("weight").alias("total"))
        .withColumn("offset", F.sum("total").over(ahead))
        .where("offset is not null")
        .select("conv_id", "slot", "offset")
    )
    inside = Window.partitionBy("slot", *talk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("inner", F.coalesce(F.sum("weight").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), ["conv_id", "slot"], "left")
        .withColumn("before", F.col("inner") + F.coalesce("offset", F.lit(0)))
        .withColumn("segment", F.floor(F.col("before") / segment_bytes).cast("long"))
    )


def rotate(conversations: DataFrame, segment_bytes: int = SEGMENT_BYTES, whole: bool = False) -> DataFrame:
    """One row a conversation, segment and speaker: messages, rendered text and spans.

    ``whole``: the segments are the consecutive pieces of one example a speaker.
    """
    messages = (
        conversations.select(
            F.col("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("name"),
            F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("text"),
            F.monotonically_increasing_id().alias("row"),
        )
        .withColumn("alone", F.when(F.col("conv_id").isNull(), F.col("row")))
        .withColumn("late", F.col("turn").isNull())
        .withColumn("weight", (F.octet_length("text") + F.octet_length("name") + MESSAGE_BYTES).cast("long"))
    )
    placed = _segments(messages, segment_bytes)
    said = placed.select("conv_id", "alone", "segment", F.struct(F.lit(True).alias("own"), "late", "turn", "name", "text").alias("m"))
    first_system = F.min(F.when(F.col("name") == "system", F.struct("before", "segment", "text"))).alias("first")
    context = (
        placed.where("conv_id is not null")
        .groupBy("conv_id")
        .agg(F.max("segment").alias("last"), first_system)
        .where(F.col("last") > F.col("first.segment"))
        .select("conv_id", "first.text", F.explode(F.sequence(F.col("first.segment") + 1, F.col("last"))).alias("segment"))
        .select(
            "conv_id",
            F.lit(None).cast("long").alias("alone"),
            "segment",
            F.struct(
                F.lit(False).alias("own"), F.lit(True).alias("late"), F.lit(None).cast("long").alias("turn"), F.lit("system").alias("name"), "text"
            ).alias("m"),
        )
    )
    shown = said if whole else said.unionByName(context)
    dialogues = shown.groupBy("conv_id", "alone", "segment").agg(F.array_sort(F.collect_list("m")).alias("said"))
    if whole:
        of = placed.where("name <> 'system'").select(F.col("conv_id").alias("c"), F.col("alone").alias("a"), F.col("name").alias("speaker")).distinct()
        views = dialogues.join(of, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("alone").eqNullSafe(F.col("a"))).drop("c", "a")
    else:
        views = dialogues.withColumn("speaker", F.explode(F.filter(F.array_distinct(F.col("said.name")), lambda s: s != "system")))
    pieces = F.transform(
        "said",
        lambda m: F.struct(
            _head(m["name"], F.col("speaker")).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), (m["name"] == F.col("speaker")).alias("own")
        ),
    )
    lengths = F.transform("pieces", lambda p: F.struct(F.char_length(p["head"]).alias("h"), F.char_length(p["body"]).alias("b"), p["own"].alias("own")))
    views = views.withColumn("pieces", pieces)
    first, kind = F.lit(0), "int"
    if whole:
        # Only the lengths of the pieces meet by speaker, to place each behind the ones before.
        size = F.aggregate(lengths, F.lit(0).cast("long"), lambda n, p: n + p["h"] + p["b"] + 1)
        by = ["c", "a", "s"]
        ahead = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        at = views.select(F.col("conv_id").alias("c"), F.col("alone").alias("a"), F.col("speaker").alias("s"), F.col("segment").alias("k"), size.alias("size"))
        at = at.select(*by, "k", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("first"))
        same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(("conv_id", "alone", "speaker", "segment"), (*by, "k"))]
        views = views.join(at, same).drop(*by, "k")
        first, kind = F.col("first"), "bigint"
    start = F.struct(first.alias("at"), F.array().cast(f"array<struct<start:{kind},stop:{kind}>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + p["h"]
        span = F.array(F.struct(begin.alias("start"), (begin + p["b"]).alias("stop")))
        return F.struct(
            (begin + p["b"] + 1).alias("at"), F.when(p["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        )

    return (
        views.withColumn("spans", F.aggregate(lengths, start, step, lambda state: state["spans"]))
        .select(
            "conv_id",
            "segment",
            "speaker",
            F.size(F.filter("said", lambda m: m["own"])).cast("long").alias("n_messages"),
            F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
            "spans",
        )
    )


def _sql(segment_bytes: int = SEGMENT_BYTES) -> str:
    shown = "m.name"
    for char, code in CODES.items():
        shown = f"replace({shown}, chr({ord(char)}), '{code}')"
    order = "own, turn NULLS LAST, name, text, row"
    return f"""
    WITH m0 AS (
      SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS name,
             replace(coalesce(text, ''), '<|im_', '<| im_') AS text, row_number() OVER () AS row FROM conversations),
    m1 AS (
      SELECT *, CASE WHEN conv_id IS NULL THEN row END AS alone, strlen(text) + strlen(name) + {MESSAGE_BYTES} AS weight FROM m0),
    m2 AS (
      SELECT *, CAST(coalesce(sum(weight) OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS LAST, name, text, row
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM m1),
    m3 AS (SELECT *, before // {segment_bytes} AS segment, true AS own FROM m2),
    s AS (SELECT conv_id, min(segment) AS at, arg_min(text, before) AS text FROM m3 WHERE name = 'system' GROUP BY conv_id),
    m AS (
      SELECT conv_id, alone, segment, own, turn, name, text, row FROM m3
      UNION ALL
      SELECT s.conv_id, NULL, d.segment, false, NULL, 'system', s.text, 0
      FROM s JOIN (SELECT DISTINCT conv_id, segment FROM m3) d ON s.conv_id = d.conv_id AND d.segment > s.at),
    v AS (SELECT DISTINCT conv_id, alone, segment, name AS speaker FROM m WHERE name <> 'system'),
    p AS (
      SELECT v.conv_id, v.alone, v.segment, v.speaker, m.own, m.turn, m.name, m.text, m.row, m.name = v.speaker AS mine, m.text || '{END}' AS body,
             CASE WHEN m.name = 'system' THEN '{START}system' || chr(10) WHEN m.name = v.speaker THEN '{START}assistant' || chr(10)
                  ELSE '{START}user name=' || {shown} || chr(10) END AS head
      FROM v JOIN m ON v.conv_id IS NOT DISTINCT FROM m.conv_id AND v.alone IS NOT DISTINCT FROM m.alone AND v.segment = m.segment),
    o AS (
      SELECT *, CAST(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, alone, segment, speaker
               ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS stop FROM p)
    SELECT conv_id, segment, speaker, count(*) FILTER (WHERE own) AS n_messages,
           string_agg(head || body || chr(10), '' ORDER BY {order}) AS rendered,
           string_agg((stop - length(body)) || ':' || stop, ',' ORDER BY {order}) FILTER (WHERE mine) AS mask
    FROM o GROUP BY conv_id, alone, segment, speaker"""


@query("op4_chat_format", _sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return masked(rotate(table(spark, folder, "conversations"), whole=True))


def masked(rotated: DataFrame) -> DataFrame:
    """The spans as ``start:stop`` joined by commas."""
    mask = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return rotated.select("conv_id", "segment", "speaker", "n_messages", "rendered", mask.alias("mask"))
