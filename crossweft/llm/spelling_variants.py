"""Spelling variants by a relational trie frontier.

Words live in two tries, of the words and of the words read backwards. A trie is a table of
edges (node, label, child, what can come next), one table for each level; up to ``PLAIN`` code points deep a
label is one code point, below that labels grow with the depth, so that very long words need
few levels. A node is known by the hash of its prefix.

The frontier holds states (word, target, position, node, edits). A word's own path, without
edits, lies in the trie by construction. At a level it meets the node's edges, and a state
with one edit arises for each edge that replaces the word's next code point by a larger one,
or that skips it. From then on the rest must match, and a state moves on by joining its only
possible child with the edge table of the level; where none is, it ends. A terminal
state, whose word is used up at the end of a word of the trie, is a pair of neighbours. As an edge
says which code points can come next, most states that would end at once never start.

Each pair is found from one side: the longer word, or that with the smaller code point at the
place where they differ, and then mirrored. An edit in the back half of a word is looked for in
the forward trie, one in the front half in the backward trie, so edits start only
below half a word, where few edges leave a node. Work is so in proportion to words and their
near prefixes. Edge tables are stored, so Spark splits a node with many words.

Words are counted before they are shuffled. Forms (the near word of largest count, if that is
``ratio`` times the word's) and roots are joins of the pair table; a chain of forms multiplies
the count by ``ratio`` at each step, and is followed by doubling.

Defined cases: null and empty texts have no words; a null id counts as empty in the hash that
decides which runs lose a code point. Repeated rows count repeatedly. An empty table gives an
empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweft.llm.registry import query
from crossweft.llm.tables import UPPER, stored, table

#: Fixed values of the contract: letters of a run, the share of runs that lose one, least sizes.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
DAMAGED, LEAST_LETTERS, LEAST_COUNT, RATIO = 31, 7, 2, 10

#: Depth down to which labels are single code points.
PLAIN = 32


def words(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): counted letter runs, of which one in ``DAMAGED`` has lost a code point."""
    runs = docs.select(F.coalesce(F.col(identity).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= LEAST_LETTERS)
    plain = F.octet_length("run") == F.char_length("run")
    low = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, UPPER.lower())).alias("run"))
    hashed = low.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    seen = hashed.withColumn("at", at).select(F.when(F.pmod("h", F.lit(DAMAGED)) == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = seen.where(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def depths(longest: int) -> list[int]:
    """Where the labels of the levels begin: every code point down to ``PLAIN``, then ever farther apart."""
    out = list(range(min(longest, PLAIN) + 1))
    while out[-1] < longest:
        out.append(out[-1] + max(1, out[-1] // 2))
    return out


def _part(text: str, start: int | str, size: int | str) -> str:
    return f"substring({text}, {start} + 1, {size})"


def _bits(letter: str, ends: str) -> tuple[str, str]:
    """Two numbers with the bit of one code point: a-z and the end of a word, and the rest of a run's letters."""
    low = f"IF({ends}, 1L << 26, IF(ascii({letter}) < 128, shiftleft(1L, ascii({letter}) - 97), 0L))"
    return low, f"IF({ends} OR ascii({letter}) < 128, 0L, shiftleft(1L, ascii({letter}) - 192))"


def _allowed(letter: str, ends: str) -> str:
    low, high = _bits(letter, ends)
    return f"((next_low & {low}) | (next_high & {high})) != 0"


def edges(tries: DataFrame, start: int, stop: int) -> DataFrame:
    """(way, node, label, child, next_low, next_high): the tries' edges between two depths.

    The last two are sets of bits: the code points that come next, and whether a word ends here.
    """
    low, high = _bits(_part("word", stop, 1), f"letters <= {stop}")
    at = tries.where(F.col("letters") > start).selectExpr(
        "way",
        f"xxhash64(way, {_part('word', 0, start)}) AS node",
        f"{_part('word', start, stop - start)} AS label",
        f"xxhash64(way, {_part('word', 0, stop)}) AS child",
        f"{low} AS low",
        f"{high} AS high",
    )
    return at.groupBy("way", "node", "label", "child").agg(F.bit_or("low").alias("next_low"), F.bit_or("high").alias("next_high"))


def first_edits(tries: DataFrame, here: DataFrame, start: int, stop: int) -> DataFrame:
    """States with one edit that arise on the edges between two depths; ``position``: code points used."""
    own = tries.where((F.col("letters") > start) & (F.col("half") < stop)).selectExpr("way", "word", "letters", f"xxhash64(way, {_part('word', 0, start)}) AS node")
    met = own.join(here, ["way", "node"]).withColumn("size", F.char_length("label"))
    same, longer = _part("word", start, "size"), _part("word", start, "size + 1")
    swapped, dropped = f"label > {same}", f"label = {_part('word', start + 1, 1)} AND label != {same}"
    if stop - start > 1:
        swapped = f"{swapped} AND levenshtein(label, {same}) = 1 AND letters >= {start} + size"
        dropped = f"label != {same} AND levenshtein(label, {longer}) = 1 AND letters > {start} + size"
    states = met.withColumn("shift", F.explode(F.expr(f"filter(array(IF({swapped}, 0, NULL), IF({dropped}, 1, NULL)), x -> x IS NOT NULL)")))
    states = states.withColumn("position", F.expr(f"{start} + size + shift")).where(_allowed(_part("word", "position", 1), "position >= letters"))
    target = F.expr(f"concat({_part('word', 0, start)}, label, substring(word, position + 1))")
    return states.select("way", "word", target.alias("target"), "position", F.col("child").alias("node"), F.lit(1).alias("edits"), (F.col("position") >= F.col("letters")).alias("terminal"))


def moved_on(moving: DataFrame, here: DataFrame, start: int, stop: int) -> DataFrame:
    """States one level deeper: at the only child that the rest of their target allows, where it exists."""
    label = F.expr(_part("target", start, stop - start))
    asked = moving.select("way", "word", "target", "position", "edits", F.char_length(label).alias("size"), F.expr(f"xxhash64(way, {_part('target', 0, stop)})").alias("child"))
    over = f"char_length(target) <= {stop}"
    met = asked.join(here.select("way", "child", "next_low", "next_high"), ["way", "child"]).where(_allowed(_part("target", stop, 1), over))
    return met.select("way", "word", "target", (F.col("position") + F.col("size")).alias("position"), F.col("child").alias("node"), "edits", F.expr(over).alias("terminal"))


def neighbours(counted: DataFrame) -> DataFrame:
    """(word, near): every pair of words that differ by one inserted, deleted or replaced code point, both ways."""
    longest = counted.agg(F.max(F.char_length("word"))).first()[0] or 0
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("word")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("word")))).alias("t")
    tries = counted.select(ways).select("t.way", "t.word").withColumn("letters", F.char_length("word"))
    # Every place of a word lies behind the half of exactly one way.
    tries = stored(tries.withColumn("half", F.expr("IF(way = 0, letters DIV 2, letters - letters DIV 2)")), "variant-tries")
    first = (tries.agg(F.min("half")).first()[0] or 0) if longest else 0
    bounds = depths(longest)
    found, moving = [], None
    for start, stop in zip(bounds, bounds[1:]):
        if stop <= first:
            continue
        here = stored(edges(tries, start, stop), "variant-edges")
        fresh = first_edits(tries, here, start, stop)
        if moving is not None:
            fresh = fresh.unionByName(moved_on(moving, here, start, stop))
        states = stored(fresh, "variant-states")
        found.append(states.where("terminal").select("way", "word", "target"))
        moving = states.where("NOT terminal")
    # A word without its last code point (its first, read backwards) ends before the last level of the word.
    shorter = tries.selectExpr("way", "word", "substring(word, 1, letters - 1) AS target")
    pairs = shorter.join(tries.select("way", F.col("word").alias("target")), ["way", "target"]).select("way", "word", "target")
    for more in found:
        pairs = pairs.unionByName(more)
    plain = pairs.select(F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word")).alias("a"), F.when(F.col("way") == 0, F.col("target")).otherwise(F.reverse("target")).alias("b"))
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")
    # Hashes stand for prefixes, so the words themselves are compared at last; a target that
    # is no word, should hashes ever clash, finds no count later.
    return plain.where("levenshtein(a, b) = 1").distinct().select(both).select("p.word", "p.near")


def variants(docs: DataFrame, identity: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """One row a word: word, n, n_near, form, form_n, root."""
    counted = stored(words(docs, identity, text), "variant-words")
    pairs = neighbours(counted).join(counted.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    large = -F.col("best.less") >= ratio * F.col("n")
    named = counted.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("best.near")).alias("form"),
        F.when(large, -F.col("best.less")).alias("form_n"),
    )
    named = stored(named, "variant-forms")
    steps = stored(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "variant-steps")
    while True:
        # Each step's root is replaced by that root's own, so lengths of paths double.
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-steps")
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return named.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_spelling_variants")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return variants(table(spark, folder, "documents"))
