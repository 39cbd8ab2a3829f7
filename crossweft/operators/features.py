"""One-hot, TF-IDF and max-abs features as long tables and sparse rows.

Items of both tables are one frame keyed by ``(domain, item_id)``, one row an item. Terms are
counted inside that row, so raw texts never cross the network: what is shuffled are term
totals when fitting, and the sparse rows themselves when transforming.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweft.functions.text import column_text, to_number, with_bigrams, words
from crossweft.operators.ordering import global_row_number
from crossweft.operators.schema import FeatureSchema
from crossweft.session import durable

KEY = ["domain", "item_id"]
# Default vocabulary cap and minimum document count.
MAX_TEXT_FEATURES = 3_000
MIN_TEXT_DF = 1
# Vocabularies up to this many bytes are sent to every executor; of larger ones the heaviest part.
BROADCAST_VOCAB = 32 << 20
# Inputs up to so many bytes a core may be scanned by fewer tasks than there are cores.
SPREAD_BYTES = 64 << 20
# Buckets of the frequency sketch for each term of the cap, and buckets first looked at.
SKETCH_BUCKETS, FIRST_BUCKETS = 64, 2
# An entry that every item has, so that items without any feature keep a row.
MARKER, MARKER_ID = "", -1


def union_domains(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Both tables as one frame; columns only one of them has are null for the other."""
    return queries.withColumn("domain", F.lit("q")).unionByName(
        catalog.withColumn("domain", F.lit("c")), allowMissingColumns=True
    )


def one_hot_entries(columns: tuple[str, ...]) -> list[Column]:
    return [
        F.struct(
            F.concat(F.lit(f"cat:{c}_"), F.col(c)).alias("feature"),
            F.lit("cat").alias("kind"),
            F.lit(i).alias("ord"),
            F.lit(1.0).alias("value"),
        )
        for i, c in enumerate(columns)
    ]


def one_hot(items: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(domain, item_id, feature, kind, ord, value=1) for every category value."""
    entries = items.select(*KEY, F.explode(F.array(*one_hot_entries(columns))).alias("e"))
    return entries.select(*KEY, "e.*").where(F.col("feature").isNotNull())


def computed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a last column that is computed once, however often it is used.

    Projections are merged, and what a lambda refers to would be computed anew for each
    element; a generated row is not merged.
    """
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def spread(items: DataFrame) -> DataFrame:
    """Small inputs, by the size of what they read, dealt to all cores; larger ones stay where they are."""
    leaves = items._jdf.queryExecution().optimizedPlan().collectLeaves()
    volume = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    cores = items.sparkSession.sparkContext.defaultParallelism
    return items.repartition(cores) if volume <= SPREAD_BYTES * cores else items


def tokenised(items: DataFrame, text: Column, bigrams: bool, *keep: Column | str) -> DataFrame:
    """(keep.., __terms): every term of an item, repeats included."""
    found = spread(items).select(*keep, F.explode(F.array(words(text))).alias("__words"))
    terms = with_bigrams(F.col("__words")) if bigrams else F.col("__words")
    return found.select(*found.columns[:-1], terms.alias("__terms"))


def counted_terms(rows: DataFrame) -> DataFrame:
    """``__terms`` as (term, tf), counted inside the row: sorted, then cut where the term changes."""
    kept = rows.columns[:-1]
    ordered = computed(rows, "__t", F.sort_array("__terms")).select(*kept, "__t")
    places = F.when(F.size("__t") > 0, F.sequence(F.lit(0), F.size("__t") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("__t", i) != F.get("__t", i - 1)))
    cut = computed(ordered, "__s", starts)
    runs = F.transform(
        "__s",
        lambda i, k: F.struct(
            F.get("__t", i).alias("term"), (F.coalesce(F.get("__s", k + 1), F.size("__t")) - i).cast("long").alias("tf")
        ),
    )
    return cut.select(*kept, runs.alias("__terms"))


def term_counts(items: DataFrame, text: Column, bigrams: bool = True) -> DataFrame:
    """(domain, item_id, term, tf), without a shuffle."""
    rows = counted_terms(tokenised(items, text, bigrams, *KEY))
    return rows.select(*KEY, F.explode("__terms").alias("e")).select(*KEY, "e.term", "e.tf")


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df, cf): items holding the term and its total count."""
    return counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    )


def cap_vocabulary(frequency: DataFrame, max_features: int | None, min_df: int) -> DataFrame:
    """Most frequent terms that occur in at least ``min_df`` items; ties by term."""
    kept = frequency.where(F.col("df") >= min_df)
    if max_features is None:
        return kept
    return kept.orderBy(F.col("cf").desc(), "term").limit(max_features)


def frequent_terms(
    items: DataFrame, text: Column, bigrams: bool, cap: int | None, min_df: int, buckets: int | None = None
) -> DataFrame:
    """(term, df, cf) of the capped vocabulary, without a shuffle of all distinct terms.

    Terms are hashed into buckets whose totals are summed first. A bucket's total bounds the
    count of each of its terms from above, and such sums merge in any order. Terms of the
    fullest buckets are counted exactly; their ``cap``-th count bounds the vocabulary from
    below, so that terms of buckets under it are out. Only if buckets not looked at yet reach
    that bound, theirs are counted too. The result is exact whatever the distribution: if all
    buckets reach the bound, all terms are counted.
    """
    if cap is None:
        return document_frequency(term_counts(items, text, bigrams)).where(F.col("df") >= min_df)
    if cap <= 0:
        return document_frequency(term_counts(items, text, bigrams)).limit(0)
    width = buckets or 1 << (SKETCH_BUCKETS * cap - 1).bit_length()

    def bucket(term: str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(width)).cast("int")

    raw = tokenised(items, text, bigrams).select(F.explode("__terms").alias("term"))
    totals = durable(raw.groupBy(bucket("term").alias("bucket")).agg(F.count(F.lit(1)).alias("total")))

    def counted(chosen: DataFrame) -> DataFrame:
        # At most ``width`` numbers, whatever the data: small enough for every executor.
        asked = term_counts(items, text, bigrams).withColumn("bucket", bucket("term"))
        frequency = document_frequency(asked.join(F.broadcast(chosen.select("bucket")), "bucket", "left_semi"))
        return durable(cap_vocabulary(frequency, cap, min_df))

    fullest = durable(totals.orderBy(F.col("total").desc(), "bucket").limit(FIRST_BUCKETS * cap))
    kept = counted(fullest)
    size, bound = kept.agg(F.count(F.lit(1)), F.min("cf")).first()
    rest = totals.join(F.broadcast(fullest.select("bucket")), "bucket", "left_anti")
    # A bucket at the bound could hold a term that ties and comes first by name.
    missed = durable(rest if size < cap else rest.where(F.col("total") >= bound))
    if missed.isEmpty():
        return kept
    return cap_vocabulary(kept.unionByName(counted(missed)), cap, min_df)


def idf(n_items: int) -> Column:
    return F.log((1.0 + n_items) / (1.0 + F.col("df"))) + 1.0


def numeric_scales(items: DataFrame, columns: tuple[str, ...]) -> dict[str, float]:
    """Largest absolute value per column, 1 for an all-zero column."""
    if not columns:
        return {}
    row = items.agg(
        *[F.max(F.abs(F.coalesce(to_number(F.col(c)), F.lit(0.0)))).alias(c) for c in columns]
    ).first()
    return {c: row[c] or 1.0 for c in columns}


def scaled_entries(scales: dict[str, float]) -> list[Column]:
    return [
        F.struct(
            F.lit(f"num:{c}").alias("feature"),
            F.lit("num").alias("kind"),
            F.lit(i).alias("ord"),
            (F.coalesce(to_number(F.col(c)), F.lit(0.0)) / F.lit(float(s))).alias("value"),
        )
        for i, (c, s) in enumerate(scales.items())
    ]


def scaled(items: DataFrame, scales: dict[str, float]) -> DataFrame:
    """(domain, item_id, feature, kind, ord, value) of the non-zero scaled numbers."""
    entries = items.select(*KEY, F.explode(F.array(*scaled_entries(scales))).alias("e"))
    return entries.select(*KEY, "e.*").where(F.col("value") != 0)


@dataclass(frozen=True)
class FeatureSpace:
    """Fitted state. ``vocab(feature_id, feature, kind, ord, idf)`` is a table."""

    schema: FeatureSchema
    vocab: DataFrame
    scales: dict[str, float]
    n_features: int
    title_only: bool = False
    vocab_bytes: int | None = None

    def lookup(self, kind: str) -> DataFrame:
        part = self.vocab.where(F.col("kind") == kind)
        small = self.vocab_bytes is not None and self.vocab_bytes <= BROADCAST_VOCAB
        return F.broadcast(part) if small else part

    def text(self) -> Column:
        return F.col("title").cast("string") if self.title_only else column_text(self.schema.text)


def fit(
    items: DataFrame,
    schema: FeatureSchema,
    max_text_features: int | None = MAX_TEXT_FEATURES,
    min_text_df: int = MIN_TEXT_DF,
) -> FeatureSpace:
    """Learn vocabulary, idf and scales over both tables.

    Ids run over categories (column, then value), terms (alphabetical), numbers
    (column order). Without any block, titles alone are used, single words only.
    """
    n_items = items.count()
    space = FeatureSpace(schema, items, numeric_scales(items, schema.numeric), 0)
    blocks = []
    if schema.categorical:
        blocks.append(
            one_hot(items, schema.categorical)
            .groupBy("kind", "ord", "feature")
            .agg(F.lit(None).cast("double").alias("idf"))
            .withColumn("block", F.lit(0))
        )
    if schema.text:
        blocks.append(
            _term_block(items, n_items, space.text(), True, max_text_features, min_text_df)
        )
    if schema.numeric:
        blocks.append(
            items.sparkSession.createDataFrame(
                [("num", i, f"num:{c}", None, 2) for i, c in enumerate(schema.numeric)],
                "kind string, ord int, feature string, idf double, block int",
            )
        )
    union, n_features, size = _union_blocks(blocks)
    if not n_features:
        space = replace(space, title_only=True)
        union, n_features, size = _union_blocks(
            [_term_block(items, n_items, space.text(), False, None, 1)]
        )
    keys = [("block", True), ("ord", True), ("feature", True)]
    numbered = global_row_number(union, keys, "n", n=n_features)
    vocab = numbered.select(
        (F.col("n") - 1).cast("int").alias("feature_id"), "feature", "kind", "ord", "idf"
    )
    return replace(space, vocab=durable(vocab), n_features=n_features, vocab_bytes=size)


def _union_blocks(blocks: list[DataFrame]) -> tuple[DataFrame | None, int, int]:
    """The vocabulary so far, its rows and its rough bytes."""
    if not blocks:
        return None, 0, 0
    union = blocks[0]
    for block in blocks[1:]:
        union = union.unionByName(block)
    union = durable(union)
    size = F.coalesce(F.sum(F.octet_length("feature") + 32), F.lit(0))
    return union, *union.agg(F.count(F.lit(1)), size).first()


def _term_block(
    items: DataFrame, n_items: int, text: Column, bigrams: bool, cap: int | None, min_df: int
) -> DataFrame:
    return frequent_terms(items, text, bigrams, cap, min_df).select(
        F.lit("txt").alias("kind"),
        F.lit(0).alias("ord"),
        F.concat(F.lit("txt:"), "term").alias("feature"),
        idf(n_items).alias("idf"),
        F.lit(1).alias("block"),
    )


def entries(items: DataFrame, space: FeatureSpace) -> DataFrame:
    """(domain, item_id, feature, kind, value): all features of all items, known or not, in one scan."""
    fixed = [F.struct(F.lit(MARKER).alias("feature"), F.lit("").alias("kind"), F.lit(0).alias("ord"), F.lit(1.0).alias("value"))]
    fixed += one_hot_entries(space.schema.categorical) + scaled_entries(space.scales)
    keep = [*KEY, F.array(*fixed).alias("__fixed")]
    if space.schema.text or space.title_only:
        rows = counted_terms(tokenised(items, space.text(), not space.title_only, *keep))
        terms = F.transform(
            "__terms",
            lambda e: F.struct(
                F.concat(F.lit("txt:"), e["term"]).alias("feature"),
                F.lit("txt").alias("kind"),
                F.lit(0).alias("ord"),
                e["tf"].cast("double").alias("value"),
            ),
        )
        found = rows.select(*KEY, F.explode(F.concat("__fixed", terms)).alias("e"))
    else:
        found = items.select(*keep).select(*KEY, F.explode("__fixed").alias("e"))
    return found.select(*KEY, "e.feature", "e.kind", "e.value").where("feature IS NOT NULL AND (kind != 'num' OR value != 0)")


def known_entries(found: DataFrame, space: FeatureSpace, limit: int | None = None) -> DataFrame:
    """(domain, item_id, feature_id, value, is_text) of the entries that have a vocabulary row.

    A vocabulary within the limit goes to every executor. Of a larger one the terms of smallest
    idf do, which are in most items, with all categories and numbers as long as these fit: a
    feature that could make a task hot is answered there, and only the others are shuffled.
    """
    limit = BROADCAST_VOCAB if limit is None else limit
    vocab = space.vocab.select("feature", "kind", "feature_id", "idf")
    marker = vocab.sparkSession.createDataFrame([(MARKER, "", MARKER_ID, None)], vocab.schema)
    size = space.vocab_bytes
    if size is None:
        size = vocab.agg(F.coalesce(F.sum(F.octet_length("feature") + 32), F.lit(0))).first()[0]
    if size <= limit:
        met = found.join(F.broadcast(vocab.unionByName(marker)), ["feature", "kind"])
    else:
        heavy = max(1, int(limit * space.n_features / size))
        first = durable(vocab.orderBy(F.col("idf").asc_nulls_first(), "feature").limit(heavy).unionByName(marker))
        asked = found.join(F.broadcast(first), ["feature", "kind"], "left")
        light = vocab.join(F.broadcast(first.select("feature_id")), "feature_id", "left_anti")
        rest = asked.where("feature_id IS NULL").drop("feature_id", "idf").join(light, ["feature", "kind"])
        met = asked.where("feature_id IS NOT NULL").unionByName(rest, allowMissingColumns=True)
    is_text = F.col("kind") == "txt"
    value = F.when(is_text, F.col("value") * F.col("idf")).otherwise(F.col("value"))
    return met.select(*KEY, "feature_id", value.alias("value"), is_text.alias("is_text"))


def transform(items: DataFrame, space: FeatureSpace, limit: int | None = None) -> DataFrame:
    """(domain, item_id, idx, val): one sparse row per item, seen before or not.

    Unknown categories and terms simply find no vocabulary row. Items without any
    feature keep an empty row. Item ids are unique within a table.
    """
    known = known_entries(entries(items, space), space, limit)
    rows = known.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("feature_id", "value", "is_text"))).alias("f"))
    # The marker has the smallest id of all. Squares are added in the order of ids, on any partitioning.
    rows = computed(rows, "f", F.slice("f", F.lit(2), F.size("f")))
    square = F.aggregate("f", F.lit(0.0), lambda s, e: F.when(e["is_text"], s + e["value"] * e["value"]).otherwise(s))
    rows = computed(rows, "length", F.sqrt(square))
    val = F.transform(
        "f", lambda e: F.when(e["is_text"], e["value"] / F.col("length")).otherwise(e["value"])
    )
    return rows.select(*KEY, F.col("f.feature_id").alias("idx"), val.alias("val"))


def long_rows(sparse: DataFrame) -> DataFrame:
    """(domain, item_id, feature_id, value) of sparse rows."""
    return sparse.select(*KEY, F.explode(F.arrays_zip("idx", "val")).alias("e")).select(
        *KEY, F.col("e.idx").alias("feature_id"), F.col("e.val").alias("value")
    )
