"""Train, save, load, recommend, build playlists and evaluate, end to end."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweft.functions import vectors
from crossweft.operators import arc, dictionary, explain, features, lsh, metrics, relevance, rerank, steering, titles
from crossweft.operators.blocks import sent_if_small
from crossweft.operators.schema import FeatureSchema
from crossweft.operators.similarity import top_scored
from crossweft.session import durable
from crossweft.sources import artifacts
from crossweft.sources.tables import PreparedPair

SEED = 42


@dataclass(frozen=True)
class Settings:
    n_components: int = 32
    alpha: float = 0.25
    batch_size: int = 512
    use_minibatch: bool = True
    max_iter: int | None = None
    max_text_features: int | None = features.MAX_TEXT_FEATURES
    min_text_df: int = features.MIN_TEXT_DF
    ann_bits: int | None = None  # as many as suit the catalog
    seed: int = SEED


@dataclass(frozen=True)
class Trained:
    pair: PreparedPair
    space: features.FeatureSpace
    model: dictionary.Dictionary
    codes: DataFrame
    planes: np.ndarray | None
    items: DataFrame
    settings: Settings = field(default_factory=Settings)

    def query_vectors(self) -> DataFrame:
        return self.codes.where("domain = 'q'").select(F.col("item_id").alias("qid"), F.col("code").alias("vec"))

    def catalog(self) -> DataFrame:
        """Catalog columns with ``vec`` and bucket ``key``."""
        return self.items


def keyed_catalog(pair: PreparedPair, codes: DataFrame, planes: np.ndarray | None) -> DataFrame:
    """The catalog with ``vec``, and with bucket keys if there are planes."""
    key = [] if planes is None else [lsh.lsh_key(F.col("code"), planes).alias("key")]
    coded = codes.where("domain = 'c'").select("item_id", F.col("code").alias("vec"), *key)
    return pair.catalog.join(coded, "item_id")


def train(pair: PreparedPair, settings: Settings = Settings()) -> Trained:
    items = features.union_domains(pair.queries, pair.catalog)
    space = features.fit(items, pair.schema, settings.max_text_features, settings.min_text_df)
    rows = durable(features.transform(items, space))
    model = dictionary.fit(
        rows,
        space.n_features,
        settings.n_components,
        settings.alpha,
        settings.seed,
        settings.use_minibatch,
        settings.batch_size,
        settings.max_iter,
    )
    codes = durable(dictionary.encode(rows, model))
    bits = settings.ann_bits or lsh.fitting_bits(pair.catalog.count())
    planes = lsh.hyperplanes(bits, settings.n_components, settings.seed)
    items = durable(keyed_catalog(pair, codes, planes))
    return Trained(pair, space, model, codes, planes, items, settings)


def training_summary(trained: Trained) -> DataFrame:
    """One row: sizes, sparsity, buckets and run parameters."""
    s = trained.settings
    counts = trained.codes.agg(
        F.count(F.when(F.col("domain") == "q", 1)).alias("query_items"),
        F.count(F.when(F.col("domain") == "c", 1)).alias("catalog_items"),
        F.count(F.lit(1)).alias("total_items"),
        (
            F.sum(F.size(F.filter("code", lambda x: x == 0))) / F.sum(F.size("code")) * 100.0
        ).alias("sparsity_pct"),
    )
    indexed = trained.planes is not None
    buckets = trained.items.select("key").distinct().count() if indexed else 0
    objective = trained.model.objective[-1] if trained.model.objective else None
    return counts.withColumns(
        {
            "ann_buckets": F.lit(buckets).cast("long"),
            "feature_dim": F.lit(trained.space.n_features),
            "n_components": F.lit(s.n_components),
            "alpha": F.lit(s.alpha),
            "ann_bits": F.lit(len(trained.planes) if indexed else 0),
            "objective": F.lit(objective).cast("double"),
        }
    )


def save(trained: Trained, folder: str) -> None:
    spark = trained.codes.sparkSession
    schema, space = trained.pair.schema, trained.space
    roles = {"categorical": schema.categorical, "numeric": schema.numeric, "text": schema.text}
    roles |= {"source_type": trained.pair.source_type}
    config = {"title_only": space.title_only, "n_features": space.n_features, "vocab_bytes": space.vocab_bytes}
    fitted = {"alpha": trained.model.alpha, "objective": trained.model.objective, "settings": asdict(trained.settings)}
    summary = training_summary(trained).withColumns(
        {name: F.lit(json.dumps(value, sort_keys=True)) for name, value in (("schema", roles), ("feature_config", config), ("scales", space.scales))}
    )
    index = {}
    if trained.planes is not None:
        index["ann"] = trained.catalog().select("item_id", "key")
        index["hyperplanes"] = artifacts.matrix_table(spark, trained.planes, "bit", "plane")
    artifacts.save(
        {
            "atoms": artifacts.matrix_table(spark, trained.model.atoms, "atom", "weights"),
            "codes": trained.codes,
            "model": artifacts.json_row(spark, fitted),
            "item_keys": trained.codes.select("domain", "item_id"),
            "vocab": space.vocab,
            "scales": artifacts.json_row(spark, space.scales),
            "feature_config": artifacts.json_row(spark, config),
            "schema": artifacts.json_row(spark, roles),
            "training_metadata": summary,
            **index,
        },
        folder,
    )


def load(spark: SparkSession, folder: str, pair: PreparedPair) -> Trained:
    """Trained state for the given tables; fails when they are not the trained ones.

    Bucket keys and the planes behind them come together or not at all; without them
    there is no index and every recommendation is exact.
    """
    found = artifacts.load(spark, folder)
    current = features.union_domains(pair.queries, pair.catalog).select("domain", "item_id")
    artifacts.require_same_items(found["item_keys"], current)
    atoms = artifacts.table_matrix(found["atoms"], "atom", "weights")
    model = artifacts.read_json_row(found["model"])
    roles = artifacts.read_json_row(found["schema"]) if "schema" in found else None
    schema = (
        FeatureSchema(tuple(roles["categorical"]), tuple(roles["numeric"]), tuple(roles["text"]))
        if roles
        else pair.schema
    )
    config = artifacts.read_json_row(found["feature_config"]) if "feature_config" in found else {}
    space = features.FeatureSpace(
        schema,
        found["vocab"] if "vocab" in found else spark.createDataFrame([], "feature_id int, feature string, kind string, ord int, idf double"),
        artifacts.read_json_row(found["scales"]) if "scales" in found else {},
        config.get("n_features", atoms.shape[1]),
        config.get("title_only", False),
        config.get("vocab_bytes"),
    )
    planes = artifacts.table_matrix(found["hyperplanes"], "bit", "plane") if "hyperplanes" in found else None
    items = keyed_catalog(pair, found["codes"], None)
    if planes is not None:
        items = items.join(found["ann"].select("item_id", "key"), "item_id")
    settings = Settings(**model.get("settings", {"n_components": len(atoms), "alpha": model["alpha"]}))
    fitted = dictionary.Dictionary(atoms, model["alpha"], model["objective"])
    # Joined once: every later request reads the catalog several times.
    return Trained(pair, space, fitted, found["codes"], planes, durable(items), settings)


def recommend(
    queries: DataFrame,
    catalog: DataFrame,
    planes: np.ndarray | None,
    top_n: int = 5,
    request: steering.Request = steering.Request(),
    text_columns: Sequence[str] = (),
    use_ann: bool = True,
    search_k: int = 256,
    radius: int = 2,
    diversify: bool = True,
    labels: DataFrame | None = None,
) -> DataFrame:
    """(qid, rank, item_id, title, artist, similarity, score, method, pool_size[, explanation]).

    ``queries(qid, vec)``; ``catalog(item_id, title, artist, vec, key, ...)``.
    """
    dim = vectors.vector_dim(catalog, "vec")
    shifted, biased = steering.steer(queries, catalog, request, dim, text_columns)
    pool = lsh.retrieve(shifted, biased, planes, top_n, search_k, radius, use_ann)
    depth = max(rerank.POOL_FACTOR * top_n, top_n) if diversify else top_n
    ranked = rerank.rank_by_score(pool, depth)
    # One more pass over the catalog brings vectors and titles to the short lists.
    shown = catalog.select("item_id", "title", "artist", F.col("vec").cast("array<double>").alias("vec"))
    final = _attach(ranked, shown, _bounded(queries, depth))
    if diversify:
        final = final.persist()
        final = final.drop("rank").join(rerank.diversify(final, top_n), ["qid", "item_id"])
    columns = ["qid", "rank", "item_id", "title", "artist", "similarity", "score", "method", "pool_size"]
    if labels is not None:
        codes = queries.select("qid", F.col("vec").alias("query_code"))
        pairs = final.withColumnRenamed("vec", "item_code").join(codes, "qid")
        final = explain.explain_pairs(pairs, labels)
        columns.append("explanation")
    return final.select(*columns)


def _bounded(queries: DataFrame, per_query: int) -> int:
    return queries.count() * per_query


def _attach(rows: DataFrame, catalog: DataFrame, n_rows: int) -> DataFrame:
    """Catalog columns for result rows; results of known small size go to the scan."""
    return catalog.join(sent_if_small(rows, n_rows), "item_id")


def recommend_titles(
    trained: Trained, texts: DataFrame, min_score: float = titles.MIN_SCORE, explained: bool = False, **options
) -> tuple[DataFrame, DataFrame]:
    """(recommendations, title suggestions) for ``texts(qid, text)``.

    Texts without an accepted title only have suggestions.
    """
    found = titles.match_titles(texts, trained.pair.queries, min_score=min_score).persist()
    codes = trained.query_vectors().withColumnRenamed("qid", "item_id")
    matched = found.where("accepted").select("qid", "item_id").join(codes, "item_id").select("qid", "vec")
    labels = None
    if explained:
        table = dictionary.atoms_table(texts.sparkSession, trained.model)
        labels = explain.atom_labels(table, trained.space.vocab)
    results = recommend(
        matched.persist(), trained.catalog(), trained.planes,
        text_columns=trained.space.schema.text, labels=labels, **options,
    )
    return results, found


def playlist(
    queries: DataFrame,
    catalog: DataFrame,
    planes: np.ndarray | None,
    stages: int = 3,
    per_stage: int = 3,
    use_ann: bool = True,
    search_k: int = 512,
) -> DataFrame:
    """(qid, stage_no, stage, stage_rank, item_id, title, artist, arc_score, similarity, novelty, energy)."""
    if per_stage < 1:
        raise ValueError("per_stage must be at least 1.")
    stages = max(1, stages)
    heads = []
    exact_queries = queries
    if use_ann and planes is not None:
        size = max(search_k, 20 * stages * per_stage)
        items = catalog.drop("bias")
        plan = lsh.plan_probes(queries, items, planes, size, 2, 5 * stages * per_stage)
        found = lsh.probed_pools(plan, items, size, size, with_fallback=False)
        raw = catalog.select("item_id", *arc.raw_energy(catalog))
        pool = _attach(found, raw, _bounded(queries, size))
        heads.append(arc.stage_heads_from_pool(arc.pool_energy(pool, catalog), stages, per_stage))
        exact_queries = plan.policy.where("method <> 'ann'").select("qid", "vec")
    heads.append(
        arc.stage_heads_exact(exact_queries, arc.catalog_energy(catalog.drop("bias")), stages, per_stage)
    )
    shape = ["qid", "stage_no", "stage", "place", "item_id", "arc_score", "similarity", "energy"]
    union = heads[0].select(*shape)
    for part in heads[1:]:
        union = union.unionByName(part.select(*shape))
    picks = arc.pick_stages(union, stages, per_stage)
    return _attach(
        picks, catalog.select("item_id", "title", "artist"), _bounded(queries, stages * per_stage)
    ).select(
        "qid", "stage_no", "stage", "stage_rank", "item_id", "title", "artist",
        "arc_score", "similarity", "novelty", "energy",
    )


def in_holdout(key, share: float = 0.2, seed: int = SEED):
    """True for about ``share`` of the keys, the same ones on any partitioning."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10_000
    return bucket < int(round(share * 10_000))


# Most keys of the border group of an exact hold-out that are looked at on the driver.
BORDER_KEYS = 10_000


def exact_holdout(rows: DataFrame, key: str, share: float = 0.2, seed: int = SEED):
    """True for exactly ``floor(share * n + 0.5)`` of ``n`` rows with unique keys, on any partitioning.

    The keys with the smallest hashes are held out. The last of them is found by counting:
    hashes are counted by their first 12 bits, then the group that holds it by the next 12, until
    that group is small. Rows of one repeated key stay together; rows without a key stay in.
    """
    text = F.col(key).cast("string")
    digest = F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{seed}"))), 1, 15), 16, 10).cast("bigint")
    group = rows.where(text.isNotNull()).select(digest.alias("h"), text.alias("key"))
    left = int(math.floor(share * group.count() + 0.5))
    if left <= 0:
        return F.lit(False)
    for shift in (48, 36, 24, 12, 0):
        counts = sorted(group.groupBy(F.shiftright("h", shift).alias("part")).count().collect())
        for part, size in counts:
            if left <= size:
                break
            left -= size
        group = group.where(F.shiftright("h", shift) == part)
        if size <= BORDER_KEYS:
            break
    for h, last, size in sorted(group.groupBy("h", "key").count().collect()):
        left -= size
        if left <= 0:
            break
    return F.coalesce((digest < h) | ((digest == h) & (text <= last)), F.lit(False))


def evaluate(
    pair: PreparedPair,
    settings: Settings = Settings(n_components=20, alpha=1.0),
    ks: Sequence[int] = metrics.DEFAULT_KS,
    share: float = 0.2,
    exact_share: bool = False,
) -> tuple[DataFrame, int]:
    """(metric rows per K, number of held-out items): fit without them, rank exactly.

    ``exact_share`` holds out exactly that share of the query items, at the cost of counting their keys.
    """
    if exact_share:
        held = exact_holdout(pair.queries, "item_id", share, settings.seed)
    else:
        held = in_holdout(F.col("item_id"), share, settings.seed)
    test = pair.queries.where(held)
    trained = train(
        PreparedPair(pair.queries.where(~held), pair.catalog, pair.schema, pair.source_type, pair.fills), settings
    )
    rows = features.transform(test.withColumn("domain", F.lit("q")), trained.space)
    codes = durable(dictionary.encode(rows, trained.model))
    queries = codes.select(F.col("item_id").alias("qid"), F.col("code").alias("vec"))
    catalog = trained.catalog()
    ranked = top_scored(queries, catalog.select("item_id", "vec"), max(ks)).persist()
    asked = test.withColumnRenamed("item_id", "qid")
    n_ranked = ranked.count()
    judged, counts = relevance.judge(ranked, asked, pair.catalog, pair.schema, n_ranked)
    judged = _attach(judged, catalog.select("item_id", "vec"), n_ranked)
    per_query = metrics.query_metrics(judged, counts, ks, settings.n_components)
    covered = metrics.coverage(ranked, pair.catalog.count(), ks)
    return metrics.summary(per_query, covered), test.count()
