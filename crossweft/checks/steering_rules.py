"""Rules, prototypes, bonuses, diversity and explanations on embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossweft.checks.registry import query, table
from crossweft.checks.retrieval import BITS, DIM, SIMS_SQL, keyed, policy_sql, vectors
from crossweft.functions import vectors as V
from crossweft.operators import explain, rerank, steering
from crossweft.operators.similarity import top_scored
from crossweft.plans import model

REQUEST = steering.Request(
    prefer={"lang": ["EN", " fr ", ""], "Source": ["src1", "src3", "src1"], "nowhere": ["x"]},
    avoid={"label": ["3", "7"], "lang": ["de"]},
    boost_terms=["tion", " ou ", "on."],
)
TEXT = ["text"]


def described_catalog(spark, folder):
    """Embeddings with the metadata of the document of the same number."""
    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "item_id")
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    _, catalog, planes = keyed(spark, folder)
    full = catalog.join(labels, "item_id").join(docs, "item_id", "left")
    return (
        full.withColumn("title", F.concat_ws("-", "source", "item_id"))
        .withColumn("artist", F.coalesce("lang", F.lit("Unknown Artist")))
        .withColumn("tempo", F.coalesce("n_chars", F.lit(0)))
    ), planes


CATALOG_SQL = """
cat AS (SELECT vec_id AS item_id, label, v, u, lang, source, text, coalesce(n_chars, 0) AS tempo,
               concat_ws('-', source, vec_id::VARCHAR) AS title, coalesce(lang, 'Unknown Artist') AS artist
        FROM u LEFT JOIN documents d ON d.doc_id = u.vec_id),
scored AS (
    SELECT *, coalesce(lower(lang) IN ('en', 'fr'), false)::INT + coalesce(lower(source) IN ('src1', 'src3'), false)::INT AS prefer,
           (label IN (3, 7))::INT + coalesce(lower(lang) IN ('de'), false)::INT AS avoid,
           coalesce(contains(lower(text), 'tion')::INT + contains(lower(text), 'ou')::INT + contains(lower(text), 'on.')::INT, 0) AS hits
    FROM cat),
bonus AS (SELECT item_id, 0.08 * prefer - 0.10 * avoid + 0.06 * hits AS bonus FROM scored),
proto AS (
    SELECT pos, sum(prefer * v[pos]) / sum(prefer) AS p, sum(avoid * v[pos]) / sum(avoid) AS a
    FROM scored, range(1, 65) r(pos) GROUP BY pos),
protos AS (SELECT list(p ORDER BY pos) AS p, list(a ORDER BY pos) AS a FROM proto),
moved AS (SELECT vec_id AS qid, list_transform(range(1, 65), lambda i: v[i] + 0.35 * p[i] - 0.35 * a[i]) AS m FROM u, protos),
shifted AS (SELECT qid, list_transform(m, lambda x: x / n) AS s FROM (SELECT *, sqrt(list_dot_product(m, m)) AS n FROM moved)),
steered AS (SELECT s.qid, c.item_id, list_dot_product(s.s, c.u) AS sim, b.bonus
            FROM shifted s, cat c JOIN bonus b ON b.item_id = c.item_id)
"""


@query(
    "constraint_scores",
    f"WITH {SIMS_SQL}, {CATALOG_SQL} SELECT item_id, prefer::DOUBLE AS prefer, avoid::DOUBLE AS avoid FROM scored",
    "D4 L1 L2 H4 C11",
)
def constraint_scores(spark, folder):
    catalog, _ = described_catalog(spark, folder)
    return catalog.select(
        "item_id",
        steering.match_score(catalog, REQUEST.prefer).alias("prefer"),
        steering.match_score(catalog, REQUEST.avoid).alias("avoid"),
    )


@query(
    "rule_prototypes",
    f"WITH {SIMS_SQL}, {CATALOG_SQL} SELECT pos::INT AS pos, round(p, 6) AS prefer, round(a, 6) AS avoid FROM proto",
    "E11 L3",
)
def rule_prototypes(spark, folder):
    catalog, _ = described_catalog(spark, folder)
    found = steering.prototypes(catalog, {"prefer": REQUEST.prefer, "avoid": REQUEST.avoid}, DIM)
    rows = [(i + 1, p, a) for i, (p, a) in enumerate(zip(found["prefer"], found["avoid"]))]
    return spark.createDataFrame(rows, "pos int, prefer double, avoid double").select(
        "pos", F.round("prefer", 6).alias("prefer"), F.round("avoid", 6).alias("avoid")
    )


@query(
    "shifted_queries",
    f"""
    WITH {SIMS_SQL}, {CATALOG_SQL}
    SELECT qid, pos::INT AS pos, round(s[pos + 1], 6) AS value FROM shifted, range(64) r(pos)
    """,
    "L4",
)
def shifted_queries(spark, folder):
    queries, _ = vectors(spark, folder)
    catalog, _ = described_catalog(spark, folder)
    moved, _ = steering.steer(queries, catalog, REQUEST, DIM, TEXT)
    return moved.select("qid", F.posexplode("vec").alias("pos", "x")).select("qid", "pos", F.round("x", 6).alias("value"))


@query(
    "metadata_bonus",
    f"WITH {SIMS_SQL}, {CATALOG_SQL} SELECT item_id, round(bonus, 6)::DOUBLE AS bonus FROM bonus",
    "L5 C15",
)
def metadata_bonus(spark, folder):
    catalog, _ = described_catalog(spark, folder)
    return catalog.select("item_id", F.round(steering.bonus(catalog, REQUEST, TEXT), 6).alias("bonus"))


@query(
    "steered_exact_scores",
    f"""
    WITH {SIMS_SQL}, {CATALOG_SQL}
    SELECT qid, item_id, round(sim, 6) AS similarity, round(sim + bonus, 6) AS score, r::INT AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim + bonus, 6) DESC, item_id) AS r FROM steered) WHERE r <= 50
    """,
    "L6 G4 G5 D8",
)
def steered_exact_scores(spark, folder):
    queries, _ = vectors(spark, folder)
    catalog, _ = described_catalog(spark, folder)
    moved, biased = steering.steer(queries, catalog, REQUEST, DIM, TEXT)
    return top_scored(moved, biased, 50).select(
        "qid", "item_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "rank"
    )


def mmr_sql(source, top_n):
    """Greedy selection over the best 10 * top_n rows of ``source(qid, item_id, sim, score)``."""
    return f"""
pool AS (
    SELECT p.qid, p.item_id, p.sim, p.score, c.u, row_number() OVER (PARTITION BY p.qid ORDER BY round(p.score, 6) DESC, p.item_id) AS pos
    FROM {source} p JOIN u c ON c.vec_id = p.item_id QUALIFY pos <= {10 * top_n}),
pooled AS (SELECT qid, list(u ORDER BY pos) AS us, list(score ORDER BY pos) AS ss, count(*) AS n FROM pool GROUP BY qid),
sel AS (
    SELECT qid, 1 AS step, [1::BIGINT] AS chosen FROM pooled
    UNION ALL
    SELECT qid, step + 1, list_append(chosen, pos) FROM (
        SELECT s.qid, s.step, s.chosen, c.pos,
               row_number() OVER (PARTITION BY s.qid ORDER BY
                   CASE WHEN p.n <= {top_n} THEN 0 ELSE round(0.78 * p.ss[c.pos] - 0.22 * list_max(list_transform(s.chosen, lambda k:
                        list_dot_product(p.us[c.pos], p.us[k]))), 6) END DESC, c.pos) AS r
        FROM sel s JOIN pooled p ON p.qid = s.qid, range(1, {10 * top_n + 1}) c(pos)
        WHERE s.step < {top_n} AND c.pos <= p.n AND NOT list_contains(s.chosen, c.pos)) WHERE r = 1),
final AS (
          SELECT qid, k AS rank, chosen[k] AS pos FROM (
              SELECT qid, chosen, unnest(range(1, len(chosen) + 1)) AS k FROM (
                  SELECT qid, arg_max(chosen, step) AS chosen FROM sel GROUP BY qid)))
"""


@query(
    "diverse_top_items",
    f"""
    WITH RECURSIVE {SIMS_SQL}, scores AS (SELECT qid, item_id, sim, sim AS score FROM sims), {mmr_sql('scores', 5)}
    SELECT f.qid, f.rank::INT AS rank, p.item_id FROM final f JOIN pool p ON p.qid = f.qid AND p.pos = f.pos
    """,
    "L7",
)
def diverse_top_items(spark, folder):
    queries, catalog = vectors(spark, folder)
    pool = top_scored(queries, catalog, 50)
    return rerank.diversify(rerank.attach_vectors(pool, catalog), 5).select("qid", "rank", "item_id")


def _final_columns(df):
    return df.withColumn("similarity", F.round("similarity", 6)).withColumn("score", F.round("score", 6))


@query(
    "recommend_exact_steered",
    f"""
    WITH RECURSIVE {SIMS_SQL}, {CATALOG_SQL}, scores AS (SELECT qid, item_id, sim, sim + bonus AS score FROM steered),
    {mmr_sql('scores', 5)}
    SELECT f.qid, f.rank::INT AS rank, p.item_id, c.title, c.artist, round(p.sim, 6) AS similarity, round(p.score, 6) AS score,
           'exact' AS method, (SELECT count(*) FROM cat) AS pool_size
    FROM final f JOIN pool p ON p.qid = f.qid AND p.pos = f.pos JOIN cat c ON c.item_id = p.item_id
    """,
    "L9 L4 L5 L6 L7 F2",
)
def recommend_exact_steered(spark, folder):
    queries, _ = vectors(spark, folder)
    catalog, planes = described_catalog(spark, folder)
    return _final_columns(model.recommend(queries, catalog, planes, 5, REQUEST, TEXT, use_ann=False))


@query(
    "recommend_hashed",
    f"""
    WITH RECURSIVE {policy_sql(5, 60, 1, BITS, 150)}, {CATALOG_SQL.replace('steered AS', 'unused AS')},
    nearest AS (SELECT p.*, b.bonus, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 6) DESC, p.item_id) AS near
                FROM pools p JOIN bonus b ON b.item_id = p.item_id),
    scores AS (SELECT qid, item_id, sim, sim + bonus AS score FROM nearest WHERE near <= 150 OR method <> 'ann'),
    {mmr_sql('scores', 5)}
    SELECT f.qid, f.rank::INT AS rank, p.item_id, c.title, c.artist, round(p.sim, 6) AS similarity, round(p.score, 6) AS score,
           o.method, o.pool_size
    FROM final f JOIN pool p ON p.qid = f.qid AND p.pos = f.pos JOIN cat c ON c.item_id = p.item_id
         JOIN (SELECT DISTINCT qid, method, pool_size FROM pools) o ON o.qid = f.qid
    """,
    "L9 K6 L5 L6 L7 G5",
)
def recommend_hashed(spark, folder):
    """Boost terms only: the query itself is not shifted, the pool comes from buckets."""
    queries, _ = vectors(spark, folder)
    catalog, planes = described_catalog(spark, folder)
    request = steering.Request(REQUEST.prefer, REQUEST.avoid, REQUEST.boost_terms, strength=0.0)
    return _final_columns(model.recommend(queries, catalog, planes, 5, request, TEXT, search_k=60, radius=1))


ATOMS_SQL = """
atoms AS (SELECT label AS atom, pos - 1 AS feature_id, avg(v[pos]) AS weight FROM u, range(1, 65) r(pos) GROUP BY label, pos),
codes AS (SELECT vec_id, atom, sum(v[feature_id + 1] * weight) AS x FROM u, atoms GROUP BY vec_id, atom),
labels AS (SELECT atom, 'A' || atom || ':' || string_agg('f' || feature_id, ', ' ORDER BY r) AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY atom ORDER BY round(abs(weight), 6) DESC, feature_id) AS r FROM atoms) WHERE r <= 3 GROUP BY atom),
strong AS (
    SELECT q.qid, q.item_id, a.atom, row_number() OVER (PARTITION BY q.qid, q.item_id ORDER BY round(abs(a.x) * abs(b.x), 6) DESC, a.atom) AS r
    FROM best q JOIN codes a ON a.vec_id = q.qid JOIN codes b ON b.vec_id = q.item_id AND b.atom = a.atom)
"""


@query(
    "atom_explanations",
    f"""
    WITH {SIMS_SQL},
    best AS (SELECT qid, item_id FROM sims QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sim, 6) DESC, item_id) <= 5),
    {ATOMS_SQL}
    SELECT qid, item_id, string_agg(label, ' | ' ORDER BY r) AS explanation
    FROM strong JOIN labels USING (atom) WHERE r <= 3 GROUP BY qid, item_id
    """,
    "L8 G6 D10",
)
def atom_explanations(spark, folder):
    """Atoms are the mean vectors per label; a code is the projection on each of them."""
    queries, catalog = vectors(spark, folder)
    vecs = table(spark, folder, "embeddings")
    means = vecs.select("label", F.posexplode("embedding").alias("feature_id", "x")).groupBy("label", "feature_id").agg(
        F.avg(F.col("x").cast("double")).alias("weight")
    )
    atoms = means.select(F.col("label").alias("atom"), "feature_id", "weight").persist()
    n_atoms = atoms.agg(F.max("atom")).first()[0] + 1
    rows = atoms.groupBy("atom").agg(F.array_sort(F.collect_list(F.struct("feature_id", "weight"))).alias("w"))
    weights = {r.atom: [e.weight for e in r.w] for r in rows.collect()}
    code = F.array(*[V.dot(F.col("vec"), V.double_array(weights[a])) for a in range(n_atoms)])
    names = means.select("feature_id", F.concat(F.lit("f"), "feature_id").alias("feature")).distinct()
    best = top_scored(queries, catalog, 5).select("qid", "item_id")
    pairs = best.join(queries.select("qid", code.alias("query_code")), "qid").join(
        catalog.select("item_id", code.alias("item_code")), "item_id"
    )
    return explain.explain_pairs(pairs, explain.atom_labels(atoms, names)).select("qid", "item_id", "explanation")

