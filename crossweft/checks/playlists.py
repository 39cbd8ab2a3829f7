"""Energy signals and staged playlists on described embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossweft.checks.registry import query, table
from crossweft.checks.retrieval import SIMS_SQL, policy_sql, vectors
from crossweft.checks.steering_rules import CATALOG_SQL, described_catalog
from crossweft.operators import arc
from crossweft.plans import model


@query(
    "named_energy_levels",
    """
    SELECT doc_id, CASE lower(level) WHEN 'low' THEN 0.2 WHEN 'medium' THEN 0.6 WHEN 'high' THEN 1.0 ELSE 0.5 END::DOUBLE AS energy
    FROM (SELECT doc_id, CASE WHEN n_chars < 300 THEN 'LOW' WHEN n_chars < 900 THEN 'medium' WHEN n_chars < 3000 THEN 'High'
                         WHEN n_chars < 9000 THEN 'loud' END AS level FROM documents)
    """,
    "M1",
)
def named_energy_levels(spark, folder):
    n = F.col("n_chars")
    level = F.when(n < 300, "LOW").when(n < 900, "medium").when(n < 3000, "High").when(n < 9000, "loud")
    docs = table(spark, folder, "documents").select("doc_id", level.alias("energy_level"))
    return arc.catalog_energy(docs).select("doc_id", F.col("energy").cast("double").alias("energy"))


@query(
    "scaled_energy",
    f"""
    WITH {SIMS_SQL}, {CATALOG_SQL}
    SELECT item_id, round((tempo - min(tempo) OVER ()) / (max(tempo) OVER () - min(tempo) OVER ()), 6)::DOUBLE AS energy FROM cat
    """,
    "M1 E12",
)
def scaled_energy(spark, folder):
    catalog, _ = described_catalog(spark, folder)
    return arc.catalog_energy(catalog).select("item_id", F.round("energy", 6).alias("energy"))


def stages_sql(weights, per_stage):
    """Pick stage after stage from ``graded(qid, item_id, sim, energy)`` without repeats."""
    parts = []
    for i, (name, sim, nov, energy) in enumerate(weights, start=1):
        used = "".join(
            f" AND NOT EXISTS (SELECT 1 FROM s{j} x WHERE x.qid = g.qid AND x.item_id = g.item_id)" for j in range(1, i)
        )
        parts.append(f"""
s{i} AS (SELECT qid, {i} AS stage_no, '{name}' AS stage, item_id, sim, energy, a, row_number() OVER (
            PARTITION BY qid ORDER BY round(a, 6) DESC, item_id) AS r
         FROM (SELECT *, {sim!r} * sim + {nov!r} * (1 - (sim + 1) / 2) + {energy!r} * energy AS a FROM graded) g
         WHERE true{used} QUALIFY r <= {per_stage})""")
    union = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(1, len(weights) + 1))
    return ",".join(parts) + f""",
picked AS ({union})
SELECT p.qid, stage_no::INT AS stage_no, stage, r::INT AS stage_rank, p.item_id, c.title, c.artist, round(a, 6) AS arc_score,
       round(sim, 6) AS similarity, round(1 - (sim + 1) / 2, 6) AS novelty, round(energy, 6) AS energy
FROM picked p JOIN cat c ON c.item_id = p.item_id
"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("arc_score", "similarity", "novelty", "energy")})


@query(
    "playlist_exact",
    f"""
    WITH {SIMS_SQL}, {CATALOG_SQL},
    graded AS (SELECT s.qid, s.item_id, s.sim, c.tempo / (SELECT max(tempo) FROM cat) AS energy
               FROM sims s JOIN (SELECT item_id, tempo - (SELECT min(tempo) FROM cat) AS tempo FROM cat) c ON c.item_id = s.item_id),
    {stages_sql(arc.stage_weights(3), 3)}
    """.replace("(SELECT max(tempo) FROM cat)", "(SELECT max(tempo) - min(tempo) FROM cat)"),
    "M2 M3 F4 D7 C18",
)
def playlist_exact(spark, folder):
    queries, _ = vectors(spark, folder)
    catalog, planes = described_catalog(spark, folder)
    return _rounded(model.playlist(queries, catalog, planes, use_ann=False))


@query(
    "playlist_hashed",
    f"""
    WITH {policy_sql(8, 40, 2, 8, 160)}, {CATALOG_SQL},
    near AS (SELECT p.*, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 6) DESC, item_id) AS near FROM pools p),
    chosen AS (SELECT * FROM near WHERE near <= 160 OR method <> 'ann'),
    graded AS (
        SELECT n.qid, n.item_id, n.sim, CASE WHEN max(tempo) OVER w - min(tempo) OVER w > 1e-8
               THEN (tempo - min(tempo) OVER w) / (max(tempo) OVER w - min(tempo) OVER w) ELSE 0 END AS energy
        FROM chosen n JOIN cat c ON c.item_id = n.item_id WINDOW w AS (PARTITION BY n.qid)),
    {stages_sql(arc.stage_weights(4), 2)}
    """,
    "M1 M2 M3 F4 D7 E12",
)
def playlist_hashed(spark, folder):
    """Four interpolated stages of two, from bucket pools, with the exact fallback."""
    queries, _ = vectors(spark, folder)
    catalog, planes = described_catalog(spark, folder)
    return _rounded(model.playlist(queries, catalog, planes, stages=4, per_stage=2, search_k=40))
