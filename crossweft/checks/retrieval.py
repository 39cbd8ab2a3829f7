"""Exact and hashed retrieval: every embedding against the whole embedding table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crossweft.checks.registry import query, table
from crossweft.operators import lsh, metrics, titles
from crossweft.operators.rerank import rank_by_score
from crossweft.operators.similarity import top_scored
from crossweft.session import checkpoint_folder
from crossweft.sources import artifacts

DIM = 64
BITS = 8


def vectors(spark, folder):
    """(queries, catalog), the same whole table in both roles."""
    vecs = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return vecs.withColumnRenamed("vec_id", "qid"), vecs.withColumnRenamed("vec_id", "item_id")


def keyed(spark, folder, bits=BITS):
    planes = lsh.hyperplanes(bits, DIM)
    queries, catalog = vectors(spark, folder)
    key = lsh.lsh_key(F.col("vec"), planes).alias("key")
    return queries, catalog.select("*", key), planes


U_SQL = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, label, v, list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS u
      FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e))
"""
SIMS_SQL = U_SQL + """,
sims AS (SELECT q.vec_id AS qid, c.vec_id AS item_id, list_dot_product(q.u, c.u) AS sim FROM u q, u c)
"""


def planes_sql(bits=BITS):
    rows = ", ".join(
        f"({i}, [{', '.join(repr(float(x)) for x in plane)}]::DOUBLE[])" for i, plane in enumerate(lsh.hyperplanes(bits, DIM))
    )
    return f"""
planes AS (SELECT * FROM (VALUES {rows}) t(bit, p)),
keys AS (SELECT vec_id, label, v, u, sum(CASE WHEN list_dot_product(u, p) >= 0 THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS key
         FROM u, planes GROUP BY vec_id, label, v, u)
"""


def probing_sql(radius, search_k, bits=BITS):
    return planes_sql(bits) + f""",
buckets AS (SELECT key, count(*) AS cnt FROM keys GROUP BY key),
hits AS (SELECT q.vec_id AS qid, b.key, bit_count(xor(q.key, b.key))::INT AS dist, b.cnt
         FROM keys q JOIN buckets b ON bit_count(xor(q.key, b.key)) <= {radius}),
rings AS (SELECT qid, dist, sum(cnt) AS n FROM hits GROUP BY qid, dist),
cut AS (SELECT qid, dist, n, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY dist ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM rings),
reach AS (SELECT qid, max(dist) AS dist, sum(n)::BIGINT AS pool_size FROM cut WHERE before < {search_k} GROUP BY qid),
cand AS (SELECT h.qid, k.vec_id AS item_id, h.dist FROM hits h JOIN reach r ON r.qid = h.qid AND h.dist <= r.dist
         JOIN keys k ON k.key = h.key)
"""


@query(
    "exact_top_items",
    f"""
    WITH {SIMS_SQL}
    SELECT qid, item_id, round(sim, 6) AS similarity, r::INT AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 6) DESC, item_id) AS r FROM sims) WHERE r <= 10
    """,
    "D9 G3 F2 C17",
)
def exact_top_items(spark, folder):
    queries, catalog = vectors(spark, folder)
    return top_scored(queries, catalog, 10).select("qid", "item_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    "exact_top_items_grid",
    f"""
    WITH {SIMS_SQL}
    SELECT qid, item_id, round(sim, 6) AS similarity, r::INT AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 6) DESC, item_id) AS r FROM sims) WHERE r <= 10
    """,
    "D9 G3 F2",
)
def exact_top_items_grid(spark, folder):
    """The same answer through the block grid used when no side is small."""
    queries, catalog = vectors(spark, folder)
    found = top_scored(queries, catalog, 10, broadcast_rows=0, block_rows=200)
    return found.select("qid", "item_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("lsh_keys", f"WITH {U_SQL}, {planes_sql()} SELECT vec_id, key FROM keys", "K1 K2")
def lsh_keys(spark, folder):
    return keyed(spark, folder)[1].select(F.col("item_id").alias("vec_id"), "key")


@query(
    "lsh_keys_24_bits", f"WITH {U_SQL}, {planes_sql(24)} SELECT vec_id, key FROM keys", "K1 K2"
)
def lsh_keys_24_bits(spark, folder):
    return keyed(spark, folder, 24)[1].select(F.col("item_id").alias("vec_id"), "key")


@query(
    "bucket_sizes",
    f"WITH {U_SQL}, {planes_sql()} SELECT key, count(*) AS cnt FROM keys GROUP BY key",
    "E10 K3",
)
def bucket_sizes(spark, folder):
    return lsh.bucket_counts(keyed(spark, folder)[1])


def _probes(spark, folder, radius, search_k, bits=BITS):
    queries, catalog, planes = keyed(spark, folder, bits)
    asked = queries.withColumn("key", lsh.lsh_key(F.col("vec"), planes))
    by_key = lsh.probe_rings(lsh.distinct_keys(asked), lsh.bucket_counts(catalog), bits, radius, search_k)
    return lsh.per_query(asked, by_key), catalog


@query(
    "probed_buckets",
    f"WITH {U_SQL}, {probing_sql(2, 1000000)} SELECT qid, key, dist, cnt FROM hits",
    "K4",
)
def probed_buckets(spark, folder):
    return _probes(spark, folder, 2, 1_000_000)[0].select("qid", "key", F.col("dist").cast("int").alias("dist"), "cnt")


@query(
    "ring_cutoff",
    f"WITH {U_SQL}, {probing_sql(3, 16)} SELECT qid, pool_size, dist FROM reach",
    "F5",
)
def ring_cutoff(spark, folder):
    kept, _ = _probes(spark, folder, 3, 16)
    return kept.groupBy("qid").agg(F.first("pool_size").alias("pool_size"), F.max("dist").cast("int").alias("dist"))


@query(
    "wide_radius_probing",
    f"WITH {U_SQL}, {probing_sql(7, 40, 24)} SELECT qid, pool_size, dist FROM reach",
    "K4 F5",
)
def wide_radius_probing(spark, folder):
    """A radius with too many probe keys to spell out: ring by ring, the far ones joined on key pieces."""
    kept, _ = _probes(spark, folder, 7, 40, 24)
    return kept.groupBy("qid").agg(F.first("pool_size").alias("pool_size"), F.max("dist").cast("int").alias("dist"))


@query(
    "lsh_candidates",
    f"WITH {U_SQL}, {probing_sql(2, 16)} SELECT qid, item_id, dist FROM cand",
    "D6 H3",
)
def lsh_candidates(spark, folder):
    kept, catalog = _probes(spark, folder, 2, 16)
    return lsh.candidates(kept, catalog).select("qid", "item_id", F.col("dist").cast("int").alias("dist"))


def policy_sql(top_n, search_k, radius, bits, pool):
    """Pool per query under the retrieval policy; no bias, so score is similarity."""
    return f"""{SIMS_SQL}, {probing_sql(radius, pool, bits)},
policy AS (
    SELECT k.vec_id AS qid, r.pool_size AS found,
           CASE WHEN coalesce(r.pool_size, n.n) < {5 * top_n} THEN 'exact_fallback' ELSE 'ann' END AS method, n.n
    FROM keys k LEFT JOIN reach r ON r.qid = k.vec_id, (SELECT count(*) AS n FROM u) n),
pools AS (
    SELECT p.qid, s.item_id, s.sim, p.method, (CASE WHEN p.method = 'ann' THEN coalesce(p.found, p.n) ELSE p.n END)::BIGINT AS pool_size
    FROM policy p JOIN sims s ON s.qid = p.qid
    WHERE p.method <> 'ann' OR p.found IS NULL
       OR EXISTS (SELECT 1 FROM cand c WHERE c.qid = p.qid AND c.item_id = s.item_id))
"""


def _policy_query(name, top_n, search_k, radius, bits, covers):
    pool = max(search_k, 30 * top_n)

    @query(
        name,
        f"""
        WITH {policy_sql(top_n, search_k, radius, bits, pool)}
        SELECT qid, item_id, round(sim, 6) AS similarity, method, pool_size, r::INT AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 6) DESC, item_id) AS r FROM pools)
        WHERE r <= {top_n}
        """,
        covers,
    )
    def run(spark, folder):
        queries, catalog, planes = keyed(spark, folder, bits)
        found = lsh.retrieve(queries, catalog, planes, top_n, search_k, radius)
        return rank_by_score(found, top_n).select(
            "qid", "item_id", F.round("similarity", 6).alias("similarity"), "method", "pool_size", "rank"
        )


_policy_query("ann_top_items", 5, 256, 2, 8, "K5 K6 G3")
_policy_query("ann_or_fallback", 8, 60, 1, 8, "K5 K6")
_policy_query("ann_without_buckets", 5, 256, 0, 24, "K5 K6")
_policy_query("ann_default_bits", 5, 256, 2, 24, "K5 K6")


@query(
    "hashed_recall",
    f"""
    WITH {policy_sql(10, 256, 2, BITS, 300)},
    ours AS (SELECT qid, item_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 6) DESC, item_id) AS r
                                       FROM pools) WHERE r <= 10),
    best AS (SELECT qid, item_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 6) DESC, item_id) AS r
                                       FROM sims) WHERE r <= 10)
    SELECT b.qid, count(*) AS n_exact, count(o.item_id) AS n_found, count(o.item_id) / count(*) AS recall
    FROM best b LEFT JOIN ours o ON o.qid = b.qid AND o.item_id = b.item_id GROUP BY b.qid
    """,
    "K5 K6",
)
def hashed_recall(spark, folder):
    """Recall of the hashed first ten against the exact first ten, query by query."""
    queries, catalog, planes = keyed(spark, folder)
    found = rank_by_score(lsh.retrieve(queries, catalog, planes, 10, 256, 2), 10)
    return metrics.list_recall(found, top_scored(queries, catalog, 10), 10)


@query(
    "stored_index",
    f"WITH {U_SQL}, {planes_sql()} SELECT vec_id AS item_id, key FROM keys",
    "A6 A7 K3",
)
def stored_index(spark, folder):
    """The index written as a table to the shared folder and read back."""
    _, catalog, planes = keyed(spark, folder)
    place = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    artifacts.save(
        {
            "ann": catalog.select("item_id", "key"),
            "hyperplanes": artifacts.matrix_table(spark, planes, "bit", "plane"),
            "codes": catalog.select("item_id", "vec"),
            "item_keys": catalog.select("item_id"),
            "atoms": artifacts.matrix_table(spark, planes, "atom", "weights"),
            "model": artifacts.json_row(spark, {"bits": len(planes)}),
        },
        place,
    )
    return artifacts.load(spark, place)["ann"].select("item_id", "key")


NAMES_SQL = """
texts AS (SELECT DISTINCT replace(p_name, 'e', 'a') AS text FROM part UNION SELECT DISTINCT upper(n_name) FROM nation
          UNION SELECT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) FROM part),
items AS (SELECT p_partkey AS item_id, p_name AS title FROM part UNION ALL SELECT 1000000 + c_custkey, c_name FROM customer),
t AS (SELECT DISTINCT title FROM items),
pairs AS (
    SELECT text, title, string_split(text, ' ') AS a, string_split(title, ' ') AS b,
           array_to_string(list_sort(string_split(text, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(title, ' ')), ' ') AS sb
    FROM texts, t),
scored AS (
    SELECT text, title, round(100 * greatest(
        1 - levenshtein(text, title) / greatest(length(text), length(title)),
        0.95 * (1 - levenshtein(sa, sb) / greatest(length(sa), length(sb))),
        0.95 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6)::DOUBLE AS s FROM pairs)
"""


@query(
    "fuzzy_titles",
    f"""
    WITH {NAMES_SQL},
    top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY s DESC, title) AS r FROM scored) WHERE r <= 5),
    ranked AS (SELECT p.text, i.item_id, i.title, s, row_number() OVER (PARTITION BY p.text ORDER BY s DESC, i.title, i.item_id) AS rank
               FROM top5 p JOIN items i ON i.title = p.title)
    SELECT text, rank::INT AS rank, item_id, title, s AS match_score, rank = 1 AND s >= 55 AS accepted FROM ranked WHERE rank <= 5
    """,
    "D5",
)
def fuzzy_titles(spark, folder):
    parts, people, nations = (table(spark, folder, t) for t in ("part", "customer", "nation"))
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    texts = (
        parts.select(F.translate("p_name", "e", "a").alias("text"))
        .unionByName(nations.select(F.upper("n_name").alias("text")))
        .unionByName(parts.select(F.concat(second, F.lit(" "), first).alias("text")))
        .distinct()
        .select(F.col("text").alias("qid"), "text")
    )
    items = parts.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title")).unionByName(
        people.select((F.col("c_custkey") + 1_000_000).alias("item_id"), F.col("c_name").alias("title"))
    )
    return titles.match_titles(texts, items).drop("qid")
