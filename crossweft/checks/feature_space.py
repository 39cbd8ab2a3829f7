"""One-hot, TF-IDF, scaling and assembly over documents (catalog) and benchmark (queries)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from crossweft.checks.registry import query, table
from crossweft.operators import dictionary, features
from crossweft.operators.schema import FeatureSchema

SCHEMA = FeatureSchema(categorical=("lang", "source"), numeric=("n_chars", "quality"), text=("text", "lang_text"))


def text_items(spark, folder):
    """Both text tables as one item frame; what a table lacks gets its default."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    catalog = docs.select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("title"), "lang", "source", "n_chars",
        (F.col("quality").cast("double") - 0.25).alias("quality"), "text", F.col("lang").alias("lang_text"),
    )
    asked = table(spark, folder, "benchmark").select("item_id", F.lit("benchmark").alias("title"), "text")
    both = features.union_domains(asked, catalog)
    return both.withColumns(
        {
            "lang": F.coalesce("lang", F.lit("Unknown")),
            "source": F.coalesce("source", F.lit("Unknown")),
            "lang_text": F.coalesce("lang_text", F.lit("")),
        }
    )


WORDS_SQL = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}')"

ITEMS_SQL = """
items AS (
    SELECT 'c' AS domain, d.doc_id AS item_id, source AS title, lang, source, n_chars, quality::DOUBLE - 0.25 AS quality, text, lang AS lang_text
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    UNION ALL
    SELECT 'q', item_id, 'benchmark', 'Unknown', 'Unknown', NULL, NULL, text, '' FROM benchmark),
w AS (SELECT domain, item_id, """ + WORDS_SQL.format(
    c="concat_ws(' ', 'text:' || nullif(trim(text, E' \\t\\n\\r\\f\\v'), ''), 'lang_text:' || nullif(lang_text, ''))"
) + """ AS t FROM items),
grams AS (
    SELECT domain, item_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM w),
tf AS (SELECT domain, item_id, term, count(*) AS tf FROM grams GROUP BY ALL),
freq AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term),
kept AS (SELECT * FROM freq WHERE df >= 1 ORDER BY cf DESC, term LIMIT 3000),
n AS (SELECT count(*) AS n FROM items),
weighted AS (SELECT domain, item_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN kept USING (term), n),
tfidf AS (SELECT domain, item_id, 'txt:' || term AS feature,
                 x / sqrt(sum(x * x) OVER (PARTITION BY domain, item_id)) AS value FROM weighted),
onehot AS (
    SELECT domain, item_id, 'cat:lang_' || lang AS feature, 1.0 AS value, 0 AS ord FROM items
    UNION ALL SELECT domain, item_id, 'cat:source_' || source, 1.0, 1 FROM items),
scales AS (SELECT max(abs(coalesce(n_chars, 0))) AS a, max(abs(coalesce(quality, 0))) AS b FROM items),
nums AS (
    SELECT domain, item_id, 'num:n_chars' AS feature, coalesce(n_chars, 0) / a AS value, 0 AS ord FROM items, scales
    UNION ALL SELECT domain, item_id, 'num:quality', coalesce(quality, 0) / b, 1 FROM items, scales),
names AS (
    SELECT DISTINCT 0 AS block, ord, feature FROM onehot
    UNION ALL SELECT 1, 0, 'txt:' || term FROM kept
    UNION ALL SELECT 2, 0, 'num:n_chars' UNION ALL SELECT 2, 1, 'num:quality'),
vocab AS (SELECT feature, (row_number() OVER (ORDER BY block, ord, feature) - 1)::INT AS feature_id FROM names)
"""


@query("document_frequency", f"WITH {ITEMS_SQL} SELECT term, df, cf FROM freq", "E7")
def document_frequency(spark, folder):
    items = text_items(spark, folder)
    space = features.FeatureSpace(SCHEMA, items, {}, 0)
    return features.document_frequency(features.term_counts(items, space.text()))


@query("capped_vocabulary", f"WITH {ITEMS_SQL} SELECT term, df, cf FROM kept", "G2")
def capped_vocabulary(spark, folder):
    items = text_items(spark, folder)
    text = features.FeatureSpace(SCHEMA, items, {}, 0).text()
    return features.frequent_terms(items, text, True, features.MAX_TEXT_FEATURES, 1)


@query(
    "one_hot",
    f"WITH {ITEMS_SQL} SELECT domain, item_id, feature, value::DOUBLE AS value FROM onehot",
    "I1 I5",
)
def one_hot(spark, folder):
    return features.one_hot(text_items(spark, folder), SCHEMA.categorical).select("domain", "item_id", "feature", "value")


@query(
    "max_abs_scaled",
    f"WITH {ITEMS_SQL} SELECT domain, item_id, feature, round(value, 6)::DOUBLE AS value FROM nums WHERE value <> 0",
    "E8 I3 I5",
)
def max_abs_scaled(spark, folder):
    items = text_items(spark, folder)
    rows = features.scaled(items, features.numeric_scales(items, SCHEMA.numeric))
    return rows.select("domain", "item_id", "feature", F.round("value", 6).alias("value"))


@query("feature_ids", f"WITH {ITEMS_SQL} SELECT feature_id, feature FROM vocab", "I4 I5")
def feature_ids(spark, folder):
    return features.fit(text_items(spark, folder), SCHEMA).vocab.select("feature_id", "feature")


@query(
    "feature_matrix",
    f"""
    WITH {ITEMS_SQL}
    SELECT domain, item_id, feature_id, round(value, 6)::DOUBLE AS value
    FROM (SELECT domain, item_id, feature, value FROM tfidf
          UNION ALL SELECT domain, item_id, feature, value FROM onehot
          UNION ALL SELECT domain, item_id, feature, value FROM nums WHERE value <> 0) JOIN vocab USING (feature)
    """,
    "I1 I2 I3 I4",
)
def feature_matrix(spark, folder):
    items = text_items(spark, folder)
    rows = features.transform(items, features.fit(items, SCHEMA))
    return features.long_rows(rows).select("domain", "item_id", "feature_id", F.round("value", 6).alias("value"))


@query(
    "unseen_items_transformed",
    f"""
    WITH {ITEMS_SQL},
    u AS (SELECT conv_id AS c, turn, role, {WORDS_SQL.format(c="'text:' || trim(text, E' \\t\\n\\r\\f\\v')")} AS t FROM conversations),
    ug AS (SELECT c, turn, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM u),
    utf AS (SELECT c, turn, term, count(*) AS tf FROM ug GROUP BY ALL),
    uw AS (SELECT c, turn, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM utf JOIN kept USING (term), n)
    SELECT c || ':' || turn AS item_id, 'txt:' || term AS feature,
           round(x / sqrt(sum(x * x) OVER (PARTITION BY c, turn)), 6) AS value
    FROM uw
    """,
    "I7",
)
def unseen_items_transformed(spark, folder):
    space = features.fit(text_items(spark, folder), SCHEMA)
    turns = table(spark, folder, "conversations").select(
        F.lit("q").alias("domain"), F.concat_ws(":", "conv_id", "turn").alias("item_id"), F.col("role").alias("lang"),
        F.lit("never seen").alias("source"), F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("double").alias("quality"),
        "text", F.lit("").alias("lang_text"),
    )
    rows = features.long_rows(features.transform(turns, space))
    return rows.join(space.lookup("txt"), "feature_id").select("item_id", "feature", F.round("value", 6).alias("value"))


@query(
    "title_only_features",
    r"""
    WITH items AS (SELECT 'q' AS domain, item_id, text AS title FROM benchmark UNION ALL SELECT 'c', page_id, url FROM pages),
    g AS (SELECT domain, item_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]{2,}')) AS term FROM items),
    tf AS (SELECT domain, item_id, term, count(*) AS tf FROM g GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM items),
    w AS (SELECT domain, item_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term), n)
    SELECT domain, item_id, 'txt:' || term AS feature, round(x / sqrt(sum(x * x) OVER (PARTITION BY domain, item_id)), 6) AS value FROM w
    """,
    "I6 B6",
)
def title_only_features(spark, folder):
    left = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("title"))
    right = table(spark, folder, "pages").select(F.col("page_id").alias("item_id"), F.col("url").alias("title"))
    items = features.union_domains(left, right)
    space = features.fit(items, FeatureSchema())
    rows = features.long_rows(features.transform(items, space))
    return rows.join(space.lookup("txt"), "feature_id").select(
        "domain", "item_id", "feature", F.round("value", 6).alias("value")
    )


@query(
    "sparse_codes_orthonormal",
    """
    SELECT vec_id, atom::INT AS atom, round(sign(p) * greatest(abs(p) - 0.05, 0), 6) AS weight
    FROM (SELECT vec_id, r.atom, list_sum(list_transform(range(64),
                 lambda j: embedding[j + 1]::DOUBLE * (1 - 2 * (bit_count(r.atom & j) % 2)))) / 8 AS p
          FROM embeddings, range(64) r(atom))
    """,
    "J2",
)
def sparse_codes_orthonormal(spark, folder):
    """Codes against a Walsh basis, whose lasso solution SQL can state in closed form."""
    codes = dictionary.encode(embedding_rows(spark, folder), walsh_model())
    return codes.select(F.col("item_id").alias("vec_id"), F.posexplode("code").alias("atom", "x")).select(
        "vec_id", "atom", (F.round("x", 6) + 0.0).alias("weight")
    )


def walsh_model():
    ids = np.arange(64)
    odd = np.array([[bin(i & j).count("1") % 2 for j in ids] for i in ids])
    return dictionary.Dictionary((1.0 - 2.0 * odd) / 8.0, alpha=0.05)


def embedding_rows(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.lit("c").alias("domain"), F.col("vec_id").alias("item_id"),
        F.sequence(F.lit(0), F.size("embedding") - 1).alias("idx"), F.col("embedding").cast("array<double>").alias("val"),
    )


WALSH_SQL = """
codes AS (
    SELECT vec_id, r.atom, embedding, list_sum(list_transform(range(64),
               lambda j: embedding[j + 1]::DOUBLE * (1 - 2 * (bit_count(r.atom & j) % 2)))) / 8 AS p
    FROM embeddings, range(64) r(atom)),
soft AS (SELECT vec_id, atom, embedding, sign(p) * greatest(abs(p) - 0.05, 0) AS c FROM codes)
"""


@query(
    "coding_statistics",
    f"""
    WITH {WALSH_SQL}
    SELECT 'atom' AS side, a.atom::INT AS line, b.atom::INT AS atom, round(sum(a.c * b.c), 6) AS total
    FROM soft a JOIN soft b ON a.vec_id = b.vec_id GROUP BY ALL
    UNION ALL
    SELECT 'feature', j::INT, atom::INT, round(sum(embedding[j + 1]::DOUBLE * c), 6) FROM soft, range(64) f(j) GROUP BY ALL
    """,
    "J1",
)
def coding_statistics(spark, folder):
    """The sums one learning pass is made of, for atoms whose codes SQL can state."""
    model = walsh_model()
    a, b, _, _ = dictionary.coding_statistics(embedding_rows(spark, folder), model.atoms, model.alpha)
    rows = [
        (side, line, atom, float(x))
        for side, sums in (("atom", a), ("feature", b.T))
        for line, row in enumerate(sums)
        for atom, x in enumerate(row)
    ]
    frame = spark.createDataFrame(rows, "side string, line int, atom int, total double")
    return frame.withColumn("total", F.round("total", 6) + 0.0)


@query(
    "code_sparsity",
    """
    SELECT round(100.0 * sum(zeros) / (64 * count(*)), 6)::DOUBLE AS sparsity_pct
    FROM (SELECT len(list_filter(embedding::DOUBLE[], lambda x: abs(x) <= 0.05)) AS zeros FROM embeddings)
    """,
    "E9 J3",
)
def code_sparsity(spark, folder):
    soft = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) <= 0.05, 0.0).otherwise(x.cast("double")))
    codes = table(spark, folder, "embeddings").select(soft.alias("code"))
    return dictionary.sparsity(codes).select(F.round("sparsity_pct", 6).alias("sparsity_pct"))
