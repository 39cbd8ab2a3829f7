"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossweft.checks.registry import query, table
from crossweft.functions import text as X
from crossweft.functions import vectors as V
from crossweft.operators import steering

WS = r"E' \t\n\r\f\v'"


def order_title():
    return F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(" ("), F.year("o_orderdate"), F.lit(") "))


@query(
    "title_year_and_clean",
    """
    SELECT o_orderkey,
           year(o_orderdate)::INT AS year,
           'Order ' || o_orderkey AS clean,
           NULL::INT AS no_year
    FROM orders
    """,
    "C1 C2",
)
def title_year_and_clean(spark, folder):
    title = order_title()
    return table(spark, folder, "orders").select(
        "o_orderkey",
        X.trailing_year(title).alias("year"),
        X.clean_title(title).alias("clean"),
        X.trailing_year(F.concat(title, F.lit("cut"))).alias("no_year"),
    )


ERA_SQL = """CASE WHEN {y} IS NULL THEN 'Unknown' WHEN {y} < 1980 THEN 'pre-1980'
    WHEN {y} < 2020 THEN (({y} // 10) * 10)::VARCHAR || 's' ELSE '2020s' END"""


@query(
    "era_buckets",
    f"""
    SELECT p_partkey, {ERA_SQL.format(y="y")} AS era
    FROM (SELECT p_partkey, CASE WHEN p_size = 50 THEN NULL ELSE 1975 + p_size END AS y FROM part)
    """,
    "C3",
)
def era_buckets(spark, folder):
    year = F.when(F.col("p_size") != 50, F.col("p_size") + 1975)
    return table(spark, folder, "part").select("p_partkey", X.era(year).alias("era"))


@query(
    "genre_fields",
    """
    WITH g AS (
        SELECT p_partkey, CASE WHEN p_size <= 5 THEN '(no genres listed)'
                               WHEN p_size <= 8 THEN '' WHEN p_size <= 11 THEN NULL
                               ELSE p_type || '|' || p_brand || '|' || p_name END AS g
        FROM part)
    SELECT p_partkey,
           CASE WHEN g IS NULL OR g = '' OR g = '(no genres listed)' THEN 'Unknown'
                ELSE split_part(g, '|', 1) END AS genre,
           replace(coalesce(g, 'Unknown'), '|', ' ') AS genre_text
    FROM g
    """,
    "C4 C5",
)
def genre_fields(spark, folder):
    genres = (
        F.when(F.col("p_size") <= 5, X.NO_GENRES)
        .when(F.col("p_size") <= 8, "")
        .when(F.col("p_size") > 11, F.concat_ws("|", "p_type", "p_brand", "p_name"))
    )
    return table(spark, folder, "part").select(
        "p_partkey", X.primary_genre(genres).alias("genre"), X.genre_text(genres).alias("genre_text")
    )


@query(
    "joined_text",
    f"""
    SELECT d.doc_id,
           concat_ws(' ', nullif(trim(' ' || source || ' ', {WS}), ''),
                          nullif(trim(CASE WHEN quality = 1 THEN '  ' ELSE quality::VARCHAR END, {WS}), ''),
                          nullif(trim(text, {WS}), '')) AS joined
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    """,
    "C6 C10",
)
def joined_text(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    odd = F.when(F.col("quality") == 1, F.lit("  ")).otherwise(F.col("quality").cast("string"))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", X.join_text(F.concat(F.lit(" "), "source", F.lit(" ")), odd, F.col("text")).alias("joined")
    )


@query(
    "log_scaled",
    "SELECT l_partkey, round(ln(1 + count(*)), 6) AS popularity FROM lineitem GROUP BY l_partkey",
    "C7",
)
def log_scaled(spark, folder):
    n = F.count(F.lit(1)).cast("double")
    return table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.round(F.log1p(n), 6).alias("popularity"))


@query(
    "coerced_numbers",
    """
    SELECT event_id,
           TRY_CAST(replace(replace(props, '{"k": ', ''), '}', '') AS DOUBLE) AS k,
           TRY_CAST(event_type AS DOUBLE) AS bad,
           coalesce(TRY_CAST(event_type AS DOUBLE), 0.0)::DOUBLE AS filled
    FROM events
    """,
    "C8",
)
def coerced_numbers(spark, folder):
    number = F.replace(F.replace("props", F.lit('{"k": ')), F.lit("}"))
    return table(spark, folder, "events").select(
        "event_id",
        X.to_number(number).alias("k"),
        X.to_number(F.col("event_type")).alias("bad"),
        F.coalesce(X.to_number(F.col("event_type")), F.lit(0.0)).alias("filled"),
    )


@query(
    "day_first_years",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS shipped,
           CASE WHEN l_linenumber = 7 THEN NULL ELSE year(l_shipdate)::INT END AS listen_year
    FROM lineitem
    """,
    "C9",
)
def day_first_years(spark, folder):
    text = (
        F.when(F.col("l_linenumber") == 1, F.date_format("l_shipdate", "dd/MM/yyyy"))
        .when(F.col("l_linenumber") == 2, F.date_format("l_shipdate", "d-M-yyyy"))
        .when(F.col("l_linenumber") == 3, F.date_format("l_shipdate", "dd MMM yyyy HH:mm"))
        .when(F.col("l_linenumber") == 7, F.date_format("l_shipdate", "yyyy/MM"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    )
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_shipdate").cast("date").alias("shipped"),
        X.day_first_year(text).alias("listen_year"),
    )


@query(
    "blank_rows_dropped",
    f"""
    SELECT event_id, artist, track FROM (
        SELECT event_id, trim(coalesce(CASE WHEN event_type = 'error' THEN ' ' WHEN event_type = 'view' THEN NULL
                              ELSE ' ' || event_type END, ''), {WS}) AS artist,
               trim(coalesce(props, ''), {WS}) AS track
        FROM events) WHERE artist <> '' AND track <> ''
    """,
    "B12 C10",
)
def blank_rows_dropped(spark, folder):
    kind = F.col("event_type")
    odd = F.when(kind == "error", F.lit(" ")).when(kind != "view", F.concat(F.lit(" "), kind))
    return (
        table(spark, folder, "events")
        .select("event_id", X.null_to_blank(odd).alias("artist"), X.null_to_blank(F.col("props")).alias("track"))
        .where((F.col("artist") != "") & (F.col("track") != ""))
    )


@query("lowered_text", "SELECT conv_id, turn, lower(text) AS lowered FROM conversations", "C11")
def lowered_text(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", F.lower("text").alias("lowered"))


@query(
    "column_aware_text",
    f"""
    SELECT doc_id, concat_ws(' ', 'lang:' || nullif(trim(lang, {WS}), ''), 'text:' || nullif(trim(text, {WS}), '')) AS combined
    FROM documents
    """,
    "C12",
)
def column_aware_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.column_text(["lang", "text"]).alias("combined"))


TOKENS_SQL = r"list_distinct(list_filter(regexp_split_to_array(lower(replace({c}, ',', ' ')), '\s+'), lambda x: x <> ''))"


@query(
    "light_tokens",
    f"""
    SELECT doc_id, len(t)::INT AS n_tokens, array_to_string(list_sort(t), ' ') AS tokens
    FROM (SELECT doc_id, {TOKENS_SQL.format(c="text")} AS t FROM documents)
    """,
    "C13",
)
def light_tokens(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", X.light_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query(
    "token_overlap",
    f"""
    SELECT a.conv_id, a.turn,
           len(list_intersect({TOKENS_SQL.format(c="a.text")}, {TOKENS_SQL.format(c="b.text")}))::INT AS overlap
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
    """,
    "C14",
)
def token_overlap(spark, folder):
    turns = table(spark, folder, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", X.token_overlap(F.col("text"), F.col("reply")).alias("overlap")
    )


@query(
    "literal_contains",
    """
    SELECT doc_id, contains(lower(text), 'on.') AS dotted, contains(lower(text), 'tion') AS plain FROM documents
    """,
    "C15",
)
def literal_contains(spark, folder):
    low = F.lower("text")
    return table(spark, folder, "documents").select(
        "doc_id", F.contains(low, F.lit("on.")).alias("dotted"), F.contains(low, F.lit("tion")).alias("plain")
    )


@query(
    "unit_vectors",
    """
    SELECT vec_id, pos::INT AS pos, round(v[pos + 1] / n, 6) AS value
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
          FROM embeddings), range(64) r(pos)
    """,
    "C16",
)
def unit_vectors(spark, folder):
    vecs = table(spark, folder, "embeddings")
    return vecs.select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("pos", "x")).select(
        "vec_id", "pos", F.round("x", 6).alias("value")
    )


@query(
    "cosine_and_novelty",
    """
    SELECT vec_id, round(s, 6) AS similarity, round(1 - (s + 1) / 2, 6) AS novelty
    FROM (SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
                 / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])
                        * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s
          FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    """,
    "C17 C18",
)
def cosine_and_novelty(spark, folder):
    vecs = table(spark, folder, "embeddings").select("vec_id", "embedding")
    after = vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    sim = V.cosine(F.col("embedding"), F.col("b"))
    return vecs.join(after, "vec_id").select(
        "vec_id", F.round(sim, 6).alias("similarity"), F.round(V.novelty(sim), 6).alias("novelty")
    )


@query(
    "parsed_rules",
    f"""
    WITH r AS (
        SELECT doc_id, CASE WHEN n_chars < 300 THEN lang WHEN n_chars < 600 THEN '=' || source
                            WHEN n_chars < 900 THEN lang || '= |' ELSE ' lang =' || lang || '| ' || source || '=x||' END AS rule
        FROM documents),
    p AS (SELECT doc_id, rule, trim(substr(rule, 1, strpos(rule, '=') - 1), {WS}) AS c,
                 unnest(string_split(substr(rule, strpos(rule, '=') + 1), '|')) AS v
          FROM r WHERE contains(rule, '='))
    SELECT doc_id, rule, c AS rule_column, trim(v, {WS}) AS rule_value
    FROM p WHERE c <> '' AND trim(v, {WS}) <> ''
    """,
    "C19",
)
def parsed_rules(spark, folder):
    n = F.col("n_chars")
    rule = (
        F.when(n < 300, F.col("lang"))
        .when(n < 600, F.concat(F.lit("="), "source"))
        .when(n < 900, F.concat("lang", F.lit("= |")))
        .otherwise(F.concat(F.lit(" lang ="), "lang", F.lit("| "), "source", F.lit("=x||")))
    )
    rules = table(spark, folder, "documents").select("doc_id", rule.alias("rule"))
    return steering.parse_rule_table(rules, "rule")
