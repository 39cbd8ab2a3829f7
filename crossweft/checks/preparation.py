"""Building, typing and cleaning the two item tables."""

from __future__ import annotations

from dataclasses import replace
from uuid import uuid4

from pyspark.sql import functions as F

from crossweft.checks.registry import query, table
from crossweft.checks.text_columns import ERA_SQL
from crossweft.operators import features, ordering
from crossweft.operators import schema as S
from crossweft.sources import artifacts, bridges
from crossweft.session import checkpoint_folder
from crossweft.sources.tables import SourceSpec, load_pair, load_raw

# ---- stand-in source tables -------------------------------------------------


def rated_parts(spark, folder):
    """Items with a titled year and piped genres."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("movieId"),
        F.concat("p_name", F.lit(" ("), F.col("p_size") + 1975, F.lit(")")).alias("title"),
        F.when(F.col("p_size") <= 5, "(no genres listed)")
        .otherwise(F.concat_ws("|", "p_type", "p_brand"))
        .alias("genres"),
    )


def part_tags(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("movieId"),
        F.when(F.col("l_linenumber") != 7, F.concat("l_returnflag", "l_linestatus")).alias("tag"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey",
    )


TAG_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]


def part_ratings(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("movieId"), F.col("l_quantity").alias("rating")
    )


def shipments(spark, folder):
    """A listening log: supplier 'plays' a part name for a customer."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    parts, suppliers = table(spark, folder, "part"), table(spark, folder, "supplier")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .select(
            F.col("s_name").alias("Artist"),
            F.col("p_name").alias("Track"),
            F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("Album"),
            F.when(F.col("l_linenumber") != 3, F.col("o_custkey").cast("string")).alias("Username"),
            F.date_format("l_shipdate", "dd/MM/yyyy").alias("Date"),
        )
    )


def bridge_spec(spark, folder, max_catalog=bridges.MAX_CATALOG):
    return SourceSpec(
        rated=rated_parts(spark, folder),
        tags=part_tags(spark, folder),
        ratings=part_ratings(spark, folder),
        listens=shipments(spark, folder),
        tag_order=TAG_ORDER,
        max_catalog=max_catalog,
    )


def customers(spark, folder):
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_mktsegment") != "MACHINERY", F.col("r_name")).alias("region"),
            F.when(F.col("c_acctbal") > -500, F.col("c_acctbal")).alias("acctbal"),
            F.concat("n_name", F.lit(", "), "c_mktsegment").alias("summary"),
            "c_mktsegment",
        )
    )


def suppliers(spark, folder):
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").alias("item_id"),
            F.col("s_name").alias("title"),
            F.when(F.col("s_acctbal") > 5000, F.col("n_name")).alias("band"),
            F.col("r_name").alias("region"),
            F.col("s_acctbal").alias("acctbal"),
            F.col("n_name").alias("summary"),
        )
    )


RATED_SQL = """
rated AS (SELECT p_partkey AS item_id, p_name || ' (' || (p_size + 1975) || ')' AS title, p_name AS clean, p_size + 1975 AS y,
                 CASE WHEN p_size <= 5 THEN '(no genres listed)' ELSE p_type || '|' || p_brand END AS genres FROM part),
tagged AS (SELECT l_partkey AS item_id, lower(l_returnflag || l_linestatus) AS tag,
                  row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS r
           FROM lineitem WHERE l_linenumber <> 7),
tag_text AS (SELECT item_id, string_agg(tag, ' ' ORDER BY r) AS tag_text FROM tagged WHERE r <= 20 GROUP BY item_id),
stats AS (SELECT l_partkey AS item_id, avg(l_quantity) AS rating_mean, count(l_quantity) AS rating_count
          FROM lineitem GROUP BY l_partkey),
rated_items AS (
    SELECT item_id, title, 'N/A' AS artist,
           concat_ws(' ', clean, replace(genres, '|', ' '), nullif(tag_text, '')) AS tags,
           CASE WHEN genres = '(no genres listed)' THEN 'Unknown' ELSE split_part(genres, '|', 1) END AS genre,
           """ + ERA_SQL.format(y="y") + """ AS era,
           ln(1 + coalesce(rating_count, 0)) AS popularity, coalesce(rating_mean, 0.0) AS quality
    FROM rated LEFT JOIN tag_text USING (item_id) LEFT JOIN stats USING (item_id))
"""

LISTENS_SQL = f"""
listens AS (
    SELECT s_name AS artist, p_name AS track, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS album,
           CASE WHEN l_linenumber = 3 THEN '' ELSE o_custkey::VARCHAR END AS username, year(l_shipdate)::INT AS y
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
         JOIN supplier ON l_suppkey = s_suppkey),
albums AS (SELECT artist, track, album, row_number() OVER (PARTITION BY artist, track ORDER BY n DESC, album) AS r
           FROM (SELECT artist, track, album, count(*) AS n FROM listens GROUP BY artist, track, album)),
tracks AS (
    SELECT artist, track, count(*) AS play_count, count(DISTINCT nullif(username, '')) AS user_count, max(y) AS y
    FROM listens GROUP BY artist, track),
played AS (SELECT t.*, a.album FROM tracks t JOIN albums a ON a.artist = t.artist AND a.track = t.track AND a.r = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY play_count DESC, artist, track) AS item_id FROM played),
listened_items AS (
    SELECT item_id, track AS title, artist, concat_ws(' ', track, artist, nullif(album, '')) AS tags, 'Unknown' AS genre,
           {ERA_SQL.format(y="y")} AS era, ln(1 + play_count) AS popularity, ln(1 + user_count) AS quality
    FROM ranked WHERE item_id <= 15000)
"""


@query("first_tags_per_item", f"WITH {RATED_SQL} SELECT item_id, tag_text FROM tag_text", "E1 F3")
def first_tags_per_item(spark, folder):
    tags = part_tags(spark, folder).withColumnRenamed("movieId", "item_id")
    return bridges.first_tags(tags, TAG_ORDER)


@query(
    "rating_stats",
    f"""WITH {RATED_SQL} SELECT item_id, round(rating_mean, 6) AS rating_mean, rating_count FROM stats""",
    "E2",
)
def rating_stats(spark, folder):
    ratings = part_ratings(spark, folder).withColumnRenamed("movieId", "item_id")
    return bridges.rating_stats(ratings).select("item_id", F.round("rating_mean", 6).alias("rating_mean"), "rating_count")


def _rounded(df):
    return df.withColumn("popularity", F.round("popularity", 6)).withColumn("quality", F.round("quality", 6))


ROUNDED = "item_id, title, artist, tags, genre, era, round(popularity, 6) AS popularity, round(quality, 6) AS quality"


@query("rated_items", f"WITH {RATED_SQL} SELECT {ROUNDED} FROM rated_items", "A2 D1 D2 C6 C7")
def rated_items(spark, folder):
    spec = bridge_spec(spark, folder)
    return _rounded(bridges.rated_items(spec.rated, spec.tags, spec.ratings, TAG_ORDER))


@query(
    "listen_groups",
    f"WITH {LISTENS_SQL} SELECT artist, track, play_count, album, user_count, y AS year FROM played",
    "E3",
)
def listen_groups(spark, folder):
    groups = bridges.listen_groups(bridges.clean_listens(shipments(spark, folder)))
    return groups.select("artist", "track", "play_count", "album", "user_count", "year")


@query("listened_items", f"WITH {LISTENS_SQL} SELECT {ROUNDED} FROM listened_items", "A3 G1 F1")
def listened_items(spark, folder):
    return _rounded(bridges.listened_items(shipments(spark, folder)))


@query(
    "listened_items_uncapped",
    f"WITH {LISTENS_SQL} SELECT item_id, artist, track, play_count FROM ranked",
    "F1 G1",
)
def listened_items_uncapped(spark, folder):
    groups = bridges.listen_groups(bridges.clean_listens(shipments(spark, folder))).drop("year")
    numbered = ordering.global_row_number(
        groups, [("play_count", False), ("artist", True), ("track", True)], "item_id", single_sort_rows=1_000
    )
    return numbered.select(F.col("item_id").cast("bigint").alias("item_id"), "artist", "track", "play_count")


@query(
    "event_log_items",
    """
    WITH g AS (SELECT event_type AS artist, props AS title, count(*) AS n, count(DISTINCT user_id) AS users, max(year(ts)) AS y
               FROM events GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY n DESC, artist, title) AS item_id, title, artist, title || ' ' || artist AS tags,
           'Unknown' AS genre, '2020s' AS era, round(ln(1 + n), 6) AS popularity, round(ln(1 + users), 6) AS quality
    FROM g
    """,
    "A3 E3 F1",
)
def event_log_items(spark, folder):
    log = table(spark, folder, "events").select(
        F.col("event_type").alias("artist"), F.col("props").alias("title"), F.col("user_id").alias("userid"), F.col("ts").alias("date")
    )
    return _rounded(bridges.listened_items(log, max_items=0))


PAIR_SQL = f"""
cust AS (SELECT c_custkey AS item_id, c_name AS title, CASE WHEN c_mktsegment <> 'MACHINERY' THEN r_name END AS region,
                CASE WHEN c_acctbal > -500 THEN c_acctbal END AS acctbal, n_name || ', ' || c_mktsegment AS summary
         FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
supp AS (SELECT s_suppkey AS item_id, s_name AS title, CASE WHEN s_acctbal > 5000 THEN n_name END AS artist,
                r_name AS region, s_acctbal AS acctbal, n_name AS summary
         FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
mid AS (SELECT median(acctbal) AS m FROM (SELECT acctbal FROM cust UNION ALL SELECT acctbal FROM supp)),
pair AS (
    SELECT 'q' AS domain, item_id, title, coalesce(region, 'Unknown') AS region, coalesce(acctbal, m) AS acctbal, summary,
           NULL AS artist FROM cust, mid
    UNION ALL
    SELECT 'c', item_id, title, coalesce(region, 'Unknown'), coalesce(acctbal, m), summary, coalesce(artist, 'Unknown Artist')
    FROM supp, mid)
"""


def customer_supplier_pair(spark, folder):
    return load_pair(spark, SourceSpec(queries=customers(spark, folder), catalog=suppliers(spark, folder)))


@query(
    "prepared_pair",
    f"WITH {PAIR_SQL} SELECT domain, item_id, title, region, round(acctbal, 6) AS acctbal, summary, artist FROM pair",
    "A1 B7 B8 B9 B10 H1 H2",
)
def prepared_pair(spark, folder):
    pair = customer_supplier_pair(spark, folder)
    both = features.union_domains(pair.queries, pair.catalog)
    return both.select("domain", "item_id", "title", "region", F.round("acctbal", 6).alias("acctbal"), "summary", "artist")


@query(
    "chosen_sources",
    f"""
    WITH {PAIR_SQL}, {RATED_SQL}, {LISTENS_SQL}
    SELECT 'direct_pair' AS source_type, count(*) FILTER (domain = 'q') AS n_queries, count(*) FILTER (domain = 'c') AS n_catalog FROM pair
    UNION ALL
    SELECT 'ratings_and_listens', (SELECT count(*) FROM rated_items), (SELECT count(*) FROM listened_items)
    """,
    "A4",
)
def chosen_sources(spark, folder):
    """A complete direct pair wins over the raw logs; without one the logs are used."""
    logs = bridge_spec(spark, folder)
    both = replace(logs, queries=customers(spark, folder), catalog=suppliers(spark, folder))
    rows = []
    for spec in (both, logs):
        left, right, kind = load_raw(spark, spec)
        rows.append((kind, left.count(), right.count()))
    return spark.createDataFrame(rows, "source_type string, n_queries long, n_catalog long")


@query(
    "inferred_roles",
    f"""
    WITH {PAIR_SQL}
    SELECT 'region' AS column, CASE WHEN count(DISTINCT region) <= 250 THEN 'categorical' ELSE 'text' END AS role FROM pair
    UNION ALL SELECT 'acctbal', CASE WHEN typeof(any_value(acctbal)) = 'DOUBLE' THEN 'numeric' ELSE 'other' END FROM pair
    UNION ALL SELECT 'summary', 'text'
    """,
    "B1 B2 B3 B4 B5",
)
def inferred_roles(spark, folder):
    schema = customer_supplier_pair(spark, folder).schema
    rows = [(c, role) for role in ("categorical", "numeric", "text") for c in getattr(schema, role)]
    return spark.createDataFrame(rows, "column string, role string")


@query(
    "text_column_profile",
    r"""
    WITH t AS (
        SELECT 'text' AS "column", text AS v, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL
        UNION ALL SELECT 'lang', lang, row_number() OVER (ORDER BY doc_id) FROM documents WHERE lang IS NOT NULL
        UNION ALL SELECT 'source', source, row_number() OVER (ORDER BY doc_id) FROM documents WHERE source IS NOT NULL)
    SELECT "column", round(avg(len(list_filter(regexp_split_to_array(v, '\s+'), lambda x: x <> ''))), 6) AS avg_tokens,
           round(avg(length(v)), 6) AS avg_chars
    FROM t WHERE r <= 200 GROUP BY "column"
    """,
    "B4 E5",
)
def text_column_profile(spark, folder):
    profile = S.text_profile(table(spark, folder, "documents"), ["text", "lang", "source"], "doc_id")
    return profile.select("column", F.round("avg_tokens", 6).alias("avg_tokens"), F.round("avg_chars", 6).alias("avg_chars"))


@query(
    "distinct_over_union",
    """
    WITH u AS (SELECT p_name AS name, p_brand AS label FROM part UNION ALL SELECT c_name, c_mktsegment FROM customer)
    SELECT count(DISTINCT name) AS name, count(DISTINCT label) AS label FROM u
    """,
    "E4 B5",
)
def distinct_over_union(spark, folder):
    parts = table(spark, folder, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("label"))
    people = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"))
    return S.distinct_counts(parts, people, ["name", "label"])


@query(
    "union_median",
    """
    SELECT round(median(v), 6) AS median
    FROM (SELECT o_totalprice AS v FROM orders UNION ALL SELECT l_extendedprice FROM lineitem)
    """,
    "E6 B10",
)
def union_median(spark, folder):
    a = table(spark, folder, "orders").select(F.col("o_totalprice").alias("v"))
    b = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("v"))
    median = ordering.exact_median(a.unionByName(b), F.col("v"), collect_rows=10_000)
    return spark.createDataFrame([(median,)], "median double").select(F.round("median", 6).alias("median"))


@query(
    "title_fallback",
    "SELECT item_id, text AS title, text AS __title_text FROM benchmark",
    "B6 I6",
)
def title_fallback(spark, folder):
    left = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("title"))
    right = table(spark, folder, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"))
    pair = load_pair(spark, SourceSpec(queries=left, catalog=right))
    return pair.queries.select("item_id", "title", S.TITLE_FEATURE)


@query(
    "fallback_roles",
    """
    WITH t AS (SELECT event_type AS title FROM events UNION ALL SELECT n_name FROM nation)
    SELECT '__title_text' AS "column", CASE WHEN count(DISTINCT title) <= 250 THEN 'categorical' ELSE 'text' END AS role FROM t
    UNION ALL SELECT '__title_text (long)', 'text'
    """,
    "B6",
)
def fallback_roles(spark, folder):
    """Without shared columns the title is typed like any column: short ones are a category."""
    events = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"))
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("title"))
    benchmark = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("title"))
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"))
    rows = []
    for suffix, left, right in (("", events, nations), (" (long)", benchmark, pages)):
        schema = load_pair(spark, SourceSpec(queries=left, catalog=right)).schema
        rows += [(c + suffix, role) for role in ("categorical", "numeric", "text") for c in getattr(schema, role)]
    return spark.createDataFrame(rows, "column string, role string")


@query(
    "csv_pair",
    f"WITH {PAIR_SQL} SELECT domain, item_id, title, region, round(acctbal, 6) AS acctbal, summary, artist FROM pair",
    "A1 B9",
)
def csv_pair(spark, folder):
    """Both tables written as CSV to the shared folder and loaded again by path and schema."""
    place = f"{checkpoint_folder(spark)}/csv-{uuid4().hex}"
    frames = {"queries": customers(spark, folder), "catalog": suppliers(spark, folder)}
    for name, df in frames.items():
        df.write.option("header", True).option("escape", '"').csv(f"{place}/{name}")
    kinds = {name: df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") for name, df in frames.items()}
    pair = load_pair(spark, SourceSpec(queries=f"{place}/queries", catalog=f"{place}/catalog", format="csv", schemas=kinds))
    both = features.union_domains(pair.queries, pair.catalog)
    return both.select("domain", "item_id", "title", "region", F.round("acctbal", 6).alias("acctbal"), "summary", "artist")


@query(
    "refused_inputs",
    """
    SELECT 'empty' AS input, 'The catalog table is empty.' AS message FROM (SELECT count(*) AS n FROM supplier) WHERE n > 0
    UNION ALL SELECT 'unnamed', 'no title' FROM (SELECT count(*) AS n FROM customer) WHERE n > 0
    """,
    "A5 B11",
)
def refused_inputs(spark, folder):
    """What loading says of an empty table, and of one without a title column."""
    rows = []
    for name, left, right in (
        ("empty", customers(spark, folder), suppliers(spark, folder).where("item_id IS NULL")),
        ("unnamed", customers(spark, folder).select("id", "acctbal"), suppliers(spark, folder)),
    ):
        try:
            load_pair(spark, SourceSpec(queries=left, catalog=right))
        except ValueError as error:
            rows.append((name, "no title" if "title" in str(error) else str(error)))
    return spark.createDataFrame(rows, "input string, message string")


@query(
    "stale_items",
    """
    SELECT doc_id, 'trained' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'current' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    """,
    "A8 D7",
)
def stale_items(spark, folder):
    return artifacts.key_differences(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"])
