"""Reading table pairs, and preparing them for feature work."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossweft.operators import schema as S
from crossweft.session import durable
from crossweft.sources.bridges import MAX_CATALOG, listened_items, rated_items, reject_empty

DIRECT = "direct_pair"
BRIDGE = "ratings_and_listens"

Table = str | DataFrame


@dataclass(frozen=True)
class SourceSpec:
    """Where the data is: a direct pair, or raw ratings plus a listening log.

    Entries are frames or paths. A path is read as ``format``, else by its suffix, else as
    CSV with a header; ``schemas`` (by entry name) saves the pass that infers types. CSV is
    split over tasks unless ``multi_line`` says that values hold line breaks.
    A complete direct pair wins over the bridge.
    """

    queries: Table | None = None
    catalog: Table | None = None
    rated: Table | None = None
    tags: Table | None = None
    ratings: Table | None = None
    listens: Table | None = None
    tag_order: list[str] | None = None
    max_catalog: int = MAX_CATALOG
    format: str | None = None
    schemas: dict[str, str] = field(default_factory=dict)
    multi_line: bool = False


@dataclass(frozen=True)
class PreparedPair:
    queries: DataFrame
    catalog: DataFrame
    schema: S.FeatureSchema
    source_type: str
    fills: dict[str, float] = field(default_factory=dict)


def read_table(spark: SparkSession, spec: SourceSpec, entry: str) -> DataFrame:
    given = getattr(spec, entry)
    if isinstance(given, DataFrame):
        return given
    suffix = given.rstrip("/").rsplit(".", 1)[-1].lower()
    kind = spec.format or (suffix if suffix in ("parquet", "orc", "json") else "csv")
    schema = spec.schemas.get(entry)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        reader = reader.options(header=True, inferSchema=schema is None, multiLine=spec.multi_line, escape='"')
    return reader.format(kind).load(given)


def load_raw(spark: SparkSession, spec: SourceSpec) -> tuple[DataFrame, DataFrame, str]:
    if spec.queries is not None and spec.catalog is not None:
        return read_table(spark, spec, "queries"), read_table(spark, spec, "catalog"), DIRECT
    if spec.rated is None or spec.listens is None:
        raise FileNotFoundError(
            "Give both tables of a direct pair, or the rated items and the listening log."
        )

    def optional(entry: str) -> DataFrame | None:
        return None if getattr(spec, entry) is None else read_table(spark, spec, entry)

    queries = rated_items(read_table(spark, spec, "rated"), optional("tags"), optional("ratings"), spec.tag_order)
    return queries, listened_items(read_table(spark, spec, "listens"), spec.max_catalog), BRIDGE


def load_pair(spark: SparkSession, spec: SourceSpec) -> PreparedPair:
    """Resolve columns, infer roles over the shared ones, and fill the gaps."""
    raw_q, raw_c, source_type = load_raw(spark, spec)
    # Several passes follow; the raw tables and logs behind them are read once.
    raw_q, raw_c = durable(raw_q), durable(raw_c)
    reject_empty(raw_q, "The query table")
    reject_empty(raw_c, "The catalog table")
    roles_q = S.resolve_roles(raw_q, S.QUERY_TITLES)
    roles_c = S.resolve_roles(raw_c, S.CATALOG_TITLES, with_artist=True)
    raw_q, raw_c, schema = S.infer_schema(raw_q, raw_c, roles_q, roles_c)
    if not schema.all_columns:
        raise ValueError("The tables share no usable feature column.")
    queries = S.canonical_queries(raw_q, roles_q, schema.all_columns)
    catalog = S.canonical_catalog(raw_c, roles_c, schema.all_columns)
    kinds = [df.schema["item_id"].dataType for df in (queries, catalog)]
    if kinds[0] != kinds[1]:
        # Both domains share one key column later on.
        whole = all(isinstance(kind, T.IntegralType) for kind in kinds)
        key = F.col("item_id").cast("bigint" if whole else "string")
        queries, catalog = queries.withColumn("item_id", key), catalog.withColumn("item_id", key)
    fills = S.fill_values(queries, catalog, schema)
    return PreparedPair(
        S.impute(queries, schema, fills), S.impute(catalog, schema, fills), schema, source_type, fills
    )
