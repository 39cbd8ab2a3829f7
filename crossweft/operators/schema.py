"""Which columns two tables share and what role each one plays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossweft.functions.text import UNKNOWN, to_number
from crossweft.operators.ordering import exact_medians

# Accepted column names per role, first match wins.
QUERY_TITLES = ("title", "movie_title", "movie", "name")
CATALOG_TITLES = ("title", "song_title", "track", "name")
IDS = ("movie_id", "song_id", "item_id", "id", "uid", "movieid", "track_id", "trackid")
ARTISTS = ("artist", "singer", "performer", "band")
TEXT_HINTS = ("tags", "keywords", "description", "summary", "lyrics", "theme", "synopsis")

# Rows looked at and the averages that make a string column text, the
# most distinct values of a category, defaults for missing values, fallback feature.
TEXT_SAMPLE = 200
TEXT_MIN_TOKENS = 2.0
TEXT_MIN_CHARS = 18.0
MAX_CATEGORIES = 250
DEFAULT_ARTIST = "Unknown Artist"
TITLE_FEATURE = "__title_text"


@dataclass(frozen=True)
class FeatureSchema:
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    text: tuple[str, ...] = ()

    @property
    def all_columns(self) -> tuple[str, ...]:
        return self.categorical + self.numeric + self.text


@dataclass(frozen=True)
class Roles:
    id: str
    title: str
    artist: str | None = None


def resolve_column(columns: Sequence[str], candidates: Sequence[str], required: bool = True) -> str | None:
    """First candidate present, ignoring case."""
    by_lower = {c.lower(): c for c in columns}
    found = next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)
    if found is None and required:
        raise ValueError(f"None of {list(candidates)} is a column; available: {list(columns)}.")
    return found


def resolve_roles(df: DataFrame, titles: Sequence[str], with_artist: bool = False) -> Roles:
    return Roles(
        id=resolve_column(df.columns, IDS, required=False) or df.columns[0],
        title=resolve_column(df.columns, titles),
        artist=resolve_column(df.columns, ARTISTS, required=False) if with_artist else None,
    )


def shared_features(queries: DataFrame, catalog: DataFrame, q: Roles, c: Roles) -> list[str]:
    """Same-named columns that are no id, title or artist, in query order."""
    available = set(catalog.columns) - {c.id, c.title, c.artist}
    return [name for name in queries.columns if name not in {q.id, q.title} and name in available]


def _is_string(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def text_profile(df: DataFrame, columns: Sequence[str], order_by: str, rows: int = TEXT_SAMPLE) -> DataFrame:
    """(column, avg_tokens, avg_chars) over the first ``rows`` non-null values by key."""
    parts = []
    for name in columns:
        head = df.where(F.col(name).isNotNull()).select(order_by, name).orderBy(order_by).limit(rows)
        tokens = F.size(F.array_remove(F.split(F.col(name), r"\s+"), ""))
        parts.append(
            head.agg(
                F.avg(tokens).alias("avg_tokens"), F.avg(F.length(name)).alias("avg_chars")
            ).select(F.lit(name).alias("column"), "avg_tokens", "avg_chars")
        )
    profile = parts[0]
    for part in parts[1:]:
        profile = profile.unionByName(part)
    return profile


def infer_text_columns(queries: DataFrame, shared: Sequence[str], order_by: str) -> list[str]:
    """Hinted columns if there are any, else string columns that read like prose."""
    hinted = [c for c in shared if c.lower() in TEXT_HINTS]
    if hinted:
        return hinted
    strings = [c for c in shared if _is_string(queries, c)]
    if not strings:
        return []
    rows = text_profile(queries, strings, order_by).collect()
    prose = {
        r["column"]
        for r in rows
        if r.avg_tokens is not None
        and (r.avg_tokens >= TEXT_MIN_TOKENS or r.avg_chars >= TEXT_MIN_CHARS)
    }
    return [c for c in strings if c in prose]


def distinct_counts(queries: DataFrame, catalog: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: exact distinct values per column over both tables, null counting as 'nan'."""
    both = _stacked(queries, catalog, columns)
    return both.agg(*[F.countDistinct(c).alias(c) for c in columns])


def _stacked(queries: DataFrame, catalog: DataFrame, columns: Sequence[str]) -> DataFrame:
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in columns]
    return queries.select(*as_text).unionByName(catalog.select(*as_text))


def few_valued(queries: DataFrame, catalog: DataFrame, columns: Sequence[str], most: int = MAX_CATEGORIES) -> set[str]:
    """Columns with at most ``most`` distinct values, decided exactly.

    A task stops listing a column's values at ``most + 1``, which already proves the
    column too varied, so the shuffle stays tiny however unique the values are.
    """
    if not columns:
        return set()

    def list_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set] = {c: set() for c in columns}
        for batch in batches:
            for c in columns:
                if len(seen[c]) <= most:
                    seen[c].update(pc.unique(batch[c]).to_pylist())
        pairs = [(c, v) for c in columns for v in sorted(seen[c])[: most + 1]]
        if pairs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], names=["c", "v"]
            )

    found = (
        _stacked(queries, catalog, columns)
        .mapInArrow(list_values, "c string, v string")
        .groupBy("c")
        .agg(F.countDistinct("v").alias("n"))
        .collect()
    )
    return {r.c for r in found if r.n <= most}


def infer_schema(
    queries: DataFrame, catalog: DataFrame, q: Roles, c: Roles
) -> tuple[DataFrame, DataFrame, FeatureSchema]:
    """Roles of the shared columns; falls back to the title.

    Where no column is shared, the title is the one shared column and is typed like any
    other: few short values make it a category. Where columns are shared but none is
    usable, it is text.
    """
    def titled(df: DataFrame, roles: Roles) -> DataFrame:
        return df.withColumn(TITLE_FEATURE, F.col(roles.title).cast("string"))

    shared = shared_features(queries, catalog, q, c)
    if not shared:
        queries, catalog, shared = titled(queries, q), titled(catalog, c), [TITLE_FEATURE]
    schema = FeatureSchema()
    if shared:
        text = infer_text_columns(queries, shared, q.id)
        rest = [name for name in shared if name not in text]

        def numeric(df: DataFrame, name: str) -> bool:
            return isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))

        numbers = [n for n in rest if numeric(queries, n) and numeric(catalog, n)]
        strings = [
            n for n in rest if n not in numbers and (_is_string(queries, n) or _is_string(catalog, n))
        ]
        few = few_valued(queries, catalog, strings)
        schema = FeatureSchema(
            categorical=tuple(n for n in strings if n in few),
            numeric=tuple(numbers),
            text=tuple(text + [n for n in strings if n not in few]),
        )
    if not schema.all_columns:
        queries, catalog = titled(queries, q), titled(catalog, c)
        schema = FeatureSchema(text=(TITLE_FEATURE,))
    return queries, catalog, schema


def canonical_queries(df: DataFrame, roles: Roles, features: Sequence[str]) -> DataFrame:
    return df.select(
        F.col(roles.id).alias("item_id"), F.col(roles.title).alias("title"), *features
    ).dropna(subset=["item_id", "title"])


def canonical_catalog(df: DataFrame, roles: Roles, features: Sequence[str]) -> DataFrame:
    artist = F.col(roles.artist) if roles.artist else F.lit(DEFAULT_ARTIST)
    return df.select(
        F.col(roles.id).alias("item_id"),
        F.col(roles.title).alias("title"),
        *features,
        artist.alias("artist"),
    ).dropna(subset=["item_id", "title"])


def fill_values(queries: DataFrame, catalog: DataFrame, schema: FeatureSchema) -> dict[str, float]:
    """Exact median of each numeric column over both tables, 0 when it has no number."""
    if not schema.numeric:
        return {}
    both = queries.select(*schema.numeric).unionByName(catalog.select(*schema.numeric))
    medians = exact_medians(both, schema.numeric)
    return {name: 0.0 if value is None else value for name, value in medians.items()}


def impute(df: DataFrame, schema: FeatureSchema, fills: dict[str, float]) -> DataFrame:
    """Typed and gap-free feature columns."""
    new = {"title": F.col("title").cast("string")}
    new |= {c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in schema.categorical}
    new |= {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in schema.text}
    new |= {c: F.coalesce(to_number(F.col(c)), F.lit(fills[c])) for c in schema.numeric}
    if "artist" in df.columns:
        new["artist"] = F.coalesce(F.col("artist").cast("string"), F.lit(DEFAULT_ARTIST))
    return df.withColumns(new)
