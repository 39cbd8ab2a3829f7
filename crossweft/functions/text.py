"""Column expressions for titles, tags, tokens, dates and free text.

All of them are built-in Spark functions, so they stay inside generated code and
need no Python worker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank, what stands in for a missing category, and
# the placeholder some catalogs use for "no genre".
WHITESPACE = " \t\n\r\f\v"
UNKNOWN = "Unknown"
NO_GENRES = "(no genres listed)"

# Accepted listening-date layouts, day before month.
DAY_FIRST_FORMATS = (
    "d/M/yyyy[ H:mm[:ss]]",
    "d-M-yyyy[ H:mm[:ss]]",
    "d.M.yyyy[ H:mm[:ss]]",
    "d/M/yy[ H:mm[:ss]]",
    "d-M-yy[ H:mm[:ss]]",
    "d MMM yyyy[ H:mm[:ss]]",
    "d MMMM yyyy[ H:mm[:ss]]",
    "yyyy-M-d[ H:mm[:ss]]",
    "yyyy/M/d[ H:mm[:ss]]",
    "yyyy-MM-dd'T'HH:mm[:ss][.SSS][XXX]",
)

# Fixed value: a word is two or more letters, digits or underscores, any script.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col.cast("string")), F.lit(""))


def null_to_blank(col: Column) -> Column:
    """Null becomes '', everything else is trimmed text."""
    return strip(F.coalesce(col.cast("string"), F.lit("")))


# How a year ends a title, first and last labelled year, years to a label.
YEAR_AT_END = r"\s*\((\d{4})\)\s*$"
FIRST_ERA, LAST_ERA, ERA_YEARS = 1980, 2020, 10


def trailing_year(title: Column) -> Column:
    """The year in a trailing ``(YYYY)``, else null."""
    digits = F.regexp_extract(title, YEAR_AT_END, 1)
    return F.when(digits != "", digits.cast("int"))


def clean_title(title: Column) -> Column:
    return strip(F.regexp_replace(title, YEAR_AT_END, ""))


def era(year: Column) -> Column:
    """Coarse decade label of a year."""
    decade = F.greatest(F.lit(FIRST_ERA - ERA_YEARS), F.least(F.lit(LAST_ERA), year - F.pmod(year, F.lit(ERA_YEARS))))
    label = F.when(decade < FIRST_ERA, f"pre-{FIRST_ERA}").otherwise(F.concat(decade.cast("string"), F.lit("s")))
    return F.when(year.isNull(), UNKNOWN).otherwise(label)


def primary_genre(genres: Column) -> Column:
    missing = genres.isNull() | (genres == "") | (genres == NO_GENRES)
    return F.when(missing, UNKNOWN).otherwise(F.substring_index(genres, "|", 1))


def genre_text(genres: Column) -> Column:
    return F.translate(F.coalesce(genres, F.lit(UNKNOWN)), "|", " ")


def join_text(*parts: Column) -> Column:
    """Non-blank trimmed parts joined by one space."""
    return F.concat_ws(" ", *[blank_to_null(part) for part in parts])


def to_number(col: Column) -> Column:
    """Text or number to double; anything unreadable (or NaN) becomes null."""
    number = col.try_cast("double")
    return F.when(~F.isnan(number), number)


def day_first_year(col: Column, formats: Sequence[str] = DAY_FIRST_FORMATS) -> Column:
    """Year of a date written day-first; unreadable dates give null."""
    return F.year(F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats]))


def column_text(columns: Sequence[str]) -> Column:
    """``"col:value"`` chunks of the non-blank columns, space separated."""
    if not columns:
        return F.lit("")
    chunks = [F.concat(F.lit(f"{c}:"), blank_to_null(F.col(c))) for c in columns]
    return strip(F.concat_ws(" ", *chunks))


def light_tokens(text: Column) -> Column:
    """Distinct lower-cased pieces split on whitespace and commas."""
    pieces = F.split(F.lower(F.translate(F.coalesce(text, F.lit("")), ",", " ")), r"\s+")
    return F.array_distinct(F.array_remove(pieces, ""))


def token_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(light_tokens(a), light_tokens(b)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """Every token, then every pair of neighbouring tokens joined by a space."""
    n = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), n - 1),
        F.slice(tokens, F.lit(2), n - 1),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.when(n < 2, tokens).otherwise(F.concat(tokens, pairs))
