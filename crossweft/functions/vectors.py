"""Array-column arithmetic for per-row use (pair counts that are already bounded).

Retrieval over whole catalogs goes through ``operators.similarity`` instead, which
multiplies Arrow blocks as matrices.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def unit(a: Column) -> Column:
    """L2-normalised copy; a zero vector stays zero.

    The norm is bound to a lambda variable so that it is computed once per row and
    not once per element.
    """
    safe = F.when(norm(a) == 0, F.lit(1.0)).otherwise(norm(a))
    return F.transform(
        F.array(safe), lambda n: F.transform(a, lambda x: x.cast("double") / n)
    )[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def novelty(similarity: Column) -> Column:
    return 1.0 - (similarity + 1.0) / 2.0


def vector_dim(df: DataFrame, column: str) -> int:
    row = df.where(F.col(column).isNotNull()).select(F.size(column)).first()
    if row is None:
        raise ValueError(f"No vector found in column {column!r}.")
    return int(row[0])


def vector_sum(vector: str, weight: str, dim: int) -> Column:
    """Aggregate: element-wise sum of column ``vector`` times the SQL ``weight``.

    Partial sums form before the shuffle. Written as one SQL text because building
    ``dim`` column objects costs a round trip to the JVM for each of their parts.
    """
    return F.expr(
        "array(" + ", ".join(f"sum({weight} * cast({vector}[{i}] as double))" for i in range(dim)) + ")"
    )


def double_array(values: Iterable[float]) -> Column:
    """Literal array of doubles, sent as one SQL text."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")
