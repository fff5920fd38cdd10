"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(
        left, right, lambda a, b: a.cast("double") * b.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine_distance(left: Column, right: Column) -> Column:
    """1 - cosine; NULL where a vector has no length."""
    return 1 - F.try_divide(dot(left, right), norm(left) * norm(right))


def widen(vector: Column, n: int, prefix: str = "embed_", start: int = 1) -> list[Column]:
    """One column per position, for export only."""
    return [F.get(vector, F.lit(i)).alias(f"{prefix}{i + start}") for i in range(n)]


def widen_suffixed(vector: Column, n: int, suffix: str = "_embed") -> list[Column]:
    return [F.get(vector, F.lit(i)).alias(f"{i}{suffix}") for i in range(n)]


def fold(columns: list[str]) -> Column:
    """The inverse of ``widen``."""
    return F.array(*[F.col(f"`{c}`") for c in columns])
