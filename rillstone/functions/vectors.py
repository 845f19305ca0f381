"""Dot and cosine as column expressions: doubles added left to right, result a float."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this width the sum is written out inside generated code; wider ones would pass the JIT's method size and run slower.
UNROLLED = 8


def query_problem(query: list[float]) -> str | None:
    return "a query needs finite components" if not query or not all(math.isfinite(x) for x in query) else None


def _literal(query: list[float]) -> Column:
    """An array literal, parsed at once: a call for each component would take longer than the search of a small table."""
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in query) + ")")


def _sum_of(column: str, query: list[float] | None, width: int) -> Column:
    v = F.col(column)
    if width <= UNROLLED:
        total = F.lit(0.0)
        for i in range(width):
            x = F.get(v, F.lit(i)).cast("double")
            total = total + x * (x if query is None else F.lit(float(query[i])))
        return total
    other = v if query is None else _literal(query)
    return F.aggregate(F.zip_with(v, other, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)


def _odd(column: str) -> Column:
    return F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _finite(score: Column, column: str) -> Column:
    """The score as a float; null where a component is null or not finite, an error where a float can't hold it.

    A bad component always spoils the score, so components are looked at for such rows only.
    """
    small = score.cast("float")
    fine = ~F.isnan(small) & (F.abs(small) < F.lit(float("inf")))
    bad = F.lit(None).cast("float")
    return F.when(fine, small).when(score.isNull() | _odd(column), bad).otherwise(F.raise_error(F.lit("a score is no finite float")).cast("float"))


def dot(column: str, query: list[float], norm: Column | None = None) -> Column:
    """Null for a vector with a null or non-finite component."""
    return _finite(_sum_of(column, query, len(query)), column)


def squared_length(column: str, width: int) -> Column:
    return _sum_of(column, None, width)


def cosine(column: str, query: list[float], norm: Column | None = None) -> Column:
    """0 where either vector has no length; null for a vector with a null or non-finite component.  norm: its squared length, if known."""
    size = 0.0
    for x in query:
        size += float(x) * float(x)
    below = (squared_length(column, len(query)) if norm is None else norm) * F.lit(size)
    return _finite(F.when(below.isNull(), below).when(below > 0, _sum_of(column, query, len(query)) / F.sqrt(below)).otherwise(F.lit(0.0)), column)


def _sum_f32(column: str, other: Column) -> Column:
    products = F.zip_with(F.col(column), other, lambda a, b: (a.cast("float") * b.cast("float")).cast("float"))
    return F.aggregate(products, F.lit(0.0).cast("float"), lambda a, x: (a + x).cast("float"))


def dot_f32(column: str, query: list[float]) -> Column:
    """The first generation's dot: floats added left to right."""
    return _sum_f32(column, F.array(*[F.lit(float(x)).cast("float") for x in query]))


def cosine_f32(column: str, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    own = F.aggregate(q, F.lit(0.0).cast("float"), lambda a, x: (a + (x * x).cast("float")).cast("float"))
    below = F.sqrt((_sum_f32(column, F.col(column)) * own).cast("float")).cast("float")
    return F.when(below > 0, (_sum_f32(column, q) / below).cast("float")).otherwise(F.lit(0.0).cast("float"))


def is_candidate(column: str, width: int) -> Column:
    """A vector of this width whose components are all finite."""
    return has_width(column, width) & ~_odd(column)


def has_width(column: str, width: int) -> Column:
    return F.col(column).isNotNull() & (F.size(column) == width)


def parsed_vector(text: Column) -> Column:
    """'1,0,0' -> array<float>."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("float"))


def scores_equivalent(a: list[tuple[int, float]], b: list[tuple[int, float]], tolerance: float = 1e-4) -> bool:
    """The same rows in the same order, scores within a relative tolerance."""
    return len(a) == len(b) and all(x == y and abs(s - t) <= tolerance * max(abs(s), 1.0) for (x, s), (y, t) in zip(a, b, strict=True))
