"""Array, vector and coercion functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def top_by_score(items: Column, n: int = 5) -> Column:
    """The ``n`` structs of the highest score; equal scores keep their order."""
    keyed = F.transform(items, lambda x, i: F.struct((-F.coalesce(x.score, F.lit(0.0))).alias("s"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda k: k.x)


def first_or(items: Column, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(default))


def padded(items: Column, n: int) -> Column:
    """Exactly ``n`` elements: cut, or filled with nulls."""
    return F.slice(F.concat(items, F.array_repeat(F.lit(None), n)), 1, n)


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def far_apart(reference: Column, other: Column, tolerance: float = 1e-3) -> Column:
    """Whether some element differs by more than the absolute and relative tolerance together."""
    return F.exists(F.zip_with(reference, other, lambda x, y: F.abs(x - y) > tolerance + tolerance * F.abs(y)), lambda z: z)


def largest_gap(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(default))


def indicator(condition: Column) -> Column:
    """1.0 or 0.0 in double precision; null counts as 0.0."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)).cast("double")


def as_boolean(cell: Column) -> Column:
    text = F.upper(F.trim(cell))
    return F.when(text == "TRUE", True).when(text == "FALSE", False)


def as_whole_number(cell: Column) -> Column:
    """Integers and integral decimals as a long; null for anything else."""
    text = F.trim(cell)
    number = text.try_cast("double")
    return F.when(text.rlike(r"^[+-]?[0-9]+(\.0*)?$") & (F.floor(number) == number), number.cast("long"))
