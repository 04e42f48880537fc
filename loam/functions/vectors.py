"""Vector functions over arrays, in doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where the product of norms is next to nothing."""
    n = norm(a) * norm(b)
    return F.when(n < 1e-10, 0.0).otherwise(dot(a, b) / n)


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine to one vector, whose norm is taken here rather than for every row."""
    size = math.sqrt(sum(float(x) * float(x) for x in query))
    n = norm(a) * F.lit(size)
    return F.when(n < 1e-10, 0.0).otherwise(dot(a, F.array(*(F.lit(float(x)) for x in query))) / n)


def checked(vector) -> list[float]:
    """A query vector as floats: flat or one row of a nested one; anything else is an error."""
    if isinstance(vector, (str, bytes)):
        raise ValueError("an embedding can't be text")
    try:
        rows = list(vector)
    except TypeError as e:
        raise ValueError("an embedding must be a sequence of numbers") from e
    if not rows:
        raise ValueError("an embedding can't be empty")
    if isinstance(rows[0], (list, tuple)) or hasattr(rows[0], "__iter__") and not isinstance(rows[0], (str, bytes)):
        rows = list(rows[0])
        if not rows:
            raise ValueError("an embedding can't be empty")
    try:
        return [float(x) for x in rows]
    except (TypeError, ValueError) as e:
        raise ValueError("an embedding must hold numbers") from e
