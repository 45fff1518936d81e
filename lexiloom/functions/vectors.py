"""Column expressions on numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def offset_target(a: Column | str, b: Column | str, c: Column | str) -> Column:
    """b - a + c, element by element."""
    shifted = F.zip_with(_c(b), _c(a), lambda x, y: x.cast("double") - y.cast("double"))
    return F.zip_with(shifted, _c(c), lambda x, y: x + y.cast("double"))
