"""Vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is zero or null."""
    both = F.array(F.struct(a.alias("a"), b.alias("b")))  # evaluated once, used thrice

    def of(p: Column) -> Column:
        return F.try_divide(dot(p["a"], p["b"]), F.sqrt(dot(p["a"], p["a"])) * F.sqrt(dot(p["b"], p["b"])))

    return F.element_at(F.transform(both, of), 1)
