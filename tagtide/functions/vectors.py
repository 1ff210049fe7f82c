"""Algebra of sparse vectors: maps from an index to a non-zero value, with the size beside them. JVM expressions.

A vector is a column of type map<int, double>; what is not in it is zero. Results hold no zeros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _solid(v: Column) -> Column:
    return F.map_filter(v, lambda _, x: x != 0)


def _joined(a: Column, b: Column, f) -> Column:
    """f of both values at each index that either has; a missing one is 0."""
    zero = F.lit(0.0)
    return _solid(F.map_zip_with(a, b, lambda _, x, y: f(F.coalesce(x, zero), F.coalesce(y, zero))))


def add(a: Column, b: Column) -> Column:
    return _joined(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _joined(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    """Value by value."""
    return _joined(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Value by value, at the indices that b has; others would be 0/0 or infinite and are left out."""
    return _solid(F.transform_values(F.map_filter(a, lambda i, _: F.map_contains_key(b, i)), lambda i, x: x / F.element_at(b, i)))


def scale(a: Column, by) -> Column:
    return _solid(F.transform_values(a, lambda _, x: x * by))


def map_add(a: Column, size: Column, d) -> Column:
    """d added to every value, zeros included: as long as d isn't 0, the result is dense."""
    every = F.map_from_arrays(F.sequence(F.lit(0), size - 1), F.array_repeat(F.lit(0.0), size))
    return _solid(F.map_zip_with(every, a, lambda _, x, y: F.coalesce(y, x) + d))


def append(a: Column, size: Column, b: Column) -> Column:
    """b behind a of the given size."""
    return F.map_concat(a, F.transform_keys(b, lambda i, _: (i + size).cast("int")))


def subvector(a: Column, start, n) -> Column:
    """n values from an index on, as a vector of size n."""
    inside = F.map_filter(a, lambda i, _: (i >= start) & (i < start + n))
    return F.transform_keys(inside, lambda i, _: (i - start).cast("int"))


def _sum(v: Column) -> Column:
    # in the order of the indices
    values = F.transform(F.array_sort(F.map_entries(v)), lambda e: e["value"])
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(multiply(a, b))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.transform_values(subtract(a, b), lambda _, x: F.abs(x)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.transform_values(subtract(a, b), lambda _, x: x * x)))


def l_infinity(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.map_values(subtract(a, b)), lambda x: F.abs(x))), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform_values(a, lambda _, x: x * x)))


def unit(a: Column) -> Column:
    """The vector over its norm; null for the zero vector, which has no direction."""
    return F.when(norm(a) > 0, F.transform_values(a, lambda _, x: x / norm(a)))


def sparsity(a: Column, size) -> Column:
    """The share of the indices that hold a non-zero."""
    return F.size(_solid(a)) / size


def equal(a: Column, b: Column) -> Column:
    return F.size(subtract(a, b)) == 0
