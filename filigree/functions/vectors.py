"""Vectors as ARRAY<DOUBLE> columns: built-in higher-order functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def scaled(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def turned(x: Column, degrees: float | tuple[float, float, float]) -> Column:
    """x turned by degrees: two coordinates clockwise, or three round the first, second and third axis in turn, each
    counter-clockwise."""
    at = lambda k: F.element_at(x, k + 1)
    if isinstance(degrees, (int, float)):
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        return F.array(at(0) * c + at(1) * s, at(1) * c - at(0) * s)
    if len(degrees) != 3:
        raise ValueError("degrees must be one number or three")
    v = [at(0), at(1), at(2)]
    for (i, j), d in zip(((1, 2), (2, 0), (0, 1)), degrees):
        c, s = math.cos(math.radians(d)), math.sin(math.radians(d))
        v[i], v[j] = v[i] * c - v[j] * s, v[i] * s + v[j] * c
    return F.array(*v)
