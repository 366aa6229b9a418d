"""Distortion kernels: penalties of distance and weight, losses of distance and target deviation.

Each kernel is written once, as value and slope over a small set of operations, and runs with Spark Columns (whole-
stage code, for queries) or NumPy arrays (for the solver). `w` is the weight of a penalty, the deviation of a loss.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class _Arrays:
    exp, log, log1p, expm1, abs, sign, max, min = np.exp, np.log, np.log1p, np.expm1, np.abs, np.sign, np.maximum, np.minimum

    @staticmethod
    def where(c, a, b):
        return np.where(c, a, b)

    @staticmethod
    def pow(a, e):
        return np.power(a, e)

    @staticmethod
    def div(a, b):
        return a / b

    @staticmethod
    def pair(w):
        return w[..., 0], w[..., 1]


class _Columns:
    """As arrays do: a division by zero gives infinity or not a number, a logarithm of zero minus infinity; Spark's own
    would raise or give null."""

    exp, log1p, expm1, abs, sign = F.exp, F.log1p, F.expm1, F.abs, F.signum

    @staticmethod
    def _col(x):
        return x if isinstance(x, Column) else F.lit(float(x))

    @staticmethod
    def pair(w):
        return w["deviation"], w["weight"]

    @classmethod
    def max(cls, a, b):
        return F.greatest(cls._col(a), cls._col(b))

    @classmethod
    def min(cls, a, b):
        return F.least(cls._col(a), cls._col(b))

    @classmethod
    def where(cls, c, a, b):
        return F.when(c, cls._col(a)).otherwise(cls._col(b))

    @staticmethod
    def pow(a, e):
        return F.pow(a, F.lit(float(e)))

    @classmethod
    def div(cls, a, b):
        a = cls._col(a)
        return F.when(b != 0, a / b).when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull() & b.isNotNull(), float("nan"))

    @staticmethod
    def log(a):
        return F.when(a > 0, F.log(a)).when(a == 0, float("-inf")).when(a.isNotNull(), float("nan"))


@dataclass(frozen=True)
class Kernel:
    """f(d, w) and df/dd. check: raises on weights it can't take. paired: w is a deviation and a weight, as a struct
    column of these names or an array of two columns."""

    name: str
    on: str
    f: Callable[..., Any]
    slope_: Callable[..., Any]
    check: Callable[[np.ndarray], None] = field(default=lambda w: None)
    paired: bool = False

    def column(self, d: Column, w: Column) -> Column:
        return self.f(_Columns, d, w)

    def slope_column(self, d: Column, w: Column) -> Column:
        return self.slope_(_Columns, d, w)

    def value(self, d: np.ndarray, w: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return self.f(_Arrays, d, w)

    def slope(self, d: np.ndarray, w: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return self.slope_(_Arrays, d, w)

    def __call__(self, distances: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.value(np.asarray(distances, float), np.asarray(weights, float))


def custom(value: Callable, slope: Callable | None = None, on: str = "weight", name: str = "custom") -> Kernel:
    """A kernel from NumPy functions of (d, w); without a slope, central differences serve. As a Column it is a
    vectorised user function over Arrow batches."""

    def numeric(d, w):
        h = 1e-6 * np.maximum(1.0, np.abs(d))
        return (value(d + h, w) - value(np.maximum(d - h, 0.0), w)) / (d + h - np.maximum(d - h, 0.0))

    def either(g):
        def run(m, d, w):
            return g(d, w) if m is _Arrays else _batched(g)(d, w)

        return run

    return Kernel(name, on, either(value), either(slope or numeric))


def _batched(g: Callable):
    def on_batches(d: pd.Series, w: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(g(d.to_numpy(float), w.to_numpy(float)))

    return F.pandas_udf(on_batches, "double")


def register(spark: SparkSession, name: str, kernel: Kernel) -> None:
    """Make a kernel a SQL function of (distance, weight), and its slope one called `name`_slope."""
    spark.udf.register(name, _batched(kernel.value))
    spark.udf.register(f"{name}_slope", _batched(kernel.slope))


def _softplus(m, z):
    return m.max(z, 0.0) + m.log1p(m.exp(-m.abs(z)))


def _logistic(m, z):
    return 1.0 / (1.0 + m.exp(-z))


# ---- penalties


def linear() -> Kernel:
    return Kernel("linear", "weight", lambda m, d, w: w * d, lambda m, d, w: w + 0.0 * d)


def quadratic() -> Kernel:
    return Kernel("quadratic", "weight", lambda m, d, w: w * d * d, lambda m, d, w: 2.0 * w * d)


def cubic() -> Kernel:
    return Kernel("cubic", "weight", lambda m, d, w: w * m.pow(d, 3), lambda m, d, w: 3.0 * w * d * d)


def power(exponent: float) -> Kernel:
    return Kernel("power", "weight", lambda m, d, w: w * m.pow(d, exponent), lambda m, d, w: w * exponent * m.pow(d, exponent - 1))


def huber(threshold: float = 0.5) -> Kernel:
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    t = threshold
    return Kernel(
        "huber",
        "weight",
        lambda m, d, w: m.where(d < t, 0.5 * w * d * d, w * t * (d - 0.5 * t)),
        lambda m, d, w: m.where(d < t, w * d, w * t),
    )


def logistic(threshold: float = 0.0, alpha: float = 3.0) -> Kernel:
    return Kernel(
        "logistic",
        "weight",
        lambda m, d, w: w * _softplus(m, alpha * (d - threshold)),
        lambda m, d, w: w * alpha * _logistic(m, alpha * (d - threshold)),
    )


def sigmoid(threshold: float, alpha: float = 1.0) -> Kernel:
    s = lambda m, d: _logistic(m, alpha * (d - threshold))
    return Kernel("sigmoid", "weight", lambda m, d, w: w * s(m, d), lambda m, d, w: w * alpha * s(m, d) * (1.0 - s(m, d)))


def hinge(threshold: float, sigma: float | None = None) -> Kernel:
    g = threshold / 2 if sigma is None else sigma
    inner = lambda m, d, w: w * (d - (threshold - m.sign(w) * g))
    return Kernel("hinge", "weight", lambda m, d, w: m.max(inner(m, d, w), 0.0), lambda m, d, w: m.where(inner(m, d, w) > 0, w, 0.0))


def log1p(exponent: float = 1.5) -> Kernel:
    e = exponent
    return Kernel("log1p", "weight", lambda m, d, w: w * m.log1p(m.pow(d, e)), lambda m, d, w: w * e * m.pow(d, e - 1) / (1.0 + m.pow(d, e)))


def log(exponent: float = 1.0) -> Kernel:
    e = exponent
    return Kernel(
        "log", "weight", lambda m, d, w: w * m.log(-m.expm1(-m.pow(d, e))), lambda m, d, w: m.div(w * e * m.pow(d, e - 1), m.expm1(m.pow(d, e)))
    )


def inv_power(exponent: float = 1.0) -> Kernel:
    def check(w):
        if (np.asarray(w) > 0).any():
            raise ValueError("weights must not be positive")

    e = exponent
    return Kernel("inv_power", "weight", lambda m, d, w: m.div(m.abs(w), m.pow(d, e)), lambda m, d, w: m.div(-e * m.abs(w), m.pow(d, e + 1)), check)


def log_ratio(exponent: float = 2.0) -> Kernel:
    e = exponent
    return Kernel("log_ratio", "weight", lambda m, d, w: w * m.log(m.pow(d, e) / (1.0 + m.pow(d, e))), lambda m, d, w: m.div(w * e, d * (1.0 + m.pow(d, e))))


def push_and_pull(attractive: Kernel | None = None, repulsive: Kernel | None = None) -> Kernel:
    """Weights of 0 or more attract, negative ones repel."""
    a, r = attractive or log1p(), repulsive or log_ratio()

    def check(w):
        w = np.asarray(w)
        if w.ndim and w.size == 1:
            raise ValueError("needs more than one weight")
        a.check(w[w >= 0])
        r.check(w[w < 0])

    return Kernel(
        "push_and_pull",
        "weight",
        lambda m, d, w: m.where(w >= 0, a.f(m, d, w), r.f(m, d, w)),
        lambda m, d, w: m.where(w >= 0, a.slope_(m, d, w), r.slope_(m, d, w)),
        check,
    )


def deadzone_quadratic(threshold: float) -> Kernel:
    return Kernel("deadzone_quadratic", "weight", lambda m, d, w: m.where(d < threshold, 0.0, w * d * d), lambda m, d, w: m.where(d < threshold, 0.0, 2.0 * w * d))


def deadzone_cubic(threshold: float) -> Kernel:
    return Kernel("deadzone_cubic", "weight", lambda m, d, w: m.where(d < threshold, 0.0, w * m.pow(d, 3)), lambda m, d, w: m.where(d < threshold, 0.0, 3.0 * w * d * d))


def clipped_quadratic(threshold: float) -> Kernel:
    top = (threshold + 1.0) ** 2
    return Kernel("clipped_quadratic", "weight", lambda m, d, w: w * m.min(d * d, top), lambda m, d, w: m.where(d * d < top, 2.0 * w * d, 0.0))


# ---- losses: u is the deviation


def loss_quadratic() -> Kernel:
    return Kernel("quadratic", "deviation", lambda m, d, u: (d - u) * (d - u), lambda m, d, u: 2.0 * (d - u))


def _given(kernel: Kernel) -> Kernel:
    """A loss times a weight of its own for each pair."""

    def times(g):
        def run(m, d, w):
            u, weight = m.pair(w)
            return weight * g(m, d, u)

        return run

    return Kernel(kernel.name, kernel.on, times(kernel.f), times(kernel.slope_), paired=True)


def loss_weighted_quadratic(given: bool = False) -> Kernel:
    """Weighted by 1 over the squared deviation, or by given weights (Kernel.paired)."""
    if given:
        return _given(loss_quadratic())
    return Kernel("weighted_quadratic", "deviation", lambda m, d, u: m.div((d - u) * (d - u), u * u), lambda m, d, u: m.div(2.0 * (d - u), u * u))


def loss_huber(threshold: float) -> Kernel:
    t = threshold
    return Kernel(
        "huber",
        "deviation",
        lambda m, d, u: m.where(m.abs(d - u) < t, (d - u) * (d - u), t * (2.0 * m.abs(d - u) - t)),
        lambda m, d, u: m.where(m.abs(d - u) < t, 2.0 * (d - u), 2.0 * t * m.sign(d - u)),
    )


def loss_cubic() -> Kernel:
    return Kernel("cubic", "deviation", lambda m, d, u: m.pow(m.abs(d - u), 3), lambda m, d, u: 3.0 * (d - u) * (d - u) * m.sign(d - u))


def loss_power(exponent: float) -> Kernel:
    e = exponent
    return Kernel("power", "deviation", lambda m, d, u: m.pow(m.abs(d - u), e), lambda m, d, u: e * m.pow(m.abs(d - u), e - 1) * m.sign(d - u))


def loss_absolute() -> Kernel:
    return Kernel("absolute", "deviation", lambda m, d, u: m.abs(d - u), lambda m, d, u: m.sign(d - u))


def loss_logistic() -> Kernel:
    return Kernel("logistic", "deviation", lambda m, d, u: _softplus(m, m.abs(d - u)), lambda m, d, u: _logistic(m, m.abs(d - u)) * m.sign(d - u))


def loss_fractional() -> Kernel:
    return Kernel("fractional", "deviation", lambda m, d, u: m.max(m.div(u, d), m.div(d, u)) - 1.0, lambda m, d, u: m.where(d > u, m.div(1.0, u), m.div(-u, d * d)))


def loss_soft_fractional(gamma: float = 10.0) -> Kernel:
    if gamma <= 0:
        raise ValueError("gamma must be positive")
    s = lambda m, d, u: _logistic(m, gamma * (m.div(d, u) - m.div(u, d)))
    return Kernel(
        "soft_fractional",
        "deviation",
        lambda m, d, u: m.max(m.div(u, d), m.div(d, u)) + (m.log1p(m.exp(-gamma * m.abs(m.div(u, d) - m.div(d, u)))) - float(np.log(2.0))) / gamma - 1.0,
        lambda m, d, u: m.div(s(m, d, u), u) - m.div((1.0 - s(m, d, u)) * u, d * d),
    )


def loss_clipped_quadratic(threshold: float) -> Kernel:
    top = (threshold + 1.0) ** 2
    return Kernel("clipped_quadratic", "deviation", lambda m, d, u: m.min((d - u) * (d - u), top), lambda m, d, u: m.where((d - u) * (d - u) < top, 2.0 * (d - u), 0.0))


def loss_weighted_power(exponent: float, given: bool = False) -> Kernel:
    """Weighted as loss_weighted_quadratic."""
    if given:
        return _given(loss_power(exponent))
    e = exponent
    return Kernel(
        "weighted_power", "deviation", lambda m, d, u: m.div(m.pow(m.abs(d - u), e), u * u), lambda m, d, u: m.div(e * m.pow(m.abs(d - u), e - 1) * m.sign(d - u), u * u)
    )


def loss_log1p(exponent: float) -> Kernel:
    """Of the signed difference: not a number where it is negative and the exponent no whole number."""
    e = exponent
    return Kernel("log1p", "deviation", lambda m, d, u: m.log1p(m.pow(d - u, e)), lambda m, d, u: e * m.pow(d - u, e - 1) / (1.0 + m.pow(d - u, e)))
