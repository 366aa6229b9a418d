import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filigree.functions import kernels as K

PENALTIES = [K.linear(), K.quadratic(), K.cubic(), K.power(1.7), K.huber(0.5), K.logistic(), K.sigmoid(0.4), K.hinge(0.4), K.log1p(), K.log(), K.log_ratio(), K.push_and_pull(), K.deadzone_quadratic(0.5), K.deadzone_cubic(0.5), K.clipped_quadratic(0.5)]
LOSSES = [K.loss_quadratic(), K.loss_weighted_quadratic(), K.loss_huber(0.3), K.loss_cubic(), K.loss_power(1.5), K.loss_absolute(), K.loss_logistic(), K.loss_fractional(), K.loss_soft_fractional(), K.loss_clipped_quadratic(0.5), K.loss_weighted_power(1.5), K.loss_log1p(2)]


@pytest.mark.parametrize("kernel", [*PENALTIES, *LOSSES, K.inv_power()], ids=lambda k: f"{k.on}-{k.name}")
@pytest.mark.parametrize("w", [1.5, -0.7, 0.9])
def test_slope_is_the_derivative(kernel, w):
    if kernel.name == "inv_power":
        w = -abs(w)
    if kernel.on == "deviation":
        w = abs(w)
    d = np.array([0.11, 0.33, 0.77, 1.21, 2.6])
    h = 1e-6
    got = (kernel.value(d + h, np.full(5, w)) - kernel.value(d - h, np.full(5, w))) / (2 * h)
    np.testing.assert_allclose(kernel.slope(d, np.full(5, w)), got, rtol=1e-5, atol=1e-6)


def test_columns_equal_arrays(spark):
    rng = np.random.default_rng(0)
    d, w = rng.uniform(0.05, 3, 60), rng.uniform(0.2, 2, 60)
    table = spark.createDataFrame([(float(a), float(b)) for a, b in zip(d, w)], "d double, w double")
    every = [*PENALTIES, *LOSSES, K.inv_power()]
    rows = table.select(*(k.column(F.col("d"), F.col("w")).alias(f"f{i}") for i, k in enumerate(every)), *(k.slope_column(F.col("d"), F.col("w")).alias(f"g{i}") for i, k in enumerate(every))).collect()
    for i, k in enumerate(every):
        np.testing.assert_allclose([r[f"f{i}"] for r in rows], k.value(d, w), rtol=1e-12, atol=1e-12)
        np.testing.assert_allclose([r[f"g{i}"] for r in rows], k.slope(d, w), rtol=1e-12, atol=1e-12)


def test_zero_distance_and_nulls_do_not_raise(spark):
    t = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0), (None, 1.0), (1.0, None), (0.0, -1.0)], "d double, w double")
    for k in [*PENALTIES, *LOSSES, K.inv_power()]:
        rows = t.select(k.column(F.col("d"), F.col("w")).alias("f"), k.slope_column(F.col("d"), F.col("w")).alias("g")).collect()
        assert len(rows) == 5
    assert t.select(K.inv_power().column(F.col("d"), F.col("w")).alias("f")).first()["f"] == float("inf")


def test_goldens():
    np.testing.assert_allclose(K.quadratic()([2, 1, 4], [1, 2, 3]), [4, 2, 48])
    np.testing.assert_allclose(K.loss_quadratic()([2, 5, 4], [1, 2, 3]), [1, 9, 1])
    np.testing.assert_allclose(K.loss_logistic()([1.0], [1.0]), [np.log(2)])


def test_refused_parameters():
    for bad in (lambda: K.huber(-1), lambda: K.loss_soft_fractional(0), lambda: K.inv_power().check([1.0]), lambda: K.push_and_pull().check(np.array([1.0]))):
        with pytest.raises(ValueError):
            bad()


def test_custom_kernel_without_slope(spark):
    k = K.custom(lambda d, w: w * d**2)
    np.testing.assert_allclose(k.slope(np.array([0.5, 2.0]), np.array([1.0, 3.0])), [1, 12], rtol=1e-6)
    rows = spark.createDataFrame([(0.5, 1.0), (2.0, 3.0)], "d double, w double").select(k.column(F.col("d"), F.col("w")).alias("v"))
    assert sorted(r["v"] for r in rows.collect()) == [0.25, 12.0]


@settings(max_examples=60, deadline=None)
@given(st.floats(0.01, 50), st.floats(0.01, 50))
def test_soft_fractional_is_near_fractional(d, u):
    soft, hard = K.loss_soft_fractional(1000.0), K.loss_fractional()
    assert abs(soft.value(np.array([d]), np.array([u]))[0] - hard.value(np.array([d]), np.array([u]))[0]) < 1e-2
