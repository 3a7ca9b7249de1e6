"""p-values from the incomplete beta function with a fixed number of steps, against the finite series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitgauge.functions import stats as S
from commitgauge.operators import trends


def series(t, v):
    """Two-sided p of Student's t by the trigonometric series of v / 2 terms."""
    theta = math.atan(abs(t) / math.sqrt(v))
    c2 = math.cos(theta) ** 2
    if v % 2:
        term = total = math.cos(theta)
        for k in range(2, (v - 1) // 2 + 1):
            term *= c2 * (2 * k - 2) / (2 * k - 1)
            total += term
        return 1 - 2 / math.pi * (theta + math.sin(theta) * (total if v > 1 else 0.0))
    term = total = 1.0
    for k in range(2, v // 2 + 1):
        term *= c2 * (2 * k - 3) / (2 * k - 2)
        total += term
    return 1 - math.sin(theta) * total


def test_equal_to_the_series_for_1_to_200_degrees(spark):
    rows = [(t, v) for v in range(1, 201) for t in (0.0, 0.3, 1.0, 2.5, 7.0, -40.0)]
    df = spark.createDataFrame(rows, "t double, v long").withColumn("p", S.t_test_p_value(F.col("t"), F.col("v")))
    assert max(abs(r.p - series(r.t, r.v)) for r in df.collect()) < 1e-10


def test_ten_million_degrees(spark):
    rows = [(1.96, 10**7), (0.5, 10**7), (4.0, 10**7)]
    df = spark.createDataFrame(rows, "t double, v long").withColumn("p", S.t_test_p_value(F.col("t"), F.col("v")))
    for r in df.collect():  # the series itself rounds over 5 million terms: about 1e-10 of error of its own
        assert abs(r.p - series(r.t, r.v)) < 1e-9


def test_edges(spark):
    rows = [(0.0, 5), (1e300, 3), (2.0, None), (None, 4), (1.0, 0), (-2.0, 2)]
    found = [r.p for r in spark.createDataFrame(rows, "t double, v long").select(S.t_test_p_value(F.col("t"), F.col("v")).alias("p")).collect()]
    assert found[0] == 1.0 and found[1] == 0.0 and found[2] is None and found[3] is None and found[4] is None
    assert found[5] == pytest.approx(series(2.0, 2), abs=1e-12)


def test_grouped_regression_has_errors_and_p_values(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=40)
    y = 2 * x + rng.normal(size=40)
    rows = [("a", float(a), float(b)) for a, b in zip(x, y)] + [("b", 1.0, 2.0), ("b", 2.0, 4.0), ("c", 1.0, 1.0), ("c", 2.0, 3.0), ("c", 3.0, 2.0)]
    fits = {r.g: r for r in trends.grouped_regression(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    slope, intercept = np.polyfit(x, y, 1)
    residual = y - slope * x - intercept
    error = math.sqrt((residual @ residual) / 38 / ((x - x.mean()) @ (x - x.mean())))
    assert fits["a"].slope_error == pytest.approx(error, rel=1e-9)
    assert fits["a"].p_value == pytest.approx(series(slope / error, 38), abs=1e-12)
    assert fits["b"].slope_error is None and fits["b"].p_value is None  # two points
    assert fits["c"].p_value == pytest.approx(series(0.5 / math.sqrt(1.5 / 2), 1), abs=1e-12)
