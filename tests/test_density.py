"""Violin curves: binned densities against the exact sum of kernels over all rows, bandwidth rules, edge cases."""

import math

import numpy as np
import pytest

from commitgauge.operators import density as D


def exact(values, points, cut, rule):
    """Row by row: the bandwidth rule and the sum of one kernel a value at every grid point."""
    x = np.asarray(values, float)
    n, sd = len(x), (x.std(ddof=1) if len(x) > 1 else float("nan"))
    if rule == "nrd0":
        spread = min(v for v in (sd, (np.percentile(x, 75) - np.percentile(x, 25)) / 1.34) if not math.isnan(v))
    else:
        spread = sd
    for stand_in in (spread, sd, abs(x.min()), 1.0):
        if not math.isnan(stand_in) and stand_in != 0:
            spread = stand_in
            break
    bw = (0.9 if rule == "nrd0" else 1.0) * spread * n**-0.2
    grid = np.linspace(x.min() - cut * bw, x.max() + cut * bw, points)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(1) / (n * bw * math.sqrt(2 * math.pi))
    return bw, grid, dens


@pytest.mark.parametrize("rule,points,cut", [("nrd0", 512, 3.0), ("scott", 100, 2.0)])
def test_binned_density_is_near_the_exact_sum(spark, rule, points, cut):
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(0, 1, 3_000), rng.normal(4, 0.5, 1_000)])
    b = rng.exponential(2.0, 500)
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("a", None), ("b", float("nan"))]
    found = D.density(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], points, cut, rule).toPandas()
    for name, values in (("a", a), ("b", b)):
        mine = found[found.g == name].sort_values("point")
        bw, grid, dens = exact(values, points, cut, rule)
        assert mine.n.iloc[0] == len(values) and abs(mine.bandwidth.iloc[0] - bw) < 1e-12
        assert np.allclose(mine.x, grid, atol=1e-9)
        # linear binning: the error is of the order (step / bandwidth) squared of the peak
        step = grid[1] - grid[0]
        assert np.max(np.abs(mine.density.to_numpy() - dens)) <= (step / bw) ** 2 * dens.max()
        assert abs(np.trapezoid(mine.density, mine.x) - np.trapezoid(dens, grid)) < 1e-3  # same mass on the grid


def test_density_edges(spark):
    rows = [("one", 5.0), ("same", 2.0), ("same", 2.0), ("zero", 0.0), (None, 1.0), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", D.F.lit("clash"))
    found = D.density(df.drop("n"), "v", ["g"], points=16, cut=3.0).toPandas()
    by = {g: part for g, part in found.groupby(found.g.fillna("<null>"))}
    assert set(by) == {"one", "same", "zero", "<null>"}  # a group without values has no rows
    assert by["one"].bandwidth.iloc[0] == pytest.approx(0.9 * 5.0)  # one value: |x| stands in
    assert by["same"].bandwidth.iloc[0] == pytest.approx(0.9 * 2.0 * 2**-0.2)
    assert by["zero"].bandwidth.iloc[0] == pytest.approx(0.9)  # nothing but 0: 1 stands in
    assert (found.density >= 0).all() and len(found) == 4 * 16
    assert D.density(spark.createDataFrame([], "g string, v double"), "v", ["g"]).count() == 0
    with pytest.raises(ValueError):
        D.density(df, "v", ["g"], points=1)
