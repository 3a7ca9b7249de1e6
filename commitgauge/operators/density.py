"""Kernel density of a value per group, the curve a violin draws: linear binning on a grid, then a Gaussian kernel.

Work does not grow with the rows beyond one grouped pass: values are counted per distinct value first, each count is
shared between the two grid points around its value (linear binning), and the grid of ``points`` bins is convolved
with the kernel as a join of grid with grid inside each group (``points`` squared rows a group, whatever its size).
The error against the exact sum of kernels over all rows is of the order (grid step / bandwidth) squared.

Bandwidth rules: ``nrd0`` is 0.9 min(sd, IQR / 1.34) n^-1/5 (the default of R's density and violins), ``scott`` is
sd n^-1/5 (the default of the Python violins). Where that spread is 0 or undefined (one value, or all equal), the
standard deviation, else the absolute smallest value, else 1 stands in. The grid reaches ``cut`` bandwidths beyond
the smallest and largest value. Missing and NaN values take no part; a group without values has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitgauge.operators.focus import count_by
from commitgauge.operators.scoring import exact_quantiles

# Fixed values of the rules.
NRD0_FACTOR = 0.9
IQR_TO_SD = 1.34
EXPONENT = -0.2
ROOT_TWO_PI = math.sqrt(2 * math.pi)


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def bandwidths(df: DataFrame, value: str, by: Sequence[str], rule: str = "nrd0") -> DataFrame:
    """Per group: n, lo, hi, bandwidth."""
    by = list(by)
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    stats = usable.groupBy(*by).agg(
        F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    sd = F.col("s.sd")
    if rule == "nrd0":
        quartiles = exact_quantiles(usable, value, by, (0.25, 0.75))
        joined = stats.alias("s").join(quartiles.alias("q"), _same(by, "s", "q"))
        spread = F.least(sd, (F.col("q.q75") - F.col("q.q25")) / IQR_TO_SD)
        factor = NRD0_FACTOR
    elif rule == "scott":
        joined, spread, factor = stats.alias("s"), sd, 1.0
    else:
        raise ValueError(f"unknown bandwidth rule {rule}")
    nonzero = lambda c: F.when(c != 0, c)
    spread = F.coalesce(nonzero(spread), nonzero(sd), nonzero(F.abs(F.col("s.lo"))), F.lit(1.0))
    width = factor * spread * F.pow(F.col("s.n").cast("double"), F.lit(EXPONENT))
    return joined.select(*(F.col(f"s.{k}").alias(k) for k in by), "s.n", "s.lo", "s.hi", width.alias("bandwidth"))


def density(
    df: DataFrame, value: str, by: Sequence[str], points: int = 512, cut: float = 3.0, rule: str = "nrd0"
) -> DataFrame:
    """Rows (by..., point, x, density, bandwidth, n): the density at ``points`` even grid points of each group."""
    if points < 2:
        raise ValueError("a grid needs two points at least")
    by = list(by)
    groups = bandwidths(df, value, by, rule)
    start = F.col("lo") - cut * F.col("bandwidth")
    step = (F.col("hi") - F.col("lo") + 2 * cut * F.col("bandwidth")) / (points - 1)
    groups = groups.withColumns({"start": start, "step": step})

    counted = count_by(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value))), *by, value, name="_c")
    placed = counted.alias("v").join(groups.alias("g"), _same(by, "v", "g"))
    at = (F.col(f"v.{value}") - F.col("g.start")) / F.col("g.step")
    low = F.least(F.floor(at), F.lit(points - 2)).cast("int")
    share = at - low
    halves = F.array(
        F.struct(low.alias("k"), (F.col("v._c") * (1 - share)).alias("w")),
        F.struct((low + 1).alias("k"), (F.col("v._c") * share).alias("w")),
    )
    bins = placed.select(*(F.col(f"g.{k}").alias(k) for k in by), F.explode(halves).alias("b"))
    bins = bins.groupBy(*by, F.col("b.k").alias("k")).agg(F.sum("b.w").alias("w"))

    grid = groups.select(*by, "n", "start", "step", "bandwidth", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    pairs = grid.alias("p").join(bins.alias("b"), _same(by, "p", "b"))
    z = (F.col("p.point") - F.col("b.k")) * F.col("p.step") / F.col("p.bandwidth")
    kernel = F.col("b.w") * F.exp(-0.5 * z * z) / ROOT_TWO_PI
    summed = pairs.groupBy(*(F.col(f"p.{k}").alias(k) for k in by), "p.point", "p.n", "p.start", "p.step", "p.bandwidth").agg(
        F.sum(kernel).alias("_sum")
    )
    return summed.select(
        *by,
        F.col("point").cast("int").alias("point"),
        (F.col("start") + F.col("point") * F.col("step")).alias("x"),
        (F.col("_sum") / (F.col("n") * F.col("bandwidth"))).alias("density"),
        "bandwidth",
        F.col("n").cast("long").alias("n"),
    )
