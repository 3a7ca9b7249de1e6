"""Score and trend statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitgauge import fixed_values as V


def ccs_score(
    complexity: Column,
    files: Column,
    lines: Column,
    *,
    plus_one: bool = False,
    weights: tuple[float, float, float] = (V.WEIGHT_COMPLEXITY, V.WEIGHT_FILES, V.WEIGHT_LINES),
) -> Column:
    """Weighted complexity plus damped sizes; a missing or NaN size counts as 1.

    ``plus_one`` takes log10(x + 1) instead of log10(max(1, x)).
    """

    def damped(size: Column) -> Column:
        number = size.cast("double")
        if plus_one:
            return F.log10(F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0)) + 1)
        return F.log10(F.greatest(F.lit(1.0), F.nanvl(number, F.lit(1.0))))

    w_complexity, w_files, w_lines = weights
    return (
        F.lit(w_complexity) * complexity.cast("double")
        + F.lit(w_files) * damped(files)
        + F.lit(w_lines) * damped(lines)
    )


#: Continued-fraction steps of the incomplete beta function: enough for 10^7 degrees of freedom (the fraction needs
#: about the square root of the larger shape parameter); a step that changes nothing stops the updates.
BETA_STEPS = 4096
_TINY = 1e-300
_EPSILON = 1e-16
# Coefficients of Stirling's series for log Gamma.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
_SHIFT = 8


def _stirling_rest(z: Column) -> Column:
    return sum((F.lit(c) / F.pow(z, 2 * k + 1) for k, c in enumerate(_STIRLING)), F.lit(0.0))


def log_gamma_half_step(a: Column) -> Column:
    """log Gamma(a + 1/2) - log Gamma(a) for a > 0, without the cancellation of two large logarithms: Stirling's
    series at a + 8, brought down by the recurrence Gamma(z + 1) = z Gamma(z)."""
    z = a + _SHIFT
    far = z * F.log1p(0.5 / z) + 0.5 * F.log(z) - 0.5 + _stirling_rest(z + 0.5) - _stirling_rest(z)
    return far - sum((F.log1p(0.5 / (a + i)) for i in range(_SHIFT)), F.lit(0.0))


def _fraction(x: Column, a: Column, b: Column, steps: int) -> Column:
    """The continued fraction of the incomplete beta function by the modified Lentz method, ``steps`` at most."""

    def nonzero(v: Column) -> Column:
        return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def step(state: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        d1 = 1 / nonzero(1 + even * state["d"])
        c1 = nonzero(1 + even / state["c"])
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        d2 = 1 / nonzero(1 + odd * d1)
        c2 = nonzero(1 + odd / c1)
        change = d2 * c2
        moved = F.struct(
            d2.alias("d"), c2.alias("c"), (state["h"] * d1 * c1 * change).alias("h"),
            (F.abs(change - 1) < _EPSILON).alias("done"),
        )
        return F.when(state["done"], state).otherwise(moved)

    d0 = 1 / nonzero(1 - (a + b) * x / (a + 1))
    start = F.struct(d0.alias("d"), F.lit(1.0).alias("c"), d0.alias("h"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["h"]


def t_test_p_value(t: Column, df: Column, steps: int = BETA_STEPS) -> Column:
    """Two-sided p-value of Student's t with ``df`` degrees of freedom (any positive number).

    It is the regularised incomplete beta function I_x(df / 2, 1 / 2) at x = df / (df + t^2), from its continued
    fraction with a fixed number of steps: the work a row is the same for 3 and for 10^7 degrees of freedom. The
    logarithms of x and 1 - x are taken from df and t apart, so that neither loses digits when x is near 0 or 1.
    """
    nu, t = df.cast("double"), t.cast("double")
    a, b = nu / 2, F.lit(0.5)
    log_x = F.log(nu) - F.log(nu + t * t)
    log_rest = 2 * F.log(F.abs(t)) - F.log(nu + t * t)
    x = F.exp(log_x)
    log_beta = 0.5 * math.log(math.pi) - log_gamma_half_step(a)
    front = F.exp(a * log_x + b * log_rest - log_beta)
    near = front * _fraction(x, a, b, steps) / a
    far = 1 - front * _fraction(1 - x, b, a, steps) / b
    p = F.when(t == 0, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), near).otherwise(far)
    return F.when((nu > 0) & t.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def slope_error(n: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Standard error of a fitted slope; NULL for fewer than three points or no spread of x."""
    residual = syy - sxy * sxy / sxx
    return F.when((n >= 3) & (sxx > 0), F.sqrt(F.greatest(residual, F.lit(0.0)) / (n - 2) / sxx))


def slope_p_value(n: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """p-value of a fitted slope; NULL for fewer than three points or an exact fit."""
    residual = syy - sxy * sxy / sxx
    usable = (n >= 3) & (sxx > 0) & (residual > syy * 1e-14)
    return F.when(usable, t_test_p_value(sxy / sxx / slope_error(n, sxx, syy, sxy), n - 2))
