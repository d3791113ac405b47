"""Distribution tails as column expressions (no Python runs for them).

* Student-t two-sided p-value: regularised incomplete beta function of
  (df / 2, 1 / 2), as a continued fraction evaluated from a fixed depth
  backwards.  The depth follows sqrt(df), as the fraction's convergence does.
* Normal distribution function: power series near zero, continued fraction in
  the tails.
* MacKinnon (1994) response-surface p-value for the Dickey-Fuller statistic
  (constant only, one series).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# MacKinnon (1994) response-surface constants for the
# Dickey-Fuller tau statistic, regression with a constant, one series.
ADF_C_TAU_MAX = 2.74
ADF_C_TAU_MIN = -18.83
ADF_C_TAU_STAR = -1.61
ADF_C_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_C_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)

# Stirling's series of ln Gamma: Bernoulli numbers B(2k) / (2k (2k - 1))
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_SHIFT = 10
SERIES_TERMS = 60        # of the normal series, used below TAIL
TAIL = 3.0
TAIL_DEPTH = 200


def _down(depth: Column) -> Column:
    return F.sequence(depth, F.lit(1))


def gamma_ratio_ln(a: Column) -> Column:
    """ln(Gamma(a + 1/2) / Gamma(a)) for a > 0, without the cancellation of two large logarithms."""
    z = a + _SHIFT
    correction = F.lit(0.0)
    for k, c in enumerate(_STIRLING):
        correction += c * (F.pow(z + 0.5, F.lit(-(2.0 * k + 1))) - F.pow(z, F.lit(-(2.0 * k + 1))))
    far = z * F.log1p(0.5 / z) + 0.5 * F.ln(z) - 0.5 + correction
    for i in range(_SHIFT):
        far -= F.log1p(0.5 / (a + i))
    return far


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """1 / (1 + d1 / (1 + d2 / ...)) of the incomplete beta function, from depth sqrt(a + b) upwards."""
    depth = F.ceil(3 * F.sqrt(a + b)).cast("int") + 100

    def step(acc: Column, m: Column) -> Column:
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return even / (1 + odd / (1 + acc))

    tail = F.aggregate(_down(depth), F.lit(0.0), step)          # d2 / (1 + d3 / ...)
    first = -(a + b) * x / (a + 1)
    return 1 / (1 + first / (1 + tail))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for Student-t with ``df`` > 0 degrees of freedom; NULL without t or degrees of freedom."""
    t, df = t.cast("double"), df.cast("double")
    a, half = df / 2, F.lit(0.5)
    near = F.least(F.abs(t), F.lit(1e150))
    x, rest = df / (df + near * near), near * near / (df + near * near)      # rest = 1 - x
    front = F.exp(gamma_ratio_ln(a) - 0.5 * math.log(math.pi) + a * F.when(rest < 0.5, F.log1p(-rest)).otherwise(F.ln(x)) + 0.5 * F.ln(rest))
    direct = x < (a + 1) / (a + 2.5)
    p = F.when(rest == 0, F.lit(1.0)).when(x == 0, F.lit(0.0)).when(
        direct, front / a * _beta_fraction(a, half, x)).otherwise(1 - front / half * _beta_fraction(half, a, rest))
    return F.when(t.isNotNull() & (df > 0) & ~F.isnan(t), F.when(F.abs(t) == float("inf"), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))


def normal_cdf(z: Column) -> Column:
    """P(Z <= z) of the standard normal distribution."""
    size = F.abs(z)
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    # z + z^3 / 3 + z^5 / (3 5) + ... = z (1 + z^2 / 3 (1 + z^2 / 5 (...)))
    series = size * F.aggregate(_down(F.lit(SERIES_TERMS)), F.lit(1.0), lambda acc, k: 1 + acc * z * z / (2 * k + 1))
    far = F.greatest(size, F.lit(TAIL))
    tail = density / (far + F.aggregate(_down(F.lit(TAIL_DEPTH)), F.lit(0.0), lambda acc, k: k / (far + acc)))
    upper = F.when(size < TAIL, 0.5 - density * series).otherwise(tail)      # P(Z > |z|)
    return F.when(z < 0, upper).otherwise(1 - upper)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + c
    return out


def adf_p_value(stat: Column) -> Column:
    """MacKinnon p-value of a Dickey-Fuller t statistic; NULL without one."""
    surface = F.when(stat <= ADF_C_TAU_STAR, _polynomial(ADF_C_SMALL_P, stat)).otherwise(_polynomial(ADF_C_LARGE_P, stat))
    return F.when(stat.isNotNull() & ~F.isnan(stat), F.when(stat > ADF_C_TAU_MAX, F.lit(1.0)).when(stat < ADF_C_TAU_MIN, F.lit(0.0)).otherwise(
        normal_cdf(surface)))
