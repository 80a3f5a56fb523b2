"""Normal distribution as built-in column expressions (Spark has no erf).

The cdf is the rational approximation of Hart (1968) as given by West (2005), good to about
1e-15. The inverse is Acklam's rational approximation with one Halley step on that cdf.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients, highest power first.
CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
INV_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
INV_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01, 1.0)
INV_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
INV_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00, 1.0)
INV_TAIL = 0.02425
EULER_GAMMA = 0.5772156649015329


def _poly(coef: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + F.lit(c)
    return out


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once. These formulas use their argument dozens of times; written out
    in place they would overflow the size limit of generated code."""
    return F.transform(F.array(x), f)[0]


def _cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * _poly(CDF_NUM, a) / _poly(CDF_DEN, a)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / F.lit(2.506628274631)
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_cdf(x: Column) -> Column:
    return _let(x, _cdf)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail."""
    return 2 * norm_cdf(-F.abs(z))


def _ppf_start(p: Column) -> Column:
    low = F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    q = p - 0.5
    r = q * q
    return (
        F.when(p < INV_TAIL, _poly(INV_C, low) / _poly(INV_D, low))
        .when(p > 1 - INV_TAIL, -_poly(INV_C, high) / _poly(INV_D, high))
        .otherwise(_poly(INV_A, r) * q / _poly(INV_B, r))
    )


def norm_ppf(p: Column) -> Column:
    """Inverse normal cdf for 0 < p < 1."""

    def refine(x: Column) -> Column:
        err = (norm_cdf(x) - p) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
        return _let(err, lambda u: x - u / (1 + x * u / 2))

    return _let(_let(p, _ppf_start), refine)
