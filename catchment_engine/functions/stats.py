"""Statistics as Column expressions: everything stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..bands import z_value


def _d(c: Column) -> Column:
    return c.cast("double")


def wald_ci(x: Column, n: Column, confidence: float = 0.95) -> Column:
    """struct(estimate, lower, upper), clamped to 0..1; null unless 0 <= x <= n and n > 0."""
    z = F.lit(z_value(confidence))
    p = F.try_divide(_d(x), _d(n))
    half = z * F.sqrt(p * (1 - p) / _d(n))
    out = F.struct(p.alias("estimate"), F.greatest(F.lit(0.0), p - half).alias("lower"), F.least(F.lit(1.0), p + half).alias("upper"))
    return F.when((n > 0) & (x >= 0) & (x <= n), out)


def wilson_ci(x: Column, n: Column, confidence: float = 0.95) -> Column:
    """struct(estimate, lower, upper) of Wilson's score interval, under the same conditions."""
    z = z_value(confidence)
    p, m = F.try_divide(_d(x), _d(n)), _d(n)
    shrink = 1 + F.lit(z * z) / m
    middle = (p + F.lit(z * z) / (2 * m)) / shrink
    half = F.lit(z) / shrink * F.sqrt(p * (1 - p) / m + F.lit(z * z) / (4 * m * m))
    out = F.struct(p.alias("estimate"), F.greatest(F.lit(0.0), middle - half).alias("lower"), F.least(F.lit(1.0), middle + half).alias("upper"))
    return F.when((n > 0) & (x >= 0) & (x <= n), out)


#: Coefficients of Cody's rational approximations to erf and erfc (1969).
_ERF_P = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_ERF_Q = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_ERFC_P = (5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
_ERFC_Q = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_TAIL_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_TAIL_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(x: Column, p: tuple, q: tuple) -> Column:
    """The last of p leads the numerator, 1 the denominator."""
    top, bottom = F.lit(p[-1]) * x, x
    for a, b in zip(p[:-2], q[:-1], strict=True):
        top, bottom = (top + F.lit(a)) * x, (bottom + F.lit(b)) * x
    return (top + F.lit(p[-2])) / (bottom + F.lit(q[-1]))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def erfc(x: Column) -> Column:
    """Complementary error function, to about 1e-15 relative, also in the tail; null for null."""
    return _let(_d(x), _erfc)


def _erfc(x: Column) -> Column:
    y = F.abs(x)
    # For x the ratio runs over x * x; Horner's scheme as above, on a function of y.
    near = 1 - y * _ratio(y * y, _ERF_P, _ERF_Q)
    middle = F.exp(-y * y) * _ratio(y, _ERFC_P, _ERFC_Q)
    inverse = 1 / (y * y)
    far = F.exp(-y * y) / y * (F.lit(1 / math.sqrt(math.pi)) - inverse * _ratio(inverse, _TAIL_P, _TAIL_Q))
    upper = F.when(y <= 0.46875, near).when(y <= 4.0, middle).when(y < 27.0, far).otherwise(0.0)
    return F.when(x >= 0, upper).when(x < 0, 2 - upper)


def normal_cdf(z: Column) -> Column:
    return erfc(-_d(z) / F.lit(math.sqrt(2))) / 2


def two_prop_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """struct(z, p): pooled two-sided z-test; null fields where the pooled error is 0."""
    x1, n1, x2, n2 = map(_d, (x1, n1, x2, n2))
    pool = F.try_divide(x1 + x2, n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    z = F.try_divide(F.try_divide(x1, n1) - F.try_divide(x2, n2), se)
    return F.struct(z.alias("z"), erfc(F.abs(z) / F.lit(math.sqrt(2))).alias("p"))


def two_prop_yates(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """struct(chisq, p): Yates' corrected test of a two by two table in doubles; a deviation
    below the correction counts as 0; null fields where a margin is 0."""
    a, c = _d(x1), _d(x2)
    b, d = _d(n1) - a, _d(n2) - c
    n = _d(n1) + _d(n2)
    deviation = F.abs(a * d - b * c)
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    chisq = F.when(margins != 0, F.when(deviation < n / 2, F.lit(0.0)).otherwise(F.try_divide(n * (deviation - n / 2) * (deviation - n / 2), margins)))
    return F.struct(chisq.alias("chisq"), erfc(F.sqrt(chisq / 2)).alias("p"))


def ols_slope(x: Column | str, y: Column | str) -> Column:
    """Aggregate: least-squares slope; null for fewer than two points or a constant x."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    slope = F.regr_slope(_d(y), _d(x))
    return F.when(F.regr_count(_d(y), _d(x)) >= 2, F.nanvl(slope, F.lit(None).cast("double")))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with a whole number of degrees of freedom: the
    finite trigonometric sum, as a fold over its terms."""
    t, df = F.abs(_d(t)), df.cast("int")
    angle = F.atan(t / F.sqrt(_d(df)))
    s, c = F.sin(angle), F.cos(angle)
    odd = df % 2 == 1
    # Odd: 2/pi (a + s (c + 2/3 c^3 + ...)); even: s (1 + 1/2 c^2 + 1*3/(2*4) c^4 + ...).
    count = F.when(odd, F.floor((df - 1) / 2)).otherwise(F.floor(df / 2)).cast("int")
    start = F.struct(F.when(odd, c).otherwise(F.lit(1.0)).alias("term"), F.lit(0.0).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        ratio = F.when(odd, (2.0 * k) / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
        return F.struct((acc["term"] * ratio * c * c).alias("term"), (acc["total"] + acc["term"]).alias("total"))

    total = F.aggregate(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["total"])
    inside = F.when(odd, F.lit(2 / math.pi) * (angle + s * total)).otherwise(s * total)
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1 - inside))
