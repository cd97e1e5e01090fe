"""Numeric Column functions: safe ratios, money sums, the normal distribution.

Everything here is a plain Column expression, so it stays inside generated code
and needs no Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of erf / erfc, W. J. Cody,
# "Rational Chebyshev approximations for the error function", Math. Comp. 1969.
# Numerator and denominator per region, highest power first.
ERF_SMALL = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
     3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2,
     1.28261652607737228e3, 2.84423683343917062e3),
)
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
     6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
     1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
     1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
     3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_TAIL = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
     1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1,
     6.05183413124413191e-2, 2.33520497626869185e-3),
)

# Normal quantile, M. J. Wichura, algorithm AS 241 (PPND16),
# Applied Statistics 1988. Highest power first.
PPF_CENTER = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
     4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
     1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
     2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
     4.2313330701600911252e1, 1.0),
)
PPF_MIDDLE = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
     1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
     4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
     1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
     2.05319162663775882187e0, 1.0),
)
PPF_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
     2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
     5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
     7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
     5.99832206555887937690e-1, 1.0),
)


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(num: Column | str, den: Column | str) -> Column:
    """num / den as a double; NULL when the denominator is zero or NULL."""
    return F.try_divide(_as_column(num).cast("double"), _as_column(den).cast("double"))


def rate_or_zero(num: Column | str, den: Column | str) -> Column:
    """num / den, 0.0 when there is no denominator (the rule of the statistics)."""
    return F.coalesce(safe_divide(num, den), F.lit(0.0))


def money(c: Column | str) -> Column:
    """Cents-exact form of an amount, so that sums do not depend on row order."""
    return _as_column(c).cast("decimal(18,2)")


def money_sum(c: Column | str) -> Column:
    return F.sum(money(c)).cast("double")


def rounded(c: Column | str, digits: int = 8) -> Column:
    """Rounded double without a negative zero; for reports."""
    c = _as_column(c).cast("double")
    return F.when(F.abs(c) < 0.5 * 10.0**-digits, F.lit(0.0)).otherwise(F.round(c, digits))


def _polynomial(coefficients, x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def _rational(pair, x: Column) -> Column:
    return _polynomial(pair[0], x) / _polynomial(pair[1], x)


def erfc(x: Column | str) -> Column:
    """Complementary error function, about 1e-15 relative error."""
    x = _as_column(x).cast("double")
    y = F.abs(x)
    # greatest() keeps the branch that is not taken away from a zero division
    inverse_square = F.lit(1.0) / F.greatest(y * y, F.lit(1e-300))
    small = F.lit(1.0) - x * _rational(ERF_SMALL, y * y)
    middle = F.exp(-y * y) * _rational(ERFC_MIDDLE, y)
    tail = (
        F.exp(-y * y)
        * (F.lit(1.0 / math.sqrt(math.pi)) - inverse_square * _rational(ERFC_TAIL, inverse_square))
        / F.greatest(y, F.lit(1e-150))
    )
    positive = F.when(y <= 4.0, middle).otherwise(tail)
    return F.when(y <= 0.46875, small).when(x < 0, F.lit(2.0) - positive).otherwise(positive)


def normal_cdf(x: Column | str) -> Column:
    return F.lit(0.5) * erfc(-_as_column(x).cast("double") / F.lit(math.sqrt(2.0)))


def two_sided_p(z: Column | str) -> Column:
    """2 * (1 - cdf(|z|)) without cancellation in the far tail."""
    return erfc(F.abs(_as_column(z).cast("double")) / F.lit(math.sqrt(2.0)))


def normal_ppf(p: Column | str) -> Column:
    """Standard normal quantile; NULL outside (0, 1)."""
    p = _as_column(p).cast("double")
    inside = F.when((p > 0) & (p < 1), p)
    q = inside - 0.5
    center = q * _rational(PPF_CENTER, F.lit(0.180625) - q * q)
    r = F.sqrt(-F.log(F.least(inside, F.lit(1.0) - inside)))
    edge = F.when(r <= 5.0, _rational(PPF_MIDDLE, r - 1.6)).otherwise(_rational(PPF_TAIL, r - 5.0))
    return F.when(F.abs(q) <= 0.425, center).otherwise(F.signum(q) * edge)
