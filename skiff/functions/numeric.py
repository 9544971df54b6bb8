"""Scalar numbers: arithmetic with the semantics of a compiled Python, casts, and maths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def floor_div(a: Column, b: Column | int) -> Column:
    """Integer division as Python's, rounding down."""
    b = F.lit(b) if isinstance(b, int) else b
    return int_div(a, b) - F.when((a % b != 0) & ((a < 0) != (b < 0)), 1).otherwise(0)


def remainder(a: Column, b: Column | int) -> Column:
    """The remainder with the sign of a."""
    return a % b


def python_mod(a: Column, b: Column | int) -> Column:
    """The remainder with the sign of b."""
    b = F.lit(b) if isinstance(b, int) else b
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def float_div(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is an infinity, 0/0 is NaN, and NULL where a or b is."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).when(a < 0, -INF)
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def _no_nan(test: Column, a: Column, b: Column) -> Column:
    return test & ~F.isnan(a) & ~F.isnan(b)


def eq(a: Column, b: Column) -> Column:
    """Float equality where NaN equals nothing."""
    return _no_nan(a == b, a, b)


def lt(a: Column, b: Column) -> Column:
    return _no_nan(a < b, a, b)


def gt(a: Column, b: Column) -> Column:
    return _no_nan(a > b, a, b)


def power(a: Column, n: float | Column) -> Column:
    """Powers; small whole exponents unroll to products."""
    if isinstance(n, (int, float)) and n == int(n) and 1 <= n <= 4:
        out = a
        for _ in range(int(n) - 1):
            out = out * a
        return out
    return F.pow(a, n)


def to_int(c: Column) -> Column:
    """Strict text to integer; NULL if it is none. Floats truncate."""
    return c.try_cast("bigint")


def to_int_prefix(c: Column) -> Column:
    """Text to integer by its leading digits."""
    return F.regexp_extract(c, r"^[ \t\n\r\f\x0b]*([+-]?[0-9]+)", 1).try_cast("bigint")


def float_text(c: Column) -> Column:
    """Six decimals without trailing zeros, one decimal at least."""
    fixed = F.rtrim(F.format_string("%.6f", c.cast("double")), F.lit("0"))
    return F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed)


def bool_text(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def log(c: Column) -> Column:
    """Natural logarithm with IEEE results at and below 0."""
    c = c.cast("double")
    return F.when(c == 0, -INF).when(c < 0, NAN).otherwise(F.ln(c))


sqrt, exp, sin, cos, arcsin, isnan = F.sqrt, F.exp, F.sin, F.cos, F.asin, F.isnan
absolute, bankers_round, factorial, left_shift, random = F.abs, F.bround, F.factorial, F.shiftleft, F.rand



# The coefficients of Cody's rational approximations of erf and erfc (1969), from the constant term up.
ERF_SMALL = (3.20937758913846947e3, 3.77485237685302021e2, 1.13864154151050156e2, 3.16112374387056560, 1.85777706184603153e-1), (2.84423683343917062e3, 1.28261652607737228e3, 2.44024637934444173e2, 2.36012909523441209e1, 1.0)
ERFC_MIDDLE = (
    (1.23033935479799725e3, 2.05107837782607147e3, 1.71204761263407058e3, 8.81952221241769090e2, 2.98635138197400131e2, 6.61191906371416295e1, 8.88314979438837594, 5.64188496988670089e-1, 2.15311535474403846e-8),
    (1.23033935480374942e3, 3.43936767414372164e3, 4.36261909014324716e3, 3.29079923573345963e3, 1.62138957456669019e3, 5.37181101862009858e2, 1.17693950891312499e2, 1.57449261107098347e1, 1.0),
)


def _ratio(of: tuple, x: Column) -> Column:
    def value(of: tuple) -> Column:
        out = F.lit(of[-1])
        for c in reversed(of[:-1]):
            out = out * x + c
        return out

    return value(of[0]) / value(of[1])


def erf(c: Column) -> Column:
    """The error function, which Spark lacks, as rational forms of 15 digits; 1 or -1 beyond 6."""
    c = c.cast("double")
    x = F.abs(c)
    far = F.signum(c) * (1 - F.exp(-x * x) * _ratio(ERFC_MIDDLE, F.least(x, F.lit(6.0))))
    return F.when(F.isnan(c), c).when(x <= 0.46875, c * _ratio(ERF_SMALL, x * x)).when(x < 6, far).otherwise(F.signum(c))
