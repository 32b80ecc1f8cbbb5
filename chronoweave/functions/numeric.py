"""Number functions with IEEE results where Spark would raise or give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def number(x: float | int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def round_to_decimal_digits(c: Column, digits: int) -> Column:
    """Half away from zero; unchanged if abs(digits) >= 100 and for NaN and infinities."""
    if abs(digits) >= 100:
        return c
    return F.when(F.isnan(c) | (F.abs(c) == INF), c).otherwise(F.round(c, digits))


def round_to_significant_digits(c: Column, digits: int) -> Column:
    """Unchanged for 0, NaN, infinities, no digits, and 18 digits or more."""
    if digits <= 0 or digits >= 18:
        return c
    size = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(c))))
    return F.when((c == 0) | F.isnan(c) | (F.abs(c) == INF), c).otherwise(F.round(c * size) / size)


def floor_mod(a: Column, n: int | Column) -> Column:
    """Modulo with the sign of a positive n."""
    return F.pmod(a, F.lit(n) if not isinstance(n, Column) else n)


def divide(a: Column, b: Column) -> Column:
    """a / b as IEEE has it: 0/0 is NaN, x/0 an infinity."""
    zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def remainder(a: Column, b: Column) -> Column:
    """Remainder with the sign of a; NaN by 0. Where a / b rounds to a whole number nothing is left: 0.4 as a double is a
    little more than 0.4, and 102.8 % 0.4 would be 0.4."""
    d = F.when(b != 0, b)
    q = F.abs(a / d)
    whole = (q >= 1) & (q < 2.0**53) & (q == F.rint(q))
    return F.when((b == 0) | F.isnan(b) | F.isnan(a) | (F.abs(a) == INF), NAN).when(whole, a * 0.0).otherwise(a % d)


def log(c: Column, base: float | None = None) -> Column:
    f = {None: F.ln, 2.0: F.log2, 10.0: F.log10}[base]
    return F.when(c == 0, -INF).when((c < 0) | F.isnan(c), NAN).otherwise(f(c))


def less(a: Column, b: Column) -> Column:
    """a < b, false with NaN on either side (Spark holds NaN to be the largest value)."""
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def equal(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a == b)


def proper(c: Column) -> Column:
    """NULL for NaN, so that aggregates leave it out."""
    return F.when(~F.isnan(c), c)


def min_or_nan(c: Column) -> Column:
    """Least value; NaN is skipped unless there is nothing else."""
    return F.coalesce(F.min(proper(c)), F.min(c))


def max_or_nan(c: Column) -> Column:
    return F.coalesce(F.max(proper(c)), F.min(c))
