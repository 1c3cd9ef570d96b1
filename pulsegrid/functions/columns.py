"""Column expressions: rounding, ladders, flags and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    """Rounds to six decimals, the precision of all reported figures.

    Halves are those of the number times a million, as SQL engines round doubles: ``round(x, 6)`` of Spark takes the half of the number's
    shortest decimal form, which the double itself may not reach.
    """
    return F.round((c if isinstance(c, Column) else F.col(c)) * F.lit(1e6)) / F.lit(1e6)


def tenths(c: Column | str) -> Column:
    """Rounds a double to one decimal as ``%.1f`` does in C: by its exact value, and an exact half to the even digit.

    Twenty times x is compared with an odd whole number exactly, in two parts that are short enough to multiply without loss.
    """
    c = c if isinstance(c, Column) else F.col(c)
    x = F.abs(c)
    below, high = F.floor(x * 10), x.cast("float").cast("double")
    over = (high * 20 - (2 * below + 1)) + (x - high) * 20
    up = F.when(over > 0, 1).when(over < 0, 0).otherwise(below % 2)
    return F.when(x < 1e14, F.signum(c) * (below + up) / F.lit(10.0)).otherwise(c)


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: the error of the product (by halves of 26 bits) and that of the sum are added back."""
    half = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    p = a * b
    a1, b1 = half(a), half(b)
    lost = ((a1 * b1 - p) + a1 * (b - b1) + (a - a1) * b1) + (a - a1) * (b - b1)
    s = p + c
    return s + (((p - (s - (s - p))) + (c - (s - p))) + lost)


def between(low: Column, high: Column, part: Column) -> Column:
    """The value so far between two neighbours of a sorted list as ``quantile_cont`` has it: low * (1 - part) + high * part, the first product not rounded."""
    return F.when(part == 0, low).otherwise(_fused(low, 1 - part, high * part))


def ratio(num: Column, den: Column) -> Column:
    """num / den, or 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def share(condition: Column) -> Column:
    """The share of rows that meet a condition, as an aggregate."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def ladder(value: Column, steps: list[tuple[float, str]], other: str, strict: bool = False) -> Column:
    """The label of the first step that value reaches (exceeds, if strict), else ``other``."""
    out = F
    for least, label in steps:
        out = out.when(value > least if strict else value >= least, label)
    return out.otherwise(other)


def flags(*tests: tuple[Column, str]) -> Column:
    """The names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, name) for test, name in tests]))


def points(*tests: Column) -> Column:
    """How many of the tests hold; a test on missing values does not."""
    total = F.lit(0)
    for test in tests:
        total = total + F.coalesce(test, F.lit(False)).cast("int")
    return total
