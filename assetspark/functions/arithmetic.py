"""Integer and rounding helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def div(a, b) -> Column:
    """Integral division, exact for 64-bit keys."""
    return F.call_function("div", _col(a), _col(b))


def half_up(value: Column) -> Column:
    """floor(x + 0.5) as a whole number."""
    return F.floor(value + 0.5)


def half_even(value: Column, guard: int = 9) -> Column:
    """Round half to even; guard digits absorb summation-order noise."""
    return F.bround(F.round(value, guard)).cast("long")


def clip(value: Column, low, high) -> Column:
    return F.least(_col(high), F.greatest(_col(low), value))


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def issue_codes(**problems: Column) -> Column:
    """Sorted array of the names whose condition holds (null counts as false)."""
    return F.array_compact(
        F.array(*[F.when(problems[name], F.lit(name)) for name in sorted(problems)])
    )


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))
