"""Small expression helpers shared by the plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattlake.config import COOLING_BASE_C, HEATING_BASE_C


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return F.try_divide(num, den)


def avg_if(cond: Column, value: Column) -> Column:
    return F.avg(F.when(cond, value))


def sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value))


def share_if(cond: Column) -> Column:
    """Share of rows for which ``cond`` holds; NULL conditions leave the base."""
    return F.avg(cond.cast("double"))


def clip_low(value: Column, low: float) -> Column:
    return F.greatest(value, F.lit(low))


def heating_degrees(temp: Column, base: float = HEATING_BASE_C) -> Column:
    """``max(0, base - t)``, NULL without a temperature (``greatest`` skips NULLs)."""
    return F.when(temp.isNotNull(), F.greatest(F.lit(0.0), F.lit(base) - temp))


def cooling_degrees(temp: Column, base: float = COOLING_BASE_C) -> Column:
    return F.when(temp.isNotNull(), F.greatest(F.lit(0.0), temp - F.lit(base)))


def outside(value: Column, low: float | None = None, high: float | None = None, inclusive: bool = True) -> Column:
    """True where ``value`` breaks the accepted range; at least one bound is required."""
    if low is None and high is None:
        raise ValueError("an accepted range needs at least one bound")
    broken = []
    if low is not None:
        broken.append(value < low if inclusive else value <= low)
    if high is not None:
        broken.append(value > high if inclusive else value >= high)
    return reduce(lambda a, b: a | b, broken)


def code_name(code: Column, names: dict[str, str]) -> Column:
    """Name of a code from a fixed list, ``UNKNOWN(code)`` when it is not listed."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.concat(F.lit("UNKNOWN("), code, F.lit(")")))


def code_or_self(code: Column, names: dict[str, str]) -> Column:
    """Mapped value, or the code itself so that a new one stays visible."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


