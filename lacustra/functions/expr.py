"""Column helpers for missing data: NaN is missing, division never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def not_nan(v: Column) -> Column:
    """v as double with NaN as null, so that aggregates skip it."""
    d = v.cast("double")
    return F.when(F.isnan(d), F.lit(None)).otherwise(d)


def finite(v: Column) -> Column:
    """Whether v is neither null, NaN nor infinite."""
    d = v.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(INF))


def cleaned(quotient: Column, clip: bool = True) -> Column:
    """Null, NaN and infinities become 0, and only then the range -1..1 is enforced; the sum with 0.0 turns -0.0 into 0.0."""
    q = F.when(finite(quotient), quotient).otherwise(F.lit(0.0))
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q)) if clip else q) + F.lit(0.0)


def ratio(over: Column, under: Column) -> Column:
    """over / under in double; null where under is 0."""
    return F.try_divide(over.cast("double"), under.cast("double"))


def scaled(v: Column, scale: float | None) -> Column:
    return v.cast("double") if scale is None else ratio(v, F.lit(float(scale)))


def rounded(v: Column, digits: int = 9) -> Column:
    return F.round(v, digits) + F.lit(0.0)


def in_parts(n: Column) -> Column:
    """n, a count, in a way that has Spark compile the aggregates beside it in parts: many of them in one method are too large for the JVM to compile."""
    return n + F.size(F.collect_list(F.lit(None)))
