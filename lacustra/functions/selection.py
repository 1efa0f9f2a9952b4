"""Exact percentiles of large tables by narrowing, without a task that holds or reads all values.

A percentile lies at one rank or between two. Each round takes a bounded sketch of the values in a rank's bracket, counts
exactly how many values lie below and at the sketch's values on either side of the rank, and so finds the rank or a
bracket some hundred times smaller. The counts decide, so a sketch's error can only cost another round. What is left of
a bracket, a bounded number of values, is sorted. Tasks send sketches, counts and rests of brackets, never their distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacustra.functions.expr import NAN, not_nan
from lacustra.storage import repeatable

#: Values that a bracket has at most when it is sorted.
LIMIT = 100_000
#: The same for groups, of which a task has up to 128 in memory; groups of so many are left to Spark's own percentile.
GROUP_LIMIT = 20_000
#: Steps of a sketch's percentiles; its error is a quarter of a step.
STEPS = 500


@dataclass
class _Bracket:
    """The values of a group's column between lo and hi, both excluded (None: open): how many come before, how many there are, and the ranks (from 0, in the column) sought."""

    group: tuple
    column: int
    lo: float | None
    hi: float | None
    before: int
    size: int
    ranks: list[int]


def _inside(x: Column, lo: Column, hi: Column) -> Column:
    return F.when((lo.isNull() | (x > lo)) & (hi.isNull() | (x < hi)), x)


def _asked(df: DataFrame, by: Sequence[str], brackets: list[_Bracket], extra: list[list], kind: T.DataType, make: Callable[[Column, Column], Column]) -> list:
    """For each bracket, in one pass, the aggregate that make gives for (the values inside, the bracket's extra list)."""
    if not by:
        made = [make(_inside(F.col(f"v{b.column}"), F.lit(b.lo).cast("double"), F.lit(b.hi).cast("double")), F.array(*map(F.lit, e)).cast(T.ArrayType(kind))) for b, e in zip(brackets, extra, strict=True)]
        return list(df.agg(*[m.alias(f"b{i}") for i, m in enumerate(made)]).first())
    # A group's brackets come as a row of a broadcast table: for each column, slots of which some may be unused (null).
    slots: dict[tuple, dict[tuple[int, int], int]] = {}
    for i, b in enumerate(brackets):
        own = slots.setdefault(b.group, {})
        own[b.column, len([1 for c, _ in own if c == b.column])] = i
    names = sorted({s for own in slots.values() for s in own})
    rows = [(*g, *[x for s in names for x in ((brackets[own[s]].lo, brackets[own[s]].hi, extra[own[s]]) if s in own else (None, None, None))]) for g, own in slots.items()]
    fields = [T.StructField(f"{k}_{c}_{j}", t) for c, j in names for k, t in (("lo", T.DoubleType()), ("hi", T.DoubleType()), ("extra", T.ArrayType(kind)))]
    state = df.sparkSession.createDataFrame(rows, T.StructType([*df.select(*by).schema.fields, *fields]))
    made = [make(F.when(F.col(f"extra_{c}_{j}").isNotNull(), _inside(F.col(f"v{c}"), F.col(f"lo_{c}_{j}"), F.col(f"hi_{c}_{j}"))), F.col(f"extra_{c}_{j}")).alias(f"b_{c}_{j}") for c, j in names]
    out: list = [None] * len(brackets)
    for r in df.join(F.broadcast(state), list(by)).groupBy(*by).agg(*made).collect():
        for s, i in slots[tuple(r[: len(by)])].items():
            out[i] = r[len(by) + names.index(s)]
    return out


def _pivots(b: _Bracket, sketch: Sequence[float]) -> list[float]:
    """The sketch's values on either side of each rank, with a step to spare."""
    steps = [STEPS * (r - b.before) // max(1, b.size - 1) for r in b.ranks]
    return sorted({sketch[k] for i in steps for k in (max(0, i - 1), min(STEPS, i + 2))})


def _narrowed(b: _Bracket, pivots: list[float], counts: Sequence[int], found: dict[tuple, float]) -> list[_Bracket]:
    """The parts of a bracket between pivots that have ranks; ranks at a pivot are found. Counts: inside the bracket, below and up to each pivot."""
    edges = [(b.lo, 0, 0), *[(p, counts[2 * i], counts[2 * i + 1]) for i, p in enumerate(pivots)], (b.hi, b.size, b.size)]
    parts: dict[int, _Bracket] = {}
    for r in b.ranks:
        k = max(i for i, (_, below, _) in enumerate(edges[:-1]) if below <= r - b.before)
        value, _, upto = edges[k]
        if r - b.before < upto:
            found[b.group, b.column, r] = value
        else:
            parts.setdefault(k, _Bracket(b.group, b.column, value, edges[k + 1][0], b.before + upto, edges[k + 1][1] - upto, [])).ranks.append(r)
    return list(parts.values())


def _at_ranks(df: DataFrame, by: Sequence[str], wanted: dict[tuple[tuple, int], tuple[int, set[int]]]) -> dict[tuple[tuple, int, int], float]:
    """{(group, column, rank): value} for {(group, column): (how many values, ranks)}."""
    found: dict[tuple[tuple, int, int], float] = {}
    left = [_Bracket(g, c, None, None, 0, n, sorted(ranks)) for (g, c), (n, ranks) in wanted.items() if ranks]
    grid = [i / STEPS for i in range(STEPS + 1)]
    limit = GROUP_LIMIT if by else LIMIT
    while wide := [b for b in left if b.size > limit]:
        sketches = _asked(df, by, wide, [[0.0]] * len(wide), T.DoubleType(), lambda x, _: F.percentile_approx(x, grid, 4 * STEPS))
        pivots = [_pivots(b, s) for b, s in zip(wide, sketches, strict=True)]
        most = max(map(len, pivots))
        counts = _asked(df, by, wide, pivots, T.DoubleType(), lambda x, p: F.array(*[F.count_if(c) for i in range(most) for c in (x < F.get(p, F.lit(i)), x <= F.get(p, F.lit(i)))]))  # noqa: B023
        left = [b for b in left if b.size <= limit] + [n for b, p, c in zip(wide, pivots, counts, strict=True) for n in _narrowed(b, p, c, found)]
    if left:
        rests = _asked(df, by, left, [[r - b.before for r in b.ranks] for b in left], T.IntegerType(), lambda x, at: F.transform(F.first(at), lambda i: F.get(F.sort_array(F.collect_list(x)), i)))
        found |= {(b.group, b.column, r): v for b, rest in zip(left, rests, strict=True) for r, v in zip(b.ranks, rest, strict=True)}
    return found


def _between(n: int, share: float, at: Callable[[int], float]) -> float:
    """The percentile of n values by linear interpolation, as Spark's own computes it."""
    place = (n - 1) * share
    low, high = math.floor(place), math.ceil(place)
    a, b = at(low), at(high)
    return a if low == high or a == b else (high - place) * a + (place - low) * b


def _ranks(n: int, shares: Sequence[float]) -> set[int]:
    return {f((n - 1) * s) for s in shares for f in (math.floor, math.ceil)} if n else set()


def percentiles(df: DataFrame, columns: dict[str, Column], shares: Sequence[float], nan_wins: bool = False) -> dict[str, dict[float, float | None]]:
    """The percentiles (by share, 0 to 1) of each column's values that are neither null nor NaN: None without any; nan_wins: NaN where a value is NaN.

    Runs one job to count, and two for each round (two rounds for 10 million to some billion values) and one for the rests.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("percentiles lie between 0 and 100")
    raw = repeatable(df.select(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(columns.values())]))
    cells = raw.select(*[not_nan(F.col(c)).alias(c) for c in raw.columns])
    sizes = raw.agg(*[f for c in raw.columns for f in (F.count(not_nan(F.col(c))), F.count_if(F.isnan(c)))]).first()
    n, nans = sizes[::2], sizes[1::2]
    blank = [bool(nan_wins and k) for k in nans]
    found = _at_ranks(cells, [], {((), i): (k, _ranks(k, shares)) for i, k in enumerate(n) if not blank[i]})
    return {name: {s: NAN if blank[i] else _between(n[i], s, lambda r: found[(), i, r]) if n[i] else None for s in shares} for i, name in enumerate(columns)}  # noqa: B023


def large_groups(df: DataFrame, by: Sequence[str], value: str, share: float) -> DataFrame | None:
    """(by, large): the percentile of the values, neither null nor NaN, of groups with more than GROUP_LIMIT of them; None if there are none. df must be repeatable."""
    cells = df.select(*by, not_nan(F.col(value)).alias("v0"))
    sizes = {tuple(r[:-1]): r[-1] for r in cells.groupBy(*by).agg(F.count("v0").alias("n")).where(F.col("n") > GROUP_LIMIT).collect()}
    if not sizes:
        return None
    found = _at_ranks(cells, by, {(g, 0): (n, _ranks(n, [share])) for g, n in sizes.items()})
    rows = [(*g, _between(n, share, lambda r: found[g, 0, r])) for g, n in sizes.items()]  # noqa: B023
    return df.sparkSession.createDataFrame(rows, T.StructType([*df.select(*by).schema.fields, T.StructField("large", T.DoubleType())]))


def with_large(df: DataFrame, by: Sequence[str], value: str, share: float) -> tuple[DataFrame, Column]:
    """df, and the aggregate by which its groups get the value's percentile: Spark's own for groups up to GROUP_LIMIT, what was found before for larger ones. df must be repeatable."""
    large = large_groups(df, by, value, share)
    x = not_nan(F.col(value))
    if large is None:
        return df, F.percentile(x, F.lit(share))
    return df.join(F.broadcast(large), list(by), "left"), F.coalesce(F.first("large"), F.percentile(F.when(F.col("large").isNull(), x), F.lit(share)))
