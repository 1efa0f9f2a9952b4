"""Reductions, descriptive statistics and histograms; NaN is missing.

Everything here is one aggregation: partial sums per task, then a shuffle of one row per task (or per line of
the axis). Exact percentiles are found by narrowing (lacustra.functions.selection), in several passes before;
`accuracy` switches to bounded sketches.
"""

from __future__ import annotations

from builtins import max as most_of
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacustra.functions import selection
from lacustra.functions.expr import INF, NAN, finite, in_parts, not_nan, ratio
from lacustra.raster import Raster, validate_array
from lacustra.storage import repeatable

#: Which column each axis keeps.
AXES = {0: "col", 1: "row"}


def _number(v: Column, df: DataFrame, name: str) -> Column:
    return v.cast("int").cast("double") if dict(df.dtypes)[name] == "boolean" else v.cast("double")


def sum_of(v: Column) -> Column:
    return F.coalesce(F.sum(not_nan(v)), F.lit(0.0))


def _sketched(v: Column, shares: Sequence[float], accuracy: int) -> dict[float, Column]:
    """Percentiles (by share, 0 to 1) of the values that are neither null nor NaN, from one bounded sketch."""
    wanted = sorted(set(shares))
    every = F.percentile_approx(not_nan(v), [float(q) for q in wanted], accuracy)
    return {q: every[i] for i, q in enumerate(wanted)}


def _fixed(value: float | None) -> Column:
    return F.lit(value).cast("double")


def percentiles_of(df: DataFrame, columns: dict[str, Column], shares: Sequence[float], accuracy: int | None = None) -> dict[str, dict[float, float | None]]:
    """Percentiles (by share, 0 to 1) by linear interpolation: NaN if any value is NaN, None without values; with accuracy, of bounded sketches. Runs jobs."""
    if accuracy is None:
        return selection.percentiles(df, columns, shares, nan_wins=True)
    got = df.agg(*[F.when(F.max(F.isnan(v.cast("double"))), F.lit(NAN)).otherwise(at) for v in columns.values() for _, at in sorted(_sketched(v, shares, accuracy).items())]).first() if shares and columns else ()
    wanted = sorted(set(shares))
    return {k: dict(zip(wanted, got[i * len(wanted) :], strict=False)) for i, k in enumerate(columns)}


def percentile_table(df: DataFrame, v: Column, qs: Sequence[float], accuracy: int | None = None) -> DataFrame:
    """One row with the percentiles (0 to 100) as p0, p25, ..."""
    at = percentiles_of(df, {"v": v}, [q / 100.0 for q in qs], accuracy)["v"]
    return df.sparkSession.range(1).select(*[_fixed(at[q / 100.0]).alias(f"p{q}") for q in qs])


REDUCTIONS = {
    "sum": sum_of,
    "mean": lambda v: F.avg(not_nan(v)),
    "std": lambda v: F.stddev_pop(not_nan(v)),
    "min": lambda v: F.min(not_nan(v)),
    "max": lambda v: F.max(not_nan(v)),
    "count_nonzero": lambda v: F.count_if(v != 0),
}


def reduced(df: DataFrame, band: str, kinds: Sequence[str], axis: int | None = None) -> DataFrame:
    """The reductions of a band over all cells, or for each column (axis 0) or row (axis 1), in one pass; medians (NaN if any value is NaN) take some passes before."""
    v = _number(F.col(band), df, band)
    made = {}
    if "median" in kinds and axis is None:
        made["median"] = F.max(_fixed(percentiles_of(df, {"v": v}, [0.5])["v"][0.5]))
    elif "median" in kinds:
        df = repeatable(df.select(AXES[axis], v.alias(band)))
        df, at = selection.with_large(df, [AXES[axis]], band, 0.5)
        v = F.col(band)
        made["median"] = F.when(F.max(F.isnan(v)), F.lit(NAN)).otherwise(at)
    columns = [(made[k] if k in made else REDUCTIONS[k](v)).alias(k) for k in kinds]
    return df.agg(*columns) if axis is None else df.groupBy(AXES[axis]).agg(*columns)


def _reduce(data: Raster, kind: str, axis: int | None, strict: bool):
    if kind != "median" and kind != "count_nonzero":
        validate_array(data, "data")
    out = reduced(data.df, data.bands[0], [kind], axis)
    if axis is None:
        v = out.first()[0]
        if strict and (v is None or v != v):
            raise ValueError("all values are NaN")
        return v
    if strict and out.where(F.col(kind).isNull() | F.isnan(kind)).limit(1).count():
        raise ValueError("a slice has only NaN values")
    return out


def sum(data: Raster, axis: int | None = None):
    """A number, or with an axis a table (col or row, sum). A slice of NaN sums to 0."""
    return _reduce(data, "sum", axis, False)


def mean(data: Raster, axis: int | None = None):
    """A number or a table (col or row, mean); ValueError if a slice has no value."""
    return _reduce(data, "mean", axis, True)


def std(data: Raster, axis: int | None = None):
    """Population standard deviation."""
    return _reduce(data, "std", axis, True)


def min(data: Raster, axis: int | None = None):
    return _reduce(data, "min", axis, True)


def max(data: Raster, axis: int | None = None):
    return _reduce(data, "max", axis, True)


def median(data: Raster, axis: int | None = None, accuracy: int | None = None):
    """NaN if any value is NaN; no validation. accuracy: from a bounded sketch."""
    if accuracy is None:
        return _reduce(data, "median", axis, False)
    v = _number(F.col(data.bands[0]), data.df, data.bands[0])
    near = F.when(F.max(F.isnan(v)), F.lit(NAN)).otherwise(_sketched(v, [0.5], accuracy)[0.5]).alias("median")
    return data.df.agg(near).first()[0] if axis is None else data.df.groupBy(AXES[axis]).agg(near)


def percentile(data: Raster, q, accuracy: int | None = None):
    """The percentile q (0 to 100), or a list for a list."""
    qs = q if isinstance(q, (list, tuple, np.ndarray)) else [q]
    v = _number(F.col(data.bands[0]), data.df, data.bands[0])
    at = percentiles_of(data.df, {"v": v}, [float(p) / 100.0 for p in qs], accuracy)["v"]
    got = [at[float(p) / 100.0] for p in qs]
    return got if qs is q else got[0]


def count_nonzero(data: Raster, axis: int | None = None):
    """NaN counts as not zero."""
    return _reduce(data, "count_nonzero", axis, False)


def unique(data: Raster, return_counts: bool = False) -> DataFrame:
    """Sorted distinct values (value[, count]); NaN comes once, last."""
    out = data.df.groupBy((data.value.cast("double") + F.lit(0.0)).alias("value")).agg(F.count("*").alias("count")).orderBy("value")
    return out if return_counts else out.select("value")


def stats_table(df: DataFrame, v: Column, percentiles: Sequence[float] = (0, 25, 50, 75, 100), scale: float | None = None, compat: bool = False, accuracy: int | None = None) -> DataFrame:
    """The row of `stats`: one pass over the table, after those that find exact percentiles; NaN is left out."""
    x = not_nan(v)
    whole = F.when(finite(v), v)
    n = F.count("*").cast("double")
    shares = [0.5, *(p / 100.0 for p in percentiles)]
    # Division by a positive number keeps the order, so the values' own percentiles are divided.
    values = {"x": x} if scale is None or scale > 0 else {"x": x, "y": ratio(x, F.lit(float(scale)))}
    if accuracy is None:
        by = {k: {q: _fixed(c) for q, c in at.items()} for k, at in selection.percentiles(df, values, shares).items()}
    else:
        by = {k: _sketched(c, shares, accuracy) for k, c in values.items()}
    at = by["x"]
    counts = {"valid": F.count_if(finite(v)), "nan": F.count_if(F.isnan(v)), "zeros": F.count_if(v == 0), "inf": F.count_if(F.abs(v) == F.lit(INF))}
    out = [
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        at[0.5].alias("median"),
        (F.max(x) - F.min(x)).alias("range"),
        F.var_pop(x).alias("variance"),
        in_parts(F.count("*")).alias("size"),
        (F.count(x) if compat else F.count_if((v != 0) & ~F.isnan(v))).alias("non_zero"),
        F.coalesce(F.skewness(whole), F.lit(NAN)).alias("skewness"),
        F.coalesce(F.kurtosis(whole), F.lit(NAN)).alias("kurtosis"),
        *[c.alias(k) for k, c in counts.items()],
        *[(ratio(c, n) * 100).alias(f"{k}_percent") for k, c in counts.items()],
        *[at[p / 100.0].alias(f"p{p}") for p in percentiles],
    ]
    if scale is not None:
        y = ratio(x, F.lit(float(scale)))
        own = by["y"] if "y" in by else {q: ratio(c, F.lit(float(scale))) for q, c in at.items()}
        kinds = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}
        out += [f(y).alias(f"reflectance_{k}") for k, f in kinds.items()] + [own[0.5].alias("reflectance_median")]
        out += [own[p / 100.0].alias(f"reflectance_p{p}") for p in percentiles]
    return df.agg(*out)


def stats(data: Raster, percentiles: Sequence[float] = (0, 25, 50, 75, 100), reflectance_scale: float | None = None, bins: int = 50, compat: bool = False, accuracy: int | None = None) -> dict:
    """Descriptive statistics as a nested dict; compat: `non_zero` counts what isn't NaN, and no histogram comes along; accuracy: percentiles from a bounded sketch."""
    validate_array(data, "data")
    band = data.bands[0]
    row = stats_table(data.df, _number(F.col(band), data.df, band), percentiles, reflectance_scale, compat, accuracy).first().asDict()
    out = {k: v for k, v in row.items() if not k.startswith(("p", "reflectance_")) and not k.endswith("_percent")}
    out |= {"percentiles": {str(p): row[f"p{p}"] for p in percentiles}, "percentages": {k: row[f"{k}_percent"] for k in ("valid", "nan", "zeros", "inf")}, "shape": data.shape, "dtype": data.meta.get("dtype", dict(data.df.dtypes)[band])}
    if reflectance_scale is not None:
        own = {k.removeprefix("reflectance_"): v for k, v in row.items() if k.startswith("reflectance_")}
        out["reflectance_stats"] = {k: v for k, v in own.items() if not k.startswith("p")} | {"percentiles": {str(p): own[f"p{p}"] for p in percentiles}}
    if not compat:
        out["histogram"] = [tuple(r) for r in histogram(data.df, data.value, bins).select("bin_start", "bin_end", "n").orderBy("bin_start").collect()]  # `bins` rows
    return out


def histogram(df: DataFrame, v: Column, bins: int = 50, density: bool = False) -> DataFrame:
    """(bin, bin_start, bin_end, n, height) over the finite values: equal widths, the last bin closed on the right.

    A value's bin is found by division and then put right against the bins' edges. Constant data widen by 0.5
    on both sides. Without finite values the table is empty.
    """
    bins = most_of(1, int(bins))
    values = df.select(v.cast("double").alias("v")).where(finite(F.col("v")))
    lo, hi, total = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not total:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, n long, height double")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.lit(hi)).otherwise(F.lit(lo) + i * F.lit(width))

    g, x = F.col("g"), F.col("v")
    guess = values.select("v", F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int").alias("g"))
    counts = guess.select(F.when(x < edge(g), g - 1).when((x >= edge(g + 1)) & (g < bins - 1), g + 1).otherwise(g).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    n, b = F.coalesce(F.col("n"), F.lit(0)).cast("long"), F.col("bin")
    height = n / F.lit(total * width) if density else n.cast("double")
    return frame.join(counts, "bin", "left").select("bin", edge(b).alias("bin_start"), edge(b + 1).alias("bin_end"), n.alias("n"), height.alias("height"))
