"""Stencils over dense rasters as window functions: gradients, box statistics, morphology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacustra.raster import Raster

_ALONG = {"row": "col", "col": "row"}


def _line(axis: str):
    """The window that runs along an axis: `row` runs over rows within a column."""
    return Window.partitionBy(_ALONG[axis]).orderBy(axis)


def gradient_of(v: Column, axis: str, size: int) -> Column:
    """Central differences, one-sided at the edges."""
    if size < 2:
        raise ValueError("a gradient needs two cells or more along its axis")
    w, at = _line(axis), F.col(axis)
    ahead, behind = F.lead(v).over(w), F.lag(v).over(w)
    return F.when(at == 0, ahead - v).when(at == size - 1, v - behind).otherwise((ahead - behind) / F.lit(2.0))


def gradient(data: Raster, axis: int) -> Raster:
    """The gradient along axis 0 (down the rows) or 1 (along the columns)."""
    v = data.value.cast("double")
    return data.with_value(gradient_of(v, "row", data.height) if axis == 0 else gradient_of(v, "col", data.width))


def _mirrored(df: DataFrame, axis: str, size: int, before: int, after: int) -> DataFrame:
    """df with lines mirrored at both ends of an axis (edge cells doubled), at coordinates outside the raster."""
    at = F.col(axis)
    period = 2 * size
    copies = F.sequence(F.lit(-before), F.lit(size - 1 + after))
    # A coordinate x outside shows cell m or 2n-1-m with m = x mod 2n.
    near = F.filter(copies, lambda x: ((x < 0) | (x >= size)) & (F.least(F.pmod(x, F.lit(period)), F.lit(period - 1) - F.pmod(x, F.lit(period))) == at))
    edge = df.where((at < max(before, after)) | (at >= size - max(before, after))) if max(before, after) < size else df
    moved = edge.withColumn("_at", F.explode(near)).withColumn(axis, F.col("_at").cast("int")).drop("_at")
    return df.unionByName(moved)


def box(df: DataFrame, columns: list[str], height: int, width: int, size: int) -> DataFrame:
    """(row, col, <column>_mean, <column>_variance) over size x size cells around each cell, mirrored at the border.

    Separable: sums along rows, then along columns. Even sizes reach one cell further up and left.
    """
    before, after = size // 2, size - size // 2 - 1
    out = df.select("row", "col", *[F.col(c).cast("double").alias(c) for c in columns], *[(F.col(c).cast("double") * F.col(c).cast("double")).alias(f"{c}_2") for c in columns])
    names = [*columns, *[f"{c}_2" for c in columns]]
    for axis, n in (("col", width), ("row", height)):
        w = _line(axis).rowsBetween(-before, after)
        out = _mirrored(out, axis, n, before, after).select("row", "col", *[F.sum(c).over(w).alias(c) for c in names]).where((F.col(axis) >= 0) & (F.col(axis) < n))
    area = F.lit(float(size * size))
    mean = {c: F.col(c) / area for c in columns}
    return out.select("row", "col", *[x for c in columns for x in (mean[c].alias(f"{c}_mean"), F.greatest(F.lit(0.0), F.col(f"{c}_2") / area - mean[c] * mean[c]).alias(f"{c}_variance"))])


def _boxed(df: DataFrame, name: str, n: int, erode: bool) -> DataFrame:
    """n rounds of 3x3 erosion or dilation at once, as a separable box minimum or maximum; outside is false."""
    out = df
    for axis in ("col", "row"):
        w = _line(axis).rowsBetween(-n, n)
        v = F.col(name).cast("int")
        hit = (F.min(v).over(w) == 1) & (F.count(v).over(w) == 2 * n + 1) if erode else F.max(v).over(w) == 1
        out = out.select("row", "col", hit.alias(name))
    return out


def opening(mask: Raster, iterations: int = 1) -> Raster:
    """Erosion by 3x3 cells, `iterations` times, then as many dilations. Below 1 iteration erosion goes on to the end: nothing is left."""
    name = mask.bands[0]
    dense = mask.df.select("row", "col", F.col(name).cast("boolean").alias(name))
    if iterations < 1:
        return mask.with_value(F.lit(False), name, dense)
    return mask.with_value(F.col(name), name, _boxed(_boxed(dense, name, iterations, True), name, iterations, False))
