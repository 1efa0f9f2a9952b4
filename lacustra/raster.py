"""Rasters as pixel tables: one row per cell with its row, column and bands."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacustra.functions.expr import not_nan


@dataclass(frozen=True)
class Raster:
    """A dense table (row int, col int, one column per band) with its shape; `bands` are the ones in view."""

    df: DataFrame
    height: int
    width: int
    bands: tuple[str, ...] = ("value",)
    meta: dict = field(default_factory=dict)

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    @property
    def value(self) -> Column:
        """The column of the only band in view."""
        if len(self.bands) != 1:
            raise ValueError(f"one band is needed, there are {len(self.bands)}")
        return F.col(self.bands[0])

    def __getitem__(self, band: str) -> Raster:
        """The same table with one band in view; costs nothing."""
        if band not in self.df.columns:
            raise KeyError(band)
        return Raster(self.df, self.height, self.width, (band,), self.meta)

    def with_value(self, value: Column, name: str = "value", df: DataFrame | None = None) -> Raster:
        """A raster of one new band."""
        return Raster((df if df is not None else self.df).select("row", "col", value.alias(name)), self.height, self.width, (name,), self.meta)

    def to_numpy(self) -> np.ndarray:
        """The cells of the band in view on the driver; for small rasters. Missing cells are NaN."""
        rows = self.df.select("row", "col", self.value.cast("double").alias("v")).toArrow()
        out = np.full(self.shape, np.nan)
        out[rows.column(0).to_numpy(), rows.column(1).to_numpy()] = rows.column(2).to_numpy(zero_copy_only=False)
        return out


def from_numpy(spark: SparkSession, bands: dict[str, np.ndarray] | np.ndarray, meta: dict | None = None) -> Raster:
    """A raster from arrays of equal shape (a single array becomes the band `value`); unsigned and float types become double."""
    bands = bands if isinstance(bands, dict) else {"value": bands}
    arrays = {k: np.atleast_2d(np.asarray(v)) for k, v in bands.items()}
    shapes = {a.shape for a in arrays.values()}
    if len(shapes) != 1:
        raise ValueError("all bands must have the same shape")
    h, w = shapes.pop()
    kinds = {k: "boolean" if a.dtype == bool else "double" for k, a in arrays.items()}
    schema = T.StructType([T.StructField("row", T.IntegerType(), False), T.StructField("col", T.IntegerType(), False)] + [T.StructField(k, T.BooleanType() if t == "boolean" else T.DoubleType()) for k, t in kinds.items()])
    flat = {k: (a if kinds[k] == "boolean" else a.astype(float)).ravel().tolist() for k, a in arrays.items()}
    rows = [(i // w, i % w, *(flat[k][i] for k in arrays)) for i in range(h * w)]
    return Raster(spark.createDataFrame(rows, schema), h, w, tuple(arrays), {"dtype": str(next(iter(arrays.values())).dtype), **(meta or {})})


def aligned(*rasters: Raster) -> tuple[DataFrame, list[str]]:
    """One table with the bands in view of all rasters, as b0, b1, ...: a projection where they share their table, else an equi-join on the cell."""
    first = rasters[0]
    if any(r.shape != first.shape for r in rasters):
        raise ValueError("all rasters must have the same shape")
    names = [f"b{i}" for i in range(len(rasters))]
    groups: list[tuple[DataFrame, list[Column]]] = []
    for name, r in zip(names, rasters, strict=True):
        for df, columns in groups:
            if df is r.df:
                columns.append(r.value.alias(name))
                break
        else:
            groups.append((r.df, [r.value.alias(name)]))
    parts = [df.select("row", "col", *columns) for df, columns in groups]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["row", "col"])
    return out.select("row", "col", *names), names


def validate_array(raster: Raster, name: str = "array") -> None:
    """TypeError unless a raster; ValueError if it has no cells or only NaN (one aggregation job)."""
    if not isinstance(raster, Raster):
        raise TypeError(f"{name} must be a raster")
    if raster.height * raster.width == 0:
        raise ValueError(f"{name} is empty")
    if raster.df.select(F.count(not_nan(raster.value))).first()[0] == 0:
        raise ValueError(f"{name} has only NaN values")


def validate_bands(*bands: Raster) -> None:
    """ValueError without bands, for shapes that differ, and for what validate_array rejects."""
    if not bands:
        raise ValueError("at least one band is needed")
    for i, b in enumerate(bands, 1):
        validate_array(b, f"Band {i}")
    same_shape(*bands)


def same_shape(*bands: Raster) -> None:
    """Shapes are known to the driver: no job."""
    for b in bands:
        if not isinstance(b, Raster):
            raise TypeError("bands must be rasters")
        if b.height * b.width == 0:
            raise ValueError("a band is empty")
    if len({b.shape for b in bands}) > 1:
        raise ValueError("all bands must have the same shape")


def pixel_area_m2(pixel_size: float | tuple[float, float]) -> float:
    """Square metres of a cell from its edge or its (x, y) edges: positive numbers, or ValueError; other types, TypeError."""
    sizes = pixel_size if isinstance(pixel_size, tuple) else (pixel_size, pixel_size)
    if len(sizes) != 2 or not all(isinstance(s, (int, float)) for s in sizes):
        if isinstance(pixel_size, tuple) and len(sizes) != 2:
            raise ValueError("pixel_size must have two edges")
        raise TypeError("pixel_size must be a number or a tuple of two numbers")
    if not all(s > 0 for s in sizes):
        raise ValueError("pixel_size must be positive")
    return float(sizes[0]) * float(sizes[1])
