"""Resampling by separable weight tables: two equi-joins with (out, in, weight) and two aggregations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacustra.functions.selection import GROUP_LIMIT, with_large
from lacustra.raster import Raster, validate_array
from lacustra.storage import repeatable

#: Weight tables of up to so many rows are broadcast.
BROADCAST_ROWS = 500_000


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, a * (((x - 5) * x + 8) * x - 4), 0.0))


def _spline(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (4 + x * x * (3 * x - 6)) / 6, np.where(x < 2, (2 - x) ** 3 / 6, 0.0))


#: Kernels with the distance, in source cells, at which they end.
KERNELS = {
    "bilinear": (1.0, lambda x: np.maximum(0.0, 1 - np.abs(x))),
    "cubic": (2.0, _cubic),
    "cubic_spline": (2.0, _spline),
    "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)),
    "gauss": (1.5, lambda x: np.exp(-2 * x * x)),
}
#: Aggregates over the source cells whose share of the target cell is their weight.
AREA = {
    "mode": lambda v: F.mode(v, True),  # of equally frequent values the smallest
    "max": F.max,
    "min": F.min,
}
#: Percentiles of the same cells, by their share.
SHARES = {"med": 0.5, "q1": 0.25, "q3": 0.75}


def weights(method: str, n_in: int, n_out: int) -> list[tuple[int, int, float]]:
    """(out, in, weight), the weights of each out adding up to 1; target centres lie at (i + 0.5) n_in / n_out - 0.5.

    Kernels widen by the ratio when shrinking; what falls outside the raster is left out and the rest renormalised.
    """
    out: list[tuple[int, int, float]] = []
    step = n_in / n_out
    for i in range(n_out):
        if method == "nearest":
            out.append((i, min(n_in - 1, int(math.floor((i + 0.5) * step))), 1.0))
            continue
        if method in KERNELS:
            reach, kernel = KERNELS[method]
            wide, centre = max(1.0, step), (i + 0.5) * step - 0.5
            j = np.arange(max(0, math.ceil(centre - reach * wide)), min(n_in - 1, math.floor(centre + reach * wide)) + 1)
            w = kernel((j - centre) / wide)
        else:
            lo, hi = i * step, (i + 1) * step
            j = np.arange(int(math.floor(lo)), min(n_in, math.ceil(hi - 1e-12)))
            w = np.minimum(j + 1, hi) - np.maximum(j, lo)
        keep = np.abs(w) > 1e-12
        j, w = j[keep], w[keep] / w[keep].sum()
        out += list(zip([i] * len(j), j.tolist(), w.tolist(), strict=True))
    return out


def _table(df: DataFrame, rows: list[tuple[int, int, float]], axis: str) -> DataFrame:
    t = df.sparkSession.createDataFrame(rows, f"{axis}_out int, {axis} int, w_{axis} double")
    return F.broadcast(t) if len(rows) <= BROADCAST_ROWS else t


def _checked_shape(shape: object) -> None:
    """ValueError unless shape is a pair (height, width) of positive whole numbers."""
    match shape:
        case (int(h), int(w)) if isinstance(shape, tuple) and h > 0 and w > 0:
            return
    raise ValueError(f"a shape is a tuple (height, width) of positive whole numbers, not {shape!r}")


def resample(array: Raster, target_shape: tuple[int, int], method: str = "bilinear") -> Raster:
    """The raster at another shape. Methods: nearest, bilinear, cubic, cubic_spline, lanczos, gauss, average, sum, rms, mode, max, min, med, q1, q3.

    Results are double; with meta dtype of an integer kind they are rounded. NaN cells take no part.
    """
    validate_array(array, "array")
    _checked_shape(target_shape)
    if method not in {"nearest", "average", "sum", "rms", *KERNELS, *AREA, *SHARES}:
        raise ValueError(f"unknown method: {method}")
    h, w = target_shape
    v = array.value.cast("double")
    cells = array.df.select("row", "col", F.when(F.isnan(v), F.lit(None)).otherwise(v).alias("v"))
    # Only where so many cells meet in a target cell can its percentile take passes of its own.
    large = method in SHARES and math.prod(math.ceil(n_in / n_out) + 1 for n_in, n_out in zip(array.shape, target_shape, strict=True)) > GROUP_LIMIT
    if large:
        cells = repeatable(cells)
    rows, cols = (_table(cells, weights(method, n_in, n_out), axis) for axis, n_in, n_out in (("row", array.height, h), ("col", array.width, w)))
    if method in AREA or method in SHARES:
        met = cells.join(rows, "row").join(cols, "col").select(F.col("row_out").alias("row"), F.col("col_out").alias("col"), "v")
        if large:
            met, at = with_large(met, ["row", "col"], "v", SHARES[method])
        else:
            at = AREA[method](F.col("v")) if method in AREA else F.percentile("v", F.lit(SHARES[method]))
        out = met.groupBy("row", "col").agg(at.alias("value"))
    else:
        x = F.col("v") * F.col("v") if method == "rms" else F.col("v")
        # Sums of weights and of weighted values go through both passes, so that NaN cells are left out exactly.
        first = cells.join(rows, "row").groupBy(F.col("row_out").alias("row"), "col").agg(F.sum(x * F.col("w_row")).alias("s"), F.sum(F.when(F.col("v").isNotNull(), F.col("w_row"))).alias("k"))
        met = first.join(cols, "col").groupBy("row", F.col("col_out").alias("col")).agg(F.sum(F.col("s") * F.col("w_col")).alias("s"), F.sum(F.col("k") * F.col("w_col")).alias("k"))
        mean = F.try_divide(F.col("s"), F.col("k"))
        area = float(array.height * array.width) / (h * w)
        out = met.select("row", "col", {"rms": F.sqrt(mean), "sum": F.col("s") * F.lit(area)}.get(method, mean).alias("value"))
    value = F.coalesce(F.col("value"), F.lit(float("nan")))
    if "int" in str(array.meta.get("dtype", "")):
        value = F.rint(value)
    return Raster(out.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), (value + F.lit(0.0)).alias("value")), h, w, ("value",), array.meta)
