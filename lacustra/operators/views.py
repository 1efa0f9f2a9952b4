"""What figures show: plot-ready tables with their limits; drawing is left to whoever has a plotting library."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacustra.functions.expr import not_nan, ratio, scaled
from lacustra.functions.stats import histogram, percentiles_of
from lacustra.raster import Raster, aligned, from_numpy


@dataclass
class View:
    """Panels are tables (row, col, value), (row, col, red, green, blue) or histograms."""

    panels: list[DataFrame]
    titles: list[str]
    limits: tuple[float, float] | None = None
    labels: dict[str, str] = field(default_factory=dict)

    def render(self, figsize: tuple[float, float] = (10, 8), cmap: str = "viridis"):
        """A matplotlib figure, where that is installed; panels are collected, so `cells` should bound them."""
        try:
            import matplotlib.pyplot as plt
        except ImportError as e:
            raise RuntimeError("matplotlib isn't installed") from e
        fig, axes = plt.subplots(1, len(self.panels), figsize=figsize, squeeze=False)
        for ax, table, title in zip(axes[0], self.panels, self.titles, strict=True):
            data = table.toPandas()
            ax.set_title(title)
            if "bin_start" in data:
                ax.bar(data["bin_start"], data["height"], data["bin_end"] - data["bin_start"], align="edge")
            elif "red" in data:
                ax.scatter(data["col"], -data["row"], c=data[["red", "green", "blue"]].fillna(0).to_numpy(), marker="s")
            else:
                low, high = self.limits or (None, None)
                image = ax.imshow(data.pivot(index="row", columns="col", values="value"), cmap=cmap, vmin=low, vmax=high)
                fig.colorbar(image, ax=ax, label=self.labels.get("colorbar", ""))
        return fig


def _checked(*data: Raster) -> None:
    for d in data:
        if not isinstance(d, Raster):
            raise TypeError("data must be a raster")
        if d.height * d.width == 0:
            raise ValueError("data is empty")


def thinned(data: Raster, cells: int = 512, scale: float | None = None) -> DataFrame:
    """(row, col, value) averaged over square blocks so that neither side is longer than `cells`."""
    k = max(1, -(-max(data.height, data.width) // cells))
    v = not_nan(scaled(data.value, scale))
    if k == 1:
        return data.df.select("row", "col", F.coalesce(v, F.lit(float("nan"))).alias("value"))
    block = [F.floor(F.col(c) / F.lit(k)).cast("int").alias(c) for c in ("row", "col")]
    return data.df.groupBy(*block).agg(F.coalesce(F.avg(v), F.lit(float("nan"))).alias("value"))


def limits(data: Raster, scale: float | None = None, symmetric: bool = False) -> tuple[float, float]:
    v = not_nan(scaled(data.value, scale))
    low, high, far = data.df.agg(F.min(v), F.max(v), F.max(F.abs(v))).first()
    return (-far, far) if symmetric else (low, high)


def plot(data: Raster, title: str = "", colorbar_label: str = "", vmin: float | None = None, vmax: float | None = None, reflectance_scale: float | None = None, cells: int = 512) -> View:
    _checked(data)
    low, high = limits(data, reflectance_scale) if vmin is None or vmax is None else (vmin, vmax)
    return View([thinned(data, cells, reflectance_scale)], [title], (low if vmin is None else vmin, high if vmax is None else vmax), {"colorbar": colorbar_label})


def compare(data1: Raster, data2: Raster, title1: str = "", title2: str = "", vmin: float | None = None, vmax: float | None = None, reflectance_scale: float | None = None, cells: int = 512) -> View:
    """Two panels with shared limits, which come from the first."""
    _checked(data1, data2)
    if data1.shape != data2.shape:
        raise ValueError("data must have the same shape")
    one = plot(data1, title1, "", vmin, vmax, reflectance_scale, cells)
    return View([one.panels[0], thinned(data2, cells, reflectance_scale)], [title1, title2], one.limits)


def changes(data: Raster, title: str = "", symmetric: bool = True, vmin: float | None = None, vmax: float | None = None, colorbar_label: str = "Change", cells: int = 512) -> View:
    _checked(data)
    low, high = limits(data, symmetric=symmetric and vmin is None and vmax is None)
    return View([thinned(data, cells)], [title], (low if vmin is None else vmin, high if vmax is None else vmax), {"colorbar": colorbar_label})


def hist(data: Raster | np.ndarray | list, bins: int = 50, density: bool = True, title: str = "", xlabel: str = "Value", ylabel: str | None = None, reflectance_scale: float | None = None) -> View:
    """A histogram of a raster, or of an array or (nested) list of numbers, which goes to the active session; ValueError if it is empty."""
    if isinstance(data, (list, tuple, np.ndarray)):
        flat = np.asarray(data, np.float64).reshape(1, -1)
        if not flat.size:
            raise ValueError("there is nothing to count")
        data = from_numpy(SparkSession.getActiveSession(), flat)
    _checked(data)
    return View([histogram(data.df, scaled(data.value, reflectance_scale), bins, density)], [title], None, {"x": xlabel, "y": ylabel or ("Density" if density else "Count")})


def distribution_comparison(data1: Raster, data2: Raster, bins: int = 50, density: bool = True, title1: str = "", title2: str = "") -> View:
    """Two histograms, each over its own range; shapes may differ."""
    _checked(data1, data2)
    return View([histogram(d.df, d.value, bins, density) for d in (data1, data2)], [title1, title2], None, {"y": "Density" if density else "Count"})


def rgb_columns(df: DataFrame, names: dict[str, str], scale_factor: float = 1.0, gamma: float = 1.0, percentile: float = 98.0, scale: float | None = None, accuracy: int | None = None) -> list[Column]:
    """Expressions for red, green and blue in 0..1, stretched to a percentile of each band (found here; accuracy: from bounded sketches).

    A band with NaN, or whose percentile is 0, has no finite stretch and comes out as null.
    """
    v = {k: scaled(F.col(n), scale) * F.lit(float(scale_factor)) for k, n in names.items()}
    tops = {k: None if (top := at[percentile / 100.0]) is None or math.isnan(top) else top for k, at in percentiles_of(df, v, [percentile / 100.0], accuracy).items()}
    out = []
    for k, c in v.items():
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(c, F.lit(tops[k]).cast("double"))))
        out.append((F.pow(part, F.lit(1.0 / gamma)) if gamma != 1.0 else part).alias(k))
    return out


def plot_rgb(red: Raster, green: Raster, blue: Raster, title: str = "", scale_factor: float = 1.0, gamma: float = 1.0, percentile: float = 98.0, reflectance_scale: float | None = None, accuracy: int | None = None) -> View:
    _checked(red, green, blue)
    df, names = aligned(red, green, blue)
    return View([df.select("row", "col", *rgb_columns(df, dict(zip(("red", "green", "blue"), names, strict=True)), scale_factor, gamma, percentile, reflectance_scale, accuracy))], [title])


def compare_rgb(rgb1: tuple[Raster, Raster, Raster], rgb2: tuple[Raster, Raster, Raster], title1: str = "", title2: str = "", **options) -> View:
    """Two colour images, each stretched to its own percentiles."""
    if rgb1[0].shape != rgb2[0].shape:
        raise ValueError("images must have the same shape")
    one, two = plot_rgb(*rgb1, title=title1, **options), plot_rgb(*rgb2, title=title2, **options)
    return View([one.panels[0], two.panels[0]], [title1, title2])
