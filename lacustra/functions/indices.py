"""Spectral indices: as column expressions, and over rasters (a projection, no shuffle where bands share a table)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacustra.functions.expr import cleaned, ratio, scaled
from lacustra.raster import Raster, aligned, same_shape


def normalized_difference(a: Column, b: Column, clip: bool = True) -> Column:
    """(a - b) / (a + b); 0 where that has no finite value."""
    a, b = a.cast("double"), b.cast("double")
    return cleaned(ratio(a - b, a + b), clip)


def evi_of(red: Column, nir: Column, blue: Column, G: float = 2.5, C1: float = 6.0, C2: float = 7.5, L: float = 1.0) -> Column:
    _numbers(G=G, C1=C1, C2=C2, L=L)
    if L < 0 or G <= 0:
        raise ValueError("L must not be negative and G must be positive")
    red, nir, blue = (x.cast("double") for x in (red, nir, blue))
    return cleaned(ratio(F.lit(float(G)) * (nir - red), nir + F.lit(float(C1)) * red - F.lit(float(C2)) * blue + F.lit(float(L))))


def savi_of(nir: Column, red: Column, L: float = 0.5) -> Column:
    _numbers(L=L)
    if L < 0 or L > 1:
        raise ValueError(f"the soil factor L is a share from 0 to 1, not {L}")
    nir, red = nir.cast("double"), red.cast("double")
    return cleaned(ratio(nir - red, nir + red + F.lit(float(L))) * F.lit(1.0 + L))


def _numbers(**values: float) -> None:
    for name, v in values.items():
        if not isinstance(v, (int, float)):
            raise TypeError(f"{name} must be a number")


#: For each index the bands it takes, in the order of its expression.
REGISTRY: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "ndvi": (("nir", "red"), normalized_difference),
    "evi": (("red", "nir", "blue"), evi_of),
    "savi": (("nir", "red"), savi_of),
    "ndwi": (("nir", "green"), normalized_difference),  # near infrared first: water is negative
    "ndbi": (("swir1", "nir"), normalized_difference),
    "nbr": (("nir", "swir2"), normalized_difference),
    "ndmi": (("nir", "swir1"), normalized_difference),
}


def _over(name: str, bands: list[Raster], scale: float | None, **options) -> Raster:
    same_shape(*bands)
    df, names = aligned(*bands)
    return bands[0].with_value(REGISTRY[name][1](*(scaled(F.col(n), scale) for n in names), **options), name, df)


def calculate_normalized_difference(band1: Raster, band2: Raster, clip: bool = True) -> Raster:
    df, (a, b) = aligned(band1, band2)
    return band1.with_value(normalized_difference(F.col(a), F.col(b), clip), "value", df)


def ndvi(nir: Raster, red: Raster, reflectance_scale: float | None = None) -> Raster:
    return _over("ndvi", [nir, red], reflectance_scale)


def evi(red: Raster, nir: Raster, blue: Raster, reflectance_scale: float | None = None, G: float = 2.5, C1: float = 6.0, C2: float = 7.5, L: float = 1.0) -> Raster:
    return _over("evi", [red, nir, blue], reflectance_scale, G=G, C1=C1, C2=C2, L=L)


def savi(nir: Raster, red: Raster, reflectance_scale: float | None = None, L: float = 0.5) -> Raster:
    return _over("savi", [nir, red], reflectance_scale, L=L)


def ndwi(green: Raster, nir: Raster, reflectance_scale: float | None = None, convention: str = "nir_first") -> Raster:
    """Water index; `nir_first`: water is negative (the default), `green_first`: positive."""
    if convention not in ("nir_first", "green_first"):
        raise ValueError("convention must be nir_first or green_first")
    return _over("ndwi", [nir, green] if convention == "nir_first" else [green, nir], reflectance_scale)


def ndbi(swir1: Raster, nir: Raster, reflectance_scale: float | None = None) -> Raster:
    return _over("ndbi", [swir1, nir], reflectance_scale)


def nbr(nir: Raster, swir2: Raster, reflectance_scale: float | None = None) -> Raster:
    return _over("nbr", [nir, swir2], reflectance_scale)


def ndmi(nir: Raster, swir1: Raster, reflectance_scale: float | None = None) -> Raster:
    return _over("ndmi", [nir, swir1], reflectance_scale)


def index_columns(columns: dict[str, Column], indices: list[str], reflectance_scale: float | None = None) -> list[Column]:
    """One expression for each index, for a single select over a wide table."""
    out = []
    for name in indices:
        if name not in REGISTRY:
            raise ValueError(f"unknown index: {name}")
        needed, of = REGISTRY[name]
        if missing := [b for b in needed if b not in columns]:
            raise ValueError(f"{name} lacks the bands {', '.join(missing)}")
        out.append(of(*(scaled(columns[b], reflectance_scale) for b in needed)).alias(name))
    return out


def calculate_indices(bands: dict[str, Raster], indices: list[str], reflectance_scale: float | None = None) -> dict[str, Raster]:
    """Several indices at once; all views are of one table, so that one scan serves them."""
    if not bands:
        raise ValueError("at least one band is needed")
    same_shape(*bands.values())
    df, names = aligned(*bands.values())
    columns = dict(zip(bands, map(F.col, names), strict=True))
    table = df.select("row", "col", *index_columns(columns, indices, reflectance_scale))
    first = next(iter(bands.values()))
    return {i: Raster(table, first.height, first.width, (i,), first.meta) for i in indices}
