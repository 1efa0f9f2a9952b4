"""Scenes as streams: indices and masks are projections, so they run under readStream unchanged; coverage is kept by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacustra.functions.indices import index_columns


def with_indices(scenes: DataFrame, indices: list[str], bands: dict[str, str] | None = None, reflectance_scale: float | None = None) -> DataFrame:
    """A (streaming) wide pixel table with index columns; bands names the column of each band."""
    columns = {b: F.col(c) for b, c in (bands or {b: b for b in ("blue", "green", "red", "nir", "swir1", "swir2") if b in scenes.columns}).items()}
    return scenes.select("*", *index_columns(columns, indices, reflectance_scale))


def coverage(scenes: DataFrame, mask: Column, time_col: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(start, cells, covered, percent) by time window; rows later than the delay are left out, state is one row for each open window."""
    timed = scenes.select(F.col(time_col).alias("t"), mask.cast("boolean").alias("m")).withWatermark("t", delay)
    sums = timed.groupBy(F.window("t", window)).agg(F.count("*").alias("cells"), F.count_if(F.col("m")).alias("covered"))
    return sums.select(F.col("window.start").alias("start"), "cells", "covered", (F.col("covered") * 100.0 / F.col("cells")).alias("percent"))
