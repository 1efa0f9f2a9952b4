"""Water bodies: shapes, statistics, change between two dates, catalogues."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacustra.functions.expr import INF, ratio
from lacustra.operators.components import label, ranked
from lacustra.operators.neighbors import opening
from lacustra.raster import Raster, aligned, pixel_area_m2, same_shape
from lacustra.storage import staged


def _checked(mask: Raster) -> None:
    if not isinstance(mask, Raster):
        raise TypeError("mask must be a raster")
    if mask.height * mask.width == 0:
        raise ValueError("mask is empty")


def gradient_parts(axis: str, size: int) -> Column:
    """What a true cell adds to the gradient along an axis, at itself and at its neighbours: array of (at, weight)."""
    i, end = F.col(axis), size - 1

    def part(at: Column, weight: Column, when: Column) -> Column:
        return F.when(when, F.struct(at.cast("int").alias("at"), weight.cast("double").alias("w")))

    whole, half = F.lit(1.0), F.lit(0.5)
    return F.array_compact(
        F.array(
            part(i - 1, F.when(i - 1 == 0, whole).otherwise(half), i >= 1),
            part(i + 1, -F.when(i + 1 == end, whole).otherwise(half), i <= end - 1),
            part(i, F.lit(-1.0), i == 0),
            part(i, F.lit(1.0), i == end),
        )
    )


def body_shapes(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(body_id, pixels, perimeter, compactness, elongation, orientation) of bodies (row, col, body_id).

    The perimeter sums the length of the 0/1 mask's gradient over the whole raster; only cells at and beside a
    body have any, so no dense mask is built. A raster with fewer than two rows or columns raises ValueError.
    """
    if height < 2 or width < 2:
        raise ValueError("shapes need at least two rows and two columns")
    down = cells.select("body_id", "col", F.explode(gradient_parts("row", height)).alias("p")).select("body_id", F.col("p.at").alias("row"), "col", F.col("p.w").alias("gy"), F.lit(0.0).alias("gx"))
    along = cells.select("body_id", "row", F.explode(gradient_parts("col", width)).alias("p")).select("body_id", "row", F.col("p.at").alias("col"), F.lit(0.0).alias("gy"), F.col("p.w").alias("gx"))
    slope = down.unionByName(along).groupBy("body_id", "row", "col").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))
    edge = slope.groupBy("body_id").agg(F.sum(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("perimeter"))
    col, row = F.col("col").cast("double"), F.col("row").cast("double")
    moments = cells.groupBy("body_id").agg(F.count("*").alias("pixels"), F.var_pop(col).alias("xx"), F.var_pop(row).alias("yy"), F.covar_pop(col, row).alias("xy"))
    # Dust of the streamed moments would turn the axis of a symmetric body.
    moments = moments.withColumns({"xy": F.when(F.abs("xy") < 1e-9, 0.0).otherwise(F.col("xy")), "xx": F.when(F.abs(F.col("xx") - F.col("yy")) < 1e-9, F.col("yy")).otherwise(F.col("xx"))})
    mid, spread = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, F.lit(2)) + F.col("xy") * F.col("xy"))
    small = F.when(F.abs(mid - spread) < 1e-12, 0.0).otherwise(mid - spread)  # dust of the streamed variance
    perimeter = F.coalesce(F.col("perimeter"), F.lit(0.0))
    return moments.join(edge, "body_id", "left").select(
        "body_id",
        "pixels",
        perimeter.alias("perimeter"),
        F.when(perimeter > 0, F.lit(4 * math.pi) * F.col("pixels") / (perimeter * perimeter)).otherwise(F.lit(0.0)).alias("compactness"),
        F.when(small > 0, F.sqrt((mid + spread) / F.when(small > 0, small))).otherwise(F.lit(1.0)).alias("elongation"),
        F.degrees(F.lit(0.5) * F.atan2(F.lit(2.0) * F.col("xy"), F.col("xx") - F.col("yy"))).alias("orientation"),
    )


def calculate_shape_metrics(mask: Raster) -> dict:
    """perimeter, area, compactness, elongation and orientation of all true cells taken as one body, in cells."""
    _checked(mask)
    cells = mask.df.where(mask.value.cast("boolean")).select("row", "col", F.lit(1).alias("body_id"))
    r = body_shapes(cells, mask.height, mask.width).first()
    if r is None:
        return {"perimeter": 0.0, "area": 0, "compactness": 0.0, "elongation": 1.0, "orientation": 0.0}
    return {"perimeter": r["perimeter"], "area": r["pixels"], "compactness": r["compactness"], "elongation": r["elongation"], "orientation": r["orientation"]}


def water_summary(bodies: DataFrame, height: int, width: int, pixel_km2: float, compat: bool = False) -> DataFrame:
    """One row from body sizes (body_id, pixels): total_area, coverage_percent, num_water_bodies, mean_body_size, largest_body."""
    px, n, total = F.lit(pixel_km2), F.count("*"), F.coalesce(F.sum("pixels"), F.lit(0))
    # compat: the mean also counts an empty body 0
    return bodies.agg(
        (total * px).alias("total_area"),
        (total * F.lit(100.0 / (height * width))).alias("coverage_percent"),
        n.alias("num_water_bodies"),
        F.coalesce(ratio(total, n + 1 if compat else n), F.lit(0.0)).cast("double").alias("mean_body_pixels"),
        F.coalesce(F.max("pixels") * px, F.lit(0.0)).alias("largest_body"),
    ).select("total_area", "coverage_percent", "num_water_bodies", (F.col("mean_body_pixels") * px).alias("mean_body_size"), "largest_body")


def water_stats(mask: Raster, pixel_size: float | tuple[float, float] = 30.0, calculate_shapes: bool = False, compat: bool = False) -> dict:
    """Statistics of a mask's bodies in square kilometres; compat: the mean counts one body too many."""
    _checked(mask)
    px = pixel_area_m2(pixel_size) / 1e6
    cells = staged(label(mask))
    out = water_summary(cells.groupBy("body_id").agg(F.count("*").alias("pixels")), mask.height, mask.width, px, compat).first().asDict()
    if calculate_shapes and out["num_water_bodies"]:
        shapes = staged(body_shapes(cells, mask.height, mask.width))
        mean = shapes.agg(F.avg("compactness").alias("mean_compactness"), F.avg("elongation").alias("mean_elongation")).first().asDict()
        out["shape_metrics"] = mean | {"body_metrics": shapes.orderBy("body_id")}  # a table: it grows with the raster
    return out


def change_cells(mask1: Raster, mask2: Raster) -> DataFrame:
    """(row, col, m1, m2) of two masks; true is any value but zero."""
    same_shape(mask1, mask2)
    df, (a, b) = aligned(mask1, mask2)
    return df.select("row", "col", F.col(a).cast("boolean").alias("m1"), F.col(b).cast("boolean").alias("m2"))


def change_summary(cells: DataFrame, pixel_km2: float) -> DataFrame:
    """One row from cells (m1, gained, lost, stable): areas in square kilometres and percent of the original area."""
    px = F.lit(pixel_km2)
    n = {k: F.count_if(F.col(k)) for k in ("m1", "gained", "lost", "stable")}
    net = n["gained"] - n["lost"]
    percent = F.when(n["m1"] > 0, F.try_divide(net * F.lit(100.0), n["m1"])).when(n["gained"] > 0, F.lit(INF)).otherwise(F.lit(0.0))
    return cells.agg(
        (n["gained"] * px).alias("gained_area"), (n["lost"] * px).alias("lost_area"), (net * px).alias("net_change"), (n["stable"] * px).alias("stable_area"), (n["m1"] * px).alias("original_area"), percent.alias("change_percent")
    )


def water_change(mask1: Raster, mask2: Raster, pixel_size: float | tuple[float, float] = 30.0, min_change_area: float | None = None, compat: bool = False) -> dict:
    """Change from mask1 to mask2: areas, change_percent, and the rasters change_mask (-1, 0, 1) and stable_water.

    min_change_area (m2) opens what was gained and lost by as many 3x3 rounds as its square root has cells; below
    one cell nothing is filtered (compat: everything is).
    """
    for m in (mask1, mask2):
        _checked(m)
    area = pixel_area_m2(pixel_size)
    cells = change_cells(mask1, mask2).select("row", "col", "m1", (~F.col("m1") & F.col("m2")).alias("gained"), (F.col("m1") & ~F.col("m2")).alias("lost"), (F.col("m1") & F.col("m2")).alias("stable"))
    if min_change_area is not None:
        rounds = int(math.sqrt(min_change_area / area))
        if rounds >= 1 or compat:
            cells = staged(cells)
            parts = [opening(Raster(cells, mask1.height, mask1.width, (k,)), rounds).df for k in ("gained", "lost")]
            cells = cells.select("row", "col", "m1", "stable").join(parts[0], ["row", "col"]).join(parts[1], ["row", "col"])
    cells = staged(cells)
    change = cells.select("row", "col", (F.col("gained").cast("int") - F.col("lost").cast("int")).alias("change"), "stable")
    out = change_summary(cells, area / 1e6).first().asDict()
    view = Raster(change, mask1.height, mask1.width, ("change",), mask1.meta)
    return {k: out[k] for k in ("gained_area", "lost_area", "net_change", "change_percent")} | {"change_mask": view, "stable_water": view["stable"]}


def body_catalogue(cells: DataFrame, height: int, width: int, pixel_m2: float, min_area: float | None = None, shapes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cells (row, col, body_id) and bodies (body_id, area[, shape metrics]) of at least min_area m2, numbered densely in order."""
    sizes = cells.groupBy("body_id").agg(F.count("*").alias("pixels"))
    if min_area is not None:
        sizes = sizes.where(F.col("pixels") >= F.lit(min_area / pixel_m2))
    kept = staged(ranked(sizes, "body_id").join(sizes, "body_id"))
    left = cells.join(kept.select("body_id", "id"), "body_id").select("row", "col", F.col("id").alias("body_id"))
    bodies = kept.select(F.col("id").alias("body_id"), (F.col("pixels") * F.lit(pixel_m2 / 1e6)).alias("area"))
    if shapes:
        bodies = bodies.join(body_shapes(left, height, width).drop("pixels"), "body_id")
    return left, bodies


def get_water_bodies(mask: Raster, pixel_size: float | tuple[float, float] = 30.0, min_area: float | None = None, calculate_shapes: bool = False) -> tuple[DataFrame, DataFrame]:
    """The label image as its true cells (row, col, body_id), and the catalogue (body_id, area in km2[, shapes])."""
    _checked(mask)
    return body_catalogue(staged(label(mask)), mask.height, mask.width, pixel_area_m2(pixel_size), min_area, calculate_shapes)
