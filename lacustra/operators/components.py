"""Connected components of masks: tiles are labelled alone, their seams are joined as a graph.

One shuffle brings the true cells to tiles of TILE x TILE cells, so a task's memory has a bound. Facing cells of
neighbouring tiles meet by an equi-join; the components of those pairs are found by alternating stars. A body's
id is the rank of its first cell in raster order; ranks are counted in stripes, never in a single task.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacustra.operators.graph import components
from lacustra.raster import Raster
from lacustra.storage import staged

TILE = 256


def tile_labels(row: np.ndarray, col: np.ndarray, width: int) -> np.ndarray:
    """For the true cells of a tile, the smallest row * width + col that each reaches by its four neighbours."""
    r0, c0 = row.min(), col.min()
    here = np.full((row.max() - r0 + 3, col.max() - c0 + 3), -1, np.int64)
    here[row - r0 + 1, col - c0 + 1] = np.arange(len(row))
    order = np.lexsort((col, row))
    rank = np.empty(len(row), np.int64)
    rank[order] = np.arange(len(row))
    around = [here[row - r0 + 1 + a, col - c0 + 1 + b] for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    label = rank.copy()  # by rank in raster order
    while True:
        least = label
        for n in around:
            least = np.where(n >= 0, np.minimum(least, label[np.maximum(n, 0)]), least)
        least = np.minimum(least, least[order[least]])
        if (least == label).all():
            break
        label = least
    first = order[label]
    return row[first].astype(np.int64) * width + col[first]


def label_cells(cells: DataFrame, width: int) -> DataFrame:
    """(row, col, root) for true cells (row, col): root is the component's first row * width + col. Cells must not repeat."""
    schema = "row int, col int, root long"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        return pd.DataFrame({"row": row.astype(np.int32), "col": col.astype(np.int32), "root": tile_labels(row, col, width)})

    tiled = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).withColumns({"tr": F.floor(F.col("row") / TILE), "tc": F.floor(F.col("col") / TILE)})
    local = staged(tiled.groupBy("tr", "tc").applyInPandas(solve, schema))
    down = local.where(F.col("row") % TILE == TILE - 1).select((F.col("row") + 1).alias("row"), "col", F.col("root").alias("a"))
    right = local.where(F.col("col") % TILE == TILE - 1).select("row", (F.col("col") + 1).alias("col"), F.col("root").alias("a"))
    faces = local.select("row", "col", F.col("root").alias("b"))
    seams = down.join(faces.where(F.col("row") % TILE == 0), ["row", "col"]).select("a", "b").union(right.join(faces.where(F.col("col") % TILE == 0), ["row", "col"]).select("a", "b")).distinct()
    root = components(seams)
    merged = local.join(root.select(F.col("node").alias("root"), F.col("root").alias("final")), "root", "left")
    return merged.select("row", "col", F.coalesce("final", "root").alias("root"))


def ranked(keys: DataFrame, key: str, stripe: int = 1 << 20) -> DataFrame:
    """(key, id): dense ranks from 1 of distinct non-negative keys; ranks within stripes of keys, then offsets by stripe."""
    one = keys.select(F.col(key).cast("long").alias(key)).distinct().withColumn("stripe", F.floor(F.col(key) / F.lit(stripe)))
    sizes = one.groupBy("stripe").agg(F.count("*").alias("n"))
    coarse = sizes.withColumn("s2", F.floor(F.col("stripe") / F.lit(4096)))
    upper = coarse.groupBy("s2").agg(F.sum("n").alias("n"))  # a row for every 2**32 cells
    before = upper.select("s2", F.coalesce(F.sum("n").over(Window.orderBy("s2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    offsets = coarse.join(before, "s2").select("stripe", (F.col("base") + F.coalesce(F.sum("n").over(Window.partitionBy("s2").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("stripe").orderBy(key))
    return one.withColumn("at", inside).join(offsets, "stripe").select(key, (F.col("at") + F.col("offset")).cast("int").alias("id"))


def label(mask: Raster) -> DataFrame:
    """(row, col, body_id) of the true cells; ids from 1 in raster order of the bodies' first cells. Any non-zero value, NaN too, is true."""
    cells = mask.df.where(mask.value.cast("boolean")).select("row", "col")
    rooted = label_cells(cells, mask.width)
    return rooted.join(ranked(rooted, "root"), "root").select("row", "col", F.col("id").alias("body_id"))


