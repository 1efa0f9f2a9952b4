"""Reading and writing rasters: Parquet pixel tables and GeoTIFF files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacustra.raster import Raster, validate_array
from lacustra.sources import tiff
from lacustra.storage import staged


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, filepath: str) -> tuple[Raster, dict]:
    """(raster, metadata): the first band of a GeoTIFF, or all bands of a pixel table.

    FileNotFoundError if there is nothing, ValueError if it isn't a raster, RuntimeError for what fails otherwise.
    """
    if not exists(spark, filepath):
        raise FileNotFoundError(filepath)
    try:
        if exists(spark, f"{filepath}/metadata"):
            meta = json.loads(spark.read.json(f"{filepath}/metadata").first()["metadata"])
            return Raster(spark.read.parquet(f"{filepath}/pixels"), meta["height"], meta["width"], tuple(meta["bands"]), meta), meta
        files = spark.read.format("binaryFile").load(filepath).select("content")
        meta = json.loads(files.mapInPandas(_header, "meta string").first()["meta"])
        if "error" in meta:
            raise ValueError(meta["error"])
        return Raster(files.mapInPandas(_cells, "row int, col int, value double"), meta["height"], meta["width"], ("value",), meta), meta
    except ValueError:
        raise
    except Exception as e:
        raise RuntimeError(f"can't read {filepath}") from e


def _header(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for content in f["content"]:
            try:
                meta = tiff.metadata(content)
            except (ValueError, KeyError, IndexError) as e:
                meta = {"error": f"not a raster: {e}"}
            yield pd.DataFrame({"meta": [json.dumps(meta)]})


def _cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for content in f["content"]:
            for first, block in tiff.strips(content):
                h, w = block.shape
                yield pd.DataFrame({"row": np.repeat(np.arange(first, first + h, dtype=np.int32), w), "col": np.tile(np.arange(w, dtype=np.int32), h), "value": block.astype(float).ravel()})


def write_table(raster: Raster, filepath: str, metadata: dict | None = None) -> None:
    """A pixel table (Parquet, sorted by row within files) with its metadata beside it; scales with the cluster."""
    meta = {"height": raster.height, "width": raster.width, "bands": list(raster.bands)} | (metadata or raster.meta)
    raster.df.select("row", "col", *raster.bands).repartitionByRange("row").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(f"{filepath}/pixels")
    raster.df.sparkSession.createDataFrame([(json.dumps(meta),)], "metadata string").coalesce(1).write.mode("overwrite").json(f"{filepath}/metadata")


#: Rows of cells in a strip of a GeoTIFF.
STRIP_ROWS = 64


def write(filepath: str, data: Raster, metadata: dict | None = None) -> None:
    """A GeoTIFF of one band; RuntimeError if it fails, after validate_array's errors.

    Strips are encoded on the executors and staged; once their sizes are known the header is written, and the strips follow
    one by one, as one file has one writer. metadata: dtype (uint8, int16, uint16, int32, float32, float64), compress (none
    or deflate), transform (six numbers), crs (EPSG:code) and nodata (cells that are NaN get it); what the raster's own
    metadata say of place, coordinate system and missing values holds where metadata don't.
    """
    validate_array(data, "data")
    meta = {"dtype": "float64", "compress": "deflate"} | {k: v for k, v in data.meta.items() if k in ("transform", "crs", "geo", "nodata")} | (metadata or {})
    if "crs" in (metadata or {}) and "geo" not in metadata:
        meta.pop("geo", None)
    w, h = data.width, data.height
    fill = np.nan if meta.get("nodata") is None else float(meta["nodata"])

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        strip = int(pdf["strip"].iloc[0])
        block = np.full((min(STRIP_ROWS, h - strip * STRIP_ROWS), w), np.nan)
        block[pdf["row"] - strip * STRIP_ROWS, pdf["col"]] = pdf["v"]
        return pd.DataFrame({"strip": [strip], "data": [tiff.encoded(np.where(np.isnan(block), fill, block), meta["dtype"], meta["compress"])]})

    try:
        spark = data.df.sparkSession
        cells: DataFrame = data.df.select(F.floor(F.col("row") / STRIP_ROWS).cast("int").alias("strip"), "row", "col", data.value.cast("double").alias("v"))
        strips = staged(cells.groupBy("strip").applyInPandas(encode, "strip int, data binary"))
        sizes = {r["strip"]: r["n"] for r in strips.select("strip", F.octet_length("data").alias("n")).collect()}  # a number for each STRIP_ROWS rows of cells
        empty = {k: tiff.encoded(np.full((min(STRIP_ROWS, h - k * STRIP_ROWS), w), fill), meta["dtype"], meta["compress"]) for k in range(-(-h // STRIP_ROWS)) if k not in sizes}
        order = [sizes[k] if k in sizes else len(empty[k]) for k in range(-(-h // STRIP_ROWS))]
        path = spark._jvm.org.apache.hadoop.fs.Path(filepath)
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(tiff.head(h, w, STRIP_ROWS, order, meta)))
            at = 0
            for r in strips.repartitionByRange(max(1, len(sizes) // 16), "strip").sortWithinPartitions("strip").toLocalIterator():  # a few strips at a time
                while at < r["strip"]:
                    out.write(bytearray(empty[at]))
                    at += 1
                out.write(bytearray(r["data"]))
                at += 1
            for k in range(at, len(order)):
                out.write(bytearray(empty[k]))
        finally:
            out.close()
    except Exception as e:
        raise RuntimeError(f"can't write {filepath}") from e
