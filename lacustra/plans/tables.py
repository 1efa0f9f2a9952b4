"""The driver's tables as rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacustra.raster import Raster
from lacustra.storage import staged

#: Columns of the raster of events, and the day that begins the second date.
HOURS, SECOND = 24, "2024-01-16"
#: Columns of the raster made of orders.
ORDER_WIDTH = 100
#: Which columns of lineitem stand for bands.
LINE_BANDS = {"nir": "l_extendedprice", "red": "l_quantity", "green": "l_discount", "blue": "l_tax", "swir1": "l_quantity", "swir2": "l_tax"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row = vec_id, col = component, value)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v")).select("row", "col", F.col("v").cast("double").alias("value"))


def embedding_raster(spark: SparkSession, sf_dir: str) -> Raster:
    height = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return Raster(embedding_cells(spark, sf_dir), int(height), 64)


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem's keys and the columns that stand for bands."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def event_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Dense cells (row = user_id, col = hour of the day, m1, m2): two events or more before and from SECOND; and the height."""
    e = table(spark, sf_dir, "events")
    height = int(e.agg(F.max("user_id")).first()[0]) + 1
    late = F.to_date("ts") >= F.lit(SECOND).cast("date")
    counts = e.groupBy(F.col("user_id").cast("int").alias("row"), F.hour("ts").alias("col")).agg(F.count_if(~late).alias("n1"), F.count_if(late).alias("n2"))
    frame = spark.range(height).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))).alias("col"))
    dense = frame.join(counts, ["row", "col"], "left")
    return dense.select("row", "col", (F.coalesce("n1", F.lit(0)) >= 2).alias("m1"), (F.coalesce("n2", F.lit(0)) >= 2).alias("m2")), height


def event_masks(spark: SparkSession, sf_dir: str) -> tuple[Raster, Raster]:
    """The masks of the two dates, as views of one staged table."""
    cells, height = event_cells(spark, sf_dir)
    both = Raster(staged(cells), height, HOURS, ("m1", "m2"))
    return both["m1"], both["m2"]
