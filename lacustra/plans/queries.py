"""One query for each operator, over the driver's tables; the SQL is in lacustra.plans.oracle under the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacustra.functions import indices, stats
from lacustra.functions.expr import rounded, scaled
from lacustra.operators import clustering, features, neighbors, resample, views, water
from lacustra.operators.components import label
from lacustra.plans.tables import LINE_BANDS, ORDER_WIDTH, embedding_cells, embedding_raster, event_cells, event_masks, line_cells, table
from lacustra.raster import Raster, pixel_area_m2, validate_array, validate_bands
from lacustra.sources import pixels
from lacustra.storage import new_path, staged
from lacustra.streaming import scenes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Square kilometres of a cell of 30 m.
PX = 900.0 / 1e6
KEY = ["l_orderkey", "l_linenumber"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounds(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its double columns rounded, without negative zeros."""
    return df.select(*[rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Sources and sinks


@query
def s1_read_geotiff(spark, sf_dir):
    """The embeddings written as a GeoTIFF of float64 and read again."""
    path = new_path(spark, "raster") + ".tif"
    pixels.write(path, embedding_raster(spark, sf_dir))
    return rounds(pixels.read(spark, path)[0].df)


@query
def s2_write_pixels(spark, sf_dir):
    """The embeddings written as a pixel table and read again."""
    path = new_path(spark, "raster")
    pixels.write_table(embedding_raster(spark, sf_dir), path)
    return rounds(pixels.read(spark, path)[0].df)


@query
def s3_s4_model_round_trip(spark, sf_dir):
    """A forest saved and loaded: how many vectors both give the same class."""
    model = _forest(spark, sf_dir).model
    path = new_path(spark, "model")
    features.save_model(model, path, {"kind": "rf"})
    again, meta = features.load_model(spark, path)
    cells = _vectors(spark, sf_dir)
    one = features.predict_raster(model, cells).withColumnRenamed("prediction", "p1")
    two = features.predict_raster(again, cells).withColumnRenamed("prediction", "p2")
    return one.join(two, ["row", "col"]).agg(F.count("*").alias("n"), F.count_if(F.col("p1") == F.col("p2")).alias("same")).withColumn("kind", F.lit(meta["kind"]))


# Validation


def _outcome(check: Callable[[], object]) -> str:
    """What a validator gives or raises."""
    try:
        return str(check())
    except (TypeError, ValueError) as e:
        return type(e).__name__


@query
def v1_v2_v3_validation(spark, sf_dir):
    """What the validators say of bands of lineitem: whole ones, one of NaN only, one without cells, one of another shape, and no raster at all."""
    cells = line_cells(spark, sf_dir).withColumns({"row": F.col("l_orderkey").cast("int"), "col": F.col("l_linenumber"), "missing": F.lit(float("nan"))})
    whole = Raster(cells, 1000, 8, ("l_quantity", "l_tax", "missing"))
    good, other, missing = whole["l_quantity"], whole["l_tax"], whole["missing"]
    empty, wide = Raster(cells, 0, 8, ("l_quantity",)), Raster(cells, 1000, 9, ("l_quantity",))
    checks: dict[str, Callable[[], object]] = {
        "array": lambda: validate_array(good),
        "array of NaN": lambda: validate_array(missing),
        "array without cells": lambda: validate_array(empty),
        "no array": lambda: validate_array(1.5),
        "bands": lambda: validate_bands(good, other),
        "no bands": lambda: validate_bands(),
        "bands of two shapes": lambda: validate_bands(good, wide),
        "a band of NaN": lambda: validate_bands(good, missing),
        "index of two shapes": lambda: indices.ndvi(good, wide),
        "index of a number": lambda: indices.ndvi(good, 3),
        "index with a bad factor": lambda: indices.savi(good, other, L=2),
        "index": lambda: indices.ndvi(good, other).shape,
    }
    return spark.createDataFrame([(k, _outcome(f)) for k, f in checks.items()], "checked string, outcome string")


@query
def v4_pixel_size(spark, sf_dir):
    """Areas of cells by edges, and what is no edge."""
    sizes = {"30": 30.0, "10 x 20": (10.0, 20.0), "0": 0, "-1": (30.0, -1.0), "three": (1.0, 2.0, 3.0), "text": "30"}
    return spark.createDataFrame([(k, _outcome(lambda v=v: pixel_area_m2(v))) for k, v in sizes.items()], "size string, outcome string")


# Reductions


@query
def a1_a5_reductions(spark, sf_dir):
    return rounds(stats.reduced(embedding_cells(spark, sf_dir), "value", ["sum", "mean", "std", "min", "max"]))


@query
def a1_a5_reductions_axis0(spark, sf_dir):
    return rounds(stats.reduced(embedding_cells(spark, sf_dir), "value", ["sum", "mean", "std", "min", "max"], 0))


@query
def a1_a5_reductions_axis1(spark, sf_dir):
    return rounds(stats.reduced(embedding_cells(spark, sf_dir), "value", ["sum", "mean", "std", "min", "max"], 1))


@query
def a6_median(spark, sf_dir):
    return rounds(stats.reduced(embedding_cells(spark, sf_dir), "value", ["median"], 0))


@query
def a7_percentile(spark, sf_dir):
    return rounds(stats.percentile_table(line_cells(spark, sf_dir), F.col("l_extendedprice"), (0, 2, 25, 50, 75, 98, 100)))


@query
def a8_count_nonzero(spark, sf_dir):
    return stats.reduced(line_cells(spark, sf_dir), "l_discount", ["count_nonzero"])


@query
def a9_unique(spark, sf_dir):
    cells = line_cells(spark, sf_dir).withColumns({"row": F.lit(0), "col": F.lit(0)})
    return stats.unique(Raster(cells, 1, 1, ("l_quantity",)), return_counts=True)


@query
def a10_stats(spark, sf_dir):
    return rounds(stats.stats_table(line_cells(spark, sf_dir), F.col("l_extendedprice"), (0, 25, 50, 75, 100), 1000.0), 4)


# Spectral indices


def _index(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = {b: F.col(c) for b, c in LINE_BANDS.items()}
        return rounds(line_cells(spark, sf_dir).select(*KEY, *indices.index_columns(columns, [name], 100.0)))

    return run


for _i, _name in enumerate(("ndvi", "evi", "savi", "ndwi", "ndbi", "nbr", "ndmi"), 1):
    QUERIES[f"i{_i}_{_name}"] = _index(_name)


@query
def i0_normalized_difference(spark, sf_dir):
    """Discount and tax are both 0 in some rows: 0/0 comes out as 0."""
    return rounds(line_cells(spark, sf_dir).select(*KEY, indices.normalized_difference(F.col("l_discount"), F.col("l_tax")).alias("nd")))


@query
def i8_calculate_indices(spark, sf_dir):
    columns = {b: F.col(c) for b, c in LINE_BANDS.items()}
    return rounds(line_cells(spark, sf_dir).select(*KEY, *indices.index_columns(columns, list(indices.REGISTRY))))


@query
def i9_reflectance_scale(spark, sf_dir):
    return rounds(line_cells(spark, sf_dir).select(*KEY, scaled(F.col("l_extendedprice"), 10000.0).alias("reflectance")))


# Masks


@query
def p1_p6_masks(spark, sf_dir):
    """Coverage by threshold, boolean algebra, finite filter and strict difference, in one pass."""
    price, q = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    n = F.count("*")
    return rounds(
        line_cells(spark, sf_dir).agg(
            (F.count_if(price) * 100.0 / n).alias("coverage"),
            F.count_if(~price & q).alias("only_b"),
            F.count_if(price & ~q).alias("only_a"),
            F.count_if(price & q).alias("in_both"),
            F.count_if(stats.finite(F.col("l_extendedprice"))).alias("finite"),
            F.count_if(F.abs(F.col("l_discount") - F.col("l_tax")) > 0.02).alias("apart"),
        )
    )


# Raster algebra


def _orders(spark: SparkSession, sf_dir: str) -> Raster:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value"))
    n = int(o.agg(F.count("*")).first()[0])
    cells = o.select((F.col("k") / ORDER_WIDTH).cast("int").alias("row"), (F.col("k") % ORDER_WIDTH).cast("int").alias("col"), "value")
    return Raster(cells, n // ORDER_WIDTH, ORDER_WIDTH)


@query
def r1_resample_nearest(spark, sf_dir):
    return rounds(resample.resample(_orders(spark, sf_dir), (60, 70), "nearest").df)


@query
def r1_resample_bilinear(spark, sf_dir):
    return rounds(resample.resample(_orders(spark, sf_dir), (60, 150), "bilinear").df, 8)


@query
def r1_resample_average(spark, sf_dir):
    return rounds(resample.resample(_orders(spark, sf_dir), (30, 40), "average").df, 8)


def _several(r: Raster, methods: dict[str, tuple[int, int]], digits: int = 6) -> DataFrame:
    """(method, row, col, value) of a raster resampled in several ways."""
    parts = [resample.resample(r, shape, m).df.withColumn("method", F.lit(m)) for m, shape in methods.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return rounds(whole, digits)


@query
def r1_resample_kernels(spark, sf_dir):
    """Orders through the kernels, to fewer rows and more columns."""
    return _several(_orders(spark, sf_dir), dict.fromkeys(("cubic", "cubic_spline", "lanczos", "gauss"), (40, 130)), 3)


@query
def r1_resample_areas(spark, sf_dir):
    """Thousands of orders' prices by the aggregates over cells that a target cell covers."""
    r = _orders(spark, sf_dir)
    thousands = r.with_value(F.floor(F.col("value") / 10000).cast("double"))
    return _several(thousands, dict.fromkeys(("sum", "rms", "mode", "max", "min", "med", "q1", "q3"), (30, 40)))


@query
def r1_resample_whole_numbers(spark, sf_dir):
    """A raster of an integer type, halved both ways: means are rounded, halves to even. An odd last row is left out."""
    r = _orders(spark, sf_dir)
    half = r.height // 2
    tens = r.df.where(F.col("row") < 2 * half).select("row", "col", F.floor(F.col("value") / 10000).cast("double").alias("value"))
    return rounds(resample.resample(Raster(tens, 2 * half, r.width, ("value",), {"dtype": "uint8"}), (half, r.width // 2), "average").df)


@query
def r2_components(spark, sf_dir):
    return label(event_masks(spark, sf_dir)[0])


@query
def r3_shape_metrics(spark, sf_dir):
    mask = event_masks(spark, sf_dir)[0]
    return rounds(water.body_shapes(staged(label(mask)), mask.height, mask.width))


@query
def r4_water_stats(spark, sf_dir):
    mask = event_masks(spark, sf_dir)[0]
    return rounds(water.water_summary(label(mask).groupBy("body_id").agg(F.count("*").alias("pixels")), mask.height, mask.width, PX))


@query
def r5_water_change(spark, sf_dir):
    cells, _ = event_cells(spark, sf_dir)
    m1, m2 = F.col("m1"), F.col("m2")
    return rounds(water.change_summary(cells.select("m1", (~m1 & m2).alias("gained"), (m1 & ~m2).alias("lost"), (m1 & m2).alias("stable")), PX))


@query
def r5_change_mask(spark, sf_dir):
    out = water.water_change(*event_masks(spark, sf_dir))
    return out["change_mask"].df.select("row", "col", "change", "stable")


@query
def r6_opening(spark, sf_dir):
    return neighbors.opening(event_masks(spark, sf_dir)[0], 1).df.where("m1").select("row", "col")


@query
def r7_water_bodies(spark, sf_dir):
    """Bodies of at least three cells, numbered anew."""
    _, bodies = water.get_water_bodies(event_masks(spark, sf_dir)[0], min_area=2700.0)
    return rounds(bodies)


@query
def r8_gradient(spark, sf_dir):
    e = embedding_raster(spark, sf_dir)
    v = F.col("value")
    return rounds(e.df.select("row", "col", neighbors.gradient_of(v, "row", e.height).alias("gy"), neighbors.gradient_of(v, "col", e.width).alias("gx")))


# Machine learning


@query
def m1_extract_features(spark, sf_dir):
    e = embedding_raster(spark, sf_dir)
    f = features.extract_features(e, 3)
    return rounds(f.select("row", "col", *[F.col("features")[i].alias(n) for i, n in enumerate(("value", "mean", "variance"))]))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row"), F.lit(0).alias("col"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.col("label").cast("double").alias("label"))


def _forest(spark: SparkSession, sf_dir: str) -> features.Classified:
    return features.train_classifier(_vectors(spark, sf_dir), n_estimators=20, max_depth=8)


@query
def m2_train_classifier(spark, sf_dir):
    """Metrics of a forest on the held-out fifth."""
    c = _forest(spark, sf_dir)
    return spark.createDataFrame([(float(c.accuracy), len(c.labels), sum(map(sum, c.confusion_matrix)))], "accuracy double, classes int, held_out int")


@query
def m3_predict_raster(spark, sf_dir):
    return features.predict_raster(_forest(spark, sf_dir).model, _vectors(spark, sf_dir))


@query
def m4_detect_changes(spark, sf_dir):
    """Where the first and the second half of each vector differ by more than 0.2."""
    cells = embedding_cells(spark, sf_dir)
    e = embedding_raster(spark, sf_dir)
    one = Raster(cells.where("col < 32"), e.height, 32)
    two = Raster(cells.where("col >= 32").select("row", (F.col("col") - 32).alias("col"), "value"), e.height, 32)
    return features.detect_changes_ml(one, two, threshold=0.2).df.select("row", "col", "changed")


@query
def m5_augment(spark, sf_dir):
    """Rows by copy and label; noise has no influence on these."""
    out = features.augment_training_data(_vectors(spark, sf_dir).select("features", "label"), augmentation_factor=3)
    return out.groupBy("copy", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))


def _scene(spark: SparkSession, sf_dir: str) -> Raster:
    """Two bands of orders: the price and the price of the cell's mirror image in its block of ten."""
    r = _orders(spark, sf_dir)
    return Raster(r.df.select("row", "col", (F.col("value") / 1000).alias("a"), ((F.col("row") * 7 + F.col("col") * 3) % 50).cast("double").alias("b")), r.height, r.width, ("a", "b"))


@query
def m6a_kmeans(spark, sf_dir):
    """Sizes of three clusters that lie apart: prices, moved by the order's key modulo 3."""
    r = _orders(spark, sf_dir)
    third, price = (F.col("row") * ORDER_WIDTH + F.col("col")) % 3, F.col("value") / 1e6
    apart = Raster(r.df.select("row", "col", (price + 10 * third).alias("a"), (price - 5 * third).alias("b")), r.height, r.width, ("a", "b"))
    clusters, _ = clustering.cluster_water_bodies(apart, n_clusters=3)
    return clusters.df.groupBy("cluster").agg(F.count("*").alias("n"))


@query
def m6b_dbscan(spark, sf_dir):
    """Sizes of the clusters of events by day (days are far apart) and whole value; -1 is noise."""
    points = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.dayofmonth("ts") * 10.0).alias("day"), F.floor("value").cast("double").alias("v"))
    found = clustering.dbscan(points, ["day", "v"], eps=1.0, min_samples=8)
    return found.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"))


@query
def m6c_standard_scaler(spark, sf_dir):
    return rounds(clustering.standardized(line_cells(spark, sf_dir).select(*KEY, "l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"]))


@query
def m7_analyze_clusters(spark, sf_dir):
    """Bodies of the cells that are water at the first date."""
    m1, _ = event_masks(spark, sf_dir)
    return rounds(clustering.cluster_bodies(m1.with_value(F.col("m1").cast("int"), "cluster"), 1))


@query
def m8_optimize_clustering(spark, sf_dir):
    """The default grid: inertia falls with every further cluster, so the largest number is the best."""
    best, results = clustering.optimize_clustering(_scene(spark, sf_dir))
    return spark.createDataFrame([(best["n_clusters"], len(results))], "n_clusters int, tried int")


# Views


@query
def g1_plot(spark, sf_dir):
    """The thinned grid of orders."""
    return rounds(views.thinned(_orders(spark, sf_dir), cells=50), 4)


@query
def g2_g3_limits(spark, sf_dir):
    e = embedding_raster(spark, sf_dir)
    low, high = views.limits(e)
    _, far = views.limits(e, symmetric=True)
    return rounds(spark.createDataFrame([(low, high, -far, far)], "vmin double, vmax double, change_min double, change_max double"))


@query
def g4_histogram(spark, sf_dir):
    return rounds(stats.histogram(line_cells(spark, sf_dir), F.col("l_extendedprice"), 50, True))


@query
def g5_distribution_comparison(spark, sf_dir):
    e = embedding_raster(spark, sf_dir)
    halves = [Raster(e.df.where(c), e.height, 32) for c in ("col < 32", "col >= 32")]
    one, two = views.distribution_comparison(*halves, bins=20).panels
    return rounds(one.withColumn("part", F.lit(1)).unionByName(two.withColumn("part", F.lit(2))))


@query
def g6_plot_rgb(spark, sf_dir):
    df = line_cells(spark, sf_dir)
    names = {"red": "l_quantity", "green": "l_extendedprice", "blue": "l_discount"}
    return rounds(df.select(*KEY, *views.rgb_columns(df, names, 1.0, 2.0, 98.0, 100.0)))


@query
def g7_compare_rgb(spark, sf_dir):
    """Two images, stretched each to its own percentiles: their mean colours."""
    df = line_cells(spark, sf_dir)
    images = [{"red": "l_quantity", "green": "l_extendedprice", "blue": "l_discount"}, {"red": "l_tax", "green": "l_discount", "blue": "l_quantity"}]
    parts = [df.select(*views.rgb_columns(df, n)).agg(*[F.avg(c).alias(c) for c in ("red", "green", "blue")]).withColumn("image", F.lit(i)) for i, n in enumerate(images, 1)]
    return rounds(parts[0].unionByName(parts[1]))


# Streams


@query
def t1_stream_coverage(spark, sf_dir):
    """Daily share of events with a value over 50, by a stream that ends with its input."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    out = new_path(spark, "stream")
    days = scenes.coverage(source.withColumn("t", F.col("ts").cast("timestamp")), F.col("value") > 50, "t")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writing = days.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(keep).start()
    writing.awaitTermination()
    done = spark.read.parquet(out)
    last = done.agg(F.max("batch")).first()[0]
    return rounds(done.where(F.col("batch") == last).select(F.dayofmonth("start").alias("day"), "cells", "covered", "percent"))


