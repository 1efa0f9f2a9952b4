"""Unsupervised water bodies: KMeans, DBSCAN, analysis of the clusters, search over parameters."""

from __future__ import annotations

import itertools
import math

from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacustra.operators.components import label, ranked
from lacustra.operators.features import vectors
from lacustra.operators.graph import components
from lacustra.operators.water import body_shapes
from lacustra.raster import Raster, aligned, pixel_area_m2
from lacustra.storage import staged


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with mean 0 and population deviation 1 (constant ones only centred); one aggregation first."""
    row = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[f"mean_{c}"])) / F.lit(row[f"std_{c}"] or 1.0) for c in columns})


def kmeans_cells(df: DataFrame, columns: list[str], k: int, seed: int = 42, **options) -> tuple[DataFrame, object]:
    """df with `cluster`, numbered by cluster centre so that numbers are stable, and the model."""
    table = df.withColumn("features", F.array(*columns))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="raw", **options).fit(vectors(table))
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))
    place = F.element_at(F.create_map(*[F.lit(x) for i, o in enumerate(order) for x in (o, i)]), F.col("raw"))
    return model.transform(vectors(table)).withColumn("cluster", place).drop("raw", "features"), model


def dbscan(points: DataFrame, columns: list[str], eps: float = 0.5, min_samples: int = 5, id_col: str = "id") -> DataFrame:
    """(id, cluster) of points (id long, columns): -1 for noise; clusters from 0 in the order of their smallest core id.

    Equal points are joined to one with a weight first. Points meet those of the neighbouring cells of a grid
    with edge eps, by an equi-join on the cell. Points of a finer cell whose diagonal is eps are within eps of
    each other, so core points of such a cell are one node of the graph, and dense cells add no edges inside.
    Practical for few dimensions, as each point looks at 3**d cells. A point within eps of several clusters'
    core points goes to the first.
    """
    d = len(columns)
    if not 1 <= d <= 6:
        raise ValueError("one to six columns are supported")
    same = points.groupBy(*columns).agg(F.count("*").alias("weight"), F.min(id_col).alias("p"))
    cell = [F.floor(F.col(c) / F.lit(eps)).cast("long") for c in columns]
    fine = [F.floor(F.col(c) / F.lit(eps / math.sqrt(d) * (1 - 1e-9))).cast("long") for c in columns]
    spots = staged(same.select("p", "weight", F.array(*columns).alias("x"), F.array(*cell).alias("cell"), F.array(*fine).alias("fine")))
    steps = F.array(*[F.array(*[F.lit(s) for s in step]) for step in itertools.product((-1, 0, 1), repeat=d)])
    near = spots.select(F.col("p").alias("q"), F.col("x").alias("y"), F.col("weight").alias("w"), F.col("fine").alias("g"), F.explode(F.transform(steps, lambda s: F.zip_with("cell", s, lambda a, b: a + b))).alias("cell"))
    far = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    close = spots.join(near, "cell").where(far <= F.lit(eps * eps))
    core = staged(close.groupBy("p").agg(F.sum("w").alias("n")).where(F.col("n") >= min_samples).select("p"))
    nodes = staged(spots.join(core, "p").groupBy("fine").agg(F.min("p").alias("node")))
    core_spots = spots.join(core, "p").join(nodes, "fine").select("p", "node")
    pairs = close.where("fine <> g").select("p", "q").join(core_spots, "p").withColumnRenamed("node", "a").join(core_spots.select(F.col("p").alias("q"), F.col("node").alias("b")), "q")
    root = components(pairs.select("a", "b").distinct())
    member = core_spots.join(root.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("p", F.coalesce("root", "node").alias("root"))
    first = member.groupBy("root").agg(F.min("p").alias("first"))
    numbered = member.join(first, "root").select("p", "first")
    border = close.select("p", "q").join(numbered.select(F.col("p").alias("q"), "first"), "q").join(core, "p", "left_anti").groupBy("p").agg(F.min("first").alias("first"))
    settled = staged(numbered.union(border))
    number = ranked(settled, "first").select("first", (F.col("id") - 1).alias("cluster"))
    named = spots.select("p", "x").join(settled.join(number, "first"), "p", "left").select("x", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return points.select(F.col(id_col), F.array(*columns).alias("x")).join(named, "x").select(id_col, "cluster")


def cluster_water_bodies(raster_data: Raster, method: str = "kmeans", n_clusters: int = 2, water_index: Raster | None = None, seed: int = 42, **kwargs) -> tuple[Raster, dict]:
    """Clusters of cells by their bands (and a water index) after scaling, and what is known of them.

    The water cluster has the smallest mean water index (near infrared first), else it is cluster 0.
    """
    views = [raster_data[b] for b in raster_data.bands] + ([water_index] if water_index is not None else [])
    df, names = aligned(*views)
    df = df.select("row", "col", *[F.col(n).cast("double").alias(n) for n in names])
    index = names[-1] if water_index is not None else None
    kept = df.withColumn("index", F.col(index)) if index else df
    scaled = staged(standardized(kept, names))
    if method == "kmeans":
        cells, model = kmeans_cells(scaled, names, n_clusters, seed, **kwargs)
        centres = sorted(tuple(map(float, c)) for c in model.clusterCenters())
        meta = {"cluster_centers": centres, "inertia": float(model.summary.trainingCost)}
    elif method == "dbscan":
        points = scaled.withColumn("id", F.col("row").cast("long") * F.lit(raster_data.width) + F.col("col"))
        found = dbscan(points, names, **kwargs)
        cells = points.join(found, "id")
        meta = {}
    else:
        raise ValueError(f"unknown method: {method}")
    cells = staged(cells.select("row", "col", "cluster", *(["index"] if index else [])))
    sizes = cells.groupBy("cluster").agg(F.count("*").alias("n"), (F.avg("index") if index else F.lit(0.0)).alias("mean")).orderBy("cluster").collect()  # a row for each cluster
    real = [r for r in sizes if r["cluster"] >= 0]
    meta["water_cluster"] = min(real, key=lambda r: (r["mean"], r["cluster"]))["cluster"] if index and real else 0
    if method == "kmeans":
        meta["cluster_means"] = [r["mean"] for r in real] if index else None
    else:
        meta |= {"n_clusters": len(real), "noise_points": next((r["n"] for r in sizes if r["cluster"] < 0), 0)}
    return Raster(cells.select("row", "col", "cluster"), raster_data.height, raster_data.width, ("cluster",), raster_data.meta), meta


def cluster_bodies(clusters: Raster, water_cluster: int, pixel_size: float | tuple[float, float] = 30.0) -> DataFrame:
    """(body_id, area_m2, perimeter_m, compactness) of the water cluster's bodies; a body without perimeter has compactness 0."""
    area = pixel_area_m2(pixel_size)
    edge = sum(pixel_size) / 2 if isinstance(pixel_size, tuple) else float(pixel_size)
    cells = staged(label(clusters.with_value(clusters.value == F.lit(water_cluster), "mask")))
    shapes = body_shapes(cells, clusters.height, clusters.width)
    a, p = F.col("pixels") * F.lit(area), F.col("perimeter") * F.lit(edge)
    return shapes.select("body_id", a.alias("area_m2"), p.alias("perimeter_m"), F.when(p > 0, F.lit(4 * math.pi) * a / (p * p)).otherwise(F.lit(0.0)).alias("compactness"))


def analyze_water_clusters(cluster_labels: Raster, water_cluster: int, pixel_size: float | tuple[float, float] = 30.0) -> dict:
    """Number of bodies, areas in m2, mean perimeter and compactness; `bodies` is the table of all of them."""
    bodies = staged(cluster_bodies(cluster_labels, water_cluster, pixel_size))
    zero = F.lit(0.0)
    row = bodies.agg(
        F.count("*").alias("num_water_bodies"),
        F.coalesce(F.sum("area_m2"), zero).alias("total_area_m2"),
        F.coalesce(F.avg("area_m2"), zero).alias("mean_area_m2"),
        F.coalesce(F.max("area_m2"), zero).alias("max_area_m2"),
        F.coalesce(F.min("area_m2"), zero).alias("min_area_m2"),
        F.coalesce(F.avg("perimeter_m"), zero).alias("mean_perimeter_m"),
        F.coalesce(F.avg("compactness"), zero).alias("mean_compactness"),
    ).first()
    return row.asDict() | {"bodies": bodies}


#: The grids that are searched by default.
GRIDS = {"kmeans": {"n_clusters": [2, 3, 4], "seed": [42]}, "dbscan": {"eps": [0.3, 0.5, 0.7], "min_samples": [5, 10, 15]}}


def optimize_clustering(raster_data: Raster, water_index: Raster | None = None, method: str = "kmeans", param_grid: dict | None = None) -> tuple[dict | None, list[dict]]:
    """The best parameters of a grid and all results.

    The score is minus the inertia, or minus the share of noise if two to five clusters come out (else minus
    infinity). The first strict maximum wins; if every score is minus infinity there is no best.
    """
    if method not in GRIDS:
        raise ValueError(f"unknown method: {method}")
    grid = param_grid or GRIDS[method]
    cells = raster_data.height * raster_data.width
    best, top, results = None, -math.inf, []
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        own = {"seed" if k == "random_state" else k: v for k, v in params.items()}
        _, meta = cluster_water_bodies(raster_data, method, water_index=water_index, **own)
        score = -meta["inertia"] if method == "kmeans" else -meta["noise_points"] / cells if 2 <= meta["n_clusters"] <= 5 else -math.inf
        results.append({"params": params, "score": score, "metadata": meta})
        if score > top:
            best, top = params, score
    return best, results
