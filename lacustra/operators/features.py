"""Feature tables, classifiers and change detection."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacustra.operators.neighbors import box
from lacustra.raster import Raster, aligned
from lacustra.storage import staged


def feature_names(bands: tuple[str, ...], window_size: int) -> list[str]:
    """Bands first, then mean and variance of each."""
    return [*bands, *[f"{b}_{k}" for b in bands if window_size > 1 for k in ("mean", "variance")]]


def extract_features(raster_data: Raster, window_size: int = 3, indices: list[str] | None = None) -> DataFrame:
    """(row, col, features array<double>): every band in view, then local means and variances over a window; `indices` has no effect."""
    bands = raster_data.bands
    df = raster_data.df.select("row", "col", *[F.col(b).cast("double").alias(b) for b in bands])
    if window_size > 1:
        df = df.join(box(df, list(bands), raster_data.height, raster_data.width, window_size), ["row", "col"])
    return df.select("row", "col", F.array(*[F.col(n) for n in feature_names(bands, window_size)]).alias("features"))


@dataclass
class Classified:
    model: object
    accuracy: float
    confusion_matrix: list[list[int]]
    labels: list[float]
    report: dict[str, dict[str, float]]

    def report_text(self) -> str:
        """The report as a table: a line for each class, then accuracy, and the plain and weighted means of the classes."""
        kinds, total = ("precision", "recall", "f1"), sum(r["support"] for r in self.report.values())
        lines = [(name, *(f"{r[k]:.2f}" for k in kinds), str(r["support"])) for name, r in self.report.items()]
        lines.append(("accuracy", "", "", f"{self.accuracy:.2f}", str(total)))
        for name, weight in (("macro avg", lambda r: 1 / len(self.report)), ("weighted avg", lambda r: r["support"] / total if total else 0.0)):
            lines.append((name, *(f"{sum(r[k] * weight(r) for r in self.report.values()):.2f}" for k in kinds), str(total)))
        return "\n".join("".join(f"{c:>14}" for c in line) for line in [("", "precision", "recall", "f1-score", "support"), *lines])


def vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("features")) if dict(df.dtypes)["features"].startswith("array") else df


def train_classifier(samples: DataFrame, model_type: str = "rf", test_size: float = 0.2, random_state: int = 42, **model_params) -> Classified:
    """A random forest from (features, label) and its metrics on a held-out part.

    The part is picked by a seeded hash of the row's values, so that it doesn't depend on partitions. Parameters
    of the forest go to Spark ML (n_estimators and max_depth are taken as well).
    """
    if model_type.lower() != "rf":
        raise ValueError(f"unknown model type: {model_type}")
    names = {"n_estimators": "numTrees", "max_depth": "maxDepth"}
    params = {"numTrees": 100, "maxDepth": 20, "seed": random_state} | {names.get(k, k): v for k, v in model_params.items()}
    arrays = samples.select(F.col("features"), F.col("label").cast("double").alias("label"))
    flat = arrays if dict(arrays.dtypes)["features"].startswith("array") else arrays.selectExpr("vector_to_array(features) AS features", "label")
    split = F.pmod(F.xxhash64(F.lit(random_state), "features", "label"), F.lit(1_000_000)) < F.lit(int(test_size * 1_000_000))
    data = staged(flat.withColumn("held_out", split))
    model = RandomForestClassifier(featuresCol="features", labelCol="label", **params).fit(vectors(data.where("NOT held_out")))
    counts = model.transform(vectors(data.where("held_out"))).groupBy("label", "prediction").count().collect()  # classes squared
    labels = sorted({r["label"] for r in counts} | {r["prediction"] for r in counts})
    table = {(r["label"], r["prediction"]): r["count"] for r in counts}
    matrix = [[table.get((a, b), 0) for b in labels] for a in labels]
    total = sum(map(sum, matrix))
    report = {}
    for i, a in enumerate(labels):
        hit, said, there = matrix[i][i], sum(row[i] for row in matrix), sum(matrix[i])
        p, r = hit / said if said else 0.0, hit / there if there else 0.0
        report[str(a)] = {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0, "support": there}
    return Classified(model, sum(matrix[i][i] for i in range(len(labels))) / total if total else 0.0, matrix, labels, report)


def predict_raster(model, features: DataFrame, batch_size: int | None = None) -> DataFrame:
    """(row, col, prediction) by a Spark ML model, or by any object whose predict() takes a matrix (rows of features) and gives a value for each row.

    Such an object goes to the tasks and is asked for a batch of rows at a time; else Spark's partitions are the batches.
    """
    if hasattr(model, "transform") and not hasattr(model, "predict_proba"):
        return model.transform(vectors(features)).select("row", "col", "prediction")
    if not hasattr(model, "predict"):
        raise TypeError("a model has to have transform() or predict()")
    most = batch_size or 65_536

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                part = whole.slice(at, most)
                x = np.array(part.column(2).to_pylist(), np.float64)
                said = np.asarray(model.predict(x), np.float64).ravel()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(said)], ["row", "col", "prediction"])

    arrays = features if dict(features.dtypes)["features"].startswith("array") else features.withColumn("features", vector_to_array("features"))
    kinds = {c: arrays.schema[c].dataType.simpleString() for c in ("row", "col")}
    return arrays.select("row", "col", F.col("features").cast("array<double>").alias("features")).mapInArrow(run, f"row {kinds['row']}, col {kinds['col']}, prediction double")


def detect_changes_ml(raster1: Raster, raster2: Raster, model=None, threshold: float = 0.5) -> Raster:
    """Whether the absolute difference, or with a model the class predicted from its features, is over the threshold."""
    df, (a, b) = aligned(raster1, raster2)
    diff = raster1.with_value(F.abs(F.col(b).cast("double") - F.col(a).cast("double")), "value", df)
    if model is None:
        return diff.with_value(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > F.lit(float(threshold))), "changed")
    said = predict_raster(model, extract_features(diff))
    return diff.with_value(F.col("prediction") > F.lit(float(threshold)), "changed", said)


def augment_training_data(samples: DataFrame, augmentation_factor: int = 2, random_state: int = 42, shape: tuple[int, int] | None = None) -> DataFrame:
    """samples (features array, label[, row, col]) with noisy and turned copies, `copy` numbering them from 0.

    Each of factor - 1 rounds adds a copy with normal noise of 0.1 and, for samples with cells and a shape, a
    copy turned by one, two or three quarters; labels go along.
    """
    out = samples.withColumn("copy", F.lit(0))
    first = samples.select("features").first() if augmentation_factor > 1 else None
    n = len(first["features"]) if first else 0
    for k in range(1, augmentation_factor):
        noisy = F.array(*[F.col("features")[i] + F.lit(0.1) * F.randn(random_state + 1000 * k + i) for i in range(n)])
        out = out.unionByName(samples.withColumns({"features": noisy, "copy": F.lit(2 * k - 1)}))
        if shape is not None and {"row", "col"} <= set(samples.columns):
            h, w = shape
            turn = (random_state + k) % 3 + 1
            row, col = {1: (w - 1 - F.col("col"), F.col("row")), 2: (h - 1 - F.col("row"), w - 1 - F.col("col")), 3: (F.col("col"), h - 1 - F.col("row"))}[turn]
            out = out.unionByName(samples.withColumns({"row": row, "col": col, "copy": F.lit(2 * k)}))
    return out


def save_model(model, filepath: str, metadata: dict | None = None) -> None:
    """A Spark ML model at filepath/model and its metadata beside it; folders are made as needed."""
    model.write().overwrite().save(f"{filepath}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(metadata or {}),)], "metadata string").coalesce(1).write.mode("overwrite").json(f"{filepath}/metadata")


def load_model(spark, filepath: str) -> tuple[object, dict]:
    """(model, metadata) that save_model wrote; FileNotFoundError if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{filepath}/model")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(filepath)
    model = DefaultParamsReader.loadParamsInstance(f"{filepath}/model", spark)
    return model, json.loads(spark.read.json(f"{filepath}/metadata").first()["metadata"])
