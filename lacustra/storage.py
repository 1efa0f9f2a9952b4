"""The folder that driver and executors share, and tables staged in it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Nodes of plans that are scans and work on single rows.
_PLAIN = {"LogicalRelation", "LogicalRDD", "LocalRelation", "Range", "Project", "Filter", "Generate", "Union"}
#: Temporary folders by application, of sessions that run in one process.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it names none, a temporary folder if all runs in this process, else RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _OWN.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="lacustra-")
        _OWN[context.applicationId] = found
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str = "stage") -> str:
    """A fresh path in the shared folder; what is written there goes when Python ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def repeatable(df: DataFrame) -> DataFrame:
    """df if it only scans files and works on single rows, else df staged: several passes cost scans and see the same values."""

    def plain(node) -> bool:
        children = node.children()
        return node.getClass().getSimpleName() in _PLAIN and all(plain(children.apply(i)) for i in range(children.size()))

    plan = df._jdf.queryExecution().optimizedPlan()
    return df if plan.deterministic() and plain(plan) else staged(df)
