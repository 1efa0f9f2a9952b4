"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacustra.storage import staged


#: Edges (16 bytes each) that one task solves alone.
TOGETHER = 200_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges and the smallest node that each reaches: minima of neighbours, and of what these point at, until nothing changes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        for ends in (x, y, root[x], root[y]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        node, root = roots_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def _contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task, TOGETHER at a time: each node once, with the smallest that it reaches by them."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held, total = [], 0

    def solved() -> pa.RecordBatch:
        node, root = roots_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(x[node != root]) for x in (node, root)], schema=schema)

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        total += b.num_rows
        if total >= TOGETHER:
            yield solved()
            held, total = [], 0
    if total:
        yield solved()


def components(edges: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(node, root) for the nodes of edges (a long, b long): root is the smallest node reachable.

    Up to `together` edges, counted first, are solved by one task. More (with 0: all) are solved by steps that alternate
    between large and small stars until nothing changes. A step first contracts the edges that each task reads, which leaves
    a node one smaller neighbour for each TOGETHER of them at most. It then takes three shuffles at most: for the least
    neighbour of each node, to bring it to the node's larger neighbours (large star), and to tie a node's smaller neighbours
    to the least of them (small star). Steps are staged in the shared folder. Nodes without an edge don't come out.
    """
    now = edges.where("a <> b AND a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if together:
        now = staged(now.distinct())
        if 0 < now.count() <= together:
            return now.coalesce(1).mapInArrow(_solved, "node long, root long")
    else:
        now = staged(now)
    while True:
        flat = now.select("u", "v").mapInArrow(_contracted, "u long, v long")
        least = flat.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))  # no row for a node without a smaller neighbour, which stays
        large = flat.join(least, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"), F.col("w").isNotNull().alias("moved"))
        small = large.groupBy("u").agg(F.collect_set("v").alias("vs"), F.max("moved").alias("moved")).withColumn("m", F.array_min("vs"))
        each = small.select("u", "m", (F.col("moved") | (F.size("vs") > 1)).alias("moved"), F.explode("vs").alias("x"))
        now = staged(each.select(F.when(F.col("x") == F.col("m"), F.col("u")).otherwise(F.col("x")).alias("u"), F.col("m").alias("v"), "moved"))
        if not now.agg(F.max("moved")).first()[0]:  # each node had one smaller neighbour, and that one had none
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
