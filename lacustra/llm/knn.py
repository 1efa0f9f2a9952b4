"""Exact top-k search by inner product as a Voronoi join.

Pivots come from a sample; their number follows the root of the table's size up to a bound. Every vector goes to the
cell of its nearest pivot, and cells are summed up by how many vectors they hold, how far the farthest lies from
the pivot, and the longest vector. With a vector x = c + e, |e| <= r, and any query q:  q.x <= q.c + |q|r, and q.x <= |q||x|.

1. Each query visits the cells with the highest such bounds that hold more than k vectors. The k-th best of the
   true scores found there is the least that any further candidate must reach.
2. It then visits the other cells whose bound reaches that, and only those; a block of such a cell is skipped for the
   queries that its own, tighter ball can't satisfy.

Blocks of queries meet blocks of data, are solved by one matrix product each, and the partial lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, rows_of, staged

#: The sample that pivots come from (on average), and the least and most pivots for each dimension.
SAMPLE, PIVOTS = 4096, (4, 512)
#: Vectors in a block; blocks of a cell that one task meets; cells that a query visits first, at least.
BLOCK, TOGETHER, FIRST = 4096, 8, 2


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component; without vectors that are null or hold a null or non-finite component."""
    v = F.col(vec_col)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.col(id_col).isNotNull()
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first traversal followed by three Lloyd steps; the first row is the start."""
    x = sample.astype(np.float64)
    picked = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(picked) < min(most, len(x)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
    pivots = x[picked]
    for _ in range(3):
        cell = cells_of(x, pivots)
        for i in range(len(pivots)):
            if (mine := cell == i).any():
                pivots[i] = x[mine].mean(0)
    return pivots


def cells_of(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots**2).sum(1)[None, :] - 2 * x @ pivots.T).argmin(1)


def best(scores: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the columns of its k highest scores; of equal ones the leftmost. All columns if fewer than k."""
    n = scores.shape[1]
    if n <= k:
        return [np.arange(n)] * len(scores)
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    out = []
    for row, t in zip(scores, least, strict=True):
        above = np.flatnonzero(row > t)
        out.append(np.concatenate([above, np.flatnonzero(row == t)[: k - len(above)]]))
    return out


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products (int64): by floating point where every sum stays below 2**53, else by integers."""
    if not q.size or not d.size:
        return np.zeros((len(q), len(d)), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(d).max()) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    return q @ d.T


def packed(v: np.ndarray) -> bytes:
    """Rows of integers, each value in as few bytes as the largest needs; the first byte says how many."""
    for kind in (np.int16, np.int32, np.int64):
        if not v.size or np.abs(v).max() <= np.iinfo(kind).max:
            return bytes([np.dtype(kind).itemsize]) + v.astype(kind).tobytes()
    raise OverflowError


def unpacked(blob: bytes, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[blob[0]]
    n = (len(blob) - 1) // blob[0]
    return np.frombuffer(blob, kind, n, 1).reshape(n // dim if dim else 0, dim).astype(np.int64)


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, rows, ids, vectors) for each length of the vectors of a batch (id, v, ...)."""
    size = np.asarray(pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False), np.int64)
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield n, rows, ids[rows], flat[start[rows][:, None] + np.arange(n)]


@dataclass
class Cells:
    """The cells of one dimension that hold vectors: number, pivot, how many, radius around the pivot, length of the longest vector."""

    cell: np.ndarray
    pivot: np.ndarray
    n: np.ndarray
    radius: np.ndarray
    longest: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The highest score that a vector of each cell (columns) can have with each query (rows)."""
        q = q.astype(np.float64)
        length = np.sqrt((q**2).sum(1))[:, None]
        most = np.minimum(q @ self.pivot.T + length * self.radius[None, :], length * self.longest[None, :])
        return most + np.abs(most) * 1e-9 + 1e-6

    def first(self, q: np.ndarray, k: int) -> np.ndarray:
        """Which cells each query visits first: those of the highest bounds, FIRST at least and as many as hold more than k vectors."""
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(self.n[order], 1) - self.n[order]
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, (before <= k) | (np.arange(bound.shape[1]) < FIRST)[None, :], 1)
        return out

    def later(self, q: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
        """Which other cells each query has to visit, to find scores of `least` or more."""
        return (self.bounds(q) >= least[:, None]) & ~self.first(q, k)


_SENT = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("ids", pa.binary()), ("qv", pa.binary()), ("least", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_NONE = -(1 << 63)


def sent_queries(queries: DataFrame, cells: object, k: int, later: bool) -> DataFrame:
    """(dim, cell, ids, qv, least): blocks of the queries (id, v, least) that visit each cell first, or later; cells: a broadcast dict of Cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def out(key: tuple[int, int]) -> pa.RecordBatch:
            ids, q, least = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, ids.tobytes(), packed(q), least.tobytes()), _SENT.types, strict=True)], schema=_SENT)

        for batch in batches:
            asked = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim, rows, ids, q in by_length(batch):
                if dim not in cells.value:
                    continue
                own, least = cells.value[dim], asked[rows]
                visits = own.later(q, k, least) if later else own.first(q, k)
                for j in np.flatnonzero(visits.any(0)).tolist():
                    some = visits[:, j]
                    held.setdefault((dim, int(own.cell[j])), []).append((ids[some], q[some], least[some]))
                    if sum(len(x[0]) for x in held[dim, int(own.cell[j])]) >= BLOCK:
                        yield out((dim, int(own.cell[j])))
        for key in list(held):
            yield out(key)

    return queries.select("id", "v", "least").mapInArrow(lean(run), "dim int, cell int, ids binary, qv binary, least binary")


def scores(blocks: DataFrame, sent: DataFrame, salts: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block for each query that is sent to its cell, above its least score."""
    own = blocks.join(salts, ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("ids"), F.col("salts"))).select("dim", "cell", "salt", "centre", "radius", F.col("ids").alias("d_ids"), F.col("vectors").alias("d"))
    asked = sent.join(salts, ["dim", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - F.lit(1)))).drop("salts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, qv, least, centre, radius, d_ids, dv in rows_of(b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            ids, d_ids, least = (np.frombuffer(x, np.int64) for x in (ids, d_ids, least))
            q, v = unpacked(qv, dim), unpacked(dv, dim)
            most = q @ np.frombuffer(centre) + np.sqrt((q.astype(np.float64) ** 2).sum(1)) * radius
            kept = most + np.abs(most) * 1e-9 + 1e-6 >= least
            ids, q, least = ids[kept], q[kept], least[kept]
            for at in range(0, len(ids), 256):
                score = products(q[at : at + 256], v)
                enough = score >= least[at : at + 256, None]
                asks = np.flatnonzero(enough.any(1))  # the others find nothing here that counts
                if not len(asks):
                    continue
                score, enough, own_ids = score[asks], enough[asks], ids[at : at + 256][asks]
                same = own_ids[:, None] == d_ids[None, :]
                want = k + int(same.sum(1).max())  # the query itself can stand among the best
                rows, cols = [], []
                for i, c in enumerate(best(score, want)):
                    c = c[enough[i, c] & ~same[i, c]]
                    c = c[np.lexsort((d_ids[c], -score[i, c]))][:k]
                    rows.append(np.full(len(c), i))
                    cols.append(c)
                r, c = np.concatenate(rows), np.concatenate(cols)
                yield pa.RecordBatch.from_arrays([pa.array(own_ids[r]), pa.array(d_ids[c]), pa.array(score[r, c])], schema=_FOUND)

    met = asked.join(own, ["dim", "cell", "salt"]).select("dim", "ids", "qv", "least", "centre", "radius", "d_ids", "d")
    return met.mapInArrow(lean(run), "query_id long, vec_id long, score long").dropDuplicates()


def top_k(data: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of `data` with the highest inner product for each query.

    Both tables have (id long, v array<long>). Ties go to the smaller id; a query's own id is no candidate;
    only vectors of the query's length are. Rows that repeat both id and vector count once. Fewer than k
    candidates give fewer rows; an empty table on either side gives none. Scores must fit 64 bits.
    """
    spark = data.sparkSession
    d = data.select("id", "v", F.size("v").alias("dim")).where("dim > 0")
    sizes = {r["dim"]: r["n"] for r in d.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length
    share = min(1.0, SAMPLE / max(1, sum(sizes.values())))
    sample = d.where(F.pmod(F.xxhash64(F.lit(5), "id", "v"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).distinct().collect()  # SAMPLE rows on average
    pivots: dict[int, np.ndarray] = {}
    for dim in sorted({r["dim"] for r in sample}):
        mine = np.array(sorted(r["v"] for r in sample if r["dim"] == dim), np.int64)
        pivots[dim] = choose_pivots(mine, min(PIVOTS[1], max(PIVOTS[0], int(sizes[dim] ** 0.5) // 2)))
    shared = spark.sparkContext.broadcast(pivots)
    schema = "dim int, cell int, n long, radius_of_cell double, longest double, centre binary, radius double, ids binary, vectors binary"
    kind = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("radius_of_cell", pa.float64()), ("longest", pa.float64()), ("centre", pa.binary()), ("radius", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            ids, v = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            if len(np.unique(ids)) < len(ids):  # rows that repeat id and vector
                whole = np.unique(np.column_stack([ids, v]), axis=0)
                ids, v = whole[:, 0].copy(), whole[:, 1:]
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            pivot, centre = shared.value[key[0]][key[1]] if key[0] in shared.value else np.zeros(key[0]), v.mean(0)
            far = lambda c: float(np.sqrt(((v - c) ** 2).sum(1)).max()) * (1 + 1e-9)
            row = (*key, len(ids), far(pivot), far(0), centre.tobytes(), far(centre), ids.tobytes(), packed(v))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kind.types, strict=True)], schema=kind)

        for batch in batches:
            for dim, _, ids, v in by_length(batch):
                p = shared.value.get(dim)
                cell = cells_of(v.astype(np.float64), p) if p is not None else np.zeros(len(v), int)
                for c in np.unique(cell).tolist():
                    held.setdefault((dim, c), []).append((ids[cell == c], v[cell == c]))
                    if sum(len(x[0]) for x in held[dim, c]) >= BLOCK:
                        yield block((dim, c))
        for key in list(held):
            yield block(key)

    blocks = staged(d.mapInArrow(lean(grouped), schema))
    summary = blocks.groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.max("radius_of_cell").alias("radius"), F.max("longest").alias("longest"), F.count("*").alias("blocks")).collect()  # a row for each cell
    cells = {}
    for dim in {r["dim"] for r in summary}:
        rows = sorted((r for r in summary if r["dim"] == dim), key=lambda r: r["cell"])
        number = np.array([r["cell"] for r in rows])
        pivot = pivots[dim][number] if dim in pivots else np.zeros((1, dim))
        cells[dim] = Cells(number, pivot, *(np.array([r[c] for r in rows], t) for c, t in (("n", np.int64), ("radius", np.float64), ("longest", np.float64))))
    known = spark.sparkContext.broadcast(cells)
    salts = F.broadcast(spark.createDataFrame([(r["dim"], r["cell"], -(-r["blocks"] // TOGETHER)) for r in summary], "dim int, cell int, salts long"))  # a row for each cell
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked = staged(queries.select("id", "v").where(F.size("v") > 0))
    found = staged(ranked(scores(blocks, sent_queries(asked.withColumn("least", F.lit(_NONE)), known, k, False), salts, k)).drop("rank"))
    least = found.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("s"), F.count("*").alias("n")).select("id", F.when(F.col("n") == k, F.col("s")).otherwise(F.lit(_NONE)).alias("least"))
    rest = asked.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(_NONE)))
    more = scores(blocks, sent_queries(rest, known, k, True), salts, k)
    return ranked(found.union(more).dropDuplicates()).select("query_id", "rank", "vec_id", "score")
