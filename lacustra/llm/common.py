"""What the operators share: the shared folder, staged tables, partition counts and packed exchanges."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacustra.operators.graph import components  # noqa: F401  for the operators
from lacustra.storage import staged  # noqa: F401  for the operators

#: Bytes of text that one Python step holds at a time.
CHUNK_BYTES = 4 << 20
#: Multipliers of a 64-bit finalizer (public: splitmix64).
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


#: Beyond this an estimate of Catalyst's only says that it doesn't know; rows are then counted, at so many bytes each.
UNKNOWN_BYTES, ROW_BYTES = 10**17, 4096


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size (for files: their size), without a job; where it has none, from the number of rows."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else df.count() * ROW_BYTES


def partitions(df: DataFrame, ratio: float = 1.0, target: int = 24 << 20) -> int:
    """How many partitions of about `target` bytes hold `ratio` times df; at least spark.sql.shuffle.partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(df) * ratio
    return int(min(max(least, size // target + 1), 1 << 20))


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back to the system when its task is done: worker processes live on, idle, between tasks."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return whole


def modest(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of 1000 rows unless it sets a size itself: rows here are whole texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(31))


_SPACES = b"\t\n\x0b\x0c\r "
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IN_WORD = bytes(b not in _SPACES for b in range(256))
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data (A-Z lower-cased, cut at ASCII white space) start, and a 64-bit hash of each.

    Hashes are built from eight bytes at a time of all words at once; equal words have equal hashes anywhere.
    """
    data = b"\n" + data.translate(_LOWER) + b"\n"
    inside = np.frombuffer(data.translate(_IN_WORD), np.bool_)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edge[0::2] + 1, edge[1::2] - edge[0::2]
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=data + bytes(8), strides=(1,))
    with np.errstate(over="ignore"):
        h = mixed((eight[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at, more = 8, np.flatnonzero(size > 8)
        while len(more):
            part = eight[start[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]
            h[more] = mixed(h[more] * np.uint64(0xC2B2AE3D27D4EB4F) ^ part)
            at += 8
            more = more[size[more] > at]
    return start - 1, h


def squeezed(*arrays: np.ndarray) -> bytes:
    """Integer arrays in as few bytes as the range of each needs."""
    head, body = [len(arrays)], []
    for a in arrays:
        least = a.min() if len(a) else a.dtype.type(0)
        above = (a - least).view(np.uint64) if a.dtype.itemsize == 8 else (a - least).astype(np.uint64)
        most = int(above.max()) if len(a) else 0
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
        head += [len(a), width, int(np.array(least).astype(np.uint64 if a.dtype.kind == "u" else np.int64).view(np.int64))]
        body.append(above.astype(f"<u{width}").tobytes())
    return np.array(head, np.int64).tobytes() + b"".join(body)


def unsqueezed(blob: bytes) -> list[np.ndarray]:
    """What squeezed() packed, as int64 (uint64 values keep their bits)."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    at, out = 8 * (1 + 3 * n), []
    with np.errstate(over="ignore"):
        for size, width, least in np.frombuffer(blob, np.int64, 3 * n, 8).reshape(n, 3).tolist():
            out.append(np.frombuffer(blob, f"<u{width}", size, at).astype(np.uint64).view(np.int64) + np.int64(least))
            at += size * width
    return out


def sliced(rows: Iterable[tuple], weight: Callable[[tuple], int], most: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Lists of rows whose weights sum to about `most`; a heavier row stands alone."""
    held, total = [], 0
    for row in rows:
        w = weight(row)
        if held and total + w > most:
            yield held
            held, total = [], 0
        held.append(row)
        total += w
    if held:
        yield held


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a few thousand at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def texts_of(batches: Iterable[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Rows (id, text, ...) in lists of about `most` characters of text."""
    return sliced(rows_of(batches), lambda r: 64 + len(r[1] or ""), most)


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df hash-partitioned into n by keys."""
    return df.repartition(n, *[F.col(k) for k in keys])


def bucket_bounds(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that groups uint64 keys by bucket (key mod n), the buckets present, and where each begins and the last ends."""
    bucket = (keys % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, start = np.unique(bucket[order], return_index=True)
    return order, found, np.append(start, len(order))


def most_frequent(df: DataFrame, count: str, most: int, *order: str) -> DataFrame:
    """Rows with the highest counts, about `most` at most, ordered by count (highest first) and then by `order`.

    A sorted limit would send that many rows from every task to the driver. Here counts fall into steps of an
    eighth of a power of two; one small table says which steps fit within `most` as a whole, and only their rows
    come out. If even the highest step has more rows, a hash of `order` picks a share of it.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * F.lit(8.0)).cast("int")
    sizes = sorted(((r["step"], r["n"]) for r in df.where(F.col(count) > 0).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 512 rows at most
    least, total = None, 0
    for s, n in sizes:
        total += n
        if total > most:
            break
        least = s
    if not sizes:
        return df.where(F.lit(False))
    if least is None:
        share = int(most / sizes[0][1] * (1 << 30))
        kept = df.where((F.col(count) > 0) & (step == F.lit(sizes[0][0])) & (F.pmod(F.xxhash64(*order), F.lit(1 << 30)) < F.lit(share)))
    else:
        kept = df.where((F.col(count) > 0) & (step >= F.lit(least)))
    return kept.orderBy(F.desc(count), *order)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucketwise(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by their first column, as (its value, the rest of each row), one value after the other."""
    now, held = None, []
    for row in rows_of(b.slice(i, 8) for b in batches for i in range(0, b.num_rows, 8)):
        if held and row[0] != now:
            yield now, held
            held = []
        now = row[0]
        held.append(row[1:])
    if held:
        yield now, held


def exchanged(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, ...) with each bucket whole in one partition and the buckets of a partition one after the other."""
    return packed.repartition(min(max(1, buckets // 4), 1 << 20), "bucket").sortWithinPartitions("bucket")
