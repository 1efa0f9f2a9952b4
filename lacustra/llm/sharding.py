"""Sharding by a two-pass external shuffle.

Pass one scatters every record, by seeded hashes, to a bucket that fits in memory. A bucket belongs to one
shard. Pass two takes each bucket alone, shuffles it with a seeded Fisher-Yates shuffle and hands it on (or
writes it). The shard is fixed by doc_id and shard count alone (law `key`): the shard with the highest seeded
hash wins, so that one more shard takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import estimated_bytes, lean, staged

#: Bytes of records that a bucket holds on average.
BUCKET_BYTES = 16 << 20


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash of the key is highest (a null key is a key as well)."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*scores) if shards > 1 else scores[0])["s"]


def fisher_yates(n: int, seed: int) -> list[int]:
    """0..n-1 in shuffled order; seeded, and the same wherever it runs."""
    rng, order = np.random.Generator(np.random.PCG64(seed)), list(range(n))
    if n > 1:
        picks = rng.integers(0, np.arange(n, 1, -1)).tolist()
        for i, j in zip(range(n - 1, 0, -1), picks, strict=True):
            order[i], order[j] = order[j], order[i]
    return order


def shuffled_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df's columns with `_shard`, `_grown_shard` (with one shard more), `_bucket` and `_at` (position in the shuffled bucket).

    Every row comes out once, repeated rows as often as they came in. Rows are spread within a shard by a hash
    of id and text, so that a bucket holds about bucket_bytes; rows that agree in both stay together, but with
    a null id, which can be any share of the rows, the position in its input split is hashed as well. Column
    names that clash with the four new ones raise ValueError. An empty table gives an empty table.
    """
    own = {"_shard", "_grown_shard", "_bucket", "_at"}
    if clash := own & {c.lower() for c in df.columns}:
        raise ValueError(f"columns are already there: {sorted(clash)}")
    subs = int(min(estimated_bytes(df) * 2 // (bucket_bytes * shards) + 1, 1 << 22))
    key, text = F.col(id_col), F.col(text_col)
    spread = F.xxhash64(F.lit(seed + 1), key, text, F.when(key.isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)))
    scattered = df.withColumns(
        {"_shard": shard_of(key, shards, seed), "_grown_shard": shard_of(key, shards + 1, seed), "_sub": F.pmod(spread, F.lit(subs)), "_spread": spread}
    ).withColumn("_bucket", (F.col("_shard") * F.lit(subs) + F.col("_sub")).cast("long"))
    parts = min(shards * subs, 1 << 20)
    # One bucket, one task: dealt by a hash, several would meet in some.
    sent = scattered.drop("_sub").repartitionById(parts, (F.col("_bucket") % F.lit(parts)).cast("int")).sortWithinPartitions("_bucket", "_spread", id_col)
    names = [c for c in sent.columns if c != "_spread"]
    schema = T.StructType([*(sent.schema[c] for c in names), T.StructField("_at", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            order = fisher_yates(table.num_rows, seed ^ table.column("_bucket")[0].as_py() << 8)
            table = table.take(pa.array(order, pa.int64())).append_column("_at", pa.array(range(len(order)), pa.int64()))
            yield from table.to_batches(max_chunksize=2048)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            batch = batch.select(names)
            buckets = batch.column("_bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column("_bucket")[0].as_py() != buckets[a]:
                    yield from out(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from out(held)

    return sent.mapInArrow(lean(run), schema)


def with_slots(shuffled: DataFrame) -> DataFrame:
    """shuffled_shards' rows (or a projection of them) with `_slot`: gapless from 0 in each shard, bucket after bucket.

    The rows are staged; the offsets come from one count per bucket (a window over a table that has a row for
    each bucket, partitioned by shard).
    """
    from pyspark.sql import Window

    kept = staged(shuffled)
    counts = kept.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    return kept.join(offsets, "_bucket").withColumn("_slot", F.col("_from") + F.col("_at")).drop("_from")


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Writes df's rows to one folder per shard (path/_shard=k), each bucket in its shuffled order."""
    shuffled_shards(df, **options).drop("_grown_shard").write.partitionBy("_shard").parquet(path)
