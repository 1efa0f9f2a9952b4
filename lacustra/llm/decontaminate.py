"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Benchmark items are sets of five-word shingles and are partitioned by size (powers of two). In a partition,
each item's sketch is its k smallest MinHash values; k follows from the partition's upper size u and the
threshold t as u - ceil(t u) + 1. A document that contains t of an item lacks at most n - ceil(t n) of its
shingles, so it must hold at least one of those k: the sketch misses nothing, however long the document.
Documents probe the sketches with each of their shingles. Candidates (pairs of a row's key and an item) are few beside
the documents; up to a counted bound they are broadcast to a second scan of the texts, which verifies them by exact
containment of the shingles' text, so texts aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unused

#: Rows of sketches (16 bytes each), of candidates and of keys of hits up to which they are broadcast, and rows of sketches up to
#: which the items' shingles are (about 90 bytes for each such row); beyond it they are joined by a shuffle. All are counted first.
BROADCAST_ROWS, BROADCAST_ITEMS = 2_000_000, 100_000
WORDS = 5


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != F.lit(""))


def shingles(w: Column, n: int = WORDS) -> Column:
    """Distinct n-word shingles of an array of words; the whole sequence if it is shorter; empty without words.

    w is bound as a lambda's variable: as a plain expression it would be evaluated anew for every shingle.
    """

    def of(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))
        )

    return F.transform(F.array(w), of)[0]


def _hash(h: Column, i: Column, n: int) -> Column:
    """The hash of the shingle at i, from the hashes of the words."""
    return F.when(F.size(h) >= n, F.xxhash64(*[h[i + F.lit(j)] for j in range(n)])).otherwise(F.xxhash64(h))


def _hashed(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., most, hash): one row for each shingle position of column w; most: how many shingles the row has at most."""
    # explode_outer: for explode, the optimizer would infer a filter that splits every text once more.
    h = rows.select(*keep, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    places = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.greatest(F.size("h") - F.lit(WORDS), F.lit(0))))
    each = h.select(*keep, "h", F.explode_outer(places).alias("i")).where("i IS NOT NULL")
    return each.select(*keep, F.greatest(F.size("h") - F.lit(WORDS - 1), F.lit(1)).alias("most"), _hash(F.col("h"), F.col("i"), WORDS).alias("hash"))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item_id, n, key): the sketch of each item, with n its number of distinct shingle hashes."""
    sets = _hashed(items, "item_id").groupBy("item_id").agg(F.sort_array(F.collect_set("hash")).alias("keys"))  # one item's shingles
    n = F.size("keys")
    upper = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) + F.lit(1)) - F.lit(1)
    k = upper - F.ceil(F.lit(threshold) * upper - F.lit(1e-9)) + F.lit(1)
    return sets.select("item_id", n.alias("n"), F.explode(F.slice("keys", F.lit(1), F.least(n, k.cast("int")))).alias("key"))


def _key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and its text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _small(df: DataFrame, most: int) -> DataFrame:
    """df, which is staged, to be broadcast if it has `most` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def _verified(docs: DataFrame, benchmark: DataFrame, threshold: float, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(key, doc_id, item_id, n_item, n_shared) for the rows that hold an item."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("w")).where("item_id IS NOT NULL AND size(w) > 0")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), _key(id_col, text_col).alias("key")).where("doc_id IS NOT NULL AND t IS NOT NULL")
    # Equal ids with other texts are told apart by a hash of the words.
    items = items.groupBy("item_id", F.xxhash64("w").alias("v")).agg(F.first("w").alias("w")).withColumn("item_id", F.struct("item_id", "v"))
    sketch = staged(sketches(items, threshold))
    probes = _hashed(texts.select("key", words(F.col("t")).alias("w")), "key").withColumnsRenamed({"key": "row", "hash": "key"})
    # A document with fewer shingles than the threshold asks for can't contain the item.
    pairs = staged(probes.join(_small(sketch, BROADCAST_ROWS), "key").where(F.col("most") >= F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9))).select(F.col("row").alias("key"), "item_id").distinct())
    sets = items.select("item_id", shingles(F.col("w")).alias("s"))
    sets = F.broadcast(sets) if sketch.count() <= BROADCAST_ITEMS else sets
    both = texts.join(_small(pairs, BROADCAST_ROWS // 4), "key").join(sets, "item_id")
    shared = F.size(F.array_intersect("s", shingles(words(F.col("t"))))).cast("long")
    done = both.select("key", "doc_id", F.col("item_id.item_id").alias("item_id"), F.size("s").cast("long").alias("n_item"), shared.alias("n_shared"))
    return done.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - F.lit(1e-9))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): documents that hold at least `threshold` of an item's distinct shingles.

    Words are lower-cased runs of letters and digits. Null or wordless texts and items and rows with a null id
    match nothing. Rows that repeat an id count as separate texts: a pair comes out once, with its highest
    n_shared; items that repeat an id likewise. Other columns aren't read. What is broadcast is counted first.
    """
    enough = _verified(docs, benchmark, threshold, id_col, text_col, item_col, item_text)
    return enough.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_item")).alias("m")).select("doc_id", "item_id", F.col("m.n_item").alias("n_item"), F.col("m.n_shared").alias("n_shared"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without the rows that hold a benchmark item; every other row stays as it is, null ids included.

    Rows that repeat an id with other texts are judged by their own texts.
    """
    name = unused(docs, "_hit")
    hit = staged(_verified(docs, benchmark, threshold, "doc_id", "text", "item_id", "text").select(F.col("key").alias(name)).distinct())
    return docs.join(_small(hit, BROADCAST_ROWS), (_key("doc_id", "text") == F.col(name)) & F.col("doc_id").isNotNull(), "left_anti").select(docs.columns)
