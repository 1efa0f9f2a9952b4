"""The corpus pipeline: five stages over documents, each an operator of lacustra.llm.

Each stage works on all that the one before kept, and is written as Parquet and read again in between. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacustra.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from lacustra.llm.common import modest, staged, unused

#: Documents of this score or more are rejected.
TOXIC = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that a weighted lexicon finds toxic; it is learned from a bounded sample of the labelled rows.

    Null and empty texts have no word and stay unless all labelled rows are toxic; without labels all rows stay. Rows that
    repeat an id and rows with a null id are judged by their own texts. An empty table stays empty.
    """
    labels = modest(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.rejected(docs, toxicity.train(docs, labels), TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier line matches; n_chars follows; documents of which no word is left go.

    Null and empty texts, and texts that lose no line, stay as they are. Of rows that repeat an id with other texts each
    loses its own lines; rows that repeat id and text lose the same ones. An empty table stays empty.
    """
    modest(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    done = line_dedup.deduplicated(docs, percent=80, carry=others)
    left = done.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    values = {c: F.col(f"rest.`{c}`") for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in others:
        values["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(values["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return left.select(*[values[c].alias(c) for c in docs.columns])


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that links of five-word shingles at 0.8 connect.

    Null, empty and wordless texts link with nothing and stay, as do documents with a null id. Rows that repeat an id with
    other texts are documents of their own; of rows that repeat both id and text one stays. An empty table stays empty.
    """
    modest(spark)
    node = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull())
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", node.alias("node"))
    groups = ngram_join.similar(rows, n=5, percent=80, id_col="node").distinct()
    named = groups.join(rows.select("node", "doc_id").distinct(), "node")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("first")).select(F.col("first.node").alias("node"))
    name = unused(docs, "_node")
    one = docs.where("doc_id IS NOT NULL").withColumn(name, node).join(first.withColumnRenamed("node", name), name, "left_semi").dropDuplicates([name])
    return one.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold 0.8 or more of the five-word shingles of a benchmark item.

    Null and wordless texts hold none and stay, as do rows with a null id. Rows that repeat an id are judged by their own
    texts. Without benchmark items every row stays.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 0.8)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of every row: token ids of its text, and the text decoded from them.

    A null text is encoded as an empty one, which has no ids. Null and repeated ids stay as they are.
    """
    modest(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    done = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode_bytes),
]
#: The lexicon is learned from a hashed sample by a greedy search, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
