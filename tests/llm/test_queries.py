"""The queries themselves on the smallest tables: columns and types, and rows against plain ways where no SQL is given."""

import base64
import hashlib
import zlib

import public_tokenizers
import pytest
import tiktoken
from test_exact import plain_repeats

from lacustra.llm import queries, sharding

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op5_topk_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op6_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def held_out(i, folds, remainder):
    return zlib.crc32(str(i).encode()) % folds == remainder


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, texts, name):
    df = queries.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    if name != "op5_topk_search":
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    folds = {"op6_lm_scoring": (10, 0), "op8_language_id": (5, 0), "op10_toxicity": (3, 1)}.get(name)
    if folds:
        assert all(r["held_out"] == held_out(r["doc_id"], *folds) for r in rows)
    if name == "op1_byte_bpe":
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for r in rows:
            ids = known.encode_ordinary(texts[r["doc_id"]])
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    if name == "op9_suffix_dedup":
        plain = plain_repeats(list(texts.items()))
        assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (*plain[r["doc_id"]][:3], hashlib.sha256(plain[r["doc_id"]][3]).hexdigest()) for r in rows)
    if name == "op7_sharding":
        by: dict[int, list[int]] = {}
        for r in rows:
            raw = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key") and 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
            by.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    if name == "op10_toxicity":
        assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)


def test_each_bucket_is_one_partition(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(800)], "doc_id long, text string")
    moved = sharding.shuffled_shards(docs, bucket_bytes=4_000).selectExpr("_bucket", "spark_partition_id() AS p")
    by: dict[int, set[int]] = {}
    for r in moved.distinct().collect():
        by.setdefault(r["p"], set()).add(r["_bucket"])
    assert len(by) > 16 and all(len(x) == 1 for x in by.values())
