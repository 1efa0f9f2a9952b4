"""The queries opN_<name> and their SQL; each is a thin layer over its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, knn, langid, line_dedup, lm, ngram_join, sharding, suffix_dedup, toxicity
from .common import modest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return modest(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """Ids of every whole text and their round trip; a null text counts as empty."""
    ranks = bpe.read_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    return bpe.digest(bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's distinct five-word shingles, with the items."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 0.8)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_join.similar(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its lines that an earlier line matches with a Jaccard similarity of 0.8 or more."""
    left = line_dedup.deduplicated(table(spark, sf_dir, "documents"), percent=80)
    return left.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce(F.col("kept"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors with the highest integer inner product for each vector whose id is divisible by 100."""
    vectors = knn.integer_vectors(table(spark, sf_dir, "embeddings"))
    return knn.top_k(vectors, vectors.where(F.col("id") % 100 == 0), 10)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every whole text by context mixing (score) and by word counts (base_score)."""
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 10, 0)
    scored = lm.score(docs, ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot after the two-pass shuffle; digests are taken from the moved texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    moved = sharding.shuffled_shards(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(1)).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "_shard", "_grown_shard", "_bucket", "_at",
    )
    return sharding.with_slots(moved).select("doc_id", "size", "text_crc32", "law", F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_grown_shard").alias("grown_shard"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 5, 0)
    model = langid.train(docs.where(~out))
    return langid.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without 100-byte strings that start earlier as well."""
    left = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text, learned from labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= F.lit(0.7)).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_decontamination, op3_ngram_join, op4_line_dedup, op5_topk_search, op6_lm_scoring, op7_sharding, op8_language_id, op9_suffix_dedup, op10_toxicity)
}

#: A text's words: A-Z lower-cased, cut at ASCII white space.
_WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
#: A text's words: lower-cased runs of letters and digits.
_RUNS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _shingled(words: str, table: str, key: str, n: int) -> str:
    """SELECT of (key, s): distinct n-word shingles; the whole sequence if there are fewer words."""
    return f"""SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS s
        FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) > 0"""


ORACLE_SQL = {
    "op2_decontamination": f"""WITH d AS ({_shingled(_RUNS, "documents", "doc_id", 5)}), b AS ({_shingled(_RUNS, "benchmark", "item_id", 5)}),
        n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
        SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM b JOIN d USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item""",
    "op3_ngram_join": f"""WITH RECURSIVE sh AS ({_shingled(_WORDS, "documents", "doc_id", 4)}),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
        reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id, n.n""",
    "op4_line_dedup": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text <> ''),
        w AS (SELECT doc_id, k, list_distinct(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS ws
            FROM l WHERE regexp_matches(line, '[\p{L}\p{N}]')),
        df AS (SELECT x, count(*) AS n FROM (SELECT unnest(ws) AS x FROM w) GROUP BY x),
        t AS (SELECT doc_id, k, len(ws) AS n, x, row_number() OVER (PARTITION BY doc_id, k ORDER BY df.n, x) AS pos FROM (SELECT doc_id, k, ws, unnest(ws) AS x FROM w) JOIN df USING (x)),
        p AS (SELECT doc_id, k, n, x FROM t WHERE pos <= n - ceil(0.8 * n) + 1),
        c AS (SELECT DISTINCT a.doc_id AS i, a.k AS ik, b.doc_id AS j, b.k AS jk FROM p a JOIN p b USING (x) WHERE (a.doc_id, a.k) < (b.doc_id, b.k) AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n),
        r AS (SELECT DISTINCT j AS doc_id, jk AS k FROM c JOIN w a ON a.doc_id = i AND a.k = ik JOIN w b ON b.doc_id = j AND b.k = jk
            WHERE 100 * len(list_intersect(a.ws, b.ws)) >= 80 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))),
        s AS (SELECT l.doc_id, count(*) AS n_lines, count(r.k) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE r.k IS NULL), '') AS kept FROM l LEFT JOIN r USING (doc_id, k) GROUP BY l.doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)""",
    "op5_topk_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
        SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10""",
}
