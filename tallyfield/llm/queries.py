"""The registered queries of this subpackage, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfield.llm import bpe, licenses, lines, packing, pieces, quality, simhash, suffixes, toxicity, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"))


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, lexicon, keep=["doc_id"])
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detected(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_lines", "n_dropped", F.octet_length("kept").cast("long").alias("kept_bytes"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("kept")


def op10_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_simhash_near_duplicates, op3_sentencepiece_codec, op4_toxicity_scores, op5_license_scan, op6_quality_rules, op7_best_fit_packing, op8_line_dedup, op9_suffix_array_dedup, op10_embedding_near_duplicates)}
#: The other operators' results depend on hashes, vocabularies, fitted models or
#: trees that SQL doesn't have; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_embedding_near_duplicates": """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        good AS MATERIALIZED (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good AS a, good AS b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
        r AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.root = l.a),
        n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
        c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id)
        SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
}
