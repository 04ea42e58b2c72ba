"""The queries opN_<name> over the test tables, with production parameters, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import op01_line_dedup, op02_mixing, op03_embeddings, op04_packing, op05_toxicity, op06_token_counts, op07_url_filter, op08_neighbours, op09_minhash, op10_suffix, op11_embedding_whitening, op12_tokenizer_alignment, op13_token_ids
from parchment.llm.shared import own_path

TOKENIZER = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")
FILED = "byte_bpe_50k.json"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = op01_line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), extend=True)
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_kept"), "n_chunks_removed", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = op05_toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = op05_toxicity.expected_severity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "severity", F.col("severity_toxic").alias("toxic"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_url_filter.url_verdicts(table(spark, sf_dir, "pages"), RULES)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    done = op11_embedding_whitening.whiten(rows.select("vec_id", "embedding"), op11_embedding_whitening.fit(rows))
    return done.select("vec_id", F.posexplode("whitened").alias("at", "whitened"), "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "shares", "identity_error").selectExpr(
        "vec_id", "at + 1 as component", "n", "deviation", "whitened", "shares[at] as explained", "identity_error")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = op12_tokenizer_alignment.alignments(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED), shape=lambda groups: F.coalesce(F.sha2(groups, 256), F.lit("")))
    return done.withColumnRenamed("groups", "groups_sha256")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_path(spark, "token-files")
    op13_token_ids.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(FILED), path)
    return op13_token_ids.read_tokens(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_mixing, op3_embedding_near_dedup, op4_packing, op5_toxicity, op6_token_counts, op7_url_filter, op8_nearest_neighbours, op9_minhash, op10_suffix_dedup, op11_whitening, op12_alignment, op13_token_files)}


def oracle_sql() -> dict[str, str]:
    return {}
