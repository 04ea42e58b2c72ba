"""From raw documents to packed sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.llm import op01_line_dedup, op02_mixing, op04_packing, op05_toxicity, op09_minhash
from parchment.llm.shared import cut

#: SQL has no ordinal regression, sketch, apportionment or linear program.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id, text and a struct `rest` of all other columns, and the columns as they were: what a stage adds can't clash with any."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others).alias("rest") if others else F.lit(None).alias("rest")), docs.columns


def _unpacked(done: DataFrame, columns: list[str], **instead) -> DataFrame:
    """The columns of before, with some replaced."""
    return done.select(*((instead[c] if c in instead else F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`")).alias(c) for c in columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below one half. Null and empty texts have no features and stay, unless the model rejects a text
    without any; repeated rows share their fate; without labels, and of no documents, all stay. Extra columns of any name come back as they were."""
    model = op05_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, columns = _packed(docs)
    return _unpacked(op05_toxicity.expected_severity(rows, model).where("not severity_toxic"), columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks of lines and other repeated passages of lines, of which the first place stays; n_chars follows. Documents that
    lose all visible text go. Null and empty texts stay as they are; rows with null or equal ids are documents each for itself, so of rows
    equal in id and text one keeps its lines. No documents: none. Extra columns of any name come back as they were."""
    rows, columns = _packed(docs)
    done = op01_line_dedup.dedup_lines(rows, extend=True).where(rf"n_lines_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    if "n_chars" not in columns:
        return _unpacked(done, columns)
    return _unpacked(done, columns, n_chars=F.when(F.col("n_lines_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("rest.n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; of rows with that id and the same text, the one
    with the smallest hash of all its columns. Rows without an id or without words belong to no group and stay."""
    found = op09_minhash.near_duplicates(docs, percent=80, rows=6, detail=True).where("group is not null")
    least = found.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("least")).select("least.*")
    keys = [F.col("doc_id").alias("doc_id"), op09_minhash.text_hash("text").alias("text_hash")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), *keys)
    same = Window.partitionBy("doc_id", "text_hash").orderBy(F.xxhash64(*(F.col(f"own.`{c}`") for c in docs.columns)))
    kept = rows.join(least, ["doc_id", "text_hash"], "left_semi").withColumn("nth", F.row_number().over(same)).where("nth = 1").select("own.*")
    wordless = F.coalesce(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), F.lit("")) == ""
    return kept.unionByName(docs.where(F.col("doc_id").isNull() | wordless))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: documents repeated, kept, cut to their chosen blocks or left out. A null source is a source; null and empty
    texts have no words and stay or go without changing any share; repeated rows are documents each for itself; no documents: none. n_chars follows."""
    mixed = op02_mixing.mix(docs)
    return mixed.selectExpr(*("cast(char_length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens. Null and empty texts are one piece of the end id; repeated rows, also of
    null or equal ids, are packed each by itself; equal lengths are placed in the same way in every run; no documents: none. Extra columns are dropped."""
    return op04_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
