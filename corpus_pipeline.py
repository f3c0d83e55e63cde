"""The corpus pipeline: quality, line de-duplication, near-duplicates, benchmark decontamination, encoding.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of ``documents``; the last
returns (doc_id, n_pieces, ids, round_trip). ``run`` writes each stage as Parquet into the shared folder and reads it again for the next.
``n_chars``, where ``documents`` has it, follows the text. Stages after the first begin with what the one before left of the executors' heap given back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm import decontaminate, jaccard, line_dedup, quality, sentencepiece, token_counts
from foliolake.llm.common import forget, rested, written

#: Ids that are sent to the documents, at most; beyond it documents and ids are joined by a shuffle.
IDS = 1_000_000


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of documents that are here."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat in others; a document that loses all of them keeps its row, with an empty text."""
    rested(spark)
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each near-duplicate group, once, as the lines that repeat stay in the largest id; rows with a null id stay.

    Of rows that share an id the one with the smallest hash of its text stays."""
    rested(spark)
    found = jaccard.near_duplicates(docs).where("doc_id is not null")
    tied = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id", "component_id")
    heads = tied.groupBy("component_id").agg(F.max("doc_id").alias("last"))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    again = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(False).alias("lost"))
    lost = tied.select("doc_id").unionByName(heads.select(F.col("component_id").alias("doc_id"))).distinct()
    lost = lost.join(heads.select(F.col("last").alias("doc_id")), "doc_id", "left_anti").withColumn("lost", F.lit(True))
    marked = written(lost.unionByName(again).groupBy("doc_id").agg(F.max("lost").alias("__lost")).withColumnRenamed("doc_id", "__id"), "lost")
    # Texts move only where the ids are too many to be sent to them.
    few = marked.limit(IDS + 1).count() <= IDS
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    joined = rows.join(F.broadcast(marked) if few else marked, F.col("id") == F.col("__id"), "left")
    repeated = joined.where(~F.col("__lost")).groupBy("id").agg(F.min_by("row", "hash").alias("row"))
    return joined.where(F.col("__lost").isNull()).select("row").unionByName(repeated.select("row")).select("row.*")


def clean_of_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    rested(spark)
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document left."""
    rested(spark)
    return sentencepiece.encode(docs, token_counts.tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", good),
    ("line_dedup", fresh_lines),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", clean_of_items),
    ("sentencepiece", pieces),
]
#: The classifier's scores and the pieces have no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out = written(out, name)
        forget(docs)
        docs = out
    return docs
