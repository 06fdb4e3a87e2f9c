"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

Quality rules drop what they reject; of each group of near copies one document stays;
documents with benchmark text go; personal data is masked; the rest becomes tokens.
Decisions and spans meet their rows by a number of each row, so rows with a null or a
repeated doc_id are documents like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm import bpe, decontam, neardup, pii, quality
from maskframe.llm.common import scratch, shared_dir, with_keys
from maskframe.llm.queries import table, tokenizer


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, as they are."""
    return quality.keep_good(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    keyed, _ = with_keys(docs)
    kept = neardup.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "doc.text")).where("kept").select(F.col("doc_id").alias("_key"))
    return keyed.join(kept, "_key", "left_semi").select("doc.*")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    keyed, _ = with_keys(docs)
    found = decontam.decontaminate(keyed.select(F.col("_key").alias("doc_id"), "doc.text"), table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(F.col("doc_id").alias("_key"))
    return keyed.join(found, "_key", "left_semi").select("doc.*")


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked by kind."""
    return pii.mask_pii(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.encode_digests(docs, tokenizer())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_clean),
    ("pii", mask),
    ("bpe", encode),
]

#: Encoding and the masks have no equivalent in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        with scratch(spark):  # what a stage stored on its way goes when its result is written
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
