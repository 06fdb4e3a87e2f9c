"""Documents from files and tables, and the results to files. Any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "table")


def read_files(spark: SparkSession, path: str, pattern: str = "*.{txt,json}") -> DataFrame:
    """file_name, doc_id and text: every matching file of a folder (not below it) as one document; none makes an empty table."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as one document, whatever its name."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))


def read_records(spark: SparkSession, path: str, source: str = "parquet", text: str = "text", key: str | None = "doc_id", schema: str | None = None) -> DataFrame:
    """doc_id and text from a table of records; without a key column a document is known by the digest of its text."""
    if source not in FORMATS:
        raise ValueError(f"unknown format {source}")
    if source == "table":
        df = spark.table(path)
    else:
        reader = spark.read.schema(schema) if schema else spark.read
        df = (reader.option("header", True).option("multiLine", True).option("escape", '"') if source == "csv" else reader).format(source).load(path)
    return df.select((F.col(key) if key else F.sha2(F.col(text), 256)).alias("doc_id"), F.col(text).cast("string").alias("text"))


def write_masked(df: DataFrame, path: str, key: str = "file_name", mode: str = "errorifexists") -> None:
    """The masked texts as Parquet, each under the name of its input."""
    df.select(key, "masked_text").write.mode(mode).parquet(path)


def write_masked_files(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One text file an input, in a folder of its name, none where a scan failed; for small numbers of files only."""
    df.where("masked_text IS NOT NULL").select("file_name", F.col("masked_text").alias("value")).write.mode(mode).partitionBy("file_name").option("lineSep", "\u0000").text(path)


def write_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The whole nested results as JSON lines."""
    df.write.mode(mode).json(path)
