"""Chunk texts and versioned outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse
from .versions import read_versions, write_version


def read_chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``<job>/chunks/chunk_NNNN(.fixed).txt`` files as (job_id, chunk_id, kind, text)."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "chunk_*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    name = r"([^/]+)/(?:chunks/)?chunk_(\d+)(\.fixed)?\.txt$"
    g = lambda i: F.regexp_extract("path", name, i)
    return files.select(g(1).alias("job_id"), g(2).cast("int").alias("chunk_id"), F.when(g(3) == "", "raw").otherwise("fixed").alias("kind"), F.col("value").alias("text"))


def with_text(chunks: DataFrame, texts: DataFrame, kind: str = "raw") -> DataFrame:
    """Chunks with their text of a kind, white space collapsed; '' where there is none."""
    own = texts.where(F.col("kind") == kind).select("job_id", "chunk_id", F.col("text").alias("_text"))
    return chunks.drop("text").join(own, ["job_id", "chunk_id"], "left").withColumn("text", F.coalesce(collapse(F.col("_text")), F.lit(""))).drop("_text")


def write_chunk_texts(texts: DataFrame, path: str, name: str | None = None) -> int:
    """Texts of one run, whatever jobs and kinds it holds, as the next version, which is returned; a run of the same ``name`` is replaced."""
    return write_version(texts.select("job_id", "chunk_id", "kind", "text"), path, ["kind"], name)


def latest_chunk_texts(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, chunk_id, kind, text): the newest committed version of each."""
    return read_versions(spark, path).groupBy("job_id", "chunk_id", "kind").agg(F.max_by("text", "version").alias("text"))


def write_stage(captions: DataFrame, path: str, stage: str, name: str | None = None) -> int:
    """Caption texts of a stage (raw, corrected, translated, postprocessed) as the next version, which is returned; earlier ones stay, but for those of the same ``name``."""
    return write_version(captions.select("doc_id", "text", F.lit(stage).alias("stage")), path, ["stage"], name)


def latest_stage(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """The newest version of a stage for each document."""
    rows = read_versions(spark, path).where(F.col("stage") == stage)
    return rows.groupBy("doc_id").agg(F.max_by("text", "version").alias("text"), F.max("version").alias("version"))


def write_by_language(rows: DataFrame, path: str) -> None:
    """Parquet by language; only the languages at hand are overwritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
