"""Queries of sources and sinks: rows derived from the given tables, written to the shared folder and read back."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..sources import catalog as C
from ..sources import manifests as M
from ..sources import texts as X
from . import views as V
from .folders import shared_folder
from .registry import query
from .scalar_queries import PAIRED
from .views import with_views


@query("a1_media_listing", "SELECT DISTINCT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS folder, 'txt' AS suffix, FALSE AS supported, 40 AS key_length FROM documents")
def a1_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the documents' texts, in a folder for each language, listed without being read."""
    folder = shared_folder(spark)
    V.table(spark, sf, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").text(folder)
    files = C.media_catalog(spark, folder).where(F.col("path").endswith(".txt"))
    return files.select(F.regexp_extract("path", r"/lang=([^/]*)/", 1).alias("folder"), "suffix", "supported", F.length("job_id").alias("key_length")).distinct()


@query("a3_manifest_scan", with_views("timed", "SELECT job_id::VARCHAR AS job_id, chunk_id, status, start_ms / 1000.0::DOUBLE AS start_sec, end_ms / 1000.0::DOUBLE AS end_sec FROM timed"))
def a3(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest documents of all jobs, scanned into chunk rows."""
    folder = shared_folder(spark)
    rows = V.timed_lines(spark, sf).select(F.col("job_id").cast("string").alias("job_id"), F.col("chunk_id").cast("int").alias("chunk_id"), "status", (F.col("start_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"))
    jobs = rows.select("job_id").distinct().withColumns({"source_file": F.concat("job_id", F.lit(".wav")), "source_mtime": F.lit("-"), "source_size": F.lit(1).cast("long")})
    M.write_manifests(M.build_manifests(jobs, rows, jobs.limit(0)), folder)
    return M.chunk_rows(M.read_manifests(spark, folder)).select("job_id", F.col("chunk_id").cast("long").alias("chunk_id"), "status", "start_sec", "end_sec")


@query("a6_chunk_text_sink", with_views("timed", "SELECT job_id, chunk_id, 'raw' AS kind, md5(text) AS text FROM timed UNION ALL SELECT job_id, chunk_id, 'fixed', md5('2' || text) FROM timed WHERE chunk_id % 2 = 0"))
def a6(spark: SparkSession, sf: str) -> DataFrame:
    """Raw and corrected texts side by side, by two runs at once; then a run of corrected ones that is repeated, of which the second time counts."""
    folder = shared_folder(spark)
    rows = V.timed_lines(spark, sf).select("job_id", "chunk_id", F.lit("raw").alias("kind"), "text")
    fixed = lambda n: rows.where("chunk_id % 2 = 0").withColumns({"kind": F.lit("fixed"), "text": F.concat(F.lit(n), "text")})
    first = rows.union(fixed("1"))
    with ThreadPoolExecutor(2) as pool:  # at the same time
        list(pool.map(lambda half: X.write_chunk_texts(first.where(f"job_id % 2 = {half}"), folder), (0, 1)))
    X.write_chunk_texts(fixed("3"), folder, "correction")
    X.write_chunk_texts(fixed("2"), folder, "correction")  # the same run again
    return X.latest_chunk_texts(spark, folder).select("job_id", "chunk_id", "kind", F.md5("text").alias("text"))


@query("a10_eval_report", with_views("evals", f"{PAIRED} SELECT sample_id, round(auto_norm, 6) AS auto_norm, round(hinted_norm, 6) AS hinted_norm FROM paired"))
def a10(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark)
    rows = E.paired_cer(V.evals(spark, sf)).select("sample_id", F.round("auto_norm", 6).alias("auto_norm"), F.round("hinted_norm", 6).alias("hinted_norm"))
    X.write_report(rows, folder)
    return spark.read.schema(rows.schema).json(folder)


@query("a11_stage_versions", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN upper_text ELSE text END) AS text, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END AS version FROM (SELECT doc_id, coalesce(text, '') AS text, '2' || coalesce(text, '') AS upper_text FROM documents)")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    """A second version of every other document's captions; the newest of each is read."""
    folder = shared_folder(spark)
    rows = V.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    X.write_stage(rows, folder, "raw")
    X.write_stage(rows.withColumn("text", F.lit("other")), folder, "translated")
    X.write_stage(rows.where("doc_id % 2 = 0").withColumn("text", F.concat(F.lit("2"), "text")), folder, "raw")
    return X.latest_stage(spark, folder, "raw").withColumn("text", F.md5("text"))
