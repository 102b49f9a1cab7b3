"""Queries of the streaming forms: the given rows, run through a stream to its end, and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..streaming import stateful as J
from . import views as V
from .folders import shared_folder
from .registry import query
from .scalar_queries import dedup_sql
from .streams import rocksdb, run_to_end
from .transcript_queries import _LIVE, srt_sql
from .views import with_views


def _results(spark: SparkSession, sf: str, folder: str, changed: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Timed lines (changed before they are written) as result files, and a stream over them."""
    rows = changed(V.timed_lines(spark, sf).withColumn("attempt", F.lit(1)))
    rows.write.parquet(f"{folder}/in")
    return J.result_stream(spark, f"{folder}/in", rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


_ECHOES = """, f AS (SELECT job_id, chunk_id, status, said, CASE WHEN status <> 'failed' THEN {form} END AS form FROM {rows})
SELECT job_id, chunk_id, status, CASE WHEN status <> 'failed' AND form <> '' AND form = last_value(form IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN '' ELSE said END AS text FROM f"""


@query("j2_stateful_echo_filter", with_views("timed", _ECHOES.format(form=dedup_sql("said"), rows="(SELECT *, first_value(text) OVER (PARTITION BY job_id, chunk_id // 3 ORDER BY chunk_id) || repeat('.', (chunk_id % 3)::INTEGER) AS said FROM timed)")))
def j2(spark: SparkSession, sf: str) -> DataFrame:
    """Each three neighbours say the same whole line, so all but the first are echoes; chunks arrive in any order."""
    folder = shared_folder(spark)
    line = F.first("text").over(Window.partitionBy("job_id", F.floor(F.col("chunk_id") / 3)).orderBy("chunk_id"))
    said = lambda rows: rows.withColumn("text", F.concat(line, F.repeat(F.lit("."), (F.col("chunk_id") % 3).cast("int"))))
    with rocksdb(spark):
        return run_to_end(J.filter_echoes(_results(spark, sf, folder, said)), folder).select("job_id", "chunk_id", "status", "text")


@query("j2_stateful_echo_filter_whole", with_views("timed", _ECHOES.format(form=dedup_sql("said"), rows="(SELECT *, text AS said FROM timed)")))
def j2_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the lines as they are."""
    folder = shared_folder(spark)
    with rocksdb(spark):
        return run_to_end(J.filter_echoes(_results(spark, sf, folder)), folder).select("job_id", "chunk_id", "status", "text")


@query("j2_late_retries", with_views("timed", "SELECT job_id, chunk_id, 'transcribed' AS status, md5(text) AS text, FALSE AS late FROM timed WHERE status <> 'failed' UNION ALL SELECT job_id, chunk_id, 'failed', md5(''), FALSE FROM timed WHERE status = 'failed' UNION ALL SELECT job_id, chunk_id, 'transcribed', md5('again' || chunk_id), TRUE FROM timed WHERE status = 'failed'"))
def j2_late(spark: SparkSession, sf: str) -> DataFrame:
    """Every failed chunk succeeds in a second file; each text carries its chunk's number, so none is an echo."""
    folder = shared_folder(spark)
    rows = V.timed_lines(spark, sf).select("job_id", "chunk_id", F.when(F.col("status") == "failed", "failed").otherwise("transcribed").alias("status"), F.col("text").alias("own"))
    first = rows.select("job_id", "chunk_id", "status", F.when(F.col("status") != "failed", F.concat(F.col("chunk_id").cast("string"), F.lit("|"), "own")).alias("text"))
    first.write.parquet(f"{folder}/in")
    schema = "job_id long, chunk_id long, status string, text string"
    with rocksdb(spark):
        run_to_end(J.filter_echoes(J.result_stream(spark, f"{folder}/in", schema)), folder)
        again = rows.where("status = 'failed'").select("job_id", "chunk_id", F.lit("transcribed").alias("status"), F.concat(F.lit("again"), F.col("chunk_id").cast("string")).alias("text"))
        again.write.mode("append").parquet(f"{folder}/in")
        out = run_to_end(J.filter_echoes(J.result_stream(spark, f"{folder}/in", schema)), folder)
    text = F.when(F.col("late") | (F.col("status") == "failed"), F.col("text")).otherwise(F.regexp_replace("text", r"(?s)^\d+\|", ""))
    return out.select("job_id", "chunk_id", "status", F.md5(text).alias("text"), "late")


@query("j3_rerender", with_views("timed", f"{_LIVE} {srt_sql('live')}"))
def j3(spark: SparkSession, sf: str) -> DataFrame:
    """Captions rendered batch by batch, the last one of each job."""
    folder = shared_folder(spark)
    stream = _results(spark, sf, folder).withColumn("text", collapse(F.col("text")))

    def publish(captions: DataFrame, batch_id: int) -> None:
        captions.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/captions")

    q = stream.writeStream.foreachBatch(J.rerender(f"{folder}/attempts", publish)).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/captions").groupBy("doc_id").agg(F.md5(F.max_by("text", "batch")).alias("text"))


@query("j4_checkpointed_resume", with_views("timed", "SELECT job_id, chunk_id, status FROM timed"))
def j4(spark: SparkSession, sf: str) -> DataFrame:
    """A stream stopped after all files and started again reads none twice."""
    folder = shared_folder(spark)
    stream = _results(spark, sf, folder).select("job_id", "chunk_id", "status")
    run_to_end(stream, folder)
    return run_to_end(stream, folder)


@query("j5_running_progress", with_views("timed", "SELECT job_id, count(*) AS attempted, count_if(status = 'transcribed') AS transcribed, round(avg(CASE WHEN status = 'transcribed' THEN elapsed_ms END), 6) AS mean_ms FROM timed WHERE status <> 'vad_extracted' GROUP BY job_id"))
def j5(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark)
    progress = J.running_progress(_results(spark, sf, folder).where("status <> 'vad_extracted'"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{folder}/progress")

    q = progress.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{folder}/progress").groupBy("job_id").agg(F.max_by(F.struct("attempted", "transcribed", "mean_ms"), "batch").alias("p"))
    return out.select("job_id", "p.attempted", "p.transcribed", F.round("p.mean_ms", 6).alias("mean_ms"))
