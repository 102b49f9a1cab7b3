"""Corpus views over the given tables, with the same rows in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech probabilities, one recording a user."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), n.cast("long").alias("frame_idx"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("prob"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as chunk transcripts."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("job_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("job_id", (F.col("pos") + 1).cast("long").alias("chunk_id"), "text")


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks over ``lines``: start_ms, end_ms, dur_ms, status, elapsed_ms."""
    rows = lines(spark, sf_dir).withColumns({"dur_ms": F.greatest(F.lit(1000), F.length("text") * 60).cast("long"), "gap_ms": ((F.col("chunk_id") % 4) * 400).cast("long")})
    before = Window.partitionBy("job_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    kind = (F.col("job_id") * 7 + F.col("chunk_id") * 3) % 11
    start = F.coalesce(F.sum(F.col("dur_ms") + F.col("gap_ms")).over(before), F.lit(0))
    return rows.select(
        "job_id", "chunk_id", "text", start.alias("start_ms"), (start + F.col("dur_ms")).alias("end_ms"), "dur_ms",
        F.when(kind == 0, "failed").when(kind == 1, "vad_extracted").otherwise("transcribed").alias("status"), (F.col("dur_ms") % 977).alias("elapsed_ms"),
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as cues: doc_id, cue_idx, start_ms, end_ms, text."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").withColumn("d", 1500 + F.length("text") * (40 + (F.col("conv_id") + F.col("turn")) % 5 * 15))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("d").over(before), F.lit(0))
    return rows.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("cue_idx"), start.cast("long").alias("start_ms"), (start + F.col("d") - 500).cast("long").alias("end_ms"), "text")


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and hypothesis pairs of all turns that have a text."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    sub = lambda a, b: F.replace("text", F.lit(a), F.lit(b))
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), (F.col("conv_id") % 3).alias("lang_id"), F.col("text").alias("ref"), sub("th", "t").alias("hyp_auto"), sub("on", "no").alias("hyp_hinted"))


#: The same views as DuckDB table expressions.
SQL = {
    "frames": "SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, least(value / 100.0, 1.0) AS prob FROM events",
    "lines": "SELECT doc_id AS job_id, generate_subscripts(l, 1) AS chunk_id, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)",
    "timed": """SELECT *, start_ms + dur_ms AS end_ms FROM (SELECT job_id, chunk_id, text, CAST(coalesce(sum(dur_ms + gap_ms) OVER (PARTITION BY job_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms, dur_ms,
      CASE (job_id * 7 + chunk_id * 3) % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'vad_extracted' ELSE 'transcribed' END AS status, dur_ms % 977 AS elapsed_ms
      FROM (SELECT *, greatest(1000, length(text) * 60)::BIGINT AS dur_ms, ((chunk_id % 4) * 400)::BIGINT AS gap_ms FROM lines))""",
    "cues": """SELECT conv_id AS doc_id, turn + 1 AS cue_idx, text, CAST(s AS BIGINT) AS start_ms, CAST(s + d - 500 AS BIGINT) AS end_ms FROM (SELECT *, coalesce(sum(d) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
      FROM (SELECT *, 1500 + length(text) * (40 + (conv_id + turn) % 5 * 15) AS d FROM conversations WHERE text IS NOT NULL))""",
    "evals": "SELECT conv_id * 100 + turn AS sample_id, conv_id % 3 AS lang_id, text AS ref, replace(text, 'th', 't') AS hyp_auto, replace(text, 'on', 'no') AS hyp_hinted FROM conversations WHERE text IS NOT NULL",
}
_NEEDS = {"timed": ("lines",)}


def with_views(names: str, body: str) -> str:
    """``body`` with the named views (space separated) before it; a body may go on with CTEs of its own after a comma."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    recursive = "RECURSIVE " if body.startswith("RECURSIVE") else ""
    return f"WITH {recursive}{head}{body.removeprefix('RECURSIVE')}"
