"""Queries of temporal segmentation over the frames and samples views."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segments as S
from ..params import VadParams
from ..streaming.stateful import result_stream, speech_sessions
from . import views as V
from .folders import shared_folder
from .registry import query
from .scalar_queries import sql_clock
from .streams import rocksdb, run_to_end
from .views import with_views

#: Half-second frames; the default parameters suit speech, these suit the view.
VAD = VadParams(threshold=0.5, min_silence=500, min_speech=1000, max_absorb_gap=3000, max_chunk=3000)
FRAME = 500

RAW = f", raw AS (SELECT job_id, min(frame_idx) * {FRAME} AS s, (max(frame_idx) + 1) * {FRAME} AS e FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY job_id ORDER BY frame_idx) AS g FROM frames WHERE prob >= 0.5) GROUP BY job_id, g)"
MERGED = f"{RAW}, merged AS (SELECT job_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s - p > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY s) AS g FROM (SELECT *, lag(e) OVER (PARTITION BY job_id ORDER BY s) AS p FROM raw)) GROUP BY job_id, g)"
ABSORBED = f"""{MERGED}, st AS (
  SELECT job_id, list({{'s': CAST(s AS BIGINT), 'e': CAST(e AS BIGINT)}} ORDER BY s) AS x, 0 AS step FROM merged GROUP BY job_id
  UNION ALL
  SELECT job_id, x[1:least(i,j)-1] || [{{'s': x[least(i,j)].s, 'e': x[greatest(i,j)].e}}] || x[greatest(i,j)+1:], step + 1
  FROM (SELECT st.job_id, st.x, st.step, k.i,
               CASE WHEN k.i = 1 THEN 2 WHEN k.i = len(st.x) THEN k.i - 1
                    WHEN st.x[k.i].s - st.x[k.i-1].e <= st.x[k.i+1].s - st.x[k.i].e THEN k.i - 1 ELSE k.i + 1 END AS j,
               row_number() OVER (PARTITION BY st.job_id ORDER BY st.x[k.i].e - st.x[k.i].s, k.i) AS rn
        FROM st, LATERAL (SELECT unnest(range(1, len(st.x) + 1)) AS i) k
        WHERE len(st.x) > 1 AND st.x[k.i].e - st.x[k.i].s < 1000
          AND least(CASE WHEN k.i > 1 THEN st.x[k.i].s - st.x[k.i-1].e END, CASE WHEN k.i < len(st.x) THEN st.x[k.i+1].s - st.x[k.i].e END) <= 3000)
  WHERE rn = 1),
absorbed AS (SELECT job_id, unnest(x).s AS s, unnest(x).e AS e FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY step DESC) AS r FROM st) WHERE r = 1)"""
SPLIT = "SELECT job_id, s + k * 3000 AS s, least(s + (k + 1) * 3000, e) AS e FROM (SELECT *, unnest(range(0, greatest((e - s + 2999) // 3000, 1))) AS k FROM {})"
FINAL = f"{ABSORBED}, final AS ({SPLIT.format('absorbed')})"
DURATIONS = f", durations AS (SELECT job_id, (max(frame_idx) + 1) * {FRAME} AS d FROM frames GROUP BY job_id)"
_OUT = "job_id, s AS start_ms, e AS end_ms"


def rec(names: str, body: str) -> str:
    return with_views(names, "RECURSIVE" + body)


def durations(frames: DataFrame) -> DataFrame:
    return frames.groupBy("job_id").agg(((F.max("frame_idx") + 1) * FRAME).alias("duration_ms"))


def final(spark: SparkSession, sf: str) -> DataFrame:
    return S.merge_stages(V.frames(spark, sf), VAD, FRAME)["final"]


@query("c3_threshold_islands", with_views("frames", f"{RAW} SELECT {_OUT} FROM raw"))
def c3(spark: SparkSession, sf: str) -> DataFrame:
    return S.threshold_islands(V.frames(spark, sf), 0.5, FRAME)


_SWEEP = "SELECT t AS threshold, job_id, count(*) AS n_segments, sum(f) AS n_frames FROM (SELECT t, job_id, g, count(*) AS f FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY t, job_id ORDER BY frame_idx) AS g FROM frames, (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS t) WHERE prob >= t) GROUP BY ALL) GROUP BY ALL"


@query("c4_threshold_sweep", with_views("frames", f" SELECT threshold, job_id, n_segments, n_frames::BIGINT AS n_frames FROM ({_SWEEP})"))
def c4(spark: SparkSession, sf: str) -> DataFrame:
    found = S.threshold_sweep(V.frames(spark, sf), [0.3, 0.5, 0.7], FRAME)
    return found.groupBy("threshold", "job_id").agg(F.count("*").alias("n_segments"), F.sum(F.floor((F.col("end_ms") - F.col("start_ms")) / FRAME)).alias("n_frames"))


@query("c5_silence_merge", with_views("frames", f"{MERGED} SELECT {_OUT} FROM merged"))
def c5(spark: SparkSession, sf: str) -> DataFrame:
    return S.merge_silences(S.threshold_islands(V.frames(spark, sf), 0.5, FRAME), VAD.min_silence)


@query("c6_short_absorb", rec("frames", f"{ABSORBED} SELECT {_OUT} FROM absorbed"))
def c6(spark: SparkSession, sf: str) -> DataFrame:
    return S.merge_stages(V.frames(spark, sf), VAD, FRAME)["after_short_absorb"]


@query("c7_force_split", with_views("frames", f"{MERGED} {SPLIT.format('merged').replace('AS s,', 'AS start_ms,').replace('AS e FROM', 'AS end_ms FROM')}"))
def c7(spark: SparkSession, sf: str) -> DataFrame:
    return S.force_split(S.merge_silences(S.threshold_islands(V.frames(spark, sf), 0.5, FRAME), VAD.min_silence), 3000)


@query("c8_merge_pipeline", rec("frames", f"{FINAL} SELECT {_OUT} FROM final"))
def c8(spark: SparkSession, sf: str) -> DataFrame:
    return final(spark, sf)


@query("c9_segment_stats", with_views("frames", f"""{RAW}{DURATIONS}, g AS (SELECT *, s - lag(e, 1, 0) OVER (PARTITION BY job_id ORDER BY s) AS gap FROM raw)
SELECT job_id, count(*) AS n_segments, min(e - s) AS min_ms, max(e - s) AS max_ms, round(avg(e - s), 4) AS avg_ms, count_if(e - s < 1000) AS n_short, count(*) + 1 AS n_gaps,
count_if(gap > 0 AND gap <= 1000) + any_value(CASE WHEN d - m > 0 AND d - m <= 1000 THEN 1 ELSE 0 END) AS n_short_gaps FROM (SELECT *, max(e) OVER (PARTITION BY job_id) AS m FROM g) JOIN durations USING (job_id) GROUP BY job_id"""))
def c9(spark: SparkSession, sf: str) -> DataFrame:
    frames = V.frames(spark, sf)
    return S.segment_stats(S.threshold_islands(frames, 0.5, FRAME), durations(frames)).withColumn("avg_ms", F.round("avg_ms", 4))


@query("c10_merge_stats", rec("frames", f"""{FINAL}{DURATIONS}, u AS (SELECT job_id, 'r' AS k, e - s AS l FROM raw UNION ALL SELECT job_id, 'm', e - s FROM merged UNION ALL SELECT job_id, 'a', e - s FROM absorbed UNION ALL SELECT job_id, 'f', e - s FROM final)
SELECT job_id, count_if(k = 'r') AS raw, count_if(k = 'm') AS after_silence_merge, count_if(k = 'a') AS after_short_absorb, count_if(k = 'f') AS final, count_if(k = 'a' AND l > 3000) AS n_force_split, round(count_if(k = 'f') / (any_value(d) / 60000.0::DOUBLE), 6) AS per_minute FROM u JOIN durations USING (job_id) GROUP BY job_id"""))
def c10(spark: SparkSession, sf: str) -> DataFrame:
    frames = V.frames(spark, sf)
    return S.merge_stats(S.merge_stages(frames, VAD, FRAME), durations(frames), VAD.max_chunk).withColumn("per_minute", F.round("per_minute", 6))


CHUNKS = ", chunks AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY s) AS chunk_id, s, e, s * 16 AS a, least(e * 16, (SELECT max(frame_idx) + 1 FROM frames f WHERE f.job_id = final.job_id) * 8000 - 100) AS b FROM final)"


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    frames = V.frames(spark, sf)
    totals = durations(frames).select("job_id", (F.col("duration_ms") * 16 - 100).alias("n_samples"))
    return S.chunk_offsets(S.merge_stages(frames, VAD, FRAME)["final"], totals)


@query("c11_chunk_offsets", rec("frames", f"""{FINAL}{CHUNKS} SELECT job_id, chunk_id, format('chunks/chunk_{{:04d}}.wav', chunk_id) AS file, {sql_clock('s', '.')} AS start, {sql_clock('round_even(b / 16.0::DOUBLE, 0)::BIGINT', '.')} AS "end",
round_even(a / 16000.0::DOUBLE, 3)::DOUBLE AS start_sec, round_even(b / 16000.0::DOUBLE, 3)::DOUBLE AS end_sec, round_even((b - a) / 16000.0::DOUBLE, 3)::DOUBLE AS duration_sec, a AS start_sample, b AS end_sample, 'vad_extracted' AS status FROM chunks"""))
def c11(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_table(spark, sf)


@query("c13_chunk_totals", rec("frames", f"{FINAL} SELECT job_id, count(*) AS n_chunks, sum(e - s)::BIGINT AS total_ms FROM final GROUP BY job_id"))
def c13(spark: SparkSession, sf: str) -> DataFrame:
    return S.chunk_totals(final(spark, sf))


@query("c15_timeline_tiles", rec("frames", f"{FINAL}, t AS (SELECT *, unnest(range(s // 30000, (e + 29999) // 30000)) AS r FROM final) SELECT job_id, s AS start_ms, e AS end_ms, r AS row, r // 10 AS page FROM t"))
def c15(spark: SparkSession, sf: str) -> DataFrame:
    return S.timeline_tiles(final(spark, sf))


@query("c16_review_sample", with_views("timed", "SELECT job_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY md5(concat_ws('|', 'review', job_id, chunk_id)), chunk_id) AS r FROM timed) WHERE r <= 5"))
def c16(spark: SparkSession, sf: str) -> DataFrame:
    return S.review_sample(V.timed_lines(spark, sf).select("job_id", "chunk_id"))


@query("b5_hard_limit", with_views("frames", f"{MERGED} SELECT {_OUT} FROM merged WHERE e - s > 3000"))
def b5(spark: SparkSession, sf: str) -> DataFrame:
    return S.over_limit(S.merge_silences(S.threshold_islands(V.frames(spark, sf), 0.5, FRAME), VAD.min_silence), 3000)


# --- samples -----------------------------------------------------------------------------------------


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as short sample vectors."""
    return V.table(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("job_id"), F.col("embedding").alias("samples"))


_PAD = "list_resize(embedding, ((len(embedding) + 23) // 24 * 24)::BIGINT, 0.0::FLOAT)"


_C1 = f"SELECT vec_id AS job_id, i AS frame_idx, round(list_sum(f), 4) AS total, len(f) AS n, round(f[1], 5) AS first FROM (SELECT vec_id, i, (list_resize([]::FLOAT[], 4, 0.0::FLOAT) || p)[i * 24 + 1:i * 24 + 28]::DOUBLE[] AS f FROM (SELECT vec_id, {_PAD} AS p, unnest(range(0, (len(embedding) + 23) // 24)) AS i FROM embeddings WHERE len(embedding) > 0))"


@query("c1_framing", _C1)
def c1(spark: SparkSession, sf: str) -> DataFrame:
    f = S.framed(samples(spark, sf), 24, 4).withColumn("d", F.transform("frame", lambda x: x.cast("double")))
    return _frame_digest(f)


def _frame_digest(f: DataFrame) -> DataFrame:
    return f.select("job_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("d").cast("long").alias("n"), F.round(F.col("d")[0], 5).alias("first"))


_C2 = """WITH p AS (SELECT vec_id AS job_id, (len(embedding) + 23) // 24 AS n, list_concat(list_concat([0.0, 0.0, 0.0, 0.0]::DOUBLE[], embedding::DOUBLE[]), list_transform(range(0, (len(embedding) + 23) // 24 * 24 - len(embedding)), lambda x: 0.0::DOUBLE)) AS s FROM embeddings WHERE len(embedding) > 0),
r AS (SELECT job_id, n, list_transform(range(0, n), lambda i: sqrt(list_avg(list_transform(s[i * 24 + 1:i * 24 + 28], lambda x: x * x)))) AS rms FROM p)
SELECT job_id, i AS frame_idx, round(least(1.0, list_reduce(rms[1:i + 1], lambda a, b: 0.5 * a + 0.5 * b)), 6) AS prob FROM (SELECT job_id, rms, unnest(range(0, n)) AS i FROM r)"""


@query("c2_frame_scoring", _C2)
def c2(spark: SparkSession, sf: str) -> DataFrame:
    """Frames scored by their energy, smoothed over the job's earlier frames (the scorer's state)."""
    def energy(pdf, last):
        out = []
        for f in pdf["frame"]:
            rms = float(np.sqrt(np.mean(np.square(np.asarray(f, np.float64)))))
            last = rms if last is None else 0.5 * last + 0.5 * rms
            out.append(min(last, 1.0))
        return pd.Series(out), last

    return S.score_frames(S.framed(samples(spark, sf), 24, 4), energy).withColumn("prob", F.round("prob", 6))


def sample_blocks(spark: SparkSession, sf: str, size: int = 16) -> DataFrame:
    """The sample vectors as a table of blocks."""
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size("samples") / size).cast("int") - 1), lambda i: F.slice("samples", i * size + 1, size))
    cut = samples(spark, sf).where(F.size("samples") > 0).select("job_id", F.posexplode(pieces).alias("block_idx", "samples"))
    return cut.withColumn("block_idx", F.col("block_idx").cast("long"))


@query("c1_framing_blocks", _C1)
def c1_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that straddle blocks of 30 samples."""
    f = S.framed_blocks(sample_blocks(spark, sf, 30), 30, 24, 4).withColumn("d", F.transform("frame", lambda x: x.cast("double")))
    return _frame_digest(f)


@query("c12_chunk_slices", "SELECT job_id, chunk_id, round(list_sum(x::DOUBLE[]), 4) AS total, len(x) AS n FROM (SELECT vec_id AS job_id, k AS chunk_id, embedding[k * 20 - 15:least(k * 20 + 10, len(embedding))] AS x FROM (SELECT *, unnest(range(1, 4)) AS k FROM embeddings)) WHERE len(x) > 0")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    k = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("chunk_id")
    chunks = samples(spark, sf).select("job_id", F.size("samples").alias("n"), k).select("job_id", "chunk_id", (F.col("chunk_id") * 20 - 16).alias("start_sample"), F.least(F.col("chunk_id") * 20 + 10, F.col("n")).alias("end_sample"))
    out = S.slice_samples(sample_blocks(spark, sf), chunks.withColumns({"start_sample": F.col("start_sample").cast("long"), "end_sample": F.col("end_sample").cast("long")}), 16)
    return out.select("job_id", "chunk_id", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("samples").cast("long").alias("n"))


_C14 = "SELECT job_id, row, bin, min(x) AS lo, max(x) AS hi FROM (SELECT vec_id AS job_id, (i - 1) // 40 AS row, (i - 1) % 40 // CASE WHEN n > 8 THEN n // 8 ELSE 1 END AS bin, n // CASE WHEN n > 8 THEN n // 8 ELSE 1 END AS bins, x FROM (SELECT vec_id, i, x, least(40, total - (i - 1) // 40 * 40) AS n FROM (SELECT vec_id, len(embedding) AS total, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings))) WHERE bin < bins GROUP BY job_id, row, bin"


@query("c14_envelope", _C14)
def c14(spark: SparkSession, sf: str) -> DataFrame:
    return S.envelope(samples(spark, sf), 40, 8)


@query("c14_envelope_blocks", _C14)
def c14_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return S.envelope_blocks(sample_blocks(spark, sf), 16, 40, 8)


@query("j1_session_merge", with_views("frames", f"{MERGED} SELECT {_OUT} FROM merged"))
def j1(spark: SparkSession, sf: str) -> DataFrame:
    """The session merge as a stream over event files. A last event far ahead moves the watermark past all others, which closes their sessions."""
    folder, raw, schema = _session_events(spark, sf)
    end = raw.agg((F.max("end_ms") + 10**8).alias("start_ms")).select(F.lit(None).cast(raw.schema["job_id"].dataType).alias("job_id"), "start_ms", (F.col("start_ms") + 1).alias("end_ms"))
    _write_events(raw.unionByName(end), folder)
    out = _drain_sessions(spark, folder, schema)
    return out.select("job_id", F.unix_millis("start_ts").alias("start_ms"), F.unix_millis("end_ts").alias("end_ms"))


_LATE = "(job_id * 31 + s // 500) % 4 = 0"
_LATE_SQL = "SELECT job_id, min(s) AS start_ms, max(e) AS end_ms, count(*) AS n, late FROM (SELECT *, sum(CASE WHEN s - p > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, late ORDER BY s) AS g FROM (SELECT *, lag(e) OVER (PARTITION BY job_id, late ORDER BY s) AS p FROM parts)) GROUP BY job_id, late, g"


@query("j1_late_events", with_views("frames", f"{RAW}, parts AS (SELECT job_id, s, e, {_LATE} AS late FROM raw) {_LATE_SQL}"))
def j1_late(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter of the events comes in a second file, when the watermark is past all of them: none is lost, and their sessions are told as late."""
    folder, raw, schema = _session_events(spark, sf)
    late = F.expr(_LATE.replace("s //", "start_ms div").replace("// 500", "500"))
    end = raw.agg((F.max("end_ms") + 10**8).alias("start_ms")).select(F.lit(None).cast(raw.schema["job_id"].dataType).alias("job_id"), "start_ms", (F.col("start_ms") + 1).alias("end_ms"))
    _write_events(raw.where(~late).unionByName(end), folder)
    _drain_sessions(spark, folder, schema)
    _write_events(raw.where(late), folder)
    out = _drain_sessions(spark, folder, schema)
    return out.select("job_id", F.unix_millis("start_ts").alias("start_ms"), F.unix_millis("end_ts").alias("end_ms"), "n", "late")


def _session_events(spark: SparkSession, sf: str) -> tuple[str, DataFrame, str]:
    raw = S.threshold_islands(V.frames(spark, sf), 0.5, FRAME).select("job_id", "start_ms", "end_ms")
    return shared_folder(spark), raw, f"job_id {raw.schema['job_id'].dataType.simpleString()}, ts timestamp, end_ts timestamp"


def _write_events(rows: DataFrame, folder: str) -> None:
    rows.select("job_id", F.timestamp_millis("start_ms").alias("ts"), F.timestamp_millis("end_ms").alias("end_ts")).write.mode("append").parquet(f"{folder}/in")


def _drain_sessions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    with rocksdb(spark):
        return run_to_end(speech_sessions(result_stream(spark, f"{folder}/in", schema), 500, "1 hour"), folder).where("job_id is not null")


