"""Transcription jobs: work selection, model maps, hallucination filters, context, failures, resume."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import collapse, dedup_form, repetition, strip
from ..params import FilterParams
from ..sources.board import RunBoard
from .folds import ordered_fold

DUPLICATE, REPEATED = "possible_duplicate_hallucination", "possible_infinite_repetition"


def by_chunk() -> WindowSpec:
    return Window.partitionBy("job_id").orderBy("chunk_id")


def before() -> WindowSpec:
    return by_chunk().rowsBetween(Window.unboundedPreceding, -1)


def work_items(chunks: DataFrame, force: bool = False) -> DataFrame:
    """Chunks still to transcribe, or all."""
    return chunks.where(F.lit(force) | (F.col("status") != "transcribed") | F.col("status").isNull())


def correctable(chunks: DataFrame) -> DataFrame:
    """Transcribed chunks with text."""
    return chunks.where((F.col("status") == "transcribed") & (collapse(F.col("text")) != ""))


def collect_entries(chunks: DataFrame) -> DataFrame:
    """Transcribed chunks with their text collapsed; blank ones are left out."""
    return chunks.where("status = 'transcribed'").withColumn("text", collapse(F.coalesce("text", F.lit("")))).where("text <> ''")


def entry_counts(chunks: DataFrame) -> DataFrame:
    """Per job: entries, chunks not transcribed (of whatever status), transcribed but empty."""
    done, text = F.col("status") == "transcribed", collapse(F.coalesce("text", F.lit(""))) != ""
    return chunks.groupBy("job_id").agg(F.count_if(done & text).alias("n_entries"), F.count_if(~done).alias("n_failed"), F.count_if(done & ~text).alias("n_empty"))


def chunk_failures(chunks: DataFrame, rate: int = 16_000, tolerance_sec: float = 1e-3) -> DataFrame:
    """``chunks(job_id, chunk_id, start_sample, end_sample, duration_sec)`` whose written length is unknown or not that of their samples."""
    expected = (F.col("end_sample") - F.col("start_sample")) / rate
    good = F.abs(F.col("duration_sec") - expected) < tolerance_sec
    return chunks.where(~F.coalesce(good, F.lit(False))).withColumn("failures", F.array(F.lit("chunk duration differs from its samples")))


def quality_failures(meta: DataFrame, tolerance_sec: float = 0.1) -> DataFrame:
    """``meta(job_id, rate, channels, duration_sec, source_duration_sec)`` rows that break a rule of extracted audio, with all messages; unknown values break it too."""
    broken = lambda good, message: F.when(~F.coalesce(good, F.lit(False)), message)
    rules = [
        broken(F.col("rate") == 16000, "sample rate is not 16000"),
        broken(F.col("channels") == 1, "not mono"),
        broken(F.abs(F.col("duration_sec") - F.col("source_duration_sec")) <= tolerance_sec, "duration differs from the source"),
    ]
    return meta.withColumn("failures", F.array_compact(F.array(*rules))).where(F.size("failures") > 0)


def overlay_params(jobs: DataFrame, overrides: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Job parameters: overrides over defaults; a negative ``max_absorb_gap`` (no limit) becomes null."""
    out = jobs.join(overrides, "job_id", "left")
    out = out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})
    return out.withColumn("max_absorb_gap", F.when(F.col("max_absorb_gap") >= 0, F.col("max_absorb_gap")))


def drop_overlaps(entries: DataFrame) -> DataFrame:
    """Drops entries that start before the end of the last one kept (millisecond columns).

    Dropped entries don't move that end, so the rule is a fold; it sees ids and times only, and only those of
    jobs where some entry starts before the latest end so far.
    """
    latest = F.max("end_ms").over(before())
    marked = entries.withColumn("_over", F.coalesce((F.col("start_ms") < latest).cast("int"), F.lit(0)))
    marked = marked.withColumn("late", F.max("_over").over(Window.partitionBy("job_id"))).drop("_over")
    clean = marked.where("late = 0").drop("late")
    late = marked.where("late = 1").select("job_id", F.col("chunk_id").cast("long").alias("chunk_id"), "start_ms", "end_ms")

    def step(end: int | None, start: int, stop: int) -> tuple[int, int]:
        return (stop, 1) if end is None or start >= end else (end, 0)

    kept = ordered_fold(late, "job_id", "chunk_id", ["start_ms", "end_ms"], "kept", step).where("kept = 1")
    return clean.unionByName(marked.where("late = 1").drop("late").join(kept, ["job_id", "chunk_id"], "left_semi").select(*clean.columns))


# --- model map -------------------------------------------------------------------------------------

#: A model call: a request's text in, its raw answer out; it raises on failure.
ModelCall = Callable[[str], str]


#: What is told of each call.
CALLED = "ok boolean, raw string, error string, attempts int, elapsed_ms double"
#: Error of rows that were not asked for any more.
STOPPED = "stopped"


def asked(request: str, call: ModelCall, retries: int, stop: Callable[[], bool] | None = None) -> tuple:
    """(ok, raw, error, attempts, elapsed_ms of the last attempt) of one request."""
    raw, error, tries, took = None, None, 0, 0.0
    while tries <= retries and raw is None:
        if stop is not None and stop():
            return False, None, error or STOPPED, tries, took
        tries += 1
        begun = time.perf_counter()
        try:
            raw = call(request)
            error = "no answer" if raw is None else None
        except Exception as e:  # noqa: BLE001  whatever a model raises is that row's failure
            error = str(e) or type(e).__name__
        took = 1000 * (time.perf_counter() - begun)
    return raw is not None, raw, None if raw is not None else error, tries, took


def asked_on(board: RunBoard | None, request: str, call: ModelCall, retries: int) -> tuple:
    """``asked`` as a run's board says, which is told of it."""
    out = asked(request, call, retries, board.stopped if board else None)
    if board:
        ok, tried = out[0], out[3] > 0
        board.tell(asked=int(tried), ok=int(ok), failed=int(tried and not ok), skipped=int(not tried), elapsed_ms=out[4] if ok else 0)
    return out


def model_map(requests: DataFrame, key_columns: list[str], call: ModelCall, retries: int = 1, board: RunBoard | None = None) -> DataFrame:
    """Calls the injected model on ``requests(keys, request)``: keys, ok, raw, error, attempts, elapsed_ms (of the last attempt).

    One bad row never fails a task: after ``retries`` further attempts it comes back with ok = false; an answer of None is a failure. Once ``board`` is
    stopped (by the driver, while tasks run), the rows left come back with ok = false, error ``stopped`` and 0 attempts, the answers so
    far stay in the result, and a later run can take up the rest. The board holds counts while tasks run. Write the result before using it twice, or
    the model is called again.
    """
    kinds = ", ".join(f"{k} {requests.schema[k].dataType.simpleString()}" for k in key_columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [asked_on(board, r, call, retries) for r in pdf["request"]]
            yield pd.concat([pdf[key_columns].reset_index(drop=True), pd.DataFrame(out, columns=["ok", "raw", "error", "attempts", "elapsed_ms"])], axis=1)
        if board:
            board.tell(last=True)

    return requests.select(*key_columns, "request").mapInPandas(run, f"{kinds}, {CALLED}")


def observed(results: DataFrame, name: str = "model calls") -> tuple[DataFrame, Observation]:
    """``results`` of a model map, and an observation that holds its progress once an action has run: asked, ok, failed, stopped, mean_ms."""
    seen, ok = Observation(name), F.coalesce("ok", F.lit(False))
    stopped = ~ok & (F.col("error") == STOPPED)
    mean = F.avg(F.when(ok, F.col("elapsed_ms")))
    return results.observe(seen, F.count_if(F.col("attempts") > 0).alias("asked"), F.count_if(ok).alias("ok"), F.count_if(~ok & ~stopped).alias("failed"), F.count_if(stopped).alias("stopped"), mean.alias("mean_ms")), seen


# --- filters on completed results --------------------------------------------------------------------


def suppress_echoes(chunks: DataFrame, p: FilterParams = FilterParams()) -> DataFrame:
    """``chunks(job_id, chunk_id, status, text)`` with echoes and (if asked) repetitions blanked: adds flags, context; replaces text.

    An echo equals the last genuine text of its job. A suppressed echo has the form of what it echoes, so
    the last chunk that neither failed nor was blanked for repetition can stand for the genuine one, and
    a window does. ``context`` is the last genuine text before a chunk, '' at first.
    """
    text, failed = F.coalesce("text", F.lit("")), F.col("status") == "failed"
    rows = chunks.withColumns({"_form": dedup_form(text), "_blank": strip(text) == "", "_unit": repetition(text)})
    stripped = F.col("_unit").isNotNull() & F.lit(p.strip_repetition)
    last = F.last(F.when(~failed & ~stripped, F.struct("_form", "_blank")), ignorenulls=True).over(before())
    rows = rows.withColumn("_last", last)
    echo = F.lit(p.dedup_repeated) & ~failed & ~F.col("_blank") & F.coalesce(~F.col("_last._blank") & (F.col("_form") == F.col("_last._form")), F.lit(False))
    rows = rows.withColumn("_echo", echo)
    repeated = ~failed & ~F.col("_echo") & F.col("_unit").isNotNull()
    genuine = F.when(~failed & ~F.col("_echo") & ~(repeated & F.lit(p.strip_repetition)), text)
    flags = F.array_compact(F.array(F.when(F.col("_echo"), DUPLICATE), F.when(repeated, REPEATED)))
    rows = rows.withColumns({"flags": flags, "context": F.coalesce(F.last(genuine, ignorenulls=True).over(before()), F.lit("")), "text": F.when(F.col("_echo") | (repeated & F.lit(p.strip_repetition)), "").otherwise(text)})
    return rows.drop("_form", "_blank", "_unit", "_last", "_echo")


def aborted_jobs(chunks: DataFrame, p: FilterParams = FilterParams()) -> DataFrame:
    """Jobs with ``max_failures`` failed chunks in a row: job_id, longest_run."""
    # chunk ids may have holes, so runs are counted by place among all chunks
    placed = chunks.select("job_id", "chunk_id", "status", F.row_number().over(by_chunk()).alias("place")).where("status = 'failed'")
    island = F.col("place") - F.row_number().over(by_chunk())
    runs = placed.withColumn("island", island).groupBy("job_id", "island").agg(F.count("*").alias("run"))
    return runs.groupBy("job_id").agg(F.max("run").alias("longest_run")).where(F.col("longest_run") >= p.max_failures)


def progress(chunks: DataFrame) -> DataFrame:
    """Per job: total, transcribed, attempted (failed too), and the seconds left by the mean of transcribed chunks (null before the first)."""
    done = F.col("status") == "transcribed"
    sums = chunks.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(done).alias("transcribed"), F.count_if(done | (F.col("status") == "failed")).alias("attempted"), F.avg(F.when(done, F.col("elapsed_ms"))).alias("mean_ms"))
    return sums.withColumn("eta_sec", F.col("mean_ms") * (F.col("total") - F.col("attempted")) / 1000).drop("mean_ms")


def run_summary(chunks: DataFrame) -> DataFrame:
    """Per job: transcribed, failed, flagged."""
    return chunks.groupBy("job_id").agg(F.count_if(F.col("status") == "transcribed").alias("n_transcribed"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.size("flags") > 0).alias("n_flagged"))


def flagged_rate(chunks: DataFrame) -> DataFrame:
    """Per job: share of chunks with a flag."""
    return chunks.groupBy("job_id").agg(F.avg((F.size("flags") > 0).cast("int")).alias("flagged_rate"))


# --- resume ------------------------------------------------------------------------------------------


def carry_prior(chunks: DataFrame, texts: DataFrame, prior: DataFrame, mode: str = "offset") -> DataFrame:
    """New ``chunks`` with the status and metadata of a prior run.

    A chunk counts as transcribed if a non-blank text of its id exists (a raw one, where ``texts`` has kinds); in mode ``offset`` its times must also
    equal a prior chunk's. Language and elapsed time come from the prior chunk with equal times.
    """
    if mode not in ("offset", "reference"):
        raise ValueError(mode)
    raw = texts.where("kind = 'raw'") if "kind" in texts.columns else texts
    have = raw.where(strip(F.col("text")) != "").select("job_id", "chunk_id", F.lit(True).alias("_text")).distinct()
    told = F.struct(*[c for c in ("chunk_id", "language", "elapsed_ms") if c in prior.columns])  # of prior chunks with equal times, the least id
    old = prior.groupBy("job_id", "start_ms", "end_ms").agg(F.min(told).alias("o")).select("job_id", "start_ms", "end_ms", F.col("o.language").alias("_language"), F.col("o.elapsed_ms").alias("_elapsed"), F.lit(True).alias("_old"))
    rows = chunks.join(have, ["job_id", "chunk_id"], "left").join(old, ["job_id", "start_ms", "end_ms"], "left")
    text, same = F.coalesce("_text", F.lit(False)), F.coalesce("_old", F.lit(False))
    restored = text & same if mode == "offset" else text
    return rows.select(*[c for c in chunks.columns if c != "status"], F.when(restored, "transcribed").otherwise(F.col("status")).alias("status"), F.when(text & same, F.col("_language")).alias("language"), F.when(text & same, F.col("_elapsed")).alias("elapsed_ms"))


def unfinished(catalog: DataFrame, manifests: DataFrame) -> DataFrame:
    """Catalogued jobs without a manifest."""
    return catalog.join(manifests.select("job_id"), "job_id", "left_anti")


def without_kind(chunks: DataFrame, texts: DataFrame, kind: str = "fixed") -> DataFrame:
    """Chunks that have no text of the kind yet."""
    return chunks.join(texts.where(F.col("kind") == kind).select("job_id", "chunk_id"), ["job_id", "chunk_id"], "left_anti")


def cleanup_eligible(chunks: DataFrame) -> DataFrame:
    """Finished jobs without a failed chunk; nothing is deleted."""
    return chunks.groupBy("job_id").agg(F.count_if(F.col("status") != "transcribed").alias("left")).where("left = 0").select("job_id")


def recovered_context(chunks: DataFrame) -> DataFrame:
    """Per job: the text of its last transcribed chunk, to go on from."""
    return chunks.where("status = 'transcribed'").groupBy("job_id").agg(F.max_by("text", "chunk_id").alias("context"))
