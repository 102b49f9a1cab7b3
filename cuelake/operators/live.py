"""Live transcription: the chunks of a job one after another, each answer judged at once and put into the next prompt."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ASR_TAG, REPETITION
from ..params import FilterParams
from ..sources.board import RunBoard
from .transcripts import DUPLICATE, REPEATED, STOPPED, asked, recovered_context

#: A model call: the chunk's prompt and its payload (audio, or whatever the column holds) in, the raw answer out; it raises on failure.
LiveCall = Callable[[str, Any], str]
#: Error of the chunks of a job that was given up.
ABORTED = "aborted"

# The comparison form's trailing characters, as in ``functions.text``; Python's \s is Unicode white space.
_TRAILING = re.compile(r"[\s.,!?~…、。！？]+\Z")
_LOOP = re.compile(REPETITION)


@dataclass(frozen=True)
class LiveParams:
    filters: FilterParams = FilterParams()
    retries: int = 1
    wait_sec: float = 0.0  # before a retry
    provider: str = "local"  # ``gemini`` names no language, so the configured one holds and the whole answer is text
    language: str = "auto"
    tasks: int | None = None  # jobs that are asked at the same time; None: as many as the session's shuffle partitions
    rows: int = 64  # answers that are handed on at once


def answer_parts(raw: str, p: LiveParams) -> tuple[str, str]:
    """(language, text) of an answer, as ``provider_answer``."""
    head, tag, rest = raw.partition(ASR_TAG)
    if p.provider == "gemini":
        return p.language, raw.strip()
    return (head.replace("language", "").strip(), rest.strip()) if tag else ("?", raw.strip())


def compared(text: str) -> str:
    """``dedup_form`` of a text."""
    return _TRAILING.sub("", " ".join(text.split())).lower().replace("ß", "ss")


@dataclass
class JobState:
    """What a job carries from one chunk to the next."""

    context: str = ""
    failures: int = 0
    told: dict[str, int] = field(default_factory=dict)

    def take(self, status: str | None, template: str | None, payload: Any, call: LiveCall, p: LiveParams, stop: Callable[[], bool] | None) -> tuple:
        """One chunk: (status, language, text, flags, context, error, attempts, elapsed_ms)."""
        given = self.context
        if self.failures >= p.filters.max_failures:
            return status, None, None, [], given, ABORTED, 0, 0.0
        prompt = (template or "").replace("{{context}}", given)
        tries = iter(range(p.retries + 1))

        def ask(request: str) -> str:
            if next(tries, 0) and p.wait_sec:
                time.sleep(p.wait_sec)
            return call(request, payload)

        ok, raw, error, attempts, took = asked(prompt, ask, p.retries, stop)
        if not ok and error == STOPPED:
            return status, None, None, [], given, STOPPED, attempts, took
        if not ok:
            self.failures += 1
            return "failed", None, None, [], given, error, attempts, took
        self.failures = 0
        language, text = answer_parts(raw, p)
        if p.filters.dedup_repeated and text and given.strip() and compared(text) == compared(given):
            return "transcribed", language, "", [DUPLICATE], given, None, attempts, took
        looped = _LOOP.search(text) is not None
        if looped and p.filters.strip_repetition:
            return "transcribed", language, "", [REPEATED], given, None, attempts, took
        self.context = text
        return "transcribed", language, text, [REPEATED] if looped else [], given, None, attempts, took


_TOLD = ["status", "language", "text", "flags", "context", "error", "attempts", "elapsed_ms"]
_KINDS = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.float64()]


def transcribe_live(chunks: DataFrame, call: LiveCall, params: LiveParams = LiveParams(), board: RunBoard | None = None) -> DataFrame:
    """Asks the model for every chunk of ``chunks(job_id, chunk_id, status, text, template, payload)`` that is not transcribed yet, in the order of
    ids: job_id, chunk_id, status, language, text, flags, context, error, attempts, elapsed_ms (of the last attempt).

    ``template`` is the prompt with ``{{context}}`` left open (``template_prompt`` fills the rest); it gets the job's last genuine text:
    '' at first, or the text of the last transcribed chunk where a run goes on, even if that one lies later. Failed chunks, echoes and (if asked)
    repetitions leave it as it is, and echoes and repetitions are blanked as ``suppress_echoes`` does. After ``max_failures`` chunks in a row
    that failed (each asked ``retries`` times more) the job is given up: its other chunks keep their status and come back with 0 attempts and
    error ``aborted``. Once ``board`` is stopped, all chunks left come back so with error ``stopped``; what was answered stays in the result. The board also
    holds counts (asked, ok, failed, skipped, elapsed_ms) while tasks run.

    Jobs run beside each other, the chunks of one job one after another. Rows are dealt by job, sorted, and streamed; a task holds one
    Arrow batch and one job's context. A job is never split over tasks, since each prompt needs the answer before. Write the result
    before using it twice, or the model is called again; ``with_results`` puts it into the chunks. Null ids count as one job, null
    templates as ''. Of the columns of ``chunks`` only the six are read.
    """
    p, spark = params, chunks.sparkSession
    tasks = p.tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo = chunks.where((F.col("status") != "transcribed") | F.col("status").isNull())
    rows = todo.select("job_id", F.lit(1).alias("turn"), F.col("chunk_id").cast("long").alias("chunk_id"), "status", F.lit(None).cast("string").alias("seed"), "template", "payload")
    seeds = recovered_context(chunks)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    seeds = seeds.select("job_id", F.lit(0).alias("turn"), none("chunk_id"), none("status"), F.col("context").alias("seed"), none("template"), none("payload"))
    # A job's seed comes before its chunks; the number of tasks is fixed, so that no small ones are merged into one slow one.
    ordered = seeds.union(rows).repartition(tasks, "job_id").sortWithinPartitions("job_id", "turn", "chunk_id")

    def told(jobs: pa.Array, ids: pa.Array, at: list[int], out: list[tuple]) -> pa.RecordBatch:
        where = pa.array(at, pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([jobs.take(where), ids.take(where), *columns], ["job_id", "chunk_id", *_TOLD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, state, stop = None, None, board.stopped if board else None
        for batch in batches:
            jobs, ids = batch.column("job_id"), batch.column("chunk_id")
            at, out = [], []
            for i in range(batch.num_rows):
                own = jobs[i].as_py()
                if state is None or own != job:
                    job, state = own, JobState()
                if batch.column("turn")[i].as_py() == 0:
                    state.context = (batch.column("seed")[i].as_py() or "").strip()
                    continue
                row = state.take(batch.column("status")[i].as_py(), batch.column("template")[i].as_py(), batch.column("payload")[i].as_py(), call, p, stop)
                at.append(i)
                out.append(row)
                if board:
                    tried, ok = row[6] > 0, row[0] == "transcribed"
                    board.tell(asked=int(tried), ok=int(ok), failed=int(tried and not ok), skipped=int(not tried), elapsed_ms=row[7] if ok else 0)
                if len(out) >= p.rows:
                    yield told(jobs, ids, at, out)
                    at, out = [], []
            if out:
                yield told(jobs, ids, at, out)
        if board and state is not None:
            board.tell(last=True)

    return ordered.mapInArrow(run, f"job_id {kinds['job_id']}, chunk_id long, status string, language string, text string, flags array<string>, context string, error string, attempts int, elapsed_ms double")


def with_results(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """``chunks`` with status and text of a run's results, for the next run; chunks that were not asked stay as they are."""
    new = results.where("attempts > 0").select("job_id", "chunk_id", F.col("status").alias("_status"), F.col("text").alias("_text"))
    rows = chunks.join(new, ["job_id", "chunk_id"], "left")
    status, text = F.coalesce("_status", "status"), F.when(F.col("_status") == "transcribed", F.col("_text")).otherwise(F.col("text"))
    return rows.select(*[status.alias(c) if c == "status" else text.alias(c) if c == "text" else F.col(c) for c in chunks.columns])
