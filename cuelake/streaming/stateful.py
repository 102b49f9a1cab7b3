"""Streaming forms of segmentation, echo filter, captions and progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.text import dedup_form
from ..operators.captions import live_captions, render_srt


def _clocked(stream: DataFrame, clock: str, delay: str) -> DataFrame:
    """``stream`` with a watermark on ``clock``, whose late rows no operator drops.

    Spark knows a late row by the mark that the watermark leaves on its column. The column is computed anew after it, so the watermark still
    moves and fires timers, and a stateful operator sees all rows.
    """
    return stream.withWatermark(clock, delay).withColumn(clock, F.expr(f"`{clock}` + interval 0 seconds"))


def _all_known(*columns: Column) -> Column:
    """Whether no column is null, as one expression: Spark would take a condition on the job alone below the watermark, and its rows would no longer move it."""
    return F.size(F.array_compact(F.array(*[c.cast("string") for c in columns]))) == len(columns)


#: Rows that the processors tell.
SESSION = Row("job_id", "start_us", "end_us", "n", "late")
TOLD = Row("job_id", "chunk_id", "status", "text", "echo", "failures", "late")


class SessionMerger(StatefulProcessor):
    """Speech sessions of one job (times in microseconds): events merge while the gap is at most ``silence``.

    A session is told once the watermark is past its end and the silence. An event that comes later than the watermark still joins a session that is
    open; else it opens one of its own, told at once as late (those of one batch merge with each other).

    State: starts, ends, numbers of events and due times of the open sessions, in order of starts, as one value, and one timer a job, at the first
    of the due times; so a batch takes few calls of the state, however many sessions a job has.
    """

    MERGED = 10_000

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "starts array<long>, ends array<long>, counts array<long>, due array<long>")

    def _held(self) -> list[tuple]:
        return list(zip(*(self.open.get() or ()), strict=True))

    def _hold(self, sessions: list[tuple], before: int | None) -> None:
        """Keep sessions, and a timer for the first of them in place of the one at ``before``."""
        first = min((s[3] for s in sessions), default=None)
        if sessions:
            self.open.update(tuple(map(list, zip(*sessions, strict=True))))
        else:
            self.open.clear()
        if before is not None and before != first:
            self.handle.deleteTimer(before)
        if first is not None and before != first:
            self.handle.registerTimer(first)

    def _merged(self, spans: list[tuple]) -> list[tuple]:
        merged: list[tuple] = []
        for a, b, n, known in sorted(spans):
            if merged and a - merged[-1][1] <= self.silence:
                first = merged[-1]
                merged[-1] = (first[0], max(first[1], b), first[2] + n, first[3] or known)
            else:
                merged.append((a, b, n, known))
        return merged

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held()
        spans = [(a, b, n, True) for a, b, n, _ in held]  # with an open session in it, or not
        fresh: list[tuple] = []
        for r in rows:
            fresh.append((r.start_us, r.end_us, 1, False))
            if len(fresh) >= self.MERGED:
                spans, fresh = self._merged(spans + fresh), []
        now, late, kept = timerValues.getCurrentWatermarkInMs(), [], []
        for a, b, n, known in self._merged(spans + fresh):
            due = (b + self.silence) // 1000 + 1
            if due <= now and not known:
                late.append(SESSION(key[0], a, b, n, True))
            else:
                kept.append((a, b, n, max(due, now + 1)))
        if kept or held:
            self._hold(kept, min((s[3] for s in held), default=None))
        yield from late

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expiry, held = expiredTimerInfo.getExpiryTimeInMs(), self._held()
        now = max(expiry, timerValues.getCurrentWatermarkInMs())
        self._hold([s for s in held if s[3] > now], None)
        yield from [SESSION(key[0], a, b, n, False) for a, b, n, due in held if due <= now]

    def close(self) -> None:
        pass


def speech_sessions(events: DataFrame, min_silence_ms: int, watermark: str) -> DataFrame:
    """Speech events ``(job_id, ts, end_ts)`` merged while the gap is at most ``min_silence_ms``: job_id, start_ts, end_ts, n, late (append mode, RocksDB state store).

    No event is dropped: one that comes later than the watermark joins an open session or opens one of its own, told as late. Events without
    a job or times are left out, but move the watermark (Spark fires no timers of a null key, nor of those beside it).
    """
    kind = events.schema["job_id"].dataType.simpleString()
    rows = _clocked(events, "ts", watermark).where(_all_known(F.col("job_id"), F.col("ts"), F.col("end_ts"))).select("job_id", F.unix_micros("ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"))
    told = rows.groupBy("job_id").transformWithState(SessionMerger(1000 * min_silence_ms), f"job_id {kind}, start_us long, end_us long, n long, late boolean", "Append", "EventTime")
    return told.select("job_id", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"), "n", "late")


def running_progress(results: DataFrame) -> DataFrame:
    """Per job: results so far, transcribed ones and mean elapsed time; for update mode."""
    done = F.col("status") == "transcribed"
    return results.groupBy("job_id").agg(F.count("*").alias("attempted"), F.count_if(done).alias("transcribed"), F.avg(F.when(done, F.col("elapsed_ms"))).alias("mean_ms"))


class EchoFilter(StatefulProcessor):
    """Echo filter of one job: chunks are taken in the order of their ids; those that come early wait in state until the hole closes.

    A hole before which ``patience`` chunks wait is passed over, and so are all holes once nothing came for ``hole_ms``. A chunk that comes after its
    turn (a retry that succeeds, or one that was passed over) is told at once as a late row, compared with the genuine text that stood before
    it; what followed stays as it was told. Once nothing came for ``keep_ms``, all state of the job is dropped; a chunk that comes then begins it anew.

    State: next id, form of the last genuine text, length of the run of failures; the chunks that wait; for each chunk that failed or was passed
    over, the form before it; when the job's timers are due. Each call of the state is a message to the JVM, so a batch's chunks are put in order in
    memory (``HELD`` at most, the others wait in state as well), and only those that wait for a later batch are written.
    """

    HELD = 10_000

    def __init__(self, first_id: int = 1, patience: int | None = None, hole_ms: int | None = None, keep_ms: int | None = None):
        self.first_id, self.patience, self.hole_ms, self.keep_ms, self.held = first_id, patience, hole_ms, keep_ms, self.HELD

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, form string, failures int")
        self.waiting = handle.getMapState("waiting", "chunk_id long", "status string, text string, form string")
        self.missed = handle.getMapState("missed", "chunk_id long", "form string")
        self.due = handle.getValueState("due", "hole long, keep long")

    def _wait(self, fresh: dict[int, tuple]) -> None:
        for i, chunk in fresh.items():
            self.waiting.updateValue((i,), chunk)
        fresh.clear()

    def _advance(self, key, patience: int | None, place: tuple | None, fresh: dict[int, tuple], stored: bool) -> list[Row]:
        """Chunks whose turn has come, told in order: ``fresh`` ones, which replace those of one id that wait, and if any are ``stored`` those. What is left of the fresh ones waits."""
        following, last, failures = place or (self.first_id, "", 0)
        out = []
        while True:
            chunk = self.waiting.getValue((following,)) if stored else None
            if chunk is not None:
                self.waiting.removeKey((following,))
            chunk = fresh.pop(following, chunk)
            if chunk is None:
                ids = {*fresh, *([k[0] for k in self.waiting.keys()] if stored else [])} if patience is not None else ()
                if not ids or len(ids) < patience:
                    break
                for i in range(following, min(ids)):
                    self.missed.updateValue((i,), (last,))
                following = min(ids)
                continue
            status, text, form = chunk
            echo = status != "failed" and form != "" and form == last
            failures = failures + 1 if status == "failed" else 0
            if status == "failed":
                self.missed.updateValue((following,), (last,))
            elif not echo:
                last = form
            out.append(TOLD(key[0], following, status, "" if echo else text, echo, failures, False))
            following += 1
        self._wait(fresh)
        self.place.update((following, last, failures))
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        place = self.place.get()
        following = place[0] if place else self.first_id
        stored = place is not None and self.waiting.exists()
        out, came, fresh = [], 0, {}
        for r in rows:
            i, text, form = r.chunk_id, r.text or "", r.form or ""
            came = max(came, r.came_ms)
            if i >= following:
                fresh[i] = (r.status, text, form)
                if len(fresh) >= self.held:
                    self._wait(fresh)
                    stored = True
            elif place and r.status != "failed" and (missed := self.missed.getValue((i,))) is not None:
                self.missed.removeKey((i,))
                echo = form != "" and form == missed[0]
                out.append(TOLD(key[0], i, r.status, "" if echo else text, echo, 0, True))
        out += self._advance(key, self.patience, place, fresh, stored)
        self._rearm(came or timerValues.getCurrentProcessingTimeInMs())
        yield from out

    def _rearm(self, came: int) -> None:
        if self.hole_ms is None and self.keep_ms is None:
            return
        old = self.due.get() or (None, None)
        # Timers of one time are one; the later may be due at the time of an earlier one that is deleted, so all go first.
        for timer in {t for t in old if t is not None}:
            self.handle.deleteTimer(timer)
        times = [None if wait is None else max(came + wait, *[t for t in (at,) if t is not None], 0) for wait, at in ((self.hole_ms, old[0]), (self.keep_ms, old[1]))]
        for timer in {t for t in times if t is not None}:
            self.handle.registerTimer(timer)
        self.due.update(tuple(times))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        hole, keep = self.due.get() or (None, None)
        if hole is not None and hole <= now:
            out += self._advance(key, 1, self.place.get(), {}, True)
            self.due.update((None, keep))
        if keep is not None and keep <= now:
            out += self._advance(key, 1, self.place.get(), {}, True)  # nothing waits for a job that is over
            for state in (self.place, self.waiting, self.missed, self.due):
                state.clear()
        yield from out

    def close(self) -> None:
        pass


def filter_echoes(results: DataFrame, first_id: int = 1, patience: int | None = None, clock: str | None = None, delay: str = "0 seconds", hole_ms: int | None = None, keep_ms: int | None = None) -> DataFrame:
    """Streaming ``results(job_id, chunk_id, status, text)`` with echoes blanked, the run of failures at each chunk, and whether a row came late, to
    replace an earlier one of its chunk (append mode, RocksDB state store).

    With ``hole_ms`` a hole is passed over when its job had no chunk for so long, and with ``keep_ms`` the state of a job is dropped. Time is that of the
    column ``clock`` (when a result came), by a watermark of ``delay`` behind the newest of all jobs; late rows count too. Without a clock it is
    processing time, which needs a stream that goes on (a trigger of ``availableNow`` never ends then). Without both, state has no end. Results without
    a job are left out, but move the clock.
    """
    kind = results.schema["job_id"].dataType.simpleString()
    timed = hole_ms is not None or keep_ms is not None
    came = F.lit(0).cast("long")
    if timed and clock:
        results, came = _clocked(results, clock, delay), F.coalesce(F.unix_millis(clock), F.lit(0).cast("long"))
    known = _all_known(F.col("job_id"), F.coalesce(F.col(clock).cast("string"), F.lit(""))) if timed and clock else F.col("job_id").isNotNull()
    rows = results.where(known).select("job_id", F.col("chunk_id").cast("long").alias("chunk_id"), "status", "text", dedup_form(F.coalesce("text", F.lit(""))).alias("form"), came.alias("came_ms"))
    mode = "None" if not timed else "EventTime" if clock else "ProcessingTime"
    return rows.groupBy("job_id").transformWithState(EchoFilter(first_id, patience, hole_ms, keep_ms), f"job_id {kind}, chunk_id long, status string, text string, echo boolean, failures int, late boolean", "Append", mode)


class AttemptStore:
    """Attempts at chunks in buckets of the job, in a folder of deltas and bases:

        <path>/delta/bucket=<b>/batch=<i>/    what batch i brought
        <path>/base/bucket=<b>/upto=<i>/      the latest attempts of all batches up to i; counts once it holds the file _done

    Readers take the newest base that counts and the deltas after it. A bucket of more than ``keep`` deltas gets a new base, and what it replaces is
    deleted, so a batch reads at most ``keep`` + 1 folders of each of its buckets, however long the stream runs. A batch that runs twice writes
    the same delta again, and one that dies while merging leaves a base that doesn't count.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 16):
        self.spark, self.path, self.buckets, self.keep = spark, path, buckets, keep

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("job_id"), F.lit(self.buckets)).cast("int")

    def _fs(self, folder: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str, bucket: int) -> list[int]:
        folder, fs = self._fs(f"{self.path}/{kind}/bucket={bucket}")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.partition("=")[2]) for n in names if "=" in n)

    def _done(self, bucket: int, upto: int) -> str:
        return f"{self.path}/base/bucket={bucket}/upto={upto}/_done"

    def folders(self, bucket: int) -> tuple[list[str], list[str]]:
        """(base and deltas to read, those that a base replaced) of a bucket."""
        bases, deltas = self._numbers("base", bucket), self._numbers("delta", bucket)
        valid = [u for u in bases if (lambda p, fs: fs.exists(p))(*self._fs(self._done(bucket, u)))]
        upto = valid[-1] if valid else -1
        base = lambda u: f"{self.path}/base/bucket={bucket}/upto={u}"
        delta = lambda i: f"{self.path}/delta/bucket={bucket}/batch={i}"
        return [*map(base, valid[-1:]), *[delta(i) for i in deltas if i > upto]], [*[base(u) for u in bases if u < upto], *[delta(i) for i in deltas if i <= upto]]

    def add(self, batch: DataFrame, batch_id: int) -> list[int]:
        """Keep a batch; the buckets that it touched, at most all."""
        rows = batch.withColumns({"batch": F.lit(batch_id), "bucket": self._bucket()})
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/delta")
        return [b for b in range(self.buckets) if batch_id in self._numbers("delta", b)]

    def read(self, buckets: list[int], schema: StructType) -> DataFrame:
        """The latest attempts at the chunks of some buckets, with their bucket."""
        paths = [f for b in buckets for f in self.folders(b)[0]]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        others = [c for c in schema.names if c not in ("job_id", "chunk_id")]
        latest = rows.groupBy("job_id", "chunk_id").agg(F.max_by(F.struct(*others), "attempt").alias("r"))
        return latest.select("job_id", "chunk_id", "r.*").withColumn("bucket", self._bucket())

    def compact(self, buckets: list[int], schema: StructType) -> list[int]:
        """Merge the buckets that have too many deltas; returns them."""
        full = {b: n[-1] for b in buckets if len(n := self._numbers("delta", b)) > self.keep}
        if full:
            upto = F.create_map(*[F.lit(x) for pair in full.items() for x in pair])[F.col("bucket")]
            merged = self.read(list(full), schema).withColumn("upto", upto)
            merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "upto").parquet(f"{self.path}/base")
            for b, u in full.items():
                done, fs = self._fs(self._done(b, u))
                fs.create(done, True).close()
                for old in self.folders(b)[1]:
                    fs.delete(self._fs(old)[0], True)
        return list(full)


def rerender(path: str, publish: Callable[[DataFrame, int], None], buckets: int = 64, keep: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: keeps each attempt at ``(job_id, chunk_id, attempt)`` in an ``AttemptStore``, renders the captions of the batch's jobs
    anew, and publishes them. A later attempt replaces a failed chunk; a batch that runs twice changes nothing, and reads its own buckets alone."""

    def run(batch: DataFrame, batch_id: int) -> None:
        store = AttemptStore(batch.sparkSession, path, buckets, keep)
        rows = batch.select("job_id", "chunk_id", "attempt", "start_ms", "end_ms", "status", "text")
        mine = store.add(rows, batch_id)
        latest = store.read(mine, rows.schema).join(rows.select("job_id").distinct(), "job_id", "left_semi")
        publish(render_srt(live_captions(latest)), batch_id)
        store.compact(mine, rows.schema)

    return run


def result_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet result files of a folder; with a checkpoint and ``availableNow`` each is read once."""
    return spark.readStream.schema(schema).parquet(path)
