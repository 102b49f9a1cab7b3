"""Streams give what their batch twins give, also when rows come late or out of order."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from cuelake.operators.segments import merge_silences
from cuelake.streaming import stateful as J


def drain(stream, folder, **options):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_sessions_equal_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = [(1, 0, 1000), (1, 1500, 2000), (1, 2501, 3000), (2, 0, 500), (9, 10_000_000, 10_000_500)]
    df = spark.createDataFrame(rows, "job_id int, start_ms long, end_ms long")
    df.select("job_id", F.timestamp_millis("start_ms").alias("ts"), F.timestamp_millis("end_ms").alias("end_ts")).write.parquet(str(tmp_path / "in"))
    stream = J.result_stream(spark, str(tmp_path / "in"), "job_id int, ts timestamp, end_ts timestamp")
    got = drain(J.speech_sessions(stream, 500, "1 second"), tmp_path)
    out = sorted((r.job_id, r.a, r.b) for r in got.select("job_id", F.unix_millis("start_ts").alias("a"), F.unix_millis("end_ts").alias("b")).collect())
    want = sorted(tuple(r) for r in merge_silences(df, 500).where("job_id < 9").collect())
    assert [x for x in out if x[0] < 9] == want


def test_late_events_are_never_dropped(spark, tmp_path):
    """Events later than the watermark open sessions of their own, or join one that is open."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "job_id int, ts timestamp, end_ts timestamp"

    def feed(rows):
        df = spark.createDataFrame(rows, "job_id int, a long, b long").select("job_id", F.timestamp_millis("a").alias("ts"), F.timestamp_millis("b").alias("end_ts"))
        df.write.mode("append").parquet(str(tmp_path / "in"))
        got = drain(J.speech_sessions(J.result_stream(spark, str(tmp_path / "in"), schema), 500, "1 second"), tmp_path)
        return sorted((r.job_id, r.a, r.b, r.n, r.late) for r in got.select("job_id", F.unix_millis("start_ts").alias("a"), F.unix_millis("end_ts").alias("b"), "n", "late").collect())

    first = [(1, 0, 2000, 2, False), (2, 0, 500, 1, False)]
    assert feed([(1, 0, 1000), (1, 1500, 2000), (2, 0, 500), (9, 10_000_000, 10_000_500)]) == first
    late = [(1, 9000, 9100, 1, True), (3, 100, 300, 2, True), (3, 1000, 1100, 1, True)]
    assert feed([(1, 9000, 9100), (3, 250, 300), (3, 100, 200), (3, 1000, 1100), (9, 9_998_900, 9_999_600)]) == sorted(first + late)
    assert feed([(9, 10_000_900, 10_001_000), (9, 20_000_000, 20_000_001), (1, None, 5)]) == sorted([*first, *late, (9, 9_998_900, 10_001_000, 3, False)])
    assert feed([(8, 30_000_000, 30_000_001)])[-2:] == [(9, 9_998_900, 10_001_000, 3, False), (9, 20_000_000, 20_000_001, 1, False)]


def test_holes_close_and_state_ends(spark, tmp_path):
    """A hole is passed over once its job had no chunk for a while; later nothing is kept of the job."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "job_id int, chunk_id int, status string, text string, came timestamp"

    def feed(rows):
        df = spark.createDataFrame(rows, "job_id int, chunk_id int, status string, text string, sec long").withColumn("came", F.timestamp_seconds("sec")).drop("sec")
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = J.filter_echoes(J.result_stream(spark, str(tmp_path / "in"), schema), clock="came", hole_ms=60_000, keep_ms=600_000)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        held = q.lastProgress.stateOperators[0].numRowsTotal
        return sorted((r.job_id, r.chunk_id, r.text, r.echo, r.late) for r in spark.read.parquet(f"{tmp_path}/out").collect()), held

    a, b, c = (1, 1, "a", False, False), (1, 3, "", True, False), (1, 5, "b", False, False)
    rows, held = feed([(1, 1, "transcribed", "a", 100), (1, 3, "transcribed", "A.", 101), (1, 5, "transcribed", "b", 102)])
    assert rows == [a] and held > 0
    rows, _ = feed([(2, 1, "transcribed", "x", 130)])  # not long enough
    assert rows == [a, (2, 1, "x", False, False)]
    rows, _ = feed([(2, 2, "transcribed", "y", 170)])
    assert rows[:3] == [a, b, c]
    rows, held = feed([(1, 2, "transcribed", "late", 10), (2, 3, "transcribed", "z", 200)])  # passed over, and older than the watermark
    assert (1, 2, "late", False, True) in rows and held > 0
    rows, held = feed([(3, 1, "transcribed", "q", 2000)])
    rows, end = feed([(4, 1, "transcribed", "q", 9000)])
    assert len(rows) == 9 and end == held  # of job 4 alone, as before of job 3
    again, _ = feed([(1, 1, "transcribed", "b", 9001)])  # begins anew
    assert (1, 1, "b", False, False) in again


def test_echo_filter_waits_for_holes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "job_id int, chunk_id int, status string, text string"
    first = [(1, 1, "transcribed", "A."), (1, 3, "failed", None), (1, 4, "transcribed", "a")]
    spark.createDataFrame(first, schema).write.parquet(str(tmp_path / "in"))
    run = lambda: drain(J.filter_echoes(J.result_stream(spark, str(tmp_path / "in"), schema)), tmp_path)
    assert [r.chunk_id for r in run().collect()] == [1]
    spark.createDataFrame([(1, 2, "failed", None), (1, 5, "transcribed", "b")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    got = sorted((r.chunk_id, r.text, r.echo, r.failures) for r in run().collect())
    assert got == [(1, "A.", False, 0), (2, "", False, 1), (3, "", False, 2), (4, "", True, 0), (5, "b", False, 0)]


def test_rerender_takes_the_later_attempt(spark, tmp_path):
    schema = "job_id int, chunk_id int, attempt int, start_ms long, end_ms long, status string, text string"
    seen = {}
    fn = J.rerender(str(tmp_path / "attempts"), lambda df, i: seen.update({(i, r.doc_id): r.text for r in df.collect()}))
    fn(spark.createDataFrame([(1, 1, 1, 0, 1000, "failed", None), (1, 2, 1, 1000, 2000, "transcribed", "b")], schema), 0)
    fn(spark.createDataFrame([(1, 1, 2, 0, 1000, "transcribed", "a")], schema), 1)
    fn(spark.createDataFrame([(1, 1, 2, 0, 1000, "transcribed", "a")], schema), 1)
    assert "[TRANSCRIPTION FAILED]" in seen[(0, 1)]
    assert seen[(1, 1)] == "1\n00:00:00,000 --> 00:00:01,000\na\n\n2\n00:00:01,000 --> 00:00:02,000\nb\n"


def test_late_retries_and_patience(spark, tmp_path):
    """A retry that succeeds is told as a late row; a hole that stays is passed over once enough chunks wait, and its chunk is late when it comes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "job_id int, chunk_id int, status string, text string"
    run = lambda: sorted((r.chunk_id, r.late, r.status, r.text, r.echo) for r in drain(J.filter_echoes(J.result_stream(spark, str(tmp_path / "in"), schema), patience=2), tmp_path).collect())
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    write([(1, 1, "transcribed", "a"), (1, 2, "failed", None), (1, 4, "transcribed", "b")])
    assert [r[0] for r in run()] == [1, 2]
    write([(1, 5, "transcribed", "c")])
    assert [r[0] for r in run()] == [1, 2, 4, 5]
    write([(1, 2, "transcribed", "x"), (1, 3, "transcribed", "A."), (1, 4, "transcribed", "again")])
    assert run() == [(1, False, "transcribed", "a", False), (2, False, "failed", "", False), (2, True, "transcribed", "x", False), (3, True, "transcribed", "", True), (4, False, "transcribed", "b", False), (5, False, "transcribed", "c", False)]


def test_a_long_stream_reads_few_files(spark, tmp_path):
    """However many batches came, a bucket has a base and few deltas, and captions hold every chunk's latest attempt."""
    schema = "job_id int, chunk_id int, attempt int, start_ms long, end_ms long, status string, text string"
    seen, most = {}, 0
    store = J.AttemptStore(spark, str(tmp_path / "attempts"), buckets=2, keep=3)
    fn = J.rerender(store.path, lambda df, i: seen.update({r.doc_id: r.text for r in df.collect()}), buckets=2, keep=3)
    batch = lambda i: spark.createDataFrame([(1, i // 2 + 1, i % 2 + 1, 1000 * (i // 2), 1000 * (i // 2) + 900, ["failed", "transcribed"][i % 2], f"t{i}"), (5, 1, i, 0, 1, "transcribed", f"n{i}")], schema).coalesce(1)
    for i in range(14):
        fn(batch(i), i)
        if i % 5 == 4:
            fn(batch(i), i)  # runs twice
        most = max(most, *[len(store.folders(b)[0]) for b in range(2)])
    assert most <= 4 and sum(p.suffix == ".parquet" for p in (tmp_path / "attempts").rglob("*")) <= 8
    assert [line for line in seen[1].split("\n") if line.startswith("t")] == [f"t{i}" for i in range(1, 14, 2)] and "n13" in seen[5]
    # A base without its mark doesn't count.
    bucket = next(b for b in range(2) if store._numbers("base", b))
    (tmp_path / "attempts" / "base" / f"bucket={bucket}" / "upto=99").mkdir()
    assert not any("upto=99" in f for f in store.folders(bucket)[0])


class Counted:
    """States and timers of one key, kept in memory, that count their calls."""

    def __init__(self):
        self.calls, self.kept = 0, {}

    def getValueState(self, *args):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return None if name in ("get", "getValue") else False if name in ("exists", "containsKey") else iter(()) if name in ("iterator", "keys") else None

        return call


class Times:
    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0

    getCurrentProcessingTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def test_sessions_of_a_job_take_few_state_calls():
    """Each call is a message to the JVM, so there are as many for a thousand sessions as for one."""
    merger, state = J.SessionMerger(500), Counted()
    merger.init(state)
    row = Row("start_us", "end_us")
    assert list(merger.handleInputRows((1,), iter([row(10_000 * i, 10_000 * i + 1) for i in range(1000)]), Times())) == []
    assert state.calls <= 4


def test_many_sessions_close_at_once(spark, tmp_path):
    """Sessions of a job lie in one value with one timer, so many more than are merged at a time come out whole, some now and some later."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    n, kind = 300, "job_id int, ts timestamp, end_ts timestamp"

    def feed(rows):
        df = spark.createDataFrame(rows, "job_id int, a long, b long").select("job_id", F.timestamp_millis("a").alias("ts"), F.timestamp_millis("b").alias("end_ts"))
        df.write.mode("append").parquet(str(tmp_path / "in"))
        q = J.speech_sessions(J.result_stream(spark, str(tmp_path / "in"), kind), 500, "1 second").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.read.schema("job_id int, start_ts timestamp, end_ts timestamp, n long, late boolean").parquet(f"{tmp_path}/out")
        return q.lastProgress.stateOperators[0].numRowsTotal, sorted((r.a, r.n, r.late) for r in got.select(F.unix_millis("start_ts").alias("a"), "n", "late").collect())

    held, got = feed([(1, 1000 * i, 1000 * i + k) for i in range(n) for k in (10, 20)])
    assert got == [(1000 * i, 2, False) for i in range(n - 2)] and held <= 4
    held, got = feed([(1, 10**9, 10**9 + 1)])
    assert got == [(1000 * i, 2, False) for i in range(n)] and held <= 4


def chunk_rows(n, failed=()):
    row = Row("chunk_id", "status", "text", "form", "came_ms")
    return [row(i, "failed" if i in failed else "transcribed", f"t{i}", f"t{i}", 0) for i in range(1, n + 1)]


def test_chunks_of_one_batch_take_few_state_calls():
    """Chunks of a batch are put in order in memory, so a thousand that come backwards take as many calls of the state as one."""
    echoes, state = J.EchoFilter(), Counted()
    echoes.init(state)
    told = list(echoes.handleInputRows((1,), iter(chunk_rows(1000)[::-1]), Times()))
    assert [r.chunk_id for r in told] == list(range(1, 1001)) and state.calls <= 3


def test_lines_of_their_own_take_few_state_calls():
    """As above with failed chunks: each is kept for its retry, by one call, and no other chunk takes any."""
    echoes, state = J.EchoFilter(), Counted()
    echoes.init(state)
    told = list(echoes.handleInputRows((1,), iter(chunk_rows(1000, failed=(3, 500))), Times()))
    assert len(told) == 1000 and state.calls <= 5


def test_a_batch_that_memory_does_not_hold_waits_in_state(spark, tmp_path, monkeypatch):
    """Chunks in any order with echoes and failures, one chunk in memory at a time or all: the same rows; retries replace the failed ones that wait, or come late."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "job_id int, chunk_id int, status string, text string"
    rows = [(1, i, "failed" if i % 4 == 0 else "transcribed", None if i % 4 == 0 else f"t{i // 2}") for i in (5, 3, 9, 1, 2, 4, 6, 7)]
    later = [(1, 4, "transcribed", "x"), (1, 9, "transcribed", "y"), (1, 8, "failed", None)]
    seen = []
    for most in (1, 2, 100_000):
        monkeypatch.setattr(J.EchoFilter, "HELD", most)
        at = tmp_path / str(most)
        for part in (rows, later):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(at / "in"))
            out = drain(J.filter_echoes(J.result_stream(spark, str(at / "in"), schema)), at)
        seen.append(sorted(tuple(r) for r in out.collect()))
    a = [(1, 1, "transcribed", "t0", False, 0, False), (1, 2, "transcribed", "t1", False, 0, False), (1, 3, "transcribed", "", True, 0, False), (1, 4, "failed", "", False, 1, False)]
    b = [(1, 4, "transcribed", "x", False, 0, True), (1, 5, "transcribed", "t2", False, 0, False), (1, 6, "transcribed", "t3", False, 0, False), (1, 7, "transcribed", "", True, 0, False)]
    assert seen == [a + b + [(1, 8, "failed", "", False, 1, False), (1, 9, "transcribed", "y", False, 0, False)]] * 3
