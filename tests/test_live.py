"""Live runs against a sequential loop: context, resume, breaker, stop from outside, counts while tasks run."""

import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import correction as K
from cuelake.operators import live as L
from cuelake.operators import transcripts as X
from cuelake.operators import translation as H
from cuelake.params import FilterParams
from cuelake.sources.board import RunBoard, eta_sec, open_folder

SCHEMA = "job_id string, chunk_id int, status string, text string, template string, payload string"
BOTH = FilterParams(dedup_repeated=True, strip_repetition=True)


def _stub():
    # made in a function, so that it goes to workers by value
    def stub(prompt, payload):
        if payload.startswith("dead"):
            raise RuntimeError("no server")
        if payload.startswith("again"):
            return prompt[1:-1].upper() + " !"
        if payload.startswith("loop"):
            return "language xx<asr_text>" + "la la " * 7
        if payload.startswith("blank"):
            return "language xx<asr_text> \n"
        return f"language xx<asr_text> {payload} after {prompt} "

    return stub


stub = _stub()


def loop(chunks, p=BOTH):
    """The rule, one job after another: (status, text, flags, context, attempts) of each chunk that is asked for or given up."""
    out = {}
    for job in {c[0] for c in chunks}:
        own = sorted((c for c in chunks if c[0] == job), key=lambda c: c[1])
        done = [c for c in own if c[2] == "transcribed"]
        context, failures = (done[-1][3] or "").strip() if done else "", 0
        for _, i, status, _, template, payload in own:
            if status == "transcribed":
                continue
            if failures >= 5:
                out[job, i] = (status, None, [], context, 0)
                continue
            try:
                raw = stub((template or "").replace("{{context}}", context), payload)
            except RuntimeError:
                failures += 1
                out[job, i] = ("failed", None, [], context, 2)
                continue
            failures, given = 0, context
            text = raw.split("<asr_text>", 1)[-1].strip()
            form = lambda t: re.sub(r"[\s.,!?~…、。！？]+$", "", " ".join(t.split())).lower()
            flags = []
            if p.dedup_repeated and text and given.strip() and form(text) == form(given):
                flags, text = ["possible_duplicate_hallucination"], ""
            elif re.search(r"(?s)(.{2,20}?)\1{4,}", text):
                flags = ["possible_infinite_repetition"]
                if p.strip_repetition:
                    text = ""
            if not flags or (flags == ["possible_infinite_repetition"] and not p.strip_repetition):
                context = text
            out[job, i] = ("transcribed", text, flags, given, 1)
    return out


def corpus():
    rows = []
    for j, n in (("a", 30), ("b", 12), ("c", 1), ("long", 400)):
        for i in range(1, n + 1):
            kind = ["say", "again", "say", "loop", "blank", "again", "dead"][(i * i + n) % 7]
            rows.append((j, i, ["vad_extracted", "failed", None][i % 3], None, "<{{context}}>", f"{kind} {i}"))
    rows += [("seeded", i, "transcribed" if i in (2, 6) else "vad_extracted", f" old {i}\n", "<{{context}}>", f"say {i}") for i in range(1, 9)]
    rows += [("dead", i, "vad_extracted", None, "<{{context}}>", f"{'dead' if i > 3 else 'say'} {i}") for i in range(1, 40)]
    rows += [("blank seed", 1, "transcribed", None, None, "x"), ("blank seed", 2, None, None, None, "say")]
    return rows


@pytest.mark.parametrize("filters", [BOTH, FilterParams(), FilterParams(dedup_repeated=True)])
def test_equals_a_sequential_loop(spark, filters):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("seed", F.lit(1)).withColumn("turn", F.lit("x")).repartition(5)
    got = L.transcribe_live(df, stub, L.LiveParams(filters, tasks=3, rows=7)).collect()
    want = loop(rows, filters)
    assert {(r.job_id, r.chunk_id): (r.status, r.text, r.flags, r.context, r.attempts) for r in got} == want and len(got) == len(want)
    assert all(r.language == "xx" for r in got if r.status == "transcribed" and r.text and r.text.startswith("say"))


def test_given_up_jobs_are_asked_five_times(spark):
    got = [r for r in L.transcribe_live(spark.createDataFrame(corpus(), SCHEMA), stub).collect() if r.job_id == "dead"]
    assert sum(r.attempts > 0 for r in got) == 8 and sum(r.attempts for r in got) == 3 + 2 * 5
    assert {r.error for r in got if r.attempts == 0} == {L.ABORTED} and {r.status for r in got if r.attempts == 0} == {"vad_extracted"}


def test_going_on_takes_up_the_context(spark):
    """A run over the first half and one over what is left give what one run gives."""
    rows = [("j", i, "vad_extracted", None, "<{{context}}>", f"say {i}") for i in range(1, 21)]
    whole = {i: v for (_, i), v in loop(rows, FilterParams()).items()}
    df = spark.createDataFrame(rows, SCHEMA)
    first = spark.createDataFrame(L.transcribe_live(df.where("chunk_id <= 10"), stub, L.LiveParams(FilterParams())).collect(), L.transcribe_live(df, stub, L.LiveParams(FilterParams())).schema)
    second = L.transcribe_live(L.with_results(df, first), stub, L.LiveParams(FilterParams())).collect()
    assert sorted(r.chunk_id for r in second) == list(range(11, 21))
    assert {r.chunk_id: (r.text, r.context) for r in [*first.collect(), *second]} == {i: (v[1], v[3]) for i, v in whole.items()}


def test_gemini_and_empty_table(spark):
    df = spark.createDataFrame([("j", 1, None, None, "{{context}}", "p")], SCHEMA)
    (r,) = L.transcribe_live(df, lambda prompt, payload: "  x<asr_text>y ", L.LiveParams(provider="gemini", language="fi")).collect()
    assert (r.language, r.text) == ("fi", "x<asr_text>y")
    assert L.transcribe_live(df.limit(0), stub).count() == 0


def test_python_forms_equal_the_columns(spark):
    odd = ["Straße  A.", " \x1c x　Y …!", "abc .", "", "。", "A b?~", "É, ", "x\ny\t."]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert [r.f for r in df.select(T.dedup_form(F.col("t")).alias("f")).collect()] == [L.compared(t) for t in odd]


def test_driver_stops_a_run_and_the_next_asks_the_rest(spark, tmp_path):
    """A flag that the driver sets in mid-run ends it; answers are kept; counts are seen while tasks run."""
    rows = [(f"j{j}", i, "vad_extracted", None, "<{{context}}>", f"say {i}") for j in range(4) for i in range(1, 501)]
    df, board = spark.createDataFrame(rows, SCHEMA), RunBoard(str(tmp_path / "board"), every_sec=0.02)

    def slow(prompt, payload):
        time.sleep(0.01)
        return payload

    out = str(tmp_path / "out")
    running = threading.Thread(target=lambda: L.transcribe_live(df, slow, L.LiveParams(tasks=4), board).write.parquet(out))
    running.start()
    while running.is_alive() and board.counts().get("ok", 0) < 20:
        time.sleep(0.02)
    assert running.is_alive()
    seen = board.counts()
    board.stop()
    running.join(60)
    results = spark.read.parquet(out)
    done = results.where("attempts > 0").count()
    assert 20 <= done < 2000 and results.count() == 2000
    assert results.where("attempts = 0").select("error", "status").distinct().collect() == [(X.STOPPED, "vad_extracted")]
    told = board.counts()
    assert told["asked"] == told["ok"] == done and told["skipped"] == 2000 - done and seen["ok"] <= done
    assert eta_sec(told, 2000) > 0 and eta_sec({}, 5) is None
    rest = L.transcribe_live(L.with_results(df, results), lambda prompt, payload: payload).collect()
    assert len(rest) == 2000 - done and {r.attempts for r in rest} == {1}


@pytest.mark.parametrize("kind", ["model", "correction", "translation"])
def test_every_map_can_be_stopped(spark, tmp_path, kind):
    board = RunBoard(str(tmp_path / "b"))
    board.stop()
    never = lambda request: request
    chunks = spark.createDataFrame([(1, i, f"t{i}") for i in range(5)], "job_id int, chunk_id int, text string")
    if kind == "model":
        out = X.model_map(chunks.select("chunk_id", F.col("text").alias("request")), ["chunk_id"], never, board=board)
    elif kind == "correction":
        groups = K.context_groups(chunks)
        out = K.correction_map(chunks, groups, K.transcript_blocks(chunks, groups), never, board=board)
    else:
        out = H.translate_batches(chunks.select(F.col("job_id").alias("doc_id"), F.col("chunk_id").alias("cue_idx"), "text"), 10, never, board=board)
    rows = out.collect()
    assert rows and {(r.ok, r.error, r.attempts) for r in rows} == {(False, X.STOPPED, 0)}
    assert board.counts()["skipped"] == len(rows) and board.counts()["asked"] == 0


def test_folders():
    assert open_folder("file:/tmp/x")[1] == open_folder("file:///tmp/x")[1] == open_folder("/tmp/x")[1] == "/tmp/x"
