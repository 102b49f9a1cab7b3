"""Queries of transcription jobs, resume and correction over the timed lines view."""

from __future__ import annotations

import hashlib
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPEAKER, asr_text, collapse, provider_answer, template_prompt
from ..operators import captions as C
from ..operators import correction as K
from ..operators import live as L
from ..operators import transcripts as X
from ..params import FilterParams
from ..sources.board import RunBoard
from . import views as V
from .folders import shared_folder
from .registry import query
from .scalar_queries import collapse_sql, dedup_sql, sql_clock, strip_sql, units_sql
from .views import with_views

_TEXT = collapse_sql("text")
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def timed(spark: SparkSession, sf: str) -> DataFrame:
    return V.timed_lines(spark, sf)


@query("b1_work_selection", with_views("timed", "SELECT job_id, chunk_id, status FROM timed WHERE status <> 'transcribed'"))
def b1(spark: SparkSession, sf: str) -> DataFrame:
    return X.work_items(timed(spark, sf)).select("job_id", "chunk_id", "status")


@query("b2_correctable", with_views("timed", f"SELECT job_id, chunk_id FROM timed WHERE status = 'transcribed' AND {_TEXT} <> ''"))
def b2(spark: SparkSession, sf: str) -> DataFrame:
    return X.correctable(timed(spark, sf)).select("job_id", "chunk_id")


@query("b3_entry_collection", with_views("timed", f"SELECT job_id, chunk_id, start_ms, end_ms, {_TEXT} AS text FROM timed WHERE status = 'transcribed' AND {_TEXT} <> ''"))
def b3(spark: SparkSession, sf: str) -> DataFrame:
    return X.collect_entries(timed(spark, sf)).select("job_id", "chunk_id", "start_ms", "end_ms", "text")


@query("b3_entry_counts", with_views("timed", f"SELECT job_id, count_if(status = 'transcribed' AND {_TEXT} <> '') AS n_entries, count_if(status <> 'transcribed') AS n_failed, count_if(status = 'transcribed' AND {_TEXT} = '') AS n_empty FROM timed GROUP BY job_id"))
def b3_counts(spark: SparkSession, sf: str) -> DataFrame:
    return X.entry_counts(timed(spark, sf))


_SHIFT = "start_ms - CASE WHEN chunk_id % 6 = 0 THEN 2500 ELSE 0 END"


def shifted(spark: SparkSession, sf: str) -> DataFrame:
    """Every sixth chunk starts too early."""
    return timed(spark, sf).withColumn("start_ms", F.col("start_ms") - F.when(F.col("chunk_id") % 6 == 0, 2500).otherwise(0))


@query("b4_order_check", with_views("timed", f"SELECT job_id AS doc_id, chunk_id AS cue_idx FROM (SELECT *, {_SHIFT} AS s, lag(end_ms, 1, -1000) OVER (PARTITION BY job_id ORDER BY chunk_id) AS p FROM timed) WHERE end_ms < s OR s < p"))
def b4(spark: SparkSession, sf: str) -> DataFrame:
    return C.order_violations(C._as_cues(shifted(spark, sf).select("job_id", "chunk_id", "start_ms", "end_ms", "text"))).select("doc_id", "cue_idx")


_GUARD = f", n AS (SELECT job_id, chunk_id, ({_SHIFT})::BIGINT AS s, end_ms AS e FROM timed), r AS (SELECT job_id, chunk_id, CASE WHEN s >= -1 THEN e ELSE -1 END AS kept, s >= -1 AS keep FROM n WHERE chunk_id = 1 UNION ALL SELECT n.job_id, n.chunk_id, CASE WHEN n.s >= r.kept THEN n.e ELSE r.kept END, n.s >= r.kept FROM r JOIN n ON n.job_id = r.job_id AND n.chunk_id = r.chunk_id + 1)"


@query("b8_overlap_guard", with_views("timed", f"RECURSIVE{_GUARD} SELECT job_id, chunk_id FROM r WHERE keep"))
def b8(spark: SparkSession, sf: str) -> DataFrame:
    return X.drop_overlaps(shifted(spark, sf).select("job_id", "chunk_id", "start_ms", "end_ms", "text")).select("job_id", "chunk_id")


@query("d4_model_map", with_views("timed", f"SELECT job_id, chunk_id, CASE WHEN chunk_id % 5 = 0 THEN 'failed' ELSE 'transcribed' END AS status, CASE WHEN chunk_id % 5 <> 0 THEN {strip_sql('text')} END AS text, CASE WHEN chunk_id % 5 = 0 THEN 2 ELSE 1 END AS attempts FROM timed"))
def d4(spark: SparkSession, sf: str) -> DataFrame:
    """A stub model that fails on every fifth chunk, twice."""

    def stub(request: str) -> str:
        head, _, text = request.partition("|")
        if head == "0":
            raise RuntimeError("no answer")
        return f"language en<asr_text>{text}"

    requests = timed(spark, sf).select("job_id", "chunk_id", F.concat((F.col("chunk_id") % 5).cast("string"), F.lit("|"), F.col("text")).alias("request"))
    out = X.model_map(requests, ["job_id", "chunk_id"], stub)
    return out.select("job_id", "chunk_id", F.when(F.col("ok"), "transcribed").otherwise("failed").alias("status"), asr_text(F.col("raw")).alias("text"), "attempts")


# Whole lines, but every seventh chunk is one unit six times, and the one after it echoes the line before that.
_INJECTED = "SELECT job_id, chunk_id, status, CASE WHEN chunk_id % 7 = 0 THEN repeat('ab' || (chunk_id % 3)::VARCHAR || ' ', 6) WHEN chunk_id % 7 = 1 AND chunk_id > 1 THEN translate(lag(t) OVER (PARTITION BY job_id ORDER BY chunk_id), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '.' ELSE t END AS text FROM (SELECT *, text AS t FROM timed)"


def injected(spark: SparkSession, sf: str) -> DataFrame:
    rows = timed(spark, sf).withColumn("t", F.col("text"))
    echo = F.concat(F.translate(F.lag("t").over(Window.partitionBy("job_id").orderBy("chunk_id")), LOWER, UPPER), F.lit("."))
    loop = F.repeat(F.concat(F.lit("ab"), (F.col("chunk_id") % 3).cast("string"), F.lit(" ")), 6)
    text = F.when(F.col("chunk_id") % 7 == 0, loop).when((F.col("chunk_id") % 7 == 1) & (F.col("chunk_id") > 1), echo).otherwise(F.col("t"))
    return rows.select("job_id", "chunk_id", "status", text.alias("text"))


def _filter_sql(strip: bool) -> str:
    unit = "(unit IS NOT NULL)"
    usable = "status <> 'failed'" + (f" AND NOT {unit}" if strip else "")
    blank = f"(NOT echo AND status <> 'failed' AND {unit})" if strip else "FALSE"
    return f""", inj AS ({_INJECTED}){units_sql('inj')}, f AS (SELECT *, {dedup_sql('text')} AS form, {strip_sql('text')} = '' AS blank FROM inj LEFT JOIN units USING (text)),
l AS (SELECT *, last_value(CASE WHEN {usable} THEN {{'f': form, 'b': blank}} END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM f),
e AS (SELECT *, coalesce(status <> 'failed' AND NOT blank AND NOT p.b AND form = p.f, FALSE) AS echo FROM l),
g AS (SELECT *, {blank} AS cut, CASE WHEN status <> 'failed' AND NOT echo AND NOT {blank} THEN text END AS genuine FROM e)
SELECT job_id, chunk_id, CASE WHEN echo OR cut THEN '' ELSE text END AS text, CASE WHEN echo THEN 'possible_duplicate_hallucination' WHEN status <> 'failed' AND {unit} THEN 'possible_infinite_repetition' ELSE '' END AS flags,
coalesce(last_value(genuine IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM g"""


def _filtered(spark: SparkSession, sf: str, strip: bool) -> DataFrame:
    out = X.suppress_echoes(injected(spark, sf), FilterParams(dedup_repeated=True, strip_repetition=strip))
    return out.select("job_id", "chunk_id", "text", F.array_join("flags", ",").alias("flags"), "context")


@query("d9_echo_suppression", with_views("timed", _filter_sql(False)))
def d9(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, False)


@query("d10_repetition_suppression", with_views("timed", _filter_sql(True)))
def d10(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, True)


@query("d11_flags", with_views("timed", f"SELECT flags, count(*) AS n FROM ({with_views('timed', _filter_sql(False))}) GROUP BY flags"))
def d11(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, False).groupBy("flags").agg(F.count("*").alias("n"))


@query("d12_context", with_views("timed", f"SELECT job_id, chunk_id, context FROM ({with_views('timed', _filter_sql(True))})"))
def d12(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, True).select("job_id", "chunk_id", "context")


# The same over all lines as they are, without SQL: that of the queries above takes long enough.


def _whole(spark: SparkSession, sf: str, strip: bool) -> DataFrame:
    out = X.suppress_echoes(timed(spark, sf).select("job_id", "chunk_id", "status", "text"), FilterParams(dedup_repeated=True, strip_repetition=strip))
    return out.select("job_id", "chunk_id", "text", F.array_join("flags", ",").alias("flags"), "context")


@query("d9_echo_suppression_whole")
def d9_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(spark, sf, False)


@query("d10_repetition_suppression_whole")
def d10_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(spark, sf, True)


@query("d11_flags_whole")
def d11_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(spark, sf, False).groupBy("flags").agg(F.count("*").alias("n"))


@query("d12_context_whole")
def d12_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(spark, sf, True).select("job_id", "chunk_id", "context")


_STATUS2 = "CASE WHEN job_id % 9 = 0 AND chunk_id BETWEEN 3 AND 9 THEN 'failed' ELSE status END"


@query("d13_failure_breaker", with_views("timed", f", c AS (SELECT job_id, chunk_id, {_STATUS2} AS status, row_number() OVER (PARTITION BY job_id ORDER BY chunk_id) AS p FROM timed) SELECT job_id, max(n) AS longest_run FROM (SELECT job_id, count(*) AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY job_id ORDER BY chunk_id) AS g FROM c WHERE status = 'failed') GROUP BY job_id, g) GROUP BY job_id HAVING max(n) >= 5"))
def d13(spark: SparkSession, sf: str) -> DataFrame:
    return X.aborted_jobs(timed(spark, sf).withColumn("status", F.expr(_STATUS2)))


@query("d14_progress", with_views("timed", "SELECT job_id, count(*) AS total, count_if(status = 'transcribed') AS transcribed, count_if(status IN ('transcribed', 'failed')) AS attempted, round(avg(CASE WHEN status = 'transcribed' THEN elapsed_ms END) * count_if(status = 'vad_extracted') / 1000, 6) AS eta_sec FROM timed GROUP BY job_id"))
def d14(spark: SparkSession, sf: str) -> DataFrame:
    return X.progress(timed(spark, sf)).withColumn("eta_sec", F.round("eta_sec", 6))


_FLAGS = "CASE WHEN chunk_id % 4 = 0 THEN array('x') ELSE array() END"


@query("d15_run_summary", with_views("timed", "SELECT job_id, count_if(status = 'transcribed') AS n_transcribed, count_if(status = 'failed') AS n_failed, count_if(chunk_id % 4 = 0) AS n_flagged FROM timed GROUP BY job_id"))
def d15(spark: SparkSession, sf: str) -> DataFrame:
    return X.run_summary(timed(spark, sf).withColumn("flags", F.expr(_FLAGS)))


@query("d16_language_rule", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'configured' WHEN doc_id % 3 = 0 THEN '?' ELSE lang END AS language, CASE WHEN doc_id % 2 = 1 AND doc_id % 3 <> 0 THEN {strip_sql('text')} ELSE {strip_sql('raw')} END AS text FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'language ' || lang || '<asr_text>' || text END AS raw FROM documents)")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of two providers: one names no language and its whole answer is text, the other's is parsed."""
    docs = V.table(spark, sf, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("language "), "lang", F.lit("<asr_text>"), "text"))
    language, text = provider_answer(F.when(F.col("doc_id") % 2 == 0, "gemini").otherwise("local"), raw, F.lit("configured"))
    return docs.select("doc_id", language.alias("language"), text.alias("text"))


@query("d4_stop_and_progress", with_views("timed", "SELECT job_id, chunk_id, chunk_id <> 2 AS ok, CASE WHEN chunk_id <> 2 THEN md5(text) END AS raw, 1 AS attempts, TRUE AS counted FROM timed"))
def d4_stop(spark: SparkSession, sf: str) -> DataFrame:
    """A run that its driver stops after the first counts arrive, and a second one that asks what is left: together each chunk is asked once, and the boards count that."""
    folder = shared_folder(spark)
    rows = timed(spark, sf).select("job_id", "chunk_id", F.concat((F.col("chunk_id") == 2).cast("string"), F.lit("|"), "text").alias("request"))
    keys = ["job_id", "chunk_id"]

    def digest(request: str) -> str:
        fails, _, text = request.partition("|")
        if fails == "true":
            raise RuntimeError("no answer")
        return hashlib.md5(text.encode()).hexdigest()

    first, second = RunBoard(f"{folder}/first", every_sec=0.05), RunBoard(f"{folder}/second")
    with ThreadPoolExecutor(1) as pool:
        running = pool.submit(lambda: X.model_map(rows, keys, digest, 0, first).write.parquet(f"{folder}/answers/run=1"))
        while not running.done() and not first.counts().get("asked"):
            time.sleep(0.02)
        first.stop()
        running.result()
    answers = lambda: spark.read.schema(f"job_id long, chunk_id long, {X.CALLED}, run int").parquet(f"{folder}/answers").where("attempts > 0")
    X.model_map(rows.join(answers().select(*keys), keys, "left_anti"), keys, digest, 0, second).write.parquet(f"{folder}/answers/run=2")
    told = first.counts().get("asked", 0) + second.counts().get("asked", 0)
    return answers().groupBy(*keys).agg(F.any_value("ok").alias("ok"), F.max("raw").alias("raw"), F.sum("attempts").cast("int").alias("attempts")).withColumn("counted", F.lit(told) == F.count("*").over(Window.partitionBy()))


# --- live runs: each answer forms the next prompt ------------------------------------------------------

_LIVE_TEMPLATE = "{{language_hint}}{{vocabulary}}Before: {{context}}"
_PRIOR = "job_id % 3 = 0 AND chunk_id % 5 = 0"  # transcribed by an earlier run
_ACTS = "CASE WHEN (job_id * 7 + chunk_id * 3) % 11 = 0 THEN 'fail' WHEN chunk_id % 7 = 0 THEN 'loop' WHEN chunk_id % 7 = 1 THEN 'echo' ELSE 'say' END"
_DEAD = f"CASE WHEN job_id % 9 = 1 AND chunk_id >= 3 THEN 'fail' ELSE {_ACTS} END"  # the server dies in some jobs


def _live_sql(acts: str) -> str:
    """The loop of a run by recursion over each job's chunks: what the model says, whether it is an echo, and what is carried on."""
    return f"""RECURSIVE, seeds AS (SELECT job_id, {strip_sql('max_by(text, chunk_id)')} AS seed FROM timed WHERE {_PRIOR} GROUP BY job_id),
todo AS (SELECT job_id, chunk_id, text, {acts} AS act, row_number() OVER (PARTITION BY job_id ORDER BY chunk_id) AS p FROM timed WHERE NOT ({_PRIOR})),
run AS (SELECT job_id, 0::BIGINT AS p, 0::BIGINT AS chunk_id, '' AS status, '' AS text, '' AS flags, '' AS context, 0 AS attempts, coalesce(seed, '') AS carried, 0 AS failures FROM (SELECT DISTINCT job_id FROM todo) LEFT JOIN seeds USING (job_id)
UNION ALL SELECT job_id, p, chunk_id, CASE WHEN gone THEN 'vad_extracted' WHEN act = 'fail' THEN 'failed' ELSE 'transcribed' END,
  CASE WHEN gone OR act = 'fail' THEN NULL WHEN echo OR act = 'loop' THEN '' ELSE said END,
  CASE WHEN gone OR act = 'fail' THEN '' WHEN echo THEN 'possible_duplicate_hallucination' WHEN act = 'loop' THEN 'possible_infinite_repetition' ELSE '' END,
  carried, CASE WHEN gone THEN 0 WHEN act = 'fail' THEN 2 ELSE 1 END,
  CASE WHEN gone OR act IN ('fail', 'loop') OR echo THEN carried ELSE said END, CASE WHEN gone THEN failures WHEN act = 'fail' THEN failures + 1 ELSE 0 END
FROM (SELECT *, failures >= 5 AS gone, {strip_sql('said')} <> '' AND {strip_sql('carried')} <> '' AND {dedup_sql('said')} = {dedup_sql('carried')} AS echo
  FROM (SELECT t.*, r.carried, r.failures, CASE act WHEN 'say' THEN md5('language: en' || chr(10) || chr(10) || 'Before: ' || r.carried || t.text) WHEN 'echo' THEN translate(r.carried, '{LOWER}', '{UPPER}') || '.' ELSE '' END AS said FROM run r JOIN todo t ON t.job_id = r.job_id AND t.p = r.p + 1)))"""


def _live_run(spark: SparkSession, sf: str, acts: str) -> DataFrame:
    """A stub server that fails, loops, echoes the context in its prompt, or says the digest of prompt and payload."""

    def stub(prompt: str, payload: str) -> str:
        act, _, text = payload.partition("|")
        if act == "fail":
            raise RuntimeError("no answer")
        if act == "loop":
            return "language en<asr_text>" + "ab1 " * 6
        if act == "echo":
            return prompt.partition("Before: ")[2].translate(str.maketrans(LOWER, UPPER)) + "."
        return "language en<asr_text>" + hashlib.md5((prompt + text).encode()).hexdigest()

    prompt = template_prompt(F.lit(_LIVE_TEMPLATE), F.lit("{{context}}"), F.lit("en"), F.array().cast("array<string>"))
    chunks = timed(spark, sf).select("job_id", "chunk_id", "text", F.when(F.expr(_PRIOR), "transcribed").otherwise("vad_extracted").alias("status"), prompt.alias("template"), F.concat(F.expr(acts), F.lit("|"), "text").alias("payload"))
    return L.transcribe_live(chunks, stub, L.LiveParams(FilterParams(dedup_repeated=True, strip_repetition=True)))


@query("d12_live_context", with_views("timed", _live_sql(_ACTS) + " SELECT job_id, chunk_id, status, md5(text) AS text, flags, md5(context) AS context, attempts FROM run WHERE p > 0"))
def d12_live(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts that carry the last genuine answer, in jobs that begin and jobs that go on after an earlier run."""
    out = _live_run(spark, sf, _ACTS)
    return out.select("job_id", "chunk_id", "status", F.md5("text").alias("text"), F.array_join("flags", ",").alias("flags"), F.md5("context").alias("context"), "attempts")


@query("d13_live_breaker", with_views("timed", _live_sql(_DEAD) + " SELECT job_id, count(*) AS chunks, sum(attempts)::BIGINT AS attempts, count_if(status = 'failed') AS failed, count_if(attempts = 0) AS not_asked FROM run WHERE p > 0 GROUP BY job_id"))
def d13_live(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs are given up after five failed chunks in a row; nothing more is asked for them."""
    out = _live_run(spark, sf, _DEAD)
    return out.groupBy("job_id").agg(F.count("*").alias("chunks"), F.sum("attempts").alias("attempts"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if((F.col("attempts") == 0) & (F.col("error") == L.ABORTED)).alias("not_asked"))


@query("i6_flagged_rate", with_views("timed", "SELECT job_id, round(avg((chunk_id % 4 = 0)::INT), 6) AS flagged_rate FROM timed GROUP BY job_id"))
def i6(spark: SparkSession, sf: str) -> DataFrame:
    return X.flagged_rate(timed(spark, sf).withColumn("flags", F.expr(_FLAGS))).withColumn("flagged_rate", F.round("flagged_rate", 6))


# --- resume ------------------------------------------------------------------------------------------


def _prior(spark: SparkSession, sf: str) -> DataFrame:
    rows = timed(spark, sf).where("chunk_id % 2 = 0")
    moved = F.when(F.col("chunk_id") % 4 == 0, 1).otherwise(0)
    return rows.select("job_id", (F.col("start_ms") + moved).alias("start_ms"), "end_ms", F.lit("en").alias("language"), "elapsed_ms")


def _carried(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    chunks = timed(spark, sf)
    raw = chunks.where("chunk_id % 5 <> 0").select("job_id", "chunk_id", F.lit("raw").alias("kind"), "text")
    texts = raw.union(raw.withColumn("kind", F.lit("fixed")))  # a corrected text beside each raw one
    new = chunks.select("job_id", "chunk_id", "start_ms", "end_ms", F.lit("vad_extracted").alias("status"))
    return X.carry_prior(new, texts, _prior(spark, sf), mode).select("job_id", "chunk_id", "status", "language", "elapsed_ms")


_HAVE = f"(chunk_id % 5 <> 0 AND {strip_sql('text')} <> '')"
_SAME = "(chunk_id % 2 = 0 AND chunk_id % 4 <> 0)"


def _carry_sql(condition: str) -> str:
    both = f"{_HAVE} AND {_SAME}"
    return with_views("timed", f"SELECT job_id, chunk_id, CASE WHEN {condition} THEN 'transcribed' ELSE 'vad_extracted' END AS status, CASE WHEN {both} THEN 'en' END AS language, CASE WHEN {both} THEN elapsed_ms END AS elapsed_ms FROM timed")


@query("e1_carry_prior", _carry_sql(f"{_HAVE} AND {_SAME}"))
def e1(spark: SparkSession, sf: str) -> DataFrame:
    return _carried(spark, sf, "offset")


@query("e1_carry_prior_by_name", _carry_sql(_HAVE))
def e1_name(spark: SparkSession, sf: str) -> DataFrame:
    return _carried(spark, sf, "reference")


@query("e2_unfinished_jobs", "SELECT doc_id AS job_id FROM documents WHERE doc_id % 3 <> 0")
def e2(spark: SparkSession, sf: str) -> DataFrame:
    jobs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"))
    return X.unfinished(jobs, jobs.where("job_id % 3 = 0"))


@query("e3_skip_corrected", with_views("timed", "SELECT job_id, chunk_id FROM timed WHERE chunk_id % 3 <> 0"))
def e3(spark: SparkSession, sf: str) -> DataFrame:
    chunks = timed(spark, sf).select("job_id", "chunk_id")
    return X.without_kind(chunks, chunks.where("chunk_id % 3 = 0").withColumn("kind", F.lit("fixed")))


@query("e4_cleanup", with_views("timed", "SELECT job_id FROM timed GROUP BY job_id HAVING count_if(status <> 'transcribed') = 0"))
def e4(spark: SparkSession, sf: str) -> DataFrame:
    return X.cleanup_eligible(timed(spark, sf))


@query("e5_context_recovery", with_views("timed", "SELECT job_id, max_by(text, chunk_id) AS context FROM timed WHERE status = 'transcribed' GROUP BY job_id"))
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return X.recovered_context(timed(spark, sf))


# --- correction ----------------------------------------------------------------------------------------

_LIMIT, _GROUPS = 800, 3
GROUPED = f""", u AS (SELECT job_id, chunk_id, {_TEXT} AS text FROM timed WHERE status = 'transcribed' AND {_TEXT} <> ''), n AS (SELECT job_id, chunk_id, text, length(text)::BIGINT AS l, row_number() OVER (PARTITION BY job_id ORDER BY chunk_id) AS p, sum(length(text)) OVER (PARTITION BY job_id) AS total, count(*) OVER (PARTITION BY job_id) AS c FROM u),
r AS (SELECT job_id, chunk_id, p, 1 AS g, l AS held FROM n WHERE p = 1 UNION ALL SELECT n.job_id, n.chunk_id, n.p, CASE WHEN n.total > {_LIMIT} AND n.c > 1 AND r.held >= n.total / {_GROUPS}.0::DOUBLE AND r.g < {_GROUPS} THEN r.g + 1 ELSE r.g END, CASE WHEN n.total > {_LIMIT} AND n.c > 1 AND r.held >= n.total / {_GROUPS}.0::DOUBLE AND r.g < {_GROUPS} THEN n.l ELSE r.held + n.l END FROM r JOIN n ON n.job_id = r.job_id AND n.p = r.p + 1),
blocks AS (SELECT job_id, g, '<FULL_TRANSCRIPT>' || chr(10) || string_agg(n.chunk_id || ' ' || text, chr(10) ORDER BY n.chunk_id) || chr(10) || '</FULL_TRANSCRIPT>' AS block FROM n JOIN r USING (job_id, chunk_id) GROUP BY job_id, g)"""


def written_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The timed lines, written once for queries that read them several times."""
    folder = shared_folder(spark)
    timed(spark, sf).write.parquet(folder)
    return spark.read.parquet(folder)


def units(spark: SparkSession, sf: str, chunks: DataFrame | None = None) -> DataFrame:
    return X.correctable(timed(spark, sf) if chunks is None else chunks).select("job_id", "chunk_id", "text")


def grouped_units(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Units and their groups, written once, since requests read them several times."""
    folder = shared_folder(spark)
    u = units(spark, sf)
    u.join(K.context_groups(u, _LIMIT, _GROUPS), ["job_id", "chunk_id"]).write.parquet(folder)
    grouped = spark.read.parquet(folder)
    return grouped.drop("group_id"), grouped.select("job_id", "chunk_id", "group_id")


@query("f1_context_groups", with_views("timed", f"RECURSIVE{GROUPED} SELECT job_id, chunk_id, g AS group_id FROM r"))
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return K.context_groups(units(spark, sf), _LIMIT, _GROUPS)


@query("f2_transcript_blocks", with_views("timed", f"RECURSIVE{GROUPED} SELECT job_id, g AS group_id, md5(block) AS block FROM blocks"))
def f2(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    return K.transcript_blocks(u, K.context_groups(u, _LIMIT, _GROUPS)).withColumn("block", F.md5("block"))


@query("f3_correction_requests", with_views("timed", f"RECURSIVE{GROUPED} SELECT job_id, g AS group_id, chunk_id, md5(block || chr(10) || chr(10) || '<CURRENT>' || chr(10) || chunk_id || ' ' || text || chr(10) || '</CURRENT>') AS request FROM n JOIN r USING (job_id, chunk_id) JOIN blocks USING (job_id, g)"))
def f3(spark: SparkSession, sf: str) -> DataFrame:
    u, groups = grouped_units(spark, sf)
    return K.correction_requests(u, groups, K.transcript_blocks(u, groups)).withColumn("request", F.md5("request"))


def answers(spark: SparkSession, sf: str, chunks: DataFrame | None = None) -> DataFrame:
    """Answers of a stub corrector: tagged, blank or without tags."""
    marked = F.replace(collapse(F.col("text")), F.lit(". "), F.lit("." + SPEAKER))
    raw = F.when(F.col("chunk_id") % 5 == 0, F.col("text")).when(F.col("chunk_id") % 5 == 1, "<OUTPUT> \n</OUTPUT>").otherwise(F.concat(F.lit("ok <OUTPUT>\n"), marked, F.lit("</OUTPUT> x")))
    return units(spark, sf, chunks).select("job_id", "chunk_id", raw.alias("raw"))


_MARKED = f"replace({_TEXT}, '. ', '.[[SPEAKER]]')"
FIXED = f", fixed AS (SELECT job_id, chunk_id, CASE WHEN chunk_id % 5 < 2 THEN {_TEXT} ELSE {_MARKED} END AS text, {_TEXT} AS raw FROM timed WHERE status = 'transcribed' AND {_TEXT} <> '')"


@query("f5_tagged_output", with_views("timed", f"{FIXED} SELECT job_id, chunk_id, 'fixed' AS kind, text FROM fixed"))
def f5(spark: SparkSession, sf: str) -> DataFrame:
    return K.corrected_texts(answers(spark, sf), units(spark, sf))


@query("f4_correction_map", with_views("timed", f"SELECT job_id, chunk_id, translate({_TEXT}, '{LOWER}', '{UPPER}') AS text FROM timed WHERE status = 'transcribed' AND {_TEXT} <> ''"))
def f4(spark: SparkSession, sf: str) -> DataFrame:
    """A stub corrector that answers with the current chunk in capitals."""

    def stub(request: str) -> str:
        return "<OUTPUT>" + request.rsplit("<CURRENT>\n", 1)[1].removesuffix("\n</CURRENT>").partition(" ")[2].translate(str.maketrans(LOWER, UPPER)) + "</OUTPUT>"

    u, groups = grouped_units(spark, sf)
    out = K.correction_map(u, groups, K.transcript_blocks(u, groups), stub)
    return K.corrected_texts(out, u).select("job_id", "chunk_id", "text")


def both_texts(spark: SparkSession, sf: str, chunks: DataFrame | None = None) -> DataFrame:
    """Raw texts of all chunks, corrected ones of two thirds, some of them blank."""
    u = (timed(spark, sf) if chunks is None else chunks).select("job_id", "chunk_id", "text")
    fixed = K.corrected_texts(answers(spark, sf, chunks), units(spark, sf, chunks)).where("chunk_id % 3 <> 0").withColumn("text", F.when(F.col("chunk_id") % 11 == 0, " ").otherwise(F.col("text")))
    return u.select("job_id", "chunk_id", F.lit("raw").alias("kind"), "text").union(fixed)


PREFERRED = f"{FIXED}, pref AS (SELECT t.job_id, t.chunk_id, t.start_ms, t.end_ms, coalesce(CASE WHEN t.chunk_id % 3 <> 0 THEN CASE WHEN t.chunk_id % 11 = 0 AND f.text IS NOT NULL THEN '' ELSE f.text END END, {collapse_sql('t.text')}) AS text FROM timed t LEFT JOIN fixed f USING (job_id, chunk_id) WHERE t.status = 'transcribed')"


@query("f6_text_precedence", with_views("timed", f"{PREFERRED} SELECT job_id, chunk_id, text FROM pref WHERE text <> ''"))
def f6(spark: SparkSession, sf: str) -> DataFrame:
    return C.preferred_text(timed(spark, sf), both_texts(spark, sf)).select("job_id", "chunk_id", "text")


@query("f7_speaker_audit", with_views("timed", f"{FIXED} SELECT job_id, count_if(contains(text, '[[SPEAKER]]') AND NOT contains(raw, '[[SPEAKER]]')) AS n_marked FROM fixed GROUP BY job_id"))
def f7(spark: SparkSession, sf: str) -> DataFrame:
    fixed = K.corrected_texts(answers(spark, sf), units(spark, sf)).select("job_id", "chunk_id", F.col("text").alias("fixed"))
    return K.speaker_marked(units(spark, sf).withColumnRenamed("text", "raw").join(fixed, ["job_id", "chunk_id"]))


# --- views of a job ------------------------------------------------------------------------------------

_LIVE = f", live AS (SELECT job_id AS doc_id, row_number() OVER (PARTITION BY job_id ORDER BY chunk_id) AS i, start_ms, end_ms, text FROM (SELECT job_id, chunk_id, start_ms, end_ms, CASE status WHEN 'failed' THEN '[TRANSCRIPTION FAILED]' WHEN 'transcribed' THEN {_TEXT} END AS text FROM timed) WHERE text <> '')"


def srt_sql(table: str) -> str:
    line = f"i || chr(10) || {sql_clock('start_ms', ',')} || ' --> ' || {sql_clock('end_ms', ',')} || chr(10) || text || chr(10)"
    return f"SELECT doc_id, md5(string_agg({line}, chr(10) ORDER BY i)) AS text FROM {table} GROUP BY doc_id"


@query("g9_live_captions", with_views("timed", f"{_LIVE} {srt_sql('live')}"))
def g9(spark: SparkSession, sf: str) -> DataFrame:
    return C.render_srt(C.live_captions(timed(spark, sf))).withColumn("text", F.md5("text"))


@query("g11_coverage", with_views("timed", "SELECT job_id AS doc_id, round(sum(end_ms - start_ms) / 1000.0::DOUBLE, 3) AS covered_sec, round(100 * sum(CASE WHEN status = 'transcribed' THEN end_ms - start_ms END) / max(m)::DOUBLE, 4) AS percent FROM (SELECT *, max(end_ms) OVER (PARTITION BY job_id) AS m FROM timed) WHERE status = 'transcribed' GROUP BY job_id"))
def g11(spark: SparkSession, sf: str) -> DataFrame:
    chunks = timed(spark, sf)
    length = chunks.groupBy(F.col("job_id").alias("doc_id")).agg((F.max("end_ms") / 1000).alias("duration_sec"))
    cues = C._as_cues(chunks.where("status = 'transcribed'").select("job_id", "chunk_id", "start_ms", "end_ms", "text"))
    return C.coverage(cues, length).select("doc_id", F.round("covered_sec", 3).alias("covered_sec"), F.round("percent", 4).alias("percent"))


def caption_build(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: one row a job with its captions as SRT, cue count and coverage."""
    chunks = timed(spark, sf)
    cues = C._as_cues(X.collect_entries(chunks).select("job_id", "chunk_id", "start_ms", "end_ms", "text"))
    counts = cues.groupBy("doc_id").agg(F.count("*").alias("n_cues"), F.round(F.sum(F.col("end_sec") - F.col("start_sec")), 3).alias("covered_sec"))
    return counts.join(C.render_srt(cues), "doc_id")


_ENTRIES = f", entries AS (SELECT job_id AS doc_id, row_number() OVER (PARTITION BY job_id ORDER BY chunk_id) AS i, start_ms, end_ms, {_TEXT} AS text FROM timed WHERE status = 'transcribed' AND {_TEXT} <> '')"


@query("caption_build", with_views("timed", f"{_ENTRIES} SELECT doc_id, n_cues, covered_sec, text FROM (SELECT doc_id, count(*) AS n_cues, round(sum(end_ms - start_ms) / 1000.0::DOUBLE, 3) AS covered_sec FROM entries GROUP BY doc_id) JOIN ({srt_sql('entries')}) USING (doc_id)"))
def caption_build_digest(spark: SparkSession, sf: str) -> DataFrame:
    return caption_build(spark, sf).withColumn("text", F.md5("text"))
