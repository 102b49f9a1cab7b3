"""Queries of scalar functions, sources and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import transcripts as X
from ..sources.catalog import classify
from ..sources.manifests import build_manifests
from ..sources.texts import with_text
from . import views as V
from .registry import query
from .views import with_views

# Java and RE2 write the class alike; SQL's text needs its quotes doubled only.
WS = T.WS
TRAILING = T.TRAILING.replace("'", "''")


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def dedup_sql(x: str) -> str:
    return f"replace(lower(regexp_replace({collapse_sql(x)}, '{TRAILING}', '')), 'ß', 'ss')"


def sql_clock(ms: str, point: str) -> str:
    return f"format('{{:02d}}:{{:02d}}:{{:02d}}{point}{{:03d}}', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query("t1_srt_timestamp", with_views("timed", f"SELECT job_id, chunk_id, {sql_clock('ms', ',')} AS stamp FROM (SELECT *, round_even(start_ms / 2000.0::DOUBLE * 1000, 0)::BIGINT AS ms FROM timed)"))
def t1(spark: SparkSession, sf: str) -> DataFrame:
    return V.timed_lines(spark, sf).select("job_id", "chunk_id", T.srt_timestamp(F.col("start_ms") / 2000.0).alias("stamp"))


@query("t2_format_hms", with_views("timed", f"SELECT job_id, chunk_id, {sql_clock('start_ms', '.')} AS a, {sql_clock('end_ms', '.')} AS b FROM timed"))
def t2(spark: SparkSession, sf: str) -> DataFrame:
    return V.timed_lines(spark, sf).select("job_id", "chunk_id", T.hms(F.col("start_ms") / 1000).alias("a"), T.hms(F.col("end_ms") / 1000).alias("b"))


@query("t3_parse_srt_timestamp", with_views("cues", f", s AS (SELECT doc_id, cue_idx, CASE WHEN cue_idx % 7 = 0 THEN 'x' ELSE '' END || {sql_clock('start_ms', ',')} AS t, start_ms FROM cues) SELECT doc_id, cue_idx, CASE WHEN cue_idx % 7 <> 0 THEN round(start_ms / 1000.0, 3)::DOUBLE END AS sec FROM s"))
def t3(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.concat(F.when(F.col("cue_idx") % 7 == 0, "x").otherwise(""), T.srt_timestamp(F.col("start_ms") / 1000))
    return V.cues(spark, sf).select("doc_id", "cue_idx", F.round(T.parse_srt_timestamp(stamp), 3).alias("sec"))


@query("t4_format_eta", with_views("timed", "SELECT job_id, chunk_id, CASE WHEN s >= 3600 THEN format('{:d}:{:02d}:{:02d}', s // 3600, s // 60 % 60, s % 60) ELSE format('{:d}:{:02d}', s // 60, s % 60) END AS eta FROM (SELECT *, greatest(round_even(start_ms / 1000.0::DOUBLE, 0), 0)::BIGINT AS s FROM timed)"))
def t4(spark: SparkSession, sf: str) -> DataFrame:
    return V.timed_lines(spark, sf).select("job_id", "chunk_id", T.format_eta(F.col("start_ms") / 1000).alias("eta"))


@query("t5_collapse", with_views("lines", f"SELECT job_id, chunk_id, {collapse_sql('text')} AS text FROM lines"))
def t5(spark: SparkSession, sf: str) -> DataFrame:
    return V.lines(spark, sf).select("job_id", "chunk_id", T.collapse(F.col("text")).alias("text"))


@query("t6_strip", f"SELECT doc_id, {strip_sql('chr(12288) || text || chr(10)')} AS text FROM documents")
def t6(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", T.strip(F.concat(F.lit("　"), F.col("text"), F.lit("\n"))).alias("text"))


@query("t7_cps", with_views("cues", "SELECT doc_id, cue_idx, round(length(text) / greatest((end_ms - start_ms) / 1000.0::DOUBLE, 1e-9), 6) AS cps FROM cues"))
def t7(spark: SparkSession, sf: str) -> DataFrame:
    return V.cues(spark, sf).select("doc_id", "cue_idx", F.round(T.cps(F.length("text"), (F.col("end_ms") - F.col("start_ms")) / 1000.0), 6).alias("cps"))


@query("a1_media_catalog", f"SELECT doc_id, suffix, suffix IN ({', '.join(repr(x) for x in ('wav', 'mp3', 'mkv', 'ts'))}) AS supported FROM (SELECT doc_id, lower(['WAV', 'mp3', 'Mkv', 'txt', 'srt', 'ts'][doc_id % 6 + 1]) AS suffix FROM documents)")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("WAV", "mp3", "Mkv", "txt", "srt", "ts")])
    files = V.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/media/"), F.col("source"), F.lit("/a.b."), names[(F.col("doc_id") % 6).cast("int")]).alias("path"))
    return classify(files).select("doc_id", "suffix", "supported")


@query("a2_job_key", "SELECT doc_id, k AS job_id, k[1:8] AS short_id FROM (SELECT doc_id, sha1(concat_ws('|', source, lang, n_chars)) AS k FROM documents)")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    key = (F.col("source"), F.col("lang"), F.col("n_chars"))
    return V.table(spark, sf, "documents").select("doc_id", T.job_key(*key).alias("job_id"), T.job_key(*key, short=True).alias("short_id"))


@query("a4_manifests", with_views("timed", "SELECT j.doc_id AS job_id, coalesce(CASE WHEN j.doc_id % 3 = 0 THEN 'orig/' || lang || '.m4a' END, source || '/x.wav') AS source_file, coalesce(CASE WHEN j.doc_id % 3 = 0 THEN 'orig/' || lang END, source || '/x') || '.srt' AS output_srt, count(chunk_id) AS n_chunks, string_agg(status, ',' ORDER BY chunk_id) AS statuses FROM documents j LEFT JOIN timed t ON t.job_id = j.doc_id GROUP BY ALL"))
def a4(spark: SparkSession, sf: str) -> DataFrame:
    docs = V.table(spark, sf, "documents")
    jobs = docs.select(F.col("doc_id").alias("job_id"), F.concat("source", F.lit("/x.wav")).alias("source_file"), F.lit("-").alias("source_mtime"), F.col("n_chars").alias("source_size"))
    prior = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("job_id"), F.concat(F.lit("orig/"), "lang", F.lit(".m4a")).alias("source_file"), F.lit("-").alias("source_mtime"), F.col("n_chars").alias("source_size"))
    out = build_manifests(jobs, V.timed_lines(spark, sf).select("job_id", "chunk_id", "status"), prior)
    return out.select("job_id", "source_file", "output_srt", F.when(F.col("chunks").isNull(), 0).otherwise(F.size("chunks")).cast("long").alias("n_chunks"), F.array_join("chunks.status", ",").alias("statuses"))


@query("a5_chunk_text", with_views("timed", f"SELECT job_id, chunk_id, CASE WHEN chunk_id % 4 = 0 THEN '' ELSE {collapse_sql('text')} END AS text FROM timed"))
def a5(spark: SparkSession, sf: str) -> DataFrame:
    chunks = V.timed_lines(spark, sf)
    texts = chunks.where("chunk_id % 4 <> 0").select("job_id", "chunk_id", F.lit("raw").alias("kind"), "text")
    return with_text(chunks, texts).select("job_id", "chunk_id", "text")


@query("a9_language_upsert", "SELECT doc_id, lang, 'old' AS version FROM documents WHERE lang NOT IN ('fr', 'de') OR lang IS NULL UNION ALL SELECT doc_id, lang, 'new' FROM documents WHERE lang IN ('fr', 'de') AND doc_id % 2 = 0")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "documents").select("doc_id", "lang")
    return E.upsert_by_language(rows.withColumn("version", F.lit("old")), rows.where("lang in ('fr', 'de') and doc_id % 2 = 0").withColumn("version", F.lit("new")))


@query("b6_quality_rules", "SELECT job_id, array_to_string(list_filter([CASE WHEN rate <> 16000 THEN 'sample rate is not 16000' END, CASE WHEN channels <> 1 THEN 'not mono' END, CASE WHEN d > 100 THEN 'duration differs from the source' END], lambda x: x IS NOT NULL), '; ') AS failures FROM (SELECT doc_id AS job_id, CASE WHEN doc_id % 5 = 0 THEN 44100 ELSE 16000 END AS rate, 1 + doc_id % 2 AS channels, n_chars % 200 AS d FROM documents) WHERE rate <> 16000 OR channels <> 1 OR d > 100")
def b6(spark: SparkSession, sf: str) -> DataFrame:
    meta = V.table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), F.when(F.col("doc_id") % 5 == 0, 44100).otherwise(16000).alias("rate"), (1 + F.col("doc_id") % 2).alias("channels"), (F.col("n_chars") % 200).alias("duration_sec"), F.lit(0).alias("source_duration_sec"))
    return X.quality_failures(meta, 100).select("job_id", F.array_join("failures", "; ").alias("failures"))


@query("b6_unknown_values", "SELECT doc_id AS job_id, 3 - (doc_id % 3 = 0)::INT - (doc_id % 2 = 0)::INT AS n_failures FROM documents")
def b6_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown rate, channels or duration break the rules; here a third know the rate, half the channels, none the duration."""
    known = lambda n, x: F.when(F.col("doc_id") % n == 0, x).cast("long")
    meta = V.table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), known(3, 16000).alias("rate"), known(2, 1).alias("channels"), F.lit(None).cast("double").alias("duration_sec"), F.lit(1.0).alias("source_duration_sec"))
    return X.quality_failures(meta).select("job_id", F.size("failures").alias("n_failures"))


@query("b6_chunk_duration", with_views("timed", "SELECT job_id, chunk_id FROM timed WHERE chunk_id % 3 <> 0"))
def b6_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Of every three chunks one was written whole, one is two milliseconds short, and of one the length is unknown."""
    rows = V.timed_lines(spark, sf).select("job_id", "chunk_id", (F.col("start_ms") * 16).alias("start_sample"), (F.col("end_ms") * 16).alias("end_sample"), (F.col("dur_ms") / 1000).alias("d"))
    rows = rows.withColumn("duration_sec", F.when(F.col("chunk_id") % 3 == 0, F.col("d")).when(F.col("chunk_id") % 3 == 1, F.col("d") - 0.002))
    return X.chunk_failures(rows).select("job_id", "chunk_id")


@query("b7_param_overlay", "SELECT doc_id AS job_id, CASE WHEN doc_id % 3 = 0 THEN 0.3 ELSE 0.5 END::DOUBLE AS threshold, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 2.0 ELSE 3.0 END::DOUBLE AS max_absorb_gap FROM documents")
def b7(spark: SparkSession, sf: str) -> DataFrame:
    jobs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"))
    own = jobs.where("job_id % 3 = 0").select("job_id", F.lit(0.3).alias("threshold"), F.when(F.col("job_id") % 2 == 0, -1.0).otherwise(2.0).alias("max_absorb_gap"))
    return X.overlay_params(jobs, own, {"threshold": 0.5, "max_absorb_gap": 3.0})


@query("d1_plain_prompt", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Transcribe this audio.' ELSE 'language: ' || lang END AS prompt FROM documents")
def d1(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", T.plain_prompt(F.when(F.col("doc_id") % 4 == 0, "auto").otherwise(F.col("lang"))).alias("prompt"))


TEMPLATE = "{{language_hint}}{{vocabulary}}Before: {{context}}\n{{context}}"
_BLOCK = "'Vocabulary (proper nouns/terms that may appear):' || chr(10) || '- ' || source || chr(10) || '- {{context}}' || chr(10) || chr(10)"


@query("d2_template_prompt", f"SELECT doc_id, replace(CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'language: ' || lang || chr(10) || chr(10) END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_BLOCK} END || 'Before: {{{{context}}}}' || chr(10) || '{{{{context}}}}', '{{{{context}}}}', text) AS prompt FROM documents".replace("{{{{", "{{").replace("}}}}", "}}"))
def d2(spark: SparkSession, sf: str) -> DataFrame:
    """The whole text is the context."""
    terms = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(" "))).otherwise(F.array("source", F.lit(" "), F.lit("{{context}}")))
    return V.table(spark, sf, "documents").select("doc_id", T.template_prompt(F.lit(TEMPLATE), F.col("text"), F.when(F.col("doc_id") % 4 == 0, "auto").otherwise(F.col("lang")), terms).alias("prompt"))


_SETTINGS = "'temperature', 1.0::DOUBLE, '{p}', 0.95::DOUBLE, '{k}', 64, '{m}', 4096"
_CHAT = "json_object('model', lang, 'messages', json_array(json_object('role', 'user', 'content', json_array(json_object('type', 'text', 'text', text), json_object('type', 'input_audio', 'input_audio', json_object('data', to_base64(encode(text)), 'format', 'wav'))))), " + _SETTINGS.format(p="top_p", k="top_k", m="max_tokens") + "{extra})::VARCHAR"
_GEMINI = "json_object('contents', json_array(json_object('parts', json_array(json_object('text', text), json_object('inline_data', json_object('mime_type', 'audio/wav', 'data', to_base64(encode(text))))))), 'generationConfig', json_object(" + _SETTINGS.format(p="topP", k="topK", m="maxOutputTokens") + "))::VARCHAR"
_QUIET = ", 'chat_template_kwargs', json_object('enable_thinking', false)"


@query("d3_request_payload", f"SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN {_GEMINI} WHEN 1 THEN {_CHAT.format(extra='')} ELSE {_CHAT.format(extra=_QUIET)} END) AS payload FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def d3(spark: SparkSession, sf: str) -> DataFrame:
    """Whole payloads of both providers; the text's bytes stand for the audio."""
    docs = V.table(spark, sf, "documents").where("text is not null and lang is not null")
    sound, turn = F.col("text").cast("binary"), F.col("doc_id") % 3
    chat = lambda thinking: T.chat_payload(F.col("lang"), F.col("text"), sound, thinking=thinking)
    payload = F.when(turn == 0, T.gemini_payload(F.col("text"), sound)).when(turn == 1, chat(True)).otherwise(chat(False))
    return docs.select("doc_id", F.md5(payload).alias("payload"))


@query("d3_text_payload", "SELECT doc_id, md5(json_object('messages', json_array(json_object('role', 'system', 'content', 'Translate to ' || lang), json_object('role', 'user', 'content', text)), 'chat_template_kwargs', json_object('enable_thinking', false))::VARCHAR) AS payload FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def d3_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = V.table(spark, sf, "documents").where("text is not null and lang is not null")
    return docs.select("doc_id", F.md5(T.text_payload(F.concat(F.lit("Translate to "), "lang"), F.col("text"))).alias("payload"))


@query("d3_correction_payload", """SELECT doc_id, md5('{"messages":' || json_array(json_object('role', 'system', 'content', 'Correct ' || lang), json_object('role', 'user', 'content', text))::VARCHAR
|| ',"temperature":0.5,"top_p":0.8,"top_k":20,"presence_penalty":1.0,"repetition_penalty":1.0,"max_tokens":512,"stop":["</OUTPUT>"],"chat_template_kwargs":{"enable_thinking":false}}') AS payload FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""")
def d3_correction(spark: SparkSession, sf: str) -> DataFrame:
    docs = V.table(spark, sf, "documents").where("text is not null and lang is not null")
    return docs.select("doc_id", F.md5(T.correction_payload(F.concat(F.lit("Correct "), "lang"), F.col("text"), temperature=0.5)).alias("payload"))


@query("d5_response_text", "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN text END AS answer FROM documents")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    gemini = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct("text")).alias("parts")).alias("content"))).alias("candidates")))
    provider = F.when(F.col("doc_id") % 2 == 0, "gemini").otherwise("local")
    raw = F.when(F.col("doc_id") % 5 == 0, "{}").when(provider == "gemini", gemini).otherwise(chat)
    return V.table(spark, sf, "documents").select("doc_id", T.response_text(raw, provider).alias("answer"))


@query("d6_asr_parse", f"SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '?' ELSE lang END AS language, CASE WHEN doc_id % 9 = 0 THEN {strip_sql('text')} ELSE {strip_sql('text')} || '<asr_text>' || chr(12288) || 'x' END AS text FROM documents")
def d6(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 9 == 0, F.col("text")).otherwise(F.concat(F.lit("language "), F.col("lang"), F.lit("<asr_text> "), T.strip(F.col("text")), F.lit("<asr_text>　x ")))
    return V.table(spark, sf, "documents").select("doc_id", T.asr_language(raw).alias("language"), T.asr_text(raw).alias("text"))


def units_sql(table: str) -> str:
    """CTE ``units(text, unit)`` of the texts of ``table`` that repeat a unit five times: RE2 has no back-references, so by comparing substrings.

    Where a unit of k characters stands five times, 4 * k >= 8 characters in a row equal those k further on, so some of them are four at a
    place that four divides. Only texts and k with such a place are looked at in full.
    """
    return f""", near AS (SELECT text, k FROM (SELECT text, unnest(range(4, length(text) - 3, 4)) AS p FROM (SELECT DISTINCT text FROM {table})), range(2, 21) u(k) WHERE substr(text, p, 4) = substr(text, p + k, 4) GROUP BY ALL),
units AS (SELECT text, min_by(substr(text, p, k), p * 100 + k) AS unit FROM (SELECT text, k, unnest(range(1, length(text) - 5 * k + 2)) AS p FROM near) WHERE substr(text, p, 5 * k) = repeat(substr(text, p, k), 5) GROUP BY text)"""


@query("d7_repetition", with_views("lines", ", rep AS (SELECT job_id, chunk_id, CASE WHEN chunk_id % 5 = 0 THEN text || repeat(substr(text, 1, 7), 5) ELSE text END AS text FROM lines)" + units_sql("rep") + " SELECT job_id, chunk_id, unit FROM rep JOIN units USING (text)"))
def d7(spark: SparkSession, sf: str) -> DataFrame:
    """Whole lines; every fifth ends with its beginning, five times."""
    text = F.when(F.col("chunk_id") % 5 == 0, F.concat("text", F.repeat(F.substring("text", 1, 7), 5))).otherwise(F.col("text"))
    return V.lines(spark, sf).select("job_id", "chunk_id", T.repetition(text).alias("unit")).where("unit is not null")


@query("d7_repetition_whole", with_views("lines", units_sql("lines") + " SELECT job_id, chunk_id, unit FROM lines JOIN units USING (text)"))
def d7_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Repetition in all lines as they are."""
    return V.lines(spark, sf).select("job_id", "chunk_id", T.repetition(F.col("text")).alias("unit")).where("unit is not null")


@query("d8_dedup_form", with_views("lines", f"SELECT job_id, chunk_id, {dedup_sql('text')} AS form FROM lines"))
def d8(spark: SparkSession, sf: str) -> DataFrame:
    return V.lines(spark, sf).select("job_id", "chunk_id", T.dedup_form(F.col("text")).alias("form"))


@query("i1_cer_form", f"SELECT doc_id, regexp_replace(text, '[{WS[1:-1]}\\p{{P}}]', '', 'g') AS form FROM documents")
def i1(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", T.cer_form(F.col("text")).alias("form"))


_NORM = "regexp_replace({}, '[\\s\\p{{P}}]', '', 'g')"
# DuckDB's edit distance counts bytes, so the characters of a pair (at most 43 different ones at any scale) are numbered and written as one byte each.
_BYTES = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
_ASCII = "translate({0}, array_to_string(list_distinct(string_split({1} || {2}, '')), ''), '" + _BYTES + "')"
_CER = "CASE WHEN length({0}) = 0 THEN CASE WHEN length({1}) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(" + _ASCII.format("{0}", "{0}", "{1}") + ", " + _ASCII.format("{1}", "{0}", "{1}") + ") / length({0})::DOUBLE END"
PAIRED = f", norm AS (SELECT *, {_NORM.format('ref')} AS r, {_NORM.format('hyp_auto')} AS a, {_NORM.format('hyp_hinted')} AS h FROM evals), paired AS (SELECT sample_id, lang_id, {_CER.format('ref', 'hyp_auto')} AS auto_raw, {_CER.format('r', 'a')} AS auto_norm, {_CER.format('ref', 'hyp_hinted')} AS hinted_raw, {_CER.format('r', 'h')} AS hinted_norm FROM norm)"
_RATES = ("auto_raw", "auto_norm", "hinted_raw", "hinted_norm")


@query("i2_cer", with_views("evals", f"SELECT sample_id, round({_CER.format('ref', 'hyp_auto')}, 6) AS cer FROM evals"))
def i2(spark: SparkSession, sf: str) -> DataFrame:
    return V.evals(spark, sf).select("sample_id", F.round(T.cer(F.col("ref"), F.col("hyp_auto")), 6).alias("cer"))


@query("i3_paired_cer", with_views("evals", f"{PAIRED} SELECT sample_id, lang_id, {', '.join(f'round({r}, 6) AS {r}' for r in _RATES)} FROM paired"))
def i3(spark: SparkSession, sf: str) -> DataFrame:
    return E.paired_cer(V.evals(spark, sf)).select("sample_id", "lang_id", *[F.round(r, 6).alias(r) for r in _RATES])


@query("i4_mean_cer", with_views("evals", f"{PAIRED} SELECT lang_id, count(*) AS n, {', '.join(f'round(avg({r}), 6) AS {r}' for r in _RATES)} FROM paired GROUP BY ROLLUP (lang_id)"))
def i4(spark: SparkSession, sf: str) -> DataFrame:
    return E.mean_cer(E.paired_cer(V.evals(spark, sf))).select("lang_id", "n", *[F.round(r, 6).alias(r) for r in _RATES])


@query("i5_misdetections", "SELECT code, count(*) AS n, count_if(name IS NOT NULL AND lower(name) <> lower(detected)) AS n_wrong, count_if(name IS NULL) AS n_unmapped FROM (SELECT ['ko', 'ja', 'zh', 'xx'][doc_id % 4 + 1] AS code, ['Korean', 'japanese', 'Chinese', 'Korean', NULL][doc_id % 5 + 1] AS d, coalesce(d, '') AS detected, CASE code WHEN 'ko' THEN 'Korean' WHEN 'ja' THEN 'Japanese' WHEN 'zh' THEN 'Chinese' END AS name FROM documents) GROUP BY code")
def i5(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda xs: F.array(*[F.lit(x) for x in xs])
    rows = V.table(spark, sf, "documents").select(pick(("ko", "ja", "zh", "xx"))[(F.col("doc_id") % 4).cast("int")].alias("code"), pick(("Korean", "japanese", "Chinese", "Korean", None))[(F.col("doc_id") % 5).cast("int")].alias("detected"))
    return E.misdetections(rows, spark.createDataFrame(list(E.LANGUAGE_NAMES.items()), "code string, name string"))

