"""Queries of SRT parsing, cue splitting and the translation round trip over the cues view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPEAKER, WS, collapse, translation_prompt
from ..operators import captions as C
from ..operators import translation as H
from ..params import CueParams
from . import views as V
from .registry import query
from .scalar_queries import collapse_sql, sql_clock, strip_sql
from .transcript_queries import PREFERRED, both_texts, timed, written_chunks
from .views import with_views

#: Cue limits with and without a bound of characters.
SHORT, NO_CHARS = CueParams(max_chars=40), CueParams(max_chars=None)


def cues(spark: SparkSession, sf: str) -> DataFrame:
    return V.cues(spark, sf).select("doc_id", "cue_idx", (F.col("start_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"), "text")


# --- SRT -----------------------------------------------------------------------------------------------

_CUE_LINES = f"cue_idx || chr(10) || {sql_clock('start_ms', ',')} || ' --> ' || {sql_clock('end_ms', ',')} || chr(10) || text || chr(10)"
SRT = f", srt AS (SELECT doc_id, string_agg({_CUE_LINES}, chr(10) ORDER BY cue_idx) AS text FROM cues GROUP BY doc_id)"
_STAMP = r"(\d+):(\d{2}):(\d{2}),(\d{3})"
_LINE = rf"{_STAMP}\s*-->\s*{_STAMP}"


def _sec(i: int) -> str:
    g = lambda k: f"regexp_extract(t, '{_LINE}', {k})::BIGINT"
    return f"{g(i)} * 3600 + {g(i + 1)} * 60 + {g(i + 2)} + {g(i + 3)} / 1000.0::DOUBLE"


def _parsed(body: str) -> str:
    return f"""{SRT}, b AS (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS body FROM (SELECT doc_id, string_split_regex({strip_sql('text')}, '\\r?\\n\\r?\\n') AS l FROM srt)),
n AS (SELECT doc_id, k, list_filter(string_split_regex(body, '\\r\\n|[\\n\\r]'), lambda x: {strip_sql('x')} <> '') AS l FROM b), m AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(x, '{_LINE}')), TRUE) AS p FROM n),
parsed AS (SELECT doc_id, k, l[p] AS t, {body} AS text FROM m WHERE p > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS cue_idx, round({_sec(1)}, 3) AS start_sec, round({_sec(5)}, 3) AS end_sec, text FROM parsed WHERE text <> ''"""


#: Added before rounding, so that times which are exact in binary never lie on a rounding boundary.
NUDGE = 1.7e-8


def _nudged(column: str) -> Column:
    return F.round(F.col(column) + NUDGE, 7)


def _times(df: DataFrame) -> DataFrame:
    return df.withColumns({"start_sec": _nudged("start_sec"), "end_sec": _nudged("end_sec")})


def _rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    return df.withColumns({"start_sec": F.round("start_sec", digits), "end_sec": F.round("end_sec", digits)})


@query("a7_srt_parse", with_views("cues", _parsed(collapse_sql("array_to_string(l[p + 1:], ' ')"))))
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(C.parse_srt(C.render_srt(cues(spark, sf))))


@query("a7_srt_parse_lines", with_views("cues", _parsed(strip_sql("array_to_string(l[p + 1:], chr(10))"))))
def a7_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(C.parse_srt(C.render_srt(cues(spark, sf)), preserve_newlines=True))


@query("a8_srt_render", with_views("cues", f"{SRT} SELECT doc_id, text FROM srt"))
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return C.render_srt(cues(spark, sf))


# --- speaker cues ----------------------------------------------------------------------------------------

_PIECES = f", p AS (SELECT doc_id, cue_idx, start_ms, end_ms, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS piece FROM (SELECT *, list_filter(list_transform(string_split(replace(text, '. ', '.[[SPEAKER]]'), '[[SPEAKER]]'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS l FROM cues))"


def times_sql(pieces: str, keys: str, lo: str = "", hi: str = "") -> str:
    """Allocation of time by characters over a table of pieces with start and end in milliseconds."""
    share = "greatest(end_ms - start_ms, 0) / 1000.0::DOUBLE * (length(piece) / greatest(sum(length(piece)) OVER (PARTITION BY {0}), 1)::DOUBLE)".format(keys)
    share = f"least({share}, {hi}::DOUBLE)" if hi else share
    share = f"greatest({share}, {lo}::DOUBLE)" if lo else share
    return f"""w AS (SELECT *, {share} AS share FROM {pieces}), d AS (SELECT *, sum(share) OVER (PARTITION BY {keys}) AS total FROM w),
x AS (SELECT *, share * CASE WHEN total > 0 THEN greatest(end_ms - start_ms, 0) / 1000.0::DOUBLE / total ELSE 1.0 END AS dur FROM d),
y AS (SELECT *, start_ms / 1000.0::DOUBLE + sum(dur) OVER (PARTITION BY {keys} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop, k = max(k) OVER (PARTITION BY {keys}) AS last FROM x),
timed_pieces AS (SELECT *, round(stop - dur + {NUDGE}, 7) AS start_sec, round(CASE WHEN last THEN end_ms / 1000.0::DOUBLE ELSE greatest(stop - dur + 0.01, stop - 0.08) END + {NUDGE}, 7) AS end_sec FROM y)"""


def marked(spark: SparkSession, sf: str) -> DataFrame:
    return cues(spark, sf).withColumn("text", F.replace(F.col("text"), F.lit(". "), F.lit("." + SPEAKER)))


@query("g1_speaker_split", with_views("cues", f"{_PIECES} SELECT doc_id, cue_idx, k, piece FROM p"))
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return marked(spark, sf).select("doc_id", "cue_idx", F.posexplode(C.speaker_pieces(F.col("text"))).alias("k", "piece")).withColumn("k", F.col("k").cast("long"))


@query("g5_time_allocation", with_views("cues", f"{_PIECES}, {times_sql('p', 'doc_id, cue_idx', '1.0', '2.5')} SELECT doc_id, cue_idx, k, start_sec, end_sec FROM timed_pieces"))
def g5(spark: SparkSession, sf: str) -> DataFrame:
    pieces = marked(spark, sf).select("doc_id", "cue_idx", "start_sec", "end_sec", F.posexplode(C.speaker_pieces(F.col("text"))).alias("k", "piece"))
    out = C.allocate(pieces, ["doc_id", "cue_idx"], 0.08, 1.0, 2.5)
    return out.select("doc_id", "cue_idx", F.col("k").cast("long").alias("k"), _nudged("piece_start").alias("start_sec"), _nudged("piece_end").alias("end_sec"))


@query("g6_speaker_cues", with_views("cues", f"{_PIECES}, {times_sql('p', 'doc_id, cue_idx')} SELECT doc_id, cue_idx, k, start_sec, end_sec, '화자' || (k + 1) || ': ' || piece AS text FROM timed_pieces"))
def g6(spark: SparkSession, sf: str) -> DataFrame:
    return _times(C.speaker_cues(marked(spark, sf), label="화자%d: ")).withColumn("k", F.col("k").cast("long"))


# --- long cues --------------------------------------------------------------------------------------------


def _limit_sql(p: CueParams) -> str:
    dur, n = "(greatest(end_ms - start_ms, 0) / 1000.0::DOUBLE)", "length(text)"
    parts = [
        f"CASE WHEN {n} / {dur} > {p.cps_threshold}::DOUBLE THEN greatest(1, floor({p.cps_threshold}::DOUBLE * {dur})::INT) END",
        f"CASE WHEN {dur} > {p.max_duration}::DOUBLE THEN greatest(1, floor({n} / {dur} * {p.max_duration}::DOUBLE)::INT) END",
        *([f"CASE WHEN {n} > {p.max_chars} THEN {p.max_chars} END"] if p.max_chars else []),
    ]
    return f"CASE WHEN {dur} > 0 AND {n} > 0 THEN least({', '.join(parts)}) END"


def _windows(chars: str) -> str:
    return f"nullif(length(regexp_extract(rem, '(?s)^.{{' || greatest(1, (mx * 2) // 5) || ',' || mx || '}}{chars}')), 0)"


def split_sql(p: CueParams) -> str:
    """CTEs up to ``pieces(doc_id, cue_idx, k, piece, start_ms, end_ms)``: cues with their limit, then cut after cut."""
    return f""", c AS (SELECT doc_id, cue_idx, start_ms, end_ms, {collapse_sql('text')} AS text FROM cues), t AS (SELECT *, {_limit_sql(p)} AS mx FROM c WHERE text <> ''), r AS (
  SELECT doc_id, cue_idx, start_ms, end_ms, 0 AS k, NULL::VARCHAR AS piece, text AS rem, mx FROM t
  UNION ALL
  SELECT doc_id, cue_idx, start_ms, end_ms, k + 1, trim(substr(rem, 1, cut), E' \\n\\t'), trim(substr(rem, cut + 1), E' \\n\\t'), mx
  FROM (SELECT *, CASE WHEN mx IS NULL OR length(rem) <= mx THEN length(rem) ELSE coalesce({_windows('[.!?。！？…]')}, {_windows('[,、，·:;：；]')}, {_windows(chr(92) + 's')}, mx) END AS cut FROM r WHERE rem <> '')),
pieces AS (SELECT doc_id, cue_idx, start_ms, end_ms, k, piece FROM r WHERE k > 0 AND piece <> '')"""


def plain_cues(spark: SparkSession, sf: str) -> DataFrame:
    return cues(spark, sf).withColumn("text", collapse(F.col("text")))


@query("g4_split_limits", with_views("cues", f", c AS (SELECT doc_id, cue_idx, start_ms, end_ms, {collapse_sql('text')} AS text FROM cues) SELECT doc_id, cue_idx, {_limit_sql(SHORT)} AS most FROM c"))
def g4(spark: SparkSession, sf: str) -> DataFrame:
    return plain_cues(spark, sf).select("doc_id", "cue_idx", C.split_limit(F.length("text"), F.col("end_sec") - F.col("start_sec"), SHORT).alias("most"))


@query("g3_long_split", with_views("cues", f"RECURSIVE{split_sql(SHORT)} SELECT doc_id, cue_idx, row_number() OVER (PARTITION BY doc_id, cue_idx ORDER BY k) - 1 AS k, piece FROM pieces"))
def g3(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_long_cues(plain_cues(spark, sf), SHORT).select("doc_id", "cue_idx", F.col("k").cast("long").alias("k"), F.col("text").alias("piece"))


@query("g7_long_cue_split", with_views("cues", f"RECURSIVE{split_sql(NO_CHARS)}, {times_sql('pieces', 'doc_id, cue_idx', hi='7.0')} SELECT doc_id, cue_idx, row_number() OVER (PARTITION BY doc_id, cue_idx ORDER BY k) - 1 AS k, start_sec, end_sec, piece AS text FROM timed_pieces"))
def g7(spark: SparkSession, sf: str) -> DataFrame:
    return _times(C.split_long_cues(plain_cues(spark, sf), NO_CHARS)).withColumn("k", F.col("k").cast("long"))


@query("g8_postprocess_counts", with_views("cues", f"RECURSIVE{split_sql(SHORT)} SELECT doc_id, count(DISTINCT cue_idx) AS n_in, count(*) AS n_out FROM pieces GROUP BY doc_id"))
def g8(spark: SparkSession, sf: str) -> DataFrame:
    out = C.parse_srt(C.postprocess_srt(C.render_srt(cues(spark, sf)), SHORT)).groupBy("doc_id").agg(F.count("*").alias("n_out"))
    return C.parse_srt(C.render_srt(cues(spark, sf))).groupBy("doc_id").agg(F.count("*").alias("n_in")).join(out, "doc_id").select("doc_id", "n_in", "n_out")


@query("g8_split_report", with_views("cues", f"""RECURSIVE{split_sql(SHORT)} SELECT doc_id, cue_idx, n_pieces, round(length(text) / d, 5) AS cps, array_to_string(list_filter([CASE WHEN length(text) / d > 15 THEN printf('CPS %.1f > 15', floor(length(text) / d * 10 + 0.5) / 10) END, CASE WHEN d > 7 THEN printf('duration %.1fs > 7.0s', floor(d * 10 + 0.5) / 10) END, CASE WHEN length(text) > 40 THEN printf('chars %d > 40', length(text)) END], lambda x: x IS NOT NULL), ', ') AS reasons
FROM (SELECT doc_id, cue_idx, text, greatest(end_ms / 1000.0::DOUBLE - start_ms / 1000.0::DOUBLE, 1e-9) AS d FROM t) JOIN (SELECT doc_id, cue_idx, count(*) AS n_pieces FROM pieces GROUP BY ALL HAVING count(*) > 1) USING (doc_id, cue_idx)"""))
def g8_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = plain_cues(spark, sf)
    return C.split_report(rows, C.split_long_cues(rows, SHORT), SHORT).withColumn("cps", F.round("cps", 5))


_FINAL = f"{PREFERRED}, a AS (SELECT job_id, chunk_id, start_ms, end_ms, text FROM pref WHERE text <> '' UNION ALL SELECT job_id, chunk_id, start_ms, end_ms, '[TRANSCRIPTION FAILED]' FROM timed WHERE status = 'failed'), p AS (SELECT job_id AS doc_id, chunk_id AS cue_idx, start_ms, end_ms, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS piece FROM (SELECT *, list_filter(list_transform(string_split(text, '[[SPEAKER]]'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS l FROM a))"


@query("g10_final_captions", with_views("timed", f"{_FINAL}, {times_sql('p', 'doc_id, cue_idx')} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY cue_idx, k) AS cue_idx, start_sec, end_sec, piece AS text FROM timed_pieces"))
def g10(spark: SparkSession, sf: str) -> DataFrame:
    chunks = written_chunks(spark, sf)
    return _times(C.final_captions(chunks, both_texts(spark, sf, chunks)))


# --- translation -------------------------------------------------------------------------------------------

NUM = ", num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cue_idx) AS serial FROM cues)"
_MARKERS = "string_agg(format('[{{:04d}}]|', serial) || text, chr(10) ORDER BY serial)".replace("{{", "{").replace("}}", "}")
#: Marker text as it comes back from outside: digits spaced out (with spaces of several kinds) or full-width, line breaks lost, every seventh cue gone.
MANGLED = ", mangled AS (SELECT doc_id, 'intro ' || string_agg(CASE WHEN serial % 3 = 0 THEN '[' || substr(m, 1, 2) || chr(12288) || substr(m, 3) || ' ]' || chr(160) || '|' ELSE '[' || m || ']|' END || text || CASE WHEN serial % 2 = 0 THEN '' ELSE chr(10) END, '' ORDER BY serial) AS text FROM (SELECT *, CASE WHEN serial % 5 = 1 THEN translate(format('{:04d}', serial), '0123456789', '０１２３４５６７８９') ELSE format('{:04d}', serial) END AS m FROM num WHERE serial % 7 <> 0) GROUP BY doc_id)"


def mangled(spark: SparkSession, sf: str) -> DataFrame:
    rows = H.numbered(V.cues(spark, sf)).where("serial % 7 <> 0").withColumn("m", F.format_string("%04d", "serial"))
    rows = rows.withColumn("m", F.when(F.col("serial") % 5 == 1, F.translate("m", "0123456789", "０１２３４５６７８９")).otherwise(F.col("m")))
    mark = F.when(F.col("serial") % 3 == 0, F.concat(F.lit("["), F.substring("m", 1, 2), F.lit("\u3000"), F.expr("substring(m, 3)"), F.lit(" ]\u00a0|"))).otherwise(F.concat(F.lit("["), "m", F.lit("]|")))
    part = F.concat(mark, "text", F.when(F.col("serial") % 2 == 0, "").otherwise("\n"))
    ordered = F.sort_array(F.collect_list(F.struct("serial", part.alias("part"))))
    return rows.groupBy("doc_id").agg(F.concat(F.lit("intro "), F.array_join(F.transform(ordered, lambda x: x["part"]), "")).alias("text"))


_MARK = r"\[WS*(?:\p{Nd}WS*){4,}\]WS*\|".replace("WS", WS)
PARSED = f"{NUM}{MANGLED}, marks AS (SELECT doc_id, regexp_extract_all(text, '{_MARK}') AS ms, string_split_regex(text, '{_MARK}')[2:] AS ts FROM mangled), parsed AS (SELECT doc_id, serial, max_by(text, pos) AS text FROM (SELECT doc_id, generate_subscripts(ms, 1) AS pos, translate(regexp_replace(unnest(ms), '\\P{{Nd}}', '', 'g'), '{''.join(H.DIGITS)}', '{H.ASCII_DIGITS}')::BIGINT AS serial, {strip_sql('unnest(ts)')} AS text FROM marks) GROUP BY doc_id, serial)"


@query("h1_serial_numbers", with_views("cues", f"{NUM} SELECT doc_id, cue_idx, serial FROM num"))
def h1(spark: SparkSession, sf: str) -> DataFrame:
    return H.numbered(V.cues(spark, sf)).select("doc_id", "cue_idx", "serial")


@query("h2_marker_render", with_views("cues", f"{NUM} SELECT doc_id, {_MARKERS} AS text FROM num GROUP BY doc_id"))
def h2(spark: SparkSession, sf: str) -> DataFrame:
    return H.render_markers(H.numbered(V.cues(spark, sf)))


@query("h3_translated_render", with_views("cues", f"{PARSED} SELECT doc_id, {_MARKERS} AS text FROM parsed GROUP BY doc_id"))
def h3(spark: SparkSession, sf: str) -> DataFrame:
    return H.render_markers(H.parse_markers(mangled(spark, sf)))


@query("h4_marker_parse", with_views("cues", f"{PARSED} SELECT doc_id, serial, text FROM parsed"))
def h4(spark: SparkSession, sf: str) -> DataFrame:
    return H.parse_markers(mangled(spark, sf))


_BATCHED = f"{NUM}, n AS (SELECT doc_id, serial::BIGINT AS serial, (length(format('[{{:04d}}]|', serial) || text) + 1)::BIGINT AS len FROM num), r AS (SELECT doc_id, serial, 1 AS batch_id, len AS cur FROM n WHERE serial = 1 UNION ALL SELECT n.doc_id, n.serial, CASE WHEN r.cur + n.len > 1000 THEN r.batch_id + 1 ELSE r.batch_id END, CASE WHEN r.cur + n.len > 1000 THEN n.len ELSE r.cur + n.len END FROM r JOIN n ON n.doc_id = r.doc_id AND n.serial = r.serial + 1)"


@query("h5_batches", with_views("cues", f"RECURSIVE{_BATCHED} SELECT doc_id, serial, batch_id FROM r"))
def h5(spark: SparkSession, sf: str) -> DataFrame:
    return H.batches(V.cues(spark, sf), 1000)


@query("h6_translation_prompt", "SELECT doc_id, 'Translate to ' || lang || '.' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Vocabulary (proper nouns/terms that may appear):' || chr(10) || '- ' || source || chr(10) || chr(10) END AS prompt FROM documents")
def h6(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))
    return V.table(spark, sf, "documents").select("doc_id", translation_prompt(F.lit("Translate to {{target_language}}.\n{{vocabulary}}"), F.col("lang"), terms).alias("prompt"))


@query("h7_batched_translation", with_views("cues", f"{NUM} SELECT doc_id, serial, {strip_sql('text')} AS text FROM num"))
def h7(spark: SparkSession, sf: str) -> DataFrame:
    """The identity as model."""
    return H.translate(V.cues(spark, sf), 1000, lambda text: text)


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return H.merge_translation(V.cues(spark, sf), H.parse_markers(mangled(spark, sf)))


_MERGED = f"{PARSED}, joined AS (SELECT n.doc_id, n.cue_idx, n.start_ms, n.end_ms, n.serial, coalesce(p.text, n.text) AS text, p.text IS NOT NULL AS matched FROM num n LEFT JOIN parsed p ON p.doc_id = n.doc_id AND p.serial = n.serial)"


@query("h8_translation_merge", with_views("cues", f"{_MERGED} SELECT * FROM joined"))
def h8(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf)


@query("h9_merge_report", with_views("cues", f"{_MERGED} SELECT doc_id, count(*) AS n_cues, count_if(matched) AS n_matched, coalesce(string_agg(CASE WHEN NOT matched THEN serial END, ',' ORDER BY serial), '') AS missing FROM joined GROUP BY doc_id"))
def h9(spark: SparkSession, sf: str) -> DataFrame:
    return H.merge_report(merged(spark, sf)).withColumn("missing", F.array_join(F.transform("missing", lambda x: x.cast("string")), ","))


@query("h10_reanchor", with_views("cues", f"{_MERGED} SELECT doc_id, start_ms, end_ms, text FROM joined"))
def h10(spark: SparkSession, sf: str) -> DataFrame:
    return H.reanchor(V.cues(spark, sf), mangled(spark, sf)).select("doc_id", "start_ms", "end_ms", "text")


