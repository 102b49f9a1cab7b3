"""Captions: SRT parsing and rendering, checks, speaker cues, long-cue splitting, views of a job's captions.

Cues are rows ``(doc_id, cue_idx, start_sec, end_sec, text)``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import TIMING, collapse, cps, srt_timestamp, strip
from ..params import CueParams
from .transcripts import drop_overlaps

FAILED_TEXT = "[TRANSCRIPTION FAILED]"
# Where a long cue may be cut, in order of preference.
SENTENCE_END, SOFT_PUNCTUATION = ".!?。！？…", ",、，·:;：；"


def by_cue() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("cue_idx")


def parse_srt(docs: DataFrame, preserve_newlines: bool = False) -> DataFrame:
    """Cues of ``docs(doc_id, text)``: blocks between blank lines, timing on the first line that has it, text after it.

    Blocks without timing or text are skipped. A separator line that holds spaces doesn't part blocks, so
    the next cue's lines become text.
    """
    blocks = docs.select("doc_id", F.posexplode(F.split(strip(F.col("text")), r"\r?\n\r?\n")).alias("block", "body"))
    lines = F.filter(F.split("body", r"\R|[\x{1c}-\x{1e}]"), lambda x: strip(x) != "")
    rows = blocks.select("doc_id", "block", lines.alias("lines"))
    rows = rows.withColumn("at", F.array_position(F.transform("lines", lambda x: x.rlike(TIMING)), True).cast("int")).where("at > 0")
    timing = F.element_at("lines", F.col("at"))
    g = lambda i: F.regexp_extract(timing, TIMING, i).cast("long")
    sec = lambda i: g(i) * 3600 + g(i + 1) * 60 + g(i + 2) + g(i + 3) / 1000
    rest = F.slice("lines", F.col("at") + 1, F.size("lines"))
    text = strip(F.array_join(rest, "\n")) if preserve_newlines else collapse(F.array_join(rest, " "))
    out = rows.select("doc_id", "block", sec(1).alias("start_sec"), sec(5).alias("end_sec"), text.alias("text")).where("text <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("block"))
    return out.select("doc_id", number.alias("cue_idx"), "start_sec", "end_sec", "text")


def _joined(rows: DataFrame, block: Column, separator: str) -> DataFrame:
    """One row a document: its blocks in order of ``i``."""
    ordered = F.sort_array(F.collect_list(F.struct("i", block.alias("block"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), separator).alias("text"))


def render_srt(cues: DataFrame) -> DataFrame:
    """One SRT text a document, numbered from 1 in cue order."""
    rows = cues.withColumn("i", F.row_number().over(by_cue()))
    block = F.concat(F.col("i").cast("string"), F.lit("\n"), srt_timestamp(F.col("start_sec")), F.lit(" --> "), srt_timestamp(F.col("end_sec")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _joined(rows, block, "\n")


def order_violations(cues: DataFrame, strict: bool = False) -> DataFrame:
    """Cues that end before they start or start before the one before ends (1e-6 s of tolerance); an error if strict and there are any."""
    rows = cues.withColumn("prev_end", F.lag("end_sec", 1, -1.0).over(by_cue()))
    bad = rows.where((F.col("end_sec") < F.col("start_sec")) | (F.col("start_sec") < F.col("prev_end") - 1e-6))
    if strict and not bad.isEmpty():
        raise ValueError("cues are not monotonic")
    return bad


def coverage(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """Per document: covered seconds and their percentage of ``durations(doc_id, duration_sec)`` (0 if unknown)."""
    sums = cues.groupBy("doc_id").agg(F.sum(F.col("end_sec") - F.col("start_sec")).alias("covered_sec"))
    share = F.when(F.col("duration_sec") > 0, 100 * F.col("covered_sec") / F.col("duration_sec")).otherwise(0.0)
    return sums.join(durations, "doc_id", "left").select("doc_id", "covered_sec", share.alias("percent"))


# --- splitting -----------------------------------------------------------------------------------------


def allocate(pieces: DataFrame, keys: list[str], gap: float, min_duration: float | None = None, max_duration: float | None = None) -> DataFrame:
    """Times of ``pieces(keys, k, piece, start_sec, end_sec)`` by share of characters: adds piece_start, piece_end.

    Shares are clamped to the bounds and scaled back to the whole; all but the last end ``gap`` earlier
    (0.01 s after their start at least), the last at the cue's end.
    """
    cue = Window.partitionBy(*keys)
    upto = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    n, total = F.length("piece"), F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0.0))
    rows = pieces.withColumn("_all", F.greatest(F.sum(n).over(cue), F.lit(1)))
    share = total * (n / F.col("_all"))
    if max_duration:
        share = F.least(share, F.lit(float(max_duration)))
    if min_duration:
        share = F.greatest(share, F.lit(float(min_duration)))
    rows = rows.withColumn("_share", share).withColumn("_sum", F.sum("_share").over(cue))
    rows = rows.withColumn("_dur", F.col("_share") * F.when(F.col("_sum") > 0, total / F.col("_sum")).otherwise(1.0))
    rows = rows.withColumns({"_stop": F.col("start_sec") + F.sum("_dur").over(upto), "_last": F.col("k") == F.max("k").over(cue)})
    start = F.col("_stop") - F.col("_dur")
    shown = F.greatest(start + 0.01, F.col("_stop") - gap) if gap > 0 else F.col("_stop")
    return rows.withColumns({"piece_start": start, "piece_end": F.when(F.col("_last"), F.col("end_sec")).otherwise(shown)}).drop("_all", "_share", "_sum", "_dur", "_stop", "_last")


def speaker_pieces(text: Column) -> Column:
    """Turns of a text with speaker markers: trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, r"\[\[SPEAKER\]\]"), strip), lambda x: x != "")


def speaker_cues(cues: DataFrame, gap: float = 0.08, label: str | None = None) -> DataFrame:
    """One cue a speaker turn, the time shared by characters; ``label`` (with one %d for the turn) stands before the text."""
    keys = ["doc_id", "cue_idx"]
    rows = cues.select(*keys, "start_sec", "end_sec", F.posexplode(speaker_pieces(F.col("text"))).alias("k", "piece"))
    out = allocate(rows, keys, gap)
    text = F.concat(F.format_string(label, F.col("k") + 1), F.col("piece")) if label else F.col("piece")
    return out.select(*keys, "k", F.col("piece_start").alias("start_sec"), F.col("piece_end").alias("end_sec"), text.alias("text"))


def split_limit(n: Column, duration: Column, p: CueParams) -> Column:
    """Most characters that a piece may have by the triggers that fire; null if the cue stays whole (so with a duration of 0).

    Durations count in whole microseconds, since the difference of two times in seconds is mostly a little off, and a limit is rounded down.
    """
    duration = F.round(duration, 6)
    rate = n / duration
    options = []
    if p.cps_threshold:
        options.append(F.when(rate > p.cps_threshold, F.greatest(F.lit(1), F.floor(p.cps_threshold * duration))))
    if p.max_duration:
        options.append(F.when(duration > p.max_duration, F.greatest(F.lit(1), F.floor(rate * p.max_duration))))
    if p.max_chars:
        options.append(F.when(n > p.max_chars, F.lit(p.max_chars)))
    least = F.least(*options) if len(options) > 1 else options[0] if options else F.lit(None)
    return F.when((duration > 0) & (n > 0), least.cast("int"))


def _break(text: str, limit: int) -> int:
    """Where to cut: after the last sentence end, else soft punctuation, else white space in the last three fifths, else at the limit."""
    low = max(1, int(limit * 0.4))
    for good in (SENTENCE_END.__contains__, SOFT_PUNCTUATION.__contains__, str.isspace):
        for i in range(min(limit, len(text) - 1), low - 1, -1):
            if good(text[i]):
                return i + 1
    return limit


def _split(text: pd.Series, limit: pd.Series) -> pd.Series:
    def one(t: str, most: int) -> list[str]:
        rest, out = t.strip(), []
        while len(rest) > most:
            at = _break(rest, most)
            out.append(rest[:at].strip())
            rest = rest[at:].strip()
        return [x for x in [*out, rest] if x]

    return pd.Series([one(t, max(1, int(m))) for t, m in zip(text, limit, strict=True)], dtype=object)


def split_pieces(text: Column, limit: Column) -> Column:
    """Texts cut into pieces of at most ``limit`` characters (one more where a break falls there)."""
    # Else Spark, which infers a filter on the pieces from their explode, would split every cue twice.
    return F.pandas_udf(_split, "array<string>").asNondeterministic()(text, limit)


def split_long_cues(cues: DataFrame, p: CueParams = CueParams()) -> DataFrame:
    """Cues cut by reading speed, duration and length; only cues that a trigger hits reach Python."""
    keys = ["doc_id", "cue_idx"]
    rows = cues.withColumn("text", strip(F.col("text"))).where("text <> ''")
    rows = rows.withColumn("most", split_limit(F.length("text"), F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0.0)), p))
    whole = rows.where("most is null").withColumn("pieces", F.array("text"))
    cut = rows.where("most is not null").withColumn("pieces", split_pieces(F.col("text"), F.col("most")))
    pieces = whole.unionByName(cut).select(*keys, "start_sec", "end_sec", F.posexplode("pieces").alias("k", "piece"))
    out = allocate(pieces, keys, p.gap, p.min_duration, p.max_duration)
    return out.select(*keys, "k", F.col("piece_start").alias("start_sec"), F.col("piece_end").alias("end_sec"), F.col("piece").alias("text"))


def split_report(cues: DataFrame, pieces: DataFrame, p: CueParams = CueParams()) -> DataFrame:
    """Cues that were split: pieces, characters a second, and why."""
    counts = pieces.groupBy("doc_id", "cue_idx").agg(F.count("*").alias("n_pieces")).where("n_pieces > 1")
    duration, n = F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(1e-9)), F.length("text")
    rate = cps(n, duration)
    tenth = lambda x: F.floor(x * 10 + 0.5) / 10
    reasons = []
    if p.cps_threshold:
        reasons.append(F.when(rate > p.cps_threshold, F.format_string("CPS %.1f > %s", tenth(rate), F.lit(f"{p.cps_threshold:g}"))))
    if p.max_duration:
        reasons.append(F.when(duration > p.max_duration, F.format_string("duration %.1fs > %ss", tenth(duration), F.lit(str(p.max_duration)))))
    if p.max_chars:
        reasons.append(F.when(n > p.max_chars, F.format_string("chars %d > %d", n, F.lit(p.max_chars))))
    why = F.array_join(F.array_compact(F.array(*reasons)), ", ")
    why = F.when(why == "", F.format_string("CPS %.1f", tenth(rate))).otherwise(why)
    return cues.join(counts, ["doc_id", "cue_idx"]).select("doc_id", "cue_idx", "n_pieces", rate.alias("cps"), why.alias("reasons"))


def renumber(pieces: DataFrame) -> DataFrame:
    """Pieces (doc_id, cue_idx, k) as cues numbered through a document."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("cue_idx", "k"))
    return pieces.select("doc_id", number.alias("cue_idx"), "start_sec", "end_sec", "text")


def postprocess_srt(docs: DataFrame, p: CueParams = CueParams()) -> DataFrame:
    """SRT texts with their long cues split: parse, split, render."""
    return render_srt(renumber(split_long_cues(parse_srt(docs), p)))


# --- views of a job -------------------------------------------------------------------------------------


def _as_cues(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("job_id").alias("doc_id"), F.col("chunk_id").alias("cue_idx"), (F.col("start_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"), "text")


def live_captions(chunks: DataFrame) -> DataFrame:
    """Cues of a running job: a placeholder for failed chunks, chunks not reached left out, overlaps dropped."""
    text = F.when(F.col("status") == "failed", FAILED_TEXT).when(F.col("status") == "transcribed", collapse(F.coalesce("text", F.lit(""))))
    entries = chunks.withColumn("text", text).where("text <> ''").select("job_id", "chunk_id", "start_ms", "end_ms", "text")
    return _as_cues(drop_overlaps(entries))


def preferred_text(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """Transcribed chunks with their corrected text, else the raw one; an existing but blank corrected text wins, and blank chunks go."""
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("text"))).alias(kind)
    both = texts.groupBy("job_id", "chunk_id").agg(pick("fixed"), pick("raw"))
    rows = chunks.where("status = 'transcribed'").drop("text").join(both, ["job_id", "chunk_id"], "left")
    text = F.coalesce(strip(F.col("fixed")), collapse(F.col("raw")), F.lit(""))
    return rows.withColumn("text", text).drop("fixed", "raw").where("text <> ''")


def final_captions(chunks: DataFrame, texts: DataFrame, gap: float = 0.08) -> DataFrame:
    """Cues of a finished job: corrected text by speaker turn, a placeholder for failed chunks; numbered through."""
    failed = chunks.where("status = 'failed'").withColumn("text", F.lit(FAILED_TEXT))
    cols = ["job_id", "chunk_id", "start_ms", "end_ms", "text"]
    return renumber(speaker_cues(_as_cues(preferred_text(chunks, texts).select(*cols).union(failed.select(*cols))), gap))

