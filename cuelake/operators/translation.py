"""Translation round trip: serial numbers, marker text, batches, model map, merge.

Cues are rows ``(doc_id, cue_idx, text, ...)``; translated text is a long table ``(doc_id, serial, text)``.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, strip
from ..sources.board import RunBoard
from .folds import ordered_fold
from .transcripts import ModelCall, model_map

#: A marker, also where digits were spaced out; digits and spaces are Unicode's, spelled out since Java's ``\\d`` and ``\\s`` are ASCII only.
MARKER = r"\[WS*(?:\p{Nd}WS*){4,}\]WS*\|".replace("WS", WS)
#: All decimal digits but 0 to 9, and what they are.
DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in DIGITS)


def numbered(cues: DataFrame) -> DataFrame:
    """Cues with ``serial`` from 1."""
    return cues.withColumn("serial", F.row_number().over(Window.partitionBy("doc_id").orderBy("cue_idx")).cast("long"))


def render_markers(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``rows(keys, serial, text)`` as marker text, one row a key, ordered by serial."""
    ordered = F.sort_array(F.collect_list(F.struct("serial", F.format_string("[%04d]|%s", "serial", "text").alias("line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def parse_markers(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, serial, text) of marker text: markers may stand anywhere, text before the first is dropped, of equal serials the last wins.

    Markers of a number beyond 63 bits are no cue's, and their text is dropped.
    """
    marks = F.regexp_extract_all("text", F.lit(f"({MARKER})"), F.lit(1))
    texts = F.slice(F.split("text", MARKER), 2, F.greatest(F.size(marks), F.lit(1)))
    rows = docs.where(F.size(marks) > 0).select(*keys, F.posexplode(F.arrays_zip(marks.alias("mark"), texts.alias("body"))).alias("pos", "x"))
    serial = F.translate(F.regexp_replace("x.mark", r"\P{Nd}", ""), "".join(DIGITS), ASCII_DIGITS).try_cast("long")
    rows = rows.select(*keys, "pos", serial.alias("serial"), strip(F.col("x.body")).alias("text")).where("serial is not null")
    return rows.groupBy(*keys, "serial").agg(F.max_by("text", "pos").alias("text"))


def batches(cues: DataFrame, max_chars: int) -> DataFrame:
    """(doc_id, serial, batch_id): cues in order, a new batch where the rendered text would pass ``max_chars``; an oversize cue is alone.

    The fold sees serials and lengths only.
    """
    sizes = numbered(cues).select("doc_id", "serial", (F.length(F.format_string("[%04d]|%s", "serial", "text")) + 1).cast("long").alias("n"))

    def step(state: tuple | None, n: int) -> tuple[tuple, int]:
        batch, held = state or (1, 0)
        if held and held + n > max_chars:
            batch, held = batch + 1, 0
        return (batch, held + n), batch

    return ordered_fold(sizes, "doc_id", "serial", ["n"], "batch_id", step)


def translate_batches(cues: DataFrame, max_chars: int, call: ModelCall, retries: int = 1, board: RunBoard | None = None) -> DataFrame:
    """One call a batch: doc_id, batch_id and what ``model_map`` tells; failed and stopped batches are told too. Write it before using it twice."""
    rows = numbered(cues).select("doc_id", "serial", "text").join(batches(cues, max_chars), ["doc_id", "serial"])
    requests = render_markers(rows, ("doc_id", "batch_id")).withColumnRenamed("text", "request")
    return model_map(requests, ["doc_id", "batch_id"], call, retries, board)


def translated(answers: DataFrame) -> DataFrame:
    """(doc_id, serial, text) of the batches that were answered; of serials that several batches return the later batch wins."""
    parsed = parse_markers(answers.where("ok").select("doc_id", "batch_id", F.col("raw").alias("text")), ("doc_id", "batch_id"))
    return parsed.groupBy("doc_id", "serial").agg(F.max_by("text", "batch_id").alias("text"))


def translate(cues: DataFrame, max_chars: int, call: ModelCall) -> DataFrame:
    """(doc_id, serial, text) from the model; ``translate_batches`` also tells which batches failed."""
    return translated(translate_batches(cues, max_chars, call))


def merge_translation(cues: DataFrame, translated: DataFrame) -> DataFrame:
    """Cues with their translated text where there is one; adds serial and ``matched``. Times stay."""
    new = translated.select("doc_id", "serial", F.col("text").alias("_new"))
    rows = numbered(cues).join(new, ["doc_id", "serial"], "left")
    return rows.select(*cues.columns[:1], *[c for c in cues.columns[1:] if c != "text"], "serial", F.coalesce("_new", "text").alias("text"), F.col("_new").isNotNull().alias("matched"))


def merge_report(merged: DataFrame) -> DataFrame:
    """Per document: cues, matched ones, and the serials without translation."""
    missing = F.array_sort(F.collect_list(F.when(~F.col("matched"), F.col("serial"))))
    return merged.groupBy("doc_id").agg(F.count("*").alias("n_cues"), F.count_if("matched").alias("n_matched"), missing.alias("missing"))


def reanchor(cues: DataFrame, edited: DataFrame) -> DataFrame:
    """Cues with the texts of edited marker text; serials that are gone keep theirs."""
    return merge_translation(cues, parse_markers(edited))
