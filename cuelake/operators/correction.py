"""Full-context text correction: groups of chunks, their transcript block, messages and answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPEAKER, collapse, tagged_output
from ..sources.board import RunBoard
from .folds import ordered_fold
from .transcripts import CALLED, ModelCall, asked_on


def context_groups(chunks: DataFrame, max_chars: int = 60_000, groups: int = 3) -> DataFrame:
    """(job_id, chunk_id, group_id) of ``chunks(job_id, chunk_id, text)``: one group up to ``max_chars``, else at most ``groups`` contiguous ones.

    A group closes once it holds total/groups characters. The fold sees chunk ids and lengths only, and
    only of jobs above the limit.
    """
    job = Window.partitionBy("job_id")
    sizes = chunks.select("job_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.length(collapse(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    sizes = sizes.withColumns({"total": F.sum("n").over(job), "count": F.count("*").over(job)})
    long = (F.col("total") > max_chars) & (F.col("count") > 1)

    def step(state: tuple | None, n: int, total: int) -> tuple[tuple, int]:
        group, held = state or (1, None)
        if held is not None and held >= total / groups and group < groups:
            group, held = group + 1, None
        return (group, (held or 0) + n), group

    folded = ordered_fold(sizes.where(long), "job_id", "chunk_id", ["n", "total"], "group_id", step)
    return sizes.where(~long).select("job_id", "chunk_id", F.lit(1).cast("long").alias("group_id")).union(folded)


def transcript_blocks(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """One block a (job, group) with all its chunk texts; its own table, joined to chunks only for the model map."""
    line = F.concat(F.col("chunk_id").cast("string"), F.lit(" "), collapse(F.coalesce("text", F.lit(""))))
    rows = chunks.join(groups, ["job_id", "chunk_id"]).withColumn("line", line)
    ordered = F.sort_array(F.collect_list(F.struct("chunk_id", "line")))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return rows.groupBy("job_id", "group_id").agg(F.concat(F.lit("<FULL_TRANSCRIPT>\n"), text, F.lit("\n</FULL_TRANSCRIPT>")).alias("block"))


def correction_requests(chunks: DataFrame, groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(job_id, group_id, chunk_id, request): the block, then the chunk to correct, as text and in no order. To call a model, ``correction_map`` needs none of these rows."""
    own = F.concat(F.lit("\n\n<CURRENT>\n"), F.col("chunk_id").cast("string"), F.lit(" "), collapse(F.coalesce("text", F.lit(""))), F.lit("\n</CURRENT>"))
    rows = chunks.join(groups, ["job_id", "chunk_id"]).join(blocks, ["job_id", "group_id"])
    return rows.select("job_id", "group_id", "chunk_id", F.concat("block", own).alias("request"))


def correction_map(chunks: DataFrame, groups: DataFrame, blocks: DataFrame, call: ModelCall, retries: int = 1, board: RunBoard | None = None, run_chunks: int = 50) -> DataFrame:
    """The model called on every chunk's request: job_id, chunk_id and what ``model_map`` tells, ``board`` included.

    The chunks of a group are cut into runs of ``run_chunks`` neighbours, and the block goes once to each run; so a long job is spread over tasks, and
    calls with one block still follow each other in the order of chunks. A request is put together only for its call: no
    block is copied into the rows of its chunks. Runs are streamed one after the other, each a block and then its chunks, so many short jobs cost no call of Python each.
    """
    own = F.concat(F.lit("\n\n<CURRENT>\n"), F.col("chunk_id").cast("string"), F.lit(" "), collapse(F.coalesce("text", F.lit(""))), F.lit("\n</CURRENT>"))
    place = F.row_number().over(Window.partitionBy("job_id", "group_id").orderBy("chunk_id")) - 1
    rows = chunks.join(groups, ["job_id", "chunk_id"]).select("job_id", "group_id", F.floor(place / run_chunks).alias("run"), F.col("chunk_id").cast("long").alias("chunk_id"), own.alias("own"))
    runs = groups.groupBy("job_id", "group_id").agg(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.count("*") - 1) / run_chunks))).alias("run"))

    # Renaming to the same names gives columns of their own: blocks come from the same chunks.
    spread = blocks.toDF(*blocks.columns).join(runs.toDF(*runs.columns), ["job_id", "group_id"])
    key, kind = ["job_id", "group_id", "run"], chunks.schema["job_id"].dataType.simpleString()
    heads = spread.select(*key, F.lit(True).alias("head"), F.lit(0).cast("long").alias("chunk_id"), F.col("block").alias("text"))
    ordered = heads.union(rows.toDF(*rows.columns).select(*key, F.lit(False), "chunk_id", "own")).repartition(*key).sortWithinPartitions(*key, F.desc("head"), "chunk_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = block = None
        for pdf in batches:
            out = []
            for j, g, r, head, c, text in zip(*[pdf[n].tolist() for n in (*key, "head", "chunk_id", "text")], strict=True):
                if head:
                    at, block = (j, g, r), text
                elif at == (j, g, r):
                    out.append((j, c, *asked_on(board, block + text, call, retries)))
            if out:
                yield pd.DataFrame(out, columns=["job_id", "chunk_id", "ok", "raw", "error", "attempts", "elapsed_ms"])
        if board:
            board.tell(last=True)

    return ordered.mapInPandas(run, f"job_id {kind}, chunk_id long, {CALLED}")


def corrected_texts(answers: DataFrame, chunks: DataFrame, allow_unclosed: bool = False) -> DataFrame:
    """``kind = 'fixed'`` texts of ``answers(job_id, chunk_id, raw)``; an answer without tagged text (or none) leaves the chunk's own."""
    rows = answers.select("job_id", "chunk_id", F.coalesce("raw", F.lit("")).alias("raw")).join(chunks.select("job_id", "chunk_id", collapse(F.coalesce("text", F.lit(""))).alias("own")), ["job_id", "chunk_id"])
    return rows.select("job_id", "chunk_id", F.lit("fixed").alias("kind"), tagged_output(F.col("raw"), F.col("own"), allow_unclosed).alias("text"))


def speaker_marked(texts: DataFrame) -> DataFrame:
    """Per job: corrected chunks with speaker markers that the raw text lacks. ``texts(job_id, chunk_id, raw, fixed)``."""
    return texts.groupBy("job_id").agg(F.count_if(F.col("fixed").contains(SPEAKER) & ~F.col("raw").contains(SPEAKER)).alias("n_marked"))
