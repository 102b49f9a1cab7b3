"""Temporal segmentation: frames to speech segments to bounded chunks.

Times are integer milliseconds (``start_ms``, ``end_ms``) or frames; every window is partitioned by ``job_id``.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import hms
from ..params import VadParams


def by_time() -> WindowSpec:
    return Window.partitionBy("job_id").orderBy("start_ms")


def framed(samples: DataFrame, window: int, context: int) -> DataFrame:
    """``samples(job_id, samples)`` cut into zero-padded windows, each after the last ``context`` samples before it (zeros at first): job_id, frame_idx, frame."""
    n = F.ceil(F.size("samples") / window).cast("int")
    pad = F.concat(F.array_repeat(F.lit(0.0).cast("float"), context), "samples", F.array_repeat(F.lit(0.0).cast("float"), n * window - F.size("samples")))
    cut = lambda i: F.slice("padded", i * window + 1, window + context)
    rows = samples.where(F.size("samples") > 0).select("job_id", n.alias("n"), pad.alias("padded"))
    return rows.select("job_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), cut)).alias("frame_idx", "frame"))


def framed_blocks(blocks: DataFrame, block_size: int, window: int, context: int) -> DataFrame:
    """``framed`` over ``blocks(job_id, block_idx, samples)`` of ``block_size`` samples each (a job's last may be shorter): job_id, frame_idx, frame.

    A window belongs to the block of its first sample. Each block gets the last ``context`` samples of the block before it and the first
    ``window`` - 1 of the one after it by equi joins of those edges, so no row is longer than a block with its edges, and a long recording is
    spread over all tasks.
    """
    if not max(window, context) <= block_size:
        raise ValueError("a block must hold a window and its context")
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    own = blocks.where(F.size("samples") > 0).select("job_id", F.col("block_idx").cast("long").alias("block_idx"), F.transform("samples", lambda x: x.cast("float")).alias("samples"))
    tail = F.slice("samples", F.greatest(F.size("samples") - context + 1, F.lit(1)), context)
    before = own.select("job_id", (F.col("block_idx") + 1).alias("block_idx"), tail.alias("before"))
    after = own.select("job_id", (F.col("block_idx") - 1).alias("block_idx"), F.slice("samples", 1, window - 1).alias("after"))
    rows = own.join(before, ["job_id", "block_idx"], "left").join(after, ["job_id", "block_idx"], "left")
    held = F.coalesce("before", zeros(F.lit(0)))
    strip = F.concat(zeros(F.lit(context) - F.size(held)), held, "samples", F.coalesce("after", zeros(F.lit(0))), zeros(F.lit(window)))
    first = F.ceil(F.col("block_idx") * block_size / window)  # the first window that begins in the block
    at = (first * window - F.col("block_idx") * block_size).cast("int")
    count = F.floor((F.size("samples") - 1 - at) / window).cast("int") + 1
    frames = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("strip", F.col("at") + i * window + 1, window + context))
    cut = rows.where(F.size("samples") > at).select("job_id", first.alias("first"), at.alias("at"), strip.alias("strip"), "samples", "block_idx")
    return cut.select("job_id", "first", F.posexplode(frames).alias("i", "frame")).select("job_id", (F.col("first") + F.col("i")).alias("frame_idx"), "frame")


#: Scores the next frames of a job: (frames, state) to (probabilities, state); the state is None at a job's first frames.
FrameScorer = Callable[[pd.DataFrame, Any], tuple[pd.Series, Any]]


def score_frames(frames: DataFrame, scorer: FrameScorer) -> DataFrame:
    """``frames(job_id, frame_idx, frame)`` with ``prob``; the injected scorer sees a job's frames in order, some at a time, with the state it gave back last.

    Frames are dealt by job, sorted, and streamed: a scorer call holds the part of a job that lies in one Arrow batch, never a recording.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, state, begun = None, None, False
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf["job_id"]
            new = (ids != ids.shift()) & ~(ids.isna() & ids.shift().isna())
            probs = []
            for _, part in pdf.groupby(new.cumsum(), sort=False):
                own = part["job_id"].iloc[0]
                if not begun or not (own == job or (pd.isna(own) and pd.isna(job))):
                    job, state, begun = own, None, True
                prob, state = scorer(part, state)
                probs.append(pd.Series(prob).astype("float64"))
            yield pd.DataFrame({"job_id": ids.to_numpy(), "frame_idx": pdf["frame_idx"].to_numpy(), "prob": pd.concat(probs).to_numpy()})

    kind = frames.schema["job_id"].dataType.simpleString()
    ordered = frames.select("job_id", F.col("frame_idx").cast("long").alias("frame_idx"), "frame").repartition("job_id").sortWithinPartitions("job_id", "frame_idx")
    return ordered.mapInPandas(run, f"job_id {kind}, frame_idx long, prob double")


def threshold_islands(frames: DataFrame, threshold: float | Column = 0.5, frame_ms: int = 500, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs of frames with prob >= threshold as segments; ``extra_keys`` join the job as a key."""
    keys = [*extra_keys, "job_id"]
    speech = frames.where(F.col("prob") >= threshold)
    island = F.col("frame_idx") - F.row_number().over(Window.partitionBy(*keys).orderBy("frame_idx"))
    runs = speech.withColumn("island", island).groupBy(*keys, "island").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    return runs.select(*keys, (F.col("a") * frame_ms).alias("start_ms"), ((F.col("b") + 1) * frame_ms).alias("end_ms"))


def threshold_sweep(frames: DataFrame, thresholds: list[float], frame_ms: int = 500) -> DataFrame:
    """Segments at each of a few thresholds in one pass: every frame meets the thresholds that it reaches."""
    each = F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("prob") >= t))
    return threshold_islands(frames.select("job_id", "frame_idx", "prob", each.alias("threshold")), F.col("threshold"), frame_ms, ("threshold",))


def merge_silences(segments: DataFrame, min_silence: int) -> DataFrame:
    """Joins neighbours whose gap is at most ``min_silence``; the end is the last one's."""
    gap = F.col("start_ms") - F.lag("end_ms").over(by_time())
    island = F.sum(F.when(gap > min_silence, 1).otherwise(0)).over(by_time())
    return segments.withColumn("island", island).groupBy("job_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "start_ms").alias("end_ms")).drop("island")


def _absorb(rows: list[tuple[int, int]], min_speech: int, cap: int | None) -> list[tuple[int, int]]:
    """The fold of one island (segments in order): a heap of short segments over a linked list.

    A segment that can't be absorbed leaves the heap, and comes back when a neighbour of its changes. Entries of
    segments that are gone or have another length by now are passed over.
    """
    start, end = [s for s, _ in rows], [e for _, e in rows]
    n = len(rows)
    left, right, gone = list(range(-1, n - 1)), [*range(1, n), -1], [False] * n
    heap: list[tuple[int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] - start[i] < min_speech:
            heapq.heappush(heap, (end[i] - start[i], i))

    for i in range(n):
        offer(i)
    while heap:
        length, i = heapq.heappop(heap)
        if gone[i] or end[i] - start[i] != length:
            continue
        sides = [(start[i] - end[left[i]], 0, left[i])] if left[i] >= 0 else []
        sides += [(start[right[i]] - end[i], 1, right[i])] if right[i] >= 0 else []
        if not sides:
            break
        gap, _, other = min(sides)
        if cap is not None and gap > cap:
            continue
        first, second = min(i, other), max(i, other)
        end[first], gone[second], right[first] = max(end[first], end[second]), True, right[second]
        if right[second] >= 0:
            left[right[second]] = first
        for k in (left[first], first, right[first]):
            offer(k)
    return [(start[i], end[i]) for i in range(n) if not gone[i]]


def absorb_short(segments: DataFrame, min_speech: int, max_absorb_gap: int | None) -> DataFrame:
    """Segments shorter than ``min_speech`` join the nearer neighbour (the earlier on a tie) unless it is farther than the cap.

    No merge crosses a gap above the cap, so a job falls into independent islands at such gaps. Islands of
    one segment or without a short one pass by; only the others are folded, one island a group.
    """
    gap = F.col("start_ms") - F.lag("end_ms").over(by_time())
    island = F.sum(F.when(gap > max_absorb_gap, 1).otherwise(0)).over(by_time()) if max_absorb_gap is not None else F.lit(0)
    own = Window.partitionBy("job_id", "island")
    rows = segments.select("job_id", "start_ms", "end_ms", island.alias("island"))
    rows = rows.withColumns({"n": F.count("*").over(own), "shortest": F.min(F.col("end_ms") - F.col("start_ms")).over(own)})
    loop = (F.col("n") > 1) & (F.col("shortest") < min_speech)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Islands come whole and one after the other; only one is held."""
        at, held = None, []

        def done() -> list[tuple]:
            return [(at[0], s, e) for s, e in _absorb(held, min_speech, max_absorb_gap)] if held else []

        for pdf in batches:
            out: list[tuple] = []
            for job, own, start, end in zip(*[pdf[c].tolist() for c in ("job_id", "island", "start_ms", "end_ms")], strict=True):
                if (job, own) != at:
                    out += done()
                    at, held = (job, own), []
                held.append((start, end))
            yield pd.DataFrame(out, columns=["job_id", "start_ms", "end_ms"])
        yield pd.DataFrame(done(), columns=["job_id", "start_ms", "end_ms"])

    kind = segments.schema["job_id"].dataType.simpleString()
    dealt = rows.where(loop).select("job_id", "island", "start_ms", "end_ms").repartition("job_id", "island").sortWithinPartitions("job_id", "island", "start_ms")
    folded = dealt.mapInPandas(fold, f"job_id {kind}, start_ms long, end_ms long")
    return rows.where(~loop).select("job_id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms")).union(folded)


def force_split(segments: DataFrame, max_chunk: int) -> DataFrame:
    """Cuts segments longer than ``max_chunk`` at fixed steps; a whole multiple leaves no empty rest."""
    length = F.col("end_ms") - F.col("start_ms")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(length / max_chunk) - 1, F.lit(0)).cast("long")))
    rows = segments.select("job_id", "start_ms", "end_ms", k.alias("k"))
    start = F.col("start_ms") + F.col("k") * max_chunk
    return rows.select("job_id", start.alias("start_ms"), F.least(start + max_chunk, F.col("end_ms")).alias("end_ms"))


def merge_stages(frames: DataFrame, p: VadParams, frame_ms: int = 500) -> dict[str, DataFrame]:
    """All stages from frames to final segments, in their fixed order."""
    raw = threshold_islands(frames, p.threshold, frame_ms)
    silence = merge_silences(raw, p.min_silence)
    absorbed = absorb_short(silence, p.min_speech, p.max_absorb_gap)
    return {"raw": raw, "after_silence_merge": silence, "after_short_absorb": absorbed, "final": force_split(absorbed, p.max_chunk)}


def segment_stats(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Per job: count and lengths of segments, short ones, gaps (leading and trailing too), gaps of at most a second. ``durations(job_id, duration_ms)``."""
    gap = F.col("start_ms") - F.lag("end_ms", 1, 0).over(by_time())
    length = F.col("end_ms") - F.col("start_ms")
    small = lambda g: (g > 0) & (g <= 1000)
    sums = segments.withColumns({"gap": gap, "length": length}).groupBy("job_id").agg(
        F.count("*").alias("n_segments"), F.min("length").alias("min_ms"), F.max("length").alias("max_ms"), F.avg("length").alias("avg_ms"),
        F.count_if(F.col("length") < 1000).alias("n_short"), F.count_if(small(F.col("gap"))).alias("inner_gaps"), F.max("end_ms").alias("last_ms"),
    )
    tail = F.col("duration_ms") - F.col("last_ms")
    return sums.join(durations, "job_id").select("job_id", "n_segments", "min_ms", "max_ms", "avg_ms", "n_short", (F.col("n_segments") + 1).alias("n_gaps"), (F.col("inner_gaps") + F.when(small(tail), 1).otherwise(0)).alias("n_short_gaps"))


def merge_stats(stages: dict[str, DataFrame], durations: DataFrame, max_chunk: int) -> DataFrame:
    """Per job: segments of each stage, forced splits, final segments a minute (0 for a job without duration)."""
    names = list(stages)
    rows = None
    for n, df in stages.items():
        one = df.select("job_id", F.lit(n).alias("stage"), (F.col("end_ms") - F.col("start_ms")).alias("length"))
        rows = one if rows is None else rows.union(one)
    counts = [F.count_if(F.col("stage") == n).alias(n) for n in names]
    split = F.count_if((F.col("stage") == "after_short_absorb") & (F.col("length") > max_chunk)).alias("n_force_split")
    per_minute = F.when(F.col("duration_ms") > 0, F.col("final") / (F.col("duration_ms") / 60000.0)).otherwise(0.0)
    return rows.groupBy("job_id").agg(*counts, split).join(durations, "job_id").select("job_id", *names, "n_force_split", per_minute.alias("per_minute"))


def over_limit(segments: DataFrame, limit_ms: int = 30_000) -> DataFrame:
    """Segments longer than the limit."""
    return segments.where(F.col("end_ms") - F.col("start_ms") > limit_ms)


def chunk_offsets(segments: DataFrame, totals: DataFrame, rate: int = 16_000) -> DataFrame:
    """Chunk rows of final segments: id, file name, sample offsets clamped to ``totals(job_id, n_samples)``, the offset forms, duration and status."""
    rows = segments.join(totals, "job_id").withColumn("chunk_id", F.row_number().over(by_time()))
    rows = rows.withColumns({
        "start_sample": F.greatest(F.lit(0), F.bround(F.col("start_ms") / 1000 * rate)).cast("long"),
        "end_sample": F.least(F.col("n_samples"), F.bround(F.col("end_ms") / 1000 * rate)).cast("long"),
    })
    start, end = F.col("start_sample") / rate, F.col("end_sample") / rate
    return rows.select(
        "job_id", "chunk_id", F.format_string("chunks/chunk_%04d.wav", "chunk_id").alias("file"), hms(start).alias("start"), hms(end).alias("end"),
        F.bround(start, 3).alias("start_sec"), F.bround(end, 3).alias("end_sec"), F.bround((F.col("end_sample") - F.col("start_sample")) / rate, 3).alias("duration_sec"),
        "start_sample", "end_sample", F.lit("vad_extracted").alias("status"),
    )


def slice_samples(blocks: DataFrame, chunks: DataFrame, block_size: int) -> DataFrame:
    """Samples of each chunk from a block table ``blocks(job_id, block_idx, samples)``: chunks meet the blocks they overlap by an equi join."""
    first, last = F.floor(F.col("start_sample") / block_size), F.floor((F.col("end_sample") - 1) / block_size)
    wanted = chunks.where("end_sample > start_sample").select("job_id", "chunk_id", "start_sample", "end_sample", F.explode(F.sequence(first, last)).alias("block_idx"))
    begin = F.greatest(F.col("start_sample") - F.col("block_idx") * block_size, F.lit(0))
    stop = F.least(F.col("end_sample") - F.col("block_idx") * block_size, F.size("samples").cast("long"))
    part = F.slice("samples", (begin + 1).cast("int"), F.greatest(stop - begin, F.lit(0)).cast("int"))
    parts = wanted.join(blocks, ["job_id", "block_idx"]).select("job_id", "chunk_id", "block_idx", part.alias("part"))
    ordered = F.sort_array(F.collect_list(F.struct("block_idx", "part")))
    return parts.groupBy("job_id", "chunk_id").agg(F.flatten(F.transform(ordered, lambda x: x["part"])).alias("samples"))


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """Per job: chunks and their summed milliseconds."""
    return chunks.groupBy("job_id").agg(F.count("*").alias("n_chunks"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))


def envelope(samples: DataFrame, row_samples: int, max_points: int) -> DataFrame:
    """Least and greatest sample of every bin: rows longer than ``max_points`` get bins of floor(n / max_points), a rest that fills no bin is dropped.

    Bins are slices of the array, so there is a row for each bin and never one for each sample.
    """
    rows = F.transform(F.sequence(F.lit(0), F.ceil(F.size("samples") / row_samples).cast("int") - 1), lambda r: F.slice("samples", r * row_samples + 1, F.lit(row_samples)))
    cut = samples.where(F.size("samples") > 0).select("job_id", F.posexplode(rows).alias("row", "part"))
    n = F.size("part")
    size = F.when(n > max_points, F.floor(n / max_points)).otherwise(1).cast("int")
    each = lambda b: F.slice("part", b * F.col("size") + 1, F.col("size"))
    bins = F.transform(F.sequence(F.lit(0), F.floor(n / F.col("size")).cast("int") - 1), lambda b: F.struct(F.array_min(each(b)).alias("lo"), F.array_max(each(b)).alias("hi")))
    out = cut.withColumn("size", size).select("job_id", F.col("row").cast("long").alias("row"), F.posexplode(bins).alias("bin", "x"))
    return out.select("job_id", "row", F.col("bin").cast("long").alias("bin"), "x.lo", "x.hi")


def envelope_blocks(blocks: DataFrame, block_size: int, row_samples: int, max_points: int) -> DataFrame:
    """``envelope`` over ``blocks(job_id, block_idx, samples)``: each block gives least and greatest values of the bins it overlaps, which are merged."""
    own = blocks.where(F.size("samples") > 0).select("job_id", (F.col("block_idx") * block_size).cast("long").alias("begin"), "samples")
    total = own.groupBy("job_id").agg(F.max(F.col("begin") + F.size("samples")).alias("total"))  # lengths only
    end = F.col("begin") + F.size("samples")
    rows = own.join(total, "job_id").withColumn("row", F.explode(F.sequence(F.floor(F.col("begin") / row_samples), F.floor((end - 1) / row_samples))))
    n = F.least(F.lit(row_samples).cast("long"), F.col("total") - F.col("row") * row_samples)
    rows = rows.withColumn("size", F.when(n > max_points, F.floor(n / max_points)).otherwise(1)).withColumn("bins", F.floor(n / F.col("size")))
    lead = F.col("row") * row_samples - F.col("begin")  # where the row begins in the block
    low, high = F.greatest(-lead, F.lit(0)), F.least(F.lit(row_samples), end - F.col("row") * row_samples)
    rows = rows.withColumns({"lead": lead, "low": low, "high": high}).withColumn("last", F.least(F.floor((F.col("high") - 1) / F.col("size")), F.col("bins") - 1))

    def part(b: Column) -> Column:
        a, z = F.greatest(b * F.col("size"), F.col("low")), F.least((b + 1) * F.col("size"), F.col("high"))
        own = F.slice("samples", (a + F.col("lead") + 1).cast("int"), (z - a).cast("int"))
        return F.struct(b.alias("bin"), F.array_min(own).alias("lo"), F.array_max(own).alias("hi"))

    first = F.floor(F.col("low") / F.col("size"))
    cut = rows.withColumn("first", first).where("first <= last").select("job_id", "row", F.explode(F.transform(F.sequence("first", "last"), part)).alias("x"))
    return cut.groupBy("job_id", "row", F.col("x.bin").alias("bin")).agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))


def timeline_tiles(segments: DataFrame, row_ms: int = 30_000, rows_a_page: int = 10) -> DataFrame:
    """Segments by the timeline rows they overlap, and the row's page; an equi key instead of an overlap join."""
    rows = F.sequence(F.floor(F.col("start_ms") / row_ms), F.ceil(F.col("end_ms") / row_ms) - 1)
    tiles = segments.where("end_ms > start_ms").select("job_id", "start_ms", "end_ms", F.explode(rows).alias("row"))
    return tiles.withColumn("page", F.floor(F.col("row") / rows_a_page))


def review_sample(chunks: DataFrame, per_job: int = 5, seed: str = "review") -> DataFrame:
    """At most ``per_job`` chunks a job by a seeded hash of the id."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("job_id").cast("string"), F.col("chunk_id").cast("string")))
    return chunks.withColumn("turn", F.row_number().over(Window.partitionBy("job_id").orderBy(order, "chunk_id"))).where(F.col("turn") <= per_job).drop("turn")
