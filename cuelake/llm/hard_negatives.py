"""Hard negatives by a vertical (BOND) scan: dimensions are columns, and bounds of what is still unread shrink the candidates.

1. Vectors become integers and are dealt to blocks of about ``block`` rows. A block is one row of a scratch table: its
   dimensions one after the other, each a column of all its rows.
2. Anchors are packed into parts and each part meets each block. For an anchor a block's columns are read in descending magnitude
   of the anchor's components. The least and greatest value of each column bound what the unread ones can add to a
   partial inner product, and a bitmap holds the rows that may still matter.
3. A first scan keeps same-label rows whose upper bound reaches the ``positives``-th lower bound. The best of all blocks are an anchor's
   positives, and each gives a window of scores.
4. A second scan keeps rows of other labels that may lie in a window and are not beaten there by ``negatives`` rows that surely do.
   The best of all blocks for each window are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, squeeze, unsqueeze


@dataclass(frozen=True)
class HardNegativeParams:
    positives: int = 5
    negatives: int = 5
    scale: int = 256  # a component x becomes floor(scale * x)
    low: tuple[int, int] = (80, 100)  # a negative has at least 80/100 of the positive's score, and at most all of it
    block: int = 16_384  # vectors of a block
    part: int = 2048  # anchors that meet a block at once
    stride: int = 4  # columns read between two looks at the bitmap


class Columns:
    """The vectors of a block by dimension: ``x[d]`` holds one component of all rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.least, self.most = x.min(axis=1), x.max(axis=1)

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, prune, stride: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows that ``prune`` left, their inner products, components read): ``prune(lower, upper)`` says which rows may still matter."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.least, anchor * self.most])[:, order]
        # Bounds of the columns from the j-th on; zeros when all are read.
        lower, upper = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.min(axis=0), ends.max(axis=0)))
        rows = np.flatnonzero(bitmap)
        score, read = np.zeros(len(rows), np.int64), 0
        for j, d in enumerate(order.tolist(), 1):
            column = self.x[d]
            score += anchor[d] * (column if len(rows) == len(column) else column[rows])
            read += len(rows)
            if len(rows) and (j % stride == 0 or j == len(order)):
                keep = prune(score + lower[j], score + upper[j])
                if not keep.all():
                    rows, score = rows[keep], score[keep]
        return rows, score, read

    def best(self, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((self.ids[rows], -score))[:k]


def _at_least(values: np.ndarray, k: int) -> int | None:
    """The k-th greatest value, if there are so many."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def keep_top(k: int):
    def prune(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        bar = _at_least(lower, k)
        return np.ones(len(upper), bool) if bar is None else upper >= bar

    return prune


def keep_windows(windows: list[tuple[int, int]], k: int):
    """Rows that may be among the k best of a window (from, to)."""

    def prune(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(upper), bool)
        for a, b in windows:
            bar = _at_least(lower[(lower >= a) & (upper <= b)], k)
            keep |= (upper >= (a if bar is None else max(a, bar))) & (lower <= b)
        return keep

    return prune


def window_of(positive: int, p: HardNegativeParams) -> tuple[int, int]:
    """Scores s with low[0] * positive <= low[1] * s and s <= positive; none of a negative one's, for they would be greater than it."""
    return -(-p.low[0] * positive // p.low[1]), positive


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64)


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(pdf["x"]).T
    row = (pdf["dims"].iloc[0], pdf["block"].iloc[0], squeeze(pdf["vec_id"].to_numpy(np.int64)), squeeze(pdf["label"].to_numpy(np.int64)), squeeze(x.reshape(-1)))
    return pd.DataFrame([row], columns=["dims", "block", "ids", "labels", "columns"])


def _pack_part(pdf: pd.DataFrame) -> pd.DataFrame:
    row = [pdf["dims"].iloc[0], pdf["part"].iloc[0], *(squeeze(pdf[c].to_numpy(np.int64)) for c in ("vec_id", "label")), squeeze(_matrix(pdf["x"]).reshape(-1))]
    scores = [list(map(int, s)) if s is not None else [] for s in pdf["scores"]]
    return pd.DataFrame([(*row, scores)], columns=["dims", "part", "a_ids", "a_labels", "a_x", "a_scores"])


def _longs(x: bytes) -> np.ndarray:
    return unsqueeze(x, np.int64, 8)


_FOUND = "anchor_id long, place int, vec_id long, score long"


def _scanner(p: HardNegativeParams, positives: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ids = _longs(r["ids"])
                block = Columns(ids, _longs(r["labels"]), _longs(r["columns"]).reshape(r["dims"], len(ids)))
                anchors = _longs(r["a_ids"])
                out = [np.zeros((0, 4), np.int64)]
                for anchor, label, x, scores in zip(anchors.tolist(), _longs(r["a_labels"]).tolist(), _longs(r["a_x"]).reshape(len(anchors), -1), r["a_scores"], strict=True):
                    if positives:
                        rows, score, _ = block.scan(x, (block.labels == label) & (ids != anchor), keep_top(p.positives), p.stride)
                        takes = [block.best(rows, score, p.positives)]
                    else:
                        windows = [window_of(s, p) for s in scores]
                        rows, score, _ = block.scan(x, (block.labels != label) & (ids != anchor), keep_windows(windows, p.negatives), p.stride)
                        takes = []
                        for a, b in windows:
                            inside = np.flatnonzero((score >= a) & (score <= b))
                            takes.append(inside[block.best(rows[inside], score[inside], p.negatives)])
                    for place, take in enumerate(takes, 1):
                        n = len(take)
                        out.append(np.stack([np.full(n, anchor), np.full(n, place), ids[rows[take]], score[take]], axis=1))
                found = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2]), pa.array(found[:, 3])], ["anchor_id", "place", "vec_id", "score"])

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, params: HardNegativeParams = HardNegativeParams()) -> DataFrame:
    """Hard negatives of the anchors among ``vectors(vec_id, label, vector)``: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components x become floor(scale * x), scores are integer inner products, higher ones come first, and ties go to the smaller
    vec_id. An anchor's positives are its first other rows of its label; for each of them come the first rows of other labels whose score
    lies in the window that ``low`` sets below the positive's (rank from 1). A positive without any has no row.

    Rows with a null vec_id, label, vector or component, with a non-finite component, without components, or with components so
    large that an inner product might not fit a long (scaled magnitude times the root of the dimensions from 2^31) take no part. Vectors of
    different lengths are never compared. Rows that repeat a vec_id are candidates each, but no row meets an anchor of its own
    vec_id; of anchors that share one, the least by (label, vector) stands. An empty table gives an empty result; further columns
    are ignored, whatever their names.

    Scratch: blocks and positives stay in the shared folder until ``clear_scratch``.
    """
    p, spark = params, vectors.sparkSession
    v = F.transform("vector", lambda x: x.cast("double") * p.scale)
    dims = F.size("vector")
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * p.scale) * F.sqrt(dims) < F.lit(2.0**31)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector", F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (dims > 0) & fits)
    rows = rows.select("vec_id", "label", "asks", dims.alias("dims"), F.transform(v, lambda x: F.floor(x)).alias("x"))

    # One row of 12 bytes for each length of vectors. k lengths need k * (k + 1) / 2 components at least, so 10^14 bytes of floats have
    # at most 7 million of them, and the table is bounded for broadcasting.
    sizes = materialise(rows.groupBy("dims").agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks"), F.ceil(F.count_if("asks") / p.part).cast("int").alias("parts")))
    spot = lambda salted, n: F.pmod(F.xxhash64(salted), n).cast("int")
    # Dealt by place, not by value, so that a row that comes a million times fills no block.
    dealt = rows.withColumn("_turn", F.monotonically_increasing_id()).join(F.broadcast(sizes), "dims").withColumn("block", spot(F.col("_turn"), F.col("blocks")))
    blocks = materialise(dealt.select("dims", "block", "vec_id", "label", "x").groupBy("dims", "block").applyInPandas(_pack_block, "dims int, block int, ids binary, labels binary, columns binary"), "none")

    anchors = rows.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "x", "dims")).alias("a")).select("vec_id", "a.*")
    anchors = materialise(anchors.join(F.broadcast(sizes), "dims").withColumn("part", spot(F.col("vec_id"), F.greatest("parts", F.lit(1)))))

    def scan(asking: DataFrame, positives: bool) -> DataFrame:
        packed = asking.groupBy("dims", "blocks", "part").applyInPandas(lambda key, pdf: _pack_part(pdf).assign(blocks=key[1]), "dims int, part int, a_ids binary, a_labels binary, a_x binary, a_scores array<array<long>>, blocks int")
        each = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return blocks.join(each, ["dims", "block"]).mapInArrow(_scanner(p, positives), _FOUND)

    place = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    top = lambda found, k: found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    first = materialise(top(scan(anchors.withColumn("scores", F.lit(None).cast("array<long>")), True), p.positives).select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    held = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    found = top(scan(anchors.join(held, "vec_id"), False), p.negatives)
    return found.join(first, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
