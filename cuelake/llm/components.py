"""Connected components of an edge table by alternating stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_table, materialise, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: link every neighbour of a node (the larger ones, or the smaller ones and itself) to its least neighbour."""
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        sides = sides.union(sides.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = sides.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    pairs = sides.join(least, "u")
    if large:
        out = pairs.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = pairs.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and what tells edge sets apart (their number and hash sum), which is counted while they are written."""
    seen = Observation()
    out = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hash")))
    return out, (seen.get["n"], seen.get["hash"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``edges(a, b)``; the component is its least node.

    Nulls and self loops are ignored; nodes without an edge do not appear. The loop ends when a
    round of both star steps leaves the edge set (its size and hash sum) as it was. Each step is written by
    itself, so the driver plans one star at a time.
    """
    now, mark = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        if mark == seen or mark[0] == 0:
            break
        seen, old = mark, now
        half = materialise(_star(old, True))
        drop_table(old)
        now, mark = _written(_star(half, False))
        drop_table(half)
        del old, half
        release(now.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
