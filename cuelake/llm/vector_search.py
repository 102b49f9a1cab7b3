"""Nearest neighbours with randomly rotated one-bit codes (RaBitQ): estimate, bound, rerank.

Vectors are dealt to centroids (at most ``centroids``, fitted on at most about ``fit_rows`` vectors) and, within one, to
blocks of a bounded size. In a block they are centred, normalised and rotated by
a fixed random orthogonal matrix; the signs are packed into bytes and the cosine between the code and
its vector is kept as the correction scalar. A query's inner products with all codes are sums of byte
look-ups; divided by the scalar they are unbiased estimates, whose error the scalar bounds. Every vector
whose lower distance bound is at most the k-th least upper bound is measured exactly in double precision.

A query meets the blocks of its own centroid first. The k-th distance found there rules out every other centroid
whose vectors all lie farther away (by the triangle inequality, so nothing is lost); the query then meets the blocks of the
rest. Where vectors form clusters few are left; where they don't (random directions), all are, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialise


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    block: int = 8192  # vectors of a block
    query_block: int = 16_384  # queries that meet a block in one task
    centroids: int = 1024
    fit_rows: int = 40_000
    fit_rounds: int = 8
    epsilon: float = 3.0  # width of the error bound, in standard deviations
    seed: int = 19


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


class OneBitCodes:
    def __init__(self, vectors: np.ndarray, rotate: np.ndarray):
        self.dims = d = vectors.shape[1]
        self.rotate, self.centre = rotate, vectors.mean(axis=0)
        residual = vectors - self.centre
        self.norm = np.sqrt((residual**2).sum(axis=1))
        turned = (residual / np.maximum(self.norm, 1e-300)[:, None]) @ rotate
        self.packed = np.packbits(turned >= 0, axis=1)
        self.scalar = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(d), 1e-12)  # code . vector
        self.error = np.sqrt(np.maximum(1 - np.minimum(self.scalar, 1) ** 2, 0)) / self.scalar / np.sqrt(max(d - 1, 1))
        self.signs = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0) / np.sqrt(d)

    def bounds(self, query: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the squared distance to every vector."""
        q = query - self.centre
        length = np.sqrt((q**2).sum())
        turned = np.zeros(self.packed.shape[1] * 8)
        turned[: self.dims] = (q / max(length, 1e-300)) @ self.rotate
        lookup = turned.reshape(-1, 8) @ self.signs.T  # one row of 256 sums a code byte
        inner = np.zeros(len(self.norm))
        for j in range(self.packed.shape[1]):
            inner += lookup[j][self.packed[:, j]]
        estimate = inner / self.scalar
        base, cross = self.norm**2 + length**2, 2 * self.norm * length
        slack = epsilon * self.error + 1e-9
        return base - cross * np.minimum(estimate + slack, 1.0), base - cross * np.maximum(estimate - slack, -1.0)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed from the first component to the last."""
    d = vectors - query
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])


def _searcher(p: SearchParams):
    columns = ["query_id", "vec_id", "score"]

    def run(key, data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(queries):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        ids, x = data["vec_id"].to_numpy(np.int64), np.stack(data["vector"].to_numpy()).astype(np.float64)
        codes = OneBitCodes(x, rotation(x.shape[1], p.seed))
        out = []
        for qid, q in zip(queries["vec_id"].to_numpy(np.int64), queries["vector"], strict=True):
            q = np.asarray(q, np.float64)
            low, high = codes.bounds(q, p.epsilon)
            other = np.flatnonzero(ids != qid)
            if len(other) > p.k:
                other = other[low[other] <= np.partition(high[other], p.k - 1)[p.k - 1]]
            exact = distances(x[other], q)
            best = np.lexsort((ids[other], exact))[: p.k]
            out.append((np.full(len(best), qid), ids[other][best], exact[best]))
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def fit_centroids(sample: np.ndarray, n: int, p: SearchParams) -> np.ndarray:
    """k-means of the sample, begun at ``n`` of its distinct rows."""
    rng = np.random.default_rng(p.seed)
    sample = np.unique(sample, axis=0)
    centres = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(p.fit_rounds if len(centres) > 1 else 0):
        own = _closest(sample, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, sample[:, j], len(centres)) for j in range(sample.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _closest(x: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[np.argmin(half - x[a : a + rows] @ centres.T, axis=1) for a in range(0, len(x), rows)]])


_ROW = "vec_id long, vector array<double>, dims int, asks boolean"


def _assign(centres: np.ndarray):
    """Rows with their centroid and the distance to it; those of other dimensions go to centroid 0 of theirs, at the origin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy()
            dims = batch.column("dims").to_numpy()
            ends = np.cumsum(dims)
            which, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            own = np.flatnonzero(dims == centres.shape[1])
            if len(own):
                x = flat[(ends[own] - dims[own])[:, None] + np.arange(centres.shape[1])]
                which[own] = _closest(x, centres)
                far[own] = np.sqrt(((x - centres[which[own]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(which), pa.array(far)], [*batch.schema.names, "cluster", "far"])

    return run


def _meets(centres: np.ndarray, radius: np.ndarray):
    """Queries with each centroid but their own that may hold one of the k nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, limit, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dims", "limit", "cluster"))
            row, cluster = [], []
            for i, q in enumerate(batch.column("vector")):
                if dims[i] == centres.shape[1]:
                    gap = np.sqrt(((centres - q.values.to_numpy()) ** 2).sum(axis=1)) - radius
                    near = np.flatnonzero(gap <= limit[i] * (1 + 1e-9) + 1e-12)
                    near = near[(near != home[i]) & (radius[near] >= 0)]
                    row.append(np.full(len(near), i))
                    cluster.append(near)
            at = np.concatenate([np.zeros(0, np.int64), *row])
            found = batch.select(["vec_id", "vector", "dims"]).take(pa.array(at, pa.int64()))
            yield found.append_column("cluster", pa.array(np.concatenate([np.zeros(0, np.int64), *cluster]).astype(np.int32)))

    return run


def nearest(vectors: DataFrame, is_query: Column, params: SearchParams = SearchParams()) -> DataFrame:
    """The k nearest rows by Euclidean distance of every query row of ``vectors(vec_id, vector)``, never its own vec_id.

    Returns query_id, rank (from 1), vec_id, score (the exact distance); ties go to the smaller vec_id.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with
    a null vec_id; vectors of different lengths are never compared. Rows that repeat a vec_id are
    candidates each. An empty table gives an empty result; further columns are ignored, whatever their names.
    """
    p = params
    v = F.transform("vector", lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"), F.size("vector").alias("dims"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    dims, n = (sizes["dims"], sizes["count"]) if sizes else (1, 0)
    share = min(1.0, p.fit_rows / max(n, 1))
    drawn = rows.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("vector", F.lit(p.seed)), F.lit(1 << 30)) < int(share * (1 << 30)))).select("vector").distinct().limit(2 * p.fit_rows).toPandas()["vector"]
    sample = np.stack(drawn.to_numpy()) if len(drawn) else np.ones((1, dims))
    centres = fit_centroids(sample, min(p.centroids, -(-n // p.block) or 1), p)

    placed = materialise(rows.mapInArrow(_assign(centres), f"{_ROW}, cluster int, far double"))
    table = placed.groupBy("dims", "cluster").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / p.block).cast("int").alias("blocks"), F.ceil(F.count("*") / p.query_block).cast("int").alias("parts"))
    table = materialise(table)  # a row for each centroid in use: at most ``centroids`` and one for each other length
    radius = np.full(len(centres), -1.0)
    for r in table.where(F.col("dims") == dims).collect():
        radius[r["cluster"]] = r["radius"]
    spot = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")
    key, every = ["dims", "cluster", "block", "part"], lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    queries = placed.where("asks")

    def search(asking: DataFrame) -> DataFrame:
        """Top rows of each query from each block of the centroid it stands with."""
        asking = materialise(asking.withColumn("turn", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 20))))
        crowd = asking.groupBy("dims", "cluster").agg(F.ceil(F.count("*") / p.query_block).cast("int").alias("crowd"))
        shape = table.drop("parts").join(crowd, ["dims", "cluster"])
        q = asking.join(shape, ["dims", "cluster"]).select("vec_id", "vector", "dims", "cluster", every(F.col("blocks")).alias("block"), (F.col("turn") % F.col("crowd")).cast("int").alias("part"))
        data = placed.join(shape, ["dims", "cluster"]).select("vec_id", "vector", "dims", "cluster", spot(F.col("blocks"), 1).alias("block"), every(F.col("crowd")).alias("part"))
        return data.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(_searcher(p), "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)
    first = materialise(top(search(queries.select("vec_id", "vector", "dims", "cluster"))).drop("rank"))
    limit = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= p.k, F.max("score")).otherwise(float("inf")).alias("limit"))
    more = queries.join(limit, "vec_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    rest = search(more.select("vec_id", "vector", "dims", "cluster", "limit").mapInArrow(_meets(centres, radius), "vec_id long, vector array<double>, dims int, cluster int"))
    return top(first.union(rest)).select("query_id", "rank", "vec_id", "score")
