"""Whitening by bit-sliced scatter: exact integer cross-products from bit planes, centred as integers, then one eigendecomposition.

1. Entries become integers. The distinct vectors are the fit list, written once.
2. Each dimension is shifted by its least value, so that few bits are left. A task packs, for a chunk of rows, each bit plane of each dimension
   into 64-bit words across rows. The cross-product of two dimensions is the sum over pairs of their planes of
   2^(a + b) * popcount(plane a AND plane b): exact, and with no product of entries.
3. Spark adds the chunks' sums as decimals. The driver gets D * (D + 1) / 2 of them, whatever the number of rows.
4. n * (sum of products) - (product of sums) is n^2 times the covariance, in integers of any size. Only then comes floating point:
   the division, and ``eigh``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class WhiteningParams:
    components: int = 16
    scale: int = 64  # an entry c becomes floor(scale * c) + offset
    offset: int = 1_000_000
    chunk: int = 65_536  # rows whose bit planes are packed at once


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Packed planes of non-negative integers: one row of 64-bit words for each bit, from the lowest."""
    bits = int(values.max(initial=0)).bit_length()
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    return np.stack([np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8)).view(np.uint64) for b in range(bits)]) if bits else np.zeros((0, len(padded) // 64), np.uint64)


def scatter(values: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """(sums of each column, cross-products of columns i <= j) of rows of non-negative integers, by weighted popcounts."""
    planes = [bit_planes(c) for c in values.T]
    owner = np.repeat(np.arange(len(planes)), [len(p) for p in planes])
    weight = np.concatenate([np.arange(len(p)) for p in planes])
    every = np.concatenate(planes)
    sums = [0] * len(planes)
    for i, b, count in zip(owner.tolist(), weight.tolist(), np.bitwise_count(every).sum(axis=1, dtype=np.int64).tolist(), strict=True):
        sums[i] += count << b
    cross = [[0] * len(planes) for _ in planes]
    first = np.searchsorted(owner, np.arange(len(planes)))
    for i, own in enumerate(planes):
        later = slice(int(first[i]), None)  # planes of this dimension and those after it
        for a, plane in enumerate(own):
            counts = np.bitwise_count(plane & every[later]).sum(axis=1, dtype=np.int64)
            for j, b, count in zip(owner[later].tolist(), weight[later].tolist(), counts.tolist(), strict=True):
                cross[i][j] += count << (a + b)
    return sums, cross


def _stack(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _extremes(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = None, None
        for batch in batches:
            if batch.num_rows:
                x = _stack(batch.column("x"), dims)
                least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
                most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(least), pa.array(most)], ["i", "least", "most"])

    return run


_SUM = pa.decimal128(38, 0)


def _scatters(shift: np.ndarray, chunk: int):
    dims = len(shift)

    def packed(rows: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(rows)
        sums, cross = scatter((x - shift).astype(np.uint64))
        i, j = np.triu_indices(dims)
        where = [*zip(range(dims), [-1] * dims, strict=True), *zip(i.tolist(), j.tolist(), strict=True)]
        values = [*sums, *(cross[a][b] for a, b in where[dims:])]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in where], pa.int32()), pa.array([b for _, b in where], pa.int32()), pa.array(values, _SUM), pa.array([len(x)] * len(where), pa.int64())], ["i", "j", "value", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            x = _stack(batch.column("x"), dims)
            for lo in range(0, len(x), chunk):
                rows.append(x[lo : lo + chunk])
                held += len(rows[-1])
                if held >= chunk:
                    yield packed(rows)
                    rows, held = [], 0
        if held:
            yield packed(rows)

    return run


@dataclass(frozen=True)
class Whitening:
    """What ``fit_whitening`` learned: rows, sums, the exact n^2-fold covariance, and the components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    scatter: tuple[tuple[int, ...], ...]
    values: np.ndarray
    vectors: np.ndarray  # a column a component
    trace: float

    @property
    def rank(self) -> int:
        """Components whose eigenvalue is more than rounding."""
        return int((self.values > max(len(self.values), 1) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)).sum())

    def apply(self, x: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(deviation, whether it fits a long, whitened columns) of integer rows; columns past the rank are NaN."""
        wide = np.abs(x).max(initial=0) < 2**52 // max(self.n, 1) and max(map(abs, self.sums), default=0) < 2**52
        gap = x * self.n - np.array(self.sums, np.int64) if wide else x.astype(object) * self.n - np.array(self.sums, object)
        top = int(np.abs(gap).max(initial=0))
        exact = (gap * gap).sum(axis=1) if top * top * max(x.shape[1], 1) < 2**63 and wide else np.array([sum(int(g) * int(g) for g in row) for row in gap], object)
        fits = np.array([int(e) < 2**63 for e in exact], bool)
        centred = gap.astype(np.float64) / self.n if wide else np.array([[int(g) / self.n for g in row] for row in gap], np.float64).reshape(x.shape)
        k, out = min(components, self.rank), np.full((len(x), min(components, x.shape[1])), np.nan)
        out[:, :k] = (centred @ self.vectors[:, :k]) / np.sqrt(self.values[:k])
        return np.where(fits, exact, 0).astype(np.int64), fits, out


def fit_whitening(distinct: DataFrame, dims: int, params: WhiteningParams = WhiteningParams()) -> Whitening:
    """The whitening of ``distinct(x array<long>)``, rows of ``dims`` entries each taken once."""
    ends = distinct.mapInArrow(_extremes(dims), "i int, least long, most long").groupBy("i").agg(F.min("least").alias("least")).collect()  # a row a dimension
    shift = np.zeros(dims, np.int64)
    for r in ends:
        shift[r["i"]] = r["least"]
    added = distinct.mapInArrow(_scatters(shift, params.chunk), "i int, j int, value decimal(38,0), n long").groupBy("i", "j").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()  # dims * (dims + 3) / 2 rows
    n, sums, cross = 0, [0] * dims, [[0] * dims for _ in range(dims)]
    for r in added:
        n = r["n"]
        if r["j"] < 0:
            sums[r["i"]] = int(r["value"])
        else:
            cross[r["i"]][r["j"]] = cross[r["j"]][r["i"]] = int(r["value"])
    centred = tuple(tuple(n * cross[i][j] - sums[i] * sums[j] for j in range(dims)) for i in range(dims))  # the same for shifted entries
    covariance = np.array([[c / max(n * n, 1) for c in row] for row in centred]).reshape(dims, dims)
    values, vectors = np.linalg.eigh(covariance)
    trace = sum(centred[i][i] for i in range(dims)) / max(n * n, 1)
    return Whitening(n, tuple(s + n * int(m) for s, m in zip(sums, shift, strict=True)), centred, np.maximum(values[::-1], 0.0), vectors[:, ::-1], trace)


def _moments(model: Whitening, components: int, mean: np.ndarray | None):
    """Partial sums over the fit list: of each whitened column (``mean`` unknown yet), or of products of the centred ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = min(components, model.rank)
        total = np.zeros(k) if mean is None else np.zeros((k, k))
        for batch in batches:
            w = model.apply(_stack(batch.column("x"), len(model.sums)), components)[2][:, :k]
            total += w.sum(axis=0) if mean is None else (w - mean).T @ (w - mean)
        where = [(i, i) for i in range(k)] if mean is None else [(i, j) for i in range(k) for j in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in where], pa.int32()), pa.array([j for _, j in where], pa.int32()), pa.array(total.reshape(-1))], ["i", "j", "value"])

    return run


def identity_error(distinct: DataFrame, model: Whitening, components: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, minus the identity; NaN without components."""
    k = min(components, model.rank)
    if not k:
        return math.nan

    def added(mean: np.ndarray | None) -> dict[tuple[int, int], float]:
        rows = distinct.mapInArrow(_moments(model, components, mean), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
        return {(r["i"], r["j"]): r["value"] / model.n for r in rows}

    centre = added(None)
    spread = added(np.array([centre[i, i] for i in range(k)]))
    return max(abs(v - (i == j)) for (i, j), v in spread.items())


def whiten(vectors: DataFrame, params: WhiteningParams = WhiteningParams()) -> DataFrame:
    """Rows of ``vectors(vec_id, vector)`` in whitened coordinates: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * c) + offset. The fit list is each distinct x vector once: n of them, with sums S. ``deviation`` is the
    sum over dimensions of (n * x - S)^2, exact, or null if it doesn't fit a long; ``whitened`` is x - S / n on a unit eigenvector
    of the covariance, over the root of its eigenvalue; ``explained`` is the eigenvalue's share of the trace.

    Rows with a null vector or entry, a non-finite one, one beyond 2^52 once scaled, or no entries are dropped, and so are those of
    another length than the commonest (of ties, the smaller). A null vec_id stays null. Rows that repeat are returned each and fitted once.
    A component whose eigenvalue is zero but for rounding (fewer distinct rows than dimensions, say) has a null ``whitened`` and doesn't count in
    ``identity_error``, which is null if none is left; with a trace of zero ``explained`` is null. Vectors of fewer entries than
    ``components`` have as many components as entries. An empty table gives an empty result; further columns are ignored.

    The driver holds the D x D matrix of D dimensions and nothing that grows with the rows. Scratch: the fit list stays until ``clear_scratch``.
    """
    p = params
    scaled = F.transform("vector", lambda c: F.floor(c.cast("double") * p.scale) + F.lit(p.offset).cast("long"))
    fits = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * p.scale) < F.lit(2.0**52)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where(F.col("vector").isNotNull() & (F.size("vector") > 0) & fits).select("vec_id", F.size("vector").alias("dims"), scaled.alias("x"))
    common = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    dims = common["dims"] if common else 1
    rows = rows.where(F.col("dims") == dims).select("vec_id", "x")
    distinct = materialise(rows.select("x").distinct())
    model = fit_whitening(distinct, dims, p)
    error = identity_error(distinct, model, p.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = [float(e) / model.trace if model.trace else None for e in model.values]
        for batch in batches:
            deviation, fits, w = model.apply(_stack(batch.column("x"), dims), p.components)
            m, k = w.shape
            row, part = np.repeat(np.arange(m), k), np.tile(np.arange(k), m)
            flat = w.reshape(-1)
            columns = [
                batch.column("vec_id").take(pa.array(row)), pa.array((part + 1).astype(np.int32)), pa.array(np.full(m * k, model.n)),
                pa.array(deviation[row], mask=~fits[row]), pa.array(flat, mask=np.isnan(flat)),
                pa.array(share, pa.float64()).take(pa.array(part)), pa.array(np.full(m * k, error), mask=np.full(m * k, math.isnan(error))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
