"""Shared helpers of the training-data operators: scratch tables, packed numbers and text batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy pass holds at once; a single longer document makes a pass of its own.
PASS_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(taken: list[str], *names: str) -> list[str]:
    """``names``, each with underscores put before it until it differs from all columns taken, whatever their case."""
    low, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        out.append(n)
    return out


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Where none is set, a local session gets one of its own; on a cluster that would be a folder of one
    machine, so there it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


@contextmanager
def batch_rows(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within, Spark hands Python Arrow batches of at most ``rows`` rows; afterwards the session has its own setting again.

    For what runs within. A plan that is returned runs under the caller's setting; its batches have at most 64 MB.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def session_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For applications, not operators: whole texts reach Python in Arrow batches of at most ``rows`` rows in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


_WRITTEN: set[str] = set()


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _WRITTEN.add(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_scratch(path: str) -> None:
    """Put a folder that an operator wrote itself on the list of ``clear_scratch``."""
    _WRITTEN.add(path)


def drop_path(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)
        _WRITTEN.difference_update([p for p in _WRITTEN if folder.endswith(p.rsplit("/", 1)[1])])


def release(spark: SparkSession) -> None:
    """For loops of many short writes: Spark drops the shuffle files and broadcasts of plans that nothing holds when the driver collects its garbage, and the heap shrinks again."""
    gc.collect()  # Python's objects hold the JVM's
    spark.sparkContext._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this process; results of the operators that were not written yet are lost with them."""
    while _WRITTEN:
        drop_path(spark, _WRITTEN.pop())


def squeeze(x: np.ndarray) -> bytes:
    """The bytes of ``x``, those of like weight together, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"")


def unsqueeze(x: bytes, dtype: type, width: int) -> np.ndarray:
    """Rows of ``width`` bytes, back as they were (one number a row, or a row of int8)."""
    import zstandard

    raw = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(width, -1).T)
    return raw.view(dtype) if dtype is np.int8 else raw.view(dtype)[:, 0]


def passes(lengths: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` units each (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


class ByteHasher:
    """64-bit hashes of byte ranges of one buffer, from prefix sums of a polynomial over random byte values."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**62)) * 4 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up, self.down = self._powers(self.base, 1), self._powers(self.inverse, 1)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        if n > 1:
            out[1:] = np.uint64(base)
            np.multiply.accumulate(out, out=out)
        return out

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        if len(buf) + 1 > len(self.up):
            n = max(len(buf) + 1, 2 * len(self.up))
            self.up, self.down = self._powers(self.base, n), self._powers(self.inverse, n)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.values[buf] * self.up[: len(buf)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.down[start])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def hashed_words(texts: list[bytes], hasher: ByteHasher) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end): words are runs of bytes other than ASCII white space."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = np.concatenate(([True], _SPACE[buf], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, end = edges[0::2], edges[1::2]
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lens)))
    return hasher.ranges(hasher.prefix(buf), start, end), np.searchsorted(start, offsets)
