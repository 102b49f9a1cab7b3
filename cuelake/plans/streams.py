"""How the queries run a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within, streams keep their state in RocksDB, which stateful processors need; afterwards the session has its own setting again."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """The stream's rows once all files are read."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
