"""Versioned sinks: runs write data of their own, and a commit log says which of it exists.

    <path>/data/run=<unique>/...          what a run wrote, Parquet
    <path>/log/<version>.json             one file a version: run, name, schema

A version's file is put in place only if no other run has it; a run that finds its number taken takes the next. Readers list the log and read
the data that it names, so a run is seen whole or not at all, and a run that died before its commit is never seen.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if path.startswith("/") else None


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether ``path`` was made with ``text``; false if it exists. No reader sees it half written."""
    folder, _, name = path.rpartition("/")
    fresh = f"{folder}/.{name}-{uuid.uuid4().hex}"
    where, fs = _hadoop(spark, fresh)
    out = fs.create(where)
    out.write(bytearray(text.encode()))
    out.close()
    mount = _local(fs.makeQualified(where).toString())
    try:
        if mount is not None:  # a hard link is made only where nothing is
            try:
                os.link(mount, _local(path) or path)
                return True
            except FileExistsError:
                return False
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(where, _hadoop(spark, path)[0], options)  # fails where the target exists
            return True
        except Exception as e:  # noqa: BLE001  py4j wraps whatever Hadoop raises
            if "FileAlreadyExists" in str(e):
                return False
            raise
    finally:
        fs.delete(where, False)


def versions(spark: SparkSession, path: str) -> list[dict]:
    """The committed versions in order: version, run, name, schema. One small file a run."""
    folder, fs = _hadoop(spark, f"{path}/log")
    if not fs.exists(folder):
        return []
    found, read = [], spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".json") and not name.startswith("."):
            stream = fs.open(status.getPath())
            try:
                found.append({"version": int(name.removesuffix(".json")), **json.loads(read.toString(stream, "UTF-8"))})
            finally:
                stream.close()
    return sorted(found, key=lambda v: v["version"])


def write_version(rows: DataFrame, path: str, partition_by: list[str], name: str | None = None) -> int:
    """Writes ``rows`` as a run of its own and commits it under the next version, which is returned.

    ``name`` tells runs apart that may be repeated: of several versions with one name readers take the newest alone, so a run that is written again
    replaces itself. Runs may write at the same time.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    rows.write.partitionBy(*partition_by).parquet(f"{path}/data/run={run}")
    folder, fs = _hadoop(spark, f"{path}/log")
    fs.mkdirs(folder)
    last = max((v["version"] for v in versions(spark, path)), default=0)
    entry = json.dumps({"run": run, "name": name or run, "schema": rows.schema.json()})
    while True:
        last += 1
        if _put_if_absent(spark, f"{path}/log/{last:012d}.json", entry):
            return last


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the versions that count, with their ``version``."""
    committed = versions(spark, path)
    if not committed:
        raise FileNotFoundError(f"no committed version below {path}")
    newest = {v["name"]: v for v in committed}
    schema = StructType.fromJson(json.loads(committed[-1]["schema"]))
    known = {v["run"]: v["version"] for v in newest.values()}
    rows = spark.read.schema(schema.add("run", "string")).option("basePath", f"{path}/data").parquet(*[f"{path}/data/run={r}" for r in known])
    log = spark.createDataFrame(list(known.items()), "run string, version long")
    return rows.join(log, "run").drop("run")


def drop_uncommitted(spark: SparkSession, path: str) -> int:
    """Deletes the data of runs that no version names, and returns how many. For times when no run is writing."""
    known = {f"run={v['run']}" for v in versions(spark, path)}
    folder, fs = _hadoop(spark, f"{path}/data")
    dead = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in known] if fs.exists(folder) else []
    for p in dead:
        fs.delete(p, True)
    return len(dead)
