"""Job manifests: JSON documents to job and chunk rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..schemas import MANIFEST


def scan_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Every JSON document of a file, or of the ``*.json`` files at any depth of a folder: path, line, document, error.

    The content tells the form, not the name: a file that is one document (on however many lines) has one row with a null ``line``; any other is
    read as one document a line, with blank lines left out. ``document`` has the declared schema; where a text is no JSON object, or an object
    that doesn't fit, it is null and ``error`` says so. A document may be of 100 MB or so; a file of lines is read whole by a task, too.
    """
    files = spark.read.option("recursiveFileLookup", True)
    if _is_folder(spark, path):
        files = files.option("pathGlobFilter", "*.json")
    texts = files.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\x{feff}", "").alias("text"))
    # One parse of a text as a whole; only what is no document by itself is cut into lines.
    whole = texts.withColumn("document", _parsed(F.col("text")))
    single = whole.where(_complete(F.col("document")))
    lines = whole.where(~_complete(F.col("document"))).select("path", F.posexplode(F.split("text", r"\r?\n")).alias("at", "text")).where(F.trim("text") != "")
    each = lines.select("path", (F.col("at") + 1).alias("line"), _parsed(F.col("text")).alias("document"))
    rows = single.select("path", F.lit(None).cast("int").alias("line"), "document").unionByName(each)
    good = _complete(F.col("document"))
    return rows.select("path", "line", F.when(good, F.col("document")).alias("document"), F.when(~good, "not one JSON object of a job").alias("error"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _parsed(text: Column) -> Column:
    """The one document that a text is, or null. As an array of one it is parsed to its end, where a bare object would hide what follows it."""
    found = F.from_json(F.concat(F.lit("["), text, F.lit("\n]")), ArrayType(MANIFEST))
    lost = found[0]["chunks"].isNull() & F.get_json_object(text, "$.chunks").isNotNull()  # what doesn't fit comes back as null
    return F.when((F.size(found) == 1) & ~lost, found[0])


def _complete(document: Column) -> Column:
    """Whether a text was a manifest: an object that fits the schema, with a job."""
    return F.coalesce(document["job_id"].isNotNull(), F.lit(False))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """The manifest documents of a file or a folder; ``broken_manifests`` tells what could not be read."""
    return scan_manifests(spark, path).where("error is null").select("document.*")


def broken_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, error) of the documents that could not be read."""
    return scan_manifests(spark, path).where("error is not null").drop("document")


def chunk_rows(manifests: DataFrame) -> DataFrame:
    """One row a chunk with its job."""
    return manifests.select("job_id", F.explode("chunks").alias("c")).select("job_id", "c.*").withColumnRenamed("id", "chunk_id")


def build_manifests(jobs: DataFrame, chunks: DataFrame, provenance: DataFrame) -> DataFrame:
    """Manifest rows of ``jobs`` with their chunks in order; source fields from ``provenance`` first, then the job's own; output_srt is the stem + .srt."""
    fields = [f for f in MANIFEST["chunks"].dataType.elementType.names]
    have = [F.col("chunk_id").alias("id") if f == "id" else F.col(f) if f in chunks.columns else F.lit(None).alias(f) for f in fields]
    grouped = chunks.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(*have))).alias("chunks"))
    source = ["source_file", "source_mtime", "source_size"]
    prior = provenance.select("job_id", *[F.col(c).alias(f"_{c}") for c in source])
    rows = jobs.join(prior, "job_id", "left").join(grouped, "job_id", "left")
    rows = rows.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in source}).drop(*[f"_{c}" for c in source])
    return rows.withColumn("output_srt", F.concat(F.regexp_replace("source_file", r"\.[^./]*$", ""), F.lit(".srt")))


def write_manifests(manifests: DataFrame, path: str) -> None:
    """JSON documents, one a line, with nested chunks."""
    manifests.write.mode("overwrite").json(path)
