"""Media catalog: files by suffix, and job keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import job_key
from ..schemas import MEDIA_TYPES


def classify(files: DataFrame) -> DataFrame:
    """``files(path, ...)`` with the lower-cased suffix and whether it is a supported media type."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("suffix", suffix).withColumn("supported", F.col("suffix").isin(*MEDIA_TYPES))


def media_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """All files below ``folder`` with path, modification time, length, job key; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    return classify(files).withColumn("job_id", job_key(F.col("path"), F.col("modificationTime"), F.col("length")))
