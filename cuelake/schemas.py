"""Table schemas, declared once; nothing is inferred."""

from pyspark.sql import types as T

VAD_PARAMS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("threshold", "min_silence", "min_speech", "max_absorb_gap", "max_chunk")])

CHUNK = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("start", T.StringType()), T.StructField("end", T.StringType()),
    T.StructField("start_sec", T.DoubleType()), T.StructField("end_sec", T.DoubleType()), T.StructField("duration_sec", T.DoubleType()),
    T.StructField("start_sample", T.LongType()), T.StructField("end_sample", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("language_detected", T.StringType()), T.StructField("transcribe_elapsed_sec", T.DoubleType()), T.StructField("flags", T.ArrayType(T.StringType())),
])

MANIFEST = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("source_mtime", T.StringType()), T.StructField("source_size", T.LongType()),
    T.StructField("provider", T.StringType()), T.StructField("created_at", T.StringType()), T.StructField("output_srt", T.StringType()), T.StructField("audio_sample_rate", T.IntegerType()),
    T.StructField("source_duration_sec", T.DoubleType()), T.StructField("vad_params", VAD_PARAMS), T.StructField("chunks", T.ArrayType(CHUNK)),
])

CHUNK_TEXT = "job_id string, chunk_id int, kind string, text string"
#: Supported media suffixes.
MEDIA_TYPES = (
    "wav", "mp3", "aac", "m4a", "flac", "ogg", "wma", "opus",
    "mp4", "mkv", "webm", "mov", "avi", "mpg", "mpeg", "wmv", "ts", "m2ts", "3gp",
)
