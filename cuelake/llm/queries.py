"""Registered queries of the training-data operators: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import materialise, session_batches, table
from .hard_negatives import hard_negatives
from .language import fit_language_model, fold, predict_language
from .mixing import form_topic, mix, word_count
from .mixing_lm import score_texts
from .near_dup import NearDupParams, near_duplicates
from .order_minhash import edited_fingerprints, likeness, signature
from .packing import PackingParams, pack
from .prefix_trees import remove_repeated_passages
from .secret_scan import fit_secret_model, scan_secrets
from .substring_dedup import remove_repeated_substrings
from .url_filter import judge_urls
from .vector_search import nearest
from .whitening import whiten


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", form_topic(F.col("text")).alias("topic"), word_count(F.col("text")).alias("tokens"))
    return mix(materialise(docs), {"source": 0.7, "lang": 0.5, "topic": 0.8})  # each text is read once


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("path"))
    return scan_secrets(docs, fit_secret_model(docs.select("text", "path")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_substrings(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    return cut.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), NearDupParams(shingle_words=4))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    model = fit_language_model(docs.where("not held_out").select("text", "lang"))
    return predict_language(docs.drop("lang"), model, ["doc_id", "held_out"])


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(vectors, F.col("vec_id") % 100 == 0)


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 10) == 0)
    score = -F.col("bits") * F.log10(F.lit(2.0))
    return score_texts(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", score.alias("score"), "bits_per_byte")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        signature(F.col("entries")).alias("fingerprint"), signature(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"), likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_batches(spark)
    pieces = pack(table(spark, sf_dir, "documents"), PackingParams(tokenizer_path("word_bpe_49k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector")), F.col("vec_id") % 100 == 0)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_passages(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    return cut.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_retrieval_packing": op1_retrieval_packing,
    "op2_url_filter": op2_url_filter,
    "op3_language_id": op3_language_id,
    "op6_vector_search": op6_vector_search,
    "op4_context_mixing": op4_context_mixing,
    "op5_order_minhash": op5_order_minhash,
    "op7_source_mixing": op7_source_mixing,
    "op8_secret_scan": op8_secret_scan,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}

#: DuckDB SQL of those that SQL can express.
ORACLES: dict[str, str] = {
    "op6_vector_search": oracles.OP6,
    "op9_suffix_dedup": oracles.OP9,
    "op10_minhash_near_dedup": oracles.OP10,
    "op11_hard_negatives": oracles.OP11,
    "op12_substring_dedup": oracles.OP12,
}
