"""Corpus pipeline over ``documents``: language, near duplicates, secrets, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; ``run`` writes each as Parquet to the shared folder before the next reads it. All but the last
return the columns of ``documents``; further columns pass through them, whatever their names. Rows that repeat are rows
of their own (near duplicates: of one document). An empty table passes through every stage. Ties: see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import free_names, materialise, session_batches, table
from cuelake.llm.language import UNDETERMINED, fit_language_model, fold, predict_language
from cuelake.llm.mixing import MixingParams, form_topic, mix, word_count
from cuelake.llm.near_dup import NearDupParams, near_duplicates
from cuelake.llm.packing import PackingParams, pack
from cuelake.llm.queries import tokenizer_path
from cuelake.llm.secret_scan import fit_secret_model, mask_secrets

#: Least calibrated probability of a document's language.
MIN_LANGUAGE_SCORE = 0.5
#: Share of the tokens that mixing keeps.
KEEP_SHARE = 0.8


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some confidence; null texts, texts without letters and doubtful ones go."""
    session_batches(spark)
    model = fit_language_model(docs.where(fold(F.col("doc_id"), 5) != 0).select("text", "lang"))
    lang, score = free_names(docs.columns, "lang_pred", "score")
    told = predict_language(docs, model, docs.columns, (lang, score))
    return told.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the least doc_id.

    Rows that share that doc_id all stay; so do rows with a null doc_id, and documents without words.
    """
    kept = near_duplicates(docs, NearDupParams(shingle_words=5)).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` counted anew; null texts stay null."""
    session_batches(spark)
    model = fit_secret_model(docs.select("text", F.col("source").alias("path")))
    return mask_secrets(docs, model, "source").withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow tempered source, language and form marginals. The doc_id decides the draw; documents without words go."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")  # its columns can't clash with those of the mixing
    counted = materialise(docs.select("doc_id", "source", "lang", whole, form_topic(F.col("text")).alias("topic"), word_count(F.col("text")).alias("tokens")))
    return mix(counted, {"source": 0.7, "lang": 0.5, "topic": 0.8}, MixingParams(keep_share=KEEP_SHARE)).where("kept").select("whole.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences, token ids as little-endian 32-bit numbers."""
    return pack(docs, PackingParams(tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and iterations can't be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
