"""Evaluation of transcripts: character error rate of two variants, means, misdetections, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cer, cer_form

#: Language names by code.
LANGUAGE_NAMES = {"ko": "Korean", "ja": "Japanese", "zh": "Chinese"}


def paired_cer(samples: DataFrame) -> DataFrame:
    """``samples(sample_id, lang_id, ref, hyp_auto, hyp_hinted)`` with raw and normalised error rates of both variants."""
    # Distances cost far more than rows weigh: every core gets some, however few files there are.
    samples = samples.repartition(samples.sparkSession.sparkContext.defaultParallelism, "sample_id")
    norm = {c: cer_form(F.col(c)) for c in ("ref", "hyp_auto", "hyp_hinted")}
    rows = samples.select("sample_id", "lang_id", "ref", "hyp_auto", "hyp_hinted", *[v.alias(f"_{c}") for c, v in norm.items()])
    rates = {f"{v}_{kind}": cer(F.col(f"{pre}ref"), F.col(f"{pre}hyp_{v}")) for v in ("auto", "hinted") for kind, pre in (("raw", ""), ("norm", "_"))}
    return rows.select("sample_id", "lang_id", *[v.alias(k) for k, v in rates.items()])


def mean_cer(paired: DataFrame) -> DataFrame:
    """Means of the rates per language and over all (lang_id null), in one pass."""
    return paired.rollup("lang_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("auto_raw", "auto_norm", "hinted_raw", "hinted_norm")])


def misdetections(results: DataFrame, names: DataFrame) -> DataFrame:
    """Per expected code: samples and those whose ``detected`` name differs (case ignored). Unknown codes count as ``unmapped``."""
    rows = results.join(names.select("code", "name"), "code", "left")
    wrong = F.col("name").isNotNull() & (F.lower("name") != F.lower(F.coalesce("detected", F.lit(""))))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.count_if(wrong).alias("n_wrong"), F.count_if(F.col("name").isNull()).alias("n_unmapped"))


def upsert_by_language(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` rows of languages that ``new`` doesn't hold, and all of ``new``."""
    return old.join(new.select("lang").distinct(), "lang", "left_anti").select(*old.columns).unionByName(new)
