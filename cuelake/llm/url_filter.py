"""URL verdicts: explicit rules first, gradient-boosted trees on lexical features for the rest.

The labelled URLs are those that a rule decides. Features and statistics are Spark expressions and
aggregates; the trees are Spark's own DataFrame-based GBTClassifier, fitted on at most about
``train_rows`` labelled URLs chosen by hash (the suffix statistics use all of them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise

ALLOW, BLOCK = "allow", "block"
#: (verdict, host and path prefix) of the production rules.
RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlFilterParams:
    rules: tuple[tuple[str, str], ...] = RULES
    train_rows: int = 20_000
    trees: int = 20
    depth: int = 4
    folds: int = 5
    prior: float = 4.0
    seed: int = 13


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and the path up to ``?`` or ``#``; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.expr("''")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    part = lambda g: F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*+)([^?#]*+)", g), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character of the character distribution."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))).otherwise(0.0)


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, what, ""))).cast("double")


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.greatest(F.length(url), F.lit(1))
    whole = F.substring_index(url, "#", 1)
    query = F.when(F.instr(whole, "?") > 0, whole.substr(F.instr(whole, "?") + 1, F.length(whole))).otherwise("")  # a later ? is part of it
    return {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/"),
        "host_labels": _count(host, ".") + 1,
        "digit_ratio": _count(url, "0123456789") / n,
        "letter_ratio": 1 - _count(F.translate(url, _UPPER, _LOWER), _LOWER) / n,
        "hyphens": _count(host, "-_"),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
        "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "query_length": F.length(query).cast("double"),
        "fragment": (F.instr(url, "#") > 0).cast("double"),
    }


def _suffix_statistics(labelled: DataFrame, suffix: str, p: UrlFilterParams) -> DataFrame:
    """Per suffix: labelled URLs and blocked ones, all and by fold, so that a training row never sees its own fold."""
    sums = [F.count("*").alias("n"), F.sum("label").alias("b")]
    for f in range(p.folds):
        sums += [F.sum(F.when(F.col("fold") == f, 1.0).otherwise(0.0)).alias(f"n{f}"), F.sum(F.when(F.col("fold") == f, F.col("label")).otherwise(0.0)).alias(f"b{f}")]
    stats = labelled.groupBy(suffix).agg(*sums)
    out = lambda f: F.array(*[F.col(f"{f}{i}") for i in range(p.folds)])
    return stats.select(suffix, F.struct("n", "b", out("n").alias("fn"), out("b").alias("fb")).alias(f"{suffix}_stats"))


def judge_urls(pages: DataFrame, params: UrlFilterParams = UrlFilterParams()) -> DataFrame:
    """Every row of ``pages(page_id, url)`` with host, path, rule, verdict and block_score (null where a rule decides).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, of equally long ones the last by text. Urls
    of any length are read whole. Null
    urls and urls without ``://`` have empty host and path. Where the labelled URLs hold fewer than two
    verdicts no trees can be fitted: the only verdict known holds, or allow if there is none. Repeated
    rows each come back; further columns are ignored, whatever their names; an empty table gives an empty result.
    """
    p = params
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), p.rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    rows = rows.withColumns({
        "top": F.substring_index("host", ".", -1), "site": F.substring_index("host", ".", -2),
        "label": F.when(F.col("said").isNotNull(), (F.col("said") == BLOCK).cast("double")), "fold": F.pmod(F.xxhash64("host", "path"), F.lit(p.folds)).cast("int"),
    })
    rows = materialise(rows.withColumns(lexical_features(F.col("url"), F.col("host"), F.col("path"))).drop("url"))
    labelled = rows.where("label is not null")
    total, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    keep = ["page_id", "host", "path", "rule"]
    if blocked in (0.0, float(total)):
        only = BLOCK if total and blocked else ALLOW
        return rows.select(*keep, F.coalesce("said", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))

    prior = blocked / total
    wide = rows
    for s in ("top", "site"):
        wide = wide.join(_suffix_statistics(labelled, s, p), s, "left")
        known = F.col(f"{s}_stats")
        own = F.when(F.col("label").isNotNull(), F.lit(1.0)).otherwise(0.0)
        seen = F.coalesce(known["n"] - own * known["fn"][F.col("fold")], F.lit(0.0))
        bad = F.coalesce(known["b"] - own * known["fb"][F.col("fold")], F.lit(0.0))
        wide = wide.withColumns({f"{s}_rate": (bad + p.prior * prior) / (seen + p.prior), f"{s}_seen": F.log1p(seen)}).drop(f"{s}_stats")
    names = [*lexical_features(F.lit(""), F.lit(""), F.lit("")), "top_rate", "top_seen", "site_rate", "site_seen"]
    wide = VectorAssembler(inputCols=names, outputCol="features").transform(wide).select(*keep, "said", "label", "features")
    share = min(1.0, p.train_rows / total)
    train = wide.where("label is not null").where(F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    train = materialise(train.select("label", "features"))
    if train.select("label").distinct().count() < 2:
        return rows.select(*keep, F.coalesce("said", F.lit(BLOCK if prior >= 0.5 else ALLOW)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    model = GBTClassifier(maxIter=p.trees, maxDepth=p.depth, seed=p.seed, cacheNodeIds=False).fit(train)
    drop_table(train)
    from pyspark.ml.functions import vector_to_array  # JVM side

    scored = model.transform(wide)
    block = F.when(F.col("said").isNull(), vector_to_array("probability")[1])
    return scored.select(*keep, F.coalesce("said", F.when(F.col("prediction") == 1.0, BLOCK).otherwise(ALLOW)).alias("verdict"), block.alias("block_score"))
