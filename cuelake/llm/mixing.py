"""Mixing sources to target weights: iterative proportional fitting on cells, then calibrated sampling.

Documents are counted once into cells (one per combination of the dimensions' values). Each round scales
the cells' token weights so that one dimension after the other meets its target shares. Only cells are
shuffled; the documents meet their cell's probability in one join that moves no text where Spark finds the
cells small enough to broadcast, and is split by skew otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, free_names, materialise, release


@dataclass(frozen=True)
class MixingParams:
    keep_share: float = 0.5  # tokens that the sample is to hold, as a share of all
    rounds: int = 40
    tolerance: float = 1e-6
    check_every: int = 4
    seed: int = 23


_NULL = "\u0000null"


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares (dim, target) proportional to each value's tokens to the given power."""
    return cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))


def cells_of(docs: DataFrame, dims: list[str]) -> DataFrame:
    """(dims, tokens) summed; a null value is a value of its own."""
    return docs.groupBy(*[F.coalesce(F.col(d).cast("string"), F.lit(_NULL)).alias(d) for d in dims]).agg(F.sum("tokens").alias("tokens"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], p: MixingParams = MixingParams()) -> DataFrame:
    """``cells(dims, tokens)`` with ``weight`` (tokens raked to the target shares of every dimension) and ``gap``.

    Targets are renormalised over the values that occur; a value without a target gets none. The last
    dimension is met exactly, the others within ``tolerance`` if the rounds settle. ``gap``, the same in every row,
    is the largest part of all tokens by which a marginal misses its target; where it is above the tolerance, the targets
    contradict each other or want more rounds. Cells of no tokens keep weight 0. Each dimension's step is written
    by itself: a step reads the one before it twice, so a plan of several would double with each dimension.
    """
    base = state = cells.where("tokens > 0")
    total = state.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumns({"weight": F.lit(0.0), "gap": F.lit(0.0)})
    found = {d: materialise(base.select(d).distinct().join(t, d).select(d, "target")) for d, t in targets.items()}
    for d, present in found.items():
        whole = present.agg(F.sum("target")).first()[0] or 1.0
        state = state.join(present.select(d, (F.col("target") * (float(total) / whole)).alias(f"t_{d}")), d, "left").fillna({f"t_{d}": 0.0})
    state = materialise(state.withColumn("weight", F.col("tokens").cast("double")))
    for present in found.values():
        drop_table(present)
    for r in range(1, p.rounds + 1):
        for d in targets:
            before = state
            sums = before.groupBy(d).agg(F.sum("weight").alias("sum"))
            state = materialise(before.join(sums, d).withColumn("weight", F.when(F.col("sum") > 0, F.col("weight") * F.col(f"t_{d}") / F.col("sum")).otherwise(0.0)).drop("sum"))
            drop_table(before)
        if r % p.check_every == 0 or r == p.rounds:
            worst = [state.groupBy(d).agg((F.abs(F.sum("weight") - F.first(f"t_{d}")) / total).alias("gap")).agg(F.max("gap").alias("gap")) for d in list(targets)[:-1]]
            gap = reduce(DataFrame.union, worst).agg(F.max("gap")).first()[0] or 0.0 if worst else 0.0
            release(state.sparkSession)
            if gap <= p.tolerance:
                break
    return state.select(*targets, "tokens", "weight", F.lit(float(gap)).alias("gap"))


def calibrate(raked: DataFrame, p: MixingParams = MixingParams()) -> DataFrame:
    """``raked`` with ``probability`` = min(1, scale * weight / tokens), scaled so that the expected tokens are the wanted share."""
    total, mass = raked.agg(F.sum("tokens"), F.sum("weight")).first()
    if not total or not mass:
        return raked.withColumn("probability", F.lit(0.0))
    want, scale = p.keep_share * total, p.keep_share * total / mass
    for _ in range(50):
        clipped = F.col("weight") * scale >= F.col("tokens")
        full, free = raked.agg(F.sum(F.when(clipped, F.col("tokens")).otherwise(0)), F.sum(F.when(clipped, 0.0).otherwise(F.col("weight")))).first()
        now = (want - full) / free if free and want > full else scale
        if now <= scale * (1 + 1e-9):
            break
        scale = now
    return raked.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * scale / F.col("tokens")))


def draw(doc_id: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that only the id decides."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def mix(docs: DataFrame, dims: dict[str, float | DataFrame], p: MixingParams = MixingParams()) -> DataFrame:
    """Every row of ``docs(doc_id, tokens, dims...)`` with weight (its cell's raked tokens per token), probability, kept and gap.

    ``dims`` gives each dimension's targets: a table (the dimension's values, ``target``), or the power that tempers the shares at hand. Values
    that a table doesn't name get nothing; null stands for null. ``gap`` is told in ``rake``. A null value counts as a value; rows
    without tokens (or with null ones) get probability 0. The doc_id alone decides a row's draw: rows that repeat a doc_id are drawn alike, and so
    are all rows with a null one. Columns of ``docs`` named like those added are replaced; all others pass through, whatever their names.
    An empty table gives an empty result. ``docs`` is read twice: hand over a narrow or written table.
    """
    names = {d: f"dim{i}" for i, d in enumerate(dims)}
    cells = materialise(cells_of(docs.select("tokens", *[F.col(f"`{d}`").alias(n) for d, n in names.items()]), list(names.values())))

    def targets(dim: str) -> DataFrame:
        given = dims[dim]
        if not isinstance(given, DataFrame):
            return tempered(cells, names[dim], given)
        return given.select(F.coalesce(F.col(f"`{dim}`").cast("string"), F.lit(_NULL)).alias(names[dim]), F.col("target").cast("double").alias("target"))

    raked = rake(cells, {n: targets(d) for d, n in names.items()}, p)
    odds = materialise(calibrate(raked, p))
    drop_table(cells)
    held, *keys = free_names(docs.columns, "_odds", *[f"_{n}" for n in names.values()])
    odds = odds.select(*[F.col(n).alias(k) for n, k in zip(names.values(), keys, strict=True)], F.struct(F.try_divide("weight", "tokens").alias("weight"), "probability", "gap").alias(held))
    on = [F.coalesce(F.col(f"`{d}`").cast("string"), F.lit(_NULL)) == F.col(k) for d, k in zip(names, keys, strict=True)]
    added = ("weight", "probability", "kept", "gap")
    out = docs.join(odds, on, "left").drop(*keys)
    odd = lambda i: F.when(F.coalesce(F.col("tokens"), F.lit(0)) > 0, F.col(held).getField(i)).otherwise(0.0)
    out = out.withColumn(held, F.struct(odd("weight").alias("weight"), odd("probability").alias("probability"), F.col(f"{held}.gap").alias("gap")))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return out.select(*own, f"{held}.weight", f"{held}.probability", (draw(F.col("doc_id"), p.seed) < F.col(f"{held}.probability")).alias("kept"), f"{held}.gap")


def word_count(text: Column) -> Column:
    """Words (runs without ASCII white space) of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]++")), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    """A coarse topic by the form of the text, for tables without a topic column."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    return F.when(text.isNull(), "none").when(share("|") > 0.02, "table").when(share("#$%&*") > 0.05, "noisy").when(share("0123456789") > 0.02, "numeric").when(n < 400, "note").otherwise("prose")
