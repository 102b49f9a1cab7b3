"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full shingle sets.

Tables: ``side`` groups of ``rows`` minhashes make a left and a right collection; every pair (i, j)
of one left and one right group is a table key, so side**2 tables need 2*side*rows minhashes. A pair
of similarity s is missed with probability 1-(1-(1-s**rows)**side)**2: 7e-5 at s = 0.8 for the
defaults, less above.

Plan: one scan makes sketches; equal sets collapse to their least id before anything is shuffled by
table key. In each bucket the members are compared with one member a round; what is linked merges,
and later rounds compare only across components. Last, the members of buckets that still hold several
components are compared across them, so no link of a bucket is lost and dense groups never expand into
all pairs. There, the counts of 64 parts of each set, without shingles that no other such member has,
bound what two sets can share; pairs that the bound refutes are never made, and a pair of several
buckets is made in the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteHasher, batch_rows, drop_table, hashed_words, materialise, mix64, odd_constants, passes, release
from .components import components


@dataclass(frozen=True)
class NearDupParams:
    shingle_words: int = 5
    percent: int = 80
    side: int = 10
    rows: int = 2
    seed: int = 7


def shingle_sets(texts: list[bytes | None], k: int, hasher: ByteHasher) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, their bounds): texts of 1 to k-1 words give one shingle, empty ones none."""
    words, first = hashed_words([(t or b"").lower() for t in texts], hasher)
    mult = odd_constants(k, 3)
    n = len(words)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    comb = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        comb += words[j : j + len(comb)] * mult[j]
    whole = doc[: len(comb)] == doc[k - 1 :] if len(comb) else np.zeros(0, bool)
    hashes, owner = [comb[whole]], [doc[: len(comb)][whole]]
    count = np.diff(first)
    for w in range(1, k):
        few = np.flatnonzero(count == w)
        part = np.full(len(few), w * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for j in range(w):
            part += words[first[few] + j] * mult[j]
        hashes.append(part)
        owner.append(few)
    h, o = mix64(np.concatenate(hashes)), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[fresh], o[fresh]
    return h, np.searchsorted(o, np.arange(len(texts) + 1))


def _sketcher(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHasher()
        n_hash = 2 * p.side * p.rows
        mult, salt = odd_constants(n_hash, p.seed), odd_constants(n_hash, p.seed + 1)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lo, hi in passes([len(t or b"") for t in texts]):
                h, bound = shingle_sets(texts[lo:hi], p.shingle_words, hasher)
                size = np.diff(bound)
                full = np.flatnonzero(size)
                sums, xors = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                groups = np.zeros((hi - lo, 2 * p.side), np.uint64)
                if len(full):
                    at = bound[:-1][full]
                    sums[full], xors[full] = np.add.reduceat(h, at), np.bitwise_xor.reduceat(mix64(h + np.uint64(p.seed)), at)
                    for f in range(n_hash):
                        groups[full, f // p.rows] = mix64(groups[full, f // p.rows] + np.minimum.reduceat((h ^ salt[f]) * mult[f], at))
                flat = pa.array(groups.ravel().view(np.int64))
                sides = pa.FixedSizeListArray.from_arrays(flat, 2 * p.side).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(size.astype(np.int64)), pa.array(sums.view(np.int64)), pa.array(xors.view(np.int64)), sides], ["doc_id", "n_shingles", "set_a", "set_b", "sides"])

    return run


def _set_maker(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHasher()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lo, hi in passes([len(t or b"") for t in texts]):
                h, bound = shingle_sets(texts[lo:hi], k, hasher)
                yield pa.RecordBatch.from_arrays([batch.column("id")[lo:hi], pa.array([h[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)], pa.binary())], ["id", "shingles"])

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each)), pa.array(np.repeat(batch.column("id").to_numpy(), [len(x) for x in each]))], ["shingle", "id"])


_PARTS = 64  # parts that shingles fall into by hash; two sets share no more of a part than the smaller count there


def _part_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [np.bincount(np.frombuffer(x.as_buffer(), np.int64) % _PARTS, minlength=_PARTS).tolist() for x in batch.column("shingles")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(each, pa.list_(pa.int32()))], ["id", "whole"])


def _across(placed: DataFrame, sets: DataFrame, sides: DataFrame, p: NearDupParams) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of one bucket and different components that may be linked, each once; and the scratch tables that they are read from.

    Each table is written before the next is planned, so the driver doesn't hold one plan with the stages of all.
    """
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = materialise(placed.join(mixed, "key").select("key", "i", "j", "id", "component", "n"))
    sizes = materialise(rest.select("id", "n").distinct())
    held = sets.join(sizes, "id")
    own = held.select("id", "shingles").mapInArrow(_exploded, "shingle long, id long")
    part = F.pmod("shingle", F.lit(_PARTS))
    lone = own.groupBy("shingle").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").select("id", part.alias("part"))
    lone = materialise(lone.groupBy("id").agg(F.array(*[F.count_if(F.col("part") == i).cast("int") for i in range(_PARTS)]).alias("lone")))
    whole = held.select("id", "shingles").mapInArrow(_part_counts, "id long, whole array<int>")
    shared = F.transform("whole", lambda x, i: x - F.coalesce(F.col("lone")[i], F.lit(0)))
    free = whole.join(lone, "id", "left").select("id", shared.alias("parts")).withColumn("free", F.aggregate("parts", F.lit(0), lambda acc, x: acc + x))
    free = materialise(free.join(sizes, "id").where(f"100 * free >= {p.percent} * n").join(sides, "id").select("id", "free", "parts", "sides"))
    drop_table(lone)
    drop_table(sizes)
    release(sets.sparkSession)
    both = rest.join(free, "id")
    fits = f"{100 + p.percent} * least(x.free, y.free) >= {p.percent} * (x.n + y.n)"
    earlier = lambda at, shift: f"exists(sequence(1, greatest(x.{at}, 1)), t -> t <= x.{at} and x.sides[{shift} + t - 1] = y.sides[{shift} + t - 1])"
    first = f"not {earlier('i', 0)} and not {earlier('j', p.side)}"
    close = f"{100 + p.percent} * aggregate(zip_with(x.parts, y.parts, (a, b) -> least(a, b)), 0, (s, v) -> s + v) >= {p.percent} * (x.n + y.n)"
    on = F.expr(f"x.key = y.key and x.id > y.id and x.component <> y.component and {fits} and {first} and {close}")
    return both.alias("x").join(both.alias("y"), on).select(F.expr("x.id").alias("a"), F.expr("y.id").alias("b")), [rest, free]


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(b) > len(a):
                    a, b = b, a
                at = np.searchsorted(a, b)
                same = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
                keep.append(100 * same >= percent * (len(a) + len(b) - same) and same > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Words are runs of non-space bytes, A-Z lower-cased; a set holds the distinct ``shingle_words``-word
    shingles (fewer words: the whole sequence as one). Linked: percent * union <= 100 * intersection.
    component_id is the least doc_id reachable. Null or blank texts have an empty set and link with
    nothing; rows with a null doc_id get a null component and are kept. Repeated rows each come back, and
    rows that share a doc_id are one node of the links; texts of any length are read whole; an empty table gives an empty result; further columns
    are ignored, whatever their names. Scratch: three tables in the shared folder feed the result and stay until ``clear_scratch``.
    """
    with batch_rows(docs.sparkSession, 100):  # a pair of long documents' sets is large
        return _near_duplicates(docs, params)


def _near_duplicates(docs: DataFrame, p: NearDupParams) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialise(docs.mapInArrow(_sketcher(p), "doc_id long, n_shingles long, set_a long, set_b long, sides array<long>"))
    usable = sketches.where("doc_id is not null and n_shingles > 0")
    reps = materialise(usable.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("sides").alias("sides")))

    left, right = F.slice("sides", 1, p.side), F.slice("sides", p.side + 1, p.side)
    keyed = reps.select("id", right.alias("right"), F.posexplode(left).alias("i", "l")).select("id", "i", "l", F.posexplode("right").alias("j", "r")).select(F.xxhash64("i", "j", "l", "r").alias("key"), F.col("i").cast("byte").alias("i"), F.col("j").cast("byte").alias("j"), "id")
    # A member's place in its bucket is its id xor the key: every table has another first member.
    rank = F.col("id").bitwiseXOR(F.col("key"))
    shared = keyed.groupBy("key").agg(F.min(rank).alias("lo"), F.max(rank).alias("hi")).where("lo < hi").select("key")
    members = materialise(keyed.join(shared, "key"))

    ids = members.select("id").distinct()
    texts = docs.where("doc_id is not null").join(ids, docs.doc_id == ids.id, "left_semi")
    sets = materialise(texts.select(F.col("doc_id").alias("id"), "text").mapInArrow(_set_maker(p.shingle_words), "id long, shingles binary"), "none")

    sizes = reps.select("id", F.col("n_shingles").alias("n"))
    where = materialise(ids.select("id", F.col("id").alias("component")).join(sizes, "id"))
    done, used, settled = None, [members, sets], False
    for last in (False, False, False, True):
        if settled and not last:
            continue
        release(docs.sparkSession)
        placed = members.join(where, "id")
        if last:
            pairs, scratch = _across(placed, sets, reps.select("id", "sides"), p)
            used += scratch
            pairs = pairs.distinct()
        else:
            first = placed.groupBy("key").agg(F.min(F.struct("component", "id", "n")).alias("lo"), F.max("component").alias("hi")).where("lo.component < hi")
            pairs = placed.join(first, "key").where(f"component <> lo.component and 100 * least(n, lo.n) >= {p.percent} * greatest(n, lo.n)").groupBy(F.col("id").alias("a"), F.col("component")).agg(F.min("lo.id").alias("b")).select("a", "b")
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        used.append(pairs)
        if settled := pairs.isEmpty():  # the next round of this kind would have none either
            continue
        sa, sb = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        links = pairs.join(sa, "a").join(sb, "b").mapInArrow(_confirmer(p.percent), "a long, b long")
        at = where.select("id", "component")
        edges = links.join(at.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(at.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = components(edges)
        old = where
        moved = merged.select(F.col("id").alias("old"), F.col("component").alias("new"))
        where = materialise(old.join(moved, F.col("component") == F.col("old"), "left").select("id", F.coalesce("new", "component").alias("component"), "n"))
        drop_table(old)
        drop_table(merged)
        done = pairs if done is None else done.union(pairs)

    for table in used:
        drop_table(table)
    of_set = reps.select("set_a", "set_b", "n_shingles", "id").join(where.select("id", "component"), "id", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "id").alias("found"))
    linked = usable.select("doc_id", "n_shingles", "set_a", "set_b").join(of_set, ["set_a", "set_b", "n_shingles"]).select("doc_id", "n_shingles", F.col("found").alias("component_id"))
    alone = sketches.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
