"""Order MinHash fingerprints in Spark expressions only.

A text becomes tokens (runs of non-space characters, or the characters of a run of more than ``token_chars``), its k-mers are ``k``
successive tokens, and each k-mer carries the number of its occurrence so far. One 64-bit hash of
(k-mer, occurrence) orders them on a ring that ``bins`` (a power of two) bins divide; the ``picks`` first from where a bin begins, put back in
text order, are hashed together. So a bin that holds fewer borrows from those after it (one-permutation hashing with
rotation), and the tuple of every bin of a short text keeps an order too. Texts agree in a bin when the same k-mers were
picked and stand in the same order, which is what makes the likeness follow edit distance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialise


@dataclass(frozen=True)
class OrderMinHashParams:
    k: int = 3
    token_chars: int = 24  # a longer run of non-space characters is one token a character
    bins: int = 64
    picks: int = 2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def order_minhash(text: Column, p: OrderMinHashParams = OrderMinHashParams()) -> Column:
    """array<long>, one entry per bin: the bin above 32 bits of the tuple's hash. None for a null text or one without tokens.

    Sorting works on packed longs: a hash in the high bits, an index in the low ``bits``. Cut hashes only
    decide order; the tuples use whole ones.
    """
    # Runs with space at both ends, or the single characters of a longer one: there, one more character moves no token but its own.
    char = r"[^ \t\n\x0B\f\r]"
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?<!{char}){char}{{1,{p.token_chars}}}(?!{char})|{char}"), F.lit(0))

    def kmers(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(t) - p.k), lambda i: F.xxhash64(*[t[i + j] for j in range(p.k)]))
        return F.when(F.size(t) == 0, F.array().cast("array<bigint>")).when(F.size(t) < p.k, F.array(F.xxhash64(F.array_join(F.transform(t, lambda x: x.cast("string")), " ")))).otherwise(many)

    def pick(m: Column) -> Column:
        bits = F.ceil(F.log2(F.size(m) + 1.0)).cast("int") + 1
        low = F.expr("1L")
        return _let(bits, lambda b: _let((F.call_function("shiftleft", low, b) - 1), lambda mask: _picked(m, b, mask)))

    def _picked(m: Column, b: Column, mask: Column) -> Column:
        packed = F.sort_array(F.transform(m, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
        same = lambda s, i: (i > 0) & (s[i - 1].bitwiseAND(F.bitwise_not(mask)) == s[i].bitwiseAND(F.bitwise_not(mask)))

        def numbered(s: Column) -> Column:
            prev = F.transform(s, lambda x, i: F.when(same(s, i), i - 1).otherwise(i))

            def jumped(st: Column) -> Column:
                """First index of each run of equal k-mers: pointers double until no run is longer."""
                repeats = F.size(F.filter(st, lambda x, i: x != i))
                rounds = F.ceil(F.log2(repeats + 1.0)).cast("int")
                return F.when(repeats == 0, st).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), st, lambda acc, _: F.transform(acc, lambda x: acc[x])))

            return _let(_let(prev, jumped), lambda st: chosen(s, st))

        def chosen(s: Column, st: Column) -> Column:
            at = lambda i: s[i].bitwiseAND(mask).cast("int")
            full = lambda i: F.xxhash64(m[at(i)], i - st[i])
            queue = F.sort_array(F.transform(s, lambda x, i: full(i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
            bin_of = lambda x: (F.shiftright(x, 64 - (p.bins - 1).bit_length()) + p.bins // 2).cast("int")  # noqa: E731  rises with the hash

            def tuples(q: Column) -> Column:
                firsts = F.filter(F.sequence(F.lit(0), F.size(q) - 1), lambda i: (i == 0) | (bin_of(q[i]) != bin_of(q[i - 1])))
                many = F.least(F.lit(p.picks), F.size(q))

                def tuple_hash(i: Column) -> Column:
                    own = F.transform(F.sequence(F.lit(0), many - 1), lambda t: q[(i + t) % F.size(q)].bitwiseAND(mask).cast("int"))
                    ordered = F.sort_array(F.transform(own, lambda x: F.struct(at(x).alias("pos"), full(x).alias("g"))))
                    return F.shiftrightunsigned(F.xxhash64(F.transform(ordered, lambda x: x["g"])), 32)

                def spread(f: Column) -> Column:
                    """Each bin's tuple: that of the first k-mer at or after the bin's beginning, round the ring."""
                    gap = lambda x, j: bin_of(q[x]) - F.when(j > 0, bin_of(q[f[F.greatest(j - 1, F.lit(0))]])).otherwise(-1)
                    upto = F.flatten(F.transform(f, lambda x, j: F.array_repeat(tuple_hash(x), gap(x, j))))
                    rest = lambda head: F.concat(head, F.array_repeat(head[0], p.bins - F.size(head)))
                    return F.transform(_let(upto, rest), lambda h, b: F.shiftleft(b.cast("long"), 32).bitwiseOR(h))

                return _let(firsts, spread)

            return _let(queue, tuples)

        return _let(packed, numbered)

    none = F.array().cast("array<bigint>")
    hashed = _let(tokens, lambda t: F.transform(t, lambda x: F.xxhash64(x)))
    return _let(_let(hashed, kmers), lambda m: F.when(F.size(m) == 0, none).otherwise(pick(m)))


def signature(entries: Column) -> Column:
    """The fingerprint as text: ten hex digits a bin, empty without entries."""
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins filled in either fingerprint that agree; two empty ones agree."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def successors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (distinct ``keys``) with next_<key>: the row after it in descending order of the keys; the last is followed by the first.

    Rows are range partitioned, so only the first row of each partition is compared across partitions.
    """
    order = [F.col(k).desc() for k in keys]
    ranged = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.max(F.struct(*keys)).alias("head"))
    wrap = F.max("head").over(Window.partitionBy())
    heads = heads.select("part", F.coalesce(F.lead("head").over(Window.partitionBy().orderBy("part")), wrap).alias("after"))
    inner = ranged.withColumn("lead", F.lead(F.struct(*keys)).over(Window.partitionBy("part").orderBy(*order)))
    joined = inner.join(heads, "part").withColumn("next", F.coalesce("lead", "after"))
    linked = materialise(joined.select(*rows.columns, *[F.col(f"next.{k}").alias(f"next_{k}") for k in keys]))
    drop_table(ranged)
    return linked


_NO_ID = -(2**63)


def edited_fingerprints(docs: DataFrame, p: OrderMinHashParams = OrderMinHashParams(), share: int = 3) -> DataFrame:
    """Fingerprints of every text of ``docs(doc_id, text)`` and of its edited text.

    The edited text replaces the last floor(n_chars / share) code points by the first as many of the next
    document in descending doc_id (after the last: the first). Null texts are empty. Rows with a null
    doc_id come last in that order; rows that repeat a doc_id are ordered by a hash of their text, and
    exact repeats count once in the order but each come back. Texts of any length are read whole; equal k-mers are told apart by
    their occurrence. A single document is its own next. Further columns are ignored, whatever their names. An empty table gives an empty result.
    Returns doc_id, n_chars, edited, entries, edited_entries, next_entries.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    links = successors(base.select("did", "th", F.length("text").alias("n")).distinct(), ["did", "th"])
    full = base.withColumn("entries", order_minhash(F.col("text"), p))
    need = F.floor(F.col("n") / share).cast("int")
    heads = (
        full.join(links.select(F.col("did").alias("for_did"), F.col("th").alias("for_th"), need.alias("need"), F.col("next_did").alias("did"), F.col("next_th").alias("th")), ["did", "th"])
        .select("for_did", "for_th", F.col("text").substr(F.lit(1), F.col("need")).alias("head"), F.col("entries").alias("next_entries"))
        .groupBy("for_did", "for_th")
        .agg(F.first("head").alias("head"), F.first("next_entries").alias("next_entries"))
    )
    joined = full.join(heads.withColumnsRenamed({"for_did": "did", "for_th": "th"}), ["did", "th"])
    n = F.length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), n - F.floor(n / share).cast("int")), F.col("head"))
    out = joined.select(F.when(F.col("did") != _NO_ID, F.col("did")).alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"), "entries", "next_entries")
    return out.withColumn("edited_entries", order_minhash(F.col("edited"), p))
