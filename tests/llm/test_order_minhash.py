import hashlib
import random

from pyspark.sql import functions as F

from cuelake.llm.order_minhash import edited_fingerprints, likeness, order_minhash, signature


def test_edited_texts_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i * 5 % 97, "".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 300)))) for i in range(60)] + [(200, None), (201, ""), (202, "x"), (203, "é" * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as did", "2 as th", "3 as n", "4 as part").repartition(4)
    order = sorted(dict(rows).items(), reverse=True)
    want = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        want[d] = (len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest())
    got = {r.doc_id: (r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in edited_fingerprints(df).collect()}
    assert got == want


def sign(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", order_minhash(F.col("t")).alias("e"))
    return df


def test_signatures(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    a = words[:300]
    texts = [" ".join(a), " ".join(a), " ".join(a[:200] + words[300:400]), " ".join(words[400:700]), " ".join(a[150:] + a[:150]), " ".join(random.Random(3).sample(a, 300)), "", None, "x", "y y y y y y y y", "z" * 100_000, ("w v u " * 40_000)]
    df = sign(spark, texts)
    rows = {r.i: r for r in df.select("i", signature(F.col("e")).alias("s"), F.size("e").alias("n")).collect()}
    assert rows[0].s == rows[1].s and rows[0].n == 64 and rows[6].s == rows[7].s == "" and len({rows[i].s for i in (0, 2, 3, 4, 5, 8, 9, 10, 11)}) == 9
    x, y = df.select(F.col("i").alias("i"), F.col("e").alias("a")), df.select(F.col("i").alias("j"), F.col("e").alias("b"))
    like = {(r.i, r.j): r.l for r in x.join(y, F.col("i") < F.col("j")).select("i", "j", likeness(F.col("a"), F.col("b")).alias("l")).collect()}
    assert like[0, 1] == 1.0 and like[6, 7] == 1.0 and like[0, 3] == 0.0 and like[6, 8] == 0.0
    assert 0.1 < like[0, 2] < 0.45  # a third replaced: half of the k-mers agree, so a quarter of the pairs
    assert like[0, 5] < 0.1  # same words, other order
    assert like[0, 4] > 0.3  # halves swapped keep most neighbours


def test_single_null_ids_repeats_and_empty(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert edited_fingerprints(one).first().edited == "abcdab"
    df = spark.createDataFrame([(None, "n"), (1, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    assert edited_fingerprints(df).count() == 4
    assert edited_fingerprints(one.limit(0)).count() == 0


def brute_entries(text, k=3, chars=24, bins=64, picks=2):
    """The fingerprint by a plain loop over the bins: from each bin's beginning round the ring of hashes, the first picks in text order."""
    import re

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chain = lambda parts: __import__("functools").reduce(lambda seed, x: xxhash.xxh64_intdigest(x, seed=seed), parts, 42)
    tokens = [t for w in re.findall(r"[^ \t\n\x0b\f\r]+", text) for t in ([w] if len(w) <= chars else w)]
    if not tokens:
        return []
    hashes = [chain([t.encode()]) for t in tokens]
    if len(tokens) < k:
        kmers = [chain([" ".join(str(signed(h)) for h in hashes).encode()])]
    else:
        kmers = [chain([h.to_bytes(8, "little") for h in hashes[i : i + k]]) for i in range(len(tokens) - k + 1)]
    seen, ring = {}, []
    for pos, m in enumerate(kmers):
        n = seen[m] = seen.get(m, -1) + 1
        g = chain([m.to_bytes(8, "little"), n.to_bytes(4, "little")])
        ring.append((signed(g), pos, g))
    ring.sort()
    out = []
    for b in range(bins):
        begin = -(1 << 63) + b * ((1 << 64) // bins)
        at = next((i for i, r in enumerate(ring) if r[0] >= begin), 0)
        own = sorted((ring[(at + t) % len(ring)][1:] for t in range(min(picks, len(ring)))))
        out.append(b << 32 | chain([g.to_bytes(8, "little") for _, g in own]) >> 32)
    return out


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 16))) for _ in range(n)) for n in (0, 1, 2, 3, 4, 7, 20, 90, 400)]
    texts += ["a b a b a b a b", "x " * 50, "q" * 40, " \t\n", "日本語の文章" * 9 + " 終", "a" * 24 + " " + "b" * 25, "😀" * 30]
    got = {r.i: list(r.e) for r in sign(spark, texts).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_entries(t), t[:30]


def test_short_texts_keep_order(spark):
    """Twenty words, and the same with the halves swapped: nearly all k-mers agree, the order of half of the pairs doesn't."""
    rng = random.Random(4)
    like = []
    for _ in range(8):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20)]
        df = sign(spark, [" ".join(words), " ".join(words[10:] + words[:10])])
        a, b = (r.e for r in df.orderBy("i").collect())
        like.append(len(set(a) & set(b)) / 64)
    assert 0.1 < sum(like) / len(like) < 0.75


def test_texts_without_spaces_survive_an_insertion(spark):
    """600 characters in one run, and the same with one more put before or in it, share nearly all entries; another run shares few."""
    rng = random.Random(9)
    run = lambda: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(600))
    text, other = run(), run()
    rows = [r.e for r in sign(spark, [text, "新" + text, text[:300] + "新" + text[300:], other]).orderBy("i").collect()]
    share = [len(set(rows[0]) & set(r)) / 64 for r in rows]
    assert min(share[1:3]) > 0.9 and share[3] < 0.1
