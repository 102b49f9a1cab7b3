import math
import random
from collections import Counter

import numpy as np
import pytest

from cuelake.llm import mixing_lm as lm
from cuelake.llm.common import mix64
from cuelake.llm.mixing_lm import ContextMixer, MixingLmParams, score_texts

SMALL = MixingLmParams(block_bytes=3000, sorted_bytes=9000, range_bytes=2000, context_range_bytes=1500, lanes=16)


def base_scores(rows, alpha=0.1):
    words = lambda t: (t or "").encode().lower().split()
    c = Counter()
    for _, t, held in rows:
        if not held:
            c.update(words(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    out = {}
    for d, t, _ in rows:
        toks = [*words(t), None]
        out[d] = (len(toks), sum(w in c for w in toks), n, sum(math.log10((c.get(w, 0) + alpha) / (n + alpha * (v + 1))) for w in toks))
    return out


def test_base_equals_brute_force(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdÉ,") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    rows = [(i, rng.choice([" ", "\n", "\u00a0 "]).join(rng.choice(vocab) for _ in range(rng.randint(0, 80))), rng.random() < 0.2) for i in range(120)]
    rows += [(500, None, False), (501, "", True), (502, "a\0b \0 c", True), (503, "word " * 3000, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").selectExpr("*", "1 as block", "2 as bits").repartition(3)
    got = {r.doc_id: r for r in score_texts(df, SMALL).collect()}
    assert len(got) == len(rows)
    for d, (n, known, total, score) in base_scores(rows).items():
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (n, known, total)
        assert got[d].base_score == pytest.approx(score, rel=1e-9, abs=1e-9)
        assert got[d].bits > 0
    assert got[503].bits_per_byte < 1.0


def made_up_inputs(text):
    """Logits that depend on nothing but the context and the bits of the byte so far."""
    buf = lm._joined([text])
    nodes = ((np.int64(256) | buf)[:, None] >> np.arange(8, 0, -1)).astype(np.uint64)
    inputs = []
    for k in range(lm.PREDICTORS):
        h = mix64((lm.Contexts(buf).keys(k) >> np.uint64(8))[:, None] * np.uint64(512) + nodes + np.uint64(k << 50))
        inputs.append(((h % np.uint64(61)).astype(np.int64) - 30, np.arange(len(buf))))
    return [(x.astype(np.int8), at) for x, at in inputs]


def prefix_bits(text):
    """Bits of a text without its end symbol."""
    mixer, buf = ContextMixer(SMALL), lm._joined([text])
    return float(mixer._advance(buf, made_up_inputs(text), np.array([0]), np.array([len(text)]))[0]) if text else 0.0


def test_bytes_have_a_distribution():
    """At every place the probabilities of all next bytes and of the end sum to one; byte 0 is one of them."""
    for prefix in (b"", b"ab c", b"abc" * 30, "\u00e9t\u00e9 ".encode()):
        before = prefix_bits(prefix)
        total = sum(2.0 ** -(prefix_bits(prefix + bytes([x])) - before) for x in range(255))
        end = 2.0 ** -(float(ContextMixer(SMALL).mixed([prefix], made_up_inputs(prefix))[0]) - before)
        assert total + end == pytest.approx(1.0, abs=2e-3)
    assert prefix_bits(b"a\0b") != prefix_bits(b"a\1b")


def test_contexts_are_those_before_each_byte():
    """Keys agree exactly where the bytes that a predictor looks at (and the byte itself) agree; none reaches into another text."""
    texts = [b"", b"ab ab", b"x", b"abcab abcab\nabcab", b"ab", "d\u00e9j\u00e0 d\u00e9j\u00e0".encode(), b"   a  b"]
    buf = lm._joined(texts)
    seen = [{} for _ in range(lm.PREDICTORS)]
    keys = [lm.Contexts(buf).keys(k).tolist() for k in range(lm.PREDICTORS)]
    i = 0
    for t in texts:
        for j, byte in enumerate(t + b"\xff"):
            before = b"\xff" * 4 + t[:j]
            cut = max([-1, *(x for x in range(j) if t[x] in b" \n\t")]) + 1
            old = (b"\xff" * 4 + t[:cut])[-3:-1]
            for k, want in enumerate((before[-4:], (before[-2:], old), t[cut:j], before[-3:])):
                assert seen[k].setdefault((want, byte), keys[k][i]) == keys[k][i]
            i += 1
    assert all(len(set(x.values())) == len(x) for x in seen)


def test_learning_helps(spark):
    rng = random.Random(5)
    syllables = ["tha", "rin", "gou", "ble", "ste"]
    rows = [(i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(80)), i % 10 == 0) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    learned = score_texts(df, SMALL).where("held_out").agg({"bits_per_byte": "avg"}).first()[0]
    from pyspark.sql import functions as F

    blank = score_texts(df.withColumn("held_out", F.lit(True)), SMALL).agg({"bits_per_byte": "avg"}).first()[0]
    assert learned < 2.0 < blank


def test_empty(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string, held_out boolean"), SMALL).count() == 0


def test_contexts_are_counted_apart_however_many():
    """200,000 contexts, more than any table of 65,536 slots, each with one byte of its own: the pairs' logits are exact."""
    from cuelake.llm.mixing_lm import path_logits, signed

    rng = np.random.default_rng(7)
    context = np.unique(rng.integers(0, 2**56, 200_000, dtype=np.uint64))
    byte, n = rng.integers(0, 256, len(context)).astype(np.uint64), rng.integers(0, 5, len(context))
    v = context << np.uint64(8) | byte
    got = signed(path_logits(v, n, 0.4), v)
    ones = (byte[:, None] >> np.arange(7, -1, -1).astype(np.uint64) & np.uint64(1)).astype(bool)
    expected = np.rint(8 * np.log((n + 0.4) / 0.4))[:, None] * np.where(ones, 1, -1)
    assert (got == expected).all()


def test_scores_equal_brute_force_counts(spark):
    """Scores through Spark equal those from a dictionary of all contexts of all blocks."""
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcde \n") for _ in range(rng.randint(0, 400))), i % 5 == 0) for i in range(60)]
    p = MixingLmParams(block_bytes=2000, sorted_bytes=5000, range_bytes=2000, context_range_bytes=1500, lanes=16)
    got = {r.doc_id: r.bits for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3), p).collect()}
    counts = [Counter() for _ in range(lm.PREDICTORS)]
    joined = {d: lm._joined([t.encode()]) for d, t, _ in rows}
    keys = {d: [lm.Contexts(b).keys(k).tolist() for k in range(lm.PREDICTORS)] for d, b in joined.items()}
    for d, _, held in rows:
        for k in range(lm.PREDICTORS):
            if not held:
                counts[k].update((c >> 8, b) for c, b in zip(keys[d][k], joined[d].tolist()))
    for d, t, _ in rows:
        inputs = []
        for k in range(lm.PREDICTORS):
            paths = np.zeros((len(joined[d]), 8), np.int8)
            for i, (c, b) in enumerate(zip(keys[d][k], joined[d].tolist())):
                for j in range(8):
                    n = [sum(counts[k][c >> 8, x] for x in range((b >> 8 - j) << 8 - j, ((b >> 8 - j) + 1) << 8 - j) if x >> 7 - j & 1 == y) for y in (0, 1)]
                    paths[i, j] = np.clip(np.rint(8 * math.log((n[1] + p.prior) / (n[0] + p.prior))), -127, 127)
            inputs.append((paths, np.arange(len(paths))))
        assert got[d] == pytest.approx(ContextMixer(p).mixed([t.encode()], inputs)[0], rel=1e-5)


def test_mixer_equals_a_plain_learner():
    """A text costs what one learner pays that goes from bit to bit: four predictors, gated weights, 25 cells a bit; other texts beside it change nothing."""
    rng = np.random.default_rng(4)
    p, text = MixingLmParams(lanes=2), bytes(rng.integers(97, 103, 1500, dtype=np.uint8))
    buf = np.frombuffer(text + b"\xff", np.uint8)
    paths = [rng.integers(-30, 30, (len(buf), 8)).astype(np.int8) for _ in range(lm.PREDICTORS)]
    w, gated = np.full((8, 4), p.first_weight), np.zeros((8, 4))
    chart = np.tile(1 / (1 + np.exp(-np.arange(-12, 13.0))), (8, 1))
    bits = 0.0
    for t, byte in enumerate(buf.tolist()):
        known = abs(int(paths[2][t, 0])) >= 20
        for j in range(8):
            y, x = byte >> 7 - j & 1, np.array([q[t, j] / 8 for q in paths])
            dot = float(np.clip((w[j] + known * gated[j]) @ x, -11.9, 11.9))
            mixed, cell = 1 / (1 + math.exp(-dot)), round(dot) + 12
            final = 0.75 * mixed + 0.25 * chart[j, cell]
            bits -= math.log2(final if y else 1 - final)
            chart[j, cell] += p.map_rate * (y - chart[j, cell])
            step = p.rate * (y - mixed) * x
            w[j] += step
            gated[j] += known * step
    short = b"abc"  # another text beside it, before and after
    around = [(np.concatenate([np.zeros((4, 8), np.int8), q, np.zeros((4, 8), np.int8)]), np.arange(len(buf) + 8)) for q in paths]
    assert ContextMixer(p).mixed([short, text, short], around)[1] == pytest.approx(bits, rel=1e-3)


def test_inputs_are_held_once_and_ended_texts_leave():
    """The mixer's work for a byte: four logits and one gate for each bit, with few lanes that run on beyond their text."""

    class Watched(ContextMixer):
        held = 0

        def _inputs(self, inputs, at):
            found = super()._inputs(inputs, at)
            self.held += sum(x.size for x in found) if isinstance(found, tuple) else found.size
            return found

    texts = [bytes([97 + i % 7]) * (300 + 15 * i) for i in range(150)]
    size = sum(len(t) + 1 for t in texts)
    rng = np.random.default_rng(3)
    inputs = [(rng.integers(-30, 30, (size, 8)).astype(np.int8), np.arange(size, dtype=np.int32)) for _ in range(lm.PREDICTORS)]
    mixer = Watched(MixingLmParams())
    together = mixer.mixed(texts, inputs)
    assert mixer.held < 1.1 * size * 8 * (lm.PREDICTORS + 1)
    assert ContextMixer(MixingLmParams(lanes=7)).mixed(texts, inputs) == pytest.approx(together, rel=1e-9)


def test_places_and_pairs_agree():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \u00e9") for _ in range(rng.randint(0, 90))).encode() for _ in range(50)] + [b"a" * 3000]
    pairs = lm.block_pairs(texts, [i % 3 > 0 for i in range(len(texts))])
    for k, ((v, n), (own, place)) in enumerate(zip(pairs, lm.block_places(texts))):
        keys = np.concatenate([lm.Contexts(lm._joined([t])).keys(k) for t in texts])
        learn = np.repeat([i % 3 > 0 for i in range(len(texts))], [len(t) + 1 for t in texts])
        assert (own == v).all() and (v[place] == keys).all()
        count = Counter(keys[learn].tolist())
        assert n.tolist() == [count[x] for x in v.tolist()]


def test_numbers_tell_keys_apart():
    """However many keys meet in a slot, equal keys have equal numbers and others don't; in order they are the distinct keys."""
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 2**44, 20_000, dtype=np.uint64)
    keys = np.concatenate((keys, rng.choice(keys, 30_000), keys[:1] + np.arange(300, dtype=np.uint64)))
    for expected in (len(keys), 4096 * 16, 1):
        numbers, out = lm.Numbers(expected), np.empty(len(keys), np.int32)
        for a in range(0, len(keys), 7001):
            numbers.of(keys[a : a + 7001], out[a : a + 7001])
        every, place = numbers.sorted()
        assert (every == np.unique(keys)).all() and (every[place[out]] == keys).all()


def test_places_are_held_once():
    """What placing holds grows by less than 27 bytes for each byte of a block: four places of four bytes, and the distinct pairs."""
    import tracemalloc

    rng = random.Random(8)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(vocab) for _ in range(400)).encode() for _ in range(1700)]
    size = sum(len(t) + 1 for t in texts)
    lm.block_places(texts[:9])
    tracemalloc.start()
    lm.block_places(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 3 << 20 and peak < 27 * size + (64 << 20)


def test_memory_is_read_in_long_stretches_and_reused():
    """A lane's places are read 64 steps at a time however many lanes there are, and keys are made where those of the slice before were."""

    class Counted(np.ndarray):
        reads = 0

        def take(self, *args, **more):
            Counted.reads += 1
            return np.asarray(self).take(*args, **more)

    texts, rng = [bytes([97 + i % 5]) * 127 for i in range(2000)], np.random.default_rng(2)
    paths = [rng.integers(-30, 30, (500, 8)).astype(np.int8) for _ in range(lm.PREDICTORS)]
    places = [rng.integers(0, 500, 2000 * 128).astype(np.int32) for _ in paths]
    wide = ContextMixer(MixingLmParams()).mixed(texts, [(q, at.view(Counted)) for q, at in zip(paths, places, strict=True)])
    assert Counted.reads <= 2 * lm.PREDICTORS
    few = ContextMixer(MixingLmParams(lanes=100)).mixed(texts, list(zip(paths, places, strict=True)))
    assert few == pytest.approx(wide, rel=1e-5)  # the forms for few and many lanes
    room: list[np.ndarray] = []
    first = lm._keys([b"one two", b""], room).copy()
    again = lm._keys([b"one"], room)
    assert np.shares_memory(again, room[0]) and again.shape == (lm.PREDICTORS, 4) and np.array_equal(again[:, :3], first[:, :3])
