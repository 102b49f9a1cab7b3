import random
import tracemalloc

import numpy as np
import pytest

from cuelake.llm.packing import PackingParams, ShardIndex, WordTokens, fit_cells, pack, pack_shard, places, tail_vectors

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def reference(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


ODD = ["", "Hello, world... it's 1.5% of \"that\".", "a.b,c <|endoftext|>x <|EndOfText|> y", "é e\u0301 \u0301x ﬁ ß İ ǅ", "\u3000全角 \u00a0nbsp\u00a0 \x1c \x85", "don't DON'T ...,,, .,a .a. (b.), c.)", "x" * 5000, "😀😀. ١٢٣,"]


def test_words_give_the_ids_of_the_whole_text():
    words = WordTokens(PATH, 5)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abÉ .,'\n1!") for _ in range(60)) for _ in range(150)]
    for group in (texts, texts[::-1]):
        ids, bound = words.encode([t.encode() for t in group])
        for t, a, b in zip(group, bound[:-1], bound[1:]):
            assert ids[a:b].tolist() == reference(t), t


def test_pieces_cover_every_id_once(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 40, 300, 900])))) for i in range(120)]
    rows += [(500, None), (501, ""), (501, ""), (None, "null id"), (502, ODD[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as place", "3 as n", "4 as width", "5 as doc_tokens").repartition(3)
    p = PackingParams(PATH, window=256, shard_tokens=4000)
    pieces = pack(df, p).collect()
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, t in dict(rows).items():
        if d == 501:
            assert [r.length for r in by_doc[d]] == [1, 1]
            continue
        got, at = [], 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at
            got += np.frombuffer(r.ids, "<u4").tolist()
            at += r.length
        assert got == reference(t or "") + [1] and at == by_doc[d][0].doc_tokens
    padding = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        padding += 256 - at
    assert padding < 0.05 * sum(r.length for r in pieces)
    assert pack(df.limit(0), p).count() == 0


def brute_scores(tails, seed, idf, mean, p):
    """BM25 of every tail for all distinct tokens of the seed."""
    query = set(tails[seed].tolist())
    out = []
    for t in tails:
        tf = {w: t.tolist().count(w) for w in query}
        out.append(sum(idf[w] * f * (p.k1 + 1) / (f + p.k1 * (1 - p.b + p.b * len(t) / mean)) for w, f in tf.items()))
    return out


def test_neighbours_equal_brute_force():
    """Unused neighbours come in the order of brute-force BM25, with common and rare tokens, beyond the first sixteen."""
    rng = np.random.default_rng(3)
    tails = [np.minimum(rng.zipf(1.4, rng.integers(1, 60)), 199).astype("<u2") for _ in range(70)]
    df = np.array([sum(w in t for t in tails) for w in range(200)])
    idf, p = np.log1p((70 - df + 0.5) / (df + 0.5)), PackingParams(PATH)
    mean = float(np.mean([len(t) for t in tails]))
    index = ShardIndex(tails, idf, mean, p)
    assert (index.row >= 0).any() and (index.row[np.unique(np.concatenate(tails))] < 0).any()
    for seed in range(0, 70, 7):
        unused = rng.random(70) < 0.8
        want = brute_scores(tails, seed, idf, mean, p)
        got = list(index.neighbours(seed, unused))
        assert sorted(got) == [i for i in range(70) if unused[i] and want[i] > 0]
        assert all(want[a] >= want[b] - 1e-3 for a, b in zip(got, got[1:]))


def test_windows_equal_brute_force():
    """Each window is its seed and the best unused neighbours, as a plain loop over all tails finds them."""
    rng = np.random.default_rng(5)
    tails = [rng.integers(group * 40, group * 40 + 50, rng.integers(5, 40)).astype("<u2") for group in rng.integers(0, 4, 50)]
    df = np.array([sum(w in t for t in tails) for w in range(210)])
    idf, p = np.log1p((50 - df + 0.5) / (df + 0.5)), PackingParams(PATH, window=64)
    mean = float(np.mean([len(t) for t in tails]))
    left, begun, want, window, room = [len(t) for t in tails], [0] * 50, [], [], 64
    for seed in sorted(range(50), key=lambda i: -len(tails[i])):
        while left[seed]:
            scores = brute_scores(tails, seed, idf, mean, p)
            for i in [seed, *sorted((i for i in range(50) if i != seed and scores[i] > 0), key=lambda i: -scores[i])]:
                n = min(room, left[i])
                if not n:
                    continue
                window.append((i, begun[i], n))
                begun[i], left[i], room = begun[i] + n, left[i] - n, room - n
                if not room:
                    want.append(window)
                    window, room = [], 64
                    break
    got = list(pack_shard(tails, idf, mean, p))
    assert got == [*want, *([window] if window else [])]


def test_neighbours_share_words(spark):
    a, b = "alpha beta gamma delta " * 12, "omega sigma kappa lambda " * 12
    df = spark.createDataFrame([(i, a if i % 2 else b) for i in range(40)], "doc_id long, text string")
    seqs = {}
    for r in pack(df, PackingParams(PATH, window=256, min_df=2)).collect():
        seqs.setdefault(r.sequence_id, set()).add(r.doc_id % 2)
    assert sum(len(s) == 1 for s in seqs.values()) >= len(seqs) - 2


def test_other_tokenizers_encode_whole_texts():
    """A file that keeps case, or joins text across spaces, gives its own ids."""
    from tokenizers import Tokenizer

    import os

    folder = os.path.dirname(PATH)
    assert WordTokens(PATH, 100).by_word
    others = [f for f in sorted(os.listdir(folder)) if f.endswith(".json") and f != os.path.basename(PATH)]
    for name in others:
        path = os.path.join(folder, name)
        try:
            plain = Tokenizer.from_file(path)
        except Exception:
            continue
        ids, bound = WordTokens(path, 1000).encode([t.encode() for t in ODD])
        for t, a, b in zip(ODD, bound[:-1], bound[1:]):
            assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, (name, t)


def test_best_neighbour_lies_in_the_shard(spark):
    """With twenty shards, the best BM25 neighbour over all tails is found in the seed's own shard in 0.9 or more of cases."""
    rng = random.Random(8)
    common = [f"common{i}" for i in range(60)]
    rows = []
    for topic in range(240):
        own = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(25)]
        rows += [" ".join(rng.choice(own if rng.random() < 0.5 else common) for _ in range(60)) for _ in range(4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    words = WordTokens(PATH, 100_000)
    ids, bound = words.encode([t.encode() for t in rows])
    tails = [np.append(ids[a:b], 1) for a, b in zip(bound[:-1], bound[1:])]
    total = sum(map(len, tails))
    p = PackingParams(PATH, window=512, shard_tokens=-(-total // 20))
    task = {}
    for r in pack(df, p).select("doc_id", "sequence_id").collect():
        task.setdefault(r.doc_id, set()).add(r.sequence_id >> 32)
    assert len(set().union(*task.values())) >= 18 and all(len(t) == 1 for t in task.values())
    vocab = words.vocab
    dfs = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=vocab)
    idf = np.log1p((len(tails) - dfs + 0.5) / (dfs + 0.5))
    weight = np.zeros((len(tails), vocab), np.float32)
    for i, t in enumerate(tails):
        w, f = np.unique(t, return_counts=True)
        weight[i, w] = idf[w] * f * (p.k1 + 1) / (f + p.k1 * (1 - p.b + p.b * len(t) / (total / len(tails))))
    hits = []
    for seed in range(0, len(tails), 3):
        score = (weight[:, np.unique(tails[seed])]).sum(axis=1)
        score[seed] = -1
        hits.append(task[seed] == task[int(score.argmax())])
    assert np.mean(hits) >= 0.9, np.mean(hits)


def test_places():
    """Copies share a place, tails of untelling tokens have none, and the order of the sample does not matter."""
    rng = np.random.default_rng(4)
    p = PackingParams(PATH, dimensions=8)
    idf = np.where(np.arange(50) < 40, 1.0, 0.0)
    tails = [rng.integers(0, 40, 30).astype("<u2") for _ in range(30)]
    tails += [tails[3].copy(), np.array([45, 46, 47], "<u2")]
    v = tail_vectors(tails, idf, 30.0, p)
    centre, cells = fit_cells(v, 5)
    again = fit_cells(v[::-1], 5)
    assert np.array_equal(centre, again[0]) and np.array_equal(cells, again[1]) and cells.shape == (5, 8)
    at = places(v, centre, cells)
    assert at[3] == at[30] and at[31] == -1 and (at[:31] >= 0).all()
    assert (places(v[31:], *fit_cells(v[31:], 5)) == -1).all()
    assert len(set(places(v[:1].repeat(3, axis=0), *fit_cells(v[:1], 5)).tolist())) == 1


def test_cells_are_fitted_in_little_memory():
    """Tails are measured against all centroids some at a time: at once, they took four bytes for each pair in the driver."""
    x = np.random.default_rng(5).normal(size=(20_000, 8)).astype(np.float32)
    tracemalloc.start()
    fit_cells(x, 256, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6
