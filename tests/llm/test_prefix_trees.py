import os
import re

import numpy as np
import pandas as pd
import pytest

from cuelake.llm import prefix_trees as pt
from cuelake.llm.prefix_trees import PrefixTreeParams, SuffixTree, _Words, remove_repeated_passages

SMALL = PrefixTreeParams(length=4, k=2, block_bytes=300, range_bytes=500, tree_suffixes=40, sample=2, bucket_blocks=1)


def brute(rows, length):
    """(doc_id, n_words, removed word numbers, kept) by a dictionary of windows."""
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - length + 1):
            if d is not None:
                key = tuple(w[i : i + length])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - length + 1) if d is not None and least[tuple(w[i : i + length])] < d for j in range(i, i + length)}
        out.append((d, len(w), sorted(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def mine(df, p):
    got = remove_repeated_passages(df, p).collect()
    return sorted(((r.doc_id, r.n_words, [j for s in r.spans for j in range(s.start, s.start + s.length)], r.kept) for r in got), key=str)


def corpus(seed=4, n=260):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "bé", "c\0d", "日本", "x" * 30, "the", "of", *[f"w{i}" for i in range(40)]]
    spaces = [" ", "\n", "\t ", "  ", "\x0b"]
    draw = lambda k: "".join(vocabulary[i] + spaces[j] for i, j in zip(rng.integers(0, len(vocabulary), k), rng.choice(5, k, p=[0.8, 0.05, 0.05, 0.05, 0.05])))
    passages = [draw(9) for _ in range(6)]
    rows = []
    for i in range(n):
        text = draw(int(rng.integers(0, 14)))
        for _ in range(int(rng.integers(0, 3))):
            text += passages[rng.integers(0, 6)] + draw(int(rng.integers(0, 6)))
        rows.append((int(rng.permutation(3)[0] * 1000 + i), text))
    rows += [(5000 + i, rows[8][1]) for i in range(60)]  # exact copies
    rows += [(7, "the the the the the the the"), (6, "the the the the the")]  # repeats inside a document and of itself
    rows += [(9000, None), (9001, ""), (9002, " \n "), (None, rows[8][1]), (None, None), (5001, rows[9][1])]  # nulls, repeated id
    rows += [(9003, draw(400)), (9004, "of the a")]
    return rows


def test_words_and_windows():
    texts = [b" one two\nthree", b"", b"four\0five six  ", b"x"]
    sizes = np.array([len(t) for t in texts])
    words = _Words.of(np.frombuffer(b"\n".join([*texts, b""]), np.uint8), np.cumsum(sizes + 1) - sizes - 1, sizes)
    text, first = words.spaced()
    assert text.tobytes() == b"one two three four\0five six x "
    assert words.doc.tolist() == [0, 0, 0, 2, 2, 3] and first.tolist() == [0, 4, 8, 14, 24, 28, 30]
    assert words.windows(2).tolist() == [0, 1, 3]
    assert len(set(words.hashes(slice_bytes=5).tolist())) == 6 and words.hashes(5).tolist() == words.hashes().tolist()


def test_tree_nodes_are_classes_of_equal_prefixes():
    rng = np.random.default_rng(1)
    rows = [tuple(f"v{i}" for i in rng.integers(0, 3, 4)) for _ in range(200)]
    tree = SuffixTree(np.frombuffer(b"".join(f"{w} ".encode() for r in rows for w in r), np.uint8), 4)
    assert sorted(tree.order.tolist()) == list(range(200))
    for depth in (1, 2, 4):
        node = tree.deep_nodes(depth)
        assert len({(r[:depth], n) for r, n in zip(rows, node.tolist(), strict=True)}) == len({r[:depth] for r in rows}) == len(set(node.tolist()))


def test_what_a_suffix_takes_does_not_grow_with_the_trees():
    """Suffixes are sent as numbers of words: half as much as their text where a tree gets 100 of a block, and as much a suffix where it gets 4,000."""
    rng, p, ranges = np.random.default_rng(6), PrefixTreeParams(), 3
    vocabulary = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 10)))) for _ in range(20_000)]
    drawn = np.minimum(rng.zipf(1.3, 40_000) - 1, len(vocabulary) - 1).tolist()
    text = " ".join(vocabulary[i] for i in drawn).encode()
    packed = pd.DataFrame({"text": [pt._zip(text + b"\n")], "sizes": [pt._zip(np.array([len(text)]))], "ids": [pt._zip(np.array([5]))]})
    words = _Words.of(np.frombuffer(text + b"\n", np.uint8), np.array([0]), np.array([len(text)]))
    lead = rng.permutation(words.windows(p.length))[:8000]
    spelled = pd.DataFrame([{"block": 1, **r} for r in pt._Spelling.of(words, lead, p.length, ranges).dealt()])
    codes = pd.concat([pt._numberer(ranges)(g) for _, g in spelled.groupby("range")]).assign(leads=None, trees=None, amounts=None)
    sent, texts = {}, 0
    for each in (100, 4000):
        n = len(lead) // each
        plan = pd.DataFrame({"block": [1], "range": [-1], "codes": [None], "leads": [pt.squeeze(lead)], "trees": [pt.squeeze(np.arange(n))], "amounts": [pt.squeeze(np.full(n, each))]})
        found = pt._sender(p, ranges)((1,), packed, pd.concat([plan, codes]))
        sent[each] = found["symbols"].map(len).sum()
    joined = text.split(b" ")
    for a in range(0, len(lead), 100):
        texts += len(pt._zip(b"".join(b" ".join(joined[i : i + p.length]) + b" " for i in lead[a : a + 100].tolist())))
    assert sent[100] < 0.55 * texts and sent[100] < 1.2 * sent[4000]


def test_words_have_one_number_each_in_the_corpus():
    """Blocks agree on the number of a word, and no two words share one, whatever the range."""
    rng, ranges, number = np.random.default_rng(2), 4, {}
    texts = [b" ".join(b"w%d" % i for i in rng.integers(0, 300, 500)) for _ in range(3)]
    words = [_Words.of(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)])) for t in texts]
    spellings = [pt._Spelling.of(w, w.windows(4), 4, ranges) for w in words]
    spelled = pd.DataFrame([{"block": b, **r} for b, x in enumerate(spellings) for r in x.dealt()])
    codes = pd.concat([pt._numberer(ranges)(g) for _, g in spelled.groupby("range")]).sort_values("range")
    for b, (t, x) in enumerate(zip(texts, spellings, strict=True)):
        own = x.numbered(np.concatenate([pt._longs(c) for c in codes["codes"][codes["block"] == b]]))
        for w, n in zip(t.split(), own.tolist(), strict=True):
            assert number.setdefault(w, n) == n
    assert len(set(number.values())) == len(number) > 250


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as tree", "3 as v", "4 as kept").repartition(5)
    want = brute(rows, 4)
    assert sum(len(g) for _, _, g, _ in want) > 500
    assert mine(df, SMALL) == want
    assert mine(df, PrefixTreeParams(length=4, k=4)) == want
    assert mine(df.where("doc_id < 9000 or doc_id > 9002"), PrefixTreeParams(length=13)) == brute([r for r in rows if r[0] is not None and not 9000 <= r[0] <= 9002], 13)


def test_heavy_prefixes_are_extended(spark):
    """Most suffixes begin with the same words; the result stays whole when their prefixes grow to all words of a window."""
    rows = [(i, "a a a a b " * 6 + f"u{i} " + "a a a a c " * 4) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert mine(df, SMALL) == brute(rows, 4)


def test_empty_table_and_bad_parameters(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_passages(df).count() == 0
    with pytest.raises(ValueError):
        remove_repeated_passages(df, PrefixTreeParams(length=4, k=5))


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from cuelake.llm import queries as Q

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = sorted(con.execute(Q.ORACLES["op12_substring_dedup"]).fetchall())
    assert sorted(tuple(r) for r in Q.op12_substring_dedup(spark, path).collect()) == want


def test_memory_of_a_block(monkeypatch):
    """Passes over a block hold few bytes for each of its bytes, since they work in slices with 32-bit places."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, int(rng.integers(1, 10))))) for _ in range(20_000)]
    draw = lambda n: " ".join(np.array(vocabulary)[rng.integers(0, len(vocabulary), n)])
    shared = [draw(400) for _ in range(20)]
    texts = [draw(400) + " " + shared[i % 20] for i in range(1700)]
    n = sum(map(len, texts))
    p = PrefixTreeParams(block_bytes=1 << 40)
    monkeypatch.setattr(pt, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())}))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1700)), "text": texts, "n": [len(t) for t in texts]})

    def peak(run):
        tracemalloc.start()
        out = run()
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert held < 11 * n
        return out

    block = pa.Table.from_batches(peak(lambda: list(pt._blocks(p)(iter([batch]))))).to_pandas()
    plan = peak(lambda: pt._planner(p, 1, [], 1)((0,), block, pt._shared(block)))
    cut = peak(lambda: pt._cutter(p)((0,), block, plan.assign(tree=-1, bits=None)[["block", "tree", "bits", "places", "numbers", "leads", "amounts"]].iloc[:0]))
    assert cut["kept"].tolist() == [t.encode() for t in texts] and cut["n_words"].tolist() == [len(t.split()) for t in texts]
