import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cuelake.llm.common import ByteHasher
from cuelake.llm.substring_dedup import SubstringParams, SuffixFiles, distinct_strings, equal_strings, remove_repeated_substrings


def brute(rows, n):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            least[s] = min(least.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if least[b[i : i + n]] < d:
                gone[i : i + n] = True
        spans = [i for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_files_hold_transform_and_common_prefixes(tmp_path, chunk):
    """After the last round: symbols before the suffixes, common prefixes, and classes, against sorted suffixes."""
    rng = random.Random(3)
    for trial in range(12):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))).encode() for _ in range(rng.randint(1, 40))]
        size = np.array([len(s) for s in strings])
        files = SuffixFiles(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size, f"{tmp_path}/{trial}", chunk).build()
        suffixes = sorted(s[len(s) - k :] for s in strings for k in range(len(s) + 1))
        parts = list(files.read())
        assert np.concatenate([c for _, _, c in parts]).tolist() == [0] + [common(a, b) for a, b in zip(suffixes, suffixes[1:])]
        before = Counter((s[len(s) - k :], s[len(s) - k - 1] + 1 if k < len(s) else 0) for s in strings for k in range(len(s) + 1))
        assert Counter(zip(suffixes, np.concatenate([b for _, b, _ in parts]).tolist())) == before
        for length in (1, 3):
            found = {}
            for j, who, group in files.classes(length):
                for w, g in zip(who, group):
                    assert found.setdefault(strings[w][len(strings[w]) - j :][:length], g) == g
            assert len(set(found.values())) == len(found)
        files.close()
        assert not list(tmp_path.iterdir())


def test_hashes_are_confirmed():
    """Strings that share a hash are equal only if their bytes are."""
    buf = np.frombuffer(b"abcdefghij" b"abcdefghij" b"abcdefghiX", np.uint8)

    class Same(ByteHasher):
        def ranges(self, prefix, start, end):
            return np.zeros(len(start), np.uint64)

    pos, ten = np.array([0, 10, 20]), np.full(3, 10)
    lead, number = distinct_strings(buf, np.zeros(3, np.uint64), pos, ten, np.array([5, 3, 4]), Same())
    assert len(lead) == 2 or len(lead) == 3
    assert number[2] not in (number[0], number[1])
    assert equal_strings(buf, np.array([0, 0]), np.array([10, 20]), np.array([10, 10])).tolist() == [True, False]


def test_equal_brute_force(spark):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcd é") for _ in range(rng.randint(30, 200))) for _ in range(12)]
    rows = []
    for d in range(90):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.append(p[a:] if rng.random() < 0.5 else p)
            parts.append("".join(rng.choice("abcd é") for _ in range(rng.randint(0, 60))))
        rows.append((d * 7 % 90, "".join(parts)))
    rows += [(200, None), (201, ""), (202, "a" * 4000), (203, "a" * 3000), (204, "ab" * 3000), (205, "ba" * 900), (206, rows[3][1]), (207, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "'x' as kind").repartition(3)
    for p in (SubstringParams(block_bytes=6000, range_bytes=9000, chunk=500), SubstringParams()):
        got = remove_repeated_substrings(df, p).collect()
        assert sorted((r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == brute(rows, 50)


def test_null_ids_and_empty(spark):
    t = "x" * 60
    df = spark.createDataFrame([(None, t), (None, None), (1, t), (1, t)], "doc_id long, text string")
    assert sorted((str(r.doc_id), len(r.kept)) for r in remove_repeated_substrings(df).collect()) == [("1", 60), ("1", 60), ("None", 0), ("None", 60)]
    assert remove_repeated_substrings(df.limit(0)).count() == 0


def phrase_rows(n):
    """A phrase of 30 bytes in varied surroundings, and some copies of it with theirs."""
    rng = random.Random(8)
    noise = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    texts = [noise(45) + "the same phrase stands in each" + noise(45) for _ in range(n)]
    return list(enumerate(texts + [noise(20) + t[20:100] + noise(20) for t in texts[: n // 10]]))


def test_hot_minimizers_equal_brute_force(spark):
    rows = phrase_rows(200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeated_substrings(df, SubstringParams(block_bytes=3000, range_bytes=5000, hot_strings=20)).collect()
    assert sorted((r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == brute(rows, 50)
    assert sum(len(r.spans) for r in got) >= 20


def test_no_minimizer_fills_a_range():
    """Of one minimizer no more than ``hot_strings`` strings reach a range, however many documents hold its phrase."""
    import pandas as pd
    import pyarrow as pa

    from cuelake.llm import substring_dedup as sd

    p, ranges = SubstringParams(hot_strings=50), 2
    texts = [t.encode() for _, t in phrase_rows(400)]
    blocks = []
    for b in range(4):
        own = texts[b::4]
        blocks.append({"block": b, "ids": sd._zip(np.arange(b, len(texts), 4)), "lens": sd._zip(np.array([len(t) for t in own])), "text": sd._zip(b"\0".join([*own, b""]))})
    frame = pd.DataFrame(blocks)
    counted = pa.Table.from_batches(list(sd._minimizers(p, ranges)(iter([pa.RecordBatch.from_pandas(frame)])))).to_pandas()
    shared = pd.concat([sd._shared(p)(x) for _, x in counted.groupby("range")])
    sent = pd.concat([sd._sender(p, ranges)((b,), frame[frame["block"] == b], shared[shared["block"] == b]) for b in range(4)])
    v = np.concatenate([sd._values(x) for x in sent["v"]])
    assert np.unique(v, return_counts=True)[1].max() <= 50
