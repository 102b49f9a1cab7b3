import random

from cuelake.llm import components, near_dup
from cuelake.llm.common import materialise
from cuelake.llm.near_dup import NearDupParams, near_duplicates


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [bytes(x) for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return {(d, len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets)}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(5, 120))] for _ in range(20)]
    rows = []
    for d in range(n):
        w = list(rng.choice(base[: 1 + d % 20]))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((d * 3, rng.choice([" ", "\n"]).join(w)))
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus(1) + [(1001, None), (1004, ""), (1007, " \t"), (1010, "One"), (1013, "one"), (1016, "a b"), (1019, "x " * 5000), (1022, "X " * 4999)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as id", "2 as key", "'x' as sides")
    for k, percent in ((4, 80), (5, 80)):
        got = {tuple(r) for r in near_duplicates(df, NearDupParams(shingle_words=k, percent=percent)).collect()}
        assert got == brute(rows, k, percent)


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_each_plan_is_small(spark, monkeypatch):
    """The driver holds a plan with all its stages, once for each change of it; no write has many exchanges."""
    seen = []

    def counted(df, *args):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return materialise(df, *args)

    for module in (components, near_dup):
        monkeypatch.setattr(module, "materialise", counted)
    rows = corpus(2, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_dup.near_duplicates(df, NearDupParams(shingle_words=4)).collect()} == brute(rows, 4, 80)
    assert len(seen) > 10 and max(seen) <= 10
