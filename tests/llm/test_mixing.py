import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import mixing
from cuelake.llm.common import materialise
from cuelake.llm.mixing import MixingParams, calibrate, mix, rake, word_count


def brute(cells, targets, rounds=200):
    w = {k: float(t) for k, t in cells.items()}
    total = sum(w.values())
    for _ in range(rounds):
        for d, share in enumerate(targets):
            present = {v: s for v, s in share.items() if any(k[d] == v for k in w)}
            whole = sum(present.values())
            sums = {}
            for k, x in w.items():
                sums[k[d]] = sums.get(k[d], 0) + x
            w = {k: x * present[k[d]] / whole * total / sums[k[d]] for k, x in w.items()}
    return w


def test_rake_equals_brute_force(spark):
    rng = random.Random(1)
    cells = {(a, b, c): rng.randint(1, 1000) for a in "xyz" for b in "pq" for c in "mn" if rng.random() < 0.9}
    targets = [{"x": 5.0, "y": 1.0, "z": 1.0, "gone": 3.0}, {"p": 1.0, "q": 1.0}, {"m": 0.3, "n": 0.7}]
    df = spark.createDataFrame([(*k, t) for k, t in cells.items()], "a string, b string, c string, tokens long")
    frames = {n: spark.createDataFrame(list(t.items()), f"{n} string, target double") for n, t in zip("abc", targets)}
    got = {(r.a, r.b, r.c): r.weight for r in rake(df, frames, MixingParams(tolerance=1e-9)).collect()}
    want = brute(cells, targets)
    for k in cells:
        assert got[k] == pytest.approx(want[k], rel=1e-4)


def test_calibrated_tokens(spark):
    df = spark.createDataFrame([(10, 90.0), (100, 10.0), (50, 60.0)], "tokens long, weight double")
    out = calibrate(df, MixingParams(keep_share=0.5)).collect()
    assert all(0 <= r.probability <= 1 for r in out) and sum(r.tokens * r.probability for r in out) == pytest.approx(80)


def test_mix_rows_and_edges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["s0", "s0", "s1", None]), rng.choice(["en", "fr"]), rng.randint(0, 50)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens long").selectExpr("*", "1 as target", "2 as sum", "3 as cell", "4 as weight", "5 as probability", "6 as kept", "7 as gap", "8 as cell_source", "9 as t_source")
    out = mix(df, {"source": 0.0, "lang": 0.5}, MixingParams(keep_share=0.4)).collect()
    assert len(out) == 600 and all((r.probability == 0 and not r.kept) for r in out if not r.tokens)
    sums = {}
    for r in out:
        sums[r.source] = sums.get(r.source, 0) + r.tokens * r.weight
    assert np.allclose(list(sums.values()), sum(sums.values()) / 3, rtol=1e-3)
    kept = sum(r.tokens for r in out if r.kept)
    assert abs(kept / sum(r.tokens for r in out) - 0.4) < 0.08
    assert all(r.target == 1 and r.cell_source == 8 and r.t_source == 9 and r.gap <= 1e-6 for r in out)
    assert mix(df.limit(0), {"source": 1.0, "lang": 1.0}).count() == 0
    assert all(r.probability == 0 and not r.kept for r in mix(df.where("tokens = 0"), {"source": 1.0, "lang": 1.0}).collect())


def test_repeats_and_nulls(spark):
    rows = [(1, "a", 5), (1, "a", 5), (None, "a", 5), (None, "b", 7), (2, None, None)]
    out = mix(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), {"source": 1.0}).collect()
    assert len(out) == 5 and len({r.kept for r in out if r.doc_id == 1}) == 1
    assert [(r.probability, r.kept) for r in out if r.doc_id == 2] == [(0.0, False)]


def test_targets_that_contradict_each_other_are_told(spark):
    """Without any cell that mixes the two, x and y can't have 0.9 of the tokens by one marginal and 0.1 by the other."""
    df = spark.createDataFrame([("x", "p", 10), ("y", "q", 10)], "a string, b string, tokens long")
    targets = {"a": spark.createDataFrame([("x", 0.9), ("y", 0.1)], "a string, target double"), "b": spark.createDataFrame([("p", 0.1), ("q", 0.9)], "b string, target double")}
    assert all(r.gap == pytest.approx(0.8) for r in rake(df, targets, MixingParams(rounds=8)).collect())


def test_word_count(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb \n",), ("é",)], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [0, 0, 2, 1]


def test_names_clash_with_nothing_and_targets_are_given(spark):
    """Dimensions and columns of any name; target tables instead of powers, null among their values."""
    rows = [(i, 10, ["a", "b", None][i % 3], ["x", "y"][i % 2], i, "o", 0.5, 1) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, target string, sum string, _cell_target long, _odds string, _dim0 double, dim1 int")
    shares = spark.createDataFrame([("a", 0.5), (None, 0.5), ("absent", 9.0)], "target string, target_share double").withColumnRenamed("target_share", "share")
    given = shares.select(shares["target"].alias("kind"), shares["share"].alias("target"))
    out = mix(df.withColumnRenamed("target", "kind"), {"kind": given, "sum": 1.0}).collect()
    assert len(out) == 600 and {r._odds for r in out} == {"o"} and {r._dim0 for r in out} == {0.5} and {r["_cell_target"] for r in out} == set(range(600))
    mass = {k: sum(r.weight * r.tokens for r in out if r.kind == k) for k in ("a", "b", None)}
    assert mass["b"] == 0 and mass["a"] == pytest.approx(mass[None], rel=1e-3) == pytest.approx(3000, rel=1e-3)
    assert not any(r.kept for r in out if r.kind == "b")
    assert len(mix(df, {"target": 1.0, "sum": 0.5}).collect()) == 600


def test_each_plan_is_small(spark, monkeypatch):
    """A dimension more doesn't double the plan of a round."""
    seen = []

    def counted(df, *args):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return materialise(df, *args)

    monkeypatch.setattr(mixing, "materialise", counted)
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 50), *(rng.choice("xyz") for _ in range(4))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, a string, b string, c string, d string")
    assert mix(df, dict.fromkeys("abcd", 0.5)).count() == 300
    assert len(seen) > 8 and max(seen) <= 10
