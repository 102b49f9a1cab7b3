"""Error rates over all turns, those outside ASCII too, against brute force."""

import re
import unicodedata

import pytest

from cuelake.operators import evaluation as E
from cuelake.plans import QUERIES

TURNS = [(1, 0, "then on we go, over the moon"), (1, 1, "thé café on the córner — là"), (2, 0, "日本語 on 東京, the 都"), (2, 1, "😀 on the way"), (3, 0, "ß")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def rates(text):
    norm = lambda t: "".join(c for c in re.sub(r"\s", "", t) if not unicodedata.category(c).startswith("P"))
    rate = lambda r, h: round(distance(r, h) / len(r), 6)
    auto, hinted = text.replace("th", "t"), text.replace("on", "no")
    return rate(text, auto), rate(norm(text), norm(auto)), rate(text, hinted), rate(norm(text), norm(hinted))


def test_rates_of_all_turns(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(c, t, "user", x) for c, t, x in TURNS], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    expected = {c * 100 + t: rates(x) for c, t, x in TURNS}
    assert {r.sample_id: r.cer for r in QUERIES["i2_cer"](spark, folder).collect()} == {k: v[0] for k, v in expected.items()}
    assert {r.sample_id: tuple(r)[2:] for r in QUERIES["i3_paired_cer"](spark, folder).collect()} == expected
    assert {r.sample_id: (r.auto_norm, r.hinted_norm) for r in QUERIES["a10_eval_report"](spark, folder).collect()} == {k: (v[1], v[3]) for k, v in expected.items()}
    got = {r.lang_id: r for r in QUERIES["i4_mean_cer"](spark, folder).collect()}
    for lang in (None, 0, 1, 2):
        own = [v for k, v in expected.items() if lang is None or k // 100 % 3 == lang]
        assert got[lang].n == len(own)
        assert tuple(got[lang])[2:] == pytest.approx([sum(x) / len(own) for x in zip(*own)], abs=2e-6)


def test_means_take_each_distance_once(spark):
    """The rows of languages and of all are made of the rates, not of the texts: distances are computed below the rollup, in one pass, and not cell by cell."""
    rows = spark.createDataFrame([(1, 0, "abc", "abd", "abc")], "sample_id long, lang_id long, ref string, hyp_auto string, hyp_hinted string")
    means = E.mean_cer(E.paired_cer(rows))
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("Expand") < plan.index("ArrowEvalPython") and "levenshtein" not in plan.lower()
    assert sorted(r.auto_raw for r in means.collect()) == [pytest.approx(1 / 3)] * 2
