import random

import numpy as np
from pyspark.sql import functions as F

from cuelake.llm.language import LanguageParams, fit_language_model, fold, ftrl, ngram_slots, predict_language

SYLLABLES = {"aa": ["the", "ing", "and", "er"], "bb": ["ñe", "ción", "los", "que"], "cc": ["sch", "üb", "ein", "ge"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang))
    return out


def test_slots_follow_text_bounds():
    p = LanguageParams()
    alone = [list(ngram_slots([t], p)) for t in ("abc", "", "é", "Xy z")]
    together = list(ngram_slots(["abc", "", "é", "Xy z"], p))
    for k in range(p.max_n):
        for i in range(4):
            a, b = together[k][2][i], together[k][3][i]
            assert together[k][1][a:b].tolist() == alone[i][k][1].tolist()


def test_ftrl_zeroes_what_the_penalty_covers():
    rows = [(i % 2, np.array([i % 2]), np.array([1.0])) for i in range(50)]
    w = ftrl(rows, 3, 2, LanguageParams(l1=0.01))
    assert w[0, 0] > 0 > w[0, 1] and (w[2] == 0).all() and (ftrl(rows, 3, 2, LanguageParams(l1=1e9)) == 0).all()


def test_held_out_accuracy_and_edges(spark):
    rows = corpus() + [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, "the" * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held", fold(F.col("doc_id"), 5) == 0).selectExpr("*", "1 as score", "2 as turn")
    model = fit_language_model(df.where("not held"))
    assert model.classes == ["aa", "bb", "cc"] and model.temperature > 0
    got = {r.doc_id: r for r in predict_language(df, model, ["doc_id", "held", "lang"]).collect()}
    assert len(got) == len(rows)
    held = [r for r in got.values() if r.held and r.doc_id < 1000]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert fit_language_model(df) is None
    assert [tuple(r) for r in predict_language(df, None, ["doc_id"]).collect()] == [(1, "und", 0.0)]
    assert predict_language(df.limit(0), None, ["doc_id"]).count() == 0


def test_clashing_columns_copies_and_ties(spark):
    rows = corpus(120)
    hot = [(500 + i, rows[0][1], rows[0][2]) for i in range(400)]  # one text holds most rows
    df = spark.createDataFrame(rows + hot, "doc_id long, text string, lang string").selectExpr("*", "'mine' as score", "7 as lang_pred")
    model = fit_language_model(df, LanguageParams(train_docs=100))
    got = predict_language(df, model, df.columns, ("_lang", "_score"))
    assert got.columns == [*df.columns, "_lang", "_score"]
    rows = got.collect()
    assert all(r.score == "mine" and r.lang_pred == 7 for r in rows) and sum(r.lang == r._lang for r in rows) >= 0.95 * len(rows)
    assert len({(r._lang, r._score) for r in rows if r.doc_id >= 500}) == 1
    assert predict_language(df, model, df.columns).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert (model.table == 0).mean() > 0.5  # the elastic net leaves most n-grams without weight
