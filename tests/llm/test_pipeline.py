"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402

SYLLABLES = {"aa": ["the", "ing", "and", "er"], "bb": ["ñe", "ción", "los", "que"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))
    docs = {}
    for i in range(120):
        lang = rng.choice(["aa", "aa", "bb"])
        text = " ".join(word(lang) for _ in range(rng.randint(30, 90)))
        if i % 10 == 0:
            text += f" password={rng.getrandbits(72):018x} end"
        elif i % 10 == 5:
            text += f" me.{i}@host.com {rng.randint(10**11, 10**12)} "
        docs[i] = (i, text, lang, f"src{i % 3}", len(text))
    for i in range(10):  # near copies of long documents
        t = docs[i][1].split()
        t[0] = "zzz"
        docs[200 + i] = (200 + i, " ".join(t), *docs[i][2:])
    docs[300] = (300, None, "aa", "src0", 0)
    docs[301] = (301, "12 34 !", "aa", None, 7)
    docs[302] = (302, "", None, "src1", 0)
    return docs


def test_stages(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame(list(docs.values()), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    df, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = df
        df = stage(spark, df, str(tmp_path))
        if name != "packing":
            assert df.columns == before.columns
        df.write.parquet(str(tmp_path / name.replace(" ", "-")))
        df = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        seen.append({r.doc_id: r for r in df.collect()})
    language, near, secrets, mixed, packed = seen
    assert set(docs) - set(language) == {300, 301, 302}
    gone = set(language) - set(near)
    assert gone <= set(range(200, 210)) and len(gone) >= 8
    assert set(secrets) == set(near)
    assert all(("[SECRET]" in r.text) == (i < 200 and i % 10 == 0 or i == 200) and r.n_chars == len(r.text) for i, r in secrets.items())
    assert set(mixed) < set(secrets) and sum(len(r.text.split()) for r in mixed.values()) > 0.6 * sum(len(r.text.split()) for r in secrets.values())
    assert set(packed) == set(mixed)


def test_clashing_columns_repeats_and_empty_table(spark, tmp_path):
    """Columns named like the stages' own pass through all stages but the last; repeated rows and an empty table don't break any."""
    docs = corpus()
    rows = [*docs.values(), docs[3], docs[3], (None, docs[4][1], "aa", "src0", 5), docs[5][:3] + (None, 1)]
    names = ["weight", "score", "lang_pred", "topic", "tokens", "kept", "probability", "gap", "component_id", "path", "n", "label", "features"]
    for suffix, limit in (("full", None), ("empty", 0)):
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'{n}' as {n}" for n in names])
        df = df if limit is None else df.limit(0)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = df.columns
            stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / f"{suffix}-{name.replace(' ', '-')}"))
            df = spark.read.parquet(str(tmp_path / f"{suffix}-{name.replace(' ', '-')}"))
            assert df.columns == before
            got = df.collect()
            assert all(r[n] == n for r in got for n in names)
            if limit is None and name != "mixing sources to target weights":
                assert sum(r.doc_id == 3 for r in got) == 3 and sum(r.doc_id is None for r in got) == 1
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() >= len({r.doc_id for r in got})
