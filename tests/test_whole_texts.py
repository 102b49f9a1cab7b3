"""Queries over whole lines and texts, against brute force on a small fixture."""

import re

import pytest

from cuelake.plans import QUERIES

SAME = "every line begins with these same words and goes on, "
LOOP = SAME + "x" * 3 + " and then far beyond column one hundred and twenty of the line there is " + "la di da " * 6
DOCS = {
    1: [SAME + "one", SAME + "two", (SAME + "two").upper() + ".", LOOP, SAME + "three", LOOP, "", SAME + "three", SAME + "three"],
    2: [LOOP, LOOP, SAME + "four", SAME + "four.", SAME + "five", SAME + "four", SAME + "four", SAME + "four"],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(d, "\n".join(x), "en", "web", len("\n".join(x))) for d, x in DOCS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def status(d, c):
    kind = (d * 7 + c * 3) % 11
    return "failed" if kind == 0 else "vad_extracted" if kind == 1 else "transcribed"


def repeated(text):
    m = re.search(r"(.{2,20}?)\1{4}", text)
    return m and m.group(1)


def filtered(strip):
    """(text, flags, context) of every line, one after another."""
    out = {}
    for d, texts in DOCS.items():
        genuine = ""
        for c, text in enumerate(texts, 1):
            form = lambda t: re.sub(r"[.]+$", "", " ".join(t.split())).lower()
            ok, context = status(d, c) != "failed", genuine
            echo = ok and bool(text.strip()) and bool(genuine.strip()) and form(text) == form(genuine)
            loop = ok and not echo and repeated(text) is not None
            flags = "possible_duplicate_hallucination" if echo else "possible_infinite_repetition" if loop else ""
            if ok and not echo and not (loop and strip):
                genuine = text
            out[d, c] = ("" if echo or (loop and strip) else text, flags, context)
    return out


@pytest.mark.parametrize("name,strip", [("d9_echo_suppression_whole", False), ("d10_repetition_suppression_whole", True)])
def test_suppression(spark, folder, name, strip):
    got = {(r.job_id, r.chunk_id): (r.text, r.flags, r.context) for r in QUERIES[name](spark, folder).collect()}
    assert got == filtered(strip)
    assert {"possible_duplicate_hallucination", "possible_infinite_repetition"} <= {x[1] for x in got.values()}


def test_flags_context_units_and_prompts(spark, folder):
    flags = [x[1] for x in filtered(False).values()]
    assert {r.flags: r.n for r in QUERIES["d11_flags_whole"](spark, folder).collect()} == {f: flags.count(f) for f in flags}
    assert {(r.job_id, r.chunk_id): r.context for r in QUERIES["d12_context_whole"](spark, folder).collect()} == {k: x[2] for k, x in filtered(True).items()}
    units = {(d, c): repeated(t) for d, x in DOCS.items() for c, t in enumerate(x, 1) if repeated(t)}
    assert {(r.job_id, r.chunk_id): r.unit for r in QUERIES["d7_repetition_whole"](spark, folder).collect()} == units and units
    for r in QUERIES["d2_template_prompt"](spark, folder).collect():
        text = "\n".join(DOCS[r.doc_id])
        assert r.prompt.endswith(f"Before: {text}\n{text}")


def test_stream(spark, folder):
    got = {(r.job_id, r.chunk_id): r.text for r in QUERIES["j2_stateful_echo_filter_whole"](spark, folder).collect()}
    assert got == {k: x[0] for k, x in filtered(False).items()}
