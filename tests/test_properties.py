"""Operators against sequential specifications on seeded random rows."""

import random

from cuelake.operators import captions as C
from cuelake.operators import segments as S
from cuelake.params import CueParams


def test_absorb_equals_the_loop_without_islands(spark):
    rng, rows = random.Random(1), {}
    for job in range(150):
        at, own = 0, []
        for _ in range(rng.randint(1, 12)):
            at += rng.choice([100, 500, 2000, 3000, 3001, 5000])
            own.append((at, at := at + rng.choice([200, 500, 900, 1000, 4000])))
        rows[job] = own
    df = spark.createDataFrame([(j, s, e) for j, own in rows.items() for s, e in own], "job_id int, start_ms long, end_ms long")
    got = {}
    for r in S.absorb_short(df, 1000, 3000).collect():
        got.setdefault(r.job_id, []).append((r.start_ms, r.end_ms))
    assert {j: sorted(v) for j, v in got.items()} == {j: S._absorb(list(own), 1000, 3000) for j, own in rows.items()}


def test_final_segments_hold(spark):
    rng = random.Random(2)
    frames = [(j, i, rng.random()) for j in range(20) for i in range(120)]
    df = spark.createDataFrame(frames, "job_id int, frame_idx long, prob double")
    from cuelake.params import VadParams

    stages = S.merge_stages(df, VadParams(min_silence=500, max_chunk=3000), 500)
    final = sorted((r.job_id, r.start_ms, r.end_ms) for r in stages["final"].collect())
    assert all(e - s <= 3000 for _, s, e in final)
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(final, final[1:], strict=False))
    raw = {(r.job_id, t) for r in stages["raw"].collect() for t in range(r.start_ms, r.end_ms, 500)}
    assert raw <= {(j, t) for j, s, e in final for t in range(s, e, 500)}


def test_splitting_loses_no_text(spark):
    rng = random.Random(3)
    rows = [(1, i, 0.0, rng.uniform(0, 20), "".join(rng.choice("abc .,가나。") for _ in range(rng.randint(1, 150)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id int, cue_idx int, start_sec double, end_sec double, text string")
    got: dict[int, str] = {}
    for r in C.split_long_cues(df, CueParams()).orderBy("cue_idx", "k").collect():
        got[r.cue_idx] = got.get(r.cue_idx, "") + "".join(r.text.split())
    assert got == {i: "".join(t.split()) for _, i, _, _, t in rows if t.split()}
