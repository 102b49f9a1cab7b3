"""Golden cases, one behaviour each."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuelake.functions import distance as D
from cuelake.functions import text as T
from cuelake.operators import captions as C
from cuelake.operators import correction as K
from cuelake.operators import segments as S
from cuelake.operators import transcripts as X
from cuelake.operators import translation as H
from cuelake.params import CueParams, FilterParams, unlimited_if_negative


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("sec, srt", [(0.0005, "00:00:00,000"), (3661.5, "01:01:01,500"), (360000.0, "100:00:00,000")])
def test_timestamps(spark, sec, srt):
    assert one(spark, T.srt_timestamp(F.col("s")), s=sec) == srt
    assert one(spark, T.hms(F.col("s")), s=sec) == srt.replace(",", ".")


def test_parse_timestamp(spark):
    assert one(spark, T.parse_srt_timestamp(F.col("s")), s=" 01:02:03,004 ") == 3723.004
    assert one(spark, T.parse_srt_timestamp(F.col("s")), s="1:2:3") is None
    with pytest.raises(Exception, match="not an SRT timestamp"):
        one(spark, T.parse_srt_timestamp(F.col("s"), strict=True), s="x")


@pytest.mark.parametrize("sec, eta", [(0.5, "0:00"), (59.6, "1:00"), (3599.0, "59:59"), (3600.0, "1:00:00"), (-3.0, "0:00")])
def test_eta(spark, sec, eta):
    assert one(spark, T.format_eta(F.col("s")), s=sec) == eta


@pytest.mark.parametrize("text, unit", [("ö" * 11, "öö"), ("xxabababababyy", "ab"), ("abab", None), ("a\nba\nba\nba\nba\nb", "a\nb")])
def test_repetition(spark, text, unit):
    assert one(spark, T.repetition(F.col("t")), t=text) == unit


def test_asr_response(spark):
    raw = "language Finnish<asr_text>yksi, kaksi"
    assert one(spark, T.asr_language(F.col("t")), t=raw) == "Finnish" and one(spark, T.asr_text(F.col("t")), t=raw) == "yksi, kaksi"
    assert one(spark, T.asr_language(F.col("t")), t="x") == "?" and one(spark, T.asr_text(F.col("t")), t=" x　") == "x"


def test_dedup_form(spark):
    assert one(spark, T.dedup_form(F.col("t")), t="Quite so.") == one(spark, T.dedup_form(F.col("t")), t=" quite\u3000SO…!")
    assert one(spark, T.dedup_form(F.col("t")), t="Straße  A.") == "strasse a"


def test_edit_distances_are_exact(monkeypatch):
    """Against the plain table, with bands that are too narrow at first, words that end within a text, and blocks of few pairs."""

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng, pairs = random.Random(5), [("", ""), ("", "ab"), ("a", ""), ("x", "x" * 300), ("x" * 300, "y")]
    for n in (1, 7, 63, 64, 65, 128, 129, 200):
        for letters in ("ab", "añ가\U0001f600xyz 。"):
            text = rng.choices(letters, k=n)
            for changes in (0, 2, 40):
                other = list(text)
                for _ in range(changes):
                    at = rng.randrange(len(other) + 1)
                    other[at : at + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(2))
                pairs.append(("".join(text), "".join(other)))
    want = [plain(a, b) for a, b in pairs]
    for band, block in ((64, 1024), (1, 3), (7, 1)):
        monkeypatch.setattr(D, "BAND", band)
        monkeypatch.setattr(D, "PAIRS", block)
        assert D.edit_distances(*map(list, zip(*pairs, strict=True))).tolist() == want


def test_distances_of_null(spark):
    assert one(spark, D.edit_distance(F.col("r"), F.lit(None).cast("string")), r="ab") is None
    assert one(spark, T.cer(F.col("r"), F.lit(None).cast("string")), r="ab") is None


@pytest.mark.parametrize("ref, hyp, rate", [("", "", 0.0), ("", "x", 1.0), ("añb", "ab", 1 / 3), ("abc", "abc", 0.0)])
def test_cer(spark, ref, hyp, rate):
    assert one(spark, T.cer(F.col("r"), F.col("h")), r=ref, h=hyp) == pytest.approx(rate)


def test_cer_form(spark):
    assert one(spark, T.cer_form(F.col("t")), t="Ünder, this。 (a-b) $1") == "Ünderthisab$1"


def test_prompts(spark):
    template, none = F.lit("{{language_hint}}{{vocabulary}}[{{context}}]"), F.array().cast("array<string>")
    assert one(spark, T.template_prompt(template, F.lit("c"), F.lit("auto"), none)) == "[c]"
    assert "- {{context}}\n" not in one(spark, T.template_prompt(template, F.lit("c"), F.lit("ko"), F.array(F.lit("{{context}}"), F.lit(" "))))
    assert one(spark, T.translation_prompt(F.lit("{{target_language}}:{{vocabulary}}"), F.lit("ko"), F.array(F.lit("Kim")))) == "ko:Vocabulary (proper nouns/terms that may appear):\n- Kim\n\n"


def test_tagged_output(spark):
    out = lambda t, **k: one(spark, T.tagged_output(F.col("t"), F.lit("raw"), **k), t=t)
    assert (out("a<OUTPUT>\nx \n</OUTPUT>"), out("<OUTPUT> </OUTPUT>"), out("<OUTPUT>x"), out("<OUTPUT>x", allow_unclosed=True)) == ("x", "raw", "raw", "x")


# --- segments ----------------------------------------------------------------------------------------


def segs(spark, rows):
    return spark.createDataFrame([(1, s, e) for s, e in rows], "job_id int, start_ms long, end_ms long")


def pairs(df):
    return sorted((r.start_ms, r.end_ms) for r in df.collect())


def test_silence_merge(spark):
    assert pairs(S.merge_silences(segs(spark, [(0, 1000), (1700, 2000), (2710, 3000)]), 700)) == [(0, 2000), (2710, 3000)]


@pytest.mark.parametrize("rows, cap, out", [
    ([(0, 5000), (8000, 8500), (9000, 12000)], 3000, [(0, 5000), (8000, 12000)]),
    ([(0, 5000), (10000, 10700), (20000, 25000)], 3000, [(0, 5000), (10000, 10700), (20000, 25000)]),
    ([(0, 5000), (10000, 10700), (20000, 25000)], None, [(0, 10700), (20000, 25000)]),
    ([(0, 5000), (6000, 6500), (7500, 9000)], 3000, [(0, 6500), (7500, 9000)]),
    ([(0, 100)], None, [(0, 100)]),
])
def test_absorb(spark, rows, cap, out):
    assert pairs(S.absorb_short(segs(spark, rows), 1000, cap)) == out


def test_force_split(spark):
    assert pairs(S.force_split(segs(spark, [(0, 95_000), (100_000, 160_000)]), 30_000)) == [(0, 30_000), (30_000, 60_000), (60_000, 90_000), (90_000, 95_000), (100_000, 130_000), (130_000, 160_000)]
    assert unlimited_if_negative(-1) is None and unlimited_if_negative(3) == 3


# --- captions -----------------------------------------------------------------------------------------

SRT = "7\n00:01:10,250 --> 00:01:12,000\nThe harbour opens\nat élan past nine.\n\n9\n01:00:00,000 --> 01:00:01,500\nNo boats leave.\n"


def srt(spark, text, **k):
    return [(r.start_sec, r.end_sec, r.text) for r in C.parse_srt(spark.createDataFrame([(1, text)], "doc_id int, text string"), **k).orderBy("cue_idx").collect()]


def test_parse_srt(spark):
    assert srt(spark, SRT) == [(70.25, 72.0, "The harbour opens at élan past nine."), (3600.0, 3601.5, "No boats leave.")]
    assert srt(spark, SRT, preserve_newlines=True)[0][2] == "The harbour opens\nat élan past nine."
    assert srt(spark, SRT.replace("\n", "\r\n")) == srt(spark, SRT)
    assert srt(spark, "no timing\nhere\n\n1\nx 00:00:01,000 -->00:00:02,000 y\ntext\n\n2\n00:00:03,000 --> 00:00:04,000\n  \n") == [(1.0, 2.0, "text")]
    assert srt(spark, "00:00:01,000 --> 00:00:02,000\na\n \n2\n00:00:03,000 --> 00:00:04,000\nb") == [(1.0, 2.0, "a 2 00:00:03,000 --> 00:00:04,000 b")]
    assert srt(spark, "") == []


def cue(spark, text, start, end):
    return spark.createDataFrame([(1, 1, start, end, text)], "doc_id int, cue_idx int, start_sec double, end_sec double, text string")


def test_speaker_cues(spark):
    a, b = C.speaker_cues(cue(spark, "Is it far?[[SPEAKER]]A mile.", 0.0, 4.0)).orderBy("k").collect()
    assert (a.text, b.text) == ("Is it far?", "A mile.") and b.start_sec == pytest.approx(40 / 17) and a.end_sec == pytest.approx(40 / 17 - 0.08) and b.end_sec == 4.0
    assert C.speaker_cues(cue(spark, " [[SPEAKER]] ", 0.0, 1.0)).count() == 0


def test_long_split(spark):
    texts = lambda t, s, e, p: [r.text for r in C.split_long_cues(cue(spark, t, s, e), p).orderBy("k").collect()]
    only = CueParams(cps_threshold=None, max_duration=None, max_chars=10)
    assert texts("abcdefghij.k", 0.0, 1.0, only) == ["abcdefghij.", "k"]
    assert texts("가나다라마바사아자차카타", 0.0, 1.0, only) == ["가나다라마바사아자차", "카타"]
    assert texts("x" * 50, 1.0, 1.0, CueParams()) == ["x" * 50]
    assert texts("short", 0.0, 20.0, CueParams(max_duration=None)) == ["short"]


# 0.2 and 2.8 are 2.5999999999999996 apart, and 15 characters a second allow 39 in 2.6 s, so this cue stays whole (its sentence end is the 40th).
SHORT_BY_A_BIT = ("Ha eron ble halyed orannd tiealy ontion.", 0.2, 2.8)


def test_long_split_of_inexact_duration(spark):
    assert [r.text for r in C.split_long_cues(cue(spark, *SHORT_BY_A_BIT)).collect()] == [SHORT_BY_A_BIT[0]]


def test_split_limit_of_inexact_duration(spark):
    text, start, end = SHORT_BY_A_BIT
    rows = cue(spark, text, start, end).select(C.split_limit(F.length("text"), F.col("end_sec") - F.col("start_sec"), CueParams()).alias("most"))
    assert rows.first().most == 39


def test_times_of_pieces_of_inexact_duration(spark):
    rows = C.split_long_cues(cue(spark, *SHORT_BY_A_BIT), CueParams(max_chars=None)).collect()
    assert [(round(r.start_sec, 7), r.end_sec, r.text) for r in rows] == [(0.2, 2.8, SHORT_BY_A_BIT[0])]


def test_postprocess_of_inexact_duration(spark):
    text = f"1\n00:00:00,200 --> 00:00:02,800\n{SHORT_BY_A_BIT[0]}\n"
    assert C.postprocess_srt(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().text == text


def test_split_report_of_inexact_duration(spark):
    cues = cue(spark, *SHORT_BY_A_BIT)
    assert C.split_report(cues, C.split_long_cues(cues)).count() == 0


def test_order_check(spark):
    rows = [(1, 1, 0.0, 2.0, "a"), (1, 2, 1.0, 3.0, "b"), (1, 3, 3.0, 2.5, "c")]
    df = spark.createDataFrame(rows, "doc_id int, cue_idx int, start_sec double, end_sec double, text string")
    assert [r.cue_idx for r in C.order_violations(df).collect()] == [2, 3]
    with pytest.raises(ValueError):
        C.order_violations(df, strict=True)


def test_overlap_guard(spark):
    rows = [(1, 1, 0, 10), (1, 2, 5, 30), (1, 3, 10, 20), (2, 1, 0, 5), (2, 2, 5, 6)]
    df = spark.createDataFrame(rows, "job_id int, chunk_id int, start_ms long, end_ms long")
    assert sorted((r.job_id, r.chunk_id) for r in X.drop_overlaps(df).collect()) == [(1, 1), (1, 3), (2, 1), (2, 2)]


# --- transcripts --------------------------------------------------------------------------------------


def chunks(spark, rows):
    return spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate(rows, 1)], "job_id int, chunk_id int, status string, text string")


def test_echo_filter(spark):
    loop = "ab" * 6
    rows = [("transcribed", "Quite so."), ("transcribed", "quite so"), ("failed", None), ("transcribed", "Quite SO!"), ("transcribed", loop), ("transcribed", loop), ("transcribed", ""), ("transcribed", "")]
    got = X.suppress_echoes(chunks(spark, rows), FilterParams(dedup_repeated=True)).orderBy("chunk_id").collect()
    assert [r.text for r in got] == ["Quite so.", "", "", "", loop, "", "", ""]
    assert [r.flags for r in got] == [[], [X.DUPLICATE], [], [X.DUPLICATE], [X.REPEATED], [X.DUPLICATE], [], []]
    assert [r.context for r in got] == ["", *["Quite so."] * 4, loop, loop, ""]
    strict = X.suppress_echoes(chunks(spark, rows), FilterParams(dedup_repeated=True, strip_repetition=True)).orderBy("chunk_id").collect()
    assert [r.text for r in strict][4:6] == ["", ""] and strict[5].flags == [X.REPEATED] and strict[6].context == "Quite so."


def test_breaker(spark):
    rows = [("failed", None)] * 4 + [("transcribed", "x")] + [("failed", None)] * 5
    assert [tuple(r) for r in X.aborted_jobs(chunks(spark, rows)).collect()] == [(1, 5)]
    assert X.aborted_jobs(chunks(spark, rows[:6])).count() == 0


def test_model_map_retries(spark):
    def flaky(request):
        if request == "bad":
            raise ValueError("no")
        return request.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad")], "id int, request string")
    got = sorted(X.model_map(df, ["id"], flaky).collect())
    assert [tuple(r)[:5] for r in got] == [(1, True, "A", None, 1), (2, False, None, "no", 2)] and all(r.elapsed_ms >= 0 for r in got)


def test_an_answer_of_none_is_a_failure(spark):
    df = spark.createDataFrame([(1, "a")], "id int, request string")
    (r,) = X.model_map(df, ["id"], lambda request: None).collect()
    assert (r.ok, r.raw, r.error, r.attempts) == (False, None, "no answer", 2)


def test_observed_counts(spark):
    """What a map did is observed."""

    def model(request):
        if request == "2":
            raise ValueError("no")
        return request

    df = spark.createDataFrame([(i, str(i)) for i in range(10)], "id int, request string")
    out, seen = X.observed(X.model_map(df, ["id"], model, retries=0), "test calls")
    out.collect()
    told = seen.get
    assert (told["asked"], told["ok"], told["failed"], told["stopped"]) == (10, 9, 1, 0) and told["mean_ms"] >= 0


def test_correction_map(spark):
    """Every call gets its group's whole block and the chunk; a group's calls follow each other."""
    df = chunks(spark, [("transcribed", f"t{i}") for i in range(1, 6)])
    groups = K.context_groups(df, 4, 2)
    blocks = K.transcript_blocks(df, groups)
    want = {r.chunk_id: r.request for r in K.correction_requests(df, groups, blocks).collect()}
    for n in (50, 2, 1):  # the chunks of a group in one run or in several
        got = {r.chunk_id: r.raw for r in K.correction_map(df, groups, blocks, lambda request: request, run_chunks=n).collect()}
        assert got == want and len(got) == 5


def test_correction_map_streams_its_runs(spark):
    """Many short jobs are streamed through a task's one function, not passed to Python group by group; each call still gets its own job's block."""
    df = spark.createDataFrame([(j, c, "transcribed", f"{j}.{c}") for j in range(200) for c in (2**60, 2**60 + 1)], "job_id int, chunk_id long, status string, text string")
    groups = K.context_groups(df)
    out = K.correction_map(df, groups, K.transcript_blocks(df, groups), lambda request: request, run_chunks=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "CoGroups" not in plan
    want = {(j, c): f"<FULL_TRANSCRIPT>\n{2**60} {j}.{2**60}\n{2**60 + 1} {j}.{2**60 + 1}\n</FULL_TRANSCRIPT>\n\n<CURRENT>\n{c} {j}.{c}\n</CURRENT>" for j in range(200) for c in (2**60, 2**60 + 1)}
    assert {(r.job_id, r.chunk_id): r.raw for r in out.collect()} == want


def test_translation_tells_failed_batches(spark):
    def model(request):
        if "rope" in request:
            raise ValueError("no")
        return request.upper()

    answers = H.translate_batches(lines(spark, ["oar", "rope", "tar"]), 12, model)
    assert [(r.batch_id, r.ok, r.error) for r in answers.orderBy("batch_id").collect()] == [(1, True, None), (2, False, "no"), (3, True, None)]
    assert [(r.serial, r.text) for r in H.translated(answers).orderBy("serial").collect()] == [(1, "OAR"), (3, "TAR")]


def test_payloads(spark):
    sound = F.lit(b"RIFF" * 40)
    chat = json.loads(one(spark, T.chat_payload(F.lit("m"), F.lit('a "b"'), sound, temperature=0.0, thinking=False)))
    assert chat["messages"][0]["content"][0] == {"type": "text", "text": 'a "b"'} and "\n" not in chat["messages"][0]["content"][1]["input_audio"]["data"]
    assert chat["temperature"] == 0.0 and chat["chat_template_kwargs"] == {"enable_thinking": False} and (chat["top_k"], chat["max_tokens"]) == (64, 4096)
    assert "chat_template_kwargs" not in json.loads(one(spark, T.chat_payload(F.lit("m"), F.lit("a"), sound)))
    gemini = json.loads(one(spark, T.gemini_payload(F.lit("a"), sound)))
    assert gemini["contents"][0]["parts"][1]["inline_data"]["mime_type"] == "audio/wav" and gemini["generationConfig"]["topK"] == 64
    assert [m["role"] for m in json.loads(one(spark, T.text_payload(F.lit("s"), F.lit("u"))))["messages"]] == ["system", "user"]


def test_provider_answer(spark):
    raw = F.lit(" language Finnish<asr_text> yksi ")
    answer = lambda p: [one(spark, c) for c in T.provider_answer(F.lit(p), raw, F.lit("Korean"))]
    assert answer("gemini") == ["Korean", "language Finnish<asr_text> yksi"] and answer("local") == ["Finnish", "yksi"]


def test_quality_rules_know_unknown_values(spark):
    rows = [(1, 16000, 1, 5.0, 5.05), (2, None, 1, 5.0, 5.0), (3, 16000, None, None, 5.0)]
    got = {r.job_id: len(r.failures) for r in X.quality_failures(spark.createDataFrame(rows, "job_id int, rate int, channels int, duration_sec double, source_duration_sec double")).collect()}
    assert got == {2: 1, 3: 2}
    rows = [(1, 1, 0, 16000, 1.0), (1, 2, 0, 16000, 1.002), (1, 3, 0, 16000, None)]
    assert [r.chunk_id for r in X.chunk_failures(spark.createDataFrame(rows, "job_id int, chunk_id int, start_sample long, end_sample long, duration_sec double")).orderBy("chunk_id").collect()] == [2, 3]


def test_carry_prior_takes_one_raw_text(spark):
    new = spark.createDataFrame([(1, 1, 0, 10, "vad_extracted"), (1, 2, 10, 20, "vad_extracted")], "job_id int, chunk_id int, start_ms long, end_ms long, status string")
    texts = spark.createDataFrame([(1, 1, "raw", "a"), (1, 1, "fixed", "A"), (1, 2, "fixed", "B")], "job_id int, chunk_id int, kind string, text string")
    prior = spark.createDataFrame([(1, 0, 10, "en", 5), (1, 0, 10, "en", 5)], "job_id int, start_ms long, end_ms long, language string, elapsed_ms long")
    assert [(r.chunk_id, r.status) for r in X.carry_prior(new, texts, prior).orderBy("chunk_id").collect()] == [(1, "transcribed"), (2, "vad_extracted")]


def test_absorption_equals_a_plain_search():
    """The heap takes the same steps as a search of all segments for the shortest that can be absorbed."""

    def plain(rows, least, cap):
        while True:
            options = []
            for i, (s, e) in enumerate(rows):
                sides = [(s - rows[i - 1][1], 0)] if i else []
                sides += [(rows[i + 1][0] - e, 1)] if i + 1 < len(rows) else []
                if e - s < least and sides and (cap is None or min(sides)[0] <= cap):
                    options.append((e - s, i, min(sides)[1]))
            if not options:
                return rows
            _, i, after = min(options)
            lo = i if after else i - 1
            rows = [*rows[:lo], (rows[lo][0], max(rows[lo][1], rows[lo + 1][1])), *rows[lo + 2 :]]

    rng = random.Random(1)
    for _ in range(300):
        at, rows = 0, []
        for _ in range(rng.randint(1, 14)):
            at += rng.randint(0, 6)
            rows.append((at, at + rng.randint(1, 9)))
            at = rows[-1][1] - rng.choice([0, 0, 0, 1])
        cap = rng.choice([None, 0, 2, 4])
        assert S._absorb(list(rows), 6, cap) == plain(rows, 6, cap)


def test_envelope(spark):
    df = spark.createDataFrame([(1, [float(x) for x in (3, 1, 2, 9, 8, 7, 5)]), (2, []), (3, [4.0])], "job_id int, samples array<float>")
    got = sorted((r.job_id, r.row, r.bin, r.lo, r.hi) for r in S.envelope(df, 5, 2).collect())
    assert got == [(1, 0, 0, 1.0, 3.0), (1, 0, 1, 2.0, 9.0), (1, 1, 0, 7.0, 7.0), (1, 1, 1, 5.0, 5.0), (3, 0, 0, 4.0, 4.0)]


def test_context_groups(spark):
    df = chunks(spark, [("transcribed", "x" * n) for n in (50, 10, 40, 60, 5)])
    got = lambda m, k: [r.group_id for r in K.context_groups(df, m, k).orderBy("chunk_id").collect()]
    assert got(1000, 3) == [1] * 5 and got(100, 3) == [1, 1, 2, 2, 3] and got(100, 1) == [1] * 5


# --- translation --------------------------------------------------------------------------------------


@pytest.mark.parametrize("text, out", [
    ("[0 0 4 1]|low tide\n[ 0042 ] |high tide", {41: "low tide", 42: "high tide"}),
    ("[0310]|port[0311]|bow[0312]|stern", {310: "port", 311: "bow", 312: "stern"}),
    ("[0005]|\t upper deck\nlower deck \n[0006]|hold", {5: "upper deck\nlower deck", 6: "hold"}),
    ("x[0001]|a[0001]|b", {1: "b"}),
    ("[001]|x", {}),
    ("[００07]|wide[00\u30000８\u2003]\u00a0|spaced[٠٠٠٩]|other script", {7: "wide", 8: "spaced", 9: "other script"}),
    ("[99999999999999999999]|beyond[0001]|a", {1: "a"}),
])
def test_markers(spark, text, out):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert {r.serial: r.text for r in H.parse_markers(df).collect()} == out


def lines(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts, 1)], "doc_id int, cue_idx int, text string")


def test_marker_round_trip(spark):
    texts = ["a", "b\nc", "d [x] e"]
    back = H.parse_markers(H.render_markers(H.numbered(lines(spark, texts))))
    assert [r.text for r in back.orderBy("serial").collect()] == texts


def test_batches(spark):
    of = lambda texts, n: [r.batch_id for r in H.batches(lines(spark, texts), n).orderBy("serial").collect()]
    assert of(["x" * 10] * 5, 36) == [1, 1, 2, 2, 3] and of(["ab", "y" * 300, "cd"], 50) == [1, 2, 3] and of(["a"], 1000) == [1]


def test_merge(spark):
    done = spark.createDataFrame([(1, 1, "Kiel"), (1, 3, "Segel")], "doc_id int, serial long, text string")
    merged = H.merge_translation(lines(spark, ["keel", "mast", "sail"]), done)
    assert [r.text for r in merged.orderBy("serial").collect()] == ["Kiel", "mast", "Segel"]
    assert tuple(H.merge_report(merged).first()) == (1, 3, 2, [2])


def test_translate_with_a_model(spark):
    out = H.translate(lines(spark, ["oar", "rope", "tar"]), 25, lambda t: t.replace("a", "ä"))
    assert [r.text for r in out.orderBy("serial").collect()] == ["oär", "rope", "tär"]


def test_correction_payload(spark):
    got = json.loads(one(spark, T.correction_payload(F.lit("s"), F.lit("u"), top_k=5)))
    assert {k: v for k, v in got.items() if k != "messages"} == {
        "temperature": 0.25, "top_p": 0.8, "top_k": 5, "presence_penalty": 1.0, "repetition_penalty": 1.0, "max_tokens": 512, "stop": ["</OUTPUT>"], "chat_template_kwargs": {"enable_thinking": False},
    }


@pytest.mark.parametrize("size", [16, 24, 30, 31, 50])
def test_blocks_equal_arrays(spark, size):
    """Windows and bins over tables of blocks equal those of whole arrays, wherever they straddle blocks."""
    rng = random.Random(3)
    jobs = {f"j{n}": [rng.uniform(-1, 1) for _ in range(n)] for n in (1, 7, 15, 16, 17, 24, 48, 97, 150, 301)}
    whole = spark.createDataFrame(list(jobs.items()), "job_id string, samples array<float>")
    blocks = spark.createDataFrame([(j, i // size, x[i : i + size]) for j, x in jobs.items() for i in range(0, len(x), size)], "job_id string, block_idx int, samples array<float>").repartition(4)
    for window, context in ((12, 5), (7, 0), (16, 16), (1, 3)):
        want = sorted(map(tuple, S.framed(whole, window, context).collect()))
        assert sorted(map(tuple, S.framed_blocks(blocks, size, window, context).collect())) == want
    for row, points in ((40, 8), (100, 7), (16, 16), (1000, 3)):
        want = sorted(map(tuple, S.envelope(whole, row, points).collect()))
        assert sorted(map(tuple, S.envelope_blocks(blocks, size, row, points).collect())) == want


def test_scorer_state_lives_across_batches(spark):
    """A scorer that counts gives a job's whole count however small the batches are, and never sees two jobs at once."""
    rows = [(j, i, [float(i)]) for j in ("a", "b", None) for i in range(25)]
    df = spark.createDataFrame(rows, "job_id string, frame_idx int, frame array<float>").repartition(3)

    def count(pdf, seen):
        assert pdf["job_id"].nunique(dropna=False) == 1
        seen = (seen or 0) + 1000 * len(pdf) ** 0  # calls
        first = seen % 1000
        return pd.Series([first + i + 1 for i in range(len(pdf))]), seen + len(pdf)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {(r.job_id, r.frame_idx): r.prob for r in S.score_frames(df, count).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(j, i): i + 1.0 for j in ("a", "b", None) for i in range(25)}
