import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from cuelake.schemas import MANIFEST
from cuelake.sources import catalog, manifests, texts, versions


def test_catalog(spark, tmp_path):
    for name in ("a.MP3", "b/c.wav", "d.txt", "noext"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = catalog.media_catalog(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.supported) for r in rows) == [("a.MP3", True), ("c.wav", True), ("d.txt", False), ("noext", False)]
    assert len({r.job_id for r in rows}) == 4 and len(rows[0].job_id) == 40


def test_manifest_round_trip(spark, tmp_path):
    doc = {"job_id": "j", "source_file": "x.wav", "vad_params": {"threshold": 0.5, "max_absorb_gap": None}, "chunks": [{"id": 1, "status": "transcribed", "start_sec": 0.5}, {"id": 2, "status": "failed", "flags": ["f"]}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "manifest.json").write_text(json.dumps(doc, indent=1))
    read = manifests.read_manifests(spark, str(tmp_path / "in"))
    rows = manifests.chunk_rows(read)
    assert [(r.chunk_id, r.status, r.flags) for r in rows.orderBy("chunk_id").collect()] == [(1, "transcribed", None), (2, "failed", ["f"])]
    jobs = read.drop("chunks")
    built = manifests.build_manifests(jobs, rows, jobs.select("job_id", F.lit("orig/y.m4a").alias("source_file"), "source_mtime", "source_size"))
    manifests.write_manifests(built, str(tmp_path / "out"))
    again = manifests.read_manifests(spark, str(tmp_path / "out")).first()
    assert again.source_file == "orig/y.m4a" and again.output_srt == "orig/y.srt" and [c.id for c in again.chunks] == [1, 2]


def test_written_manifests_are_read_whole(spark, tmp_path):
    """Five jobs in one file of five lines, and one document of its own beside them."""
    jobs = spark.createDataFrame([(f"j{i}", "x.wav", "-", 1) for i in range(5)], "job_id string, source_file string, source_mtime string, source_size long").coalesce(1)
    rows = spark.createDataFrame([(f"j{i}", c, "transcribed") for i in range(5) for c in (1, 2)], "job_id string, chunk_id int, status string").coalesce(1)
    out = str(tmp_path / "out")
    manifests.write_manifests(manifests.build_manifests(jobs, rows, jobs.limit(0)).coalesce(1), out)
    (tmp_path / "out" / "parked.json").write_text(json.dumps({"job_id": "j9", "chunks": []}, indent=2))
    read = manifests.read_manifests(spark, out)
    assert sorted(r.job_id for r in read.collect()) == ["j0", "j1", "j2", "j3", "j4", "j9"] and manifests.chunk_rows(read).count() == 10


def test_any_file_name_and_form(spark, tmp_path):
    """The content tells the form; what is no manifest is told, and nothing becomes a row of nulls."""
    doc = lambda j, **more: {"job_id": j, "chunks": [{"id": 1, "status": "transcribed"}], **more}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    put = lambda name, text: (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    for i, name in enumerate(["p.json", "pa.json", "part.json", "part-1.json", "deep/manifest.json"]):
        put(name, json.dumps(doc(f"m{i}"), indent=2))
    put("lines.json", "\n".join(json.dumps(doc(f"l{i}")) for i in range(3)) + "\n\n")
    put("part-2.json", "\ufeff" + json.dumps(doc("bom")))
    put("mixed.json", json.dumps(doc("good")) + "\nnot json\n" + json.dumps({"other": 1}) + "\n[1, 2]\n")
    put("torn.json", '{"job_id": "torn", "chunks": [')
    put("wrong.json", json.dumps({"job_id": "wrong", "chunks": "none"}))
    put("notes.txt", "not a manifest")
    folder = str(tmp_path / "in")
    want = ["bom", "good", "l0", "l1", "l2", "m0", "m1", "m2", "m3", "m4"]
    read = manifests.read_manifests(spark, folder)
    assert sorted(r.job_id for r in read.collect()) == want and read.schema == MANIFEST
    assert manifests.chunk_rows(read).where("chunk_id = 1 and status = 'transcribed'").count() == len(want)
    broken = sorted((r.path.rsplit("/", 1)[1], r.line) for r in manifests.broken_manifests(spark, folder).collect())
    assert broken == [("mixed.json", 2), ("mixed.json", 3), ("mixed.json", 4), ("torn.json", 1), ("wrong.json", 1)]
    assert [r.job_id for r in manifests.read_manifests(spark, f"{folder}/part-1.json").collect()] == ["m3"]
    put("notes", json.dumps(doc("alone"), indent=1))
    assert [r.job_id for r in manifests.read_manifests(spark, f"{folder}/notes").collect()] == ["alone"]


def test_chunk_texts(spark, tmp_path):
    folder = tmp_path / "job1" / "chunks"
    folder.mkdir(parents=True)
    (folder / "chunk_0001.txt").write_text(" a\n b ")
    (folder / "chunk_0001.fixed.txt").write_text("A B")
    read = texts.read_chunk_texts(spark, str(tmp_path))
    assert sorted((r.job_id, r.chunk_id, r.kind) for r in read.collect()) == [("job1", 1, "fixed"), ("job1", 1, "raw")]
    chunks = spark.createDataFrame([("job1", 1), ("job1", 2)], "job_id string, chunk_id int")
    assert [r.text for r in texts.with_text(chunks, read).orderBy("chunk_id").collect()] == ["a b", ""]
    out = str(tmp_path / "table")
    assert texts.write_chunk_texts(read, out) == 1
    assert texts.write_chunk_texts(read.where("kind = 'fixed'").withColumn("text", F.lit("new")), out) == 2
    texts.write_chunk_texts(read.where("kind = 'fixed'").withColumns({"job_id": F.lit("job2"), "text": F.lit("other")}), out)
    for text in ("some", "more"):  # a run that is repeated
        texts.write_chunk_texts(read.where("kind = 'raw'").withColumns({"job_id": F.lit("job2"), "text": F.lit(text)}), out, "run 7")
    want = [("job1", "fixed", "new"), ("job1", "raw", " a\n b "), ("job2", "fixed", "other"), ("job2", "raw", "more")]
    assert sorted((r.job_id, r.kind, r.text) for r in texts.latest_chunk_texts(spark, out).collect()) == want


def test_versioned_stages(spark, tmp_path):
    out = str(tmp_path / "stages")
    rows = lambda text: spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [texts.write_stage(rows(t), out, "raw") for t in ("old", "new")] == [1, 2]
    assert texts.write_stage(rows("ko"), out, "translated") == 3
    assert [tuple(r) for r in texts.latest_stage(spark, out, "raw").collect()] == [(1, "new", 2)]
    assert [tuple(r) for r in texts.latest_stage(spark, out, "translated").collect()] == [(1, "ko", 3)]


def test_runs_at_once_lose_nothing(spark, tmp_path):
    """Runs that start together get versions of their own, and all their rows are read."""
    out = str(tmp_path / "table")
    run = lambda j: texts.write_chunk_texts(spark.createDataFrame([(f"j{j}", 1, "raw", f"t{j}"), ("all", 1, "raw", f"t{j}")], "job_id string, chunk_id int, kind string, text string"), out)
    with ThreadPoolExecutor(6) as pool:
        given = list(pool.map(run, range(6)))
    assert sorted(given) == [1, 2, 3, 4, 5, 6]
    got = {r.job_id: r.text for r in texts.latest_chunk_texts(spark, out).collect()}
    assert got == {**{f"j{j}": f"t{j}" for j in range(6)}, "all": f"t{given.index(6)}"}


def test_a_run_that_died_is_not_seen(spark, tmp_path):
    out = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        texts.latest_chunk_texts(spark, out)
    texts.write_chunk_texts(spark.createDataFrame([("j", 1, "raw", "good")], "job_id string, chunk_id int, kind string, text string"), out)
    spark.createDataFrame([("j", 1, "raw", "half")], "job_id string, chunk_id int, kind string, text string").write.partitionBy("kind").parquet(f"{out}/data/run=dead")
    assert [r.text for r in texts.latest_chunk_texts(spark, out).collect()] == ["good"]
    assert not versions._put_if_absent(spark, f"{out}/log/000000000001.json", "{}") and len(versions.versions(spark, out)) == 1
    assert versions.drop_uncommitted(spark, out) == 1 and not (tmp_path / "table" / "data" / "run=dead").exists()


def test_report_and_language_upsert(spark, tmp_path):
    out = str(tmp_path / "lang")
    texts.write_by_language(spark.createDataFrame([("a", "ko"), ("b", "ja")], "file string, lang string"), out)
    texts.write_by_language(spark.createDataFrame([("c", "ko")], "file string, lang string"), out)
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("file", "lang").collect()) == [("b", "ja"), ("c", "ko")]
    texts.write_report(spark.createDataFrame([(0.5,)], "cer double"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().cer == 0.5
