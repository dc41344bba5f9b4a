import json
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.operators import classifier, jobs, voices
from pagemill.sources import files
from pagemill.sources.blocks import BLOCKS
from pagemill.streaming import jobs as stream

JOBS = "job_id string, created_at timestamp_ntz, status string"
NOW = datetime(2024, 5, 1, 12)


def test_expired_and_orphans(spark):
    j = spark.createDataFrame([("a", NOW - timedelta(hours=2), "completed"), ("b", NOW, "completed"), ("c", NOW - timedelta(hours=2), "running"), ("d", NOW - timedelta(hours=1), "failed")], JOBS)
    assert [r["job_id"] for r in jobs.expired(j, NOW, 1).collect()] == ["a"]
    assert jobs.expired(j, NOW, 0).count() == 0
    f = spark.createDataFrame([("o", "x", NOW - timedelta(hours=3)), ("o", "y", NOW - timedelta(minutes=65)), ("o", "a", NOW - timedelta(hours=3))], "root string, name string, mtime timestamp_ntz")
    assert [r["name"] for r in jobs.orphans(f, j, NOW, 1).collect()] == ["x"]


def test_insert_delete_admit(spark):
    j = spark.createDataFrame([("a", NOW, "completed"), ("b", NOW, "running")], JOBS)
    new = spark.createDataFrame([("a", NOW, "pending"), ("n", NOW, "pending")], JOBS)
    assert sorted((r["job_id"], r["status"]) for r in jobs.inserted_if_absent(j, new).collect()) == [("a", "completed"), ("b", "running"), ("n", "pending")]
    assert [r["job_id"] for r in jobs.deleted(j, j).collect()] == ["b"]
    assert jobs.admitted(j, new, 2).count() == 1


def test_state_machine():
    t = [datetime(2024, 1, 1, 0, i) for i in range(5)]
    s = stream.advance(None, [(t[0], "pending", "queued", None), (t[2], "completed", "done", 1.0), (t[1], "running", "clean", 2.0)])
    assert s == ("completed", "done", 1.0, t[0], t[2], 3)
    assert stream.advance(s, [(t[3], "running", "again", 0.1)]) == s
    assert stream.advance(("running", "x", 0.5, t[0], t[1], 2), [(t[3], "failed", "broke", 0.0)])[2] == 0.05


def test_progress_lines(spark):
    rows = [('PROGRESS {"progress": 1.5, "step": "a"}',), ("PROGRESS {broken",), ("other",), ('PROGRESS {"step": "b"}',)]
    assert [(r["progress"], r["step"]) for r in stream.progress_events(spark.createDataFrame(rows, "value string")).collect()] == [(1.0, "a")]


def test_job_stream(spark, tmp_path):
    schema = "job_id long, updated_at timestamp, status string, step string, progress double"
    rows = [(1, datetime(2024, 1, 1), "pending", "q", 0.0), (1, datetime(2024, 1, 1, 0, 1), "running", "clean", 0.4), (2, datetime(2024, 1, 1), "pending", "q", 0.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream.job_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["job_id"], r["status"], r["version"]) for r in spark.table("job_states").collect()}
    assert got == {(1, "running", 2), (2, "pending", 1)}


def test_voices(spark):
    rows = [("auto", "pt-BR", "kokoro"), ("kokoro-en-bella", "en", "Kokoro"), ("kokoro-en-bella", "en", "piper"), (None, "pt-pt", None), ("", "de", "piper")]
    got = [r["v"] for r in spark.createDataFrame(rows, "r string, l string, e string").select(voices.resolved(F.col("r"), F.col("l"), F.col("e")).alias("v")).collect()]
    assert got == ["kokoro-pt-dora", "kokoro-en-bella", "en_US-lessac-medium", "pt_BR-faber-medium", "en_US-lessac-medium"]
    ok = spark.createDataFrame([("auto", "piper"), ("kokoro-en-bella", "piper"), ("unknown", "piper")], "v string, e string").select(voices.compatible(F.col("v"), F.col("e")).alias("c")).collect()
    assert [r["c"] for r in ok] == [True, False, True]
    assert voices.voices(spark).count() == 8


def blocks(spark, n, chars=10, pages=None):
    return spark.createDataFrame([(1, i, "x" * chars, "section_header" if i == 0 else "paragraph", pages[i] if pages else 1, None) for i in range(n)], BLOCKS)


def test_batches(spark):
    of = lambda b: [r["batch"] for r in classifier.batches(b).orderBy("ord").collect()]
    assert of(blocks(spark, 21)) == [0] * 20 + [1]
    assert of(blocks(spark, 3, chars=3500)) == [0, 1, 2]
    assert of(blocks(spark, 3, pages=[1, 1, 2])) == [0, 0, 1]


def reviewed(spark, b, content):
    batched = classifier.batches(b)
    judged = classifier.verdicts(classifier.replies(classifier.prompts(batched), lambda prompt: content))
    return [r["ord"] for r in classifier.applied(batched, judged).orderBy("new_ord").collect()], [r["error"] for r in judged.collect()]


def test_review(spark):
    b = blocks(spark, 4).withColumn("text", F.when(F.col("ord") == 0, "Methods").otherwise(F.col("text")))
    reply = json.dumps({"order": [2, 2, 9, 1], "results": [{"id": 0, "action": "DROP"}, {"id": 1, "action": " drop "}, {"id": 3, "action": "REWRITE_MINIMAL"}]})
    assert reviewed(spark, b, f"```json\n{reply}\n```") == ([2, 0, 3], [None])
    kept, errors = reviewed(spark, b, "not json")
    assert kept == [0, 1, 2, 3] and errors == ["parse JSON verdicts"]


def test_failing_client_keeps_all(spark):
    def client(prompt):
        raise TimeoutError("slow")

    batched = classifier.batches(blocks(spark, 2))
    judged = classifier.verdicts(classifier.replies(classifier.prompts(batched), client))
    assert classifier.applied(batched, judged).count() == 2 and "TimeoutError" in judged.first()["error"]


def wav(rate, n, extra=b""):
    fmt = struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)
    body = b"WAVEfmt " + struct.pack("<I", 16) + fmt + extra + b"data" + struct.pack("<I", n) + b"\0" * n
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav():
    assert files.wav_seconds(wav(8000, 16000)) == 1.0
    assert files.wav_seconds(wav(8000, 8000, b"LIST" + struct.pack("<I", 3) + b"abc\0")) == 0.5
    assert files.wav_seconds(b"RIFF") is None and files.wav_seconds(None) is None


def test_files_and_restore(spark, tmp_path):
    for name, meta in {"j1": {"job_id": "j1", "filename": "a.pdf", "created_at": "2024-01-01T00:00:00.123456789Z", "detected_language": "en"}, "j2": {"job_id": "other", "filename": "a.pdf", "created_at": "2024-01-01T00:00:00Z"}, "j3": {"job_id": "j3", "filename": "../a.pdf", "created_at": "2024-01-01T00:00:00Z"}, "j4": {"job_id": "j4", "filename": "a.pdf", "created_at": "x"}}.items():
        (tmp_path / "out" / name).mkdir(parents=True)
        (tmp_path / "out" / name / "metadata.json").write_text(json.dumps(meta, indent=2))
    audio = spark.createDataFrame([(f"j{i}", 100) for i in range(1, 5)] + [("j9", 3)], "folder string, length long")
    good, bad = files.restored(files.read_metadata(spark, str(tmp_path / "out")), audio)
    assert [(r["job_id"], r["language"], r["status"]) for r in good.collect()] == [("j1", "en", "completed")]
    assert {r["folder"]: r["warning"] for r in bad.collect()} == {"j2": "folder and job id differ", "j3": "invalid filename", "j4": "invalid time"}
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "pdf" / "b.pdf").write_bytes(b"nothing")
    ok, rejected = files.accepted(files.read_files(spark, str(tmp_path / "pdf")))
    assert ok.count() == 1 and [r["reason"] for r in rejected.collect()] == ["no PDF"]

    def pages(content):
        yield lambda: [{"n": len(content)}, {"n": 0}]
        yield lambda: 1 / 0
        yield lambda: [{"n": 3}]
        if content[-1:] == b"x":
            raise ValueError("broken")

    rows = [(r["page_no"], r["n"], r["error"] and r["error"].split(":")[0]) for r in files.extracted(ok, pages, "n int").collect()]
    assert rows == [(1, 10, None), (1, 0, None), (2, None, "ZeroDivisionError"), (3, 3, None), (0, None, "ValueError")]


@pytest.mark.parametrize(("url", "want"), [("host:80/v1/", "http://host:80/v1"), ("https://h", "https://h"), ("ftp://h", None), ("http://u:p@h", None), ("http://h?q", None)])
def test_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(files.normalized_url(F.col("u")).alias("x")).first()["x"] == want


def test_paths_and_secrets(spark, tmp_path):
    rows = spark.createDataFrame([("/a/b",), ("/ab",), ("/a/../b",)], "p string")
    assert [r["x"] for r in rows.select(files.within_root(F.col("p"), F.lit("/a/")).alias("x")).collect()] == [True, False, False]
    o = files.ProcessingOptions(use_classifier=True, classifier_url="http://h", classifier_key="secret", chunk_max_chars=0)
    assert "secret" not in json.dumps(o.public()) and "secret" not in repr(o) and o.chunk_max_chars == 900
    with pytest.raises(ValueError):
        files.ProcessingOptions(speech_rate=9.0)
    with pytest.raises(ValueError):
        files.ProcessingOptions(use_classifier=True, classifier_url=" ")
    assert files.ProcessingOptions(pause_ms=-5).pause_ms == 0 and files.ProcessingOptions(pause_ms=0).pause_ms == 0
    meta = spark.createDataFrame([("a", "saved", "secret", 7, ("v", "secret"))], "job_id string, stage string, classifier_key string, monkey int, options struct<voice:string,classifier_key:string>")
    files.write_metadata(meta, str(tmp_path / "m"))
    files.write_metadata(meta.withColumn("stage", F.lit("done")).withColumn("monkey", F.lit(8)), str(tmp_path / "m"))
    rows = files.latest_metadata(spark, str(tmp_path / "m")).collect()
    assert [(r["job_id"], r["stage"], json.loads(r["json"])) for r in rows] == [("a", "done", {"job_id": "a", "stage": "done", "monkey": 8, "options": {"voice": "v"}})]
    assert spark.read.parquet(str(tmp_path / "m")).where("json like '%secret%'").count() == 0
    none = files.write_texts(spark.createDataFrame([(1, " x "), (2, " \n")], "doc_id long, text string"), str(tmp_path / "t"))
    assert [r["doc_id"] for r in none.collect()] == [2]
    assert [r["text"] for r in files.read_texts(spark, str(tmp_path / "t")).collect()] == ["x\n"]


def test_folders(spark, tmp_path):
    for name in ("up/j1", "up/j2", "out/j1"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "a.txt").write_text(name)
    (tmp_path / "up" / "file").write_text("x")
    up, out = str(tmp_path / "up"), str(tmp_path / "out")
    assert sorted(r["name"] for r in files.listed_folders(spark, up).collect()) == ["j1", "j2"]
    assert files.listed_folders(spark, str(tmp_path / "none")).count() == 0
    left = jobs.orphans(files.listed_folders(spark, up), spark.createDataFrame([("j2",)], "job_id string"), datetime(2100, 1, 1), 1)
    assert [r["name"] for r in left.collect()] == ["j1"]
    files.export_file(spark, f"{up}/j1/a.txt", f"{tmp_path}/copy.txt")
    assert (tmp_path / "copy.txt").read_text() == "up/j1"
    with pytest.raises(ValueError):
        files.delete_folders(spark, [up], ["j1", "../out"])
    assert files.delete_folders(spark, [up, out], ["j1", "gone"]) == [f"{up}/j1", f"{out}/j1"]
    assert sorted(p.name for p in (tmp_path / "up").iterdir()) == ["file", "j2"] and not list((tmp_path / "out").iterdir())


def test_settings(tmp_path):
    from pagemill.sources import settings

    s = settings.load({"PAGEMILL_MAX_WORKERS": "0", "PAGEMILL_MAX_PAGES": "x", "PAGEMILL_REVIEW_ENABLED": "Yes", "PAGEMILL_DATA_DIR": str(tmp_path), "PAGEMILL_JOB_RETENTION_HOURS": "-3"})
    assert (s.max_workers, s.max_pages, s.review_enabled, s.data_dir, s.job_retention_hours) == (1, 200, True, str(tmp_path), 0)
    for bad in ({"PAGEMILL_MAX_PAGES": "0"}, {"PAGEMILL_SPEECH_RATE_MIN": "3"}):
        with pytest.raises(ValueError):
            settings.load(bad)


def test_speech(spark):
    from pagemill.operators import speech

    texts = spark.createDataFrame([(1, "One sentence here. Another one, after it."), (2, "  ")], "doc_id long, text string")
    chunks = speech.prepared(texts, limit=20, rate=1000)
    got = speech.synthesized(chunks, lambda t: b"\1\0" * len(t), rate=1000).collect()
    own = sorted(chunks.collect(), key=lambda r: r["chunk_no"])
    assert [r["doc_id"] for r in got] == [1] and got[0]["chunks"] == len(own)
    assert got[0]["seconds"] == pytest.approx(sum(len(r["chunk"]) + r["silent_frames"] for r in own) / 1000)
    assert files.wav_seconds(bytes(got[0]["wav"])) == pytest.approx(got[0]["seconds"])
    assert speech.pcm16([2.0, -2.0, 0.0]) == struct.pack("<hhh", 32767, -32767, 0)


def test_http_client():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = body["messages"][1]["content"]
            code = 302 if prompt == "move" else 500 if prompt == "fail" else 200
            self.send_response(code)
            if code == 302:
                self.send_header("Location", "/elsewhere")
            self.end_headers()
            reply = {"choices": [] if prompt == "none" else [{"message": {"content": prompt + self.headers.get("Authorization", "")}}]}
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        call = classifier.http_client(f"http://127.0.0.1:{server.server_port}/", key="k")
        assert call("hi") == "hiBearer k"
        for bad in ("fail", "none", "move"):
            with pytest.raises(RuntimeError):
                call(bad)
    finally:
        server.shutdown()


def test_preview(spark):
    from pagemill.functions import text as X

    got = [r["x"] for r in spark.createDataFrame([("aéé",), ("abcd",), (None,)], "t string").select(X.preview(F.col("t"), 4, "…").alias("x")).collect()]
    assert got == ["aé…", "abcd", None]


def test_tail(spark):
    from pagemill.functions import text as X

    got = [r["x"] for r in spark.createDataFrame([("ééa",), ("abcd",), (None,)], "t string").select(X.tail(F.col("t"), 4).alias("x")).collect()]
    assert got == ["éa", "abcd", None]


def test_job_stream_in_batches(spark, tmp_path):
    """Two batches give what one gives, and a batch that runs again replaces its own."""
    schema = "job_id long, updated_at timestamp, status string, step string, progress double"
    for k, rows in enumerate([[(1, datetime(2024, 1, 1), "pending", "q", 0.0), (2, datetime(2024, 1, 1), "running", "x", 0.1)], [(1, datetime(2024, 1, 1, 0, 1), "running", "clean", 0.4), (2, datetime(2024, 1, 1, 0, 2), "failed", "y", 0.0), (2, datetime(2024, 1, 1, 0, 3), "running", "z", 0.9)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            states = stream.job_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            stream.run_to_table(states, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got = sorted((r["job_id"], r["status"], r["progress"], r["version"]) for r in stream.latest_states(spark, str(tmp_path / "out")).collect())
        assert got == [[(1, "pending", 0.0, 1), (2, "running", 0.1, 1)], [(1, "running", 0.4, 2), (2, "failed", 0.05, 2)]][k]
    seen = stream.latest_states(spark, str(tmp_path / "out"))
    assert stream.changed_since(seen, 2).count() == 0 and stream.changed_since(seen, 1).count() == 2
