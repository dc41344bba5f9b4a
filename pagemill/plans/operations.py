"""Queries of what stands around the texts: files and their limits, options, requests, restored jobs, previews.

Where the tables have no such column, one is made of theirs by arithmetic, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions.shared import work_folder
from pagemill.operators import chunk, layout, speech, voices
from pagemill.operators import jobs as J
from pagemill.plans.cleaning import SQL_LINES, documents, lines
from pagemill.plans.jobs import _SQL, latest
from pagemill.plans.registry import query
from pagemill.plans.speech import _SQL_PAUSES
from pagemill.sources import blocks as B
from pagemill.sources import files


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


# -- files ----------------------------------------------------------------------------------------

#: A page as a file: every third begins as a PDF does, some hold the sign a byte later.
_CONTENT = "CASE page_id % 3 WHEN 0 THEN concat('%PDF-1.7 ', html) WHEN 1 THEN concat(' %PDF-', html) ELSE html END"


@query("accepted_files", f"""WITH f AS (SELECT page_id, {_CONTENT} AS content FROM pages), g AS (SELECT page_id, content, strlen(content) AS length FROM f)
SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN length > 3000 THEN 'too large' WHEN content[1:5] <> '%PDF-' THEN 'no PDF' ELSE 'accepted' END AS verdict FROM g""")
def accepted_files(spark, sf_dir):
    content = F.expr(_CONTENT).cast("binary")
    f = _pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("length"))
    good, bad = files.accepted(f, most_bytes=3000)
    return good.select("path", F.lit("accepted").alias("verdict")).unionByName(bad.select("path", F.col("reason").alias("verdict")))


@query("page_limits", f"WITH {SQL_LINES}, n AS (SELECT doc_id, CAST(max(ord) // 12 + 1 AS INTEGER) AS page_count FROM line GROUP BY doc_id) SELECT doc_id, page_count, page_count <= 2 AS fits FROM n")
def page_limits(spark, sf_dir):
    n = B.with_geometry(lines(spark, sf_dir)).groupBy("doc_id").agg(F.max("page_no").alias("page_count"))
    good, bad = files.page_limited(n, most_pages=2)
    return good.withColumn("fits", F.lit(True)).unionByName(bad.withColumn("fits", F.lit(False)))


def _le(n: str, digits: int = 8) -> str:
    """A whole number in little-endian hexadecimal digits."""
    h = f"lpad(hex({n}), {digits}, '0')"
    return "concat(" + ", ".join(f"substr({h}, {i}, 2)" for i in range(digits - 1, 0, -2)) + ")"


#: An event as a WAV file of event_id % 997 samples, with an odd chunk before its sound; every seventh is no WAV file.
_WAV = f"""unhex(concat(CASE WHEN event_id % 7 = 0 THEN '52494646' ELSE '52494658' END, '00000000', '57415645', '666D7420', {_le("16")}, {_le("1", 4)}, {_le("1", 4)}, {_le("8000 + user_id")}, {_le("2 * (8000 + user_id)")},
 {_le("2", 4)}, {_le("16", 4)}, '4C495354', {_le("3")}, 'AABBCC00', '64617461', {_le("2 * (event_id % 997)")}, repeat('0100', int(event_id % 997))))""".replace("'52494646' ELSE '52494658'", "'52494658' ELSE '52494646'")


@query("wav_durations", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN round((event_id % 997) / (8000.0 + user_id), 9) END AS seconds, event_id % 7 <> 0 AND event_id % 997 > 0 AS valid FROM events")
def wav_durations(spark, sf_dir):
    f = _events(spark, sf_dir).select("event_id", F.expr(_WAV).alias("content"))
    f = files.with_duration(f.withColumn("length", F.octet_length("content").cast("long")))
    return f.select("event_id", F.round("seconds", 9).alias("seconds"), "valid")


_URL = "CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN substr(url, 8) WHEN 2 THEN concat('ftp', url) WHEN 3 THEN concat('  ', split_part(url, '?', 1), '///  ') WHEN 4 THEN concat('http://u:p@', substr(url, 9)) WHEN 5 THEN split_part(url, '?', 1) ELSE '' END"


@query("normalized_urls", f"""WITH u AS (SELECT page_id, trim({_URL}) AS t FROM pages), v AS (SELECT page_id, CASE WHEN contains(t, '://') THEN t ELSE 'http://' || t END AS t FROM u)
SELECT page_id, CASE WHEN (starts_with(lower(t), 'http://') OR starts_with(lower(t), 'https://')) AND NOT regexp_matches(split_part(t, '://', 2), '^/|^$|[?#@\\s]') THEN rtrim(t, '/') END AS url FROM v""")
def normalized_urls(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", files.normalized_url(F.expr(_URL)).alias("url"))


_PATH = "CASE page_id % 5 WHEN 0 THEN concat('/data/up/', page_id) WHEN 1 THEN concat('/data/up/../', page_id) WHEN 2 THEN '/data/up' WHEN 3 THEN concat('/data/upper/', page_id) ELSE concat('/data/up/a..b/', page_id) END"


@query("paths_within_root", f"SELECT page_id, starts_with({_PATH}, '/data/up/') AND NOT list_contains(string_split({_PATH}, '/'), '..') AS within FROM pages")
def paths_within_root(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", files.within_root(F.expr(_PATH), F.lit("/data/up/")).alias("within"))


@query("validated_sources", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '/up/' || event_id || '.pdf' WHEN user_id % 3 = 1 THEN '/up/' || event_id || '/source.pdf' ELSE '' END AS source FROM events""")
def validated_sources(spark, sf_dir):
    e = _events(spark, sf_dir)
    a, b = F.concat(F.lit("/up/"), "event_id", F.lit(".pdf")), F.concat(F.lit("/up/"), "event_id", F.lit("/source.pdf"))
    there = e.where("user_id % 3 = 0").select(a.alias("path")).unionByName(e.where("user_id % 3 <= 1").select(b.alias("path"))).unionByName(e.where("user_id % 3 = 2").select(F.concat(F.lit("/other/"), "event_id").alias("path")))
    jobs = e.select("event_id", a.alias("first"), b.alias("second"))
    return files.validated_source(jobs, there, "/up").select("event_id", "source")


# -- restored jobs --------------------------------------------------------------------------------

#: Metadata of an event's folder, of ten kinds, the last six of which can't be used.
_META = """CASE WHEN event_id % 10 = 4 THEN '{broken' ELSE concat('{"job_id": "', CASE event_id % 10 WHEN 5 THEN concat('x', event_id) WHEN 6 THEN concat('../', event_id) ELSE concat('j', event_id) END,
 '", "filename": "', CASE event_id % 10 WHEN 7 THEN 'a/b.pdf' WHEN 8 THEN '' ELSE concat('f', user_id, '.pdf') END, '", "created_at": "', CASE event_id % 10 WHEN 9 THEN 'yesterday' WHEN 1 THEN '2024-01-05T10:00:00.123456789Z' ELSE '2024-01-05T10:00:00Z' END,
 '", "detected_language": "', CASE WHEN user_id % 2 = 0 THEN 'en' ELSE '' END, '", "effective_language": "', CASE WHEN event_id % 10 = 2 THEN 'pt-BR' ELSE '' END, '", "voice": "v"}') END"""
_AUDIO = "CASE WHEN event_id % 11 = 3 THEN 43 ELSE 44 END"


def _restored(spark, sf_dir):
    e = _events(spark, sf_dir)
    folder = F.concat(F.lit("j"), "event_id")
    meta = files.parsed_metadata(e.select(folder.alias("folder"), F.expr(_META).alias("value")))
    return files.restored(meta, e.select(folder.alias("folder"), F.expr(_AUDIO).alias("length")))


@query("restored_jobs", f"""SELECT 'j' || event_id AS job_id, 'f' || user_id || '.pdf' AS filename, CASE event_id % 10 WHEN 1 THEN TIMESTAMP '2024-01-05 10:00:00.123456' ELSE TIMESTAMP '2024-01-05 10:00:00' END AS created_at,
CASE WHEN event_id % 10 = 2 THEN 'pt-BR' WHEN user_id % 2 = 0 THEN 'en' END AS language FROM events WHERE event_id % 10 < 4 AND {_AUDIO} >= 44""")
def restored_jobs(spark, sf_dir):
    return _restored(spark, sf_dir)[0].select("job_id", "filename", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "language")


@query("restore_warnings", f"""SELECT 'j' || event_id AS folder, CASE event_id % 10 WHEN 4 THEN 'invalid metadata' WHEN 5 THEN 'folder and job id differ' WHEN 6 THEN 'invalid job id' WHEN 9 THEN 'invalid time' ELSE 'invalid filename' END AS warning
FROM events WHERE event_id % 10 >= 4 AND {_AUDIO} >= 44""")
def restore_warnings(spark, sf_dir):
    return _restored(spark, sf_dir)[1]


# -- options and voices ---------------------------------------------------------------------------

_RATE = "CASE event_id % 4 WHEN 0 THEN 0.5D WHEN 1 THEN 2.5D WHEN 2 THEN user_id / 100D END"


@query("checked_options", f"""WITH o AS (SELECT event_id, {_RATE.replace('0.5D', 'CAST(0.5 AS DOUBLE)').replace('2.5D', 'CAST(2.5 AS DOUBLE)').replace('user_id / 100D', 'user_id / 100.0::DOUBLE')} AS rate, user_id - 20 AS chars, event_id % 9 - 3 AS pause, user_id % 2 = 0 AS use, CASE WHEN user_id % 4 = 0 THEN ' http://h ' ELSE ' ' END AS url FROM events)
SELECT event_id, CASE WHEN rate IS NULL OR rate NOT BETWEEN 0.5 AND 2.0 THEN 'speech rate out of range' WHEN use AND trim(url) = '' THEN 'the classifier needs a URL' END AS error, CAST(CASE WHEN chars > 0 THEN chars ELSE 900 END AS BIGINT) AS chunk_max_chars, CAST(greatest(pause, 0) AS BIGINT) AS pause_ms FROM o""")
def checked_options(spark, sf_dir):
    o = _events(spark, sf_dir).select("event_id", F.expr(_RATE).alias("speech_rate"), (F.col("user_id") - 20).alias("chunk_max_chars"), (F.col("event_id") % 9 - 3).alias("pause_ms"), (F.col("user_id") % 2 == 0).alias("use_classifier"), F.when(F.col("user_id") % 4 == 0, " http://h ").otherwise(" ").alias("classifier_url"), F.lit("").alias("created_at"))
    return files.checked_options(o).select("event_id", "error", "chunk_max_chars", "pause_ms")


_ENGINE = "CASE event_id % 3 WHEN 0 THEN ' KOKORO ' WHEN 1 THEN 'piper' ELSE '' END"
_VOICE = "CASE event_id % 4 WHEN 0 THEN 'kokoro-en-bella' WHEN 1 THEN 'pt_BR-cadu-medium' WHEN 2 THEN 'auto' ELSE '' END"


@query("engine_settings", f"""WITH s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'kokoro' ELSE 'piper' END AS engine, {_VOICE} AS voice, value / 100 AS rate, user_id * 30 AS option FROM events)
SELECT event_id, engine, round(1 / least(greatest(rate, 0.7), 1.4), 3) AS length_scale, least(greatest(rate, 0.5), 2.0) AS speed, CAST(CASE WHEN engine = 'kokoro' THEN greatest(option, 2000) ELSE option END AS BIGINT) AS most_chars,
       CASE voice WHEN 'kokoro-en-bella' THEN engine = 'kokoro' WHEN 'pt_BR-cadu-medium' THEN engine = 'piper' ELSE true END AS compatible, CASE WHEN event_id % 2 = 0 THEN 'p' ELSE 'a' END AS language FROM s""")
def engine_settings(spark, sf_dir):
    engine, rate = voices.normalized_engine(F.expr(_ENGINE)), F.col("value") / 100
    language = F.when(F.col("event_id") % 2 == 0, "pt-BR").otherwise("en")
    return _events(spark, sf_dir).select("event_id", engine.alias("engine"), X.length_scale(rate).alias("length_scale"), X.speed(rate).alias("speed"), chunk.engine_limit(engine, F.col("user_id") * 30).alias("most_chars"), voices.compatible(F.expr(_VOICE), engine).alias("compatible"), speech.engine_voice(language).alias("language"))


@query("model_urls", "SELECT * FROM (VALUES " + ", ".join(f"('{v[0]}', 'https://host/m/{v[5]}/{v[0]}.onnx', 'https://host/m/{v[5]}/{v[0]}.onnx.json')" for v in voices.VOICES if v[5]) + ") AS v(key, model, config)")
def model_urls(spark, sf_dir):
    v = voices.voices(spark).where("folder is not null")
    slashed = F.concat(F.lit("/"), "folder", F.lit("//"))
    return v.select("key", voices.model_url("https://host/m", slashed, F.col("key")).alias("model"), voices.model_url("https://host/m", slashed, F.col("key"), ".onnx.json").alias("config"))


# -- requests and audio ---------------------------------------------------------------------------

_REQUEST = """CASE event_id % 5 WHEN 0 THEN '{broken' WHEN 1 THEN '{"output_path": "o", "chunks": [" ", ""]}' ELSE concat('{"output_path": "o', event_id, '", "chunks": [" a', user_id, ' ", "  ", null, "b"], "speech_rate": ', value / 100, ', "speed": ', value / 100, '}') END"""


@query("engine_requests", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'no request' WHEN 1 THEN 'no chunks' END AS error, CASE WHEN event_id % 5 > 1 THEN 'a' || user_id || '|b' ELSE '' END AS chunks,
 CASE WHEN event_id % 5 > 1 THEN round(1 / least(greatest(value / 100, 0.7), 1.4), 3) ELSE 1.0 END AS scale, CASE WHEN event_id % 5 > 1 THEN least(greatest(value / 100, 0.5), 2.0) ELSE 1.0 END AS speed FROM events WHERE value IS NOT NULL""")
def engine_requests(spark, sf_dir):
    asked = _events(spark, sf_dir).where("value is not null").select("event_id", F.expr(_REQUEST).alias("value"))
    own = speech.requests(asked).select("event_id", "value", "error", F.array_join("chunks", "|").alias("chunks"), F.col("rate").alias("scale"))
    return speech.requests(own.withColumnRenamed("error", "e").withColumnRenamed("chunks", "c"), "kokoro").select("event_id", F.col("e").alias("error"), F.col("c").alias("chunks"), "scale", F.col("rate").alias("speed"))


@query("spoken_audio", f"""WITH {chunk.sql_chunks("documents")}, paused AS ({_SQL_PAUSES})
SELECT doc_id, round(sum(length(chunk) + silent_frames) / 22050.0, 6) AS seconds, CAST(count(*) AS INTEGER) AS chunks, CAST(sum(length(chunk) + silent_frames) * 2 + 44 AS BIGINT) AS bytes FROM paused GROUP BY doc_id""")
def spoken_audio(spark, sf_dir):
    chunks = chunk.with_pauses(chunk.split_text(documents(spark, sf_dir)))
    # an engine that says one silent sample for each character
    audio = speech.synthesized(chunks, lambda t: speech.pcm16([0.0] * len(t)))
    return audio.select("doc_id", F.round("seconds", 6).alias("seconds"), "chunks", F.octet_length("wav").cast("long").alias("bytes"))


# -- texts and tables -----------------------------------------------------------------------------


@query("text_previews", f"""SELECT doc_id, CASE WHEN strlen(text) > 200 THEN list_last(list_filter(list_transform(range(40, 201), lambda i: left(text, i)), lambda t: strlen(t) <= 200)) || {"'" + X.PREVIEW_MARK + "'"} ELSE text END AS preview,
 CASE WHEN strlen(text) > 150 THEN list_last(list_filter(list_transform(range(30, 151), lambda i: right(text, i)), lambda t: strlen(t) <= 150)) ELSE text END AS tail FROM documents""")
def text_previews(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.preview(F.col("text"), 200).alias("preview"), X.tail(F.col("text"), 150).alias("tail"))


@query("safe_ratios", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE round(event_id / CAST(user_id % 3 AS DOUBLE), 9) END AS ratio FROM events")
def safe_ratios(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.round(X.safe_ratio(F.col("event_id").cast("double"), (F.col("user_id") % 3).cast("double")), 9).alias("ratio"))


_LABELS = "CASE WHEN ord % 9 = 4 THEN 'caption' ELSE 'paragraph' END"


@query("layout_regions", f"""WITH {B.SQL_GEOMETRY} SELECT doc_id, page_no, 'caption' AS kind, l AS "left", t AS top, r AS "right", b AS bottom FROM placed WHERE ord % 9 = 4
UNION ALL SELECT DISTINCT doc_id, page_no, 'picture', 180.0, 300.0, 400.0, 400.0 FROM placed WHERE (doc_id + page_no) % 3 = 0""")
def layout_regions(spark, sf_dir):
    b = B.with_geometry(lines(spark, sf_dir)).withColumn("label", F.expr(_LABELS))
    return layout.all_regions(B.picture_regions(b), b).select("doc_id", "page_no", "kind", "bbox.left", "bbox.top", "bbox.right", "bbox.bottom")


@query("caption_regions", f"""WITH {B.SQL_GEOMETRY} SELECT doc_id, page_no, l AS "left", t AS top FROM placed WHERE ord % 9 = 4""")
def caption_regions(spark, sf_dir):
    b = B.with_geometry(lines(spark, sf_dir)).withColumn("label", F.expr(_LABELS))
    return layout.caption_regions(b).select("doc_id", "page_no", "bbox.left", "bbox.top")


@query("public_metadata", """SELECT CAST(event_id AS VARCHAR) AS job_id, event_type AS stage, '{"job_id":"' || event_id || '","stage":"' || event_type || '","monkey":' || user_id || ',"options":{"voice":"v' || user_id || '"}}' AS json FROM events""")
def public_metadata(spark, sf_dir):
    options = F.struct(F.concat(F.lit("v"), "user_id").alias("voice"), F.lit("secret").alias(files.SECRET))
    rows = _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("job_id"), F.col("event_type").alias("stage"), F.col("user_id").alias("monkey"), options.alias("options"), F.lit("secret").alias(files.SECRET))
    return files.public_metadata(rows)


#: Documents as cleaned texts, of which every fourth is blank.
_CLEANED = "CASE WHEN doc_id % 4 = 1 THEN concat(' ', chr(10)) ELSE concat('  ', text, chr(10), ' ') END"


@query("written_texts", f"SELECT doc_id, {X.sql_trimmed('text')} || chr(10) AS text FROM documents WHERE doc_id % 4 <> 1 AND {X.sql_trimmed('text')} <> ''")
def written_texts(spark, sf_dir):
    path = work_folder(spark, "texts")
    files.write_texts(documents(spark, sf_dir).select("doc_id", F.expr(_CLEANED).alias("text")), path)
    return files.read_texts(spark, path)


@query("rejected_texts", f"SELECT doc_id, 'no narrative text remained after cleanup' AS reason FROM documents WHERE doc_id % 4 = 1 OR {X.sql_trimmed('text')} = ''")
def rejected_texts(spark, sf_dir):
    return files.write_texts(documents(spark, sf_dir).select("doc_id", F.expr(_CLEANED).alias("text")), work_folder(spark, "texts"))


@query("latest_metadata", """SELECT CAST(event_id AS VARCHAR) AS job_id, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'saved' END AS stage, '{"job_id":"' || event_id || '","stage":"' || CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'saved' END || '","user":' || user_id || '}' AS json FROM events""")
def latest_metadata(spark, sf_dir):
    path = work_folder(spark, "metadata")
    rows = _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("job_id"), F.lit("saved").alias("stage"), F.col("user_id").alias("user"), F.lit("secret").alias(files.SECRET))
    files.write_metadata(rows, path)
    files.write_metadata(rows.where("cast(job_id as bigint) % 3 = 0").withColumn("stage", F.lit("done")), path)
    return files.latest_metadata(spark, path)


# -- the queue ------------------------------------------------------------------------------------

#: More than the jobs of any table, so that the queue has room for some.
_MOST_ACTIVE = "SELECT count(*) FILTER (status IN ('pending', 'running')) AS n FROM job"


@query("queue_admitted", f"{_SQL}, active AS ({_MOST_ACTIVE}) SELECT event_id AS job_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k FROM events), active WHERE k <= greatest(0, 2000 - n)")
def queue_admitted(spark, sf_dir):
    new = _events(spark, sf_dir).select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"))
    return J.admitted(latest(spark, sf_dir), new, most_active=2000).select("job_id")


@query("newest_job", f"{_SQL} SELECT job_id, created_at FROM job ORDER BY created_at DESC, job_id DESC LIMIT 1")
def newest_job(spark, sf_dir):
    return J.newest(latest(spark, sf_dir)).select("job_id", "created_at")


@query("status_texts", f"{_SQL} SELECT job_id, CASE status WHEN 'completed' THEN 'Completed' WHEN 'failed' THEN 'Failed' WHEN 'running' THEN 'Running · ' || CAST(round_even(progress * 100, 0) AS INTEGER) || '%' ELSE 'Queued' END AS text FROM job")
def status_texts(spark, sf_dir):
    return latest(spark, sf_dir).select("job_id", J.status_text(F.col("status"), F.col("progress")).alias("text"))


@query("new_job_ids", "SELECT event_id, true AS fits FROM events")
def new_job_ids(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", J.new_job_id().rlike(r"\A[0-9a-f]{32}\z").alias("fits"))
