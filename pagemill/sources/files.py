"""File sources: signatures, limits, WAV headers, persisted metadata; and the text and JSON sinks."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import text as X
from pagemill.functions.shipping import ship

# Limits of what is taken in.
MOST_BYTES = 52_428_800
MOST_PAGES = 200
WAV_LEAST_BYTES = 44
PDF_MAGIC = "255044462D"
SAFE_ID = r"\A[A-Za-z0-9][A-Za-z0-9_-]*\z"

METADATA = "job_id string, filename string, created_at string, source_pdf string, detected_language string, effective_language string, voice string, engine string, options string, stats string"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length and content of files; filters on the length reach the scan."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.hex(F.substring(content, 1, 5)) == PDF_MAGIC, F.lit(False))


def accepted(files: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files within the limit that have the signature, and the others with a reason."""
    small = files.where(F.col("length") <= most_bytes)
    large = files.where(F.col("length") > most_bytes).select("path", "length", F.lit("too large").alias("reason"))
    return small.where(is_pdf(F.col("content"))), large.unionByName(small.where(~is_pdf(F.col("content"))).select("path", "length", F.lit("no PDF").alias("reason")))


def extracted(files: DataFrame, extractor: Callable[[bytes], Iterable[Callable[[], list[dict]]]], schema: str) -> DataFrame:
    """Rows that a pluggable extractor makes of each file's pages: path, page_no, error, and the columns of ``schema``.

    The extractor gives a function for each page, in order, and that function its rows. A page that can't be read
    gives one row with its error and nothing else, as does a file, with page 0; the other pages are not lost.
    """
    whole = T.StructType.fromDDL(f"path string, page_no int, error string, {schema}")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(whole)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, at = [], 0
                try:
                    for at, page in enumerate(extractor(content), 1):  # noqa: B007
                        try:
                            rows += [{"path": path, "page_no": at, **r} for r in page()]
                        except Exception as x:  # noqa: BLE001 - a malformed page is an empty one
                            rows.append({"path": path, "page_no": at, "error": f"{type(x).__name__}: {x}"})
                except Exception as x:  # noqa: BLE001 - a malformed file is an empty one
                    rows.append({"path": path, "page_no": 0, "error": f"{type(x).__name__}: {x}"})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(run, whole)


def page_limited(pages: DataFrame, most_pages: int = MOST_PAGES) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, page_count) within the limit and those beyond it."""
    return pages.where(F.col("page_count").between(1, most_pages)), pages.where(~F.col("page_count").between(1, most_pages))


def wav_seconds(data: bytes | None) -> float | None:
    """Seconds of audio, from the chunks of a RIFF file; chunks of odd size are padded. None if it isn't one."""
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, rate, size = 12, None, None
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if kind == b"fmt " and n >= 12 and at + 20 <= len(data):
            rate = struct.unpack("<I", data[at + 16 : at + 20])[0]
        elif kind == b"data":
            size = n
        at += 8 + n + n % 2
    return size / rate if rate and size is not None else None


def with_duration(files: DataFrame) -> DataFrame:
    """``files`` with ``seconds`` and whether the audio is ``valid``: 44 bytes or more, and some sound."""
    ship(files.sparkSession)

    @F.pandas_udf("double")
    def seconds(s):
        return s.map(wav_seconds)

    f = files.withColumn("seconds", seconds("content"))
    return f.withColumn("valid", (F.col("length") >= WAV_LEAST_BYTES) & F.coalesce(F.col("seconds") > 0, F.lit(False)))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """metadata.json of every folder below ``path``, with the folder's name; unreadable ones have nulls."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").text(path, wholetext=True)
    return parsed_metadata(raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("folder"), "value"))


def parsed_metadata(raw: DataFrame) -> DataFrame:
    """(folder, m) of rows (folder, value), the latter JSON."""
    return raw.select("folder", F.from_json("value", METADATA).alias("m"))


def restored(meta: DataFrame, audio: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs that can be restored, and warnings (folder, warning) for those that can't.

    ``audio``: folder, length of each job's WAV file. A folder without one of 44 bytes is left out
    silently. An id must be safe and equal its folder's name, the filename must have no path, and the
    time must be readable; sub-microseconds are cut.
    """
    base = F.regexp_extract("m.filename", r"([^/\\]*)\z", 1)
    at = F.try_to_timestamp(F.regexp_replace("m.created_at", r"(\.\d{6})\d+", "$1"))
    warning = (
        F.when(F.col("m.job_id").isNull(), "invalid metadata")
        .when(~F.col("m.job_id").rlike(SAFE_ID), "invalid job id")
        .when(F.col("m.job_id") != F.col("folder"), "folder and job id differ")
        .when(F.coalesce(F.col("m.filename"), F.lit("")).isin("", ".", "..") | (base != F.col("m.filename")), "invalid filename")
        .when(at.isNull(), "invalid time")
    )
    x = meta.join(audio.where(F.col("length") >= WAV_LEAST_BYTES).select("folder").distinct(), "folder", "left_semi").withColumn("warning", warning)
    language = F.coalesce(F.nullif("m.effective_language", F.lit("")), F.nullif("m.detected_language", F.lit("")))
    jobs = x.where("warning is null").select(F.col("m.job_id").alias("job_id"), F.col("m.filename").alias("filename"), at.alias("created_at"), F.lit("completed").alias("status"), F.lit(1.0).alias("progress"), language.alias("language"), "m.voice", "m.engine")
    return jobs, x.where("warning is not null").select("folder", "warning")


def validated_source(jobs: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """``jobs`` (with candidates ``first`` and ``second``) with ``source``: the first that exists below ``root``, else empty."""
    there = listing.where(within_root(F.col("path"), F.lit(root))).select("path").distinct()
    a, b = there.select(F.col("path").alias("_a")), there.select(F.col("path").alias("_b"))
    return jobs.join(a, F.col("first") == F.col("_a"), "left").join(b, F.col("second") == F.col("_b"), "left").withColumn("source", F.coalesce("_a", "_b", F.lit(""))).drop("_a", "_b")


def within_root(path: Column, root: Column) -> Column:
    """Whether a path stays below a root; one with a parent step doesn't."""
    clean = F.concat(F.regexp_replace(root, r"/+\z", ""), F.lit("/"))
    return F.startswith(path, clean) & ~path.rlike(r"(^|/)\.\.(/|\z)")


def normalized_url(url: Column) -> Column:
    """http:// by default, http and https only, no credentials, query or fragment; null if it is none of that."""
    t = X.trimmed(url)
    full = F.when(t.contains("://"), t).otherwise(F.concat(F.lit("http://"), t))
    ok = full.rlike(r"\A(?i:https?)://[^/?#@\s]+(/[^?#]*)?\z")
    return F.when(ok, F.regexp_replace(full, r"/+\z", ""))


@dataclass(frozen=True)
class ProcessingOptions:
    """What a job is run with. The key is never written: it is no field of the representation."""

    language: str = "auto"
    voice: str = "auto"
    engine: str = "piper"
    speech_rate: float = 1.0
    chunk_max_chars: int = 900
    pause_ms: int = 220
    drop_references: bool = True
    drop_acknowledgements: bool = True
    drop_appendices: bool = True
    remove_citations: bool = True
    keep_headings: bool = True
    use_classifier: bool = False
    classifier_url: str = ""
    classifier_key: str = field(default="", repr=False)

    def __post_init__(self) -> None:
        if not 0.5 <= self.speech_rate <= 2.0:
            raise ValueError("speech rate out of range")
        if self.use_classifier and not self.classifier_url.strip():
            raise ValueError("the classifier needs a URL")
        if self.chunk_max_chars <= 0:
            object.__setattr__(self, "chunk_max_chars", 900)
        if self.pause_ms < 0:
            object.__setattr__(self, "pause_ms", 0)

    def public(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "classifier_key"}


def checked_options(rows: DataFrame, rate_min: float = 0.5, rate_max: float = 2.0, classifier_url: str = "") -> DataFrame:
    """Options of jobs (speech_rate, chunk_max_chars, pause_ms, use_classifier, classifier_url, created_at) with defaults, and ``error``.

    ``created_at`` is the time of the run where it is absent. ``classifier_url`` is the setting that serves where a job has none.
    """
    url = F.coalesce(F.nullif(X.trimmed(F.coalesce("classifier_url", F.lit(""))), F.lit("")), F.lit(classifier_url))
    rate = F.coalesce(F.col("speech_rate").between(rate_min, rate_max), F.lit(False))
    error = F.when(~rate, "speech rate out of range").when(F.coalesce("use_classifier", F.lit(False)) & (url == ""), "the classifier needs a URL")
    checked = rows.withColumn("error", error).withColumn("classifier_url", url)
    checked = checked.withColumn("chunk_max_chars", F.when(F.col("chunk_max_chars") > 0, F.col("chunk_max_chars")).otherwise(900))
    checked = checked.withColumn("pause_ms", F.greatest(F.coalesce("pause_ms", F.lit(0)), F.lit(0)))
    return checked.withColumn("created_at", F.coalesce(F.nullif("created_at", F.lit("")), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))


def listed_folders(spark: SparkSession, root: str) -> DataFrame:
    """(root, name, mtime) of the folders right below ``root``, for ``jobs.orphans``; none if it doesn't exist.

    One listing by the driver, as many rows as jobs are kept; works for any file system that Spark knows.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    found = [(root, s.getPath().getName(), s.getModificationTime()) for s in (fs.listStatus(top) if fs.exists(top) else []) if s.isDirectory()]
    return spark.createDataFrame(found, "root string, name string, ms bigint").select("root", "name", F.timestamp_millis("ms").cast("timestamp_ntz").alias("mtime"))


def delete_folders(spark: SparkSession, roots: list[str], names: list[str]) -> list[str]:
    """Delete the folders of jobs below each root, and give back those that were there. An unsafe name is an error, before anything is deleted."""
    if bad := [n for n in names if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", n)]:
        raise ValueError(f"unsafe job id: {bad[0]}")
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for root in roots:
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
            if p.getFileSystem(conf).delete(p, True):
                gone.append(f"{root.rstrip('/')}/{name}")
    return gone


def export_file(spark: SparkSession, source: str, target: str) -> None:
    """Copy one file as it is; a file that stands at ``target`` is replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def write_texts(texts: DataFrame, path: str) -> DataFrame:
    """Write cleaned texts (doc_id, text), trimmed and with a final newline; give back those without any.

    What is given back reads what was written, so the texts are made once.
    """
    spark = texts.sparkSession
    own = texts.select("doc_id", X.trimmed(F.coalesce("text", F.lit(""))).alias("text"))
    marked = own.select("doc_id", F.when(F.col("text") != "", F.concat("text", F.lit("\n"))).alias("text"), (F.col("text") == "").cast("int").alias("empty"))
    marked.write.mode("overwrite").partitionBy("empty").parquet(path)
    whole = spark.read.schema("doc_id bigint, text string, empty int").parquet(path)
    return whole.where("empty = 1").select("doc_id", F.lit("no narrative text remained after cleanup").alias("reason"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of what ``write_texts`` wrote."""
    return spark.read.schema("doc_id bigint, text string, empty int").parquet(path).where("empty = 0").select("doc_id", "text")


#: The one column that holds a secret.
SECRET = "classifier_key"


def public_metadata(rows: DataFrame) -> DataFrame:
    """(job_id, stage, json): one JSON object for each row, without the classifier's key, wherever it stands."""
    rows = rows.drop(SECRET)
    own = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        own.append(c.dropFields(SECRET).alias(f.name) if isinstance(f.dataType, T.StructType) and SECRET in f.dataType.names else c)
    return rows.select("job_id", "stage", F.to_json(F.struct(*own)).alias("json"))


def write_metadata(rows: DataFrame, path: str) -> None:
    """Write ``public_metadata`` of rows (job_id, stage, ...), a folder for each stage.

    A job's metadata is written before its speech and again after it: the later stage replaces nothing of the earlier one.
    """
    public_metadata(rows).write.mode("append").partitionBy("stage").parquet(path)


def latest_metadata(spark: SparkSession, path: str, stages: tuple[str, ...] = ("saved", "done")) -> DataFrame:
    """(job_id, stage, json): of each job what its latest stage wrote."""
    rows = spark.read.parquet(path)
    return rows.groupBy("job_id").agg(F.max_by(F.struct("stage", "json"), F.array_position(F.lit(list(stages)), F.col("stage"))).alias("m")).select("job_id", "m.stage", "m.json")
