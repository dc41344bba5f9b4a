"""From chunks to audio, with any engine: a function from a chunk to 16-bit samples."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions.shipping import ship
from pagemill.operators import chunk

AUDIO = "doc_id bigint, wav binary, seconds double, chunks int"


def pcm16(samples) -> bytes:
    """Samples between -1 and 1 as 16-bit integers; others are clipped."""
    import numpy as np

    return (np.clip(np.asarray(samples, dtype=np.float64).reshape(-1), -1.0, 1.0) * 32767).astype("<i2").tobytes()


def wav(parts: list[bytes], rate: int, channels: int = 1) -> bytes:
    body = b"".join(parts)
    out = io.BytesIO()
    out.write(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16))
    out.write(b"data" + struct.pack("<I", len(body)) + body)
    return out.getvalue()


def prepared(texts: DataFrame, *, limit: int = chunk.DEFAULT_LIMIT, engine: str = "piper", pause_ms: int = 220, rate: int = 22050) -> DataFrame:
    """(doc_id, chunk_no, chunk, pause_ms, silent_frames) of cleaned texts in spoken form; one engine takes longer chunks."""
    longest = max(limit, 2000) if engine == "kokoro" else limit
    spoken = texts.select("doc_id", X.verbalized(F.coalesce("text", F.lit(""))).alias("text"))
    return chunk.with_pauses(chunk.split_text(spoken, limit=longest), engine, pause_ms, rate)


_REQUEST = "output_path string, chunks array<string>, speech_rate double, speed double, language string, voice string"


def requests(lines: DataFrame, engine: str = "piper") -> DataFrame:
    """Requests to an engine, one JSON object in each ``value``: trimmed chunks without blank ones, and the engine's own rate.

    ``error`` is set where the object can't be read or has no chunks left.
    """
    r = F.from_json("value", _REQUEST)
    chunks = F.filter(F.transform(F.coalesce(r["chunks"], F.array().cast("array<string>")), lambda c: X.trimmed(F.coalesce(c, F.lit("")))), lambda c: c != "")
    rate = X.speed(F.coalesce(r["speed"], F.lit(1.0))) if engine == "kokoro" else X.length_scale(F.coalesce(r["speech_rate"], F.lit(1.0)))
    rows = lines.withColumn("chunks", chunks).withColumn("rate", rate).withColumn("output_path", r["output_path"])
    return rows.withColumn("error", F.when(F.col("output_path").isNull(), "no request").when(F.size("chunks") == 0, "no chunks"))


def engine_voice(language: Column) -> Column:
    """The one-letter language that one engine takes."""
    return F.when(F.lower(language).startswith("pt"), "p").otherwise("a")


def synthesized(chunks: DataFrame, say: Callable[[str], bytes], *, rate: int = 22050, channels: int = 1) -> DataFrame:
    """One WAV for each document, with silence after each chunk but the last. Blank chunks are left out.

    A document's audio is one value, so its chunks meet in one call.
    """
    ship(chunks.sparkSession)

    def document(pdf):
        import pandas as pd

        parts, n = [], 0
        for text, frames in zip(*(pdf.sort_values("chunk_no")[c] for c in ("chunk", "silent_frames")), strict=True):
            parts.append(say(text) + b"\0" * (int(frames) * 2 * channels))
            n += 1
        size = sum(map(len, parts))
        return pd.DataFrame([(pdf.doc_id.iloc[0], wav(parts, rate, channels), size / (rate * channels * 2), n)], columns=["doc_id", "wav", "seconds", "chunks"])

    return chunks.where(X.trimmed(F.col("chunk")) != "").groupBy("doc_id").applyInPandas(document, AUDIO)
