"""Splitting a text into chunks that a speech engine takes.

One rule serves sentences, clauses and words: pieces go into a chunk while they fit, joined by
blanks, and a piece that is too long by itself stands alone. It is a fold that carries a chunk's
length only; long sentences are packed again by clauses, and what is left too long by words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions.folds import joined_runs, scan
from pagemill.operators.fold import tidied

DEFAULT_LIMIT = 900
_BLANK = r"[\s\x0B\x{85}\p{Z}]"


def packed(pieces: Column, limit: int) -> Column:
    """Pieces that aren't empty as chunks of ``limit`` characters at most, but for pieces that are longer."""

    def chunks(own: Column) -> Column:
        full = scan(F.transform(own, F.char_length), F.lit(0), lambda used, n: (used > 0) & (used + 1 + n > limit), lambda used, n, new: F.when(new | (used == 0), n).otherwise(used + 1 + n), "boolean")
        return joined_runs(own, full, " ")

    return X.bound(pieces, chunks)


def _pieces(text: Column, gap: str) -> Column:
    return F.filter(F.transform(F.split(text, gap), X.trimmed), lambda p: p != "")


def by_words(text: Column, limit: int) -> Column:
    """Chunks of words; a word that is longer is cut, and what remains of it begins the next chunk."""
    parts = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(w) - 1) / limit).cast("int")), lambda k: F.substring(w, k * limit + 1, F.lit(limit)))
    words = F.transform(X.tokens(text), lambda w: F.when(F.char_length(w) > limit, parts(w)).otherwise(F.array(w)))
    return packed(F.flatten(words), limit)


def by_clauses(sentence: Column, limit: int) -> Column:
    """Chunks of clauses. Only the last chunk is cut by words: a long clause before it stays whole."""

    def cut(chunks: Column) -> Column:
        last = F.try_element_at(chunks, F.lit(-1))
        return F.when(F.char_length(last) > limit, F.concat(F.slice(chunks, 1, F.greatest(F.size(chunks) - 1, F.lit(0))), by_words(last, limit))).otherwise(chunks)

    return X.bound(packed(_pieces(sentence, rf"(?<=[,;:]){_BLANK}+"), limit), cut)


def chunks_of(text: Column, limit: int = DEFAULT_LIMIT) -> Column:
    """Array of a text's chunks: the whole text if it fits, else its sentences packed. None for an empty text."""
    limit = limit if limit > 0 else DEFAULT_LIMIT

    def cut(t: Column) -> Column:
        own = F.filter(F.transform(X.sentences(t), X.trimmed), lambda s: s != "")
        # a sentence beyond the limit is a chunk of its own
        long = F.transform(packed(own, limit), lambda c: F.when(F.char_length(c) > limit, by_clauses(c, limit)).otherwise(F.array(c)))
        return F.when(F.char_length(t) > limit, F.flatten(long)).when(t == "", F.array().cast("array<string>")).otherwise(F.array(t))

    return X.bound(tidied(text), cut)


def split_text(docs: DataFrame, *, text_col: str = "text", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(doc_id, chunk_no, chunk): the chunks of every text, from 0."""
    return docs.select("doc_id", F.posexplode(chunks_of(F.coalesce(text_col, F.lit("")), limit)).alias("chunk_no", "chunk"))


def _sql_packed(pieces: str, limit: int) -> str:
    """``packed`` as a DuckDB expression, by a fold that keeps chunks apart by chr(2)."""
    return f"string_split(list_reduce({pieces}, lambda acc, x: acc || CASE WHEN length(list_last(string_split(acc, chr(2)))) + 1 + length(x) > {limit} THEN chr(2) ELSE ' ' END || x), chr(2))"


def sql_chunks(source: str, limit: int = DEFAULT_LIMIT) -> str:
    """(doc_id, chunk_no, chunk) of the rows (doc_id, text) of ``source``, as DuckDB queries named up to ``chunked``."""
    trimmed = lambda pieces: f"list_filter(list_transform({pieces}, lambda p: {X.sql_trimmed('p')}), lambda p: p <> '')"
    clauses = trimmed(rf"string_split(regexp_replace(c, '([,;:])[\s\x0B\x{{85}}\p{{Z}}]+', '\1' || chr(3), 'g'), chr(3))")
    parts = f"list_transform(range(0, (length(w) - 1) // {limit} + 1), lambda k: substring(w, k * {limit} + 1, {limit}))"
    words = f"flatten(list_transform({X.sql_tokens('list_last(cl)')}, lambda w: {parts}))"
    return f"""whole AS (
  SELECT row_number() OVER () AS row, doc_id, {X.sql_trimmed(f"regexp_replace({X.sql_trimmed('coalesce(text, chr(32))')}, chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")} AS t FROM {source}
), packed AS (
  SELECT row, doc_id, CASE WHEN length(t) <= {limit} THEN [t] ELSE {_sql_packed(trimmed(X.sql_sentences("t")), limit)} END AS cs FROM whole WHERE t <> ''
), piece AS (
  SELECT row, doc_id, unnest(range(len(cs))) AS k, unnest(cs) AS c FROM packed
), clause AS (
  SELECT *, CASE WHEN length(c) <= {limit} THEN [c] ELSE {_sql_packed(clauses, limit)} END AS cl FROM piece
), worded AS (
  SELECT row, doc_id, k, CASE WHEN length(list_last(cl)) > {limit} THEN list_concat(cl[1 : len(cl) - 1], {_sql_packed(words, limit)}) ELSE cl END AS cs FROM clause
), flat AS (
  SELECT row, doc_id, k, unnest(range(len(cs))) AS j, unnest(cs) AS chunk FROM worded
), chunked AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY row ORDER BY k, j) - 1 AS INTEGER) AS chunk_no, chunk FROM flat
)"""


def with_pauses(chunks: DataFrame, engine: str = "piper", default_ms: int = 220, rate: int = 22050) -> DataFrame:
    """Chunks with the silence after each but a document's last."""
    last = F.lead("chunk_no").over(W.partitionBy("doc_id").orderBy("chunk_no")).isNull()
    pause = F.when(last, 0).otherwise(X.pause_ms(F.col("chunk"), engine, default_ms))
    return chunks.withColumn("pause_ms", pause).withColumn("silent_frames", X.silent_frames(F.col("pause_ms"), rate))


def engine_limit(engine: Column, option: Column) -> Column:
    """One engine takes the option's limit; the other 2000 characters at least."""
    return F.when(engine == "kokoro", F.greatest(option, F.lit(2000))).otherwise(option)
