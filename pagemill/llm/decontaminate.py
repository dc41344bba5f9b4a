"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows.

Texts and items are normalised alike: A-Z becomes a-z, every other ASCII character that is no digit
or letter separates words. A window is ``width`` consecutive words of an item; an item of fewer
words, but not none, is one window. The automaton's letters are words, by their place in the
items' vocabulary; all words that no item holds are one letter. Each text is scanned once, and
every occurrence of a window is mapped back to characters of the original text.

A word's number is written as three digits, each place with an alphabet of its own: so a node has 64 children
at most, which the library searches one by one, and matches begin and end with words.

What bounds an automaton is its number of windows, so items go to the executors in blocks of about
``block_windows``, one block at a time on the driver too; the usual benchmark fits into one block. A larger
one makes one pass over the texts for each block, with the intervals found so far kept in a work
table in between. An item of many words is dealt out in overlapping parts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import WorkTables, append_struct, fresh_name, map_arrow, slices, utf8

#: Bytes as a normalised text has them: a-z and digits stay, A-Z is lowered, what is not ASCII stays.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("word_from", "word_to", "char_from", "char_to")]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(_BYTES).split()


#: Windows of an item's part.
PART_WINDOWS = 10_000


#: Words that three digits can tell apart, and what stands for words of no item.
MOST_LETTERS = 1 << 18
_NO_LETTER = "\xff\xff\xff"


def letter(k: int) -> str:
    """The three digits of a number below ``MOST_LETTERS``."""
    return chr(k & 63) + chr(64 + (k >> 6 & 63)) + chr(128 + (k >> 12))


class Scanner:
    """The automaton of one block of items' parts, each (item, normalised words joined by blanks)."""

    def __init__(self, parts: list[tuple[str, bytes]], width: int, most_letters: int = MOST_LETTERS):
        import ahocorasick

        self.items = sorted({item for item, _ in parts})
        number = {item: k for k, item in enumerate(self.items)}
        self.letters: dict[bytes, str] = {}
        self.found = ahocorasick.Automaton()
        self.rest: Scanner | None = None
        for at, (item, text) in enumerate(parts):
            own = text.split()
            if at and len(self.letters) + len(own) > most_letters:  # more words than letters: a second automaton
                self.rest = Scanner(parts[at:], width, most_letters)
                break
            for w in own:
                if w not in self.letters:
                    self.letters[w] = letter(len(self.letters))
            line, k, n = "".join([self.letters[w] for w in own]), number[item], min(width, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                window = line[3 * i : 3 * (i + n)]
                known = self.found.get(window, None)
                if known is None:
                    self.found.add_word(window, (n, k))
                elif known[-1] != k:
                    self.found.add_word(window, (*known, k))
        self.empty = not len(self.found)
        if not self.empty:
            self.found.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Intervals of words inside some window, merged, and the items whose windows occur."""
        spans, items = ([], set()) if self.rest is None else self.rest.hits(words)
        if not self.empty and words:
            known, who = self.letters.get, set()
            for at, (n, *own) in self.found.iter("".join([known(w, _NO_LETTER) for w in words])):
                last = at // 3 + 1
                spans.append((last - n, last))
                who.update(own)
            items |= {self.items[k] for k in who}
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """The same intervals with the characters of the original text that they cover."""
    if not spans:
        return []
    at = [(m.start(), m.end()) for m in _WORD.finditer(text.decode("utf-8"))]
    return [(a, b, at[a][0], at[b - 1][1]) for a, b in spans]


_scanners: dict[str, Scanner] = {}


def _pass(shared, token: str, width: int) -> Callable:
    def make() -> Callable:
        if token not in _scanners:  # one automaton for each Python process; the last one made is kept
            _scanners.clear()
            _scanners[token] = Scanner(shared.value, width)
        scanner = _scanners[token]

        def f(text, *before) -> list[tuple]:
            was = before[0].to_pylist() if before else [None] * len(text)
            out = []
            for t, w in zip(utf8(text), was, strict=True):
                words = words_of(t)
                spans, found = scanner.hits(words)
                if w:
                    spans = merged(spans + [(s["word_from"], s["word_to"]) for s in w["spans"]])
                    found |= set(w["items"])
                full = characters(t, spans) if spans else []
                out.append((len(words), [dict(zip(("word_from", "word_to", "char_from", "char_to"), s, strict=True)) for s in full], sorted(found)))
            return out

        return f

    return make


def _parts(width: int):
    """(item, part, n, text): an item's normalised words in parts that share ``width - 1`` words, with their number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows = []
            for item, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                words = words_of(text)
                for k, i in enumerate(range(0, max(len(words) - width + 1, min(len(words), 1)), PART_WINDOWS)):
                    own = words[i : i + PART_WINDOWS + width - 1]
                    rows.append((item, k, max(len(own) - width + 1, 1), b" ".join(own)))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["item", "part", "n", "words"])

    return run


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, block_windows: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """How many blocks the items' parts make, and the blocks one after the other; no two are held at a time."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("item is not null and text is not null")
    work = WorkTables(benchmark.sparkSession, "decontaminate-items")
    # rows that repeat an item's words are one
    parts = work.keep(map_arrow(items, _parts(width), "item string, part int, n bigint, words binary").distinct(), "parts")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(total) // block_windows))

    def blocks() -> Iterator[list[tuple[str, bytes]]]:
        for k in range(n):
            own = parts if n == 1 else parts.where(F.pmod(F.xxhash64("item", "part", "words"), F.lit(n)) == k)
            yield sorted((r["item"], bytes(r["words"])) for r in own.select("item", "words").collect())
        work.drop_all()

    return n, blocks()


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    block_windows: int = 64_000,
) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of words, spans and items; also that column's name.

    A null or empty text has no words and no spans; texts are scanned whole, however long. Items with
    a null id or text, or without words, are left out; rows that repeat an item count once, and an id with several
    texts has the windows of all; an empty benchmark finds nothing. Rows of ``docs`` that repeat, or
    repeat an id, are scanned each. The struct's name clashes with no column.
    """
    spark = docs.sparkSession
    work, name = None, None
    n, blocks = item_blocks(benchmark, item_col, item_text_col, width, block_windows)
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(block)  # a block's words: some megabytes, whatever the benchmark's size
        inputs = [text_col] if name is None else [text_col, name]
        found, new = append_struct(docs, inputs, _pass(shared, uuid.uuid4().hex, width), RESULT, "scan")
        if name is not None:
            found = found.drop(name)
        docs, name = found, new
        if k + 1 < n:
            work = work or WorkTables(spark, "decontaminate")
            before = work.frames()
            docs = work.keep(docs, "scanned")
            work.drop(*before)
            shared.destroy()
    return docs, name


def clean_only(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without any occurrence of a window, with their own columns."""
    columns = docs.columns
    found, name = scan(docs, benchmark, **how)
    return found.where(F.size(F.col(f"`{name}`.spans")) == 0).select(*[F.col(f"`{c}`") for c in columns])


def redacted(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", mask: str = " ", **how) -> DataFrame:
    """The documents with every hit passage replaced by ``mask``, by offsets in the original text."""
    columns = docs.columns
    found, name = scan(docs, benchmark, text_col=text_col, **how)
    spans, out = F.col(f"`{name}`.spans"), fresh_name(found.columns, "clean_text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
    text = F.col(f"`{text_col}`")
    step = lambda acc, s: F.struct(
        s["char_to"].alias("at"),
        F.concat(acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), (s["char_from"] - acc["at"]).cast("int")), F.lit(mask)).alias("done"),
    )
    cut = F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    found = found.withColumn(out, F.when(F.size(spans) > 0, cut).otherwise(text))
    return found.select(*[F.col(f"`{out}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in columns])
