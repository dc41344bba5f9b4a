"""Best-fit packing, planned over the histogram of lengths.

Three steps. (1) Every document is encoded once and cut into pieces of at most ``capacity`` ids; the
pieces go to a work table with their rank within their length, counted inside each task. (2) The
histogram of lengths has ``capacity`` rows at most, however many documents there are; best fit
(decreasing) runs over its counts and plans groups of equal sequences. (3) A piece's rank within its
length over the whole table is its rank within the task plus the counts of earlier tasks; pieces
take the planned slots by joining on length and rank.

No window runs over a length, so a length that a third of all rows have costs no single task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import WorkTables, map_arrow, slices
from pagemill.llm.tokens import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, part int, local_rank bigint"


#: Parts of a length's ranks in which its slots are looked for.
RANK_BLOCKS = 64


@dataclass(frozen=True)
class Slots:
    """``count`` pieces of one length, from rank ``rank_from``, each in a sequence of its own."""

    length: int
    rank_from: int
    count: int
    sequence_from: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> list[Slots]:
    """Best fit, longest first, over counts.

    Sequences with equal room and equal pieces are one group; a group is split only where a length's
    count ends inside it. So the plan's size depends on the number of lengths, not of pieces.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, count)
    made, out = 0, []
    for length in sorted((n for n in histogram if histogram[n] > 0), reverse=True):
        left, rank = histogram[length], 0
        free = length
        while left and free <= capacity:
            # the tightest sequences first; one with room for several pieces of this length is met again
            if not room[free]:
                free += 1
                continue
            first, n = room[free].pop()
            take = min(n, left)
            if take < n:
                room[free].append((first + take, n - take))
            out.append(Slots(length, rank, take, first, capacity - free))
            room[free - length].append((first, take))
            rank, left = rank + take, left - take
            free = max(length, free - length) if free - length >= length else free
        while left:
            fits = capacity // length
            full, rest = divmod(left, fits)
            for n, pieces in ((full, fits), (1 if rest else 0, rest)):
                for k in range(pieces if n else 0):
                    out.append(Slots(length, rank, n, made, k * length))
                    rank += n
                if n:
                    room[capacity - pieces * length].append((made, n))
                made += n
            left = 0
    return out


def _pieces(capacity: int, end_id: int | None, tokenizer: str, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, ranks), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        names = [f.split()[0] for f in PIECES.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
        for b in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.ids(text or "")
                if end_id is not None:
                    ids.append(end_id)
                raw, n = np.asarray(ids, dtype="<u4"), len(ids)
                first = n % capacity or min(n, capacity)
                start = 0
                for k in range(-(-n // capacity)):
                    length = first if k == 0 else capacity
                    seen[length] += 1
                    data = raw[start : start + length].tobytes()
                    rows.append((doc, k, start, length, data, zlib.crc32(data), part, int(seen[length]) - 1))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)

    return run


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int | None = 2,
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    small_rows: int = 500_000,
) -> DataFrame:
    """Pieces of documents with the sequences they go into.

    Of equal lengths, pieces take slots in the order of their tasks and of the scan; which of two alike goes
    where has no effect on how full sequences are.

    Columns: doc_id, piece, start, length, ids (binary, unsigned 32-bit little-endian), ids_crc32,
    sequence_id, offset. A null or empty text is its end id alone. Only documents longer than
    ``capacity`` are cut; their first piece is the short one, so that all others fill a sequence.
    Repeated rows are packed as often as they stand; a null id stays null. An empty table gives an
    empty result. Texts are encoded whole, however long; other columns are not read.
    """
    spark = docs.sparkSession
    work = WorkTables(spark, "packing")
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = work.keep(map_arrow(source, _pieces(capacity, end_id, tokenizer, ranks), PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg((F.max("local_rank") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = work.keep(counts.select("length", "part", "n", before.alias("earlier")), "counts")
    histogram = {r["length"]: int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # slots of a length lie one behind the other over its ranks; a piece looks among those of its block of ranks only
    steps = {n: max(1, -(-count // RANK_BLOCKS)) for n, count in histogram.items()}
    cut = [(s.length, k, s.rank_from, s.rank_from + s.count, s.sequence_from, s.offset) for s in plan(histogram, capacity) for k in range(s.rank_from // steps[s.length], (s.rank_from + s.count - 1) // steps[s.length] + 1)]
    slots = spark.createDataFrame(cut, "slot_length bigint, slot_block bigint, rank_from bigint, rank_to bigint, sequence_from bigint, offset bigint")
    step = spark.createDataFrame(sorted(steps.items()), "length bigint, step bigint")
    offsets = counts.select("length", "part", "earlier").join(F.broadcast(step), "length")
    if counts.count() <= small_rows:  # else an ordinary join on length and part
        offsets = F.broadcast(offsets)
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("local_rank") + F.col("earlier"))
    # the plan has a bounded number of rows for each length, whatever the number of documents
    same = (F.col("length") == F.col("slot_length")) & (F.floor(F.col("rank") / F.col("step")) == F.col("slot_block"))
    placed = ranked.join(F.broadcast(slots), same & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
