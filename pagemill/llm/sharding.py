"""Two-pass external shuffle into shards.

First pass: every row goes to one of as many buckets as the table's bytes, over all its columns, need at ``bucket_bytes``
each, by a seeded hash of its place in the scan; so rows that repeat, and keys that a third of all
rows share, spread evenly. Second pass: each bucket, which fits into memory, is put into a fixed
order, shuffled by Fisher-Yates from a seed of its own, and written to a work table. The buckets in
order, one behind the other, are the permutation; rows are dealt from it to the shards in turn, so
that shards differ by one row at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import WorkTables, fresh_name, map_arrow, row_bytes


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0 to n - 1: position i, from the last down, swaps with one at or before it."""
    rng = np.random.default_rng((seed, bucket))
    order = np.arange(n)
    picks = rng.integers(0, np.arange(1, n + 1)) if n else order
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def _shuffle(bucket_col: str, place_col: str, tie_col: str, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = list(batches)
        if not whole:
            return
        table = pa.Table.from_batches(whole)
        del whole
        buckets = table.column(bucket_col)
        for bucket in sorted(pc.unique(buckets).to_pylist()):
            own = table.filter(pc.equal(buckets, bucket))
            own = own.take(pc.sort_indices(own, sort_keys=[(tie_col, "ascending")]))
            own = own.take(pa.array(fisher_yates(own.num_rows, seed, bucket)))
            own = own.drop_columns([tie_col]).append_column(place_col, pa.array(np.arange(own.num_rows), pa.int64()))
            yield from own.to_batches(max_chunksize=4096)

    return run


def shuffle_shards(
    docs: DataFrame,
    *,
    shards: int = 8,
    seed: int = 20,
    bucket_bytes: int = 16_000_000,
    small_buckets: int = 1_000_000,
) -> tuple[DataFrame, str]:
    """All rows of ``docs`` with a struct column (shard, slot), and that column's name.

    ``docs`` must give its rows in the same order whenever a task is run again, as a scan does; hand
    over a written table where it doesn't. Slots have no gaps and start at 0 in each shard. Repeated
    rows stay as often as they stand; nulls are values like others; an empty table gives an empty
    result. A row larger than a bucket, as one with a very long text, gets no other treatment than to make its bucket larger.
    """
    spark = docs.sparkSession
    work = WorkTables(spark, "sharding")
    total = docs.agg(F.coalesce(F.sum(row_bytes(docs)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-int(total) // bucket_bytes))
    bucket, tie = fresh_name(docs.columns, "bucket"), fresh_name(docs.columns, "tie")
    place, name = fresh_name(docs.columns, "place"), fresh_name(docs.columns, "sharded")
    # the place in the scan is the same whenever a task is run again, and no two rows share it
    scattered = docs.withColumn(tie, F.monotonically_increasing_id()).withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col(tie)), F.lit(buckets)).cast("int"))
    exchanged = scattered.repartitionById(buckets, F.col(bucket)) if buckets > 1 else scattered.repartition(1)
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField(bucket, T.IntegerType()), T.StructField(place, T.LongType())]
    shuffled = work.keep(map_arrow(exchanged, _shuffle(bucket, place, tie, seed), T.StructType(fields)), "buckets")
    counts = shuffled.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    taken = [*docs.columns, bucket, place]
    of, earlier = fresh_name(taken, "of_bucket"), fresh_name(taken, "earlier")
    offsets = _earlier(counts.select(F.col(bucket).alias("b"), "n")).select(F.col("b").alias(of), F.col("earlier").alias(earlier))
    if buckets <= small_buckets:
        offsets = F.broadcast(offsets)
    at = F.col(place) + F.col(earlier)
    dealt = shuffled.join(offsets, F.col(bucket) == F.col(of))
    where = F.struct(F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / F.lit(shards)).cast("long").alias("slot"))
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns], where.alias(name)), name


def _earlier(counts: DataFrame, at_once: int = 4096) -> DataFrame:
    """(b, earlier): the rows of all buckets before each, over groups of buckets and inside them."""
    grouped = counts.withColumn("g", F.floor(F.col("b") / at_once))
    # one row for each 4096 buckets, which hold some ten gigabytes each
    before = grouped.groupBy("g").agg(F.sum("n").alias("n")).select("g", F.coalesce(F.sum("n").over(W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return grouped.select("b", "g", inside.alias("inside")).join(before, "g").select("b", (F.col("base") + F.col("inside")).alias("earlier"))


def write_shards(docs: DataFrame, path: str, *, shards: int = 8, **how) -> None:
    """Write the shuffled rows, one folder for each shard, in the order of their slots inside each file."""
    columns = docs.columns
    found, name = shuffle_shards(docs, shards=shards, **how)
    shard, slot = fresh_name(columns, "shard"), fresh_name(columns, "slot")
    out = found.select(*[F.col(f"`{c}`") for c in columns], F.col(f"{name}.shard").alias(shard), F.col(f"{name}.slot").alias(slot))
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)

