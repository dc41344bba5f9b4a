"""Exact top-k search by inner product: columnar branch and bound.

Candidates are packed into blocks in vertical layout, one row for each dimension. Queries meet a
block of candidates dimension block by dimension block: after each, a candidate stays only if its score
so far plus the product of the remaining masses of query and candidate (Cauchy-Schwarz) can still
reach the query's k-th best; the survivors are compacted. Scores are integers, and bounds have slack
for rounding, so nothing that belongs to the result is dropped.

The search is a grid: candidates are dealt into groups of at most ``group_bytes``, the stated queries
into blocks of at most ``query_rows``, and each pair of group and block is one task, which holds its
group, streams its queries, and sends each query's k best. Nothing goes through the driver and
nothing is broadcast. An exact search costs the product of queries and candidates, in any layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import map_arrow

#: Sums up to here are exact in doubles, and in 64-bit integers.
_EXACT, _LONG = float(1 << 52), float(1 << 62)


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite."""
    d = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(d, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))


class Block:
    """Candidates of one length in vertical layout, the heaviest dimensions first, with their remaining masses."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, width: int = 16):
        n, d = vectors.shape
        self.ids, self.peak = ids, float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.dims = np.argsort(-np.square(vectors.astype(np.float64)).sum(axis=0), kind="stable")
        self.exact = np.ascontiguousarray(vectors[:, self.dims].T)  # (dimensions, candidates)
        self.edges = [*range(0, d, width), d] if d else [0]
        self.rest = np.vstack([remaining(self.exact), np.zeros((1, n))])[self.edges]
        self._floats: np.ndarray | None = None

    def as_kind(self, kind) -> np.ndarray:
        if kind is not np.float64:
            return self.exact.astype(kind)
        if self._floats is None:
            self._floats = self.exact.astype(np.float64)
        return self._floats


def remaining(vertical: np.ndarray) -> np.ndarray:
    """For each dimension, the length of what a vector has from there on."""
    return np.sqrt(np.cumsum(np.square(vertical.astype(np.float64))[::-1], axis=0)[::-1])


def search_block(q: np.ndarray, q_ids: np.ndarray, block: Block, k: int, best: list) -> None:
    """Merge the block's candidates into ``best``, which has (scores, ids) for each row of ``q``."""
    n, d = len(block.ids), q.shape[1]
    if not n:
        return
    peak = float(np.abs(q.astype(np.float64)).max(initial=0)) * block.peak * max(d, 1)
    # doubles while they hold every sum, then 64-bit integers, then Python's
    kind = np.float64 if peak < _EXACT else np.int64 if peak < _LONG else object
    slack = 1 + peak * 1e-12  # sums of masses are rounded, and beyond 2 ** 53 scores are, too
    vertical, queries, edges, c_ids = block.as_kind(kind), np.ascontiguousarray(q[:, block.dims].astype(kind)), block.edges, block.ids
    q_rest = np.vstack([remaining(queries.T), np.zeros((1, len(q)))])[edges]
    first = queries[:, : edges[1]] @ vertical[: edges[1]] if d else np.zeros((len(q), n), kind)
    for i in range(len(q)):
        scores, ids = best[i]
        floor = scores[-1] if len(scores) >= k else None
        alive, partial = np.arange(n), first[i]
        for step in range(1, len(edges)):
            if step > 1:
                a, b = edges[step - 1], edges[step]
                partial = partial + queries[i, a:b] @ vertical[a:b][:, alive]
            if floor is None and len(alive) > k:
                # without k results so far, the k most promising give a first bound
                top = alive[np.argpartition(-partial.astype(np.float64), k)[: k + 1]]
                own = np.sort(queries[i] @ vertical[:, top[c_ids[top] != q_ids[i]][:k]])[::-1]
                floor = _long(own[k - 1 : k])[0] if len(own) >= k else None
            if floor is not None and step < len(edges) - 1:
                bound = q_rest[step, i] * block.rest[step][alive]
                keep = partial.astype(np.float64) + bound * (1 + 1e-9) + slack >= float(floor)
                alive, partial = alive[keep], partial[keep]
                if not len(alive):
                    break
        if not len(alive):
            continue
        own = c_ids[alive] != q_ids[i]
        got, who = _long(partial[own]), c_ids[alive][own]
        if floor is not None:
            keep = got >= floor
            got, who = got[keep], who[keep]
        got, who = np.concatenate([scores, got]), np.concatenate([ids, who])
        order = np.lexsort((who, ~got))[:k]  # ~x falls as x rises, for every 64-bit integer
        best[i] = (got[order], who[order])


def _long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in scores], np.int64)


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of a batch's rows, for each length of vectors."""
    lists = b.column("v")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ids = b.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), ids[rows], flat[starts[rows][:, None] + np.arange(d)].reshape(len(rows), int(d))


def _search(k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        cell, held, blocks = None, {}, {}

        def packed(d: int) -> list[Block]:
            """The cell's candidates of one length: packed when the first query of that length comes."""
            if d in held:
                ids, vectors = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
                blocks[d] = [Block(ids[i : i + block], vectors[i : i + block]) for i in range(0, len(ids), block)]
            return blocks.get(d, [])

        for whole in batches:
            # a cell's candidates come before its queries
            cells, asks = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "query"))
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, e in zip([0, *cuts], [*cuts, whole.num_rows], strict=True):
                if a == e:
                    continue
                if cells[a] != cell:
                    cell, held, blocks = cells[a], {}, {}
                for d, ids, vectors in _vectors(whole.slice(a, e - a)):
                    if not asks[a]:
                        held.setdefault(d, []).append((ids, _narrow(vectors)))
                        continue
                    best = [none] * len(ids)
                    for c in packed(d):
                        search_block(vectors, ids, c, k, best)
                    n = [len(s) for s, _ in best]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([w for _, w in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["query_id", "vec_id", "score"])

    return run


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them: a copy, so that the batch can go."""
    low, high = vectors.min(initial=0), vectors.max(initial=0)
    kind = np.int16 if -(1 << 15) <= low and high < 1 << 15 else np.int32 if -(1 << 31) <= low and high < 1 << 31 else np.int64
    return vectors.astype(kind)


def top_k(
    vectors: DataFrame,
    *,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 64,
    group_bytes: int = 128_000_000,
    query_rows: int = 50_000,
    block: int = 8192,
) -> DataFrame:
    """Each query's ``k`` best of all other rows: query_id, rank, vec_id, score.

    Queries are the rows whose id ``every`` divides. Vectors that are null or hold null or non-finite
    components, and rows with a null id, take no part; vectors of different lengths have no product
    and don't meet; empty ones have the product 0. A query id that repeats is searched once, with its smallest vector; candidates
    that repeat count as often as they stand, except those with the query's own id. Ties go to the
    smaller id. Fewer candidates than ``k`` give fewer rows. A score beyond 64 bits counts as the largest or
    smallest long. ``vectors`` must give its rows in the same order whenever a task is run again, as a scan does.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), quantised(F.col(f"`{vector_col}`"), scale).alias("v")).where("vec_id is not null and v is not null")
    asked = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v") * 8 + 64), F.lit(0)).alias("bytes"), F.count_if(asked).alias("asked")).first()
    # small tables make as many groups as there are cores, large ones as many as memory asks for
    groups = max(1, -(-size["bytes"] // group_bytes), min(spark.sparkContext.defaultParallelism, -(-size["n"] // 4096)))
    asks = max(1, -(-size["asked"] // query_rows))
    # a row's group comes from its place in the scan: ids that repeat spread as well
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "v", place.alias("group")).select("vec_id", "v", "group", each(asks).alias("part"), F.lit(False).alias("query"))
    stated = rows.where(asked).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = stated.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(asks)).alias("part")).select("vec_id", "v", each(groups).alias("group"), "part", F.lit(True).alias("query"))
    cell = (F.col("group") * asks + F.col("part")).cast("int").alias("cell")
    both = candidates.select(cell, "query", "vec_id", "v").unionAll(queries.select(cell, "query", "vec_id", "v"))
    cells = both.repartitionById(groups * asks, "cell").sortWithinPartitions("cell", "query")
    found = map_arrow(cells, _search(k, block), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
