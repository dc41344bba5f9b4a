"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is its distinct shingles of ``WIDTH`` words. Documents with equal word sequences
are one vertex. Each of ``TREES`` independent trees branches the vertices by a minwise token of
their sets: a pair of similarity s goes the same way with probability s. Nodes of at most ``small``
vertices are compared exhaustively on 64-coordinate sketches; larger nodes branch again by
``FAN`` further minwise tokens, chosen anew in each node. A node that a token hardly splits
(``dense``) holds sets that are alike, and is joined as a whole. What trees give is a forest of
candidate links, never all pairs of a node; its components hold every true link with both ends.

Then each component's documents are read once, whole, and every link between parts that are not yet
connected is decided on the full sets. Of a component whose sets are too many for one task, first one
candidate link of each vertex, to its neighbour with most links, is decided; what these links connect is one
part. What is not in the largest part is cut into blocks, and so is the largest part; each pair of
blocks is one task, but those inside the largest part, where nothing is left to decide. So a template
that millions of pages share sends each page twice, and only its exceptions meet all of them.

Recall, for a pair just at the threshold of 0.75: the 16 roots miss it with probability
0.25 ** 16 = 2e-10, the sketch (28 of 64 coordinates at least) with about 1e-7; each level of
branching below a root keeps a pair with 1 - 0.25 ** 2 = 0.94.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import WorkTables, append_struct, fresh_name, map_arrow, slices, utf8

WIDTH = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
TREES, BRANCHES, FAN = 16, 48, 2
COORDINATES = TREES + BRANCHES
#: Equal sketch coordinates that a candidate pair has at least.
LEAST_EQUAL = 28
_WORDS_AT_ONCE = 50_000
_LONG_WORD = 64
_ALL = (1 << 64) - 1


def _constants(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit numbers, by splitmix64."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _ALL
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _ALL
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, dtype=np.uint64)


_BYTE = _constants(256, 1)
_BASE = int(_constants(1, 2)[0])
_XOR, _TIMES = _constants(COORDINATES, 3)[:, None], _constants(COORDINATES, 4)[:, None]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers, and its inverse's, up to at least n."""
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; words end at blanks and at the control characters 9 to 13."""
    return [] if text is None else text.lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``WIDTH`` words, or of the whole if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) > _WORDS_AT_ONCE + WIDTH - 1:
        parts = [shingles(words[i : i + _WORDS_AT_ONCE + WIDTH - 1]) for i in range(0, len(words) - WIDTH + 1, _WORDS_AT_ONCE)]
        return np.unique(np.concatenate(parts))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if lengths.max() > _LONG_WORD:  # a digest stands for such a word, in every text, so that any text's work is bounded
        words = [w if len(w) <= _LONG_WORD else hashlib.blake2b(w, digest_size=24).digest() for w in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
    line = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _power(len(line) + 1)
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum(_BYTE[line] * up[: len(line)], out=sums[1:])
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = min(WIDTH, len(words))
    a, b = starts[: len(words) - n + 1], ends[n - 1 :]
    h = (sums[b] - sums[a]) * down[a]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def signature(s: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate."""
    least = np.full(COORDINATES, _ALL, np.uint64)
    for i in range(0, len(s), 2048):
        least = np.minimum(least, ((s[None, i : i + 2048] ^ _XOR) * _TIMES).min(axis=1))
    return least


_PARSED = "doc_id bigint, n_shingles bigint, digest binary, roots binary, branches binary, sketch binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out: list[tuple] = []
        for t in utf8(b.column(1)):
            words = words_of(t)
            if not words:
                out.append((0, None, None, None, None))
                continue
            s = shingles(words)
            sig = signature(s)
            out.append((len(s), digest_of(words), sig[:TREES].tobytes(), (sig[TREES:] >> np.uint64(32)).astype(np.uint32).tobytes(), (sig >> np.uint64(40)).astype(np.uint8).tobytes()))
        columns = [b.column(0)] + [pa.array([r[k] for r in out], pa.int64() if k == 0 else pa.binary()) for k in range(5)]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _PARSED.split(", ")])


def forest(n: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int]]:
    """Candidate links that connect a node's vertices as all its candidate links would."""
    part, out = np.arange(len(n)), []
    for i in range(len(n) - 1):
        other = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
        if not len(other):
            continue
        other = other[(100 * np.minimum(n[other], n[i]) >= PERCENT * np.maximum(n[other], n[i]))]
        other = other[(sketch[other] == sketch[i]).sum(axis=1) >= LEAST_EQUAL]
        if len(other):
            parts, first = np.unique(part[other], return_index=True)
            out += [(i, int(other[j])) for j in first]
            part[np.isin(part, parts)] = part[i]
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups out of sorted batches: a table with many groups each time."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        same = np.ones(b.num_rows, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            same &= v == v[-1]
        last = int(b.num_rows - np.argmin(same[::-1])) if not same.all() else 0
        begin = rest and all(rest[0].column(k)[0].as_py() == b.column(k)[0].as_py() for k in keys)
        if rest and not begin:
            yield pa.Table.from_batches(rest)
            rest = []
        if last:
            yield pa.Table.from_batches([*rest, b.slice(0, last)])
            rest = []
        rest.append(b.slice(last))
    if rest:
        yield pa.Table.from_batches(rest)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        new[1:] = False
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches, ["node"]):
        vid, n = t.column("vid").to_numpy(), t.column("n_shingles").to_numpy()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        at = _starts(t, ["node"])
        sizes = np.diff(at)
        a = at[:-1][sizes == 2]  # most nodes hold two
        b = a + 1
        fits = (100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b])) & ((sketch[a] == sketch[b]).sum(axis=1) >= LEAST_EQUAL)
        left, right = [vid[a[fits]]], [vid[b[fits]]]
        for k in np.flatnonzero(sizes > 2):
            s, e = at[k], at[k + 1]
            links = forest(n[s:e], sketch[s:e])
            if links:
                x = np.array(links) + s
                left.append(vid[x[:, 0]])
                right.append(vid[x[:, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def linked(a: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which of the sets are true links of the set ``a``; none is empty."""
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    both = np.add.reduceat((a[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * both >= PERCENT * (sizes + len(a) - both)


def decide(sets: list[np.ndarray], sketch: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """The parts into which true links connect the sets; a pair already in one part isn't decided again.

    ``known`` are the parts that are connected to begin with.
    """
    k = len(sets)
    n = np.array([len(s) for s in sets])
    part = np.arange(k) if known is None else np.unique(known, return_inverse=True)[1].astype(np.int64)
    # a pair has an end outside the largest part, or is in it already
    outside = np.flatnonzero(part != np.bincount(part).argmax())
    met = np.zeros(k, bool)
    for i in outside:
        met[i] = True
        other = np.flatnonzero((part != part[i]) & ~met)
        other = other[(100 * np.minimum(n[other], n[i]) >= PERCENT * np.maximum(n[other], n[i]))]
        other = other[(sketch[other] == sketch[i]).sum(axis=1) >= LEAST_EQUAL]
        for c in range(0, len(other), 256):
            some = other[c : c + 256]
            true = some[linked(sets[i], [sets[j] for j in some])]
            if len(true):
                part[np.isin(part, np.unique(part[true]))] = part[i]
    return part


_DECIDED = "vid bigint, root bigint, root_id bigint, last boolean"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups are streamed, so that only one group's sets are held at a time."""
    key, rows = None, {}

    def done() -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        own = sorted(rows.values(), key=lambda r: (r[1], r[0]))  # by the smallest document
        part = decide([r[2] for r in own], np.frombuffer(b"".join(r[3] for r in own), np.uint8).reshape(-1, COORDINATES), np.array([r[5] for r in own]))
        parts, first = np.unique(part, return_index=True)
        root = dict(zip(parts.tolist(), first.tolist(), strict=True))
        to = [own[root[p]] for p in part.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.int64()), pa.array([r[0] for r in to], pa.int64()), pa.array([r[1] for r in to], pa.int64()), pa.array([r[4] == 1 for r in own], pa.bool_())], names=["vid", "root", "root_id", "last"])

    for b in slices(batches):
        columns = [b.column(c).to_pylist() for c in ("label", "low", "high", "vid", "rep_id", "digest", "sketch", "blocks", "part")]
        texts = utf8(b.column("text"))
        for i, (label, low, high, vid, rep, digest, sketch, blocks, part) in enumerate(zip(*columns, strict=True)):
            if (label, low, high) != key:
                if (out := done()) is not None:
                    yield out
                key, rows = (label, low, high), {}
            if vid not in rows:
                words = words_of(texts[i])
                if digest_of(words) == digest:  # an id may repeat with another text
                    rows[vid] = (vid, rep, shingles(words), sketch, blocks, part)
    if (out := done()) is not None:
        yield out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The true links of hubs: a group is a hub's text and then, one after the other, those that may be linked with it."""
    key, hub = None, None
    for b in slices(batches):
        columns = [b.column(c).to_pylist() for c in ("hub", "chunk", "vid", "spoke", "digest")]
        out, texts = [], utf8(b.column("text"))
        for i, (own, chunk, vid, spoke, digest) in enumerate(zip(*columns, strict=True)):
            if (own, chunk) != key:
                key, hub = (own, chunk), None
            words = words_of(texts[i])
            if (spoke and hub is None) or digest_of(words) != digest:
                continue
            s = shingles(words)
            if not spoke:
                hub = s
            elif linked(hub, [s])[0]:
                out.append((vid, own))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges a-b and the smallest vertex of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if whole:
        ids, labels = joined(np.concatenate([x for x, _ in whole]), np.concatenate([y for _, y in whole]))
        for i in range(0, len(ids), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 50_000]), pa.array(labels[i : i + 50_000])], names=["vid", "label"])


def components(work: WorkTables, edges: DataFrame, at_once: int = 2_000_000) -> DataFrame:
    """(vid, label) of every vertex that has an edge (a, b): label is its component's smallest vertex.

    ``edges`` is a written table. Up to ``at_once`` edges, 32 MB, are one task's work; more are joined by
    large-star and small-star steps in turn, each an aggregate and a join, until nothing changes.
    """
    if edges.count() <= at_once:
        return map_arrow(edges.repartition(1), _join_all, "vid bigint, label bigint")
    e = work.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = work.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        before, e = e, work.keep(small.distinct(), "small")
        work.drop(before, large)
        was, mark = mark, _mark(e)
        if was == mark:
            break
    return e.select(F.col("u").alias("vid"), F.col("v").alias("label")).unionAll(e.select(F.col("v").alias("vid"), F.col("v").alias("label")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30))), F.lit(0))).first())


def _candidates(work: WorkTables, reps: DataFrame, small: int, dense: float, most_levels: int) -> DataFrame:
    """Edges (a, b) of the candidate forest, by the trees."""
    spark = work.spark
    token = lambda c, k, size: F.substring(F.col(c), k * size + 1, size)
    roots = F.explode(F.array(*[F.xxhash64(F.lit(t), token("roots", t, 8)) for t in range(TREES)]))
    rows = reps.select(roots.alias("node"), "vid", F.lit(1 << 62).alias("parent_n"))
    edges = None
    for level in range(most_levels + 1):
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
        sized = work.keep(rows.join(counts, "node"), f"level{level}")
        little = sized.where(F.col("cnt") <= small).select("node", "vid").join(reps.select("vid", "n_shingles", "sketch"), "vid")
        found = map_arrow(little.repartition("node").sortWithinPartitions("node", "vid"), _compare, "a bigint, b bigint")
        big = sized.where(F.col("cnt") > small)
        if big.isEmpty():
            big = None
        else:
            alike = F.lit(level == most_levels) | (F.col("cnt") >= dense * F.col("parent_n"))
            whole = big.where(alike)
            pivots = whole.groupBy("node").agg(F.min("vid").alias("pivot"))
            found = found.unionAll(whole.join(pivots, "node").where("vid <> pivot").select(F.col("vid").alias("a"), F.col("pivot").alias("b")))
            big = big.where(~alike)
        found = work.keep(found, "found")
        edges = found if edges is None else edges.unionAll(found)
        if big is None or big.isEmpty():
            break
        pick = lambda j: F.pmod(F.xxhash64("node", F.lit(j)), F.lit(BRANCHES)).cast("int") * 4 + 1
        child = lambda j: F.xxhash64("node", F.lit(j), F.substring(F.col("branches"), pick(j), F.lit(4)))
        rows = big.join(reps.select("vid", "branches"), "vid").select(F.explode(F.array(*[child(j) for j in range(FAN)])).alias("node"), "vid", F.col("cnt").alias("parent_n"))
    return edges if edges is not None else spark.createDataFrame([], "a bigint, b bigint")


#: What a row of ``members`` takes when it is broadcast, at most: three numbers, a digest, a sketch, and their table.
_MEMBER_BYTES = 250


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Each document's component: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= 75 * union of their sets. A component's id is
    its smallest doc_id, whose document is kept. A null text, or one without words, has an empty set
    and is linked with nothing; an empty table gives an empty result. A row with a null id takes no part: its component is null and it is
    kept. Rows that repeat an id get a row each; rows with equal id and text are one document. Texts are read
    whole: a long one is hashed in parts, which changes nothing. No other column is read, so none clashes.

    ``how``: ``small`` (4096), the vertices of a node that is compared exhaustively; ``dense`` (0.6), the
    share of its parent's vertices from which a node is joined as a whole; ``most_levels`` (40) of branching, below which nodes are
    joined as a whole too; ``block_shingles`` (1.5 million), what a task holds of a component, twice;
    ``broadcast_bytes`` (64 MB), up to which the members of components go to the texts and not the other way.
    """
    return _judged(docs, id_col, text_col, **how).drop("digest", "stands")


def _contracted(work: WorkTables, edges: DataFrame, large: DataFrame, texts, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """True links (a, b) that connect much of the large components, and the tasks for what they leave open.

    ``texts`` joins rows with a ``rep_id`` with their texts.
    """
    spark = work.spark
    own = large.select("vid")
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(own, F.col("a") == own["vid"], "left_semi").distinct()
    both = work.keep(both, "large-edges")
    degree = both.groupBy("b").agg(F.count(F.lit(1)).alias("links"))
    hubs = both.join(degree, "b").groupBy(F.col("a").alias("vid")).agg(F.max_by("b", F.struct("links", -F.col("b"))).alias("hub"))
    spokes = large.select("vid", "rep_id", "digest", "n_shingles").join(hubs, "vid")
    chunks = spokes.groupBy("hub").agg(F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("chunks"))
    spokes = spokes.join(chunks, "hub").select("hub", F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int").alias("chunk"), "vid", F.lit(True).alias("spoke"), "rep_id", "digest")
    centers = chunks.join(large.select(F.col("vid").alias("hub"), "rep_id", "digest"), "hub")
    centers = centers.select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("hub").alias("vid"), F.lit(False).alias("spoke"), "rep_id", "digest")
    asked = texts(work.keep(spokes.unionByName(centers), "spokes"))
    keys = ["hub", "chunk"]
    true = map_arrow(asked.select(*keys, "vid", "spoke", "digest", "text").repartition(*keys).sortWithinPartitions(*keys, "spoke"), _verify, "a bigint, b bigint")
    true = work.keep(true, "verified")
    parts = components(work, true).select("vid", F.col("label").alias("part"))
    m = work.keep(large.join(parts, "vid", "left").withColumn("part", F.coalesce("part", "vid")), "parted")
    sizes = m.groupBy("label", "part").agg(F.sum("n_shingles").alias("n"))
    whole = sizes.groupBy("label").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    count = lambda n: F.greatest(F.ceil(n / block_shingles), F.lit(1)).cast("int")
    whole = whole.select("label", "largest", count(F.col("all") - F.col("most")).alias("rest_blocks"), count(F.col("most")).alias("largest_blocks"))
    m = m.join(whole, "label")
    inside = F.col("part") == F.col("largest")
    place = F.xxhash64("vid")
    block = F.when(inside, F.col("rest_blocks") + F.pmod(place, F.col("largest_blocks"))).otherwise(F.pmod(place, F.col("rest_blocks"))).cast("int")
    partners = F.when(inside, F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("largest_blocks"))
    return true, m.select("label", "vid", "rep_id", "digest", "sketch", F.lit(0).alias("blocks"), "part", block.alias("block"), F.explode(F.sequence(F.lit(0), partners - 1)).alias("with"))


def _judged(docs: DataFrame, id_col: str, text_col: str, small: int = 4096, dense: float = 0.6, most_levels: int = 40, block_shingles: int = 1_500_000, broadcast_bytes: int = 64_000_000) -> DataFrame:
    """``near_duplicates`` with the digest of a row's words, and whether these words with this id stand for their component."""
    spark = docs.sparkSession
    work = WorkTables(spark, "neardup")
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parsed = work.keep(map_arrow(source, _parse, _PARSED), "parsed")
    # one row for each digest: equal digests have equal sets, and the smallest document stands for them
    best = F.min(F.struct("doc_id", "n_shingles", "roots", "branches", "sketch")).alias("r")
    reps = parsed.where("doc_id is not null and n_shingles > 0").groupBy("digest").agg(best)
    reps = reps.select("digest", F.col("r.doc_id").alias("rep_id"), "r.n_shingles", "r.roots", "r.branches", "r.sketch", F.monotonically_increasing_id().alias("vid"))
    reps = work.keep(reps, "reps")
    edges = _candidates(work, reps, small, dense, most_levels)
    labels = work.keep(components(work, edges), "labels")
    members = labels.join(reps.select("vid", "rep_id", "digest", "n_shingles", "sketch"), "vid")
    total = members.groupBy("label").agg(F.sum("n_shingles").alias("total"))
    members = work.keep(members.join(total, "label"), "members")

    def texts(rows: DataFrame) -> DataFrame:
        """Rows with the text of their ``rep_id``; of rows that repeat an id, the reader takes those with the right digest."""
        side = F.broadcast(rows) if rows.count() * _MEMBER_BYTES <= broadcast_bytes else rows
        return source.join(side, source["doc_id"] == side["rep_id"])

    large = members.where(F.col("total") > block_shingles)
    several = not large.isEmpty()
    little = members.where(F.col("total") <= block_shingles)
    # a small component is one task, whose decisions are the last
    tasks = little.select("label", "vid", "rep_id", "digest", "sketch", F.lit(1).alias("blocks"), F.col("vid").alias("part"), F.lit(0).alias("block"), F.lit(0).alias("with"))
    if several:
        true, more = _contracted(work, edges, large, texts, block_shingles)
        tasks = tasks.unionByName(more)
    asked = texts(work.keep(tasks, "tasks"))
    tasks = asked.select("label", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "vid", "rep_id", "digest", "sketch", "blocks", "part", "text")
    keys = ["label", "low", "high"]
    decided = work.keep(map_arrow(tasks.repartition(*keys).sortWithinPartitions(*keys), _decide, _DECIDED), "decided")
    final = decided.where("last").select("vid", "root", F.col("root_id").alias("component"))
    if several:
        cut = decided.where("not last").select(F.col("vid").alias("a"), F.col("root").alias("b")).unionAll(true).where("a <> b")
        whole = components(work, work.keep(cut, "links")).join(reps.select("vid", "rep_id"), "vid")
        least = whole.groupBy("label").agg(F.min(F.struct("rep_id", "vid")).alias("least")).select("label", F.col("least.vid").alias("root"), F.col("least.rep_id").alias("component"))
        final = final.unionAll(whole.join(least, "label").select("vid", "root", "component"))
    final = work.keep(final, "final")
    work.keep_only(parsed, reps, final)
    found = reps.select("digest", "vid", "rep_id").join(final, "vid", "left").select("digest", F.coalesce("component", "rep_id").alias("component"), F.coalesce(F.col("root") == F.col("vid"), F.lit(True)).alias("first"))
    out = parsed.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "digest", (kept & F.coalesce("first", F.lit(True))).alias("stands"))


#: What an id takes when it is broadcast, at most.
_MARKED_BYTES = 64
_DIGEST = T.StructType([T.StructField("digest", T.BinaryType())])


def _digests():
    def f(text: pa.Array) -> list[tuple]:
        words = (words_of(t) for t in utf8(text))
        return [(digest_of(w) if w else b"",) for w in words]

    return f


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 64_000_000, **how) -> DataFrame:
    """One document of each component, that with the smallest id, with its own columns.

    Rows that repeat an id are decided by id and words each: of those with equal id and words one row
    stays, if any does, and of near copies with one id too; which row is left open. Rows with a null id all stay, and so
    does a null text or one without words; of rows that repeat an id with such texts, one stays. An empty table gives an empty one.
    ``how`` goes to ``near_duplicates``.
    """
    work = WorkTables(docs.sparkSession, "neardup-drop")
    own, kept_id = F.col(f"`{id_col}`").cast("bigint"), fresh_name(docs.columns, "kept_id")
    kept_digest = fresh_name([*docs.columns, kept_id], "kept_digest")
    judged = _judged(docs, id_col, text_col, **how).where("doc_id is not null")
    judged = work.keep(judged.select(F.col("doc_id").alias(kept_id), F.coalesce("digest", F.lit(b"")).alias(kept_digest), "stands"), "judged")
    by_id = judged.groupBy(kept_id).agg(F.count(F.lit(1)).alias("n"), F.count_if("stands").alias("n_kept"))
    marked = work.keep(by_id.where("n > 1 or n_kept = 0").select(kept_id, (F.col("n_kept") > 0).alias("some")), "marked")
    side = marked.select(kept_id)
    side = F.broadcast(side) if marked.count() * _MARKED_BYTES <= broadcast_bytes else side
    plain = docs.join(side, own == F.col(kept_id), "left_anti")
    some = marked.where("some").select(kept_id)
    if some.isEmpty():
        return plain
    found, name = append_struct(docs.join(some, own == F.col(kept_id), "left_semi"), [text_col], _digests, _DIGEST, "words")
    pairs = judged.where("stands").join(some, kept_id, "left_semi").select(kept_id, kept_digest).distinct()
    again = found.join(pairs, (own == F.col(kept_id)) & (F.col(f"`{name}`.digest") == F.col(kept_digest))).dropDuplicates([kept_id, kept_digest])
    return plain.unionByName(again.select(*[F.col(f"`{c}`") for c in docs.columns]))
