"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases a text, turns homoglyphs and digits that stand for letters into those letters,
and everything that is no letter into a blank. Lexicon entries stand at the beginning of a word: an
entry is a whole word or a prefix. All entries and their weights are learned from labelled rows: words and
prefixes that many toxic rows and almost no others hold. Exception phrases are two words, one of
which an entry fits, that clean rows hold and toxic ones don't; they take their words out of the
count. The weighted hits, by themselves and for each hundred words, go into a logistic curve that is
fitted on the same rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import WorkTables, append_struct, map_arrow, slices

#: Digits and signs that stand for letters.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
#: Cyrillic, Greek and other letters that look like Latin ones, lower case.
_HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "τ": "t", "κ": "k", "χ": "x", "ɡ": "g", "ı": "i", "ⅼ": "l", "ⅰ": "i", "ℓ": "l",
}
#: Characters of a folded word that an entry may have at most.
LONGEST = 24
SHORTEST = 4
LONGEST_PREFIX = 10

_fold = {ord(k): v for k, v in (_DIGITS | _HOMOGLYPHS).items()}
_fold |= {c: chr(c - 0xFEE0).lower() for c in range(0xFF21, 0xFF5B) if chr(c - 0xFEE0).isalpha()}  # full-width letters
_fold |= {c: chr((c - 0x1D400) % 26 + 97) for c in range(0x1D400, 0x1D4E8)}  # mathematical letters, the bold and italic rows
_fold |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # invisible characters
_ASCII = {c: _fold.get(c, chr(c) if chr(c).isalpha() else " ") for c in range(128)}
_fold |= _ASCII


def folded(text: str) -> list[str]:
    """The words of a text after folding."""
    return text.lower().translate(_fold).split()


@dataclass(frozen=True)
class Model:
    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]  # constant, by log of hits, by log of hits for each hundred words

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for e, weight in self.entries:
            found.add_word(f" {e}", (len(e), weight))
        for e in self.exceptions:
            found.add_word(f" {e} ", (len(e), 0.0))
        if len(found):
            found.make_automaton()
        return found


#: Learned from nothing: no entries, and the score of a text without hits.
NOTHING = Model((), (), (-2.0, 1.5, 1.0))


def weigh(found, text: str | None) -> tuple[float, float, int]:
    """Weighted hits, for each hundred words too, and the number of words. A word counts once, by its heaviest entry."""
    words = folded(text or "")
    if not words:
        return 0.0, 0.0, 0
    if not len(found):
        return 0.0, 0.0, len(words)
    line = f" {' '.join(words)} "
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, weight) in found.iter(line):
        if weight:
            start = end - n
            hits[start] = max(hits.get(start, 0.0), weight)
        else:
            spared.append((end - 1 - n, end))
    if spared:  # in order, and one where they overlap, so that one search finds what a word lies in
        spared = merged(spared)
        starts = [a for a, _ in spared]
        hits = {at: w for at, w in hits.items() if not ((k := bisect_right(starts, at)) and at < spared[k - 1][1])}
    total = sum(hits.values())
    return total, 100 * total / (len(words) + 20), len(words)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def phrases_of(found, words: list[str]) -> set[str]:
    """The pairs of neighbouring words of which an entry fits one."""
    line, out = f" {' '.join(words)} ", set()
    starts = np.cumsum([1] + [len(w) + 1 for w in words])
    for k in {int(np.searchsorted(starts, end - n + 1, side="right")) - 1 for end, (n, weight) in found.iter(line) if weight}:
        out.update(f"{words[i]} {words[i + 1]}" for i in (k - 1, k) if 0 <= i < len(words) - 1)
    return out


def features(hits: float, density: float) -> tuple[float, float]:
    return math.log1p(hits), math.log1p(density)


def entries_of(words: list[str]) -> set[str]:
    """The whole words of a text, marked by a blank behind, and their prefixes."""
    own = set(words)
    out = {f"{w} " for w in own if 3 <= len(w) <= LONGEST}
    for n in range(SHORTEST, LONGEST_PREFIX + 1):
        out.update(w[:n] for w in own if len(w) >= n)
    return out


def _count(what: Callable[[], Callable[[list[str]], set[str]]]):
    """How many clean and toxic texts hold each thing that ``what()`` finds in their words."""

    def run(batches):
        find, counts = what(), {}
        for b in slices(batches):
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for e in find(folded(text or "")):
                    counts.setdefault(e, [0, 0])[1 if toxic else 0] += 1
            if len(counts) > 300_000:
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    return run


def _phrases(shared) -> Callable:
    def what() -> Callable[[list[str]], set[str]]:
        found = shared.value.automaton()
        return lambda words: phrases_of(found, words)

    return what


def _counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
    values = list(counts.values())
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())], names=["entry", "clean", "toxic"])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = 6000,
    most_entries: int = 5000,
    most_phrases: int = 1000,
    least_share: float = 0.006,
    least_odds: float = 3.5,
    least_clean: int = 4,
    seed: int = 7,
) -> Model:
    """Learn the lexicon, its exceptions and the curve from at most about ``per_label`` rows of each label.

    The sample is drawn from the labels' ids by a hash, which serves for nothing else; so the join
    with the texts broadcasts twice ``per_label`` ids. Equal texts count once; an id with labels of
    both kinds counts as toxic. An entry is kept if at least ``least_share`` of the sample's toxic texts
    hold it (and 4 of them) and its log odds against the others are ``least_odds`` or more. A prefix
    gives way to a longer entry that nine tenths of its toxic texts hold; of a prefix that is kept,
    longer entries stay only with better odds. A phrase is an exception if ``least_clean`` clean texts hold it
    and no toxic one. Of more than ``most_entries`` or ``most_phrases`` those that most texts hold are kept. Without labelled texts of both
    kinds there is nothing to learn, and no text has a hit. Null labels and ids are left out.
    """
    spark = docs.sparkSession
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return NOTHING
    share = lambda k: min(1_000_000, -(-per_label * 1_000_000 // n[k]))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < F.when(F.col("toxic") > 0, share(1)).otherwise(share(0)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").select("text", "toxic").distinct()
    work = WorkTables(spark, "toxicity")
    sample = work.keep(texts, "sample")
    sized = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = sized.get(0, 0), sized.get(1, 0)
    if not n_clean or not n_toxic:
        work.drop_all()
        return NOTHING
    counted = lambda what: map_arrow(sample, _count(what), "entry string, clean bigint, toxic bigint").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (n_clean - F.col("clean") + 0.5))
    kept = counted(lambda: entries_of).where(F.col("toxic") >= max(4, math.ceil(least_share * n_toxic))).withColumn("odds", odds).where(F.col("odds") >= least_odds)
    found = {r["entry"]: (float(r["odds"]), int(r["toxic"])) for r in kept.orderBy(F.desc("toxic"), "entry").limit(most_entries).collect()}
    entries: dict[str, float] = {}
    covered = {e[:k] for e in found for k in range(SHORTEST, len(e)) if e[:k] in found and found[e][1] >= 0.9 * found[e[:k]][1]}
    for e in sorted(set(found) - covered, key=lambda e: (len(e), e)):
        shorter = [found[e[:k]][0] for k in range(SHORTEST, len(e)) if e[:k] in entries]
        if not shorter or found[e][0] > max(shorter) + 0.5:
            entries[e] = found[e][0]
    model = Model(tuple(sorted(entries.items())), (), NOTHING.curve)
    if entries:
        shared = spark.sparkContext.broadcast(model)
        harmless = counted(_phrases(shared)).where((F.col("toxic") == 0) & (F.col("clean") >= least_clean))
        model = Model(model.entries, tuple(sorted(r["entry"] for r in harmless.orderBy(F.desc("clean"), "entry").limit(most_phrases).collect())), NOTHING.curve)
        shared.destroy()
    shared = spark.sparkContext.broadcast(model)
    weighed, name = append_struct(sample, ["text"], _weigher(shared), _FEATURES, "weights")
    got = sorted((r["toxic"], r["hits"], r["density"]) for r in weighed.select("toxic", f"{name}.hits", f"{name}.density").collect())
    shared.destroy()
    work.drop_all()
    x = np.array([features(h, d) for _, h, d in got])
    y = np.array([float(t) for t, _, _ in got])
    # each label has as much weight as in all labelled rows
    weight = np.where(y > 0, n[1] / n_toxic, n[0] / n_clean)
    return Model(model.entries, model.exceptions, logistic(x, y, weight / weight.mean()))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, steps: int = 60) -> tuple[float, float, float]:
    """Newton's method with a ridge that keeps the slopes finite where the labels are separable."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    penalty = ridge * np.diag([0.1] + [1.0] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (weight * (p - y)) / len(y) + penalty @ b * 0.05
        h = (a.T * (weight * p * (1 - p))) @ a / len(y) + penalty * 0.05 + 1e-9 * np.eye(len(b))
        b = b - np.linalg.solve(h, g)
    return float(b[0]), max(0.0, float(b[1])), max(0.0, float(b[2]))


_FEATURES = T.StructType([T.StructField("hits", T.DoubleType()), T.StructField("density", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _weigher(shared) -> Callable:
    def make() -> Callable:
        model = shared.value
        found, (c, by_hits, by_density) = model.automaton(), model.curve

        def f(text: pa.Array) -> list[tuple]:
            out = []
            for t in text.to_pylist():
                hits, density, _ = weigh(found, t)
                a, b = features(hits, density)
                out.append((hits, density, 1 / (1 + math.exp(-max(-30.0, min(30.0, c + by_hits * a + by_density * b))))))
            return out

        return f

    return make


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column (hits, density, score), and that column's name.

    A null or empty text has no hits and the lowest score. Texts are read whole, however long; nothing else is read, and
    rows that repeat are scored each, alike. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # most_entries short strings at most
    return append_struct(docs, [text_col], _weigher(shared), _FEATURES, "toxicity")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
