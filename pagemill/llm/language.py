"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's letters, lower-cased, form words; everything else is a blank. Its subwords are all runs of
two, three and four characters (blanks at word ends included), hashed into 2 ** ``BITS`` rows of an
embedding table. The text's vector is the mean of its subwords' embeddings; a linear softmax gives a
probability for each language. Both tables are trained in numpy by stochastic gradient descent on a
bounded sample of labelled rows. A part of the sample is held back to fit the softmax's temperature
and the confidence under which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import append_struct

BITS = 15
ROWS = 1 << BITS
SIZES = (2, 3, 4)
#: Characters that are worked on at once.
CHUNK = 400_000
_P, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points; everything else is 0, and a 0 stands at either end."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letter_table()[c], c, np.uint32(0))


def subwords(c: np.ndarray) -> Iterator[np.ndarray]:
    """For each size, the hashed rows of all runs; runs without a letter have row 0."""
    for n in SIZES:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        h = c[:m].copy()
        for j in range(1, n):
            h *= _P
            h += c[j : j + m]
        h *= _MIX
        yield (h >> np.uint32(32 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # (ROWS, languages): embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    reject_under: float

    def logits(self, text: str) -> np.ndarray | None:
        """None if the text has no letter. Texts are read whole, in chunks that overlap by a subword."""
        c = codes(text)
        if not c.any():
            return None
        total, n = np.zeros(len(self.languages), np.float64), 0
        step = CHUNK
        for a in range(0, len(c), step):
            for size, h in zip(SIZES, subwords(c[a : a + step + max(SIZES) - 1]), strict=False):
                h = h[: max(0, min(step, len(c) - a - size + 1))]
                h = h[h != 0]
                counts = np.bincount(h, minlength=ROWS) if len(h) > ROWS else None
                total += counts @ self.table if counts is not None else self.table[h].sum(axis=0, dtype=np.float64)
                n += len(h)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its probability, and whether that is too little to accept."""
        z = None if text is None or not self.languages else self.logits(text)
        if z is None:
            return "und", 0.0, True
        p = softmax(z / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.reject_under)


#: Learned from nothing: every text is ``und`` with score 0, and rejected.
NO_LANGUAGES = Model((), np.zeros((0, 0), np.float32), np.zeros(0), 1.0, 0.0)


class NothingToLearn(ValueError):
    """No labelled row, or none with a letter."""


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bags() -> Callable:
    def f(text) -> list[tuple]:
        out = []
        for t in text.to_pylist():
            bag = np.zeros(ROWS, np.int64)
            c = codes(t or "")
            for a in range(0, len(c), CHUNK):
                for size, h in zip(SIZES, subwords(c[a : a + CHUNK + max(SIZES) - 1]), strict=False):
                    bag += np.bincount(h[: max(0, min(CHUNK, len(c) - a - size + 1))], minlength=ROWS)
            bag[0] = 0
            at = np.flatnonzero(bag)
            out.append((at.astype("<i4").tobytes(), bag[at].astype("<i8").tobytes()))
        return out

    return f


#: Numbers as bytes: a list of Python integers takes several times the driver's memory.
_BAG = T.StructType([T.StructField("rows", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def fit(
    labelled: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    order_cols: tuple[str, ...] = ("doc_id",),
    per_language: int = 600,
    dim: int = 16,
    epochs: int = 6,
    rate: float = 1.5,
    false_rejects: float = 0.001,
    seed: int = 5,
) -> Model:
    """Train on at most about ``per_language`` rows of each label; every label is learned.

    The sample is drawn by a hash of ``order_cols``, which serve for nothing else. Executors turn each
    sampled text, whole, into counts of its subwords; a bag has ``ROWS`` entries at most, however long
    the text. Rows without a label are left out, and texts without a letter teach nothing; repeated rows are drawn
    together. Where no row is left, ``NothingToLearn`` is raised; ``NO_LANGUAGES`` is the model for that case.
    """
    rows = labelled.where(F.col(lang_col).isNotNull())
    n = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        raise NothingToLearn("no labelled rows to learn from")
    languages = tuple(sorted(n))
    draw = F.pmod(F.xxhash64(F.lit(seed), *order_cols), F.lit(1_000_000))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1_000_000, -(-per_language * 1_000_000 // n[k]))))])
    sample = rows.where(draw < F.coalesce(F.try_element_at(share, F.col(lang_col)), F.lit(0))).select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit(seed + 1), *order_cols).alias("o"), F.col(text_col).alias("text"))
    bagged, name = append_struct(sample, ["text"], _bags, _BAG, "bag")
    got = sorted(bagged.select("lang", "o", f"{name}.rows", f"{name}.counts").where(F.octet_length("rows") > 0).collect(), key=lambda r: (r["o"], r["lang"], bytes(r["rows"])))
    if not got:
        raise NothingToLearn("no labelled row has a letter")
    bags = [(np.frombuffer(r["rows"], "<i4"), np.cumsum(np.frombuffer(r["counts"], "<i8"), dtype=np.float64), languages.index(r["lang"])) for r in got]
    return train(bags, languages, dim=dim, epochs=epochs, rate=rate, false_rejects=false_rejects, seed=seed)


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], languages: tuple[str, ...], *, dim: int, epochs: int, rate: float, false_rejects: float, seed: int) -> Model:
    """Stochastic gradient descent over (rows, running counts, label); every tenth bag calibrates."""
    rng = np.random.default_rng(seed)
    back = [b for i, b in enumerate(bags) if i % 10 == 9] or bags
    own = [b for i, b in enumerate(bags) if i % 10 != 9] or bags
    k = len(languages)
    e = rng.uniform(-1 / dim, 1 / dim, (ROWS, dim)).astype(np.float32)
    w, bias = np.zeros((dim, k), np.float32), np.zeros(k, np.float32)
    steps, t = epochs * len(own), 0
    for _ in range(epochs):
        for i in rng.permutation(len(own)):
            at, upto, y = own[i]
            # a random part of the bag each time, short ones too: short texts are to be told as well
            m = int(rng.choice((12, 24, 60, 150, 300)))
            drawn = at[np.searchsorted(upto, rng.random(m) * upto[-1], side="right")]
            v = e[drawn].mean(axis=0)
            g = softmax(v @ w + bias)
            g[y] -= 1
            lr = np.float32(rate * (1 - t / steps))
            back_v = w @ g
            w -= lr * np.outer(v, g)
            bias -= lr * np.float32(0.1) * g
            np.subtract.at(e, drawn, (lr * back_v * (8.0 / m)).astype(np.float32))
            t += 1
    table = (e @ w).astype(np.float32)
    table[0] = 0
    z = np.array([np.average(table[at], axis=0, weights=np.diff(upto, prepend=0)) + bias for at, upto, _ in back])
    y = np.array([b[2] for b in back])
    best = min((1.0 * 1.15**j for j in range(-25, 26)), key=lambda s: -np.log(np.maximum(softmax(z / s)[np.arange(len(y)), y], 1e-12)).mean() + 1e-3 * abs(np.log(s)))
    sure = softmax(z / best).max(axis=1)
    # a text of a known language is to be rejected once in 1 / false_rejects at most; half a vote is always enough
    reject = min(0.5, float(np.quantile(sure, false_rejects)) - 1e-6)
    return Model(languages, table, bias.astype(np.float64), float(best), reject)


_RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column (lang, score, rejected), and that column's name.

    A text that is null, empty or has no letter is ``und`` with score 0, and rejected. Of languages that are as likely the
    first by name counts. Texts are read whole, however long; nothing else is read, and rows that repeat are judged each,
    alike. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS x languages floats

    def make() -> Callable:
        own = shared.value

        def f(text: pa.Array) -> list[tuple]:
            return [own.predict(t) for t in text.to_pylist()]

        return f

    return append_struct(docs, [text_col], make, _RESULT, "language")


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether a row is kept from training, by its id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
