"""URL rules by a bit-parallel wildcard automaton.

A rule is a glob over the canonical URL, which is the host behind a dot, a separator that no URL
holds, and the path. All rules' positions are packed into 64-bit words, multiword Shift-And style;
one step for each character advances every rule over a whole batch of URLs at once. A ``*`` inside
or before a rule keeps its position alive (a self-loop); a rule's end may stand anywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import append_struct, fresh_name

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The separator of host and path: no byte value, so no text can hold it.
SEPARATOR = 256


@dataclass(frozen=True)
class Rule:
    """``host`` fits itself and its subdomains; ``path`` is a prefix, in which ``*`` is any text."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Automaton:
    """All rules at once; the first of ``rules`` in order of length, then of host length, wins."""

    def __init__(self, rules: list[Rule]):
        self.rules = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name, r.verdict))
        symbols: list[tuple[int, bool, bool]] = []  # symbol, whether a * stands before it, whether it begins a rule
        ends: list[int] = []
        for r in self.rules:
            begin, star = True, True  # any subdomain may stand before the host's own dot
            for s in [*f".{r.host}".encode(), SEPARATOR, *r.path.encode()]:
                if s == ord("*"):
                    star = True
                else:
                    symbols.append((s, star, begin))
                    begin = star = False
            ends.append(len(symbols) - 1)
        self.n_words = max(1, -(-len(symbols) // 64))
        z = lambda *n: np.zeros((*n, self.n_words), dtype=np.uint64)
        self.fits, self.first, self.stay, self.final = z(257), z(), z(), z()
        for k, (s, star, begin) in enumerate(symbols):
            w, bit = k // 64, np.uint64(1 << (k % 64))
            self.fits[s, w] |= bit
            if begin:
                self.first[w] |= bit
            elif star:  # the position before it may wait
                p = k - 1
                self.stay[p // 64] |= np.uint64(1 << (p % 64))
        for k in ends:
            self.final[k // 64] |= np.uint64(1 << (k % 64))
        self.ends = ends

    def best(self, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        """For each URL the number of its best rule, or -1."""
        n = len(hosts)
        best = np.full(n, -1, dtype=np.int64)
        if not n or not self.rules:
            return best
        urls = [np.frombuffer(b"." + h, np.uint8).astype(np.uint16).tolist() + [SEPARATOR] + list(p) for h, p in zip(hosts, paths, strict=True)]
        order = np.argsort([-len(u) for u in urls], kind="stable")
        lengths = np.array([len(urls[i]) for i in order])
        state = np.zeros((n, self.n_words), dtype=np.uint64)
        seen = np.zeros((n, self.n_words), dtype=np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for t in range(int(lengths[0])):
            while live and lengths[live - 1] <= t:  # shorter URLs have ended
                live -= 1
            d = state[:live]
            column = np.fromiter((urls[i][t] for i in order[:live]), dtype=np.int64, count=live)
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved |= self.first
            state[:live] = (moved & self.fits[column]) | (d & self.stay)
            seen[:live] |= state[:live] & self.final
        for rank in range(len(self.rules) - 1, -1, -1):
            k = self.ends[rank]
            hit = (seen[:, k // 64] >> np.uint64(k % 64)) & one != 0
            best[order[hit]] = rank
        return best


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: both empty if it is null or has no ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.substring(url, at + 3, F.char_length(url))
    authority = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, F.translate(authority, _UPPER, _LOWER)).otherwise(""), F.when(at > 0, path).otherwise("")


_RESULT = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def _judge(rules: list[Rule], default: str, at_once: int) -> Callable:
    def make() -> Callable:
        auto = Automaton(rules)

        def f(host, path) -> list[tuple]:
            hosts = [(x or "").encode() for x in host.to_pylist()]
            paths = [(x or "").encode() for x in path.to_pylist()]
            out: list[tuple] = []
            for i in range(0, len(hosts), at_once):
                for k in auto.best(hosts[i : i + at_once], paths[i : i + at_once]):
                    out.append((None, default) if k < 0 else (auto.rules[k].name, auto.rules[k].verdict))
            return out

        return f

    return make


def judge(pages: DataFrame, rules: list[Rule], *, url_col: str = "url", default: str = "allow", at_once: int = 2048) -> tuple[DataFrame, str]:
    """``pages`` with a struct column (host, path, rule, verdict), and that column's name.

    The longest rule that fits decides; without one the verdict is ``default`` and the rule null. A
    null URL, or one without ``://``, has an empty host and path and fits no rule. Rules that repeat
    count once; of rules that fit and are as long, the one with the longer host decides, then the last by name and verdict. Rows that repeat are judged
    each; URLs are read whole, however long; an empty table gives an empty one.
    """
    columns = pages.columns
    h, p = fresh_name(columns, "host"), fresh_name(columns, "path")
    host, path = canonical(F.col(f"`{url_col}`").cast("string"))
    found, got = append_struct(pages.withColumn(h, host).withColumn(p, path), [h, p], _judge(sorted(set(rules), key=lambda r: (r.name, r.verdict)), default, at_once), _RESULT, "judged")
    name = fresh_name(found.columns, "filter")
    made = F.struct(F.col(f"`{h}`").alias("host"), F.col(f"`{p}`").alias("path"), F.col(f"`{got}`.rule").alias("rule"), F.col(f"`{got}`.verdict").alias("verdict"))
    return found.select(*[F.col(f"`{c}`") for c in columns], made.alias(name)), name
