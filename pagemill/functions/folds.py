"""Folds over an array whose steps depend on every earlier one, linear in the array's length.

Spark's ``aggregate`` copies what it accumulates at each step; an output for each item would make it
quadratic. So items are folded in blocks, and a finished block's outputs are carried as one value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import bound

BLOCK = 256


def scan(items: Column, start: Column, decide: Callable[[Column, Column], Column], advance: Callable[[Column, Column, Column], Column], result: str) -> Column:
    """Array of ``decide(state, item)`` for each item; ``advance(state, item, decision)`` is the next state.

    ``start`` has the type that ``advance`` gives; ``result`` is the type of a decision.
    """
    none, of_blocks = F.array().cast(f"array<{result}>"), F.array().cast(f"array<array<{result}>>")

    def one(acc: Column, x: Column) -> Column:
        return bound(decide(acc["state"], x), lambda d: F.struct(advance(acc["state"], x, d).alias("state"), F.array_append(acc["out"], d).alias("out")))

    def block(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bound(inner, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / BLOCK), F.lit(0)).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
        return F.aggregate(blocks, F.struct(start.alias("state"), of_blocks.alias("out")), block, lambda acc: F.flatten(acc["out"]))

    return bound(items, whole)


def joined_runs(pieces: Column, begins: Column, by: str) -> Column:
    """Array of the runs of ``pieces``, each joined by ``by``; a run starts at the first piece and wherever ``begins`` is true."""

    def runs(x: Column) -> Column:
        places = F.filter(F.transform(x["begins"], lambda b, i: F.when(b | (i == 0), i + 1)), lambda i: i.isNotNull())
        until = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(x["pieces"]) + 1)
        return bound(places, lambda at: F.transform(at, lambda i, k: F.array_join(F.slice(x["pieces"], i, until(at, k) - i), by)))

    return bound(F.struct(pieces.alias("pieces"), begins.alias("begins")), runs)
