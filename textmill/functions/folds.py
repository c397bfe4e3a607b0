"""Folds over arrays that keep every intermediate state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """States of a fold after each item, as an array of DDL type ``kind``.

    Appending to one array costs its length each time; states are gathered in blocks
    first, so an array of a hundred thousand items stays affordable.
    """

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def fold(block: Column, state: Column) -> Column:
        none = F.array().cast(f"array<{kind}>")
        add = lambda a, x: let(step(a["state"], x), lambda s: F.struct(s.alias("state"), F.array_append(a["out"], s).alias("out")))
        return F.aggregate(block, F.struct(state.cast(kind).alias("state"), none.alias("out")), add)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    first = F.struct(zero.cast(kind).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    join = lambda acc, b: let(fold(b, acc["state"]), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(blocks, first, join)["out"])).otherwise(F.array().cast(f"array<{kind}>"))
