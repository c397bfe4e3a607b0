"""Glossary terms in texts: longest first, never overlapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import MARK

#: Terms are a literal of the plan; larger glossaries should be split by subject.
MOST_TERMS = 10_000


def relevant(texts: Column, terms: list[tuple[str, str]]) -> Column:
    """(source, target) pairs of the terms found in an array of texts, longest first.

    A fold over the terms: a term's hits are blanked by marks of the same length, so
    shorter terms can't hit inside them.
    """
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    last = dict(terms)
    ordered = sorted(((k, v) for k, v in last.items() if k), key=lambda x: -len(x[0]))
    kind = "array<struct<source: string, target: string>>"
    if not ordered:
        return F.array().cast(kind)
    table = F.array(*[F.struct(F.lit(k).alias("source"), F.lit(v).alias("target"), F.lit(MARK * len(k)).alias("blank")) for k, v in ordered])
    zero = F.struct(F.array_join(texts, MARK + MARK).alias("text"), F.array().cast(kind).alias("out"))

    def step(a: Column, t: Column) -> Column:
        hit = F.struct(F.replace(a["text"], t["source"], t["blank"]).alias("text"), F.array_append(a["out"], F.struct(t["source"].alias("source"), t["target"].alias("target"))).alias("out"))
        return F.when(F.contains(a["text"], t["source"]), hit).otherwise(a)

    return F.aggregate(table, zero, step, lambda a: a["out"])


def written(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["source"], F.lit("→"), p["target"])), ", ")
