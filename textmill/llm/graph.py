"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (partially aggregated before its shuffle) and an
equi-join, so a node with a third of all links is a hot join key that adaptive
execution splits, never a collected list.  Rounds are logarithmic in the longest
path; each is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.scratch import drop, stash


def _hang(pairs: DataFrame, lowest: DataFrame) -> DataFrame:
    """Links each far end of ``pairs`` (at, far) to the lowest node that ``at`` knows."""
    joined = pairs.join(lowest, "at")
    return joined.where(F.col("far") != F.col("low")).select(F.col("far").alias("u"), F.col("low").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("at"), F.col("v").alias("far")).unionAll(edges.select(F.col("v").alias("at"), F.col("u").alias("far")))
    lowest = both.groupBy("at").agg(F.least(F.min("far"), F.col("at")).alias("low"))
    return _hang(both.where("far > at"), lowest).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("at"), F.least("u", "v").alias("far"))
    lowest = down.groupBy("at").agg(F.min("far").alias("low"))
    self_ = lowest.select(F.col("at").alias("u"), F.col("low").alias("v"))
    return _hang(down, lowest).unionAll(self_).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of long nodes -> (node, root) for every linked node but the roots.

    ``root`` is the smallest node of the component.  No links: an empty table.
    """
    links = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = stash(links, "links"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, before = state, now
        now = stash(_small_star(_large_star(before)), "links")
        drop(before)
