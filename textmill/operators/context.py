"""Titles, headings and neighbours of each segment, in document order; windows over one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.config import Settings
from textmill.functions import text as T


def _optional(df: DataFrame, name: str) -> Column:
    return T.strip(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in df.columns else F.lit("")


def nearest_other(value: Column, order: list[Column], key: str, payload: Column) -> Column:
    """Payload of the nearest row before in ``order`` whose value is known and not this row's own.

    Runs of equal values are crossed at once: a run's first row sees the row before it, and the others
    carry that on.  ``payload`` must be a struct; a null value sees the nearest known one.
    """
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(value.isNotNull(), F.struct(value.alias("v"), payload.alias("p"))), ignorenulls=True).over(before)


def _with_nearest(df: DataFrame, name: str, value: str, order: list[Column], key: str, payload: list[str]) -> DataFrame:
    seen = f"__seen_{name}"
    df = df.withColumn(seen, nearest_other(F.col(value), order, key, F.struct(*payload)))
    fresh = F.col(value).isNotNull() & (F.col(f"{seen}.v").isNull() | (F.col(f"{seen}.v") != F.col(value)))
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(fresh, F.struct(F.col(f"{seen}.p").alias("p"))), ignorenulls=True).over(upto)["p"]
    return df.withColumn(name, F.when(F.col(value).isNull(), F.col(f"{seen}.p")).otherwise(carried)).drop(seen)


def contexts(segments: DataFrame, s: Settings = Settings(), key: str = "doc_id", order: str = "id") -> DataFrame:
    """Adds document_title, section_title, previous_text and next_text (null if absent), each cut to size.

    Neighbours are the nearest segments with another, non-empty text; the search ends at a segment
    of another section where both sections are known.
    """
    n = s.bounded().context_chars
    rows = segments.withColumn("__text", T.soft_wraps(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("__said", F.nullif("__text", F.lit(""))).withColumn("__sec", F.nullif(F.coalesce("section_id", F.lit("")), F.lit(""))).withColumn("__at", F.col(order))
    whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when((F.col("type") == "heading"), F.col("__said"))
    explicit = F.nullif(_optional(segments, "document_title"), F.lit(""))
    rows = rows.withColumn("__title", F.first(F.coalesce(explicit, heading), ignorenulls=True).over(whole))
    own = F.coalesce(F.nullif(_optional(segments, "section_title"), F.lit("")), F.nullif(_optional(segments, "heading"), F.lit("")))
    rows = rows.withColumn("__head", F.coalesce(own, F.last(heading, ignorenulls=True).over(upto)))
    for side, direction in (("previous", [F.col(order)]), ("next", [F.col(order).desc()])):
        rows = _with_nearest(rows, f"__{side}", "__said", direction, key, ["__at", "__said"])
        rows = _with_nearest(rows, f"__{side}_sec", "__sec", direction, key, ["__at"])
        near, other = F.col(f"__{side}.__at"), F.col(f"__{side}_sec.__at")
        open_ = F.col("__sec").isNull() | other.isNull() | ((other < near) if side == "previous" else (other > near))
        rows = rows.withColumn(f"{side}_text", F.substring(F.when(open_, F.col(f"__{side}.__said")), 1, n))
    rows = rows.withColumn("document_title", F.substring("__title", 1, n))
    rows = rows.withColumn("section_title", F.substring(F.when(F.col("__head") != F.col("__text"), F.col("__head")), 1, n))
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def context_json(s: Settings = Settings()) -> Column:
    """A segment's context as one JSON object; absent parts are left out."""
    return F.to_json(F.struct("document_title", "next_text", "previous_text", F.coalesce("section_id", F.lit("")).alias("section_id"), "section_title", "table_idx", F.coalesce("type", F.lit("paragraph")).alias("type")))


def heading_lookup(segments: DataFrame) -> DataFrame:
    """(doc_id, key, target): the first heading's translation for each cleaned heading."""
    rows = segments.where("type = 'heading'").withColumn("key", T.heading_key(F.col("text"))).where("key <> ''")
    return rows.groupBy("doc_id", "key").agg(F.min_by(F.coalesce(F.nullif("ru", F.lit("")), F.col("text")), "id").alias("target"))


def translate_toc(toc: DataFrame, lookup: DataFrame) -> DataFrame:
    """Contents entries with ``target``: the heading's translation, else the title."""
    first, second = T.toc_keys(F.col("title"))
    one = lookup.select("doc_id", F.col("key").alias("k1"), F.col("target").alias("t1"))
    two = lookup.select("doc_id", F.col("key").alias("k2"), F.col("target").alias("t2"))
    rows = toc.withColumn("k1", first).withColumn("k2", second).join(one, ["doc_id", "k1"], "left").join(two, ["doc_id", "k2"], "left")
    found = F.coalesce(F.nullif("t1", F.lit("")), F.nullif("t2", F.lit("")), F.col("title"))
    return rows.withColumn("target", found).drop("k1", "k2", "t1", "t2")
