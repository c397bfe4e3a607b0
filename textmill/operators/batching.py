"""Batches of rows for one request, and sequences that need the row before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.folds import running


#: Rows of one task that ``spread`` deals out.
ROWS = 1 << 13


def spread(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """The rows dealt by key to tasks of about ``ROWS``: a file of few bytes is read by few tasks, however many rows it holds and whatever is done to each."""
    return rows.repartition(max(1, -(-rows.count() // ROWS)), *keys)


def greedy_batches(rows: DataFrame, key: str, order: str, length: Column, max_items: int, max_chars: int) -> DataFrame:
    """Adds ``batch`` (from 0 for each key): a batch ends before the row that would overfill it.

    A fold over each key's lengths; only (order, length) pairs are gathered, not rows.  A key is a document, so these are
    bounded by one document's segments; batches of a whole table in order are ``chunks``, which go by ranges.
    """
    sized = rows.withColumn("__n", length.cast("long"))
    groups = sized.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__n").alias("n")))).alias("items"))
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("items"), F.lit(0).cast("long").alias("chars"))

    def step(s: Column, x: Column) -> Column:
        full = (s["items"] > 0) & ((s["items"] >= max_items) | (s["chars"] + x["n"] > max_chars))
        fresh = F.struct((s["batch"] + 1).alias("batch"), F.lit(1).alias("items"), x["n"].alias("chars"))
        return F.when(full, fresh).otherwise(F.struct(s["batch"].alias("batch"), (s["items"] + 1).alias("items"), (s["chars"] + x["n"]).alias("chars")))

    states = running(F.col("items"), zero, step, "struct<batch: int, items: int, chars: long>")
    numbered = groups.select(key, F.explode(F.arrays_zip(F.transform("items", lambda x: x["o"]).alias("o"), F.transform(states, lambda s: s["batch"]).alias("b"))).alias("z"))
    return sized.drop("__n").join(numbered.select(key, F.col("z.o").alias(order), F.col("z.b").alias("batch")), [key, order])


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Adds the number (from 0) of each row in an order over the whole table, without one task for all.

    Rows are dealt by range and numbered within each part; only the parts' counts meet in one place.
    """
    from textmill.scratch import stash

    held = stash(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return held.withColumn(name, local).join(offsets, "__p").withColumn(name, F.col(name) + F.col("__o")).drop("__p", "__o")


def chunks(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds ``chunk``: the rows of the table in order, ``size`` at a time."""
    return numbered(rows, order, "__n").withColumn("chunk", F.floor(F.col("__n") / size).cast("int")).drop("__n")


def gap_clusters(items: DataFrame, keys: list[str], start: str, end: str, gap: float = 60.0) -> DataFrame:
    """Adds ``cluster``: rows by ``start``, parted where one starts over ``gap`` beyond all ends before it."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(F.col(start) - before > gap, 1).otherwise(0)
    return items.withColumn("__cut", cut).withColumn("cluster", F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__cut")


def cell_rows(cells: DataFrame, keys: list[str], tolerance: float = 3.0) -> DataFrame:
    """Adds ``cell_row`` to (keys, id, table_idx, row, y0): explicit rows, and loose cells by their height.

    A loose cell joins the first row whose first cell's top is within ``tolerance``, else it begins one.
    """
    explicit = F.col("table_idx").isNotNull() & F.col("row").isNotNull()
    item = F.struct(F.when(explicit, 0).otherwise(1).alias("loose"), F.when(explicit, F.col("id").cast("double")).otherwise(F.col("y0")).alias("rank"), "id", "table_idx", "row", "y0")
    pages = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    ref = "struct<t: int, r: int, y: double>"
    zero = F.struct(F.array().cast(f"array<{ref}>").alias("rows"), F.lit(-1).alias("at"))

    def step(s: Column, x: Column) -> Column:
        # A group made by a loose cell holds no table or row, so that no explicit cell meets it.
        same = F.transform(s["rows"], lambda r: F.when(x["loose"] == 0, r["t"].eqNullSafe(x["table_idx"]) & r["r"].eqNullSafe(x["row"])).otherwise(F.abs(x["y0"] - r["y"]) <= tolerance))
        at = F.array_position(same, F.lit(True)).cast("int") - 1
        new = F.struct(F.when(x["loose"] == 0, x["table_idx"]).alias("t"), F.when(x["loose"] == 0, x["row"]).alias("r"), x["y0"].alias("y"))
        return F.when(at >= 0, F.struct(s["rows"].alias("rows"), at.alias("at"))).otherwise(F.struct(F.array_append(s["rows"], new).alias("rows"), F.size(s["rows"]).alias("at")))

    states = running(F.col("items"), zero, step, f"struct<rows: array<{ref}>, at: int>")
    numbered = pages.select(*keys, F.explode(F.arrays_zip(F.transform("items", lambda x: x["id"]).alias("id"), F.transform(states, lambda s: s["at"]).alias("at"))).alias("z"))
    return cells.join(numbered.select(*keys, F.col("z.id").alias("id"), F.col("z.at").alias("cell_row")), [*keys, "id"])


def harmonize(rows: DataFrame, group: list[str], size: str = "size", minimum: str | None = "min_size", max_shrink: float = 1.0) -> DataFrame:
    """Sizes of each group of two or more drawn together: no more than the least, or the greatest less ``max_shrink``."""
    w = Window.partitionBy(*group)
    target = F.greatest(F.min(size).over(w), F.max(size).over(w) - max_shrink)
    low = F.col(minimum) if minimum else F.lit(0.0)
    return rows.withColumn(size, F.when(F.count(size).over(w) >= 2, F.greatest(low, F.least(F.col(size), target))).otherwise(F.col(size)))


def latest(rows: DataFrame, keys: list[str], seq: str, keep: int) -> DataFrame:
    """The last ``keep`` rows of each key, as a ring buffer would hold."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).where(F.col("__r") <= keep).drop("__r")


def limit_keep_shape(rows: DataFrame, done: DataFrame, doc: str, order: str, n: int, text: str = "text", target: str = "dst") -> DataFrame:
    """All rows with ``ru``: the translation for the first ``n`` of each document, the source text for the rest."""
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(doc).orderBy(order)))
    met = first.join(done.select(doc, order, F.col(target).alias("__t")), [doc, order], "left")
    return met.withColumn("ru", F.when(F.col("__r") <= n, F.coalesce("__t", F.col(text))).otherwise(F.col(text))).drop("__r", "__t")


def weighted_mode(rows: DataFrame, keys: list[str], style: list[str], weight: Column, pos: str) -> DataFrame:
    """(keys, style) with the greatest sum of weights; on ties the first seen, then the least."""
    sums = rows.groupBy(*keys, *style).agg(F.sum(weight).alias("__w"), F.min(pos).alias("__at"))
    best = sums.groupBy(*keys).agg(F.min_by(F.struct(*style), F.struct((-F.col("__w")).alias("w"), "__at", *style)).alias("s"))
    return best.select(*keys, "s.*")
