"""Intermediate tables, row numbers, batches and filters of the operators here.

Tables go through ``textmill.scratch``: Parquet in the folder that all executors share,
so lineage is cut, a lost executor costs one re-read, and later passes read few columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.scratch import drop, stash

__all__ = ["UID", "absent", "bitmap", "drop", "fresh_name", "hot_join", "own", "packed_rows", "present", "small_batches", "stash", "unpacked", "with_uid"]

UID = "__uid"
#: Rows handed to Python at once; a row can be a megabyte, so far below Spark's default.
ARROW_ROWS = 512
#: Slots of a ``bitmap``: 2 MB of bits, in at most ``SLOTS / 64`` rows.
SLOTS = 1 << 24
#: A key with over one in so many of all rows is hot; fewer than ``HOT`` keys can be.
HOT = 1000


def with_uid(df: DataFrame) -> DataFrame:
    """Adds a row number that is unique; it is only stable once the result is stashed."""
    return df.withColumn(UID, F.monotonically_increasing_id())


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of one Arrow batch, so that long texts don't pile up in a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def own(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Selects the given columns under names of our own; others, whatever they are called, go."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def fresh_name(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores after it until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed_rows(df: DataFrame, **more: str | Column) -> DataFrame:
    """The whole row as one struct ``row``, so that no column's name can clash, and ``more`` columns beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in more.items()])


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """Rows packed by ``packed_rows`` under their own names again, some columns changed."""
    return df.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in columns])


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits): the hash slots that the keys take; at most ``SLOTS / 64`` rows for any number of keys."""
    slot = _slot(F.col(key))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    return keys.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _tested(rows: DataFrame, key: str, bits: DataFrame, how: str) -> DataFrame:
    slot = _slot(F.col(key))
    held = F.call_function("shiftrightunsigned", F.col("bits"), (slot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(bits), (F.floor(slot / 64) == F.col("word")) & held, how)


def present(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows whose key may be among a ``bitmap``'s; all that are, and few that are not."""
    return _tested(rows, key, bits, "left_semi")


def absent(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows whose key is surely not among a ``bitmap``'s."""
    return _tested(rows, key, bits, "left_anti")


def hot_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row for each ``key``.

    Keys with over one in ``HOT`` of all rows, fewer than ``HOT`` keys at any size, meet a broadcast of their
    rows of the table, so no task holds a hot key; the others meet in a join by key.
    """
    if hot is None:
        hot = hot_keys(rows, key)
    few = table.join(F.broadcast(hot), key, "left_semi")
    warm = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, "left")
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left")
    return warm.unionByName(cold)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys with over one in ``HOT`` of all rows: fewer than ``HOT``."""
    counts = stash(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") * HOT > total).select(key)
