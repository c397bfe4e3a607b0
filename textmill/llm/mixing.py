"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target of words.  A source takes all its documents ``copies``
times and a part of them once more; that part is what a hash of the id puts below
a threshold.  The threshold is found by nested histograms: words by source and
leading hash bits, then only the bucket that the budget ends in by its next bits,
until that bucket holds one hash.  Nothing is sorted; each round reads a table of
(source, hash, size), and the documents are filtered by one comparison.

The document at the threshold gives just the words that are left of the budget, so
each source's words meet its target to one word.  Rows that share the boundary
hash (repeated or null ids) share these words in proportion to their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.scratch import own, packed_rows, stash, unpacked
from textmill.llm.words import first_words, n_words

HASH_BITS = 60
STEP_BITS = 12


def id_hash(id_col: Column) -> Column:
    """60 bits of the id's MD5; the same in any SQL engine."""
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def running(rows: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds the sums of values over all rows up to and with each, in an order over the whole table.

    Rows are dealt by range and summed within each part; only the parts' totals meet in one place, so any number of
    sources may be ordered.
    """
    named = {f"v_{k}": v.cast("decimal(38,0)") for k, v in sums.items()}
    held = stash(rows.withColumns(named).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    totals = held.groupBy("part").agg(*[F.sum(v).alias(v) for v in named])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"o{v}") for v in named])
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.join(offsets, "part").withColumns({k: (F.sum(f"v_{k}").over(upto) + F.col(f"ov_{k}")).cast("decimal(38,0)") for k in sums})
    return out.select(*rows.columns, *sums)


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights for (source, ...) rows: the cycle, repeated over sources in code point order, null last."""
    placed = running(sources, [F.asc_nulls_last("source")], {"place": F.lit(1)})
    at = ((F.col("place").cast("long") - 1) % len(cycle) + 1).cast("int")
    return placed.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), at).cast("long")).drop("place")


def targets(weighted: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, weight) -> the same with target and whether it is held at ``most`` sizes.

    The fixed point of sharing by weight, holding sources above their limit and sharing
    the excess anew.  With sources in order of limit by weight, those held are a prefix.
    """
    big = "decimal(38,0)"
    limit = F.col("source_size") * most
    order = [limit / F.col("weight"), F.asc_nulls_last("source")]
    sums = running(weighted, order, {"limits": limit, "weights": F.col("weight")})
    total, all_weights = sums.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_weights = F.lit(total or 0).cast(big), F.lit(all_weights or 0).cast(big)
    weight_left = all_weights - F.col("weights") + F.col("weight")
    # In whole numbers: the limit is below what the rest is worth at this weight.
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    held = whole(limit, 20) * whole(weight_left, 18) < whole(total - F.col("limits") + limit, 20) * whole(F.col("weight"), 18)
    sums = stash(sums.withColumn("held", held), "mix-held")
    free = sums.agg(F.sum(F.when(F.col("held"), limit).otherwise(0)), F.sum(F.when(F.col("held"), 0).otherwise(F.col("weight"))), F.sum("source_size")).first()
    left, weights = (free[2] or 0) - (free[0] or 0), free[1] or 0
    shared = (F.lit(left).cast("long") * F.col("weight")).cast("double") / F.lit(max(1, weights))
    return sums.drop("limits", "weights").withColumn("target", F.when(F.col("held"), limit.cast("double")).otherwise(shared))


def thresholds(sized: DataFrame, weighting=cycled_weights, most: int = 3) -> DataFrame:
    """(source, h, size) -> one row for each source: source_size, target, copies, cut, need, atom.

    ``need`` of the ``atom`` words at hash ``cut`` are taken beside all below ``cut``.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(weighting(per_source), most)
    wanted = F.round("target").cast("long")
    plan = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long"))
    plan = stash(plan.withColumn("need", wanted - F.col("copies") * F.col("source_size")), "mix-targets")

    open_ = plan.where("need > 0").select("source", "need", F.lit(0).cast("long").alias("prefix"))
    done: list[DataFrame] = []
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        open_ = _refine(sized, open_, shift)
        done.append(open_.where("low = high"))
        open_ = open_.where("low < high")
        if open_.isEmpty():
            break
    cuts = done[0]
    for more in done[1:]:
        cuts = cuts.unionByName(more)
    cuts = cuts.select(F.col("source").alias("cut_source"), F.col("low").alias("cut"), F.col("need").alias("cut_need"), F.col("words").alias("atom"))
    joined = plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return stash(joined.select("source", "source_size", "target", "copies", "cut", F.col("cut_need").alias("need"), "atom"), "mix-thresholds")


def _refine(sized: DataFrame, open_: DataFrame, shift: int) -> DataFrame:
    """Within each source's bucket ``prefix``, the next bucket that its budget ends in."""
    at = open_.select(F.col("source").alias("open_source"), "need", "prefix")
    inside = F.col("source").eqNullSafe(F.col("open_source")) & (F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
    bucket = F.shiftright("h", shift)
    # The budget joins after the sums, so a hot source is summed where its rows lie.
    sums = sized.join(at, inside, "left_semi") if shift < HASH_BITS - STEP_BITS else sized
    sums = sums.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
    run = Window.partitionBy("source").orderBy("bucket")
    sums = sums.where("words > 0").withColumn("upto", F.sum("words").over(run))
    met = sums.join(at, F.col("source").eqNullSafe(F.col("open_source")))
    hit = met.where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("words") <= F.col("need")))
    left = F.col("need") - (F.col("upto") - F.col("words"))
    return stash(hit.select("source", left.alias("need"), F.col("bucket").alias("prefix"), "words", "low", "high"), "mix-bucket")


def _part(size: Column) -> Column:
    """Words of one row at the boundary hash."""
    return F.floor(size.cast("double") * F.col("need") / F.col("atom")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weighting=cycled_weights, most: int = 3) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, taken.

    ``weighting`` maps (source, source_size) rows to rows with a positive integer weight.
    Null texts have size 0 and take 0 words; a null source is a source of its own,
    last in order.  Rows with the same id share one hash.  An empty table gives no
    rows.  Reruns agree.  Other columns are ignored.
    """
    rows = own(docs, id=id_col, source=source_col, text=text_col)
    sized = stash(rows.select("id", "source", id_hash(F.col("id")).alias("h"), n_words(F.col("text")).alias("size")), "mix-sizes")
    cuts = thresholds(sized, weighting, most).withColumnRenamed("source", "of")
    out = sized.join(cuts, F.col("source").eqNullSafe(F.col("of")))
    more = F.when(F.col("h") < F.col("cut"), F.col("size")).when(F.col("h") == F.col("cut"), _part(F.col("size"))).otherwise(0)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size") + more).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weighting=cycled_weights, most: int = 3, length_col: str | None = "n_chars") -> DataFrame:
    """The mix itself: rows of ``docs`` repeated as often as it takes them, all columns kept, whatever they are called.

    The boundary document's last copy is its first words up to the budget; ``length_col``,
    if the table has it, is set to that text's length.  Texts without words follow their
    hash, taking none of the budget; where a whole source has none, it takes nothing.
    Repeated rows share one hash.  An empty table gives no rows.
    """
    rows = own(docs, id=id_col, source=source_col, text=text_col)
    sized = stash(rows.select("source", id_hash(F.col("id")).alias("h"), n_words(F.col("text")).alias("size")), "mix-sizes")
    cuts = thresholds(sized, weighting, most).withColumnRenamed("source", "of")
    held = packed_rows(docs, h=id_hash(F.col(f"`{id_col}`")), source=source_col)
    text = F.col("row").getField(text_col)
    out = held.join(cuts, F.col("source").eqNullSafe(F.col("of")))
    part = F.when(F.col("h") == F.col("cut"), _part(n_words(text))).otherwise(0)
    out = out.withColumn("whole", F.col("copies") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)).withColumn("part", part)
    copies = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    out = out.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut_off = F.col("copy") > F.col("whole")
    said = F.when(cut_off, first_words(text, F.col("part"))).otherwise(text)
    changed = {text_col: said}
    if length_col in docs.columns:
        length = F.col("row").getField(length_col)
        changed[length_col] = F.when(cut_off, F.length(said)).otherwise(length).cast(docs.schema[length_col].dataType)
    return unpacked(out, docs.columns, **changed)


def oracle_sql(cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> str:
    """DuckDB SQL for ``mix`` over ``documents``; it sorts, where the operator does not."""
    weights = ", ".join(map(str, cycle))
    return f"""
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{weights}][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(cycle)} + 1)::BIGINT] AS weight FROM s),
o AS (SELECT *, {most} * source_size AS lim,
        coalesce(sum({most} * source_size) OVER (ORDER BY {most} * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_before,
        sum(weight) OVER (ORDER BY {most} * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
        sum(source_size) OVER () AS total FROM w),
hd AS (SELECT *, lim::HUGEINT * weight_left < (total - held_before) * weight AS held FROM o),
t AS (SELECT source, source_size,
        CASE WHEN held THEN lim::DOUBLE
             ELSE ((sum(source_size) OVER () - sum(CASE WHEN held THEN lim ELSE 0 END) OVER ()) * weight)::DOUBLE
                  / sum(CASE WHEN held THEN 0 ELSE weight END) OVER () END AS target FROM hd),
r AS (SELECT *, round(target)::BIGINT AS wanted, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS copies FROM t),
a AS (SELECT source, h, sum(size)::BIGINT AS atom FROM d GROUP BY source, h),
c AS (SELECT source, h, atom, (sum(atom) OVER (PARTITION BY source ORDER BY h) - atom)::BIGINT AS below FROM a)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (r.copies * d.size + CASE
          WHEN c.below + c.atom <= r.wanted - r.copies * r.source_size THEN d.size
          WHEN c.below < r.wanted - r.copies * r.source_size
            THEN floor(d.size::DOUBLE * (r.wanted - r.copies * r.source_size - c.below) / c.atom)::BIGINT
          ELSE 0 END)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""
