"""Parsed pages -> typed text segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.config import Settings
from textmill.functions import geometry as G
from textmill.functions import text as T
from textmill.functions.folds import running
from textmill.operators.spatial import locate_in

DOC_PAGE = ["doc_id", "page"]


def toc_index(toc: DataFrame) -> DataFrame:
    """(doc_id, pos, lvl, title, page) -> (doc_id, toc_key, toc_title); a later title of one key wins."""
    return toc.groupBy("doc_id", T.squash(F.col("title")).alias("toc_key")).agg(F.max_by("title", "pos").alias("toc_title"))


def located_spans(pages: DataFrame) -> DataFrame:
    """One row for each span of text blocks, with its table cell; a block without spans gives one row."""
    blocks = pages.select(*DOC_PAGE, "tables", F.posexplode("blocks").alias("block_pos", "block")).where("block.type = 0")

    def line(ln: Column, i: Column) -> Column:
        return F.transform(ln["spans"], lambda sp, j: F.struct(i.alias("line_pos"), j.alias("span_pos"), ln["bbox"].alias("line_bbox"), sp.alias("span"), locate_in(sp["bbox"], F.col("tables")).alias("at")))

    spans = F.flatten(F.transform("block.lines", line))
    rows = blocks.select(*DOC_PAGE, "block_pos", F.col("block.bbox").alias("block_bbox"), locate_in(F.col("block.bbox"), F.col("tables")).alias("block_at"), F.explode_outer(spans).alias("s"))
    return rows.select(*DOC_PAGE, "block_pos", "block_bbox", "s.line_pos", "s.span_pos", "s.line_bbox", "s.span", F.when(F.col("s").isNotNull(), F.col("s.at")).otherwise(F.col("block_at")).alias("at"))


def split_by_cells(spans: DataFrame) -> DataFrame:
    """Blocks split where their spans lie in different cells: one row for each part, with its lines.

    A block in one cell stays whole, with its own rectangles; parts get the union of their spans'.
    """
    key = [*DOC_PAGE, "block_pos", "at.table_idx", "at.cell_idx"]
    item = F.when(F.col("span").isNotNull(), F.struct("line_pos", "span_pos", "line_bbox", "span"))
    parts = spans.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("items"), F.min(F.struct("line_pos", "span_pos")).alias("first"), F.min_by("at", F.struct("line_pos", "span_pos")).alias("at"), F.first("block_bbox").alias("block_bbox"))
    parts = parts.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy(*DOC_PAGE, "block_pos")) == 1)

    def whole_line(i: Column) -> Column:
        own = F.filter(F.col("items"), lambda x: x["line_pos"] == i)
        box = F.when(F.col("alone"), own[0]["line_bbox"]).otherwise(G.union_of(F.transform(own, lambda x: x["span"]["bbox"])))
        return F.struct(box.alias("bbox"), F.transform(own, lambda x: x["span"]).alias("spans"))

    numbers = F.array_distinct(F.transform("items", lambda x: x["line_pos"]))
    parts = parts.withColumn("lines", F.transform(numbers, whole_line))
    box = F.when(F.col("alone"), F.col("block_bbox")).otherwise(G.union_of(F.transform("lines", lambda x: x["bbox"])))
    return parts.select(*DOC_PAGE, "block_pos", "first", F.col("at.table_idx").alias("table_idx"), F.col("at.cell_idx").alias("cell_idx"), F.col("at.row").alias("row"), F.col("at.col").alias("col"), F.col("at.cell_bbox").alias("cell_bbox"), box.alias("bbox"), "lines")


def merge_same_cell(parts: DataFrame) -> DataFrame:
    """One row for each table cell, at the place of its first part, lines in reading order; others pass."""
    in_cell = F.col("table_idx").isNotNull() & F.col("cell_idx").isNotNull()
    apart = F.when(~in_cell, F.struct("block_pos", "first"))
    at = F.struct("block_pos", "first")
    whole = parts.withColumn("apart", apart).groupBy(*DOC_PAGE, "table_idx", "cell_idx", "apart").agg(
        F.min(at).alias("at"), F.min_by("row", at).alias("row"), F.min_by("col", at).alias("col"), F.min_by("cell_bbox", at).alias("cell_bbox"), G.union_agg("bbox").alias("bbox"), F.sort_array(F.collect_list(F.struct(at.alias("at"), "lines"))).alias("all")
    )
    lines = F.flatten(F.transform("all", lambda x: x["lines"]))
    ordered = F.transform(F.array_sort(F.transform(lines, lambda x, i: F.struct(x["bbox"][1].alias("y"), x["bbox"][0].alias("x"), i.alias("i"), x.alias("line")))), lambda x: x["line"])
    return whole.withColumn("lines", F.when(F.col("apart").isNull(), ordered).otherwise(lines)).drop("all", "apart")


def merge_close(blocks: DataFrame) -> DataFrame:
    """Joins blocks that continue the one before them on its line; a fold over each page's blocks."""
    held = ("at", "bbox", "table_idx", "cell_idx", "row", "col", "cell_bbox", "lines")
    item = F.struct(*held, (F.size("lines") > 0).alias("full"))
    pages = blocks.groupBy(*DOC_PAGE).agg(F.sort_array(F.collect_list(item)).alias("items"))
    state = "struct<n: int, bbox: array<double>, table_idx: int, cell_idx: int, full: boolean>"
    none = F.lit(None)
    zero = F.struct(F.lit(-1).alias("n"), none.cast("array<double>").alias("bbox"), none.cast("int").alias("table_idx"), none.cast("int").alias("cell_idx"), F.lit(False).alias("full"))

    def step(s: Column, b: Column) -> Column:
        p, c = s["bbox"], b["bbox"]
        free = s["table_idx"].isNull() & b["table_idx"].isNull()
        same = s["table_idx"].eqNullSafe(b["table_idx"]) & s["cell_idx"].isNotNull() & s["cell_idx"].eqNullSafe(b["cell_idx"])
        row = F.abs((p[1] + p[3]) / 2 - (c[1] + c[3]) / 2) < 2.5
        near = (c[0] - p[2] > -50) & (c[0] - p[2] < 2.0)
        joins = s["full"] & b["full"] & (free | same) & row & near
        grown = F.array(F.least(p[0], c[0]), F.least(p[1], c[1]), F.greatest(p[2], c[2]), F.greatest(p[3], c[3]))
        old = F.struct(s["n"].alias("n"), grown.alias("bbox"), s["table_idx"].alias("table_idx"), s["cell_idx"].alias("cell_idx"), F.lit(True).alias("full"))
        new = F.struct((s["n"] + 1).alias("n"), c.alias("bbox"), b["table_idx"].alias("table_idx"), b["cell_idx"].alias("cell_idx"), b["full"].alias("full"))
        return F.when(F.coalesce(joins, F.lit(False)), old).otherwise(new)

    groups = pages.withColumn("n", F.transform(running(F.col("items"), zero, step, state), lambda s: s["n"]))
    # Blocks are told their numbers within their page's row, which held them all from the first, so they meet in no join.
    met = groups.select(*DOC_PAGE, F.explode(F.arrays_zip("items", "n")).alias("z")).select(*DOC_PAGE, "z.n", *[F.col(f"z.items.{c}").alias(c) for c in held])
    first = lambda c: F.min_by(c, "at").alias(c)
    merged = met.groupBy(*DOC_PAGE, "n").agg(*[first(c) for c in ("table_idx", "cell_idx", "row", "col", "cell_bbox")], G.union_agg("bbox").alias("bbox"), F.sort_array(F.collect_list(F.struct("at", "lines"))).alias("all"))
    return merged.withColumn("lines", F.flatten(F.transform("all", lambda x: x["lines"]))).drop("all")


def block_text(lines: Column, s: Settings) -> Column:
    joined = F.array_join(F.transform(lines, lambda x: F.array_join(F.transform(x["spans"], lambda sp: F.coalesce(sp["text"], F.lit(""))), "")), "\n")
    return T.normalize_markers(joined, s)


def dominant_style(spans: Column, s: Settings) -> Column:
    """Style of most characters of content, the first seen on ties; else of the first visible span."""

    def style(sp: Column) -> Column:
        return F.struct(F.coalesce(sp["font"], F.lit("")).alias("font"), F.bround(F.coalesce(sp["size"], F.lit(0.0)), 3).alias("size"), F.coalesce(sp["color"], F.lit(0)).alias("color"), F.coalesce(sp["flags"], F.lit(0)).alias("flags"))

    weighed = F.transform(spans, lambda sp: F.struct(T.content_weight(sp["text"], s.bullet_chars).alias("w"), style(sp).alias("style"), F.regexp_replace(F.coalesce(sp["text"], F.lit("")), f"[{T.PUA}]", "").alias("seen")))
    full = F.filter(weighed, lambda x: x["w"] > 0)
    styles = F.array_distinct(F.transform(full, lambda x: x["style"]))
    total = lambda st: F.aggregate(F.filter(full, lambda x: x["style"] == st), F.lit(0), lambda a, x: a + x["w"])
    best = F.array_max(F.transform(styles, lambda st, i: F.struct(total(st).alias("w"), (-i).alias("at"), st.alias("style"))))["style"]
    visible = F.get(F.filter(weighed, lambda x: T.strip(x["seen"]) != ""), F.lit(0))["style"]
    none = F.struct(F.lit("").alias("font"), F.lit(0.0).alias("size"), F.lit(0).alias("color"), F.lit(0).alias("flags"))
    return F.coalesce(best, visible, none)


def typed(rows: DataFrame, toc: DataFrame | None, s: Settings) -> DataFrame:
    """Adds type and section (the section that a heading opens, else null) to rows with text and cell columns."""
    body = T.strip(F.col("text"))
    if toc is not None:
        # The planner would guess the size of contents from their file's, and hold those of a large table in the driver.
        rows = rows.withColumn("toc_key", T.squash(body)).join(toc_index(toc).hint("merge"), ["doc_id", "toc_key"], "left").drop("toc_key")
        told = T.classify(body, F.col("toc_title"), s)
    else:
        told = T.classify(body, None, s)
    rows = rows.withColumn("told", told)
    kind = F.when(F.col("cell_idx").isNotNull(), "cell").when(F.col("table_idx").isNotNull() & (F.col("told.type") == "paragraph"), "cell").otherwise(F.col("told.type"))
    return rows.withColumn("type", kind).withColumn("opens", F.when((F.col("type") == "heading"), F.nullif("told.section", F.lit("")))).drop("told", "toc_title")


def carry_section(rows: DataFrame, order: list[str]) -> DataFrame:
    """``section_id``: the last section that a heading opened, in document order."""
    upto = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section_id", F.last("opens", ignorenulls=True).over(upto))


def segments(pages: DataFrame, toc: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """Pages (``schema.PAGE``) and contents (doc_id, pos, lvl, title, page) -> segments (``schema.SEGMENT``)."""
    blocks = merge_close(merge_same_cell(split_by_cells(located_spans(pages))))
    rows = blocks.withColumn("text", block_text(F.col("lines"), s)).where(T.strip(F.col("text")) != "")
    rows = rows.withColumn("style", dominant_style(F.flatten(F.transform("lines", lambda x: x["spans"])), s)).drop("lines")
    rows = carry_section(typed(rows, toc, s), ["page", "n"])
    rows = rows.withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "n")))
    layout = F.when(F.col("cell_bbox").isNotNull(), G.inner_cell(F.col("cell_bbox")))
    return rows.select("doc_id", "id", "type", "page", "bbox", "section_id", T.anchors(T.strip(F.col("text")), s).alias("anchors"), "style.font", "style.size", "style.color", "style.flags", "table_idx", "cell_idx", "row", "col", layout.alias("layout_bbox"), "text")


def line_segments(docs: DataFrame, s: Settings = Settings(source_lang="en"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain texts as segments: each line with text is a block of its document (doc_id, id, type, section_id, text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "text")).where(T.strip(F.col("text")) != "")
    rows = rows.withColumns({c: F.lit(None).cast("int") for c in ("table_idx", "cell_idx")})
    rows = carry_section(typed(rows, None, s), ["pos"])
    return rows.withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).select("doc_id", "id", "type", "section_id", "text")


def histogram(segments: DataFrame, *keys: str) -> DataFrame:
    return segments.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n_segments"))
