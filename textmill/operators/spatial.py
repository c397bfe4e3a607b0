"""Spatial joins; every join carries its page as an equi-key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.config import Settings
from textmill.functions import geometry as G


def locate(boxes: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each box (keys, box_id, bbox) with the smallest cell that holds its centre, if any.

    ``cells``: keys, table_idx, table_bbox, cell_pos, cell_idx, row, col, cell_bbox; a table without cells
    has one row with null cell columns.  A box in a table but in none of its cells gets the
    first such table and no cell.  Ties in area go to the first table, then the first cell.
    """
    # Columns of their own before the join, as a lambda would work its outer terms out again for each cell.
    centred, (x, y) = [c.alias(n) for c, n in zip(G.centre(F.col("bbox")), ("__x", "__y"), strict=True)], map(F.col, ("__x", "__y"))
    rest = [c for c in boxes.columns if c not in (*keys, "box_id")]
    # A page's cells are one row, and each box looks through them in place: pairs of boxes and cells are never rows.
    cell = F.struct("table_bbox", F.struct(G.area(F.col("cell_bbox")).alias("area"), "table_idx", "cell_pos", "cell_idx", "row", "col", "cell_bbox").alias("rank"))
    held = cells.groupBy(*keys).agg(F.collect_list(cell).alias("__cells"))
    met = boxes.select("*", *centred).join(held.hint("merge"), keys, "left")
    met = met.withColumn("__cells", F.transform(F.filter("__cells", lambda c: G.inside(x, y, c["table_bbox"])), lambda c: c["rank"]))
    best = F.array_min(F.filter("__cells", lambda c: c["cell_bbox"].isNotNull() & G.inside(x, y, c["cell_bbox"])))
    met = met.select(*keys, "box_id", *rest, best.alias("__best"), F.array_min(F.transform("__cells", lambda c: c["table_idx"])).alias("__first"))
    return met.select(*keys, "box_id", *rest, F.coalesce("__best.table_idx", "__first").alias("table_idx"), *[F.col(f"__best.{c}").alias(c) for c in ("cell_idx", "row", "col", "cell_bbox")])


def locate_in(bbox: Column, tables: Column) -> Column:
    """The same within one row that holds the page's tables as an array: no join at all."""
    x, y = G.centre(bbox)
    held = F.filter(F.transform(tables, lambda t, i: F.struct(t["bbox"].alias("bbox"), t["cells"].alias("cells"), i.alias("at"))), lambda t: t["bbox"].isNotNull() & G.inside(x, y, t["bbox"]))

    def cell(t: Column):
        return lambda c, i: F.struct(G.area(c["bbox"]).alias("area"), t["at"].alias("table_idx"), i.alias("pos"), F.coalesce(c["index"], i).alias("cell_idx"), c["row"].alias("row"), c["col"].alias("col"), c["bbox"].alias("cell_bbox"))

    cells = F.flatten(F.transform(held, lambda t: F.transform(F.coalesce(t["cells"], F.array().cast("array<struct<index: int, bbox: array<double>, row: int, col: int>>")), cell(t))))
    best = F.array_min(F.filter(cells, lambda c: c["cell_bbox"].isNotNull() & G.inside(x, y, c["cell_bbox"])))
    return F.struct(F.coalesce(best["table_idx"], F.get(held, F.lit(0))["at"]).alias("table_idx"), best["cell_idx"].alias("cell_idx"), best["row"].alias("row"), best["col"].alias("col"), best["cell_bbox"].alias("cell_bbox"))


def assign_grid(flat: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Flat table cells (keys, index, bbox) with rows and columns from grid slots (keys, row, col, bbox).

    Rectangles join by equality to 4 decimals.  The nth slot at a rectangle takes the nth flat cell there;
    further slots of a merged cell are left out; slots without a flat cell follow with the next indices.
    """
    key = G.rect_key(F.col("bbox"))
    f = flat.withColumn("rk", key).withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "rk").orderBy("index")))
    g = grid.withColumn("rk", key).withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "rk").orderBy("row", "col")))
    g = g.select(*keys, "rk", "nth", "row", "col", F.col("bbox").alias("slot_bbox"))
    met = f.join(g, [*keys, "rk", "nth"], "left").select(*keys, "index", "bbox", "row", "col")
    size = flat.groupBy(*keys).agg((F.max("index") + 1).alias("n"))
    extra = g.where("nth = 1").join(f.select(*keys, "rk").distinct(), [*keys, "rk"], "left_anti").join(size, keys, "left")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("row", "col")) - 1 + F.coalesce("n", F.lit(0))
    return met.unionByName(extra.select(*keys, number.cast("int").alias("index"), F.col("slot_bbox").alias("bbox"), "row", "col"))


def neighbours(rects: DataFrame, keys: list[str], box: str = "box") -> DataFrame:
    """For each rectangle of a page (keys, id, r, box): has_right, and blocker, the nearest top edge below it.

    ``r`` is the page's rectangle of each row, ``box`` the one being grown.
    """
    mine = F.col(box)
    other = rects.select(*keys, F.col("id").alias("other_id"), F.col("r").alias("other"))
    met = rects.join(other, keys).where(F.col("other_id") != F.col("id"))
    o = F.col("other")
    right = (o[0] >= mine[2] - 1) & (o[1] < mine[3]) & (o[3] > mine[1])
    below = (o[1] >= mine[3] - 0.5) & (o[0] < mine[2]) & (o[2] > mine[0])
    found = met.groupBy(*keys, "id").agg(F.coalesce(F.bool_or(right), F.lit(False)).alias("has_right"), F.min(F.when(below, o[1])).alias("blocker"))
    return rects.join(found, [*keys, "id"], "left").withColumn("has_right", F.coalesce("has_right", F.lit(False)))


def grown_rects(segments: DataFrame, s: Settings, keys: list[str], page: str | None = None, sized: bool = False) -> DataFrame:
    """Rows of ``segments`` (keys, id, type, bbox, layout_bbox) with ``grown``, the room their text may take.

    Cells keep their rectangle.  Others widen by 1; captions take the content's width; short ones reach the
    content's right edge if nothing is there; all grow down to 1.55 sizes, but not over what is below.
    """
    r = F.coalesce("layout_bbox", "bbox")
    rows = segments.withColumn("r", r).where(F.col("r").isNotNull() & (F.size("r") == 4))
    if sized:
        rows = rows.where((F.col("r")[2] - F.col("r")[0] >= 1) & (F.col("r")[3] - F.col("r")[1] >= 1))
    content = rows.groupBy(*keys).agg(F.min(F.col("r")[0]).alias("cx0"), F.max(F.col("r")[2]).alias("cx1"))
    rows = rows.join(content, keys)
    low = G.role_min_size(F.col("type"), s)
    size = F.greatest(F.coalesce(F.nullif("size", F.lit(0.0)), F.lit(10.0)), low) if sized else low
    cell, caption = F.col("type") == "cell", F.col("type").isin("caption_fig", "caption_tab")
    x0, x1 = F.col("r")[0] - 1, F.col("r")[2] + 1
    if page:
        x0, x1 = F.greatest(F.col(page)[0], x0), F.least(F.col(page)[2], x1)
    first = F.when(cell, F.col("r")).when(caption, F.array("cx0", F.col("r")[1], "cx1", F.col("r")[3])).otherwise(F.array(x0, F.col("r")[1], x1, F.col("r")[3]))
    rows = rows.withColumn("box", first).withColumn("fsize", size)
    short = ~cell & ~caption & (F.col("box")[2] - F.col("box")[0] < F.greatest(F.lit(1.0), F.col("cx1") - F.col("cx0")) * 0.80)
    side = neighbours(rows.select(*keys, "id", "r", "box"), keys).select(*keys, "id", "has_right")
    rows = rows.join(side, [*keys, "id"])
    rows = rows.withColumn("box", F.when(short & ~F.col("has_right"), F.array(F.col("box")[0], F.col("box")[1], F.col("cx1"), F.col("box")[3])).otherwise(F.col("box")))
    under = neighbours(rows.select(*keys, "id", "r", "box"), keys).select(*keys, "id", "blocker")
    rows = rows.join(under, [*keys, "id"])
    b = F.col("box")
    wanted = F.greatest(b[3] + 2, b[1] + F.col("fsize") * 1.55)
    wanted = F.least(wanted, F.coalesce(F.col("blocker") - 0.5, wanted))
    if page:
        wanted = F.least(wanted, F.col(page)[3])
    return rows.withColumn("grown", F.when(cell, b).otherwise(F.array(b[0], b[1], b[2], F.greatest(b[3], wanted)))).drop("box", "cx0", "cx1", "has_right", "blocker")


def budgets(segments: DataFrame, s: Settings, keys: list[str]) -> DataFrame:
    """(keys, id, max_chars): characters that fit each segment's room at its smallest readable size."""
    rows = grown_rects(segments, s, keys)
    low = G.role_min_size(F.col("type"), s)
    g = F.col("grown")
    w, h = F.greatest(g[2] - g[0], F.lit(1.0)), F.greatest(g[3] - g[1], low * 1.2)
    n = F.greatest((h / (low * 1.2)).cast("int"), F.lit(1))
    return rows.select(*keys, "id", F.greatest(F.lit(12), (w / (low * s.avg_char_width) * n * s.layout_fill).cast("int")).alias("max_chars"))


#: Side of a tile of a page, in points.
TILE = 64.0


def _tiles(box: Column, slack: float = 1.0) -> tuple[Column, Column]:
    """The tiles that a rectangle touches, and the first of them in each direction."""
    first = [F.floor((box[i] - slack) / TILE) for i in (0, 1)]
    last = [F.floor((box[i] + slack) / TILE) for i in (2, 3)]
    side = [F.sequence(a, F.greatest(a, b)) for a, b in zip(first, last, strict=True)]
    every = F.flatten(F.transform(side[0], lambda x: F.transform(side[1], lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return every, F.struct(first[0].alias("x"), first[1].alias("y"))


def matches(out_spans: DataFrame, src_spans: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of output and source spans of one page that overlap; output columns keep their names.

    Spans meet by the tiles of the page that they touch, and a pair counts at the first tile that both touch.
    """
    src = src_spans.select(*keys, *[F.col(c).alias(f"src_{c}") for c in src_spans.columns if c not in keys])
    (mine, from_), (theirs, src_from) = _tiles(F.col("bbox")), _tiles(F.col("src_bbox"))
    a = out_spans.select("*", F.explode(mine).alias("__tile"), from_.alias("__from"))
    b = src.select("*", F.explode(theirs).alias("__tile"), src_from.alias("__src_from"))
    first = (F.col("__tile.x") == F.greatest("__from.x", "__src_from.x")) & (F.col("__tile.y") == F.greatest("__from.y", "__src_from.y"))
    met = a.join(b, [*keys, "__tile"]).where(first & G.overlap_match(F.col("bbox"), F.col("src_bbox")))
    return met.drop("__tile", "__from", "__src_from")


def small_in_source(out_spans: DataFrame, src_spans: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, id) of output spans whose source spans were as small, one of them a service text."""
    from textmill.functions.text import meaningful_chars, strip

    text, box, page_height = strip(F.col("src_text")), F.col("src_bbox"), F.col("src_page_height")
    edge = (box[1] <= page_height * 0.07) | (box[3] >= page_height * 0.93)
    service = text.rlike(r"(?i)\A(?:\p{Nd}+|[ivxlcdm]+)\z") | (meaningful_chars(text) <= 3) | (edge & (meaningful_chars(text) <= 40))
    met = matches(out_spans, src_spans, keys).groupBy(*keys, "id").agg(F.max("src_size").alias("most"), F.bool_or(service).alias("service"))
    return met.where((F.col("most") <= threshold + 0.25) & F.col("service")).select(*keys, "id")
