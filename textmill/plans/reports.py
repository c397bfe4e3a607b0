"""More registered queries: answers, reports, layouts, caches, grids and event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill import schema, sources, streaming
from textmill.config import Settings
from textmill.functions import geometry as G
from textmill.functions import jsonio
from textmill.functions import text as T
from textmill.operators import batching, cache, layout, spatial, translate, validate, vision

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EN = Settings(source_lang="en", target_lang="de")


def _query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRAPPED = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')"
_PART = "SELECT p_partkey, p_brand, p_size, p_name, (p_partkey * 37 % 1101)::DOUBLE AS x0, (p_partkey * 53 % 1003)::DOUBLE AS y0 FROM part"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("p_partkey") * 37 % 1101).cast("double"), (F.col("p_partkey") * 53 % 1003).cast("double")
    return batching.spread(_read(spark, sf_dir, "part"), "p_partkey").select("p_partkey", "p_brand", "p_size", "p_name", F.array(x, y, x + F.col("p_size") - 3, y + 20.0).alias("box"))


@_query(f"""SELECT p_partkey, (x0 <= 1000 AND x0 + p_size - 3 BETWEEN 0 AND 1000 AND y0 + 20 <= 1000 AND p_size - 3 >= 1)::INTEGER AS n_regions,
CASE WHEN x0 <= 1000 AND x0 + p_size - 3 BETWEEN 0 AND 1000 AND y0 + 20 <= 1000 AND p_size - 3 >= 1 THEN least(1.0, p_size / 40.0)::DOUBLE END AS confidence FROM ({_PART})""")
def region_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vision answers in prose and fences, each with one region given twice."""
    region = F.struct(F.col("box").alias("bbox"), F.concat("p_name", F.lit(" a")).alias("source_text"), F.concat("p_name", F.lit(" b")).alias("translation"), (F.col("p_size") / 40.0).alias("confidence"))
    answer = F.concat(F.lit("<think>so</think> ```json\n"), F.to_json(F.struct(F.array(region, region).alias("regions"))), F.lit("\n```"))
    rows = jsonio.with_regions(_parts(spark, sf_dir).withColumn("answer", answer), "answer", "en", "en")
    return rows.select("p_partkey", F.size("regions").alias("n_regions"), F.get("regions", F.lit(0))["confidence"].alias("confidence"))


@_query(f"""WITH b AS (SELECT p_partkey, floor(x0 * 1.2)::INTEGER AS a, floor(y0 * 0.36)::INTEGER AS b, ceil((x0 + p_size - 3) * 1.2)::INTEGER AS c, ceil((y0 + 20) * 0.36)::INTEGER AS d FROM ({_PART})),
k AS (SELECT p_partkey, least(1200, greatest(0, a)) AS a, least(360, greatest(0, b)) AS b, least(1200, greatest(0, c)) AS c, least(360, greatest(0, d)) AS d FROM b)
SELECT p_partkey, a AS x0, b AS y0, c AS x1, d AS y1 FROM k WHERE c > a AND d > b""")
def pixel_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = G.pixel_rect(F.col("box"), F.lit(1200), F.lit(360))
    return _parts(spark, sf_dir).where(r.isNotNull()).select("p_partkey", *[r[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@_query("""SELECT conv_id, turn, length(trim(text))::INTEGER AS n_wrapped, length(trim(text))::INTEGER AS n_markdown, trim(text) AS cell FROM conversations""")
def response_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts come out of labels, fences and quotes as they went in."""
    t = F.col("text")
    fenced = lambda label, kind: F.concat(F.lit(f"{label}: ```{kind}\n"), t, F.lit("\n```"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(T.strip_wrappers(fenced("JSON", "json"))).alias("n_wrapped"), F.length(T.clean_markdown(fenced("Translation", "md"))).alias("n_markdown"), T.clean_cell(F.concat(F.lit('```"'), t, F.lit('"```')), F.lit("?")).alias("cell"))


@_query(f"SELECT doc_id, length(w)::INTEGER AS n_chars, sha256(w) AS digest FROM (SELECT doc_id, {_WRAPPED} AS w FROM documents)")
def layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.layout_text(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.length(w).alias("n_chars"), F.sha2(w.cast("binary"), 256).alias("digest"))


@_query(r"""SELECT page_id, count(*) FILTER (WHERE regexp_matches(x, '^\s*([•●○▪◆□]|[-–](\s|$)|[0-9]+[.)](\s|$))'))::INTEGER AS n_bullets
FROM (SELECT page_id, unnest(string_split(regexp_replace(html, '<[^>]*>', chr(10) || '- ', 'g'), chr(10))) AS x FROM pages) GROUP BY 1""")
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("html", "<[^>]*>", "\n- ")
    return _read(spark, sf_dir, "pages").select("page_id", F.size(T.logical_bullets(text)).alias("n_bullets"))


@_query("""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[<>:"/\\\\|?*\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 80 THEN rtrim(CASE WHEN contains(left(t, 80), ' ') THEN regexp_extract(left(t, 80), '^(.*) ', 1) ELSE left(t, 80) END) ELSE t END AS name FROM t""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.safe_name(F.col("text")).alias("name"))


_LOST = """WITH a AS (SELECT page_id, length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[^\\p{L}\\p{N}]', '', 'g')) AS s,
 length(regexp_replace(coalesce(array_to_string(regexp_extract_all(html, '<li>([^<]+)', 1), ' '), ''), '[^\\p{L}\\p{N}]', '', 'g')) AS o FROM pages),
p AS (SELECT page_id, CASE WHEN s >= 4 AND o = 0 THEN 'empty_pages' WHEN s >= 20 AND o < s * 0.2::DOUBLE THEN 'thinned_pages' END AS c FROM a)"""


def _problems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    text = {"src": F.regexp_replace("html", "<[^>]*>", ""), "out": F.array_join(F.regexp_extract_all("html", F.lit("<li>([^<]+)"), F.lit(1)), " ")}
    docs = pages.select("doc_id", F.lit(1).alias("pages"), *[F.lit(0).alias(c) for c in ("images", "toc_len", "max_level")])
    none = spark.createDataFrame([], "doc_id long, page int, id string, text string, size double, bbox array<double>, page_height double")
    side = {k: {"docs": docs, "spans": none, "pages": pages.select("doc_id", F.lit(0).alias("page"), v.alias("text"))} for k, v in text.items()}
    return docs, validate.validate(side["src"], side["out"], EN)


@_query(f"{_LOST} SELECT c AS \"check\", count(*) AS n_docs FROM p WHERE c IS NOT NULL GROUP BY 1")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of pages of which only list items came through."""
    return _problems(spark, sf_dir)[1].groupBy("check").agg(F.count(F.lit(1)).alias("n_docs"))


@_query(f"{_LOST} SELECT page_id AS doc_id, (c IS NOT NULL)::INTEGER AS code FROM p")
def validation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, problems = _problems(spark, sf_dir)
    return validate.exit_codes(docs, docs, problems)


@_query("SELECT user_id AS key, last_value AS dst FROM (SELECT user_id, arg_max(event_type, event_id) AS last_value, arg_max(event_id % 3, event_id) AS review FROM events GROUP BY 1) WHERE review > 0")
def cache_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a cache log of users: the last row of a key counts, unless it takes the key out of use."""
    log = _read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("dst"), F.col("event_id").alias("ts"), (F.col("event_id") % 3).cast("int").alias("accepts_review"))
    return cache.current(log).select("key", "dst")


def _quoted(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, '["\\n\\r,]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


@_query(f"SELECT conv_id, turn, {_quoted('role')} || ',' || {_quoted('text')} AS line_text FROM conversations")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    cells = rows.select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.posexplode(F.array("role", "text")).alias("col", "value"))
    return sources.grid_lines(cells).select(F.col("file").alias("conv_id"), F.col("line").alias("turn"), F.col("text").alias("line_text"))


@_query("""SELECT l_suppkey AS doc_id, count(*) - count(DISTINCT l_partkey) AS duplicate_xrefs, count(DISTINCT l_partkey) AS unique_images FROM lineitem GROUP BY 1""")
def image_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as images on pages: the same part on several pages is one image."""
    image = F.struct(F.col("l_partkey").cast("int").alias("xref"), F.array().cast("array<double>").alias("bbox"), F.lit(10).alias("width"), F.lit(10).alias("height"))
    pages = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").cast("int").alias("page")).agg(F.collect_list(image).alias("images"))
    images, extra = vision.unique_images(pages)
    return images.groupBy("doc_id").agg(F.count(F.lit(1)).alias("unique_images")).join(extra, "doc_id")


@_query("""WITH b AS (SELECT page_id, count(*) AS n, sum(length(x)) AS c FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h1|p|b|li|a)(?:[ \t\r\n][^>]*)?>([^<]+)', 1)) AS x FROM pages) GROUP BY 1)
SELECT page_id AS doc_id, 1::BIGINT AS n_pages, c::BIGINT AS chars, n::INTEGER AS n_spans FROM b""")
def document_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = sources.html_blocks(_read(spark, sf_dir, "pages"))
    none, box = F.lit(None), F.array(*[F.lit(float(v)) for v in (0, 0, 1, 1)])
    span = F.struct("text", box.alias("bbox"), F.lit(10.0).alias("size"), F.col("tag").alias("font"), F.lit(0).alias("color"), F.lit(0).alias("flags"), none.cast("double").alias("ascender"), none.cast("double").alias("descender"))
    line = F.struct(box.alias("bbox"), F.array().cast("array<double>").alias("dir"), F.lit(0).alias("wmode"), F.array(span).alias("spans"))
    block = F.struct(F.lit(0).alias("type"), box.alias("bbox"), F.lit(0).alias("number"), F.array(line).alias("lines"))
    pages = blocks.groupBy("doc_id").agg(F.collect_list(block).alias("blocks")).withColumns({"page": F.lit(0), "rect": F.array(*[F.lit(float(v)) for v in (0, 0, 595, 842)]), "images": F.array().cast(f"array<{schema.IMAGE}>"), "tables": F.array().cast(f"array<{schema.TABLE}>"), "drawings_count": F.lit(0)})
    toc = spark.createDataFrame([], "doc_id long, pos int, lvl int, title string, page int")
    n = validate.spans_of(pages).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_spans"))
    return validate.inspect(pages, toc).join(n, "doc_id").select("doc_id", F.col("pages").alias("n_pages"), "chars", "n_spans")


@_query("""SELECT p_brand AS t, i::INTEGER AS index, (i % 10)::INTEGER AS "row", (i // 10)::INTEGER AS col FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)""")
def grid_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as tables whose flat cells, their parts, run down the columns while their grid runs along the rows."""
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    rows = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("t"), i.alias("index"))
    rows = rows.select("t", "index", (F.col("index") % 10).alias("r"), F.floor(F.col("index") / 10).cast("int").alias("c"))
    box = F.array(F.col("c") * 10.0, F.col("r") * 5.0, F.col("c") * 10.0 + 10, F.col("r") * 5.0 + 5)
    flat = rows.select("t", "index", box.alias("bbox"))
    slots = rows.select("t", F.col("r").alias("row"), F.col("c").alias("col"), F.transform(box, lambda x: x + 1e-6).alias("bbox"))
    return spatial.assign_grid(flat, slots, ["t"]).select("t", "index", "row", "col")


@_query("""WITH g AS (SELECT l_returnflag, l_linenumber::VARCHAR AS num, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY num) AS rn FROM g)
SELECT l_returnflag, string_agg(CASE WHEN n > 1 THEN num || 'x' || n ELSE num END, ', ' ORDER BY num) AS details FROM r WHERE rn <= 10 GROUP BY 1""")
def counter_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").cast("string").alias("num")).agg(F.count(F.lit(1)).alias("n"))
    return validate.counter_details(rows, ["l_returnflag"], "num", "n")


@_query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS cut FROM events),
n AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts)::TIMESTAMP AS session_start, count(*) AS n FROM n GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    got = streaming.sessions(rows, "at", "1 day", keys=("user_id",), n=F.count(F.lit(1)))
    return got.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@_query(f"""SELECT p_partkey, list_max(list_filter(list_transform(range(0, 13), lambda i: 12 - i * 0.5::DOUBLE), lambda z: ceil(length(p_name) / greatest(floor((p_size + 20) / (z * 0.56::DOUBLE)), 1)) * z * 1.2::DOUBLE <= 40)) AS size FROM ({_PART})""")
def fit_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    room = F.array(F.lit(0.0), F.lit(0.0), (F.col("p_size") + 20).cast("double"), F.lit(40.0))
    return _parts(spark, sf_dir).select("p_partkey", layout.fit_size(F.col("p_name"), room, F.lit(12.0), F.lit(6.0)).alias("size"))


def _laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as segments, 20 to a page, one below the other."""
    y = (F.col("p_partkey") % 20) * 30.0
    box = F.array(F.lit(50.0), y, 50.0 + F.col("p_size") * 4, y + 12)
    kind = F.element_at(F.array(*map(F.lit, ("paragraph", "heading", "caption_fig", "listItem"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    parts = batching.spread(_read(spark, sf_dir, "part"), "p_brand", F.floor(F.col("p_partkey") / 20))
    return parts.select(F.col("p_brand").alias("doc_id"), F.floor(F.col("p_partkey") / 20).cast("int").alias("page"), F.col("p_partkey").alias("id"), kind.alias("type"), box.alias("bbox"), F.lit(None).cast("array<double>").alias("layout_bbox"), F.lit(10.0).alias("size"), F.lit("Body").alias("font"), F.lit(None).cast("int").alias("table_idx"), F.lit(None).cast("int").alias("row"), F.col("p_name").alias("text"), F.concat_ws(" ", "p_name", "p_type", "p_name").alias("ru"))


@_query()
def layout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.report(layout.plan(_laid(spark, sf_dir), EN), EN).drop("overflow", "source_retained")


@_query("""WITH s AS (SELECT p_brand, p_partkey AS id, p_partkey // 20 AS page, p_partkey % 4 AS k, 50.0 AS x0, (p_partkey % 20) * 30.0 AS y0, 50.0 + p_size * 4 AS x1, (p_partkey % 20) * 30.0 + 12 AS y1 FROM part),
c AS (SELECT *, min(x0) OVER w AS cx0, max(x1) OVER w AS cx1, CASE k WHEN 1 THEN 9.0 WHEN 2 THEN 8.0 ELSE 8.5 END AS low FROM s WINDOW w AS (PARTITION BY p_brand, page)),
g AS (SELECT *, CASE WHEN k = 2 THEN cx0 ELSE x0 - 1 END AS a, CASE WHEN k = 2 THEN cx1 WHEN x1 + 1 - (x0 - 1) < greatest(1, cx1 - cx0) * 0.8 THEN cx1 ELSE x1 + 1 END AS b FROM c),
n AS (SELECT g.p_brand, g.id, g.a, g.b, g.low, g.y0, g.y1, min(o.y0) FILTER (WHERE o.id <> g.id AND o.y0 >= g.y1 - 0.5 AND o.x0 < g.b AND o.x1 > g.a) AS blk FROM g JOIN g o ON g.p_brand = o.p_brand AND g.page = o.page GROUP BY ALL),
d AS (SELECT *, greatest(y1, least(greatest(y1 + 2, y0 + low * 1.55), coalesce(blk - 0.5, greatest(y1 + 2, y0 + low * 1.55)))) AS y2 FROM n)
SELECT p_brand AS doc_id, id, greatest(12, trunc(greatest(1, b - a)::DOUBLE / (low::DOUBLE * 0.56::DOUBLE) * greatest(1, trunc(greatest(low::DOUBLE * 1.2::DOUBLE, (y2 - y0)::DOUBLE) / (low::DOUBLE * 1.2::DOUBLE))) * 0.9::DOUBLE))::INTEGER AS max_chars FROM d""")
def layout_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No part has another to its right here, as all begin at one edge."""
    return spatial.budgets(_laid(spark, sf_dir), EN, ["doc_id", "page"]).select("doc_id", "id", "max_chars")


@_query("""SELECT conv_id AS doc_id, count(*) AS n_items, count(*) FILTER (WHERE turn = 0) AS n_first FROM conversations GROUP BY 1""")
def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of requests holds every segment once."""
    rows = translate.prepare(sources.conversation_segments(_read(spark, sf_dir, "conversations")), EN, [("the", "die")])
    rows = rows.withColumn("batch", F.lit(0)).withColumn("told", F.array().cast("array<string>"))
    asked = translate.requests(rows, EN, [("the", "die")])
    items = F.from_json("request", "struct<items: array<struct<id: string, source: string>>>")["items"]
    return asked.select("doc_id", F.size(items).cast("long").alias("n_items"), F.size(F.filter(items, lambda x: x["id"] == "0")).cast("long").alias("n_first"))
