"""The registered queries of the library itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill import sources, streaming
from textmill.config import Settings
from textmill.functions import geometry as G
from textmill.functions import sql as sqlfunctions
from textmill.functions import text as T
from textmill.operators import batching, cache, context, glossary, layout, segment, spatial, translate, validate

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


_TYPE = r"""CASE
  WHEN regexp_matches(t, '^Chapter\s+(\d+)\.?\s*(.*)$') OR regexp_matches(t, '^(\d+(?:\.\d+){0,2})\s+(.+)$') OR regexp_matches(t, '^(\d+(?:\.\d+){0,2})\s*$') THEN 'heading'
  WHEN regexp_matches(t, 'Fig\.?\s*(\d+-\d+)') THEN 'caption_fig'
  WHEN regexp_matches(t, 'Table\s*(\d+-\d+)') THEN 'caption_tab'
  WHEN regexp_matches(t, '^\s*(\d+)\.\s+(.*)$') OR regexp_matches(t, '^\s*(?:[•●○▪◆□]\s*|[-–]\s+)(.*)$') THEN 'listItem'
  ELSE 'paragraph' END"""
_SECTION = r"""CASE
  WHEN regexp_matches(t, '^Chapter\s+(\d+)\.?\s*(.*)$') THEN 'ch' || regexp_extract(t, '^Chapter\s+(\d+)', 1)
  WHEN regexp_matches(t, '^(\d+(?:\.\d+){0,2})\s+(.+)$') THEN regexp_extract(t, '^(\d+(?:\.\d+){0,2})\s', 1) END"""
_LINES = "SELECT doc_id, lang, x AS text, trim(x, ' ' || chr(9) || chr(13)) AS t FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS x FROM documents)"
_BLOCKS = """SELECT page_id AS doc_id, pos - 1 AS pos, b[pos] AS text, trim(b[pos], ' ' || chr(9) || chr(10) || chr(13)) AS t FROM (
  SELECT page_id, b, unnest(range(1, len(b) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<(?:h1|p|b|li|a)(?:[ \t\r\n][^>]*)?>([^<]+)', 1) AS b FROM pages))"""
_WRAPPED = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')"


@_query(f"SELECT lang, {_TYPE} AS type, count(*) AS n_segments, sum(length(text))::BIGINT AS n_chars FROM ({_LINES}) WHERE t <> '' GROUP BY ALL")
def segment_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = segment.line_segments(docs.withColumn("doc_id", F.struct("doc_id", "lang")), EN)
    return rows.groupBy("doc_id.lang", "type").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.length("text")).alias("n_chars"))


@_query(f"SELECT doc_id, {_TYPE} AS type, count(*) AS n_segments FROM ({_BLOCKS}) WHERE t <> '' GROUP BY ALL")
def html_block_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.html_blocks(_read(spark, sf_dir, "pages")).where(T.strip(F.col("text")) != "")
    rows = rows.withColumns({c: F.lit(None).cast("int") for c in ("table_idx", "cell_idx")})
    return segment.histogram(segment.typed(rows, None, EN), "doc_id")


@_query(f"""SELECT doc_id, pos::INTEGER AS pos, type, last_value(CASE WHEN type = 'heading' THEN sec END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section_id
FROM (SELECT doc_id, pos, {_TYPE} AS type, {_SECTION} AS sec FROM ({_BLOCKS}) WHERE t <> '')""")
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.html_blocks(_read(spark, sf_dir, "pages")).where(T.strip(F.col("text")) != "")
    rows = rows.withColumns({c: F.lit(None).cast("int") for c in ("table_idx", "cell_idx")})
    return segment.carry_section(segment.typed(rows, None, EN), ["pos"]).select("doc_id", "pos", "type", "section_id")


@_query(f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::INTEGER AS id, {_TYPE} AS type, text FROM ({_BLOCKS}) WHERE t <> ''""")
def segment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole segmenter, over pages whose blocks are laid out one below the other."""
    blocks = sources.html_blocks(_read(spark, sf_dir, "pages"))
    y = F.col("pos") * 20.0
    box = F.array(F.lit(40.0), y, F.lit(300.0), y + 12)
    none = F.lit(None)
    span = F.struct(F.col("text"), box.alias("bbox"), F.lit(10.0).alias("size"), F.lit("Body").alias("font"), F.lit(0).alias("color"), F.lit(0).alias("flags"), none.cast("double").alias("ascender"), none.cast("double").alias("descender"))
    line = F.struct(box.alias("bbox"), F.array(F.lit(1.0), F.lit(0.0)).alias("dir"), F.lit(0).alias("wmode"), F.array(span).alias("spans"))
    block = F.struct(F.lit(0).alias("type"), box.alias("bbox"), F.col("pos").alias("number"), F.array(line).alias("lines"))
    pages = blocks.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    from textmill import schema

    pages = pages.withColumns({"page": F.lit(0), "tables": F.array().cast(f"array<{schema.TABLE}>")})
    return segment.segments(pages, None, EN).select("doc_id", "id", "type", "text")


@_query(f"""WITH c AS (SELECT conv_id, turn, {_WRAPPED} AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, max_by(b.w, b.turn) AS previous_text FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.w <> '' AND b.w <> a.w GROUP BY ALL),
n AS (SELECT a.conv_id, a.turn, min_by(b.w, b.turn) AS next_text FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.w <> '' AND b.w <> a.w GROUP BY ALL)
SELECT c.conv_id, c.turn::INTEGER AS turn, left(previous_text, 220) AS previous_text, left(next_text, 220) AS next_text FROM c LEFT JOIN p USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn)""")
def neighbor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.contexts(sources.conversation_segments(_read(spark, sf_dir, "conversations")), EN)
    return rows.select(F.col("doc_id").alias("conv_id"), F.col("id").alias("turn"), "previous_text", "next_text")


@_query(f"SELECT doc_id, length(w)::INTEGER AS n_chars, sha256(w) AS digest FROM (SELECT doc_id, {_WRAPPED} AS w FROM documents)")
def soft_wrap_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.soft_wraps(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.length(w).alias("n_chars"), F.sha2(w.cast("binary"), 256).alias("digest"))


@_query("SELECT page_id, length(t)::INTEGER AS n_chars, sha256(t) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(html, '^(\\s*)[•●○◌◦◆◇■□▪▫▶▷◀◁▲△▼▽◄►◅▻]', '\\1•', 'gm'), '[\\x{f000}-\\x{f8ff}]', '', 'g') AS t FROM pages)")
def marker_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.normalize_markers(F.col("html"))
    return _read(spark, sf_dir, "pages").select("page_id", F.length(t).alias("n_chars"), F.sha2(t.cast("binary"), 256).alias("digest"))


@_query("""SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g'))::INTEGER AS squashed, length(trim(regexp_replace(text, '\\s+', ' ', 'g')))::INTEGER AS compact,
length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))::INTEGER AS html, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))::INTEGER AS meaningful FROM documents""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _read(spark, sf_dir, "documents").select("doc_id", F.length(T.squash(t)).alias("squashed"), T.compact_length(t).alias("compact"), F.length(T.escape_html(t, quotes=False)).alias("html"), T.meaningful_chars(t).alias("meaningful"))


_BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_LINK = r"(?i)https?://[^\t-\r\x1c-\x20\x{85}\p{Z}<>()]+"
_RUN = r"[A-Za-z0-9]+(?:[-_/.:][A-Za-z0-9]+)*"
_CPU = r"'(^|[^A-Za-z0-9])([iI][3579])-([0-9]+)($|[^A-Za-z0-9])', '\1\2 \3\4', 'g'"


# Runs of letters and digits with single separators between; a code is a run from its first part that begins with a letter, if
# a digit follows and no link.  A number right after a code's last part goes on in it.
@_query(rf"""WITH a AS (SELECT regexp_replace(regexp_replace(coalesce(text, ''), {_CPU}), {_CPU}) AS t FROM documents),
b AS (SELECT regexp_replace(t, '([A-Za-z]){_BLANK}+([0-9])', '\1\2', 'g') AS t FROM a),
c AS (SELECT regexp_replace(t, '{_LINK}', chr(1), 'g') AS t FROM b),
r AS (SELECT string_split_regex(t, '{_RUN}') AS g, regexp_extract_all(t, '{_RUN}') AS m FROM c),
e AS (SELECT g, m, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN regexp_matches(g[i + 1], '^[-_/.:]?\x01') THEN '' ELSE regexp_extract(m[i], '(?:^|[-_/.:])([A-Za-z].*)$', 1) END) AS k FROM r),
f AS (SELECT g, m, list_transform(k, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN x ELSE '' END) AS k FROM e),
h AS (SELECT array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i > len(m) THEN '' WHEN k[i] = '' THEN m[i]
  ELSE left(m[i], length(m[i]) - length(k[i])) || chr(1) || CASE WHEN regexp_matches(k[i], '[-_/.:][0-9]{{1,32}}$') THEN chr(2) ELSE '' END END), '') AS t FROM f),
n AS (SELECT regexp_replace(t, '\x02(?:[.,][0-9]+)*', '', 'g') AS t FROM h),
o AS (SELECT 'url' AS kind, lower(regexp_replace(x, '[.,;!?:]+$', '')) AS token FROM (SELECT unnest(regexp_extract_all(t, '{_LINK}')) AS x FROM b)
  UNION ALL SELECT 'code', lower(x) FROM (SELECT unnest(k) AS x FROM f) WHERE x <> ''
  UNION ALL SELECT 'num', replace(x, ',', '.') FROM (SELECT unnest(regexp_extract_all(t, '(?:^|[^A-Za-z0-9])([0-9]+(?:[.,][0-9]+)*)', 1)) AS x FROM n))
SELECT kind, count(*) AS n, count(DISTINCT token) AS n_distinct FROM o GROUP BY 1""")
def critical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select(F.explode(T.critical_tokens(F.col("text"))).alias("token"))
    return rows.groupBy(F.element_at(F.split("token", ":"), 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token").alias("n_distinct"))


@_query("""WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER o AS next_role, lead(text) OVER o AS answer FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text, answer FROM t WHERE role = 'user' AND next_role = 'assistant'),
a AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS x FROM p) GROUP BY ALL),
b AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(answer, ' ')) AS x FROM p) GROUP BY ALL)
SELECT p.conv_id, p.turn, coalesce(sum(greatest(a.n - coalesce(b.n, 0), 0)), 0)::INTEGER AS n_lost FROM p LEFT JOIN a USING (conv_id, turn) LEFT JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.x = b.x GROUP BY ALL""")
def token_loss_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each user turn that the assistant turn right after it lacks, as bags."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    rows = _read(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(after), "answer": F.lead("text").over(after)})
    none = F.array().cast("array<string>")
    words = [F.coalesce(F.split(c, " ", -1), none) for c in ("text", "answer")]
    return rows.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.size(T.bag_minus(*words)).alias("n_lost"))


@_query("""WITH a AS (SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS num FROM documents), b AS (SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS num FROM benchmark),
x AS (SELECT num, count(*) AS n FROM a GROUP BY 1), y AS (SELECT num, count(*) AS n FROM b GROUP BY 1)
SELECT coalesce(x.num, y.num) AS num, greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0)::BIGINT AS missing, greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0)::BIGINT AS extra
FROM x FULL JOIN y ON x.num = y.num WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def anchor_bag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = lambda t: _read(spark, sf_dir, t).select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("num"))
    return validate.bag_difference(numbers("documents"), numbers("benchmark"), ["num"])


_TERMS = [("th", "b"), ("the the", "a"), ("the", "c"), ("ción", "d"), ("schl", "e")]


def _terms_sql() -> str:
    ordered = sorted(_TERMS, key=lambda x: -len(x[0]))
    out = "SELECT text AS s0 FROM documents"
    for i, (a, _) in enumerate(ordered):
        held = ", ".join(f"h{j}" for j in range(i))
        out = f"SELECT {held + ', ' if held else ''}contains(s{i}, '{a}') AS h{i}, replace(s{i}, '{a}', repeat(chr(1), {len(a)})) AS s{i + 1} FROM ({out})"
    return " UNION ALL ".join(f"SELECT '{a}' AS source, '{b}' AS target, count(*) AS n_docs FROM ({out}) WHERE h{i}" for i, (a, b) in enumerate(ordered))


@_query(f"SELECT * FROM ({_terms_sql()}) WHERE n_docs > 0")
def glossary_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select(F.explode(glossary.relevant(F.array("text"), _TERMS)).alias("t"))
    return rows.groupBy("t.source", "t.target").agg(F.count(F.lit(1)).alias("n_docs"))


@_query("SELECT sha256(text || chr(0) || 'm' || chr(0) || lang) AS key, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def cache_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").withColumn("key", cache.key(F.col("text"), "m", F.col("lang")))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@_query("""WITH c AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1)
SELECT lang, count(*) FILTER (WHERE q > 0) AS n_hits, count(*) FILTER (WHERE q IS NULL OR q = 0) AS n_pending FROM documents LEFT JOIN c USING (doc_id) GROUP BY lang""")
def cache_hit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.lit("x").alias("dst"), F.col("quality").alias("accepts_review"), F.col("quality").alias("ts"))
    rows = cache.lookup(_read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "cache_key"), cache.current(log))
    return rows.groupBy("lang").agg(F.count_if(F.col("cached").isNotNull()).alias("n_hits"), F.count_if(F.col("cached").isNull()).alias("n_pending"))


@_query("""WITH RECURSIVE o AS (SELECT conv_id, length(text) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
r AS (SELECT conv_id, rn, 0 AS batch, 1 AS items, n_chars AS chars, n_chars FROM o WHERE rn = 1
  UNION ALL SELECT o.conv_id, o.rn, r.batch + (r.items >= 3 OR r.chars + o.n_chars > 1200)::INTEGER, CASE WHEN r.items >= 3 OR r.chars + o.n_chars > 1200 THEN 1 ELSE r.items + 1 END,
    CASE WHEN r.items >= 3 OR r.chars + o.n_chars > 1200 THEN o.n_chars ELSE r.chars + o.n_chars END, o.n_chars FROM r JOIN o ON o.conv_id = r.conv_id AND o.rn = r.rn + 1)
SELECT conv_id, batch::INTEGER AS batch, count(*) AS n_items, sum(n_chars)::BIGINT AS n_chars FROM r GROUP BY ALL""")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation, which is its document; batches never reach over two of them."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n_chars"))
    rows = batching.greedy_batches(rows, "conv_id", "turn", F.col("n_chars"), 3, 1200)
    return rows.groupBy("conv_id", "batch").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_chars").alias("n_chars"))


@_query("""WITH u AS (SELECT text, min(doc_id) AS first_doc FROM documents GROUP BY 1), n AS (SELECT first_doc, row_number() OVER (ORDER BY first_doc) - 1 AS rn FROM u)
SELECT (rn // 64)::INTEGER AS chunk, count(*) AS n_texts, min(first_doc) AS first_doc FROM n GROUP BY 1""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = _read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("first_doc"))
    return batching.chunks(unique.select("first_doc"), ["first_doc"], 64).groupBy("chunk").agg(F.count(F.lit(1)).alias("n_texts"), F.min("first_doc").alias("first_doc"))


@_query("SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2 THEN 'T: ' || text ELSE text END AS ru FROM conversations")
def limit_keep_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    done = rows.select("conv_id", "turn", F.concat(F.lit("T: "), "text").alias("dst"))
    return batching.limit_keep_shape(rows, done, "conv_id", "turn", 2).select("conv_id", "turn", "ru")


@_query("SELECT conv_id, count(*) AS n_expected, count(*) FILTER (WHERE turn <> 1) AS n_matched FROM conversations GROUP BY 1")
def response_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that give every turn once, but turn 1 twice, and one that nobody asked for."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("string").alias("sid"), "text")
    item = F.struct(F.col("sid").alias("id"), F.col("text").alias("translation"))
    twice = F.when(F.col("sid") == "1", F.array(item, item)).otherwise(F.array(item))
    items = F.concat(F.flatten(F.collect_list(twice)), F.array(F.struct(F.lit("999").alias("id"), F.lit("?").alias("translation"))))
    answers = turns.groupBy("conv_id").agg(F.to_json(F.struct(items.alias("items"))).alias("response"))
    met = translate.match_items(turns, answers, ["conv_id"])
    return met.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_expected"), F.count("translation").alias("n_matched"))


@_query("""WITH s AS (SELECT l_orderkey, l_returnflag, l_linestatus, sum(l_quantity) AS w, min(l_linenumber) AS first_at FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, first_at, l_returnflag, l_linestatus) AS rn FROM s) SELECT l_orderkey, l_returnflag, l_linestatus FROM r WHERE rn = 1""")
def dominant_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.weighted_mode(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"], F.col("l_quantity"), "l_linenumber")


@_query("""WITH s AS (SELECT l_returnflag, l_quantity, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS upto, sum(w) OVER (PARTITION BY l_returnflag) AS al FROM s)
SELECT l_returnflag, min(l_quantity) FILTER (WHERE upto > al // 2) AS median FROM r GROUP BY 1""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.weighted_median(_read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", F.col("l_linenumber"))


_BOX = "p_partkey // 500 AS page, (p_partkey * 37 % 101)::DOUBLE AS x0, (p_partkey * 53 % 103)::DOUBLE AS y0, (p_partkey * 37 % 101 + p_size)::DOUBLE AS x1, (p_partkey * 53 % 103 + 4)::DOUBLE AS y1"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("p_partkey") * 37 % 101).cast("double"), (F.col("p_partkey") * 53 % 103).cast("double")
    return _read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.floor(F.col("p_partkey") / 500).alias("page"), F.array(x, y, x + F.col("p_size"), y + 4.0).alias("bbox"))


@_query(f"""WITH b AS (SELECT p_partkey, {_BOX} FROM part), c AS (SELECT i AS cell_idx, (i % 10 * 10)::DOUBLE AS cx, (i // 10 * 10)::DOUBLE AS cy FROM range(0, 100) t(i)),
m AS (SELECT p_partkey, min(cell_idx) AS cell_idx FROM b JOIN c ON (x0 + x1) / 2 BETWEEN cx - 1 AND cx + 11 AND (y0 + y1) / 2 BETWEEN cy - 1 AND cy + 11 AND (x0 + x1) / 2 BETWEEN -1 AND 101 AND (y0 + y1) / 2 BETWEEN -1 AND 101 GROUP BY 1)
SELECT b.p_partkey, CASE WHEN (x0 + x1) / 2 BETWEEN -1 AND 101 AND (y0 + y1) / 2 BETWEEN -1 AND 101 THEN 0 ELSE -1 END AS table_idx, coalesce(m.cell_idx, -1)::INTEGER AS cell_idx, coalesce(m.cell_idx // 10, -1)::INTEGER AS "row", coalesce(m.cell_idx % 10, -1)::INTEGER AS "col" FROM b LEFT JOIN m USING (p_partkey)""")
def cell_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in a grid of 100 cells of equal size: the first of equals counts."""
    boxes = _boxes(spark, sf_dir).select("page", F.col("p_partkey").alias("box_id"), "bbox")
    pages = boxes.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("id"))
    i = F.col("id")
    x, y = (i % 10 * 10).cast("double"), (F.floor(i / 10) * 10).cast("double")
    cells = pages.select("page", F.lit(0).alias("table_idx"), F.array(*map(F.lit, (0.0, 0.0, 100.0, 100.0))).alias("table_bbox"), i.alias("cell_pos"), i.alias("cell_idx"), F.floor(i / 10).cast("int").alias("row"), (i % 10).alias("col"), F.array(x, y, x + 10, y + 10).alias("cell_bbox"))
    return spatial.locate(boxes, cells, ["page"]).select(F.col("box_id").alias("p_partkey"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("table_idx", "cell_idx", "row", "col")])


@_query(f"""WITH b AS (SELECT p_partkey, p_brand, {_BOX} FROM part)
SELECT a.p_partkey, coalesce(bool_or(o.x0 >= a.x1 - 1 AND o.y0 < a.y1 AND o.y1 > a.y0), false) AS has_right, min(o.y0) FILTER (WHERE o.y0 >= a.y1 - 0.5 AND o.x0 < a.x1 AND o.x1 > a.x0) AS blocker
FROM b a LEFT JOIN b o ON a.p_brand = o.p_brand AND a.page = o.page AND a.p_partkey <> o.p_partkey GROUP BY 1""")
def nearest_blocker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select("p_brand", "page", F.col("p_partkey").alias("id"), F.col("bbox").alias("r"), F.col("bbox").alias("box"))
    return spatial.neighbours(rows, ["p_brand", "page"]).select(F.col("id").alias("p_partkey"), "has_right", "blocker")


@_query(f"""WITH b AS (SELECT p_partkey, p_brand, {_BOX} FROM part),
m AS (SELECT a.p_partkey FROM b a JOIN b o ON a.p_brand = o.p_brand AND a.page = o.page WHERE
 (least((a.x1 - a.x0) * (a.y1 - a.y0), (o.x1 - o.x0) * (o.y1 - o.y0)) > 0 AND greatest(least(a.x1, o.x1) - greatest(a.x0, o.x0), 0) * greatest(least(a.y1, o.y1) - greatest(a.y0, o.y0), 0) / least((a.x1 - a.x0) * (a.y1 - a.y0), (o.x1 - o.x0) * (o.y1 - o.y0)) >= 0.25)
 OR ((a.x0 + a.x1) / 2 BETWEEN o.x0 - 1 AND o.x1 + 1 AND (a.y0 + a.y1) / 2 BETWEEN o.y0 - 1 AND o.y1 + 1))
SELECT p_partkey, count(*) AS n_matches FROM m GROUP BY 1""")
def rect_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir).select("p_brand", "page", "p_partkey", "bbox")
    return spatial.matches(boxes, boxes, ["p_brand", "page"]).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_matches"))


@_query("""WITH e AS (SELECT user_id, event_id, epoch(ts) AS s, epoch(ts) + abs(value) AS x FROM events),
c AS (SELECT *, CASE WHEN s - max(x) OVER (PARTITION BY user_id ORDER BY s, x, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 86400 THEN 1 ELSE 0 END AS cut FROM e),
n AS (SELECT user_id, sum(cut) OVER (PARTITION BY user_id ORDER BY s, x, event_id ROWS UNBOUNDED PRECEDING) AS cl FROM c)
SELECT user_id, cl::INTEGER AS "cluster", count(*) AS n_events FROM n GROUP BY ALL""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = _read(spark, sf_dir, "events").select("user_id", start.alias("s"), (start + F.abs("value")).alias("x"))
    return batching.gap_clusters(rows, ["user_id"], "s", "x", 86400.0).groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n_events"))


@_query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity, greatest(min(l_quantity) OVER w, max(l_quantity) OVER w - 5) AS target, count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, CASE WHEN n >= 2 THEN greatest(3, least(l_quantity, target)) ELSE l_quantity END AS size FROM g""")
def harmonize_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("size"), F.lit(3.0).alias("min_size"))
    return batching.harmonize(rows, ["l_orderkey"], max_shrink=5.0).select("l_orderkey", "l_linenumber", "size")


_FONTS = [("a/DejaVuSans.ttf", "DejaVu Sans", True), ("a/DejaVuSans-Bold.ttf", "DejaVu Sans Bold", True), ("a/DejaVuSerif.ttf", "DejaVu Serif", True), ("a/DejaVuSansMono.ttf", "DejaVu Sans Mono", True), ("a/Hidden.ttf", "Times Bold", False)]


def _traits_sql(c: str) -> str:
    from textmill.config import BOLD, ITALIC, MONO, SANS, SERIF

    m = lambda words: f"regexp_matches(lower({c}), '{'|'.join(w.replace('-', '[-]') for w in words)}')"
    return f"CASE WHEN {m(MONO)} THEN 'mono' WHEN {m(SERIF)} THEN 'serif' WHEN {m(SANS)} THEN 'sans' ELSE 'unknown' END AS family, {m(BOLD)} AS bold, {m(ITALIC)} AS italic"


_FONT_ROWS = ", ".join(f"({i}, '{p}', '{n} {p.split('/')[-1]}')" for i, (p, n, ok) in enumerate(_FONTS) if ok)


@_query(f"""WITH n AS (SELECT DISTINCT p_type || ' ' || p_brand || CASE WHEN p_size > 25 THEN ' Bold' ELSE ' Roman' END AS font FROM part),
o AS (SELECT font, {_traits_sql('font')} FROM n), f AS (SELECT pos, path, {_traits_sql('nm')} FROM (VALUES {_FONT_ROWS}) t(pos, path, nm)),
s AS (SELECT font, path, pos, CASE WHEN o.family <> 'unknown' THEN CASE WHEN o.family = f.family THEN 100 WHEN f.family = 'unknown' THEN 20 ELSE -50 END ELSE CASE f.family WHEN 'sans' THEN 40 WHEN 'serif' THEN 20 WHEN 'mono' THEN 5 ELSE 0 END END
 + CASE WHEN o.bold = f.bold THEN 30 WHEN o.bold THEN -10 ELSE 0 END + CASE WHEN o.italic = f.italic THEN 20 WHEN o.italic THEN -5 ELSE 0 END AS score FROM o, f),
r AS (SELECT *, row_number() OVER (PARTITION BY font ORDER BY score DESC, pos) AS rn FROM s) SELECT font, path, score::INTEGER AS score FROM r WHERE rn = 1""")
def font_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_type", F.lit(" "), "p_brand", F.when(F.col("p_size") > 25, " Bold").otherwise(" Roman"))
    names = _read(spark, sf_dir, "part").select(name.alias("font")).distinct()
    return layout.match_fonts(names, sources.font_table(spark, _FONTS)).select("font", "path", "score")


@_query(f"""WITH h AS (SELECT doc_id, pos, text, regexp_replace(trim(regexp_replace(regexp_replace(text, '[.\\s]*[0-9]+\\s*$', ''), '\\.{{2,}}', '', 'g')), '\\s+', '', 'g') AS k FROM ({_BLOCKS})),
l AS (SELECT doc_id, k, min_by('T: ' || text, pos) AS target FROM h WHERE k <> '' GROUP BY ALL),
e AS (SELECT doc_id, pos, text || ' ..... 7' AS title FROM h),
t AS (SELECT *, regexp_replace(regexp_replace(title, '\\.{{2,}}', '', 'g'), '\\s+', '', 'g') AS k1, regexp_replace(regexp_replace(trim(regexp_replace(title, '\\.{{2,}}', '', 'g')), '[.\\s]*[0-9]+\\s*$', ''), '\\s+', '', 'g') AS k2 FROM e)
SELECT t.doc_id, t.pos::INTEGER AS pos, coalesce(a.target, b.target, t.title) AS target FROM t LEFT JOIN l a ON a.doc_id = t.doc_id AND a.k = t.k1 LEFT JOIN l b ON b.doc_id = t.doc_id AND b.k = t.k2""")
def toc_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.html_blocks(_read(spark, sf_dir, "pages")).select("doc_id", "pos", "text")
    headings = rows.select("doc_id", F.col("pos").alias("id"), F.lit("heading").alias("type"), "text", F.concat(F.lit("T: "), "text").alias("ru"))
    toc = rows.select("doc_id", "pos", F.concat("text", F.lit(" ..... 7")).alias("title"))
    return context.translate_toc(toc, context.heading_lookup(headings)).select("doc_id", "pos", "target")


@_query("""SELECT lang, sum(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')))::BIGINT AS meaningful, sum(length(regexp_replace(text, '[^\\x{0400}-\\x{052f}]', '', 'g')))::BIGINT AS cyrillic,
sum(length(regexp_replace(text, '[^\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]', '', 'g')))::BIGINT AS han FROM documents GROUP BY 1""")
def script_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _read(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(T.meaningful_chars(t)).alias("meaningful"), F.sum(T.target_chars(t, "ru")).alias("cyrillic"), F.sum(T.han_chars(t)).alias("han"))


@_query("""WITH s AS (SELECT source, doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS m, 6 + n_chars % 5 AS size, 6 + n_chars * 7 % 5 AS src_size, (n_chars % 800)::DOUBLE AS y, text FROM documents),
t AS (SELECT *, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS n FROM s),
b AS (SELECT *, size + 0.05 < 8 AND NOT ((y <= 842 * 0.05 OR y + 10 >= 842 * 0.95) AND (n <= 3 OR regexp_full_match(trim(text), '(?i)([0-9]+|[ivxlcdm]+)')))
  AND NOT (src_size <= 8.25 AND (regexp_full_match(trim(text), '(?i)([0-9]+|[ivxlcdm]+)') OR m <= 3 OR ((y <= 842 * 0.07 OR y + 10 >= 842 * 0.93) AND m <= 40))) AS bad FROM t WHERE n > 0)
SELECT source AS doc_id, sum(n)::BIGINT AS target_chars, coalesce(sum(n) FILTER (WHERE bad), 0)::BIGINT AS bad_chars, min(size)::DOUBLE AS observed_min, coalesce(sum(n) FILTER (WHERE bad), 0) >= 4 AS failed FROM b GROUP BY 1""")
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text a span on a page of its own, with a source span in its place of another size."""
    y = (F.col("n_chars") % 800).cast("double")
    rows = _read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.col("doc_id").alias("id"), "text", F.array(F.lit(40.0), y, F.lit(90.0), y + 10).alias("bbox"), F.lit(842.0).alias("page_height"), "n_chars")
    out = rows.withColumn("size", (6 + F.col("n_chars") % 5).cast("double"))
    src = rows.withColumn("size", (6 + F.col("n_chars") * 7 % 5).cast("double"))
    got = validate.readability(out, src, Settings(source_lang="en", target_lang="xx"))
    return got.select("doc_id", "target_chars", "bad_chars", "observed_min", "failed")


@_query("""WITH a AS (SELECT page_id, length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[^\\p{L}\\p{N}]', '', 'g')) AS s,
 length(regexp_replace(coalesce(array_to_string(regexp_extract_all(html, '<li>([^<]+)', 1), ' '), ''), '[^\\p{L}\\p{N}]', '', 'g')) AS o FROM pages)
SELECT page_id AS doc_id, s::INTEGER AS src_chars, o::INTEGER AS out_chars, CASE WHEN s >= 4 AND o = 0 THEN 'empty' ELSE 'thinned' END AS loss FROM a WHERE (s >= 4 AND o = 0) OR (s >= 20 AND o < s * 0.2::DOUBLE)""")
def page_text_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which only list items came through."""
    pages = _read(spark, sf_dir, "pages")
    text = {"src": F.regexp_replace("html", "<[^>]*>", ""), "out": F.array_join(F.regexp_extract_all("html", F.lit("<li>([^<]+)"), F.lit(1)), " ")}
    side = {k: validate.page_stats(pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("page"), v.alias("text"))) for k, v in text.items()}
    return validate.page_losses(side["src"], side["out"]).select("doc_id", "src_chars", "out_chars", "loss")


def _stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.conversation_segments(_read(spark, sf_dir, "conversations"))
    return translate.translate(rows, translate.Dictionary({"the": "THE"}), EN)


@_query("SELECT conv_id, count(*) AS ok, count(*) FILTER (WHERE trim(text) = '') AS cached, 0::BIGINT AS fail FROM conversations GROUP BY 1")
def translation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate.statistics(_stub(spark, sf_dir), ["doc_id"]).select(F.col("doc_id").alias("conv_id"), "ok", "cached", "fail")


@_query(f"""SELECT conv_id, count(*) AS n_total, count(*) FILTER (WHERE replace({_WRAPPED}, 'the', 'THE') = text) AS n_untranslated FROM conversations GROUP BY 1""")
def qa_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = translate.qa_flags(_stub(spark, sf_dir).withColumnRenamed("dst", "ru"))
    return rows.groupBy(F.col("doc_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_total"), F.count_if("untranslated").alias("n_untranslated"))


_LINE_SQL = "CASE event_id % 3 WHEN 0 THEN 'parse page ' || (event_id % 50) || '/50' WHEN 1 THEN 'ok=' || (event_id % 7) || ' cached=' || (event_id % 5) || ' fail=' || (event_id % 2) ELSE '=== ЭТАП: TRANSLATE ===' END"


@_query("""SELECT user_id AS job, CASE WHEN max(event_id) FILTER (WHERE event_id % 3 = 0) > coalesce(max(event_id) FILTER (WHERE event_id % 3 = 2), -1) THEN 'parse' WHEN max(event_id) FILTER (WHERE event_id % 3 = 2) IS NOT NULL THEN 'translate' END AS stage,
arg_max(CASE WHEN event_id % 3 = 2 THEN 0 ELSE event_id % 50 END, event_id) FILTER (WHERE event_id % 3 <> 1)::INTEGER AS progress, arg_max(event_id % 7, event_id) FILTER (WHERE event_id % 3 = 1)::INTEGER AS ok, arg_max(event_id % 5, event_id) FILTER (WHERE event_id % 3 = 1)::INTEGER AS cached FROM events GROUP BY 1""")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.expr(_LINE_SQL).alias("line"))
    return streaming.job_states(lines).select("job", "stage", "progress", "ok", "cached")


@_query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def log_ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.latest(_read(spark, sf_dir, "events"), ["user_id"], "event_id", 3).select("user_id", "event_id")


@_query("""SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    got = streaming.windowed(rows, "at", "1 day", keys=("event_type",), n=F.count(F.lit(1)))
    return got.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@_query("SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g'))::INTEGER AS n, sha256(text || chr(0) || 'm' || chr(0) || 'h') AS key FROM documents")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlfunctions.register(spark)
    _read(spark, sf_dir, "documents").createOrReplaceTempView("tm_documents")
    return spark.sql("SELECT doc_id, length(tm_squash(text)) AS n, tm_cache_key(text, 'm', 'h') AS key FROM tm_documents")


@_query("SELECT p_partkey, round((x1 - x0) * (y1 - y0), 6) AS area, (x0 + least(2, greatest((x1 - x0 - 1) / 2, 0)))::DOUBLE AS inner_x0 FROM (SELECT p_partkey, " + _BOX + " FROM part)")
def rect_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("bbox")
    return _boxes(spark, sf_dir).select("p_partkey", F.round(G.area(r), 6).alias("area"), G.inner_cell(r)[0].alias("inner_x0"))
