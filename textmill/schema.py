"""Schemas of the nested records (DDL strings)."""

RECT = "array<double>"
SPAN = f"struct<text: string, bbox: {RECT}, size: double, font: string, color: int, flags: int, ascender: double, descender: double>"
LINE = f"struct<bbox: {RECT}, dir: array<double>, wmode: int, spans: array<{SPAN}>>"
BLOCK = f"struct<type: int, bbox: {RECT}, number: int, lines: array<{LINE}>>"
CELL = f"struct<index: int, bbox: {RECT}, row: int, col: int>"
TABLE = f"struct<bbox: {RECT}, method: string, row_count: int, col_count: int, cells: array<{CELL}>>"
IMAGE = f"struct<xref: int, bbox: {RECT}, width: int, height: int>"
TOC = "array<struct<lvl: int, title: string, page: int>>"
#: One row for each page of a parsed document.
PAGE = f"doc_id string, page int, rect {RECT}, blocks array<{BLOCK}>, images array<{IMAGE}>, drawings_count int, tables array<{TABLE}>"
#: One parsed document as one JSON object.
DOCUMENT = f"meta map<string, string>, toc array<array<string>>, pages array<struct<page: int, rect: {RECT}, blocks: array<{BLOCK}>, images: array<{IMAGE}>, drawings_count: int, tables: array<{TABLE}>>>"
ANCHOR = "struct<kind: string, raw: string, num: string>"
SEGMENT = f"doc_id string, id int, type string, page int, bbox {RECT}, section_id string, anchors array<{ANCHOR}>, font string, size double, color int, flags int, table_idx int, cell_idx int, row int, col int, layout_bbox {RECT}, text string"
CACHE = "key string, src string, dst string, ts string, model string, prompt_hash string, accepts_review int"
VISION_CACHE = "key string, src_img_hash string, src_lang string, tgt_lang string, dst string, model string, prompt_version string, ts string"
REGION = f"struct<bbox: {RECT}, source_text: string, translation: string, confidence: double>"
