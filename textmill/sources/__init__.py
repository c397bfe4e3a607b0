"""Readers and writers: parsed documents, glossaries, CSV grids, adapters of plain tables."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill import schema
from textmill.config import HAN_COMPAT
from textmill.functions import text as T


def source_hash(content: Column) -> Column:
    """A file's name in the store: 16 hex digits of its content's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def read_documents(spark: SparkSession, path: str, parser: Callable[[bytes], list[dict]]) -> DataFrame:
    """Files -> pages (``schema.PAGE``) by a parser backend (bytes -> page dicts); a file it can't parse gives none."""
    files = spark.read.format("binaryFile").load(path).select(source_hash(F.col("content")).alias("doc_id"), "content")

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page", "rect", "blocks", "images", "drawings_count", "tables"]
        for pdf in batches:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    pages = parser(bytes(content))
                except Exception:  # noqa: BLE001  one bad file must not end the job
                    pages = []
                rows = [{"doc_id": doc_id} | {n: p.get(n, [] if n in ("blocks", "images", "tables") else None) for n in names} for p in pages]
                yield pd.DataFrame(rows, columns=["doc_id", *names])

    return files.mapInPandas(parsed, schema.PAGE)


def read_parse_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parsed documents, one JSON object a file -> pages (``schema.PAGE``) and contents (doc_id, pos, lvl, title, page)."""
    raw = spark.read.schema(schema.DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    raw = raw.withColumn("doc_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.json)?\z", 1))
    return _pages(raw), _toc(raw)


def parse_json_column(docs: DataFrame, id_col: str = "doc_id", json_col: str = "parse") -> tuple[DataFrame, DataFrame]:
    """The same from a column of JSON texts."""
    raw = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.from_json(json_col, schema.DOCUMENT).alias("d")).select("doc_id", "d.*")
    return _pages(raw), _toc(raw)


def _pages(raw: DataFrame) -> DataFrame:
    return typed_pages(raw.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*"))


def typed_pages(pages: DataFrame) -> DataFrame:
    """Missing parts of pages as empty ones."""
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    blocks = F.transform(F.coalesce("blocks", F.array().cast(f"array<{schema.BLOCK}>")), lambda b: b.withField("type", F.coalesce(b["type"], F.lit(0))).withField("lines", F.transform(F.coalesce(b["lines"], F.array().cast(f"array<{schema.LINE}>")), lambda ln: ln.withField("spans", F.coalesce(ln["spans"], F.array().cast(f"array<{schema.SPAN}>"))))))
    return pages.select("doc_id", "page", "rect", blocks.alias("blocks"), empty("images", schema.IMAGE), F.coalesce("drawings_count", F.lit(0)).alias("drawings_count"), empty("tables", schema.TABLE))


def _toc(raw: DataFrame) -> DataFrame:
    rows = raw.select("doc_id", F.posexplode("toc").alias("pos", "t"))
    return rows.select("doc_id", "pos", F.col("t")[0].cast("int").alias("lvl"), F.col("t")[1].alias("title"), F.col("t")[2].cast("int").alias("page"))


# --- Fixed values: words that mark a glossary's first line as its header -------------
SOURCE_HEADERS = ("zh", "source", "src", "source_language", "en", "ja", "de", "fr")
TARGET_HEADERS = ("ru", "target", "dst", "target_language", "en", "de", "fr")
# -------------------------------------------------------------------------------------


def parse_glossary(text: str) -> list[tuple[str, str]]:
    """Terms of a small CSV text, in order of first appearance; a later target of one source wins.

    Further columns belong to the target.  The first usable line is a header only if both of its words are.
    """
    terms: dict[str, str] = {}
    usable = (r for r in csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")) if len(r) >= 2 and any(c.strip() for c in r))
    for i, (source, *rest) in enumerate(usable):
        source, target = source.strip(), ",".join(rest).strip()
        if i == 0 and source.lower() in SOURCE_HEADERS and target.lower() in TARGET_HEADERS:
            continue
        if source and target:
            terms[source] = target
    return list(terms.items())


def read_glossary(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The same from any store; a missing file has no terms.  Glossaries are small: they become part of the plan."""
    try:
        files = spark.read.option("wholetext", True).text(path).collect()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return parse_glossary(files[0][0]) if files else []


def glossary_frame(spark: SparkSession, terms: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(terms)], "source string, target string, pos int")


def parse_csv(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of a CSV text: quotes toggle anywhere, doubled quotes inside stand for one; any line end."""
    import re

    rows, row, cell, quoted = [], [], [], False
    for token in re.findall(rf'""|"|\r\n|\n|\r|{re.escape(delimiter)}|[^"\r\n{re.escape(delimiter)}]+', text.removeprefix("\ufeff")):
        if token == '""' and quoted:
            cell.append('"')
        elif token in ('"', '""'):
            quoted ^= token == '"'
        elif quoted or token[0] not in "\r\n" + delimiter:
            cell.append(token)
        else:
            row.append("".join(cell))
            cell = []
            if token != delimiter:
                rows.append(row)
                row = []
    if cell or row:
        rows.append([*row, "".join(cell)])
    return rows


def read_grid(spark: SparkSession, path: str, encoding: str = "gb18030", delimiter: str = ",") -> DataFrame:
    """CSV files as cells (file, line, col, value), from 0.  A file with quoted line ends can't be split, so it is one task."""
    return parse_grid(spark.read.format("binaryFile").load(path).select("path", "content"), encoding, delimiter)


def parse_grid(files: DataFrame, encoding: str = "gb18030", delimiter: str = ",") -> DataFrame:
    """The same from (path, content) rows."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = parse_csv(bytes(content).decode(encoding), delimiter)
                for at in range(0, max(1, len(rows)), 10_000):
                    flat = [(name, at + i, j, v) for i, r in enumerate(rows[at : at + 10_000]) for j, v in enumerate(r)]
                    yield pd.DataFrame(flat, columns=["file", "line", "col", "value"])

    return files.mapInPandas(cells, "file string, line long, col int, value string")


def han_cells(grid: DataFrame) -> DataFrame:
    return grid.where(F.col("value").rlike(f"[{HAN_COMPAT}]"))


def grid_lines(grid: DataFrame, delimiter: str = ",") -> DataFrame:
    """(file, line, text): cells written as CSV lines, quoted only where needed."""
    cell = T.escape_csv(F.col("value"), delimiter)
    return grid.groupBy("file", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", cell.alias("v")))), lambda x: x["v"]), delimiter).alias("text"))


def write_csv(grid: DataFrame, path: str, delimiter: str = ",") -> None:
    """One file with a byte-order mark and CRLF between lines, put in place in one step.

    Executors write the lines in parts by range; the driver's JVM joins their bytes and holds a buffer at most.
    """
    spark = grid.sparkSession
    parts = f"{path}.{uuid.uuid4().hex}.parts"
    lines = grid_lines(grid, delimiter).orderBy("file", "line").select("text")
    lines.write.option("lineSep", "\r\n").option("encoding", "UTF-8").text(parts)
    try:
        _join_parts(spark, parts, path, "\ufeff".encode(), cut=2)
    finally:
        _files(spark, parts)[0].delete(_files(spark, parts)[1], True)


def _files(spark: SparkSession, name: str):
    """A path's file system, without checksum files beside local ones, and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return (files.getRawFileSystem() if name.startswith(("/", "file:")) or not path.isAbsolute() else files), path


def _join_parts(spark: SparkSession, folder: str, target: str, head: bytes, cut: int) -> None:
    """The part files of ``folder``, by name, as one file behind ``head``, less the last ``cut`` bytes."""
    files, at = _files(spark, folder)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = sorted(((s.getPath().getName(), s.getPath(), s.getLen()) for s in files.listStatus(at) if s.getPath().getName().startswith("part-")), key=lambda x: x[0])
    filled = [x for x in found if x[2]]
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}.joined")
    out = files.create(temporary, True)
    try:
        out.write(bytearray(head))
        for i, (_, part, size) in enumerate(filled):
            source = files.open(part)
            try:
                whole = jvm.org.apache.commons.io.input.BoundedInputStream(source, size - cut * (i == len(filled) - 1))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(whole, out, conf, False)
            finally:
                source.close()
    finally:
        out.close()
    final = spark._jvm.org.apache.hadoop.fs.Path(target)
    files.delete(final, False)
    if not files.rename(temporary, final):
        raise OSError(f"{target} could not be put in place")


def promote(grid: DataFrame, path: str, main: str, delimiter: str = ",") -> int:
    """Writes ``path``; ``main`` too if no cell is left untranslated.  The number of cells left."""
    left = han_cells(grid).select((F.col("line") + 1).alias("line"), (F.col("col") + 1).alias("col"), "value")
    many = left.count()
    write_csv(grid, path, delimiter)
    if many:
        cells = left.orderBy("line", "col").toLocalIterator()
        atomic_write(f"{path}.leftovers.json", _json_list(r.asDict() for r in cells))
    else:
        write_csv(grid, main, delimiter)
    return many


def _json_list(items: Iterable) -> Iterator[str]:
    """``json.dumps(list(items), ensure_ascii=False, indent=2)`` in parts."""
    begun = False
    for x in items:
        yield ("," if begun else "[") + "\n  " + json.dumps(x, ensure_ascii=False, indent=2).replace("\n", "\n  ")
        begun = True
    yield "\n]" if begun else "[]"


def atomic_write(path: str, text: str | Iterable[str]) -> None:
    """A control file that is either the old one or the whole new one."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder, prefix=f".{os.path.basename(path)}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.writelines([text] if isinstance(text, str) else text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def save_json(value, path: str) -> None:
    atomic_write(path, json.dumps(value, ensure_ascii=False, indent=2))


def load_json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Text that directly follows the start of an h1, p, b, li or a element, with or without attributes, as blocks (doc_id, pos, tag, text), in order."""
    pattern = r"<(h1|p|b|li|a)(?:[ \t\r\n][^>]*)?>([^<]+)"
    found = F.arrays_zip(F.regexp_extract_all(html_col, F.lit(pattern), F.lit(1)).alias("tag"), F.regexp_extract_all(html_col, F.lit(pattern), F.lit(2)).alias("text"))
    rows = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("pos", "b"))
    return rows.select("doc_id", "pos", "b.tag", "b.text")


def conversation_segments(turns: DataFrame) -> DataFrame:
    """Turns as segments (doc_id, id, type, section_id, text): a conversation is a document."""
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("id"), F.lit("paragraph").alias("type"), F.lit(None).cast("string").alias("section_id"), "text")


def font_table(spark: SparkSession, fonts: list[tuple[str, str, bool]]) -> DataFrame:
    """Fonts (path, ps_name, covers) in order of preference, each path once."""
    seen = dict.fromkeys(p for p, _, _ in fonts)
    first = {p: next(f for f in fonts if f[0] == p) for p in seen}
    return spark.createDataFrame([(i, *first[p]) for i, p in enumerate(seen)], "pos int, path string, ps_name string, covers boolean")


def find_font(candidates: list[str], covers: Callable[[str], bool]) -> str:
    """The first existing candidate that covers the target language."""
    for path in candidates:
        if path and os.path.exists(path) and covers(path):
            return path
    raise FileNotFoundError("no font covers the target language")


def write_errors(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
