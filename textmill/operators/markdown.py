"""Page-wise translation to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.config import Settings
from textmill.functions import text as T
from textmill.operators.translate import Backend, call
from textmill.scratch import stash


def page_text(markdown: Column, plain: Column) -> Column:
    return F.coalesce(F.when(T.strip(F.coalesce(markdown, F.lit(""))) != "", markdown), plain, F.lit(""))


def prompt(text: Column) -> Column:
    return F.to_json(F.struct(F.lit("Translate only what document_page holds; answer with Markdown only.").alias("task"), text.alias("document_page")))


def translate_pages(pages: DataFrame, backend: Backend, s: Settings = Settings(), done: DataFrame | None = None, limit: int = 0, system: str = "") -> DataFrame:
    """(doc_id, page, text) -> (doc_id, page, markdown).  Pages in ``done`` with text are not asked for again; failed ones are empty."""
    if limit > 0:
        pages = pages.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).where(F.col("__r") <= limit).drop("__r")
    ready = done.where(T.strip(F.coalesce("markdown", F.lit(""))) != "") if done is not None else None
    todo = pages.join(ready.select("doc_id", "page"), ["doc_id", "page"], "left_anti") if ready is not None else pages
    blank = todo.where(T.strip(F.coalesce("text", F.lit(""))) == "").select("doc_id", "page", F.lit("").alias("markdown"))
    asked = todo.where(T.strip(F.coalesce("text", F.lit(""))) != "").select("doc_id", "page", prompt(F.col("text")).alias("request"))
    said = call(asked, backend, system or f"Translate from {s.source_lang} to {s.target_lang}.", s.workers, asked.count())
    out = said.select("doc_id", "page", F.coalesce(T.clean_markdown(F.col("response")), F.lit("")).alias("markdown")).unionByName(blank)
    return stash(out.unionByName(ready.select("doc_id", "page", "markdown")) if ready is not None else out, "markdown")


def to_html(markdown: Column, css: str = "") -> Column:
    """The fallback rendering: preformatted text."""
    style = f"<style>{css}</style>" if css else ""
    return F.concat(F.lit(f"<!DOCTYPE html><html><head>{style}</head><body><pre>"), T.escape_html(markdown, quotes=False), F.lit("</pre></body></html>"))


def css(family: str, size: float, leading: float = 1.25) -> str:
    """Style sheet in proportion to one body size."""
    scale = {"h1": 1.5, "h2": 1.25, "h3": 1.1, "h4": 1.0, "table": 0.9, "pre": 0.85, "code": 0.85}
    rules = [f"body {{ margin: 0; font-family: '{family}', sans-serif; font-size: {size:.1f}pt; line-height: {leading:.2f}; }}"]
    return "\n".join(rules + [f"{k} {{ font-size: {size * v:.1f}pt; }}" for k, v in scale.items()])


def font_family(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[^.]*\z", "")


def pages_map(pages: DataFrame) -> DataFrame:
    """(doc_id, pages): a map from page to Markdown."""
    return pages.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("page", "markdown")))).alias("pages"))
