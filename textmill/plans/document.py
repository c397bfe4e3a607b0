"""A document job: segment, translate, lay out, validate; resumable, each stage a Parquet table."""

from __future__ import annotations

import inspect as _inspect
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.config import Settings
from textmill.operators import context, layout, segment, translate, validate
from textmill.plans.stages import Job, Stage
from textmill.sources import save_json


def _code(*modules) -> tuple[str, ...]:
    return tuple(_inspect.getsourcefile(m) for m in modules)


def document_job(spark: SparkSession, pages: DataFrame, toc: DataFrame, backend: translate.Backend, cfg: dict, source_hash: str, folder: str, terms: list[tuple[str, str]] = ()) -> Job:
    """The stages of parsed pages (``schema.PAGE``) and contents, in ``folder``."""
    s = Settings.from_dict(cfg)
    at = lambda name: spark.read.parquet(os.path.join(folder, name))

    def put(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    def run_segment(_: dict, path: str) -> None:
        put(segment.segments(pages, toc, s), path)

    def run_translate(_: dict, path: str) -> None:
        rows = at("segments.parquet")
        log_path = os.path.join(folder, "cache.parquet")
        log = spark.read.parquet(log_path) if os.path.exists(log_path) else None
        done = translate.translate(rows, backend, s, terms, log)
        fresh = translate.cache_rows(done, s)
        fresh.write.mode("append").parquet(log_path)
        put(translate.apply_translations(rows, done.select("doc_id", "id", "dst", "ok"), ["doc_id", "id"]), path)
        bad = translate.error_rows(done)
        if not bad.isEmpty():
            bad.write.mode("append").json(os.path.join(folder, "errors"))
            raise RuntimeError("segments were left untranslated; see errors")

    def run_layout(_: dict, path: str) -> None:
        put(layout.plan(at("translated.parquet"), s), path)
        planned = spark.read.parquet(path)
        put(context.translate_toc(toc, context.heading_lookup(at("translated.parquet"))), os.path.join(folder, "toc.parquet"))
        # One line for each document, written where its row lies.
        layout.report(planned, s).write.mode("overwrite").json(os.path.join(folder, "layout.json"))

    keys = ("source_lang", "target_lang", "anchors", "section_patterns", "bullet_chars", "bullet_replace", "remove_pua")
    models = ("llm_model", "model", "temperature", "top_p", "max_tokens", "llm_batch_max_items", "llm_batch_max_chars", "translation_max_attempts")
    return Job(
        [
            Stage("segment", run_segment, "segments.parquet", keys, _code(segment)),
            Stage("translate", run_translate, "translated.parquet", ("source_lang", "target_lang", *models), _code(translate), after="segment", inputs=("glossary_path",)),
            Stage("layout", run_layout, "layout.parquet", ("builder_min_fontsize", "builder_table_min_fontsize"), _code(layout), after="translate"),
        ],
        cfg,
        source_hash,
        folder,
    )


def compare(pages: DataFrame, planned: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Problems of a layout plan against its source pages."""
    spans = validate.spans_of(pages)
    src_text = spans.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    placed = planned.where("route = 'placed'")
    out_text = placed.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "layout_text"))), lambda x: x["layout_text"]), "\n").alias("text"))
    heights = pages.select("doc_id", "page", (F.col("rect")[3] - F.col("rect")[1]).alias("page_height"))
    out_spans = placed.join(heights, ["doc_id", "page"]).select("doc_id", "page", F.col("id").cast("string").alias("id"), F.col("layout_text").alias("text"), "size", F.col("grown").alias("bbox"), "page_height")
    docs = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages")).withColumns({c: F.lit(0) for c in ("images", "toc_len", "max_level")})
    blank = src_text.select("doc_id", "page").join(out_text, ["doc_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    moved = planned.where("route = 'appendix'").groupBy("doc_id").agg(F.to_json(F.struct(F.lit(1).alias("appendix_pages"), F.collect_set(F.struct("page")).alias("overflow"))).alias("report"))
    return validate.validate({"pages": src_text, "spans": spans, "docs": docs}, {"pages": blank, "spans": out_spans, "docs": docs}, s, moved)
