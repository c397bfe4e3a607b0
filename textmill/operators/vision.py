"""Text in images: one call for each image, cached by content; regions to paint, and why others are not."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import geometry as G
from textmill.functions import jsonio
from textmill.operators import cache
from textmill.scratch import stash

PROMPT_VERSION = "regions-1"


class VisionBackend(Protocol):
    """Answers for one image with text; ``max_tokens`` bounds it."""

    def read(self, image: bytes, source_lang: str, target_lang: str, max_tokens: int) -> str: ...


def unique_images(pages: DataFrame, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pages -> distinct images (doc_id, xref, page, pos, width, height) at their first place, and (doc_id, duplicate_xrefs)."""
    each = pages.select("doc_id", "page", F.posexplode("images").alias("pos", "i")).select("doc_id", "page", "pos", "i.xref", "i.width", "i.height")
    first = each.groupBy("doc_id", "xref").agg(F.min_by(F.struct("page", "pos", "width", "height"), F.struct("page", "pos")).alias("f"), F.count(F.lit(1)).alias("n"))
    images = first.select("doc_id", "xref", "f.*").where((F.col("width") >= min_size) & (F.col("height") >= min_size))
    return images, first.groupBy("doc_id").agg(F.sum(F.col("n") - 1).alias("duplicate_xrefs"))


def read_images(images: DataFrame, backend: VisionBackend, source_lang: str, target_lang: str, model: str = "stub", log: DataFrame | None = None, max_tokens: int = 2048, most_tokens: int = 8192, attempts: int = 3, workers: int = 1) -> DataFrame:
    """(doc_id, xref, content) -> the same with regions, cache_hit, attempts and error.

    Equal images are read once.  An answer that is no JSON object, or whose regions are all
    turned down, is asked for again with twice the tokens, up to ``most_tokens``.
    """
    hashed = images.withColumn("image_hash", F.sha2("content", 256))
    hashed = hashed.withColumn("key", cache.vision_key(F.col("image_hash"), source_lang, target_lang, model, PROMPT_VERSION))
    once = hashed.groupBy("key").agg(F.min_by("content", F.struct("doc_id", "xref")).alias("content"))
    if log is not None:
        known = log.groupBy("key").agg(F.max_by("dst", "ts").alias("answer"))
        once = once.join(known, "key", "left")
    else:
        once = once.withColumn("answer", F.lit(None).cast("string"))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            rows = []
            for key, content in zip(pdf["key"], pdf["content"], strict=True):
                said, error, tokens, n = None, None, max_tokens, 0
                for n in range(1, attempts + 1):
                    try:
                        said = backend.read(bytes(content), source_lang, target_lang, tokens)
                        value = json.loads(said[said.find("{") : said.rfind("}") + 1])
                        if isinstance(value.get("regions"), list):
                            error = None
                            break
                        error = "no regions"
                    except Exception as e:  # noqa: BLE001  any failure of a call is a failed image
                        error = str(e)[:500]
                    tokens = min(tokens * 2, most_tokens)
                rows.append((key, said, n, error))
            yield pd.DataFrame(rows, columns=["key", "answer", "attempts", "error"])

    fresh = once.where("answer IS NULL").select("key", "content").repartition(workers).mapInPandas(asked, "key string, answer string, attempts int, error string")
    fresh = stash(fresh, "vision-answers").withColumn("cache_hit", F.lit(False))
    hits = once.where("answer IS NOT NULL").select("key", "answer", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("cache_hit"))
    answers = fresh.unionByName(hits)
    out = hashed.join(answers, "key")
    return jsonio.with_regions(out, "answer", source_lang, target_lang)


def overlay_plan(regions: DataFrame, min_confidence: float = 0.5, min_font: int = 6, padding: int = 3, ratio: float = 0.04) -> DataFrame:
    """(keys, region, width, height) with pixels, painted and skip, the reason against painting."""
    w, h = F.col("width"), F.col("height")
    box = G.pixel_rect(F.col("region.bbox"), w, h)
    grown = G.expanded_rect(box, w, h, padding, ratio)
    room = F.least(grown[2] - grown[0], grown[3] - grown[1]) - 2 * padding
    skip = F.when(F.col("region.confidence") < min_confidence, "low_confidence").when(box.isNull(), "invalid_bbox").when(room < min_font, "text_does_not_fit")
    return regions.withColumn("pixels", grown).withColumn("skip", skip).withColumn("painted", skip.isNull())


def report(images: DataFrame, planned: DataFrame) -> DataFrame:
    """One row for each document: counts, skip_reasons and outcome."""
    n = images.groupBy("doc_id").agg(F.count(F.lit(1)).alias("unique_images"), F.count_if("cache_hit").alias("cache_hits"), F.sum("attempts").alias("attempts"), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"), F.count_if(F.col("error").isNotNull()).alias("images_failed"), F.count_if(F.col("error").isNull()).alias("processed"), F.sum(F.size("regions")).alias("regions_detected"))
    r = planned.groupBy("doc_id").agg(F.count_if("painted").alias("regions_processed"), F.count_if(~F.col("painted")).alias("regions_skipped_overlay"))
    why = planned.where("skip IS NOT NULL").groupBy("doc_id", "skip").agg(F.count(F.lit(1)).alias("n"))
    why = why.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("skip", "n")))).alias("skip_reasons"))
    outcome = F.when((F.col("images_failed") > 0) & (F.col("processed") > 0), "partial").when(F.col("images_failed") > 0, "failed").otherwise("success")
    return n.join(r, "doc_id", "left").join(why, "doc_id", "left").withColumn("outcome", outcome)


def border_median(image: Column, width: Column, height: Column, rect: Column, thickness: int = 2) -> Column:
    """Median colour of the ring around a rectangle of a raw RGB image; of its own edge if there is no ring."""

    @F.pandas_udf("array<int>")
    def median(images: pd.Series, widths: pd.Series, heights: pd.Series, rects: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for raw, w, h, r in zip(images, widths, heights, rects, strict=True):
            if raw is None or r is None:
                out.append(None)
                continue
            px = np.frombuffer(bytes(raw), np.uint8).reshape(int(h), int(w), 3)
            x0, y0, x1, y1 = (int(v) for v in r)
            ring = [px[y, x0:x1] for d in range(1, max(1, thickness) + 1) for y in (y0 - d, y1 - 1 + d) if 0 <= y < h]
            ring += [px[y0:y1, x] for d in range(1, max(1, thickness) + 1) for x in (x0 - d, x1 - 1 + d) if 0 <= x < w]
            ring = ring or [px[y0, x0:x1], px[y1 - 1, x0:x1], px[y0:y1, x0], px[y0:y1, x1 - 1]]
            out.append([int(round(float(v))) for v in np.median(np.concatenate(ring), axis=0)])
        return pd.Series(out, dtype=object)

    return median(image, width, height, rect)


class Fixed:
    """Gives one answer for any image, for tests."""

    def __init__(self, answer: str):
        self.answer = answer

    def read(self, image: bytes, source_lang: str, target_lang: str, max_tokens: int) -> str:
        return self.answer


def data_url(image: bytes, kind: str = "image/png") -> str:
    return f"data:{kind};base64,{base64.b64encode(image).decode()}"
