"""Painting behind protocols: what is written where is planned here, bytes come from a backend.

A document writer turns the placed rows of one document into a file and can say how many pages a file has; a painter draws
lines of text into an image.  Both have plain stubs, so plans can be run and compared without a renderer.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import geometry as G
from textmill.operators.vision import border_median


class DocumentWriter(Protocol):
    """Makes a file from rows (page, id, text), in order, and reads the number of pages of one; -1 if it can't be read."""

    def write(self, doc_id: str, rows: pd.DataFrame, pages: int) -> bytes: ...

    def pages(self, content: bytes) -> int: ...


class PlainPages:
    """Pages of plain text, parted by form feeds."""

    def write(self, doc_id: str, rows: pd.DataFrame, pages: int) -> bytes:
        held: list[list[str]] = [[] for _ in range(pages)]
        for page, text in zip(rows["page"], rows["text"], strict=True):
            held[int(page)].append(text)
        return "\f".join("\n".join(x) for x in held).encode()

    def pages(self, content: bytes) -> int:
        return content.count(b"\f") + 1


def render(planned: DataFrame, pages: DataFrame, writer: DocumentWriter) -> DataFrame:
    """(doc_id, page, id, text) and (doc_id, pages) -> (doc_id, content, pages, error): a file of each document, opened again and counted.

    A document is one file, so its rows meet in one task; a file that has another number of pages, or fails, is null with
    its error.
    """
    rows = pages.select("doc_id", F.col("pages").alias("want")).join(planned.select("doc_id", "page", "id", "text"), "doc_id", "left")
    kind = dict(rows.dtypes)["doc_id"]

    def written(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        want, content, found, error = int(pdf["want"].iloc[0]), None, -1, None
        try:
            content = writer.write(str(key[0]), pdf.dropna(subset=["page"]).sort_values(["page", "id"]), want)
            found = writer.pages(content)
            if found != want:
                content, error = None, f"page count changed: {want} to {found}"
        except Exception as e:  # noqa: BLE001  one bad document must not end the job
            content, error = None, str(e)[:500]
        return pd.DataFrame({"doc_id": [key[0]], "content": [content], "pages": [found], "error": [error]})

    return rows.groupBy("doc_id").applyInPandas(written, f"doc_id {kind}, content binary, pages int, error string")


def derived_check(base: DataFrame, derived: DataFrame) -> DataFrame:
    """(doc_id, pages, size) of files and of what was made from them -> (doc_id, ok, reason): none, empty, unreadable (no pages), or other page counts."""
    met = base.select("doc_id", F.col("pages").alias("was")).join(derived.select("doc_id", "pages", "size"), "doc_id", "left")
    reason = F.when(F.coalesce("size", F.lit(0)) == 0, "no file").when(F.coalesce("pages", F.lit(-1)) < 0, "not readable").when(F.col("pages") != F.col("was"), F.concat(F.lit("page count changed: base="), "was", F.lit(", out="), "pages"))
    return met.select("doc_id", reason.isNull().alias("ok"), reason.alias("reason"))


def to_rgb(raw: Column, width: Column, height: Column, channels: Column) -> Column:
    """Raw images of 1 (grey), 3, or 4 channels as RGB; an alpha channel goes, other layouts are null."""

    @F.pandas_udf("binary")
    def converted(images: pd.Series, widths: pd.Series, heights: pd.Series, many: pd.Series) -> pd.Series:
        out = []
        for image, w, h, n in zip(images, widths, heights, many, strict=True):
            fits = image is not None and n in (1, 3, 4) and len(image) == w * h * n
            px = np.frombuffer(bytes(image), np.uint8).reshape(int(h), int(w), int(n)) if fits else None
            out.append(None if px is None else (np.repeat(px, 3, 2) if n == 1 else px[:, :, :3]).tobytes())
        return pd.Series(out, dtype=object)

    return converted(raw, width, height, channels)


class Painter(Protocol):
    """Draws a text into a rectangle of an image (rows x columns x 3), in place."""

    def draw(self, image: np.ndarray, rect: tuple[int, int, int, int], text: str, colour: tuple[int, int, int]) -> None: ...


class Bars:
    """Draws each line of text as a bar, a pixel for each character."""

    def draw(self, image: np.ndarray, rect: tuple[int, int, int, int], text: str, colour: tuple[int, int, int]) -> None:
        x0, y0, x1, y1 = rect
        for i, line in enumerate(text.split("\n")):
            if y0 + 2 * i < y1:
                image[y0 + 2 * i, x0 : min(x1, x0 + len(line))] = colour


def paint_regions(planned: DataFrame, painter: Painter, padding: int = 3) -> DataFrame:
    """(key, raw, width, height, region, pixels, painted), one row for each region -> (key, raw, processed, skipped, modified).

    ``planned`` is ``vision.overlay_plan`` of raw RGB images.  Painted regions are filled with the colour around them, then
    drawn upon in black or white, whichever reads better; without any the image stays as it is.
    """
    ground = border_median(F.col("raw"), F.col("width"), F.col("height"), F.when(F.col("painted"), F.col("pixels")))
    rows = planned.withColumn("ground", ground).withColumn("colour", G.foreground(F.col("ground")))
    rows = rows.select("key", "raw", "width", "height", F.col("region.translation").alias("text"), "pixels", "painted", "ground", "colour")

    @F.pandas_udf("binary")
    def drawn(images: pd.Series, widths: pd.Series, heights: pd.Series, regions: pd.Series) -> pd.Series:
        out = []
        for raw, w, h, todo in zip(images, widths, heights, regions, strict=True):
            image = np.frombuffer(bytes(raw), np.uint8).reshape(int(h), int(w), 3).copy()
            for r in sorted(todo, key=lambda r: (r["pixels"][1], r["pixels"][0], r["text"])):
                x0, y0, x1, y1 = map(int, r["pixels"])
                image[y0:y1, x0:x1] = list(r["ground"])
                painter.draw(image, (x0 + padding, y0 + padding, x1 - padding, y1 - padding), r["text"], tuple(r["colour"]))
            out.append(image.tobytes())
        return pd.Series(out, dtype=object)

    # Images are grouped in the JVM: handing each to Python as a table of its own costs more than to paint it.
    region = F.when(F.col("painted"), F.struct("text", "pixels", "ground", "colour"))
    many, todo = F.col("many"), F.size("todo")
    images = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("raw", "width", "height")], F.collect_list(region).alias("todo"), F.count(F.lit(1)).cast("int").alias("many"))
    return images.select("key", drawn("raw", "width", "height", "todo").alias("raw"), todo.alias("processed"), (many - todo).alias("skipped"), (todo > 0).alias("modified"))


def disposition(name: Column, inline: Column) -> Column:
    """The header that a result is given out with: shown in place, or as a file of that name."""
    encoded = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    return F.concat(F.when(inline, "inline").otherwise("attachment"), F.lit("; filename*=UTF-8''"), encoded)
