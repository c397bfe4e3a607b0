"""Translation of CSV cells: unique texts in batches, strict single retries, put back in place."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.config import HAN_COMPAT
from textmill.functions import text as T
from textmill.functions.jsonio import json_array
from textmill.operators.batching import chunks
from textmill.operators.translate import Backend, tasks
from textmill.scratch import stash

BATCH = 64
STRICT_TRIES = 3
BATCH_PROMPT = "Translate each string of the JSON array; answer with a JSON array of as many strings. Keep codes, numbers and separators."
STRICT_PROMPT = "The last answer was incomplete or still held source script. Translate all of it; answer with the text only."


def unique_texts(cells: DataFrame) -> DataFrame:
    """(file, line, col, value) -> (value, pos): each text once, at its first place."""
    return cells.groupBy("value").agg(F.min(F.struct("file", "line", "col")).alias("pos")).select("value", "pos.*")


def max_tokens(chars: int, batch: bool = True) -> int:
    """How long an answer may be for so many characters."""
    if batch:
        return max(512, min(4096, -(-chars * 16 // 5) + 700))
    return max(256, min(1200, chars * 4 + 240))


def _batches(backend: Backend, workers: int):
    def ask(texts) -> str | None:
        try:
            return backend.complete([{"role": "system", "content": BATCH_PROMPT}, {"role": "user", "content": json.dumps(list(texts), ensure_ascii=False)}])
        except Exception:  # noqa: BLE001  the texts are asked for one by one then
            return None

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for pdf in batches:
                yield pdf.assign(texts=pdf["texts"].map(list), response=list(pool.map(ask, pdf["texts"])))

    return asked


def _singles(backend: Backend, workers: int):
    import re

    han = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")

    def ask(value: str) -> str:
        said = value
        for _ in range(STRICT_TRIES):
            try:
                said = backend.complete([{"role": "system", "content": STRICT_PROMPT}, {"role": "user", "content": value}]) or value
            except Exception:  # noqa: BLE001  the text stays as it is
                said = value
            if not han.search(said):
                break
        return said

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for pdf in batches:
                yield pdf.assign(said=list(pool.map(ask, pdf["value"])))

    return asked


def translate_cells(grid: DataFrame, backend: Backend, workers: int = 1, size: int = BATCH) -> DataFrame:
    """(file, line, col, value) with the cells that hold source script translated.

    Each text is asked for once, ``size`` at a time.  A batch whose answer is no list of as many items, and a text whose
    answer keeps source script, are asked for again one by one, up to three times.
    """
    cells = grid.where(F.col("value").rlike(f"[{HAN_COMPAT}]"))
    unique = chunks(unique_texts(cells), ["file", "line", "col"], size)
    asked = unique.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("file", "line", "col", "value"))), lambda x: x["value"]).alias("texts"))
    asked = stash(asked, "grid-asked")
    said = stash(asked.repartition(tasks(asked.count())).mapInPandas(_batches(backend, workers), "chunk int, texts array<string>, response string"), "grid-batches")
    items = F.from_json(json_array(F.col("response")), "array<string>")
    pairs = said.withColumn("items", items).select(F.explode(F.arrays_zip("texts", F.when(F.size("items") == F.size("texts"), F.col("items")).otherwise(F.transform("texts", lambda _: F.lit(None).cast("string"))).alias("said"))).alias("z"))
    pairs = pairs.select(F.col("z.texts").alias("value"), F.col("z.said").alias("said"))
    first = pairs.withColumn("target", T.clean_cell(F.col("said"), F.col("value")))
    good = F.col("said").isNotNull() & ~F.col("target").rlike(f"[{HAN_COMPAT}]")
    rest = stash(first.where(~good).select("value"), "grid-rest")
    rest = rest.repartition(tasks(rest.count())).mapInPandas(_singles(backend, workers), "value string, said string")
    rest = stash(rest, "grid-singles").select("value", T.clean_cell(F.col("said"), F.col("value")).alias("target"))
    found = first.where(good).select("value", "target").unionByName(rest)
    return grid.join(found, "value", "left").select("file", "line", "col", F.coalesce("target", "value").alias("value"))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """Struct (rate a second, eta in seconds) of a running job."""
    rate = F.round(done / F.greatest(F.lit(1), F.round(seconds)), 2)
    return F.struct(rate.alias("rate"), F.round((total - done) / F.greatest(F.lit(0.01), rate)).cast("long").alias("eta"))


def translate_stem(stem: str, backend: Backend, target_lang: str) -> str:
    """A file's name translated by one call; its cleaned self if that fails."""
    import re

    clean = re.sub(r"\s*[Vv]\d[\d.]*\s*", " ", re.sub(r"^[0-9a-f]{12}_(?=.)", "", stem)).strip()
    if not clean:
        return stem
    try:
        said = backend.complete([{"role": "system", "content": f"Translate this file name to {target_lang}; answer with the name only."}, {"role": "user", "content": clean}])
    except Exception:  # noqa: BLE001
        return clean
    return (said or "").strip().strip("\"'`«» ").replace("\n", " ").strip() or clean
