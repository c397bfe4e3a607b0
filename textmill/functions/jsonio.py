"""JSON answers of models: strict and tolerant decoding."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.config import base_language, script_class
from textmill.functions import text as T
from textmill.schema import REGION

MOST_REGIONS = 256
_RAW = "struct<bbox: array<double>, bbox_2d: array<double>, source_text: string, translation: string, confidence: string>"
_FENCE = r"(?is)\A```(?:json)?%s*(.*?)%s*```\z" % (T.WS, T.WS)


def unfenced(text: Column) -> Column:
    """Without thinking and one fence."""
    t = T.strip(F.regexp_replace(text, r"\A\x{feff}+", ""))
    t = T.strip(F.regexp_replace(t, r"(?is)<(?:think|analysis)>.*?</(?:think|analysis)>", ""))
    return F.when(t.rlike(_FENCE), T.strip(F.regexp_extract(t, _FENCE, 1))).otherwise(t)


def embedded_object(text: Column) -> Column:
    """The first JSON object inside prose that has a list ``regions``; null if there is none.

    Trying each opening brace needs a decoder that stops where a value ends.
    """

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def first(t: str | None) -> str | None:
            at = (t or "").find("{")
            while at >= 0:
                try:
                    value, _ = decoder.raw_decode(t, at)
                except ValueError:
                    value = None
                if isinstance(value, dict) and isinstance(value.get("regions"), list):
                    return json.dumps(value, ensure_ascii=False)
                at = t.find("{", at + 1)
            return None

        return pd.Series([first(t) for t in texts], dtype=object)

    # Kept apart from later expressions: a Python function can't run inside a higher-order one.
    return found.asNondeterministic()(text)


def decode_object(raw: Column) -> Column:
    """Text of the JSON object in an answer; null if it is not one."""
    t = unfenced(raw)
    whole = F.try_parse_json(t)
    return F.when(whole.isNotNull(), F.when(F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")), t)).otherwise(embedded_object(t))


def json_array(content: Column) -> Column:
    """Text of the JSON array in an answer: without fences, else between the outermost brackets."""
    t = T.strip(F.regexp_replace(F.regexp_replace(content, r"(?i)\A```(?:json)?", ""), r"```\z", ""))
    inner = F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    good = lambda x: F.startswith(F.schema_of_variant(F.try_parse_json(x)), F.lit("ARRAY"))
    return F.when(good(t), t).when(good(inner), inner)


def clean_region(r: Column, source_lang: str, target_lang: str) -> Column:
    """A region with its confidence held in 0..1, or null if it must not be painted."""
    box = F.coalesce(r["bbox"], r["bbox_2d"])
    source, target = T.strip(F.coalesce(r["source_text"], F.lit(""))), T.strip(F.coalesce(r["translation"], F.lit("")))
    confidence = r["confidence"].try_cast("double")
    shape = (F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0, 1000))
    shape = shape & (F.get(box, F.lit(2)) - F.get(box, F.lit(0)) >= 1) & (F.get(box, F.lit(3)) - F.get(box, F.lit(1)) >= 1)
    said = (source != "") & (target != "") & _has(source, source_lang) & _has(target, target_lang)
    said = said & (F.lower(T.squash(source)) != F.lower(T.squash(target)))
    kept = F.size(T.bag_minus(T.critical_tokens(source), T.critical_tokens(target))) == 0
    sized = F.length(target) <= F.greatest(F.lit(500), F.length(source) * 8 + 80)
    sure = confidence.isNotNull() & ~F.isnan(confidence) & (F.abs(confidence) < float("inf"))
    out = F.struct(box.alias("bbox"), source.alias("source_text"), target.alias("translation"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"))
    return F.when(F.coalesce(shape & said & kept & sized & sure, F.lit(False)), out)


def _has(text: Column, lang: str) -> Column:
    return text.rlike(r"[\p{L}]" if base_language(lang) in ("", "auto", "unknown", "und") else f"[{script_class(lang)}]")


def with_regions(df: DataFrame, raw: str, source_lang: str, target_lang: str, name: str = "regions") -> DataFrame:
    """Adds the regions of the answers in a column."""
    told = df.withColumn("__object", decode_object(F.col(raw)))
    return told.withColumn(name, regions(F.col("__object"), source_lang, target_lang)).drop("__object")


def regions(decoded: Column, source_lang: str, target_lang: str) -> Column:
    """Clean, distinct regions of a decoded answer, by top edge, then left edge."""
    parsed = F.slice(F.from_json(decoded, f"struct<regions: array<{_RAW}>>")["regions"], 1, MOST_REGIONS)
    good = F.array_distinct(F.array_compact(F.transform(parsed, lambda r: clean_region(r, source_lang, target_lang))))
    # Confidence tells no regions apart; of equal ones the first stays.
    named = F.transform(good, lambda r, i: F.struct(r["bbox"][1].alias("y"), r["bbox"][0].alias("x"), i.alias("i"), r.alias("r")))
    same = lambda a, b: (a["r"]["bbox"] == b["r"]["bbox"]) & (a["r"]["source_text"] == b["r"]["source_text"]) & (a["r"]["translation"] == b["r"]["translation"])
    first = F.filter(named, lambda a: ~F.exists(named, lambda b: (b["i"] < a["i"]) & same(a, b)))
    return F.coalesce(F.transform(F.array_sort(first), lambda x: x["r"]), F.array().cast(f"array<{REGION}>"))
