"""Content-addressed caches as append-only logs: the latest row of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.config import Settings


def key(text: Column, model: Column | str, prompt_hash: Column) -> Column:
    m = F.lit(model) if isinstance(model, str) else model
    return F.sha2(F.concat_ws("\0", text, m, prompt_hash).cast("binary"), 256)


def vision_key(image_hash: Column, source: str, target: str, model: str, version: str) -> Column:
    return F.sha2(F.concat_ws("\0", image_hash, *map(F.lit, (source, target, model, version))).cast("binary"), 256)


def prompt_hash(s: Settings, system: str, contract: str, version: str) -> str:
    """Of all that shapes an answer besides the text; equal settings give equal hashes."""
    import hashlib
    import json

    parts = {"version": version, "system": system, "user_contract": contract, "model": s.model, "source_lang": s.source_lang, "target_lang": s.target_lang, "generation": {"enable_thinking": s.enable_thinking, "max_tokens": s.max_tokens, "temperature": s.temperature, "top_p": s.top_p}}
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:20]


def segment_hash(base: str, context_json: Column, glossary: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(F.lit(base).alias("base"), context_json.alias("context"), glossary.alias("glossary"))).cast("binary"), 256), 1, 20)


def upgraded(log: DataFrame) -> DataFrame:
    """A log of any age with the columns that later ones have."""
    if "accepts_review" not in log.columns:
        log = log.withColumn("accepts_review", F.lit(1))
    if "prompt_version" not in log.columns and "src_img_hash" in log.columns:
        log = log.withColumn("prompt_version", F.lit(""))
    return log


def current(log: DataFrame, seq: str = "ts") -> DataFrame:
    """The latest row of each key, with those rejected left out; ``seq`` orders the log."""
    log = upgraded(log)
    rest = [c for c in log.columns if c != "key"]
    last = log.groupBy("key").agg(F.max_by(F.struct(*rest), F.col(seq)).alias("last")).select("key", "last.*")
    return last.where(F.coalesce("accepts_review", F.lit(1)) > 0)


def rejected(rows: DataFrame) -> DataFrame:
    """Log rows that take keys out of use."""
    return rows.withColumn("accepts_review", F.lit(0))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def lookup(records: DataFrame, cache: DataFrame, key_col: str = "cache_key") -> DataFrame:
    """Records with cached and review of their key, null where the cache has none."""
    found = cache.select(F.col("key").alias(key_col), F.col("dst").alias("cached"), F.col("accepts_review").alias("review"))
    return records.join(found, key_col, "left")
