"""The registered queries of this subpackage: each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import chat, langid, mixing, packing, quality_classifier, quality_rules, secrets, simhash, topk, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@_query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


ORACLES["op6_secrets"] = secrets.oracle_sql()


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


ORACLES["op8_mixing"] = mixing.oracle_sql()


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


@_query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.struct("conv_id", F.lit(0).alias("probe")).alias("conv_id"), "turn", "role", "text")
    # A conversation of its own, also where the table has one that is called -1.
    probe = spark.sql(f"SELECT named_struct('conv_id', -1L, 'probe', 1) AS conv_id, * FROM VALUES (0L, 'user', '{chat.PROBE}'), (1L, 'assistant', '{chat.PROBE}') AS t(turn, role, text)")
    told = chat.digest(chat.format_trees(chat.chain(turns.unionAll(probe))))
    return told.withColumn("conv_id", F.col("conv_id.conv_id"))


ORACLES["op5_chat"] = chat.oracle_sql()


@_query
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op7_top_k"] = topk.oracle_sql()


@_query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op10_url_filter"] = urlfilter.oracle_sql()


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


@_query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
