"""The text functions as temporary SQL functions; their bodies are inlined by Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

from textmill.functions import text as T


#: name -> (parameters, type, body)
FUNCTIONS = {
    "tm_strip": ("s STRING", "STRING", rf"regexp_replace(s, r'\A{T.WS}+|{T.WS}+\z', '')"),
    "tm_squash": ("s STRING", "STRING", rf"regexp_replace(s, r'{T.WS}+', '')"),
    "tm_one_line": ("s STRING", "STRING", rf"regexp_replace(regexp_replace(s, r'{T.WS}+', ' '), r'\A +| +\z', '')"),
    "tm_meaningful_chars": ("s STRING", "INT", r"length(regexp_replace(s, r'[^\p{L}\p{N}]', ''))"),
    "tm_han_chars": ("s STRING", "INT", f"length(regexp_replace(s, r'[^{T.TARGET['zh']}]', ''))"),
    "tm_escape_html": ("s STRING", "STRING", "replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"),
    "tm_cache_key": ("s STRING, model STRING, prompt_hash STRING", "STRING", "sha2(concat_ws(char(0), s, model, prompt_hash), 256)"),
    "tm_rect_area": ("r ARRAY<DOUBLE>", "DOUBLE", "greatest(r[2] - r[0], 0) * greatest(r[3] - r[1], 0)"),
    "tm_bag_minus": ("a ARRAY<STRING>, b ARRAY<STRING>", "ARRAY<STRING>", "flatten(transform(array_sort(array_distinct(a)), x -> array_repeat(x, greatest(size(filter(a, y -> y = x)) - size(filter(b, y -> y = x)), 0))))"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to SQL in this session."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
