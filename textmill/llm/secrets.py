"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Base patterns give fixed spans.  Besides, long random-looking tokens are
candidates.  The hash of each candidate's value is counted over distinct
repositories and owners of the whole corpus: a value that many of them hold is an
example that was copied around, one that few owners hold and that looks random is
taken for a live credential.  Live tokens add spans; base spans stay either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.folds import running
from textmill.llm.scratch import UID, own, packed_rows, stash, unpacked, with_uid

#: Kinds in the order that breaks ties between spans with one start.
KINDS = ("assign", "access", "hex", "token")
#: pattern, group that holds the value, its least length
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # Runs of the next three are maximal, so the least length can be part of the pattern.
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "token": (r"[A-Za-z0-9_+/-]{20,}", 0, 20),
}
_SPAN = "struct<start: int, kind: int, end: int, hash: string, live: boolean>"


def _random_looking(value: Column) -> Column:
    """Letters and at least 3 digits, 10 distinct characters, no placeholder word, at least 20 characters."""
    digits = F.regexp_count(value, F.lit("[0-9]"))
    letters = F.regexp_count(value, F.lit("[A-Za-z]"))
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= 20) & (digits >= 3) & (letters >= 3) & (distinct >= 10) & ~value.rlike("(?i)example|sample|dummy|xxxx|1234567|changeme")


def find(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of one kind: array of (start, kind, end, hash, live-looking).

    Offsets count code points; ends are exclusive.
    """
    pattern, group, least = PATTERNS[kind]
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m)).alias("size"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    parts = F.filter(parts, lambda p: p["value"].isNotNull())
    state = "struct<start: int, end: int, value: string>"
    zero = F.struct(F.lit(0), F.lit(0), F.lit(""))
    at = running(parts, zero, lambda s, p: F.struct((s["end"] + p["gap"]).alias("start"), (s["end"] + p["gap"] + p["size"]).alias("end"), p["value"].alias("value")), state)
    long_enough = F.filter(at, lambda s: F.length(s["value"]) >= least)
    spans = F.transform(long_enough, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), F.sha2(s["value"].cast("binary"), 256).alias("hash"), _random_looking(s["value"]).alias("live")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _scanned(rows: DataFrame) -> DataFrame:
    """Adds base (spans of the three base kinds) and tokens (random-looking candidates)."""
    base = F.array_sort(F.concat(*[find(F.col("text"), k) for k in KINDS[:3]]))
    return rows.withColumn("base", base).withColumn("tokens", F.filter(find(F.col("text"), "token"), lambda s: s["live"]))


def verdicts(candidates: DataFrame, example_owners: int = 3, example_repos: int = 5) -> DataFrame:
    """(hash, owner, repo) -> (hash, owners, repos, copied), one row for each hash."""
    held = candidates.select("hash", "owner", "repo").distinct()
    counted = held.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    return counted.withColumn("copied", (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos))


def _judged(scanned: DataFrame, example_owners: int, example_repos: int) -> DataFrame:
    """(uid, added, n_live, n_example) of the rows with any candidate."""
    found = scanned.where((F.size("base") > 0) | (F.size("tokens") > 0))
    each = found.select(UID, "owner", "repo", F.explode(F.concat("base", "tokens")).alias("span")).withColumn("hash", F.col("span.hash"))
    copied = verdicts(each, example_owners, example_repos).select("hash", "copied")
    live = F.col("span.live") & ~F.col("copied")
    told = each.join(copied, "hash").withColumn("is_live", live)
    plain = F.struct("span.start", "span.kind", "span.end")
    return told.groupBy(UID).agg(
        F.array_sort(F.collect_list(F.when((F.col("span.kind") == 3) & F.col("is_live"), plain))).alias("added"),
        F.count_distinct(F.when(F.col("is_live"), F.col("hash"))).alias("n_live"),
        F.count_distinct(F.when(F.col("copied"), F.col("hash"))).alias("n_example"),
    )


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _spans(scanned: DataFrame, example_owners: int, example_repos: int) -> DataFrame:
    """``scanned`` with all spans in order, and the counts of distinct live and copied values."""
    judged = _judged(scanned, example_owners, example_repos)
    out = scanned.join(judged, UID, "left")
    added = F.coalesce(F.col("added"), F.array().cast("array<struct<start: int, kind: int, end: int>>"))
    out = out.withColumn("spans", F.array_sort(F.concat(_plain(F.col("base")), added)))
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_live", "n_example")})


def _of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _owned(docs: DataFrame, text_col: str, owner_col: str, repo_cols: tuple[str, ...], **more) -> DataFrame:
    repo = F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in repo_cols])
    return own(docs, text=text_col, owner=F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")), repo=repo, **more)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = 3, example_repos: int = 5) -> DataFrame:
    """One row for each row of ``docs``: id, n_assign, n_access, n_hex, base, spans, n_live, n_example.

    ``base`` and ``spans`` are arrays of (start, kind, end) in order of start, then
    kind.  A null text is empty; null owners and repositories count as one named ''.
    Repeated rows are all returned; they count once for their owner.  An empty
    table gives no rows.  Other columns are ignored.
    """
    scanned = _scanned(with_uid(_owned(docs, text_col, owner_col, repo_cols, id=id_col))).drop("text")
    out = _spans(stash(scanned, "secrets"), example_owners, example_repos)
    counts = [_of_kind(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return out.select(F.col("id").alias(id_col), *counts, _plain(F.col("base")).alias("base"), "spans", "n_live", "n_example")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``scan``'s rows with spans written as ``kind:start:end`` and the base spans' hash."""
    return found.select(id_col, "n_assign", "n_access", "n_hex", F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), "n_live", "n_example")


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), length_col: str | None = "n_chars", mask: str = "[SECRET]", example_owners: int = 3, example_repos: int = 5) -> DataFrame:
    """``docs`` with the spans of every text replaced by ``mask``; overlapping spans get one.

    All rows and columns stay, whatever they are called; ``length_col``, if the table has it, follows the text.  Null texts stay
    null.  Repeated rows are masked alike.  An empty table gives no rows.
    """
    columns = docs.columns
    base = F.array_sort(F.concat(*[find(F.col("text"), k) for k in KINDS[:3]]))
    tokens = F.filter(find(F.col("text"), "token"), lambda s: s["live"])
    owner = F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit(""))
    repo = F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in repo_cols])
    held = packed_rows(docs, text=text_col, owner=owner, repo=repo)
    held = with_uid(held.select("row", "owner", "repo", base.alias("base"), tokens.alias("tokens")))
    held = stash(held, "redact-input")
    hit = (F.size("base") > 0) | (F.size("tokens") > 0)
    spans = _spans(held.where(hit).select(UID, "owner", "repo", "base", "tokens"), example_owners, example_repos).select(UID, "spans")
    marked = held.where(hit).select(UID, "row").join(spans, UID)
    state = "struct<start: int, before: int, end: int>"
    merged = running(F.col("spans"), F.struct(F.lit(-1), F.lit(0), F.lit(0)), lambda s, x: F.struct(x["start"].alias("start"), s["end"].alias("before"), F.greatest(s["end"], x["end"]).alias("end")), state)
    text = F.col("row").getField(text_col)

    def piece(s: Column) -> Column:
        """The text before a span and the mask; no second mask where a span touches the one before it."""
        masked = F.when((s["start"] == s["before"]) & (s["before"] > 0), F.lit("")).otherwise(F.lit(mask))
        gap = F.substring(text, s["before"] + 1, s["start"] - s["before"])
        return F.when(s["start"] >= s["before"], F.concat(gap, masked)).otherwise(F.lit(""))

    rest = F.substring(text, F.element_at("merged", -1)["end"] + 1, F.length(text))
    marked = marked.withColumn("merged", merged)
    said = F.when(F.size("merged") > 0, F.concat(F.array_join(F.transform("merged", piece), ""), rest)).otherwise(text)
    marked = marked.select("row", said.alias("said"))
    changed = {text_col: F.col("said")}
    if length_col in columns:
        changed[length_col] = F.length("said").cast(docs.schema[length_col].dataType)
    return unpacked(held.where(~hit), columns).unionAll(unpacked(marked, columns, **changed))


def oracle_sql(example_owners: int = 3, example_repos: int = 5) -> str:
    """DuckDB SQL for the digest of all ``documents``."""
    found = " UNION ALL ".join(
        f"""SELECT rid, owner, repo, {k} AS kind, {least} AS least, regexp_extract_all(t, '{p.replace("'", "''")}', 0) AS m, regexp_extract_all(t, '{p.replace("'", "''")}', {group}) AS v, string_split_regex(t, '{p.replace("'", "''")}') AS g FROM d"""
        for k, (p, group, least) in enumerate(PATTERNS.values())
    )
    names = ", ".join(f"'{k}'" for k in KINDS)
    written = f"string_agg([{names}][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo, coalesce(text, '') AS t FROM documents),
f AS ({found}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS n FROM f WHERE len(m) > 0),
x AS MATERIALIZED (SELECT rid, owner, repo, kind, v[n] AS value, sha256(v[n]) AS hash,
  (list_sum(list_transform(g[1:n], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:n - 1], lambda y: length(y))), 0))::BIGINT AS s, length(m[n]) AS size FROM i WHERE length(v[n]) >= least),
a AS (SELECT *, s + size AS e, length(value) >= 20 AND len(regexp_extract_all(value, '[0-9]')) >= 3 AND len(regexp_extract_all(value, '[A-Za-z]')) >= 3
  AND len(list_distinct(string_split(value, ''))) >= 10 AND NOT regexp_matches(value, '(?i)example|sample|dummy|xxxx|1234567|changeme') AS random_looking FROM x),
c AS MATERIALIZED (SELECT * FROM a WHERE kind < 3 OR random_looking),
h AS (SELECT hash, count(DISTINCT owner) >= {example_owners} OR count(DISTINCT repo) >= {example_repos} AS copied FROM c GROUP BY hash),
j AS (SELECT c.*, h.copied, random_looking AND NOT h.copied AS live FROM c JOIN h USING (hash)),
o AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  {written} FILTER (WHERE kind < 3) AS base, {written} FILTER (WHERE kind < 3 OR live) AS spans, count(DISTINCT hash) FILTER (WHERE live) AS n_live, count(DISTINCT hash) FILTER (WHERE copied) AS n_example FROM j GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN o USING (rid)
"""
