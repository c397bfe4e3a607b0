"""Job progress from log lines, in batch and as a stream; event-time extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: what the logs of the jobs look like --------------------------------
EVENT_PREFIX = "@@VISION@@"
STAGE = r"=== ЭТАП: (\w+) ==="
BAR = r"(\d+)%\|.*?\|\s*(\d+)/(\d+)"
COUNTS = r"ok=(\d+)\s+cached=(\d+)\s+fail=(\d+)"
PARSE_PAGE = r"parse page (\d+)/(\d+)"
SEGMENTS = r"Сегментов:\s+(\d+)"
VALIDATED = r"ВАЛИДАЦИЯ ПРОЙДЕНА|НАЙДЕНЫ ПРОБЛЕМЫ"
PAGES = r"(?is)страниц:\s+src=(\d+)\s+out=(\d+).*?изображ\.:?\s+src=(\d+)\s+out=(\d+)"
IMAGE_PROGRESS = r"(?iU)(?:progress|image|изображ\w*)[^\d]*(\d+)\s*/\s*(\d+)"
IMAGE_COUNTS = r"(?i)(?:ok|processed)=(\d+)(?:\s+cached=(\d+))?\s+(?:fail|failed|errors?)=(\d+)"
IMAGE_PHASE = r"(?iU)(?:phase|этап)\s*[:=]\s*([\w.-]+)"
# ----------------------------------------------------------------------------------------

STATE = ("stage", "progress", "total", "ok", "cached", "fail", "pages", "images")
IMAGE_STATE = ("phase", "progress", "total", "ok", "cached", "failed", "message")


def _group(line: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(line, pattern, n).try_cast("int")


def job_updates(line: Column) -> Column:
    """What a log line sets of a job's state; null parts stay.  A new stage zeroes progress and total.

    The first kind of line that fits counts.
    """
    kinds = ("stage", STAGE), ("segments", SEGMENTS), ("bar", BAR), ("counts", COUNTS), ("parse", PARSE_PAGE)
    kind = F
    for name, pattern in kinds:
        kind = kind.when(line.rlike(f"(?U){pattern}"), name)
    other = F.struct(F.when(line.rlike(VALIDATED), "validate").alias("stage"), F.when(line.rlike(PAGES), _group(line, PAGES, 2)).alias("pages"), F.when(line.rlike(PAGES), _group(line, PAGES, 4)).alias("images"))
    is_ = lambda k: kind == k
    n = lambda p, i: _group(line, p, i)
    return F.struct(
        F.when(is_("stage"), F.lower(F.regexp_extract(line, f"(?U){STAGE}", 1))).when(is_("parse"), "parse").when(kind.isNull(), other["stage"]).alias("stage"),
        F.when(is_("stage"), 0).when(is_("bar"), n(BAR, 2)).when(is_("parse"), n(PARSE_PAGE, 1)).alias("progress"),
        F.when(is_("stage"), 0).when(is_("segments"), n(SEGMENTS, 1)).when(is_("bar"), n(BAR, 3)).when(is_("parse"), n(PARSE_PAGE, 2)).alias("total"),
        F.when(is_("counts"), n(COUNTS, 1)).alias("ok"),
        F.when(is_("counts"), n(COUNTS, 2)).alias("cached"),
        F.when(is_("counts"), n(COUNTS, 3)).alias("fail"),
        F.when(kind.isNull(), other["pages"]).alias("pages"),
        F.when(kind.isNull(), other["images"]).alias("images"),
    )


def image_updates(line: Column) -> Column:
    """What a line of the image job sets: a structured event after its prefix, else plain output."""
    text = F.trim(line)
    body = F.trim(F.substr(text, F.lit(len(EVENT_PREFIX) + 1)))
    is_event = F.startswith(text, F.lit(EVENT_PREFIX)) & F.startswith(F.schema_of_variant(F.try_parse_json(body)), F.lit("OBJECT"))
    e = F.from_json(F.when(is_event, body), "map<string, string>")
    said = F.coalesce(*[F.nullif(e[k], F.lit("")) for k in ("phase", "stage", "event")])
    number = lambda *ks: F.greatest(F.lit(0), F.coalesce(*[e[k].try_cast("int") for k in ks]))
    # With both progress kinds in a line, the image kind counts.
    bar = ~text.rlike(IMAGE_PROGRESS) & text.rlike(BAR)
    plain = lambda p, i: F.when(text.rlike(p), _group(text, p, i))
    known = lambda *ks: F.when(F.coalesce(*[e[k].try_cast("int") for k in ks]).isNotNull(), number(*ks))
    return F.struct(
        F.when(is_event, F.when(~F.lower(said).isin("progress", "log"), F.substring(said, 1, 80))).when(text.rlike(IMAGE_PHASE), F.substring(F.regexp_extract(text, IMAGE_PHASE, 1), 1, 80)).alias("phase"),
        F.when(is_event, known("progress", "current")).when(bar, _group(text, BAR, 2)).otherwise(plain(IMAGE_PROGRESS, 1)).alias("progress"),
        F.when(is_event, known("total")).when(bar, _group(text, BAR, 3)).otherwise(plain(IMAGE_PROGRESS, 2)).alias("total"),
        F.when(is_event, known("processed", "ok")).otherwise(plain(IMAGE_COUNTS, 1)).alias("ok"),
        F.when(is_event, known("cached")).when(text.rlike(IMAGE_COUNTS), F.coalesce(_group(text, IMAGE_COUNTS, 2), F.lit(0))).alias("cached"),
        F.when(is_event, known("errors", "fail", "failed")).otherwise(plain(IMAGE_COUNTS, 3)).alias("failed"),
        F.when(is_event, F.coalesce(F.nullif(e["message"], F.lit("")), e["log"])).otherwise(F.nullif(text, F.lit(""))).alias("message"),
    )


def latest_state(lines: DataFrame, keys: list[str], seq: str, updates: Column, parts: tuple[str, ...]) -> DataFrame:
    """The state of each key after all lines: the last value set of each part.

    One partially aggregated pass; on a stream, run it in update mode.
    """
    told = lines.select(*keys, seq, updates.alias("u"))
    return told.groupBy(*keys).agg(*[F.max_by(F.col(f"u.{p}"), F.when(F.col(f"u.{p}").isNotNull(), F.col(seq))).alias(p) for p in parts])


def job_states(lines: DataFrame, keys: list[str] = ["job"], seq: str = "seq") -> DataFrame:  # noqa: B006
    return latest_state(lines, keys, seq, job_updates(F.col("line")), STATE)


def image_states(lines: DataFrame, keys: list[str] = ["job"], seq: str = "seq") -> DataFrame:  # noqa: B006
    return latest_state(lines, keys, seq, image_updates(F.col("line")), IMAGE_STATE)


# Extensions that the engine offers beside its jobs: event time on streams.


def windowed(events: DataFrame, time: str, length: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    """Aggregates over tumbling or sliding windows; on a stream, events later than ``late`` are left out."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def sessions(events: DataFrame, time: str, gap: str, late: str = "1 hour", keys: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggregates)
