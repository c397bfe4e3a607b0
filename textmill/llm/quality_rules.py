"""Quality rules: base rules and robust multivariate outliers.

Each text's statistics are transformed into a vector.  For each language, and for each source
within it, minimum-covariance-determinant estimates of centre and scatter are sought: from each
of four starts, the nearest ``PART`` of a group's rows by Mahalanobis distance make the next
estimate until its determinant falls no further, and the least determinant of all starts stands.
Distances are ordered by a fine logarithmic histogram for each group, so a step is
two grouped sums over a narrow table; nothing is sorted and no group is gathered.  Sources lean on their language's estimate as if it were ``LEAN`` rows more.
Vectors beyond the cut are rejected.

What a language's short texts are drawn to, and below what its scatter is never taken to be, come from its medians.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.scratch import UID, drop, own, small_batches, stash, with_uid

#: Part of a group's rows that an estimate rests on, and the least fall of a log determinant that is worth another step.
PART, FALL = 0.75, 1e-6
#: A source leans on its language's estimate as if that were so many rows more.
LEAN = 50
#: Tail of the chi-squared distribution beyond which a vector is rejected.
TAIL = 1e-6
FEATURES = ("word_length", "symbols", "other", "upper", "marks")
#: Short texts are drawn to their language's medians, as if they had so many words more of that kind.
DRAW = 30
#: No scatter is taken to be smaller than what one character in a hundred changes.
GRAIN = 0.01
_SYMBOLS, _MARKS = np.frombuffer(b"#*$%&|<>", np.uint8), np.frombuffer(b".,;:!?", np.uint8)
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long, n_marks long"
_BEYOND = re.compile("[^\x00-\x7f]")
_SPACE = np.frombuffer(b" \t\n\v\f\r", np.uint8)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first included."""
    if len(words) <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code, many = ids, len(number)
    # Windows grow by a word at a time; equal codes are equal windows.
    for k in range(1, width):
        found, code = np.unique(code[: len(ids) - k] * many + ids[k:], return_inverse=True)
        if len(found) == len(ids) - k:
            return 0
    twice = np.bincount(code)[code] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(width):
        inside[k : len(ids) - width + 1 + k] |= twice
    return int(inside.sum())


def byte_counts(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def statistics(text: str | None) -> tuple[int, ...]:
    """The columns of ``_STATS``; a null text has none of anything."""
    text = text or ""
    raw = text.encode()
    counts, words = byte_counts(raw), raw.split()
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    # Code points beyond ASCII are counted as letters only if they are.
    beyond = sum(n for c, n in Counter(_BEYOND.findall(text)).items() if c.isalpha()) if counts[0x80:].any() else 0
    points = len(raw) - counts[0x80:0xC0].sum()
    return (len(words), int(points - counts[_SPACE].sum()), int(counts[_SYMBOLS].sum()), duplicate_lines(text), repeated_words(words), int(upper), int(upper + lower + beyond), int(counts[_MARKS].sum()))


def statistics_column(text: Column) -> Column:
    @F.pandas_udf(_STATS)
    def told(texts: pd.Series) -> pd.DataFrame:
        rows = np.array([statistics(t) for t in texts], np.int64).reshape(len(texts), 8)
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _STATS.split(", ")])

    return told(text)


def raw_features() -> dict[str, Column]:
    """Transformed statistics of a text; shares are square-rooted, symbols saturate."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "word_length": chars / n,
        "symbols": F.log1p(F.col("n_symbols") / n),
        "other": F.sqrt(F.greatest(1 - (F.col("n_letters") + F.col("n_symbols")) / chars, F.lit(0.0))),
        "upper": F.sqrt(F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))),
        "marks": F.sqrt(F.col("n_marks") / n),
    }


def usual_and_floors(rows: DataFrame) -> DataFrame:
    """(of_lang, features) -> (of_lang, usual, floors): medians of each language, and what ``GRAIN`` changes there."""
    middle = rows.groupBy("of_lang").agg(*[F.percentile_approx(f, 0.5).alias(f) for f in FEATURES])
    grown = lambda f, by: F.sqrt(F.col(f) * F.col(f) + by) - F.col(f)
    word = F.col("word_length") * GRAIN
    floors = F.array(word, F.log1p(word), grown("other", F.lit(GRAIN)), grown("upper", F.lit(GRAIN)), grown("marks", word))
    return middle.select("of_lang", F.array(*FEATURES).alias("usual"), F.transform(floors, lambda x: F.greatest(x, F.lit(1e-6))).alias("floors"))


def drawn() -> dict[str, Column]:
    """Features drawn to ``usual``, the less the longer a text is."""
    n = F.col("n_words").cast("double")
    return {f: (F.col(f) * n + F.element_at("usual", i + 1) * DRAW) / (n + DRAW) for i, f in enumerate(FEATURES)}


def chi2_quantile(q: float, p: int) -> float:
    """Wilson and Hilferty's approximation."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * (2 / (9 * p)) ** 0.5) ** 3


def chi2_below(x: float, p: int) -> float:
    return NormalDist().cdf(((x / p) ** (1 / 3) - (1 - 2 / (9 * p))) / (2 / (9 * p)) ** 0.5)


#: Makes the scatter of the nearest ``PART`` that of a whole normal sample.
CONSISTENCY = PART / chi2_below(chi2_quantile(PART, len(FEATURES)), len(FEATURES) + 2)
_P = len(FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]


def _distance() -> Column:
    """Squared Mahalanobis distance from ``centre`` under ``inverse`` (upper triangle)."""
    off = [F.col(f) - F.element_at("centre", i + 1) for i, f in enumerate(FEATURES)]
    terms = [off[i] * off[j] * F.element_at("inverse", k + 1) * (1 if i == j else 2) for k, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


def _moments(values: list[Column], name: str = "s") -> list[Column]:
    sums = [F.sum(v).alias(f"{name}{i}") for i, v in enumerate(values)]
    return sums + [F.sum(values[i] * values[j]).alias(f"{name}{i}_{j}") for i, j in _PAIRS]


def _spread(row: dict, name: str, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from the sums of n rows."""
    centre = np.array([row[f"{name}{i}"] for i in range(_P)]) / n
    scatter = np.zeros((_P, _P))
    for i, j in _PAIRS:
        scatter[i, j] = scatter[j, i] = row[f"{name}{i}_{j}"] / n - centre[i] * centre[j]
    return centre, scatter


def settled(scatter: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """A scatter that is nowhere below the floors, the upper triangle of its inverse, its log determinant."""
    scatter = scatter + np.diag(np.maximum(floors**2 - np.diag(scatter), 0)) + 1e-9 * np.eye(_P)
    inverse = np.linalg.inv(scatter)
    return scatter, np.array([inverse[i, j] for i, j in _PAIRS]), float(np.linalg.slogdet(scatter)[1])


_ESTIMATE = "g string, start int, n long, centre array<double>, scatter array<double>, inverse array<double>, det double, open boolean, floors array<double>"


def _estimate(row: dict, start: int, n: int, centre: np.ndarray, scatter: np.ndarray, before: float | None) -> dict:
    floors = np.array(row["floors"])
    scatter, inverse, det = settled(scatter, floors)
    open_ = before is None or det < before - FALL
    return {"g": row["g"], "start": start, "n": n, "centre": centre.tolist(), "scatter": scatter.ravel().tolist(), "inverse": inverse.tolist(), "det": det, "open": open_, "floors": floors.tolist()}


def _begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Four starts of each group: medians with squared deviations, with correlations of tanh scores or of spatial signs, and plain moments."""
    for pdf in batches:
        out = []
        for r in pdf.to_dict("records"):
            n = max(r["n"], 1)
            middle, scale = np.array(r["middle"]), np.array(r["scale"])
            bent = _spread(r, "t", n)[1]
            sd = np.sqrt(np.maximum(np.diag(bent), 1e-12))
            bent = bent / np.outer(sd, sd)
            np.fill_diagonal(bent, 1)
            signs = _spread(r, "u", n)
            signs = (signs[1] + np.outer(signs[0], signs[0])) * _P
            starts = [(middle, np.diag(scale**2)), (middle, bent * np.outer(scale, scale)), (middle, signs * np.outer(scale, scale)), _spread(r, "s", n)]
            out += [_estimate(r, k, r["n"], *x, None) for k, x in enumerate(starts)]
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _ESTIMATE.split(", ")])


def _stepped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.to_dict("records"):
            centre, scatter = _spread(r, "s", max(r["n"], 1))
            out.append(_estimate(r, r["start"], r["whole"], centre, CONSISTENCY * scatter, r["before"]))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _ESTIMATE.split(", ")])


def _start(rows: DataFrame, floors: DataFrame) -> DataFrame:
    values = [F.col(f) for f in FEATURES]
    middle = stash(rows.groupBy("g").agg(*[F.percentile_approx(f, 0.5).alias(f"m{i}") for i, f in enumerate(FEATURES)]), "mcd-middles")
    off = rows.join(middle, "g")
    far = off.groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(f) - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i, f in enumerate(FEATURES)])
    scales = far.join(middle, "g").join(floors, "g")
    scale = F.array(*[F.greatest(1.4826 * F.col(f"d{i}"), F.element_at("floors", i + 1)) for i in range(_P)])
    scales = stash(scales.select("g", "floors", F.array(*[f"m{i}" for i in range(_P)]).alias("middle"), scale.alias("scale")), "mcd-scales")
    scores = rows.join(scales.select("g", "middle", "scale"), "g")
    scores = scores.withColumns({f"z{i}": (v - F.element_at("middle", i + 1)) / F.element_at("scale", i + 1) for i, v in enumerate(values)})
    z = [F.col(f"z{i}") for i in range(_P)]
    scores = scores.withColumn("norm", F.greatest(F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0])), F.lit(1e-9)))
    sums = _moments(values) + _moments([F.tanh(x) for x in z], "t") + _moments([x / F.col("norm") for x in z], "u")
    moments = scores.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *sums).join(scales, "g")
    out = stash(moments.mapInPandas(_begun, _ESTIMATE), "mcd")
    drop(scales)
    return out


def _concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One step: each estimate from its group's nearest rows, which a histogram of distances tells."""
    at = rows.join(estimates.select("g", "start", "centre", "inverse"), "g").withColumn("bin", F.floor(16 * F.log2(_distance() + 1e-9)).cast("int"))
    at = at.select("g", "start", "bin", *FEATURES)
    by = Window.partitionBy("g", "start")
    bins = at.groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("whole", F.sum("n").over(by))
    cuts = bins.where(F.col("upto") - F.col("n") < F.col("whole") * PART).groupBy("g", "start").agg(F.max("bin").alias("cut"), F.max("whole").alias("whole"))
    cuts = cuts.join(estimates.select("g", "start", F.col("det").alias("before"), "floors"), ["g", "start"])
    cuts = stash(cuts, "mcd-cuts")
    near = at.join(cuts.select("g", "start", "cut"), ["g", "start"]).where("bin <= cut")
    moments = near.groupBy("g", "start").agg(F.count(F.lit(1)).alias("n"), *_moments([F.col(f) for f in FEATURES]))
    out = stash(moments.join(cuts.drop("cut"), ["g", "start"]).mapInPandas(_stepped, _ESTIMATE), "mcd")
    drop(cuts)
    return out


def minimum_determinants(rows: DataFrame, floors: DataFrame) -> DataFrame:
    """(g, features) and (g, floors) -> (g, n, centre, scatter, floors): the estimate of least determinant of each group."""
    now, found = _start(rows, floors), None
    while True:
        now = _concentrate(rows, now.where("open"))
        found = now if found is None else found.unionAll(now)
        if now.where("open").isEmpty():
            break
    best = F.min_by(F.struct("n", "centre", "scatter", "floors"), F.struct("det", "start"))
    return found.groupBy("g").agg(best.alias("e")).select("g", "e.*")


def _leaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.to_dict("records"):
            share = LEAN / (r["n"] + LEAN)
            centre = (1 - share) * np.array(r["centre"]) + share * np.array(r["base_centre"])
            scatter = (1 - share) * np.array(r["scatter"]) + share * np.array(r["base_scatter"])
            inverse = settled(scatter.reshape(_P, _P), np.array(r["floors"]))[1]
            out.append({"of_source": r["of_source"], "centre": centre.tolist(), "inverse": inverse.tolist()})
        yield pd.DataFrame(out, columns=["of_source", "centre", "inverse"])


def fit(rows: DataFrame, floors: DataFrame) -> DataFrame:
    """(of_lang, of_source, features) and (of_lang, floors) -> (of_source, centre, inverse): each source's estimate."""
    groups = stash(rows.select("of_lang", "of_source").distinct(), "mcd-groups")
    named = groups.join(floors, "of_lang")
    lows = named.select(F.col("of_lang").alias("g"), "floors").unionAll(named.select(F.col("of_source").alias("g"), "floors")).groupBy("g").agg(F.first("floors").alias("floors"))
    each = rows.select(F.explode(F.array("of_lang", "of_source")).alias("g"), *FEATURES)
    found = stash(minimum_determinants(each, stash(lows, "mcd-floors")), "mcd-least")
    base = found.select(F.col("g").alias("of_lang"), F.col("centre").alias("base_centre"), F.col("scatter").alias("base_scatter"))
    both = groups.join(found.withColumnRenamed("g", "of_source"), "of_source").join(base, "of_lang")
    return stash(both.mapInPandas(_leaned, "of_source string, centre array<double>, inverse array<double>"), "mcd-sources")


def _key(*columns: str) -> Column:
    """A name of a group that no other group has, whatever its columns hold; nulls are groups of their own."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns]
    return F.concat(F.lit(f"{len(columns)}/"), *parts)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """One row for each row of ``docs``: id, the base statistics, base_failed, distance, kept.

    A null text has no words and fails the base rules, as does any text of fewer than
    10 words or with over 20% of its words repeated.  Null languages and sources
    are groups of their own.  ``distance`` (squared) is null where the base rules
    fail.  Repeated rows are all returned.  An empty table gives no rows.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    lang, source = (F.col(f"`{c}`").cast("string") for c in (lang_col, source_col))
    rows = own(docs, id=id_col, lang=lang, source=source, text=text_col)
    told = with_uid(rows.select("id", "lang", "source", statistics_column(F.col("text")).alias("told")))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    told = told.select(UID, "id", _key("lang").alias("of_lang"), _key("lang", "source").alias("of_source"), "told.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    told = stash(told.withColumn("base_failed", failed).withColumns(raw_features()), "quality-statistics")
    rest = told.where(~F.col("base_failed"))
    usual = stash(usual_and_floors(rest), "quality-usual")
    rest = stash(rest.join(usual.select("of_lang", "usual"), "of_lang").withColumns(drawn()).select("id", *stats, "base_failed", "of_lang", "of_source", *FEATURES), "quality-vectors")
    near = rest.join(fit(rest.select("of_lang", "of_source", *FEATURES), usual.select("of_lang", "floors")), "of_source")
    cut = chi2_quantile(1 - tail, _P)
    good = near.select("id", *stats, "base_failed", _distance().alias("distance"), (_distance() <= cut).alias("kept"))
    bad = told.where("base_failed").select("id", *stats, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return good.unionAll(bad).withColumnRenamed("id", id_col)
