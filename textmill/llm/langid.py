"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed letter trigrams, learned from a
bounded sample of labelled rows.  A document's trigrams are a mixture of these:
expectation-maximisation estimates its language proportions, for nested language
sets in order of the proportions under all languages, and the set with the highest
penalised likelihood is selected.  The document's language is the largest of the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.scratch import own, packed_rows, small_batches, unpacked

UNKNOWN = "und"
DIM = 4096
#: Most bytes of a model that is broadcast: some 6,000 languages.
MODEL_BYTES = 1 << 28
#: Bytes at once; bounds the memory of a very long text.
CHUNK = 1 << 20
_LETTERS = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed trigrams of a text's letters, words parted by one space."""
    raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)
    counts = np.zeros(DIM, np.int64)
    for at in range(0, max(1, len(raw)), CHUNK):
        b = _LETTERS[raw[max(0, at - 2) : at + CHUNK]]
        space = b == 32
        b = b[np.concatenate(([True], ~(space[1:] & space[:-1])))].astype(np.uint32)
        if len(b) > 2:
            h = (b[:-2] * 2654435 + b[1:-1] * 40503 + b[2:] * 1009) >> 5
            counts += np.bincount(h & (DIM - 1), minlength=DIM)
    return counts


@dataclass(frozen=True)
class Model:
    """Distributions (languages x kept bins), the bins, and the languages' shares of the labelled rows."""

    languages: list[str]
    bins: np.ndarray
    prob: np.ndarray
    prior: np.ndarray
    penalty: float = 6.0
    rounds: int = 12
    options: dict = field(default_factory=dict)
    #: Distributions over all bins.
    whole: np.ndarray | None = None


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            total[lang] = total.get(lang, 0) + trigrams(text)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bin": at.astype(np.int32), "n": counts[at]})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, rows_per_language: int = 4000, bins: int = 1024) -> Model:
    """Learns every language of the rows where ``learn`` holds and text and language are not null.

    About ``rows_per_language`` rows a language are read, picked by a hash of the id and a row number, so that
    repeated and null ids are picked row by row.  Bins are kept by how far the languages differ in them.
    """
    small_batches(docs.sparkSession)
    rows = own(docs, id=id_col, text=text_col, lang=lang_col, ok=F.lit(True) if learn is None else learn)
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), F.monotonically_increasing_id()), F.lit(1_000_000))
    rows = rows.withColumn("part", part).where(F.col("ok") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0))
    if 8 * len(sizes) * (DIM + bins) > MODEL_BYTES:
        raise ValueError(f"{len(sizes)} values of {lang_col} are too many for one model")
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, rows_per_language / n) * 1_000_000))])
    picked = rows.where(F.col("part") < F.coalesce(rate[F.col("lang")], F.lit(0))).select("lang", "text")
    summed = picked.mapInPandas(_counted, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    languages = sorted(sizes)
    counts = np.zeros((len(languages), DIM))
    row = {lang: i for i, lang in enumerate(languages)}
    for r in summed:
        counts[row[r["lang"]], r["bin"]] = r["n"]
    share = counts.sum(1, keepdims=True)
    prob = (counts + 0.5) / (share + 0.5 * DIM)
    middle = prob.mean(0)
    telling = (prob * np.abs(np.log(prob / middle))).sum(0)
    kept = np.sort(np.argsort(-telling, kind="stable")[:bins])
    prior = np.array([sizes[x] for x in languages], float)
    return Model(languages, kept, prob[:, kept] / prob[:, kept].sum(1, keepdims=True), prior / prior.sum(), whole=prob)


def _em(counts: np.ndarray, prob: np.ndarray, start: np.ndarray, prior: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (rows x languages) and log-likelihoods; the prior weighs as much as one trigram."""
    share, n = start, counts.sum(1, keepdims=True)
    for _ in range(rounds):
        mixed = np.maximum(share @ prob, 1e-12)
        share = share * ((counts / mixed) @ prob.T)
        share = (share + prior * (start > 0)) / (n + (prior * (start > 0)).sum(1, keepdims=True))
        share /= np.maximum(share.sum(1, keepdims=True), 1e-12)
    return share, (counts * np.log(np.maximum(share @ prob, 1e-12))).sum(1)


def infer(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[str]]:
    """Languages, scores and the selected language sets (``de+en``) of texts."""
    return _inferred(model, texts)[:3]


def told_apart(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages and scores of texts; ``und`` and 0 where trigrams are likelier drawn evenly from all bins than from the selected set.

    Text of a language that was not learned, or of none, is less likely under any mixture than under even bins.
    """
    langs, score, _, share, counts = _inferred(model, texts)
    if not model.languages:
        return langs, score
    fit = (counts * np.log(share @ model.whole)).sum(1)
    n = counts.sum(1)
    other = fit < -n * (np.log(DIM) + 1e-9)
    return [UNKNOWN if o else x for x, o in zip(langs, other, strict=True)], np.where(other, 0.0, score)


def chosen(model: Model, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares under each document's language set, and under all languages, of counts of the kept bins."""
    many, n, rows = len(model.languages), np.maximum(counts.sum(1), 1), len(counts)
    share, _ = _em(counts, model.prob, np.full((rows, many), 1 / many), model.prior, model.rounds)
    order = np.argsort(-share, 1, kind="stable")
    best, best_share, growing = np.full(rows, -np.inf), share.copy(), np.arange(rows)
    # A document's set grows by its next language for as long as the penalised likelihood rises.
    for size in range(1, many + 1):
        inside = np.zeros((len(growing), many))
        np.put_along_axis(inside, order[growing, :size], 1.0, 1)
        start = inside * np.maximum(share[growing], 1e-6)
        found, fit = _em(counts[growing], model.prob, start / start.sum(1, keepdims=True), model.prior, model.rounds)
        value = fit - model.penalty * (size - 1) * np.log(n[growing] + 1)
        rose = value > best[growing]
        growing = growing[rose]
        best[growing], best_share[growing] = value[rose], found[rose]
        if not len(growing):
            break
    return best_share, share


def _inferred(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[str], np.ndarray, np.ndarray]:
    heard = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), [""] * len(texts), np.zeros((len(texts), 0)), np.zeros((len(texts), DIM))
    everything = np.array([trigrams(t) if ok else np.zeros(DIM) for t, ok in zip(texts, heard, strict=True)], np.float64).reshape(len(texts), DIM)
    counts = everything[:, model.bins]
    best_share, share = chosen(model, counts)
    many = len(model.languages)
    alone = counts @ np.log(model.prob).T + np.log(model.prior)
    top = best_share.argmax(1)
    other = alone.copy()
    other[np.arange(len(texts)), top] = -np.inf
    margin = alone[np.arange(len(texts)), top] - other.max(1) if many > 1 else np.full(len(texts), 50.0)
    mixed = (best_share > 1e-9).sum(1) > 1
    sure = np.where(mixed, 1.0, 1 / (1 + np.exp(-np.clip(margin, -50, 50))))
    score = np.where(heard, np.clip(best_share.max(1) * sure, 0, 1), 0.0)
    langs = [model.languages[i] if ok else UNKNOWN for i, ok in zip(top, heard, strict=True)]
    sets = ["+".join(x for x, p in zip(model.languages, row, strict=True) if p > 1e-9) if ok else "" for row, ok in zip(best_share, heard, strict=True)]
    return langs, score, sets, best_share, everything


def language(model: Model, text: Column, df: DataFrame) -> Column:
    """Struct (lang_pred, score, languages) of a text column.

    ``und`` with score 0 for a null text or one without a letter.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MODEL_BYTES

    @F.pandas_udf("lang_pred string, score double, languages string")
    def told(texts: pd.Series) -> pd.DataFrame:
        parts = [infer(shared.value, list(texts[i : i + 128])) for i in range(0, len(texts), 128)] or [([], np.zeros(0), [])]
        return pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts]), "languages": [x for p in parts for x in p[2]]})

    return told(text)


def held_out(id_col: Column) -> Column:
    """Whether an id is in the fold that is never learned from; a null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, lang_pred, score, languages.

    Learns from the rows that are not held out.  Null texts and texts without a letter are ``und`` with score 0.
    Repeated rows are all returned; with no labelled row every language is ``und``; an empty table gives no
    rows.  Columns besides id, text and language are ignored.
    """
    model = train(docs, id_col, text_col, lang_col, ~held_out(F.col(id_col)), **options)
    rows = own(docs, id=id_col, text=text_col)
    told = rows.select("id", language(model, F.col("text"), docs).alias("told"))
    return told.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "told.lang_pred", "told.score", "told.languages")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.25, **options) -> DataFrame:
    """The rows of ``docs`` with a known language whose score reaches ``min_score``; all columns stay.

    Null texts, texts without a letter and those that fit no learned language go
    (``told_apart``).  Repeated rows are judged alike.  All columns stay, whatever they are called.  An empty
    table gives no rows.
    """
    model = train(docs, id_col, text_col, lang_col, ~held_out(F.col(id_col)), **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_BYTES

    @F.pandas_udf("lang_pred string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        parts = [told_apart(shared.value, list(texts[i : i + 128])) for i in range(0, len(texts), 128)] or [([], np.zeros(0))]
        return pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts])})

    rows = packed_rows(docs, told=told(F.col(f"`{text_col}`")))
    return unpacked(rows.where((F.col("told.lang_pred") != UNKNOWN) & (F.col("told.score") >= min_score)), docs.columns)
