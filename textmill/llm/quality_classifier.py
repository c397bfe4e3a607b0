"""A quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model under the
non-negative unbiased risk: with class prior p, the loss on unlabelled text as
negative less p times the loss on positives as negative estimates the risk on negatives,
and is held at no less than zero.  The prior is estimated by the best bin: among the best-scored
rows of a first positive-against-unlabelled model, on rows it has not seen, unlabelled text is
as frequent as positives times the prior.  Features are counts of byte-class pairs and a few
figures of repetition and length; the training sample is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.quality_rules import duplicate_lines, repeated_words
from textmill.llm.scratch import own, small_batches

#: Bounds of the training sample, in documents.
POSITIVES, UNLABELLED = 5000, 10000
THRESHOLD = 0.3
CHUNK = 1 << 20
#: Classes of bytes; each byte not named is of the class of its kind.
_NAMED = (b"aeiou", b" ", b"\t\r\v\f", b"\n", b".", b",", b"!?", b"#", b"*", b"$%&", b"|", b"<>", b";:'\"()-")


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for c in range(256):
        out[c] = 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c >= 128 else 4
    for k, named in enumerate(_NAMED):
        out[list(named)] = 5 + k
    return out


_CLASS = _classes()
MANY = 5 + len(_NAMED)
WIDTH = MANY * MANY + 6


def features(text: str | None) -> np.ndarray:
    """Shares of byte-class pairs, and figures of length and repetition."""
    text = text or ""
    raw = text.encode()
    pairs = np.zeros(MANY * MANY, np.int64)
    codes = np.frombuffer(raw, np.uint8)
    for at in range(0, len(codes), CHUNK):
        part = _CLASS[codes[max(0, at - 1) : at + CHUNK]].astype(np.int32)
        pairs += np.bincount(part[:-1] * MANY + part[1:], minlength=MANY * MANY)
    words = raw.split()
    n = max(1, len(words))
    lines = text.count("\n") + 1
    more = [np.log1p(len(words)), len(set(words)) / n, len(raw) / n / 10, repeated_words(words) / n, duplicate_lines(text) / lines, np.log1p(max(map(len, words), default=0))]
    return np.concatenate((np.log1p(100 * pairs / max(1, len(raw))), more)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(gradient, width: int, rounds: int, rate: float = 0.02) -> tuple[np.ndarray, float]:
    """Adam from zero; ``gradient`` maps (weights, bias) to their gradients."""
    at, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        g = gradient(at[:-1], at[-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return at[:-1], float(at[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _mean_gradient(x: np.ndarray, push: np.ndarray) -> np.ndarray:
    return np.append(x.T @ push, push.sum()) / len(x)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, penalty: float = 1e-3) -> float:
    """The share of positives in unlabelled rows, from the best-scored rows of a held-out half."""
    p1, p2, u1, u2 = positive[::2], positive[1::2], unlabelled[::2], unlabelled[1::2]

    def gradient(w: np.ndarray, b: float) -> np.ndarray:
        g = _mean_gradient(p1, _sigmoid(p1 @ w + b) - 1) + _mean_gradient(u1, _sigmoid(u1 @ w + b))
        return g + np.append(penalty * w, 0)

    w, b = _descend(gradient, positive.shape[1], 150)
    if not len(p2) or not len(u2):
        return 0.5
    sp, su = np.sort(p2 @ w + b), np.sort(u2 @ w + b)
    cuts = np.unique(sp)
    above_p, above_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (sp, su))
    slack = np.sqrt(1 / len(p2)) + np.sqrt(1 / len(u2))
    # The best bin: the cut whose ratio has the least upper confidence bound; the ratio there is the estimate.
    best = np.argmin((above_u + (1 + np.sqrt(0.5)) * slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, penalty: float = 1e-4, rounds: int = 800) -> Model:
    """A linear model that minimises the non-negative unbiased risk with the logistic loss."""
    mean = unlabelled.mean(0)
    scale = np.maximum(unlabelled.std(0), 0.02)
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float64) for x in (positive, unlabelled))
    prior = estimate_prior(p, u) if prior is None else prior

    def gradient(w: np.ndarray, b: float) -> np.ndarray:
        zp, zu = p @ w + b, u @ w + b
        as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = _mean_gradient(u, _sigmoid(zu)) - prior * _mean_gradient(p, _sigmoid(zp))
        if as_negative < 0:
            return -negative + np.append(penalty * w, 0)  # back out of the overfit part
        return prior * _mean_gradient(p, _sigmoid(zp) - 1) + negative + np.append(penalty * w, 0)

    w, b = _descend(gradient, p.shape[1], rounds)
    return Model(mean, scale, w, b, prior)


def held_out(id_col: Column) -> Column:
    """Whether an id is in the fold whose labels are never learned from; a null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _feature_column(text: Column) -> Column:
    @F.pandas_udf("array<float>")
    def told(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    return told(text)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Positives: rows outside the held-out fold whose every label is 1.  Unlabelled: all rows.

    None if there is no positive or nothing unlabelled.  About ``positives`` and ``unlabelled`` rows are read, picked
    by a hash of the id and a row number: repeated and null ids are picked row by row.
    """
    small_batches(docs.sparkSession)
    marks = own(labels, at=id_col, mark=label_col).where(F.col("at").isNotNull() & ~held_out(F.col("at")))
    trusted = marks.groupBy("at").agg(F.min("mark").alias("mark")).where("mark = 1").select("at", F.lit(True).alias("good"))
    marked = lambda rows: rows.join(trusted, F.col("id") == F.col("at"), "left")
    many, good = marked(own(docs, id=id_col)).agg(F.count(F.lit(1)), F.count("good")).first()
    if not good:
        return None
    whole = 1_000_000
    rate_p, rate_u = (int(min(1.0, wanted / n) * whole) for wanted, n in ((positives, good), (unlabelled, many)))
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), F.monotonically_increasing_id()), F.lit(whole))
    # One pass over the texts: rows that neither sample can hold go before the join.
    rows = own(docs, id=id_col, text=text_col).withColumn("part", part).where(F.col("part") < max(rate_p, rate_u))
    in_p, in_u = F.col("good").isNotNull() & (F.col("part") < rate_p), F.col("part") < rate_u
    picked = marked(rows).where(in_p | in_u).select(in_p.alias("p"), in_u.alias("u"), _feature_column(F.col("text")).alias("x"))
    found = picked.collect()  # about ``positives`` and ``unlabelled`` rows
    p, u = (np.array([r.x for r in found if r[k]], np.float32).reshape(-1, WIDTH) for k in ("p", "u"))
    return fit_nnpu(p, u) if len(p) and len(u) else None


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, score, predicted.

    Null texts are scored as empty ones.  Repeated rows are all returned.  Without a
    trusted positive every score is 0.5.  An empty table gives no rows.  Other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, label_col, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if shared.value is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(shared.value.score(np.stack([features(t) for t in texts])))

    rows = own(docs, id=id_col, text=text_col)
    out = rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), scored(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
