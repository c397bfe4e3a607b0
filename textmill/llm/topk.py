"""Exact top-k search by tiled matrix products.

Vectors are packed into tiles of bounded size.  Each tile of queries meets each
tile of candidates in one matrix product, which keeps the k best of each
query; the lists of a query tile are then merged as a tree, a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.scratch import own, stash

QUERY_TILE, TILE, FAN_IN = 2048, 4096, 16
_TILE = "tile long, dim int, rows binary, ids binary, size int, matrix binary"
_LISTS = "query_tile long, dim int, shard long, query_ids binary, ids binary, scores binary, k int"


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null if the vector takes no part."""
    ok = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def narrowed(matrix: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them all."""
    low, high = matrix.min(initial=0), matrix.max(initial=0)
    return matrix.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _matrix(raw: bytes, size: int, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, f"i{size}").reshape(rows, dim)


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one tile and dimension, as one row."""
    matrix = narrowed(np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), key[1]))
    numbers = {c: [pdf[k].to_numpy(np.int64).tobytes()] for c, k in (("rows", "n"), ("ids", "id"))}
    return pd.DataFrame({"tile": [key[0]], "dim": [key[1]], **numbers, "size": [matrix.itemsize], "matrix": [matrix.tobytes()]})


def _tiles(rows: DataFrame, rows_each: int, name: str) -> tuple[DataFrame, int]:
    """Rows (n, id, v) dealt by a hash of their number into tiles of about ``rows_each``, and the number of tiles."""
    many = max(1, -(-rows.count() // rows_each))
    dealt = rows.withColumn("tile", F.pmod(F.xxhash64("n"), F.lit(many))).withColumn("dim", F.size("v"))
    return stash(dealt.select("tile", "dim", "n", "id", "v").groupBy("tile", "dim").applyInPandas(_pack, _TILE), name), many


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where every sum is exact, else by integers."""
    # Wide first: the least integer of a type has no absolute value in it.
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return np.clip(q.astype(object) @ c.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one query: score descending, then id ascending."""
    at = np.arange(len(scores))
    if len(at) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        left = k - len(above)
        at = np.concatenate((above, ties if len(ties) <= left else ties[np.argpartition(ids[ties], left - 1)[:left]]))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _meet(k: int):
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                qids, ids = np.frombuffer(r.query_ids, np.int64), np.frombuffer(r.ids, np.int64)
                asking, rows = np.frombuffer(r.query_rows, np.int64), np.frombuffer(r.rows, np.int64)
                q, c = _matrix(r.query_matrix, r.query_size, len(qids), r.dim), _matrix(r.matrix, r.size, len(ids), r.dim)
                out_ids, out_scores = np.zeros((len(qids), k), np.int64), np.full((len(qids), k), -1, np.int64)
                count = np.zeros(len(qids), np.int64)
                for at in range(0, len(qids), 256):
                    scores = products(q[at : at + 256], c)
                    for i in range(len(scores)):
                        other = rows != asking[at + i]
                        own_scores, own_ids = (scores[i], ids) if other.all() else (scores[i][other], ids[other])
                        best = _best(own_scores, own_ids, k)
                        count[at + i] = len(best)
                        out_ids[at + i, : len(best)], out_scores[at + i, : len(best)] = own_ids[best], own_scores[best]
                packed = np.concatenate((count[:, None], out_ids), 1)
                yield pd.DataFrame({"query_tile": [r.query_tile], "dim": [r.dim], "shard": [r.tile], "query_ids": [r.query_ids], "ids": [packed.tobytes()], "scores": [out_scores.tobytes()], "k": [k]})

    return meet


def _merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The lists of one query tile from a bounded number of shards, as one."""
    k = int(pdf["k"].iloc[0])
    qids = pdf["query_ids"].iloc[0]
    n = len(qids) // 8
    packed = np.stack([np.frombuffer(x, np.int64).reshape(n, k + 1) for x in pdf["ids"]])
    scores = np.stack([np.frombuffer(x, np.int64).reshape(n, k) for x in pdf["scores"]])
    out_ids, out_scores = np.zeros((n, k + 1), np.int64), np.full((n, k), -1, np.int64)
    for i in range(n):
        held = np.arange(k)[None, :] < packed[:, i, :1]
        ids, own_scores = packed[:, i, 1:][held], scores[:, i][held]
        best = _best(own_scores, ids, k)
        out_ids[i, 0] = len(best)
        out_ids[i, 1 : len(best) + 1], out_scores[i, : len(best)] = ids[best], own_scores[best]
    return pd.DataFrame({"query_tile": [key[0]], "dim": [key[1]], "shard": [key[2]], "query_ids": [qids], "ids": [out_ids.tobytes()], "scores": [out_scores.tobytes()], "k": [k]})


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            qids = np.frombuffer(r.query_ids, np.int64)
            packed = np.frombuffer(r.ids, np.int64).reshape(len(qids), r.k + 1)
            scores = np.frombuffer(r.scores, np.int64).reshape(len(qids), r.k)
            held = np.arange(r.k)[None, :] < packed[:, :1]
            q, rank = np.nonzero(held)
            yield pd.DataFrame({"query_id": qids[q], "rank": (rank + 1).astype(np.int32), "vec_id": packed[:, 1:][held], "score": scores[held]})


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, query_tile: int = QUERY_TILE, tile: int = TILE) -> DataFrame:
    """Each query's k best candidates by integer inner product: query_id, rank, vec_id, score.

    Components become floor(scale * x).  Candidates of a query are all rows but its
    own; ties go to the smaller id.  Rows whose id or vector is null, or whose vector holds a
    null or non-finite component, take no part.  Vectors meet those of their own
    dimension.  Rows with a repeated id are queries and candidates each for itself.  An empty table
    gives no rows.  Scores beyond 64 bits are held at its ends.
    """
    rows = own(vectors, id=id_col, v=scaled(F.col(f"`{vector_col}`"), scale), q=F.coalesce(is_query, F.lit(False)))
    rows = stash(rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("n", F.monotonically_increasing_id()), "vectors")
    shards, n_shards = _tiles(rows.select("n", "id", "v"), tile, "tiles")
    queries, n_queries = _tiles(rows.where("q").select("n", "id", "v"), query_tile, "query-tiles")
    wanted = queries.select(F.col("tile").alias("query_tile"), "dim", *[F.col(c).alias(f"query_{c}") for c in ("rows", "ids", "size", "matrix")])
    parts = max(1, min(n_shards * n_queries, 10_000))
    # Tiles, not rows, meet: as many pairs as the matrix products that the answer is made of.
    names = shards.select("tile", "dim").join(wanted.select("query_tile", "dim"), "dim")
    pairs = names.join(shards, ["tile", "dim"]).join(wanted, ["query_tile", "dim"])
    lists = stash(pairs.repartition(parts, "query_tile", "dim", "tile").mapInPandas(_meet(k), _LISTS), "top-lists")
    while n_shards > 1:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN)).groupBy("query_tile", "dim", "shard").applyInPandas(_merge, _LISTS)
        n_shards = -(-n_shards // FAN_IN)
    return lists.mapInPandas(_rows, "query_id long, rank int, vec_id long, score long")


def oracle_sql(k: int = 20, every: int = 20, scale: int = 64) -> str:
    """DuckDB SQL for ``embeddings``: all pairs of queries and candidates."""
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.n <> c.n AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
"""
