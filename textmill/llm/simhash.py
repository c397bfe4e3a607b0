"""SimHash near-duplicates by a segment-popcount embedding.

A text's fingerprint is the bitwise majority of the XXH64 values of its word
shingles.  Each distinct fingerprint is embedded as the counts of set bits in its
32 two-bit segments; the Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints.  The grid join lays the embedding out in
six bands of segments.  Two points at Manhattan distance of at most 3 differ in at
most three bands, so they share a grid cell of at least one choice of three
bands (20 cells for each point).  Within a cell, candidates must first meet the
Manhattan bound and then the exact Hamming distance.

A cell emits a spanning forest of its links (fewer links than points), never all
pairs.  Within a crowded cell the same is done again by finer segments of one bit
each: points within 3 bits share three of six bands of these as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm import similar
from textmill.llm.graph import components
from textmill.llm.scratch import UID, absent, bitmap, drop, own, packed_rows, present, small_batches, stash, unpacked, with_uid
from textmill.llm.words import shingle_hashes

#: Shingles whose bits are counted at once; bounds the memory of a very long text.
CHUNK = 1 << 16
BANDS = ((0, 5), (5, 10), (10, 16), (16, 21), (21, 26), (26, 32))
CELLS = tuple(combinations(range(len(BANDS)), 3))
#: Distinct fingerprints above which a cell is split by finer segments, and how often it is.
CROWDED, SPLITS = 1 << 12, 3


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (uint64); 0 if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text; 0 for a null text or one without words."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprint_column(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """``fingerprint`` as a signed 64-bit column."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle, seed) for x in texts], np.uint64).view(np.int64))

    return hashed(text)


def embed(points: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) -> counts of set bits in their two-bit segments, one segment in each two-bit field."""
    low = np.uint64(0x5555555555555555)
    return (points & low) + ((points >> np.uint64(1)) & low)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of embeddings whose fields hold 0, 1 or 2.

    Counts of set bits are monotone in unary code (0, 1, 3), where the distance of
    two fields is their number of differing bits.
    """
    return np.bitwise_count(unary(a) ^ unary(b))


def unary(e: np.ndarray) -> np.ndarray:
    high = (e >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return e | high


def _masks(split: int) -> np.ndarray:
    """Masks of the bands that cells hold fixed: bands of segments at first, then of single bits, turned by some bits each time."""
    out = []
    for cell in CELLS:
        mask = sum(((1 << 2 * (b - a)) - 1) << 2 * a for a, b in (BANDS[i] for i in cell))
        turn = 5 * max(0, split - 1)
        out.append((mask << turn | mask >> (64 - turn)) & (2**64 - 1))
    return np.array(out, np.uint64)


def _named(kind: np.ndarray, within: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A 64-bit name of a cell; that two cells may share one costs time, no link."""
    x = value ^ (within * np.uint64(0x9E3779B97F4A7C15)) ^ (kind.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _cells(split: int):
    """Rows (cell, fp), at first with cell 0 -> each point's cells within that cell."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = _masks(split)
        for pdf in batches:
            points, within = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("fp", "cell"))
            e = points if split else embed(points)
            kind = np.arange(len(masks))
            yield pd.DataFrame({"cell": np.concatenate([_named(kind[k : k + 1], within, e & m) for k, m in enumerate(masks)]).view(np.int64), "fp": np.tile(points.view(np.int64), len(masks))})

    return cells


def forest(points: np.ndarray, most: int, tile: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, as two arrays of ends.

    A search from each point not yet reached: up to ``tile`` reached points meet all those
    left at once, first by the Manhattan bound, then exactly.  Every link found reaches a new point.
    """
    codes, left = unary(embed(points)), np.arange(len(points))
    us, vs = [], []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            near, reached = np.array(reached[:tile]), reached[tile:]
            a, b = np.nonzero(np.bitwise_count(codes[near][:, None] ^ codes[left][None, :]) <= most)
            exact = np.bitwise_count(points[near[a]] ^ points[left[b]]) <= most
            b, first = np.unique(b[exact], return_index=True)
            if len(b):
                us.append(points[near[a[exact][first]]])
                vs.append(points[left[b]])
                reached.extend(left[b])
                left = np.delete(left, b)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _cell_links(most: int):
    def links(cells: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by cell; a cell's points are complete once another cell begins."""
        held: list[np.ndarray] = []
        key = None
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []

        def close() -> None:
            points = np.concatenate(held) if held else np.zeros(0, np.uint64)
            if len(points) > 1:
                u, v = forest(points, most)
                us.append(u)
                vs.append(v)
            held.clear()

        def found() -> pd.DataFrame:
            u, v = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (us, vs))
            us.clear()
            vs.clear()
            return pd.DataFrame({"u": u, "v": v})

        for pdf in cells:
            names, fps = pdf["cell"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)
            cuts = np.flatnonzero(np.diff(names)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                if a == b:
                    continue
                if names[a] != key:
                    close()
                    key = names[a]
                held.append(fps[a:b])
            yield found()
        close()
        yield found()

    return links


def links(points: DataFrame, most: int = 3, crowded: int = CROWDED) -> DataFrame:
    """(fp) of distinct fingerprints -> (u, v) links with the same components as all pairs within ``most`` bits.

    Points of a cell with over ``crowded`` of them are dealt to finer cells within it in the same way, ``SPLITS``
    times at most; a cell that is crowded after that is searched as it is.
    """
    if not 0 <= most <= 3:
        raise ValueError("three of six bands are shared at up to 3 differing bits")
    out, open_ = None, points.select(F.lit(0).cast("long").alias("cell"), "fp")
    for split in range(SPLITS + 1):
        cells = stash(open_.mapInPandas(_cells(split), "cell long, fp long"), "cells")
        counted = stash(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cell-counts")
        big = counted.where(F.col("n") > crowded).select("cell")
        more = split < SPLITS and not big.isEmpty()
        # Most cells hold one point; they are left out before any point is shuffled.
        cells = present(cells, "cell", stash(bitmap(counted, "cell"), "cell-bits"))
        direct = cells.join(counted.where(F.col("n") <= crowded) if more else counted, "cell").select("cell", "fp")
        found = direct.repartition("cell").sortWithinPartitions("cell").mapInPandas(_cell_links(most), "u long, v long")
        out = found if out is None else out.unionAll(found)
        if not more:
            return out
        open_ = cells.join(big, "cell", "left_semi").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3, shingle: int = 3, seed: int = 42, crowded: int = CROWDED) -> DataFrame:
    """One row for each row of ``docs``: id, fp (signed 64 bits), fingerprint (hex), component_id.

    ``component_id`` is the smallest id in the row's component; components join
    fingerprints that differ in at most ``most`` bits, directly or through
    others.  Null and wordless texts have fingerprint 0 and link like any
    other.  Rows with a null id link like others; a component of such rows
    alone has a null ``component_id``.  Repeated rows are all returned.  An
    empty table gives no rows.  Columns besides id and text are ignored.
    """
    small_batches(docs.sparkSession)
    rows = own(docs, id=id_col, text=text_col)
    prints = stash(rows.select("id", fingerprint_column(F.col("text"), shingle, seed).alias("fp")), "fingerprints")
    points = stash(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "points")
    rooted = components(links(points.select("fp"), most, crowded))
    roots = points.join(rooted, points["fp"] == rooted["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = stash(roots.join(smallest, "root").select("fp", "component_id"), "classes")
    out = prints.join(classes, "fp", "left")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("id").alias(id_col), "fp", hexed.alias("fingerprint"), "component_id")


def profiles(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(UID, text) -> (UID, fp, digest, n, sketch, prefix) from one pass over the shingles of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(similar.frequent(rows, shingle))  # at most similar.FREQUENT numbers

    @F.pandas_udf("fp long, digest long, n long, sketch binary, prefix array<long>")
    def told(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            hashes = shingle_hashes(text, shingle)
            held = similar.distinct(hashes)
            fp = int(np.array([majority(hashes)], np.uint64).view(np.int64)[0])
            out.append((fp, similar.digest(held), len(held), similar.sketch(held), similar.prefix(held, *shared.value, similarity)))
        return pd.DataFrame(out, columns=["fp", "digest", "n", "sketch", "prefix"])

    return rows.select(UID, told("text").alias("told")).select(UID, "told.*")


def similar_classes(rows: DataFrame, similarity: float = 0.8, shingle: int = 5, most: int = 3, crowded: int = CROWDED) -> DataFrame:
    """(UID, text) -> (UID, root): rows of one root are those that links of similar texts join.

    The similarity is Jaccard's, of the sets of ``shingle``-word shingles.  Texts whose fingerprints are within
    ``most`` bits meet first, by the grid; their links are verified on whole sets.  All other similar texts,
    however far their fingerprints are apart, follow by ``similar.links``.
    """
    told = stash(profiles(rows, shingle, similarity), "profiles")
    named = stash(told.groupBy("fp", "digest").agg(F.min(UID).alias(UID)), "sets-by-print")
    first = named.groupBy("fp").agg(F.min("digest").alias("first"))
    same = named.join(first, "fp").where("digest <> first").select(F.col("first").alias("u"), F.col("digest").alias("v"))
    met = stash(links(first.select("fp"), most, crowded), "print-links")
    across = met.join(first.toDF("u", "fu"), "u").join(first.toDF("v", "fv"), "v").select(F.least("fu", "fv").alias("u"), F.greatest("fu", "fv").alias("v"))
    likely = same.unionAll(across).where("u <> v").distinct()
    digests = stash(told.select(UID, "digest"), "digests")
    near = similar.links(rows, told.select(UID, "digest", "n", "sketch", "prefix"), similarity, shingle, likely, spent=told)
    rooted = stash(components(near), "set-roots")
    out = digests.join(rooted.withColumnRenamed("node", "digest"), "digest", "left")
    out = stash(out.select(UID, F.coalesce("root", "digest").alias("root")), "row-roots")
    for t in (digests, named, met, rooted):
        drop(t)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, **options) -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate class: its smallest id.

    Classes are those of ``similar_classes``.  Null and wordless texts are one class.
    Ids may repeat or be null; ties fall to the row stored first.  All columns stay, whatever they are called.  An
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    held = stash(with_uid(packed_rows(docs, id=id_col)), "dedup-input")
    rows = held.select(UID, F.col("row").getField(text_col).alias("text"))
    classes = similar_classes(rows, similarity, shingle, **options)
    found = classes.join(held.select(UID, "id"), UID)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col(UID))).alias("first"))
    kept = first.select(F.col(f"first.{UID}").alias(UID))
    gone = stash(found.select(UID).join(kept, UID, "left_anti"), "dedup-gone")
    drop(classes)
    # Few rows go: only those that share a slot with one of them meet their names.
    bits = stash(bitmap(gone, UID), "dedup-bits")
    out = absent(held, UID, bits).unionByName(present(held, UID, bits).join(gone, UID, "left_anti"))
    return unpacked(out, docs.columns)
