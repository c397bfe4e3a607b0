"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted sequence are cut into pieces.  Pieces are
dealt by a hash into shards of bounded size, so no key, source or length can
crowd one task, and each shard is packed best-fit decreasing: a piece goes to
the open bin that it leaves the least room in, else it opens the bin size of least cost
for each token that it is expected to hold.  Several expectations of how far later
pieces fill a bin are tried; the plan of least total cost, after each bin is
downsized to the smallest size that holds its contents, is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.scratch import UID, own, stash, with_uid
from textmill.llm.words import n_words

SIZES = (512, 1024, 2048, 4096)
#: Expected part of the room beside its first piece that a new bin gets filled.
FILLS = (0.0, 0.5, 0.9, 1.0)
SHARD = 8192


def cost(size: int, attention: float = 1 / 65536) -> float:
    """Cost of training on one sequence: its tokens and a share that grows with their square."""
    return size + attention * size * size


def best_fit(lengths: Sequence[int], sizes: Sequence[int], fill: float, attention: float) -> tuple[list[int], list[int], list[int], float]:
    """Packs positive lengths, given in decreasing order: bin and offset of each, size of each bin, total cost."""
    opens: dict[int, int] = {}
    room_of: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    mask, held, used, bins, offsets = 0, [], [], [], []
    for n in lengths:
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = room_of[room].pop()
            if not room_of[room]:
                mask ^= 1 << room
        else:
            if n not in opens:
                opens[n] = min((s for s in sizes if s >= n), key=lambda s: (cost(s, attention) / (n + fill * (s - n)), s))
            room, b = opens[n], len(held)
            held.append(room)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if room > n:
            room_of[room - n].append(b)
            mask |= 1 << (room - n)
    final = [next(s for s in sizes if s >= u) for u in used]
    return bins, offsets, final, sum(cost(s, attention) for s in final)


def _pack_shard(sizes: tuple[int, ...], attention: float):
    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece_words", UID, "piece"], ascending=[False, True, True])
        lengths = pdf["piece_words"].tolist()
        bins, offsets, final, _ = min((best_fit(lengths, sizes, f, attention) for f in FILLS), key=lambda x: x[3])
        number = np.array(bins, np.int64)
        return pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "piece_start": pdf["piece_start"], "piece_words": pdf["piece_words"], "bin_id": (int(key[0]) << 24) + number, "bin_size": np.array(final, np.int64)[number], "bin_offset": np.array(offsets, np.int64)})

    return packed


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, sizes: tuple[int, ...] = SIZES, attention: float = 1 / 65536, shard: int = SHARD) -> DataFrame:
    """Rows (id, piece, piece_start, piece_words, bin_id, bin_size, bin_offset): where each piece of each row goes.

    ``length`` is the number of tokens of a row, by default its words.  Every row of
    ``docs`` has its pieces: null and wordless texts one of no words, in no bin
    (null bin columns).  Ids may be null or repeat; each row is packed for itself.
    An empty table gives no rows.  Other columns are ignored.  A shard holds about ``shard`` pieces.
    """
    sizes = tuple(sorted(set(sizes)))
    rows = own(docs, id=id_col, n=n_words(F.col(f"`{text_col}`")) if length is None else F.coalesce(length, F.lit(0)).cast("long"))
    rows = stash(with_uid(rows), "pack-lengths")
    most = sizes[-1]
    cuts = F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("n", F.lit(1)) - 1) / most))
    pieces = rows.withColumn("piece", F.explode(cuts)).withColumn("piece_start", F.col("piece") * most)
    pieces = pieces.withColumn("piece_words", F.least(F.col("n") - F.col("piece_start"), F.lit(most).cast("long")))
    total = rows.agg(F.sum(F.ceil(F.col("n") / most))).first()[0] or 0
    dealt = pieces.where("n > 0").withColumn("shard", F.pmod(F.xxhash64(UID, "piece"), F.lit(max(1, -(-int(total) // shard)))))
    schema = f"id {dict(rows.dtypes)['id']}, piece long, piece_start long, piece_words long, bin_id long, bin_size long, bin_offset long"
    packed = dealt.groupBy("shard").applyInPandas(_pack_shard(sizes, attention), schema)
    none = [F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_size", "bin_offset")]
    empty = pieces.where("n = 0").select("id", "piece", "piece_start", "piece_words", *none)
    return packed.unionAll(empty).withColumnRenamed("id", id_col)
