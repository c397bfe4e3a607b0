"""Words as the contracts fix them: runs of anything but the six ASCII white-space characters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text with the white space after each."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), n.cast("int")), "")


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 (uint64) of each run of ``width`` words with A-Z lower-cased, repeats included.

    A text of fewer words is one shingle; one without words, or null, has none.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    runs = zip(*(words[i:] for i in range(width)), strict=False)
    return np.fromiter((xxh64_intdigest(b" ".join(x), seed) for x in runs), np.uint64, len(words) - width + 1)
