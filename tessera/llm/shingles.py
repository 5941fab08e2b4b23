"""Word shingles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in a shingle.
WIDTH = 5
#: What parts words: ASCII and Latin-1 but letters and digits, general and CJK punctuation.
_GAPS = r"[\x00-/:-`{-\xbf -⁯　-〿]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case words of the whole text, in order. A text without a word has one empty word."""
    gaps = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _GAPS, " "))
    return F.transform(F.split(gaps, " ", -1), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of each `width` consecutive words, in order; empty below `width` words.

    `hashes` must be a plain column of an earlier select(), since it is read for each shingle. Where the result is
    exploded, take the _outer form: for the plain one Spark infers a filter on the array's size and pushes it down
    below that select(), with all of the expression in it.
    """
    last = F.size(hashes) - width
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))
