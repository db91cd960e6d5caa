"""Expressions that the native operators share: words, hashes of runs of words, and a way to name a value once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once. A column that is only referred to inside a lambda may be inlined there by
    the optimizer and evaluated for each element; a lambda's own variable can't be."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_words(text: Column) -> Column:
    """Runs of characters other than space and 0x09 to 0x0D."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def runs(words: Column, width: int) -> Column:
    """A 64-bit hash of each run of `width` words, in order; empty if there are fewer."""

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        run = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width)))
        return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), run)).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)
