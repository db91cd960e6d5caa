"""Similarity of short strings: multiset bigram Dice, longest common subsequence, and their mix."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType


def bigrams(s: str) -> Counter:
    return Counter(s[i : i + 2] for i in range(len(s) - 1)) if len(s) > 1 else Counter([s] if s else [])


def dice(a: str, b: str) -> float:
    x, y = bigrams(a), bigrams(b)
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 0.0


def prefix_lcs(a: str, b: str) -> list[int]:
    """The longest common subsequence of a with each prefix of b, bit-parallel: a bit of V is clear where a row of the
    table steps up."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    out = []
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
        out.append(len(a) - v.bit_count())
    return out


def prefix_shared_bigrams(a: str, b: str) -> list[int]:
    """How many bigrams a shares with each prefix of b, as multisets."""
    left = bigrams(a)
    out, same = [], 0
    for i in range(len(b)):
        g = b[i - 1 : i + 1] if i else ""
        if i and left[g] > 0:
            left[g] -= 1
            same += 1
        out.append(same)
    return out


def lcs_length(a: str, b: str) -> int:
    return prefix_lcs(a, b)[-1] if a and b else 0


def lcs(a: str, b: str) -> float:
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 0.0


def similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 0.65 * lcs(a, b) + 0.35 * dice(a, b)


@F.pandas_udf(DoubleType())
def lcs_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def dice_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([dice(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StructType().add("lcs", "double").add("similarity", "double"))
def both_similarities(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The subsequence's share and the mix, with one pass over each pair."""
    out = []
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        part = lcs(x, y)
        out.append((part, 1.0 if x == y else 0.65 * part + 0.35 * dice(x, y)))
    return pd.DataFrame(out, columns=["lcs", "similarity"])


def span_lengths(n: int, rest: int) -> list[int]:
    """The lengths of text that are tried for a needle of n characters where `rest` are left: about half to double, in steps that grow with it, and n."""
    step = 1 if n < 18 else 2 if n < 50 else 4
    least, most = max(3, math.floor(0.55 * n)), min(rest, math.ceil(1.75 * n) + 18)
    return sorted({*range(least, most + 1, step), *([n] if n <= rest else [])})


def best_span(needle: str, text: str, starts: list[int]) -> tuple[int, int, float] | None:
    """(start, length, similarity) of the most similar span at one of the starts; the first start and the shortest length win ties."""
    best, n = None, len(needle)
    for at in sorted(set(starts)):
        lengths = span_lengths(n, len(text) - at) if n else []
        if not lengths:
            continue
        span = text[at : at + lengths[-1]]
        common, shared = prefix_lcs(needle, span), prefix_shared_bigrams(needle, span)
        for length in lengths:
            if length == n and span[:length] == needle:
                found = 1.0
            else:
                found = 0.65 * 2 * common[length - 1] / (n + length) + 0.35 * 2 * shared[length - 1] / max(1, max(1, n - 1) + length - 1)
            if best is None or found > best[2]:
                best = (at, length, found)
    return best


@F.pandas_udf(StructType().add("start", "integer").add("length", "integer").add("confidence", "double"))
def best_spans(needle: pd.Series, text: pd.Series, starts: pd.Series) -> pd.DataFrame:
    found = [best_span(a, b, list(at)) or (None, None, None) for a, b, at in zip(needle, text, starts, strict=True)]
    return pd.DataFrame(found, columns=["start", "length", "confidence"]).astype({"start": "Int32", "length": "Int32", "confidence": "float64"})


@F.pandas_udf(DoubleType())
def mixed_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def anchors(needle: str) -> list[tuple[str, int]]:
    """Head, middle and tail n-grams with their offsets; n is a third of the length within 3 to 8."""
    n = max(3, min(8, len(needle) // 3))
    places = dict.fromkeys((0, max(0, (len(needle) - n) // 2), max(0, len(needle) - n)))
    return [(needle[p : p + n], p) for p in places if len(needle[p : p + n]) >= 3]
