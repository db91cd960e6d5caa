"""Highlight ranges: exact occurrences, token spans with inflection, merging, and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First part of speech of words that inflect, and of what continues them.
INFLECTING = ("動詞", "形容詞", "助動詞")
AUXILIARY, PARTICLE, DEPENDENT = "助動詞", "助詞", "非自立可能"
TE = ("て", "で")

RANGES = "array<struct<start:int,end:int>>"


def exact_ranges(text: Column, query: str) -> Column:
    """Occurrences of the query that don't overlap, left to right, as (start, end)."""
    if not query:
        return F.array().cast(RANGES)
    n = len(query)
    none = F.array().cast(RANGES)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, part: Column) -> Column:
        begin = a["at"] + F.length(part)
        return F.struct((begin + n).alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), (begin + n).alias("end")))).alias("out"))

    parts = F.split(text, "(?:\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E)", -1)
    return F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda a: a["out"])


def merged(ranges: Column) -> Column:
    """Sorted ranges, joined where they touch or overlap."""

    def step(out: Column, r: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when(last.isNotNull() & (r["start"] <= last["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(F.sort_array(ranges), F.array().cast(RANGES), step)


def parts(text: Column, ranges: Column) -> Column:
    """Alternating (text, highlighted) parts; empty ones are left out."""
    kind = "array<struct<text:string,highlighted:boolean>>"
    piece = lambda a, b, on: F.struct(F.substr(text, a + 1, b - a).alias("text"), F.lit(on).alias("highlighted"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    step = lambda acc, r: F.struct(r["end"].alias("at"), F.concat(acc["out"], F.array(piece(acc["at"], r["start"], False), piece(r["start"], r["end"], True))).alias("out"))
    done = F.aggregate(ranges, start, step, lambda a: F.concat(a["out"], F.array(piece(a["at"], F.length(text), False))))
    return F.filter(done, lambda p: F.length(p["text"]) > 0)


def bracketed(text: Column, ranges: Column, left: str = "[", right: str = "]") -> Column:
    return F.array_join(F.transform(parts(text, ranges), lambda p: F.when(p["highlighted"], F.concat(F.lit(left), p["text"], F.lit(right))).otherwise(p["text"])), "")


def token_spans(text: Column, tokens: Column) -> Column:
    """Each token's place, sought from where the last one ended; tokens that aren't found have none."""
    kind = "array<struct<i:int,start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(kind).alias("out"))

    def step(a: Column, token: Column) -> Column:
        surface = token["surface"]
        rest = F.substr(text, a["at"] + 1)
        found = F.call_function("locate", surface, rest)
        begin = a["at"] + found - 1
        hit = (found > 0) & (F.length(surface) > 0)
        span = F.struct(a["i"].alias("i"), begin.alias("start"), (begin + F.length(surface)).alias("end"))
        return F.struct(F.when(hit, begin + F.length(surface)).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i"), F.when(hit, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda a: a["out"])


def _continues(pos: Column, surface: Column, before: Column) -> Column:
    """Whether a token continues an inflected word: an auxiliary, te or de, or a dependent verb right after one of these."""
    first = F.get(pos, F.lit(0))
    dependent = (first == "動詞") & F.exists(pos, lambda p: p == DEPENDENT) & before.isin(*TE)
    return (first == AUXILIARY) | ((first == PARTICLE) & surface.isin(*TE)) | dependent


def token_ranges(text: Column, tokens: Column, terms: Column, surface_only: bool = False) -> Column:
    """Merged ranges of the tokens that match a term by surface or lemma, with their inflection."""
    spans = token_spans(text, tokens)

    def of(span: Column) -> Column:
        token = F.get(tokens, span["i"])
        matches = F.array_contains(terms, token["surface"]) if surface_only else F.array_contains(terms, token["surface"]) | F.array_contains(terms, token["lemma"])
        begin = F.struct(span["end"].alias("end"), (F.get(token["pos"], F.lit(0)).isin(*INFLECTING) if not surface_only else F.lit(False)).alias("on"))

        def extend(a: Column, s: Column) -> Column:
            t, before = F.get(tokens, s["i"]), F.get(tokens, s["i"] - 1)
            on = a["on"] & (s["start"] == a["end"]) & _continues(t["pos"], t["surface"], before["surface"])
            return F.struct(F.when(on, s["end"]).otherwise(a["end"]).alias("end"), on.alias("on"))

        later = F.filter(spans, lambda s: s["i"] > span["i"])
        end = F.aggregate(later, begin, extend, lambda a: a["end"])
        return F.when(matches, F.struct(span["start"].alias("start"), end.alias("end")))

    return merged(F.filter(F.transform(spans, of), lambda r: r.isNotNull()))


def search_ranges(text: Column, tokens: Column, terms: Column, query: str, surface_only: bool = False) -> Column:
    """Token ranges; where there are none, the query's exact occurrences."""
    own = token_ranges(text, tokens, terms, surface_only)
    return F.when(F.size(own) > 0, own).otherwise(exact_ranges(text, query))


def islands(ranges: DataFrame, key: str) -> DataFrame:
    """Rows (key, start, end) merged where they touch or overlap: the same on rows, by windows."""
    by_start = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
