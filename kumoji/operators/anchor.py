"""Anchored candidates: where short needles may lie in long texts, found by the words of their head, middle and tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim

SPAN = 3


def words(text: Column) -> Column:
    """The words between ASCII blanks; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def needle_anchors(needles: DataFrame, key: str, text: str) -> DataFrame:
    """(key, offset, gram): three words in a row at the head, the middle and the tail of each needle; a needle of fewer
    words is one gram, one of none has no row. Repeated needles count once."""
    own = needles.select(F.col(key), words(F.col(text)).alias("w")).where(F.size("w") > 0).withColumn("g", F.least(F.lit(SPAN), F.size("w")))
    slack = F.size("w") - F.col("g")
    places = own.select("*", F.explode(F.array_distinct(F.array(F.lit(0), F.floor(slack / 2).cast("int"), slack))).alias("offset"))
    return places.select(key, "offset", F.array_join(F.slice("w", F.col("offset") + 1, F.col("g")), " ").alias("gram")).distinct()


def text_grams(docs: DataFrame, key: str, text: str, lengths: list[int]) -> DataFrame:
    """(key, place, gram) for every place, from 1, of every whole text, and each of the lengths (at most SPAN of them)."""
    w = docs.select(F.col(key), words(F.col(text)).alias("w"))
    near = w.select(key, F.posexplode(F.arrays_zip("w", *(F.slice("w", i, F.greatest(F.size("w"), F.lit(1))).alias(f"w{i}") for i in range(2, SPAN + 1)))).alias("at", "z"))
    parts = [F.col("z.w"), *(F.col(f"z.w{i}") for i in range(2, SPAN + 1))]
    grams = F.array(*(F.concat_ws(" ", *parts[:n]) if n == 1 else F.when(parts[n - 1].isNotNull(), F.concat_ws(" ", *parts[:n])) for n in lengths))
    return near.select(key, (F.col("at") + 1).alias("place"), F.explode(grams).alias("gram")).where("gram is not null")


def candidates(needles: DataFrame, needle_key: str, needle_text: str, docs: DataFrame, doc_key: str, doc_text: str) -> DataFrame:
    """(needle key, doc key, start): each word of a text, from 1, where a needle would start if one of its anchors lies
    where the text has it; a start before the text is its first word. Every occurrence counts, each start once. Null and
    blank texts have none.

    The texts are scanned once and only grams that are anchors leave the scan: Spark broadcasts the anchors if their
    measured size allows, and else joins both sides by the gram, where adaptive execution splits frequent ones.
    """
    anchors = needle_anchors(needles, needle_key, needle_text)
    spaces = F.length("gram") - F.length(F.translate("gram", " ", ""))
    lengths = sorted(r[0] + 1 for r in anchors.select(spaces).distinct().collect())  # at most SPAN numbers
    if not lengths:
        lengths = [SPAN]
    hits = text_grams(docs, doc_key, doc_text, lengths).join(anchors, "gram")
    return hits.select(needle_key, doc_key, F.greatest(F.col("place") - F.col("offset"), F.lit(1)).alias("start")).distinct()


def _per_text(found: DataFrame, needles: DataFrame, needle_key: str, needle_text: str, docs: DataFrame, doc_key: str, doc_text: str) -> DataFrame:
    """(doc key, b, starts): each text's words once, with the candidates in it as (needle key, start, size); and no text twice."""
    size = needles.select(needle_key, F.size(words(F.col(needle_text))).alias("size"))
    per = found.join(size, needle_key).groupBy(doc_key).agg(F.collect_list(F.struct(F.col(needle_key).alias("needle"), "start", "size")).alias("starts"))
    return per.join(docs.select(doc_key, words(F.col(doc_text)).alias("b")), doc_key)


def windows(found: DataFrame, needles: DataFrame, needle_key: str, needle_text: str, docs: DataFrame, doc_key: str, doc_text: str) -> DataFrame:
    """The candidates with both texts, words joined by one space: a, the whole needle, and b, as many words of the text
    from the start on, fewer at its end. Keys are unique in both tables. Windows are cut within a text's own row, so what
    moves is the text once and the windows, and not the text for each candidate."""
    cut = F.transform("starts", lambda x: F.struct(x["needle"].alias("needle"), x["start"].alias("start"), F.array_join(F.slice("b", x["start"], x["size"]), " ").alias("b")))
    rows = _per_text(found, needles, needle_key, needle_text, docs, doc_key, doc_text).select(doc_key, F.explode(cut).alias("x"))
    rows = rows.select(doc_key, F.col("x.needle").alias(needle_key), "x.start", "x.b")
    a = needles.select(needle_key, F.array_join(words(F.col(needle_text)), " ").alias("a"))
    return rows.join(a, needle_key).select(needle_key, doc_key, "start", "a", "b")


def best_spans(found: DataFrame, needles: DataFrame, needle_key: str, needle_text: str, docs: DataFrame, doc_key: str, doc_text: str) -> DataFrame:
    """(needle key, doc key, start, length, confidence): of each needle and text the span of characters, from 0, that is
    most similar, over all candidate starts and all lengths about the needle's; the first and shortest wins ties. Texts
    are words joined by one space. A needle that no span is tried for has no row."""
    offset = lambda x: F.length(F.array_join(F.slice("b", 1, x["start"] - 1), " ")) + F.when(x["start"] > 1, 1).otherwise(0)
    reach = F.ceil(F.lit(1.75) * F.col("n")).cast("int") + 18  # no tried span is longer
    placed = F.transform("starts", lambda x: F.struct(x["needle"].alias("needle"), offset(x).alias("at")))
    rows = _per_text(found, needles, needle_key, needle_text, docs, doc_key, doc_text).select(doc_key, F.array_join("b", " ").alias("text"), F.explode(placed).alias("x"))
    a = needles.select(needle_key, F.array_join(words(F.col(needle_text)), " ").alias("a")).withColumn("n", F.length("a"))
    rows = rows.select(doc_key, F.col("x.needle").alias(needle_key), "x.at", "text").join(a, needle_key)
    cut = rows.select(needle_key, doc_key, "a", "at", F.substring("text", F.col("at") + 1, reach).alias("b"))
    scored = cut.select(needle_key, doc_key, "at", sim.best_spans("a", "b", F.array(F.lit(0))).alias("s")).where("s.start is not null")
    best = scored.groupBy(needle_key, doc_key).agg(F.min(F.struct((-F.col("s.confidence")).alias("c"), F.col("at").alias("start"), F.col("s.length").alias("length"))).alias("m"))
    return best.select(needle_key, doc_key, F.col("m.start").cast("bigint").alias("start"), F.col("m.length").cast("bigint").alias("length"), (-F.col("m.c")).alias("confidence"))
