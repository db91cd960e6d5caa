"""Quality rules with cross-document line frequency, in DataFrame operations only.

Each line is normalised (lower case, no outer blanks) and hashed; for each host the distinct documents that hold it
are counted; a line in more documents than the limit is removed everywhere on that host (by clean()), and a document that keeps
less than `min_kept` of its characters is rejected, as is one that fails the base rules. The limit of a host is
`share` of its documents, `min_docs` at least, so it means the same at every size.

The texts are read once: counts and line hashes go to a table in the shared folder, and everything else works on
that. Counting is a two-step distinct with partial aggregation, and the join with frequent lines has one row of a
key on one side, so a line or a host that a third of all documents share is split by adaptive skew handling.

Nulls and odd rows: a null or empty text has no words, which fails the base rules; a null host is a host of its own;
a null id counts as one document; rows with the same id and text are judged alike and come out as often as they went
in; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name
from .native import ascii_words, let, runs

SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words lie in runs of `width` words that the text has twice or more."""

    def covered(sorted_runs: Column) -> Column:
        twice = F.filter(sorted_runs, lambda x, k: F.coalesce(F.get(sorted_runs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_runs, k + 1)["h"] == x["h"], F.lit(False)))
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), start, step, lambda a: a["n"])

    def of(hashes: Column) -> Column:
        named = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(named), covered))

    return let(runs(words, width), of)


def _blankless(text: Column) -> Column:
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def _line(x: Column) -> Column:
    """The hash of a normalised line."""
    return F.xxhash64(F.lower(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))))


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A row per document: base counts, and its lines as (hash, characters)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n_words"), repeated_words(words).cast("bigint").alias("n_repeat_words"))

    def lines(all_lines: Column) -> Column:
        real = F.filter(all_lines, lambda x: F.length(_blankless(x)) > 0)
        return let(
            real,
            lambda r: F.struct(
                (F.size(r) - F.size(F.array_distinct(r))).cast("bigint").alias("n_dup_lines"),
                F.transform(r, lambda x: F.struct(_line(x).alias("h"), F.length(x).alias("n"))).alias("lines"),
            ),
        )

    out = base.select(
        "doc_id", "host", F.xxhash64("text").alias("version"), let(ascii_words(F.col("text")), counts).alias("w"), let(F.split("text", "\n"), lines).alias("l"),
        F.length(_blankless(F.col("text"))).cast("bigint").alias("word_chars"), (F.length("text") - F.length(F.translate(F.col("text"), SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    return out.select("doc_id", "host", "version", "w.*", "l.*", "word_chars", "n_symbols")


def frequent_lines(rows: DataFrame, share: float, min_docs: int) -> DataFrame:
    """(host, h): lines that more documents of the host hold than its limit."""
    of_host = rows.groupBy("host").agg(F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("docs"))
    lines = rows.select("host", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    held = lines.groupBy("host", "h").agg(F.count_distinct("doc").alias("n")).where(F.col("n") > min_docs)
    limit = F.greatest(F.lit(float(min_docs)), F.col("docs") * share)
    same = held["host"].eqNullSafe(of_host["host"])
    return held.join(of_host, same).where(held["n"] > limit).select(held["host"], "h")


def _verdicts(rows: DataFrame, share: float, min_docs: int, min_kept: float, lists: bool = False) -> DataFrame:
    """measured() rows with base_failed, kept, removed_chars and, if lists, gone_lines: the hashes of their frequent lines."""
    often = frequent_lines(rows, share, min_docs).withColumnsRenamed({"host": "o_host", "h": "o_h"})
    lines = rows.select("doc_id", "host", "version", F.explode("lines").alias("x")).select("doc_id", "host", "version", "x.h", "x.n")
    gone = lines.join(often, F.col("host").eqNullSafe(F.col("o_host")) & (F.col("h") == F.col("o_h")), "left_semi")
    # Rows with equal id, host and text add up here; dividing by their number gives one row's share.
    more = [F.collect_set("h").alias("gone_lines")] if lists else []  # no longer than a document's lines
    gone = gone.groupBy("doc_id", "host", "version").agg(F.sum("n").alias("gone"), *more)
    copies = rows.groupBy("doc_id", "host", "version").agg(F.count(F.lit(1)).alias("copies"), F.sum(F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])).alias("all_chars"))
    share_gone = copies.join(gone, copies["doc_id"].eqNullSafe(gone["doc_id"]) & copies["host"].eqNullSafe(gone["host"]) & (copies["version"] == gone["version"]), "left")
    more = [F.coalesce("gone_lines", F.array().cast("array<bigint>")).alias("gone_lines")] if lists else []
    share_gone = share_gone.select(copies["doc_id"].alias("c_doc"), copies["host"].alias("c_host"), copies["version"].alias("c_version"), (F.coalesce("gone", F.lit(0)) / F.col("copies")).cast("bigint").alias("removed_chars"), (F.col("all_chars") / F.col("copies")).cast("bigint").alias("all_chars"), *more)
    out = rows.drop("lines").join(share_gone, F.col("doc_id").eqNullSafe(F.col("c_doc")) & F.col("host").eqNullSafe(F.col("c_host")) & (F.col("version") == F.col("c_version")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    whole = F.col("all_chars") - F.col("removed_chars") >= F.col("all_chars") * min_kept
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & whole)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = 0.01, min_docs: int = 10, min_kept: float = 0.5) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_chars."""
    rows = Scratch(docs.sparkSession, "quality").keep(measured(docs, id_col, text_col, host_col))
    return _verdicts(rows, share, min_docs, min_kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = 0.01, min_docs: int = 10, min_kept: float = 0.5) -> DataFrame:
    """docs that are kept, without their frequent lines; a text without any stays as it was, other columns are not touched."""
    rows = Scratch(docs.sparkSession, "quality").keep(measured(docs, id_col, text_col, host_col))
    names = {c: free_name(docs, c) for c in ("k_doc", "k_host", "k_version", "k_gone")}
    kept = _verdicts(rows, share, min_docs, min_kept, lists=True).where("kept")
    kept = kept.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "host", "version", "gone_lines"), names.values(), strict=True))).dropDuplicates([*names.values()][:3])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same = F.col(id_col).eqNullSafe(F.col(names["k_doc"])) & F.col(host_col).cast("string").eqNullSafe(F.col(names["k_host"])) & (F.xxhash64(text) == F.col(names["k_version"]))
    gone = F.col(names["k_gone"])
    left = F.concat_ws("\n", F.filter(F.split(text, "\n"), lambda x: (F.length(_blankless(x)) == 0) | ~F.array_contains(gone, _line(x))))
    out = docs.join(kept, same)
    return out.withColumn(text_col, F.when(F.size(gone) > 0, left).otherwise(F.col(text_col))).select(*docs.columns)
