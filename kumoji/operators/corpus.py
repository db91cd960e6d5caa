"""Segments, tokens and the inverted index as DataFrames.

Posting lists are kept in blocks of episodes: a word of every document would else gather its whole list in one task.
The list of a key is its blocks in order.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..sources import tables

#: Episodes of a block of postings.
BLOCK = 512
#: Parts of speech that are not indexed: punctuation, symbols and blanks, in English and in the tokenizer's own terms.
SKIPPED_POS = ("PUNCT", "SYM", "SPACE", "補助記号", "記号", "空白")


class Tokenizer(Protocol):
    """Gives array<struct<surface, lemma, pos array<string>, reading>> for a text column."""

    def __call__(self, column: Column) -> Column: ...


TOKENS = "array<struct<surface:string,lemma:string,pos:array<string>,reading:string>>"


def regex_tokenizer(column: Column) -> Column:
    """Runs of letters and digits; the lemma is the lower-case form."""
    none = F.lit(None).cast("string")
    return F.transform(text.tokens(column), lambda t: F.struct(t.alias("surface"), F.lower(t).alias("lemma"), F.array(F.lit("WORD")).alias("pos"), none.alias("reading")))


def dictionary_tokenizer(entries: dict[str, tuple[str, list[str], str | None]]) -> Tokenizer:
    """Longest match from a table surface -> (lemma, parts of speech, reading); other characters stand alone as unknown."""
    longest = max(map(len, entries), default=1)

    @F.pandas_udf(TOKENS)
    def split(texts: pd.Series) -> pd.Series:
        def one(s: str | None) -> list[dict]:
            out, i = [], 0
            while s and i < len(s):
                n = next((n for n in range(min(longest, len(s) - i), 0, -1) if s[i : i + n] in entries), 0)
                surface = s[i : i + (n or 1)]
                lemma, pos, reading = entries.get(surface, (surface, ["unknown"], None))
                if surface.strip():
                    out.append({"surface": surface, "lemma": surface if lemma == "*" else lemma, "pos": [p for p in pos if p != "*"] or ["unknown"], "reading": reading})
                i += n or 1
            return out

        return texts.map(one)

    return split


def reading(column: Column, tokenizer: Tokenizer) -> Column:
    """The readings of a text's tokens, one after the other; a token without one stands for itself."""
    known = lambda t: F.when(F.length(t["reading"]) > 0, F.when(t["reading"] != "*", t["reading"]))
    return F.array_join(F.transform(F.filter(tokenizer(column), lambda t: F.length(F.trim(t["surface"])) > 0), lambda t: F.coalesce(known(t), t["surface"])), "")


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terminators: str = text.TERMINATORS + ".") -> DataFrame:
    """(segment_id, segment_key, episode, local_index, text): a segment per sentence; episodes are doc ids plus one."""
    rows = docs.where(F.col(text_col).isNotNull()).select((F.col(id_col) + 1).cast("bigint").alias("episode"), F.posexplode(text.sentences(F.col(text_col), terminators)).alias("local_index", "text"))
    return rows.select(
        ids.segment_id(F.col("episode"), F.col("local_index")).alias("segment_id"), ids.segment_key(F.col("episode"), F.col("local_index")).alias("segment_key"), "episode", F.col("local_index").cast("int").alias("local_index"), "text"
    )


def indexable(token: Column) -> Column:
    """Trimmed, with a letter or digit in surface or lemma, and no skipped part of speech."""
    has = lambda x: F.coalesce(x.rlike(r"[\p{L}\p{N}]"), F.lit(False))
    return ~F.exists(token["pos"], lambda p: p.isin(*SKIPPED_POS)) & (has(token["surface"]) | has(token["lemma"]))


def segment_tokens(segs: DataFrame, tokenizer: Tokenizer = regex_tokenizer) -> DataFrame:
    """(segment_id, episode, position, surface, lemma) of the tokens that are indexed."""
    rows = segs.select("segment_id", "episode", F.posexplode(tokenizer(F.col("text"))).alias("position", "token"))
    return rows.where(indexable(F.col("token"))).select("segment_id", "episode", "position", F.trim("token.surface").alias("surface"), F.trim("token.lemma").alias("lemma"))


def _keys(segs: DataFrame, kind: str, tokenizer: Tokenizer) -> DataFrame:
    """(key, segment_id, episode), each key once a segment: distinct within the row, so without a shuffle."""
    if tokenizer is regex_tokenizer:  # its words are all indexed, so no token structs are needed
        words = text.tokens(F.col("text")) if kind == "surface" else F.transform(text.tokens(F.col("text")), F.lower)
    else:
        words = F.transform(F.filter(tokenizer(F.col("text")), indexable), lambda t: F.trim(t[kind]))
    return segs.select(F.explode(F.array_distinct(words)).alias("key"), "segment_id", "episode")


def postings(segs: DataFrame, kind: str = "surface", tokenizer: Tokenizer = regex_tokenizer, block: int = BLOCK) -> DataFrame:
    """(bucket, key, block, n, segment_ids ascending)."""
    rows = _keys(segs, kind, tokenizer).withColumn("block", F.floor(F.col("episode") / block).cast("bigint"))
    lists = rows.groupBy("key", "block").agg(F.array_sort(F.collect_list("segment_id")).alias("segment_ids"))
    return lists.select(ids.bucket(F.col("key")).alias("bucket"), "key", "block", F.size("segment_ids").cast("bigint").alias("n"), "segment_ids")


def bucket_histogram(segs: DataFrame, kind: str = "surface", tokenizer: Tokenizer = regex_tokenizer) -> DataFrame:
    """(bucket, n_keys, n_postings) of all 256 buckets."""
    keys = _keys(segs, kind, tokenizer).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = keys.groupBy(ids.bucket(F.col("key")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_postings"))
    names = segs.sparkSession.range(256).select(F.lower(F.lpad(F.hex("id"), 2, "0")).alias("bucket"))
    return names.join(found, "bucket", "left").select("bucket", F.coalesce("n_keys", F.lit(0)).alias("n_keys"), F.coalesce("n_postings", F.lit(0)).alias("n_postings"))


def surface_lemmas(segs: DataFrame, tokenizer: Tokenizer = regex_tokenizer) -> DataFrame:
    """(surface, lemmas ascending): a surface has few lemmas."""
    pairs = segment_tokens(segs, tokenizer).select("surface", "lemma").distinct()
    return pairs.groupBy("surface").agg(F.array_sort(F.collect_set("lemma")).alias("lemmas"))


def index_counts(segs: DataFrame, tokenizer: Tokenizer = regex_tokenizer) -> DataFrame:
    """One row: episodes, segments, lemmas, surfaces."""
    counts = segs.agg(F.count_distinct("episode").alias("episodes"), F.count(F.lit(1)).alias("segments"))
    words = segment_tokens(segs, tokenizer)
    lemmas = words.select("lemma").distinct().agg(F.count(F.lit(1)).alias("lemmas"))
    surfaces = words.select("surface").distinct().agg(F.count(F.lit(1)).alias("surfaces"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(counts).join(one(lemmas), "one").join(one(surfaces), "one").drop("one")


def write_index(segs: DataFrame, path: str, tokenizer: Tokenizer = regex_tokenizer) -> None:
    """Serving tables: segments by block of episodes, postings by kind and bucket, and surface lemmas.

    A bucket is dealt out by block too, so its size does not bind one task; rows lie sorted in it, so a look-up of a key
    or an id skips row groups.
    """
    blocks = segs.withColumn("block", F.floor(F.col("episode") / BLOCK)).repartition("block", "episode").sortWithinPartitions("block", "segment_id")
    blocks.write.mode("overwrite").partitionBy("block").parquet(f"{path}/segments")
    stored = segs.sparkSession.read
    segs = stored.parquet(f"{path}/segments").drop("block")  # cut into sentences once
    for kind in ("surface", "lemma"):
        lists = postings(segs, kind, tokenizer).repartition("bucket", "block").sortWithinPartitions("bucket", "key", "block")
        lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/{kind}")
    if tokenizer is regex_tokenizer:  # a surface's only lemma is its lower case
        pairs = stored.parquet(f"{path}/postings/surface").select(F.col("key").alias("surface")).distinct().withColumn("lemma", F.lower("surface"))
    else:
        pairs = segment_tokens(segs, tokenizer).select("surface", "lemma").distinct()
    pairs = pairs.withColumn("bucket", ids.bucket(F.col("surface")))
    pairs.repartition("bucket", F.substring("surface", 1, 1)).sortWithinPartitions("bucket", "surface").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/surface_lemmas")


def _buckets(keys: list[str]) -> list[str]:
    from hashlib import sha256

    return sorted({sha256(k.encode()).hexdigest()[:2] for k in keys})


class Index:
    """What write_index wrote; look-ups list and read the partitions of their keys only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def of(cls, segs: DataFrame, tokenizer: Tokenizer = regex_tokenizer) -> Index:
        """An index that is computed where it is asked, not stored."""
        self = cls(segs.sparkSession, "")
        self._segs, self._tokenizer = segs, tokenizer
        return self

    def _parts(self, table: str, column: str, values: list) -> DataFrame | None:
        """The partitions of a stored table with these values, named by their folders; None if none is there."""
        root = f"{self.path}/{table}"
        folders = [f for v in values if tables.there(self.spark, f := f"{root}/{column}={v}")]
        return self.spark.read.option("basePath", root).parquet(*folders).where(F.col(column).isin(values)) if folders else None

    def segments(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments").drop("block") if self.path else self._segs

    def segments_of(self, rows: DataFrame, most: int) -> DataFrame:
        """The segments of a page of hits: at most `most` ids, so their blocks and ids become filters of the scan."""
        found = [r["segment_id"] for r in rows.select("segment_id").limit(most).collect()]  # a page, bounded by its limit
        segs = self._segs if not self.path else self._parts("segments", "block", sorted({i // ids.PER_EPISODE // BLOCK for i in found}))
        segs = self.segments().where(F.lit(False)) if segs is None else segs.drop("block")
        return segs.where(F.col("segment_id").isin(found))

    def postings(self, kind: str) -> DataFrame:
        """(key, segment_id) of all keys, for joins with many of them."""
        if not self.path:
            return _keys(self._segs, kind, self._tokenizer).select("key", "segment_id")
        return self.spark.read.parquet(f"{self.path}/postings/{kind}").select("key", F.explode("segment_ids").alias("segment_id"))

    def hits(self, kind: str, keys: list[str]) -> DataFrame:
        """(key, segment_id) of the given keys."""
        if not self.path:
            return _keys(self._segs, kind, self._tokenizer).where(F.col("key").isin(keys)).select("key", "segment_id")
        found = self._parts(f"postings/{kind}", "bucket", _buckets(keys))
        if found is None:
            return self.spark.createDataFrame([], "key string, segment_id bigint")
        return found.where(F.col("key").isin(keys)).select("key", F.explode("segment_ids").alias("segment_id"))

    def surface_lemmas(self, surfaces: list[str]) -> DataFrame:
        """(surface, lemma) of the given surfaces."""
        if self.path:
            pairs = self._parts("surface_lemmas", "bucket", _buckets(surfaces))
            if pairs is None:
                return self.spark.createDataFrame([], "surface string, lemma string")
            return pairs.where(F.col("surface").isin(surfaces)).select("surface", "lemma")
        return segment_tokens(self._segs, self._tokenizer).where(F.col("surface").isin(surfaces)).select("surface", "lemma").distinct()
