"""Serving files: the index as 256 JSON files for each kind, and the episodes' segments, byte for byte the same each time.

A file is an object in the form that JSON.stringify(value, null, 2) gives, with keys in the order that such an object
has: whole numbers first, by value, then the others by Japanese collation (ICU) and code points. Its lines are made
where its rows are sorted, so a bucket is one stream and no text is ever held whole; all buckets are written at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from . import tables


def json_string(x: Column) -> Column:
    """A JSON string; characters beyond ASCII stand for themselves."""
    whole = F.to_json(F.array(x))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def key_order(key: str) -> list[Column]:
    """Whole numbers below 2^32 - 1 as they are written, by value; then all else by Japanese collation, then code points."""
    number = F.when(F.col(key).rlike(r"^(0|[1-9]\d{0,9})$"), F.col(key).cast("bigint"))
    number = F.when(number < (1 << 32) - 1, number)
    return [number.asc_nulls_last(), F.collate(F.col(key), "ja").asc(), F.col(key).asc()]


def video_order() -> list[Column]:
    """Videos as they are served: by episode, those without one last, then by title in Japanese collation, then by id."""
    return [F.col("episode").asc_nulls_last(), F.collate(F.col("title"), "ja").asc(), F.col("video_id").asc()]


def lines(rows: DataFrame, file: str, key: str, part: str, values: str, literal) -> DataFrame:
    """(file, lines) in order within a file: rows (file, key, part, values), a key's values in the order of its parts.

    literal makes a value's text. A row gives its own lines; what stands before and behind them depends on its neighbours
    only.
    """
    order = [*key_order(key), F.col(part).asc()]
    w = Window.partitionBy(file).orderBy(*order)
    opens, closes = ~F.lag(key).over(w).eqNullSafe(F.col(key)), ~F.lead(key).over(w).eqNullSafe(F.col(key))
    first, last = F.lag(key).over(w).isNull(), F.lead(key).over(w).isNull()
    body = F.array_join(F.transform(values, lambda x: F.concat(F.lit("    "), literal(x))), ",\n")
    text = F.concat(
        F.when(first, "{\n").otherwise(""), F.when(opens, F.concat(F.lit("  "), json_string(F.col(key)), F.lit(": [\n"))).otherwise(""), body,
        F.when(~closes, ",").when(last, "\n  ]\n}").otherwise("\n  ],"),
    )
    return rows.withColumn("lines", text)


def bucket_lines(found: DataFrame, key: str = "key", part: str = "block", values: str = "segment_ids", literal=lambda x: x.cast("string")) -> DataFrame:
    """(bucket, lines) of all 256 buckets, the empty ones too; rows come sorted within their partitions."""
    made = lines(found, "bucket", key, part, values, literal)
    names = found.sparkSession.range(256).select(F.lower(F.lpad(F.hex("id"), 2, "0")).alias("bucket"))
    empty = names.join(found.select("bucket").distinct(), "bucket", "left_anti").select("bucket", *(F.lit(None).cast(made.schema[c].dataType).alias(c) for c in (key, part)), F.lit("{}").alias("lines"))
    both = made.select("bucket", key, part, "lines").unionByName(empty)
    return both.repartition(256, "bucket").sortWithinPartitions("bucket", *key_order(key), part).select("bucket", "lines")


def write_files(made: DataFrame, file: str, folder: str) -> None:
    """made (file, lines), each file's rows together and in order, as folder/<file>.json."""
    spark = made.sparkSession
    made.write.partitionBy(file).text(f"{folder}/_parts")
    fs, parts = tables._path(spark, f"{folder}/_parts")
    for entry in fs.listStatus(parts):  # 256 names, or an episode each
        name = entry.getPath().getName()
        if "=" in name:
            found = [s.getPath() for s in fs.listStatus(entry.getPath()) if s.getPath().getName().startswith("part-")]
            if len(found) != 1:
                raise RuntimeError(f"{name} is in {len(found)} files")
            fs.rename(found[0], tables._path(spark, f"{folder}/{name.partition('=')[2]}.json")[1])
    fs.delete(parts, True)


def lemma_lists(pairs: DataFrame) -> DataFrame:
    """(bucket, key, block, values): each surface's lemmas, in Japanese collation, one row for each; a surface has few."""
    w = Window.partitionBy("surface").orderBy(F.collate(F.col("lemma"), "ja").asc(), F.col("lemma").asc())
    ranked = pairs.select("surface", "lemma").distinct().withColumn("block", F.row_number().over(w))
    return ranked.select(ids.bucket(F.col("surface")).alias("bucket"), F.col("surface").alias("key"), "block", F.array("lemma").alias("values"))


def write_index(spark: SparkSession, index: str, root: str) -> str:
    """The stored index at `index` as a new version of the serving files: lemma/, surface/ and surface-to-lemmas/, 256 files each."""

    def make(folder: str) -> None:
        for kind in ("lemma", "surface"):
            write_files(bucket_lines(spark.read.parquet(f"{index}/postings/{kind}")), "bucket", f"{folder}/{kind}")
        write_files(bucket_lines(lemma_lists(spark.read.parquet(f"{index}/surface_lemmas")), values="values", literal=json_string), "bucket", f"{folder}/surface-to-lemmas")

    return tables.publish(spark, root, make)
