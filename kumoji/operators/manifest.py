"""Episode manifest: matching videos, scripts and alignments, statuses, notes, and discovery reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that come from an alignment, and those that can be processed (again).
DERIVED = ("processed", "low-confidence")
PROCESSABLE = ("discovered", "processed", "low-confidence")
LOW_CONFIDENCE = 0.68


def first_of(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key, and how many there were."""
    w = Window.partitionBy(key)
    ranked = rows.withColumn("copies", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(*order)))
    return ranked.where("rank = 1").drop("rank")


def canonical_scripts(scripts: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """A script per episode: the preferred one if it is among them, else the latest; with the number of candidates."""
    rows = scripts
    order = [F.col("published_at").desc_nulls_last(), F.col("modified_at").desc_nulls_last(), F.col("lastmod").desc_nulls_last(), F.col("url").asc()]
    if preferred is not None:
        rows = rows.join(preferred.select("episode", F.col("url"), F.lit(1).alias("is_preferred")), ["episode", "url"], "left")
        order = [F.coalesce("is_preferred", F.lit(0)).desc(), *order]
    return first_of(rows.where("episode is not null"), "episode", order).drop("is_preferred")


def with_overrides(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """rows with the overrides' episodes; the original one is kept beside it."""
    o = overrides.select(key, F.col("episode").alias("o_episode"))
    out = rows.join(o, key, "left").withColumn("original_episode", F.col("episode"))
    return out.withColumn("episode", F.coalesce("o_episode", "episode")).drop("o_episode")


def applied_overrides(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    return overrides.join(rows.select(key, F.col("episode").alias("original_episode")), key, "inner")


def stale_overrides(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    return overrides.join(rows.select(key), key, "left_anti")


def status(has_video: Column, has_script: Column, copies: Column, aligned: Column, invalid: Column, low: Column) -> Column:
    return (
        F.when(~has_video, "missing-video").when(~has_script, "missing-script").when(copies > 1, "ambiguous").when(invalid, "failed")
        .when(aligned & low, "low-confidence").when(aligned, "processed").otherwise("discovered")
    )


def manifest(videos: DataFrame, scripts: DataFrame, alignments: DataFrame) -> DataFrame:
    """(episode, video_id, script_url, status, notes): videos (episode, video_id, published_at), canonical scripts
    (episode, url, copies), alignment states (episode, video_id, valid, low_confidence)."""
    best = first_of(videos.where("episode is not null"), "episode", [F.col("published_at").desc_nulls_last(), F.col("video_id").asc()]).withColumnRenamed("copies", "video_copies")
    both = best.join(scripts.select("episode", F.col("url").alias("script_url"), F.col("copies").alias("script_copies")), "episode", "full_outer")
    states = alignments.select("episode", F.col("video_id").alias("a_video"), "valid", "low_confidence")
    rows = both.join(states, "episode", "left")
    same = F.col("a_video").eqNullSafe(F.col("video_id"))
    there = F.col("a_video").isNotNull()
    aligned = F.coalesce(F.col("valid") & same, F.lit(False))
    state = status(F.col("video_id").isNotNull(), F.col("script_url").isNotNull(), F.coalesce("video_copies", F.lit(0)), aligned, there & ~aligned, F.coalesce(F.col("low_confidence") > 0, F.lit(False)))
    notes = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.col("video_copies") > 1, F.concat(F.col("video_copies").cast("string"), F.lit(" videos"))),
                F.when(F.col("script_copies") > 1, F.concat(F.col("script_copies").cast("string"), F.lit(" scripts"))),
                F.when(there & ~same, F.lit("aligned to another video")),
            )
        ),
        "; ",
    )
    return rows.select("episode", "video_id", "script_url", state.alias("status"), F.nullif(notes, F.lit("")).alias("notes"))


def latest(rows: DataFrame, count: int, retry_failed: bool = False) -> DataFrame:
    """The `count` newest episodes that can be processed."""
    wanted = (*PROCESSABLE, "failed") if retry_failed else PROCESSABLE
    return rows.where(F.col("status").isin(*wanted) & F.col("video_id").isNotNull() & F.col("script_url").isNotNull()).orderBy(F.col("episode").desc()).limit(count)


def duplicates(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Keys with more than one row, how many, and the smallest and largest member."""
    found = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("first"), F.max(member).alias("last"))
    return found.where("n > 1")


def missing(rows: DataFrame, key: str) -> DataFrame:
    """Numbers between the smallest and the largest key that no row has; the range is dealt out, not one row's array."""
    a, b = rows.agg(F.min(key), F.max(key)).first()
    kind = rows.schema[key].dataType
    span = rows.sparkSession.range(a, b + 1) if a is not None else rows.sparkSession.range(0)
    return span.select(F.col("id").cast(kind).alias(key)).join(rows.select(key).distinct(), key, "left_anti")


def summary(segments: DataFrame, by: str, confidence: str = "confidence", source: str = "timing_source") -> DataFrame:
    """(by, segments, low, inferred, average): a missing confidence counts as low and not in the mean."""
    return segments.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if(F.coalesce(confidence, F.lit(0.0)) < LOW_CONFIDENCE).alias("n_low"),
        F.count_if(F.col(source) == "interpolated").alias("n_inferred"), (F.floor(F.avg(confidence) * 1000 + 0.5) / 1000).alias("average_confidence"),
    )


def review(segments: DataFrame, by: str, size: int = 30, confidence: str = "confidence", position: str = "local_index") -> DataFrame:
    """The lowest-confidence segments of each key, at most `size`."""
    w = Window.partitionBy(by).orderBy(F.coalesce(confidence, F.lit(0.0)), position)
    return segments.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)


def rebuilt_report(old: DataFrame, current: DataFrame, key: str = "episode_key") -> DataFrame:
    """Old rows that don't come from an alignment and aren't replaced, and all current ones."""
    kept = old.where(~F.col("status").isin(*DERIVED)).join(current.select(key), key, "left_anti")
    return kept.unionByName(current, allowMissingColumns=True)


def unchanged(sources: DataFrame, stored: DataFrame, key: str, hashes: list[str]) -> DataFrame:
    """sources with skip: whether all hashes are as stored."""
    s = stored.select(key, *(F.col(h).alias(f"s_{h}") for h in hashes))
    same = F.lit(True)
    for h in hashes:
        same = same & F.col(h).eqNullSafe(F.col(f"s_{h}"))
    known = F.col("there").isNotNull()
    return sources.join(s.withColumn("there", F.lit(1)), key, "left").withColumn("skip", known & same).drop("there", *(f"s_{h}" for h in hashes))
