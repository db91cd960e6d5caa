"""Constraints as queries: each gives the rows that break a rule, and the rule's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from . import timeline


class ValidationError(ValueError):
    def __init__(self, issues: list[str]):
        super().__init__("; ".join(issues))
        self.issues = issues


def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of each rule that doesn't hold; a rule that is null counts as broken. One pass over the rows."""
    names = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(key, F.explode(names).alias("rule"))


def segment_violations(segs: DataFrame) -> DataFrame:
    e, i = F.col("episode"), F.col("local_index")
    rules = {"end": F.col("end") > F.col("start"), "id": F.col("segment_id") == e.cast("bigint") * ids.PER_EPISODE + i, "key": F.col("segment_key") == ids.segment_key(e, i)}
    return broken(segs, "segment_id", rules)


def token_violations(tokens: DataFrame, key: str) -> DataFrame:
    return broken(tokens, key, {"surface": F.length("surface") > 0, "lemma": F.length("lemma") > 0, "pos": F.size("pos") > 0})


def unique_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def manifest_violations(manifest: DataFrame) -> DataFrame:
    derived = F.col("status").isin("processed", "low-confidence")
    rules = {
        "video": ~derived | F.col("video_id").isNotNull(), "script": ~derived | F.col("script_url").isNotNull(), "alignment": ~derived | F.col("alignment_path").isNotNull(),
        "has_script": F.col("has_script") == F.col("script_url").isNotNull(), "status": F.col("status").isNotNull(), "episode": F.col("episode") > 0,
    }
    w = Window.partitionBy("episode")
    repeated = manifest.withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1 and status <> 'duplicate'").select("episode", F.lit("duplicate").alias("rule"))
    return broken(manifest, "episode", rules).unionByName(repeated)


def alignment_issues(segs: DataFrame, summaries: DataFrame, durations: DataFrame) -> DataFrame:
    """(episode, issue): summary counts, order, contiguity and duration, all of them and not the first."""
    counted = segs.groupBy("episode").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("confidence", F.lit(0.0)) < 0.68).alias("low"), F.count_if(F.col("timing_source") == "interpolated").alias("inferred"), F.max_by("end", "local_index").alias("last_end"),
    )
    joined = summaries.join(counted, "episode", "left").join(durations, "episode", "left")
    rules = {
        "segment count": F.col("segment_count") == F.coalesce("n", F.lit(0)), "low-confidence count": F.col("low_count") == F.coalesce("low", F.lit(0)),
        "inferred count": F.col("inferred_count") == F.coalesce("inferred", F.lit(0)), "duration": F.col("duration").isNull() | F.col("last_end").isNull() | (F.col("last_end") <= F.col("duration") + 1),
    }
    out = broken(joined, "episode", rules)
    order = timeline.monotonic_violations(segs, "episode", ["local_index"], "start", "end").select("episode", F.lit("order").alias("rule"))
    gaps = timeline.contiguous(segs, "episode", "local_index").select("episode", F.lit("indexes").alias("rule"))
    return out.unionByName(order).unionByName(gaps).withColumnRenamed("rule", "issue")


SUMMARY = ("unit_count", "segment_count", "unmatched_count", "inferred_count", "low_count", "average_confidence")


def alignment_report(segs: DataFrame, states: DataFrame, reviews: DataFrame, durations: DataFrame, need_review: bool = True, most: int = 30) -> DataFrame:
    """(episode, path, issue): everything that is wrong with stored alignments, each with the place where it is.

    segs (episode, local_index, video_id, start, end, confidence, timing_source), states (episode, video_id, SUMMARY),
    reviews (as states, with low and inferred), durations (episode, duration; null: not known). Counts are computed
    anew from the segments; only the last segment is held against the duration. Paths of a review begin with "review".
    The segments are shuffled once, by episode.
    """
    w = Window.partitionBy("episode").orderBy("local_index")
    at = lambda name: F.concat(F.lit("segments."), F.col("local_index").cast("string"), F.lit(f".{name}"))
    tell = lambda broken, path, text: F.when(F.coalesce(broken, F.lit(True)), F.struct(path.alias("path"), F.lit(text).alias("issue")))
    rows = segs.withColumns({"previous_end": F.lag("end").over(w), "previous_index": F.lag("local_index").over(w)})
    rows = rows.withColumn("found", F.array_compact(F.array(
        tell(F.col("end") <= F.col("start"), at("end"), "does not end after its start"), tell(F.coalesce(F.col("start") < F.col("previous_end") - 0.01, F.lit(False)), at("start"), "overlaps the segment before"),
        tell(F.col("local_index") != F.coalesce(F.col("previous_index") + 1, F.lit(0)), at("local_index"), "does not follow the index before"), tell(F.length("text") == 0, at("text"), "is empty"),
    )))
    own = rows.groupBy("episode").agg(
        F.flatten(F.collect_list("found")).alias("found"), F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("confidence", F.lit(0.0)) < 0.68).alias("low_n"), F.count_if(F.col("timing_source") == "interpolated").alias("inferred_n"),
        (F.floor(F.avg("confidence") * 1000 + 0.5) / 1000).alias("average"), F.min("video_id").alias("least_video"), F.max("video_id").alias("most_video"), F.max(F.struct("local_index", "end")).alias("last"),
    )
    summary = F.to_json(F.struct(*SUMMARY))
    review = reviews.select("episode", F.col("video_id").alias("r_video"), summary.alias("r_summary"), F.size("low").alias("r_low"), F.size("inferred").alias("r_inferred"))
    both = states.select("episode", "video_id", *SUMMARY, summary.alias("summary")).join(own, "episode", "left").join(review, "episode", "left").join(durations.select("episode", "duration"), "episode", "left")
    part = lambda name: F.lit(name)
    missing, known = F.col("r_summary").isNull(), F.col("r_summary").isNotNull()
    in_review = lambda broken, name, text: F.when(known & broken, F.struct(part(f"review.{name}").alias("path"), F.lit(text).alias("issue")))
    last = F.concat(F.lit("segments."), F.col("last.local_index").cast("string"), F.lit(".end"))
    issues = F.array_compact(F.array(
        tell(F.col("segment_count") != F.coalesce("n", F.lit(0)), part("summary.segment_count"), "does not equal the number of segments"),
        tell(F.col("low_count") != F.coalesce("low_n", F.lit(0)), part("summary.low_count"), "does not equal the number of low confidences"),
        tell(F.col("inferred_count") != F.coalesce("inferred_n", F.lit(0)), part("summary.inferred_count"), "does not equal the number of inferred segments"),
        tell(~F.col("average_confidence").eqNullSafe(F.col("average")), part("summary.average_confidence"), "does not equal the segments' mean"),
        tell(F.coalesce((F.col("least_video") != F.col("video_id")) | (F.col("most_video") != F.col("video_id")), F.lit(False)), part("segments.video_id"), "is not the alignment's"),
        tell(F.coalesce(F.col("last.end") > F.col("duration") + 1, F.lit(False)), last, "is after the video's end"),
        F.when(missing & F.lit(need_review), F.struct(part("review").alias("path"), F.lit("is missing").alias("issue"))),
        in_review(~F.col("r_video").eqNullSafe(F.col("video_id")), "video_id", "is not the alignment's"), in_review(F.col("r_summary") != F.col("summary"), "summary", "is not the alignment's"),
        in_review(F.coalesce(F.col("r_low") != F.least(F.col("low_count"), F.lit(most)), F.lit(True)), "low", "has another length than the summary says"),
        in_review(F.coalesce(F.col("r_inferred") != F.col("inferred_count"), F.lit(True)), "inferred", "has another length than the summary says"),
    ))
    found = F.concat(F.coalesce("found", F.array().cast("array<struct<path:string,issue:string>>")), issues)
    orphans = segs.select("episode").distinct().join(states.select("episode"), "episode", "left_anti").select("episode", F.lit("summary").alias("path"), F.lit("is missing").alias("issue"))
    return both.select("episode", F.explode(found).alias("x")).select("episode", "x.path", "x.issue").unionByName(orphans)


def require(violations: DataFrame, shown: int = 20) -> None:
    """Raise if there are any, with some of them."""
    found = violations.limit(shown).collect()
    if found:
        raise ValidationError([str(r.asDict()) for r in found])
