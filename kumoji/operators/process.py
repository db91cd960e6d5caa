"""Processing of episodes as one incremental job: sources, skip rule, alignment, summaries, reviews and build report.

All chosen episodes go through one plan; an episode is a row of the sources and a group of the alignment. What is
stored in a data folder:

    sources      (versions) a row per aligned episode: hashes of what it was made from, summary, and the run that made it
    alignments   run=<id>/ segments, and reviews run=<id>/; a run adds a folder and rewrites none
    build_report (versions) a row per episode that was ever tried, with its last status; results run=<id>/ a run's rows

A run's folders are written first and count for nothing until a new version of `sources` names the run, so a job that
dies leaves the old state. An episode is skipped if its hashes and the pipeline's version are as stored and what is
stored is sound; if only its review is not, the review is made anew. A failure is a row and stops no other episode.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..sources import landed, tables
from . import align, corpus, manifest, units, validate

VERSION = "1"
HASHES = ("script_hash", "caption_hash", "metadata_hash", "pipeline_version")
REVIEWED = 30
SUMMARY = "unit_count bigint, segment_count bigint, unmatched_count bigint, inferred_count bigint, low_count bigint, average_confidence double"
SOURCES = f"episode bigint, run string, video_id string, caption_track string, alignment_method string, script_hash string, caption_hash string, metadata_hash string, pipeline_version string, generated_at timestamp, {SUMMARY}"
SEGMENTS = "run string, episode bigint, local_index int, video_id string, text string, start double, end double, confidence double, timing_source string"
SEGMENT = "struct<local_index:int,start:double,end:double,confidence:double,timing_source:string,text:string>"
REVIEWS = f"run string, episode bigint, video_id string, {SUMMARY}, unmatched array<struct<unit_index:int,reason:string,text:string>>, low array<{SEGMENT}>, inferred array<{SEGMENT}>"
REPORT = f"episode bigint, episode_key string, status string, skipped boolean, message string, {SUMMARY}"
#: Statuses of a manifest entry that has no single video and script.
UNPROCESSABLE = ("missing-video", "missing-script", "ambiguous", "duplicate")


def heard(captions: DataFrame) -> DataFrame:
    """(episode, heard): whether the captions' cues hold any letter or digit."""
    return landed.caption_cues(captions).groupBy("episode").agg(F.max(F.col("text").rlike(r"[\p{L}\p{N}ー]")).alias("heard"))


def resolved(wanted: DataFrame, entries: DataFrame, videos: DataFrame, scripts: DataFrame, captions: DataFrame, transcripts: DataFrame, preferred: DataFrame | None = None, prefer_asr: bool = False) -> DataFrame:
    """A row per wanted episode: its video, script and timing source, or why it can't be processed.

    wanted (episode), entries (episode, video_id, script_url, status), videos (video_id, duration, ...), scripts (episode,
    url, text), captions (episode, json), transcripts (episode, stdout), preferred (episode). The timing source is the
    transcript where it is preferred, else the captions, else, and also if nothing is heard in them, the transcript.
    Captions without words are taken if there is no transcript. error: the first of the sides that are missing.
    """
    meta = F.to_json(F.struct(*sorted(c for c in videos.columns if c != "episode")))
    rows = wanted.select(F.col("episode").cast("bigint")).distinct().join(entries.select("episode", "video_id", "script_url", "status", F.lit(True).alias("listed")), "episode", "left")
    rows = rows.join(videos.select("video_id", F.col("duration").cast("double").alias("duration"), meta.alias("metadata")).dropDuplicates(["video_id"]), "video_id", "left")
    rows = rows.join(scripts.select("episode", F.col("url").alias("script_url"), F.col("text").alias("script")).dropDuplicates(["episode", "script_url"]), ["episode", "script_url"], "left")
    rows = rows.join(captions.groupBy("episode").agg(F.min("json").alias("captions")), "episode", "left").join(heard(captions), "episode", "left")
    model = F.coalesce(landed.transcript_model("transcript"), F.lit("unknown"))
    rows = rows.join(transcripts.groupBy("episode").agg(F.min("stdout").alias("transcript")), "episode", "left")
    wish = F.lit(prefer_asr)
    if preferred is not None:
        rows = rows.join(preferred.select("episode", F.lit(True).alias("wish")).distinct(), "episode", "left")
        wish = wish | F.coalesce("wish", F.lit(False))
    asr = F.col("transcript").isNotNull() & (wish | F.col("captions").isNull() | ~F.coalesce("heard", F.lit(False)))
    error = (
        F.when(F.col("listed").isNull(), "not in the manifest").when(F.col("status").isin(*UNPROCESSABLE), F.concat(F.lit("status is "), "status"))
        .when(F.col("metadata").isNull(), "no video").when(F.col("script").isNull(), "no script").when(F.col("captions").isNull() & F.col("transcript").isNull(), "no captions and no transcript")
        .when(asr, landed.transcript_fault("transcript"))
    )
    return rows.select(
        "episode", "video_id", "duration", "script", "metadata", F.when(asr, F.concat(F.lit("asr-"), model)).when(F.col("captions").isNotNull(), "ja-orig").alias("caption_track"),
        F.when(asr, "asr").when(F.col("captions").isNotNull(), "captions").alias("alignment_method"), F.when(asr, F.col("transcript")).otherwise(F.col("captions")).alias("timed"), error.alias("error"),
    )


def hashed(sources: DataFrame) -> DataFrame:
    """sources with the hashes of what an alignment is made from."""
    return sources.withColumns({"script_hash": ids.content_hash(F.col("script")), "caption_hash": ids.content_hash(F.col("timed")), "metadata_hash": ids.content_hash(F.col("metadata")), "pipeline_version": F.lit(VERSION)})


def timed_cues(sources: DataFrame) -> DataFrame:
    """(episode, cue, text, start, end) of either kind of source. A transcript that can't be read gives no cues."""
    captions = landed.caption_cues(sources.where("alignment_method = 'captions'").select("episode", F.col("timed").alias("json")))
    return captions.unionByName(landed.transcript_cues(sources.where("alignment_method = 'asr'").select("episode", F.col("timed").alias("stdout"))))


def summaries(found: DataFrame, script_units: DataFrame) -> DataFrame:
    """(episode, the columns of SUMMARY) of aligned rows."""
    placed, confidence = F.col("local_index").isNotNull(), F.col("confidence")
    counted = found.groupBy("episode").agg(
        F.count("local_index").alias("segment_count"), F.count_if(~placed).alias("unmatched_count"), F.count_if(placed & (F.col("timing_source") == "interpolated")).alias("inferred_count"),
        F.count_if(placed & (F.coalesce(confidence, F.lit(0.0)) < manifest.LOW_CONFIDENCE)).alias("low_count"), (F.floor(F.avg(F.when(placed, confidence)) * 1000 + 0.5) / 1000).alias("average_confidence"),
    )
    of = script_units.groupBy("episode").agg(F.count(F.lit(1)).alias("unit_count"))
    return of.join(counted, "episode", "left").select("episode", "unit_count", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("segment_count", "unmatched_count", "inferred_count", "low_count")), "average_confidence")


def _first(rows: Column, size: int) -> Column:
    return F.slice(F.array_sort(rows), 1, size)


def reviews(found: DataFrame, states: DataFrame) -> DataFrame:
    """(run, episode, ...) of REVIEWS: the lowest confidences and the first unplaced units, REVIEWED at most, and all inferred segments."""
    placed = F.col("local_index").isNotNull()
    segment = F.struct("local_index", "start", "end", "confidence", "timing_source", "text")
    low = F.coalesce("confidence", F.lit(0.0)) < manifest.LOW_CONFIDENCE
    lists = found.groupBy("episode").agg(
        _first(F.collect_list(F.when(~placed, F.struct("unit_index", F.col("issue").alias("reason"), "text"))), REVIEWED).alias("unmatched"),
        F.transform(_first(F.collect_list(F.when(placed & low, F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), segment.alias("s")))), REVIEWED), lambda x: x["s"]).alias("low"),
        F.array_sort(F.collect_list(F.when(placed & (F.col("timing_source") == "interpolated"), segment))).alias("inferred"),
    )
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    rows = states.join(lists, "episode", "left")
    return rows.select(
        "run", "episode", "video_id", "unit_count", "segment_count", "unmatched_count", "inferred_count", "low_count", "average_confidence",
        empty("unmatched", "array<struct<unit_index:int,reason:string,text:string>>"), empty("low", f"array<{SEGMENT}>"), empty("inferred", f"array<{SEGMENT}>"),
    )


class Store:
    """The stored state of a data folder."""

    def __init__(self, spark: SparkSession, data: str):
        self.spark, self.data = spark, data

    def sources(self) -> DataFrame:
        return tables.read(self.spark, f"{self.data}/sources", SOURCES)

    def _runs(self, name: str, schema: str) -> DataFrame:
        """The rows that the current sources name: an episode's of its own run."""
        if not tables.exists(self.spark, f"{self.data}/sources"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.data}/{name}")
        return rows.join(self.sources().select("episode", "run"), ["episode", "run"], "left_semi").select(*rows.columns)

    def segments(self) -> DataFrame:
        return self._runs("alignments", SEGMENTS)

    def reviews(self) -> DataFrame:
        if not tables.exists(self.spark, f"{self.data}/sources"):
            return self.spark.createDataFrame([], REVIEWS)
        rows = self.spark.read.schema(REVIEWS).parquet(f"{self.data}/reviews")
        newest = rows.groupBy("episode").agg(F.max("run").alias("run"))  # a repair is of a later run than the alignment
        return rows.join(newest, ["episode", "run"], "left_semi").join(self.sources().select("episode"), "episode", "left_semi").select(*rows.columns)

    def report(self) -> DataFrame:
        return tables.read(self.spark, f"{self.data}/build_report", REPORT)


def actions(sources: DataFrame, store: Store, force: bool = False) -> DataFrame:
    """sources with action: failed, align, repair (the review only) or reuse."""
    stored = store.sources()
    rows = manifest.unchanged(sources.withColumn("video", F.col("video_id")), stored.withColumn("video", F.col("video_id")), "episode", ["video", *HASHES])
    known = stored.join(sources.select("episode"), "episode", "left_semi")
    mine = lambda df: df.join(known.select("episode"), "episode", "left_semi")
    issues = validate.alignment_report(mine(store.segments()), known, mine(store.reviews()), sources.select("episode", "duration"))
    bad = issues.groupBy("episode").agg(F.max(~F.col("path").startswith("review")).alias("unsound"), F.max(F.col("path").startswith("review")).alias("unreviewed"))
    action = (
        F.when(F.col("error").isNotNull(), "failed").when(F.lit(force) | ~F.coalesce("skip", F.lit(False)) | F.coalesce("unsound", F.lit(False)), "align")
        .when(F.coalesce("unreviewed", F.lit(False)), "repair").otherwise("reuse")
    )
    return rows.join(bad, "episode", "left").withColumn("action", action).drop("skip", "video", "unsound", "unreviewed")


def run(spark: SparkSession, data: str, sources: DataFrame, tokenizer: corpus.Tokenizer | None = None, force: bool = False, now: str | None = None) -> DataFrame:
    """Bring the chosen episodes up to date; a row of REPORT for each. With a tokenizer, readings are aligned as well."""
    store, at = Store(spark, data), F.lit(now).cast("timestamp") if now else F.current_timestamp()
    number = len(tables.versions(spark, f"{data}/sources"))
    last = store.sources().agg(F.max("run")).first()[0]
    name = f"{int(last.split('-')[0]) + 1 if last else number:010d}-{uuid.uuid4().hex[:8]}"
    planned = tables.staged(actions(hashed(sources), store, force), f"{data}/_work/{name}/planned")
    todo = planned.where("action = 'align'")
    script_units, cues = units.script_units(todo.select("episode", F.col("script").alias("text"))), timed_cues(todo)
    if tokenizer is not None:
        script_units, cues = (df.withColumn("reading", corpus.reading(F.col("text"), tokenizer)) for df in (script_units, cues))
    found = tables.staged(align.aligned(script_units, cues), f"{data}/_work/{name}/found")
    failed = found.where("issue = 'failed'").select("episode", F.col("text").alias("message"))
    good = found.join(failed.select("episode"), "episode", "left_anti")
    states = todo.join(failed.select("episode"), "episode", "left_anti").join(summaries(good, script_units), "episode", "left").withColumns({"run": F.lit(name), "generated_at": at})
    whole = [f.name for f in states.sparkSession.createDataFrame([], SUMMARY).schema if f.name != "average_confidence"]
    states = tables.staged(states.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in whole}).select(*[f.name for f in spark.createDataFrame([], SOURCES).schema]), f"{data}/_work/{name}/states")
    segments = good.where("local_index is not null").join(states.select("episode", "video_id"), "episode")
    segments.select([c for c in (f.name for f in spark.createDataFrame([], SEGMENTS).schema) if c != "run"]).write.parquet(f"{data}/alignments/run={name}")
    again = store.sources().join(planned.where("action = 'repair'").select("episode"), "episode", "left_semi")
    stored = store.segments().join(again.select("episode"), "episode", "left_semi").withColumns({"unit_index": F.lit(None).cast("int"), "issue": F.lit(None).cast("string")})
    made = reviews(good, states).unionByName(reviews(stored, again))
    made.drop("run").write.parquet(f"{data}/reviews/run={name}")
    current = tables.upserted(store.sources(), states, "episode")
    tables.write_stable(current, f"{data}/sources", ())
    result = tables.staged(outcome(planned, failed, store), f"{data}/results/run={name}")
    tables.write_stable(tables.upserted(store.report(), result, "episode"), f"{data}/build_report", ())
    tables.remove(spark, f"{data}/_work/{name}")
    return result


def outcome(planned: DataFrame, failed: DataFrame, store: Store) -> DataFrame:
    """A row of REPORT for each planned episode."""
    rows = planned.select("episode", "action", "error").join(failed, "episode", "left").join(store.sources().drop("run"), "episode", "left")
    bad, skipped = (F.col("action") == "failed") | F.col("message").isNotNull(), F.col("action").isin("reuse", "repair")
    low = (F.col("low_count") > 0) | (F.col("unmatched_count") > 0)
    status = F.when(bad, "failed").when(low, "low-confidence").otherwise("processed")
    counts = [f.name for f in planned.sparkSession.createDataFrame([], SUMMARY).schema]
    return rows.select(
        "episode", ids.episode_key(F.col("episode")).alias("episode_key"), status.alias("status"), (skipped & ~bad).alias("skipped"), F.coalesce("error", "message").alias("message"), *(F.when(~bad, F.col(c)).alias(c) for c in counts)
    )
