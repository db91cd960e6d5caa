"""Commands: python -m kumoji.cli JOB ... runs a job on tables in a data directory."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids
from .functions.text import normalized_query
from .operators import corpus, manifest, process, reports, search, validate
from .sources import export, landed, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kumoji")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, *flags: str) -> argparse.ArgumentParser:
        p = jobs.add_parser(name)
        p.add_argument("--data-dir", required=True)
        for f in flags:
            p.add_argument(f)
        return p

    def processing(p: argparse.ArgumentParser, latest: bool = True) -> None:
        if latest:
            p.add_argument("--count", type=int, default=10)
            p.add_argument("--retry-failed", action="store_true")
        p.add_argument("--force", action="store_true")
        p.add_argument("--prefer-asr", action="store_true")
        p.add_argument("--overrides")

    job("list-videos", "--playlist", "--overrides")
    job("discover-scripts", "--pages")
    job("build-manifest", "--overrides")
    job("rebuild-index").add_argument("--allow-empty", action="store_true")
    processing(job("process-latest"))
    one = job("process-episode")
    one.add_argument("--episode", type=int, required=True)
    processing(one, latest=False)
    job("export-index", "--to").set_defaults(to=None)
    job("validate").add_argument("--no-report", action="store_true")
    s = job("search")
    s.add_argument("query")
    s.add_argument("--mode", choices=("auto", "lemma", "surface", "exact", "loose"), default="auto")
    s.add_argument("--limit", type=int, default=20)
    u = job("update", "--playlist", "--pages")
    processing(u)
    u.add_argument("--allow-empty", action="store_true")
    return top


def _overrides(spark: SparkSession, path: str | None) -> dict:
    return landed.overrides(spark, path) if path else {}


def list_videos(spark: SparkSession, data: str, playlist: str, overrides: str | None = None) -> None:
    """The videos, and a report of their episodes and of the overrides that were used or match no video."""
    wanted = _overrides(spark, overrides).get("videos")
    tables.write_stable(landed.videos(landed.playlist(spark, playlist), wanted), f"{data}/videos")
    rows = tables.read(spark, f"{data}/videos")
    found = reports.report(rows, "episode", "video_id")
    if wanted is not None:
        for section, used in (("applied-override", rows.join(wanted.select("video_id"), "video_id", "left_semi").select("video_id", "episode")), ("stale-override", manifest.stale_overrides(rows, wanted, "video_id"))):
            found = found.unionByName(used.select(F.lit(section).alias("section"), F.col("episode").cast("bigint").alias("episode"), F.col("video_id").alias("id"), F.lit(1).cast("bigint").alias("n")), allowMissingColumns=True)
    tables.write_stable(found, f"{data}/video_report")


def discover_scripts(spark: SparkSession, data: str, pages: str) -> None:
    """The pages' scripts, and a report of episodes by title and by address; a page without a script is in its status."""
    tables.write_stable(landed.script_pages(spark.read.parquet(pages), hooks=True), f"{data}/scripts")
    rows = tables.read(spark, f"{data}/scripts")
    tables.write_stable(reports.report(rows, "episode", "url", {"unparsed-page": F.col("status") != "parsed"}, "url_episode"), f"{data}/script_report")


def build_manifest(spark: SparkSession, data: str, overrides: str | None = None) -> None:
    """Overrides decide episodes and preferred scripts; an alignment that breaks a rule is invalid."""
    wanted, store = _overrides(spark, overrides), process.Store(spark, data)
    scripts, videos = tables.read(spark, f"{data}/scripts").where("status = 'parsed'").withColumn("lastmod", F.lit(None).cast("string")), tables.read(spark, f"{data}/videos")
    if "scripts" in wanted:
        scripts = manifest.with_overrides(scripts, wanted["scripts"], "url").drop("original_episode")
    state = store.sources()
    bad = validate.alignment_report(store.segments(), state, store.reviews(), videos.join(state.select("video_id", F.col("episode").alias("of")), "video_id").select(F.col("of").alias("episode"), "duration"))
    unsound = bad.where(~F.col("path").startswith("review")).select("episode").distinct().withColumn("unsound", F.lit(True))
    states = state.join(unsound, "episode", "left").select("episode", "video_id", F.col("unsound").isNull().alias("valid"), (F.col("low_count") + F.col("unmatched_count")).alias("low_confidence"))
    tables.write_stable(manifest.manifest(videos, manifest.canonical_scripts(scripts, wanted.get("preferred")), states), f"{data}/manifest")


def _sources(spark: SparkSession, data: str, wanted: DataFrame, overrides: str | None, prefer_asr: bool) -> DataFrame:
    scripts = tables.read(spark, f"{data}/scripts").where("status = 'parsed'")
    by_url = _overrides(spark, overrides).get("scripts")
    if by_url is not None:
        scripts = manifest.with_overrides(scripts, by_url, "url")

    def landing(name: str, form: str) -> DataFrame:
        return spark.read.parquet(f"{data}/{name}") if tables.there(spark, f"{data}/{name}") else spark.createDataFrame([], form)

    captions, transcripts = landing("captions", "episode bigint, json string"), landing("transcripts", "episode bigint, stdout string")
    return process.resolved(wanted, tables.read(spark, f"{data}/manifest"), tables.read(spark, f"{data}/videos"), scripts, captions, transcripts, _overrides(spark, overrides).get("asr"), prefer_asr)


def process_latest(spark: SparkSession, data: str, count: int, retry_failed: bool = False, force: bool = False, prefer_asr: bool = False, overrides: str | None = None) -> DataFrame:
    """Bring the newest episodes up to date: all in one stage, an episode a group."""
    if count <= 0:
        raise ValueError(f"count must be a positive whole number: {count}")
    chosen = manifest.latest(tables.read(spark, f"{data}/manifest"), count, retry_failed)
    return process.run(spark, data, _sources(spark, data, chosen, overrides, prefer_asr), force=force)


def process_episode(spark: SparkSession, data: str, episode: int, force: bool = False, prefer_asr: bool = False, overrides: str | None = None) -> DataFrame:
    wanted = spark.createDataFrame([(episode,)], "episode bigint")
    return process.run(spark, data, _sources(spark, data, wanted, overrides, prefer_asr), force=force)


def show(rows: DataFrame) -> None:
    for r in rows.orderBy("episode").collect():  # a run's episodes
        counts = f"{r.segment_count} segments, {r.unmatched_count} unmatched, {r.low_count} low" if r.status != "failed" else r.message
        print(f"{r.episode_key} {'skipped, ' if r.skipped else ''}{r.status}: {counts}")


def rebuild_index(spark: SparkSession, data: str, allow_empty: bool = False) -> None:
    """A new version of the index of all stored segments, with their videos' titles."""
    rows = process.Store(spark, data).segments()
    if not allow_empty and not rows.take(1):
        raise ValueError("nothing is aligned; --allow-empty makes an empty index")
    titles = tables.read(spark, f"{data}/videos", "video_id string, title string, published_at string").select("video_id", "title", "published_at").dropDuplicates(["video_id"])
    segs = rows.join(titles, "video_id", "left").select(
        ids.segment_id(F.col("episode"), F.col("local_index")).alias("segment_id"), ids.segment_key(F.col("episode"), F.col("local_index")).alias("segment_key"), "episode", "local_index", "text", "start", "end", "video_id", "title", "published_at",
    )
    tables.publish(spark, f"{data}/index", lambda folder: corpus.write_index(segs, folder))


def run_search(spark: SparkSession, data: str, query: str, mode: str, limit: int) -> None:
    index = corpus.Index(spark, tables.current(spark, f"{data}/index"))
    page = {"auto": search.auto, "lemma": search.lemma, "surface": search.surface, "exact": search.exact, "loose": search.loose}[mode](index, query, limit)
    lead = 1.0 if mode in ("exact", "loose") else 0.0
    total, rows = page.total(), page.rows()
    shown = search.hydrated(rows, index.segments_of(rows, page.limit), lead).orderBy("segment_id").select("episode", "title", "timestamp", "url", "text").collect()  # a page
    print(f"Search: {normalized_query(query)} ({', '.join(page.searched())}, {total} result{'' if total == 1 else 's'}, showing {len(shown)})")
    for k, r in enumerate(shown, 1):
        print(f"\n{k}. ep.{r.episode}{f' {r.title}' if r.title else ''} {r.timestamp}\n   {r.text}\n   {r.url}")


def run_validate(spark: SparkSession, data: str, need_review: bool = True) -> None:
    """Raise with everything that is wrong with what is stored."""
    store = process.Store(spark, data)
    videos = tables.read(spark, f"{data}/videos", "video_id string, duration double").select("video_id", "duration").dropDuplicates(["video_id"])
    durations = store.sources().select("episode", "video_id").join(videos, "video_id").select("episode", "duration")
    validate.require(validate.alignment_report(store.segments(), store.sources(), store.reviews(), durations, need_review))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"kumoji {a.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    data = a.data_dir
    if a.job in ("list-videos", "update") and a.playlist:
        list_videos(spark, data, a.playlist, a.overrides)
    if a.job in ("discover-scripts", "update") and a.pages:
        discover_scripts(spark, data, a.pages)
    if a.job in ("build-manifest", "update"):
        build_manifest(spark, data, a.overrides)
    if a.job in ("process-latest", "update"):
        show(process_latest(spark, data, a.count, a.retry_failed, a.force, a.prefer_asr, a.overrides))
    if a.job == "process-episode":
        show(process_episode(spark, data, a.episode, a.force, a.prefer_asr, a.overrides))
    if a.job == "update":  # with the new alignments
        build_manifest(spark, data, a.overrides)
    if a.job in ("build-manifest", "update"):
        for r in tables.read(spark, f"{data}/manifest").groupBy("status").count().orderBy("status").collect():  # a handful of statuses
            print(f"{r['status']}: {r['count']}")
    if a.job in ("rebuild-index", "update"):
        rebuild_index(spark, data, a.allow_empty)
    if a.job == "export-index":
        print(export.write_index(spark, tables.current(spark, f"{data}/index"), a.to or f"{data}/export"))
    if a.job == "search":
        run_search(spark, data, a.query, a.mode, a.limit)
    if a.job == "validate":
        run_validate(spark, data, not a.no_report)


if __name__ == "__main__":
    main()
