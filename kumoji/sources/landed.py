"""Sources that land as files: playlists, sitemaps, pages, captions, transcripts, overrides; and stable sinks.

Fetching is outside the engine: what a downloader lands in a folder or a store is read by Spark's own readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text

ENTRY = "struct<id:string,title:string,url:string,webpage_url:string,duration:double,timestamp:bigint,release_timestamp:bigint,upload_date:string>"
CAPTION = "struct<events:array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string,tOffsetMs:double>>>>>"
TRANSCRIPT = "struct<engine:string,model:string,language:string,segments:array<struct<start:double,end:double,text:string>>>"


# ---- Playlists -------------------------------------------------------------------------------------------------------


def playlist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"entries array<{ENTRY}>").option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")


def videos(entries: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(video_id, title, url, episode, published_at, duration) of the entries with a good id and a title."""
    vid = text.playlist_video_id(F.col("id"), F.col("url"), F.col("webpage_url"))
    http = lambda c: F.when(F.col(c).rlike("^https?://"), F.col(c))
    rows = entries.withColumn("video_id", vid).withColumn("title", F.trim("title")).where(F.col("video_id").isNotNull() & (F.length("title") > 0))
    out = rows.select(
        "video_id", "title", F.coalesce(http("webpage_url"), http("url"), F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("video_id"))).alias("url"), text.episode_from_title(F.col("title")).alias("episode"),
        ids.published_at(F.col("timestamp"), F.col("release_timestamp"), F.col("upload_date")).alias("published_at"), F.when(F.col("duration") >= 0, F.col("duration")).alias("duration"),
    )
    if overrides is not None:
        renamed = overrides.select(F.col("video_id"), F.col("episode").alias("o_episode"))
        out = out.join(renamed, "video_id", "left").withColumn("episode", F.coalesce("o_episode", "episode")).drop("o_episode")
    return out


def video_order() -> list[Column]:
    return [F.col("episode").asc_nulls_last(), F.col("published_at").asc_nulls_last(), F.col("video_id").asc()]


# ---- Sitemaps and pages ----------------------------------------------------------------------------------------------


def sitemap(xml: DataFrame, column: str = "xml") -> DataFrame:
    """(url, lastmod, episode) of the url blocks; lastmod only as YYYY-MM-DD."""
    tag = lambda name: text.xml_decoded(F.trim(F.regexp_extract("block", rf"(?is)<{name}>(.*?)</{name}>", 1)))
    blocks = xml.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?is)<url>.*?</url>"), F.lit(0))).alias("block"))
    rows = blocks.select(tag("loc").alias("url"), tag("lastmod").alias("lastmod")).where(F.length("url") > 0)
    return rows.select("url", F.when(F.col("lastmod").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("lastmod")).alias("lastmod"), text.episode_from_page(F.col("url")).alias("episode"))


def fresh_cache(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """entries with the cached page's path where it is still good: no lastmod, or the same one."""
    known = cache.select("url", F.col("lastmod").alias("c_lastmod"), "html_path")
    good = F.col("lastmod").isNull() | (F.col("lastmod") == F.col("c_lastmod"))
    return entries.join(known, "url", "left").withColumn("html_path", F.when(good, F.col("html_path"))).drop("c_lastmod")


BLOG = "struct<headline:string,datePublished:string,dateModified:string>"


def blog_metadata(html: Column) -> Column:
    """The first BlogPosting of the page's JSON-LD blocks; malformed ones are passed over."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    one = lambda s: F.coalesce(F.from_json(s, "array<struct<`@type`:string,headline:string,datePublished:string,dateModified:string>>"), F.array().cast("array<struct<`@type`:string,headline:string,datePublished:string,dateModified:string>>"))
    blog = F.filter(F.flatten(F.transform(raw, lambda s: one(text.xml_decoded(s)))), lambda x: x["@type"] == "BlogPosting")
    first = F.get(blog, F.lit(0))
    return F.when(F.size(blog) > 0, F.struct(first["headline"].alias("headline"), first["datePublished"].alias("datePublished"), first["dateModified"].alias("dateModified")))


def script_pages(pages: DataFrame, url: str = "url", html: str = "html", start: str = "<article>", end: str = "</article>", numeric: bool = True, hooks: bool = False) -> DataFrame:
    """(url, title, episode, title_episode, url_episode, text, status): parsed if title, episode and text are there.

    The text is what the page builder's hooks enclose, if asked for, else what stands between two markers.
    """
    meta = pages.withColumn("meta", blog_metadata(F.col(html)))
    title = F.coalesce(F.nullif(F.trim("meta.headline"), F.lit("")), text.visible_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), numeric))
    body = text.post_text(F.col(html), numeric) if hooks else text.without_boilerplate(text.visible_text(text.between(F.col(html), start, end), numeric))
    rows = meta.select(F.col(url).alias("url"), title.alias("title"), body.alias("text"), F.col("meta.datePublished").alias("published_at"), F.col("meta.dateModified").alias("modified_at"))
    rows = rows.withColumn("title_episode", text.episode_from_page(F.col("title"))).withColumn("url_episode", text.episode_from_page(F.col("url")))
    rows = rows.withColumn("episode", F.coalesce("title_episode", "url_episode"))
    whole = (F.length("title") > 0) & F.col("episode").isNotNull() & (F.length("text") > 0)
    return rows.withColumn("status", F.when(F.coalesce(whole, F.lit(False)), "parsed").otherwise("unparsed"))


def cache_names(pages: DataFrame) -> DataFrame:
    """epN, or epN.k where an episode has several pages."""
    w = Window.partitionBy("episode")
    k = F.row_number().over(w.orderBy("url"))
    key = ids.episode_key(F.col("episode"))
    return pages.withColumn("cache_name", F.when(F.count(F.lit(1)).over(w) > 1, F.concat(key, F.lit("."), k.cast("string"))).otherwise(key))


# ---- Captions --------------------------------------------------------------------------------------------------------


def caption_cues(captions: DataFrame, key: str = "episode", column: str = "json", form: str = CAPTION) -> DataFrame:
    """(key, cue, text, start, end) in seconds: a cue is spoken until its own end or the next event's start."""
    events = captions.select(key, F.posexplode(F.from_json(F.col(column), form)["events"]).alias("cue", "e"))
    start = F.when(~F.isnan("e.tStartMs"), F.col("e.tStartMs"))
    following = F.first("start_ms", ignorenulls=True).over(Window.partitionBy(key).orderBy("cue").rowsBetween(1, Window.unboundedFollowing))
    rows = events.withColumn("start_ms", start).withColumn("next_ms", following).where("start_ms is not null and e.segs is not null")
    cue_text = F.replace(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), F.lit("\n"), F.lit(""))
    until = F.least(F.col("start_ms") + F.coalesce(F.col("e.dDurationMs"), F.lit(3000.0)), F.coalesce("next_ms", F.col("start_ms") + 3000))
    rows = rows.select(key, "cue", cue_text.alias("text"), (F.col("start_ms") / 1000).alias("start"), (F.greatest(until, F.col("start_ms") + 100) / 1000).alias("end"))
    return rows.where(F.length(F.trim("text")) > 0)


def _transcript(column: str) -> Column:
    """A recogniser's document within its noisy output: the whole text, or the last line that is an object."""
    lines = F.filter(F.split(F.trim(column), "\n"), lambda s: F.trim(s).rlike(r"^\{.*\}$"))
    payload = F.when(F.trim(column).rlike(r"(?s)^\{.*\}$") & F.from_json(F.trim(column), TRANSCRIPT)["segments"].isNotNull(), F.trim(column)).otherwise(F.try_element_at(lines, F.lit(-1)))
    return F.from_json(payload, TRANSCRIPT)


def _bad_segment(s: Column) -> Column:
    return (s["end"] <= s["start"]) | (F.length(F.trim(s["text"])) == 0)


def transcript_fault(column: str = "stdout") -> Column:
    """Why transcript_cues would raise; null if it would not."""
    segments = _transcript(column)["segments"]
    return F.when(segments.isNull(), "no transcript").when(F.exists(segments, _bad_segment), "bad segment")


def transcript_model(column: str = "stdout") -> Column:
    return _transcript(column)["model"]


def transcript_cues(transcripts: DataFrame, key: str = "episode", column: str = "stdout") -> DataFrame:
    """Cues of a recogniser's noisy output; one that can't be read, or a segment without text or length, is an error."""
    found = transcripts.withColumn("doc", _transcript(column))
    checked = F.when(F.col("doc.segments").isNotNull(), F.col("doc.segments")).otherwise(F.raise_error(F.lit("no transcript")).cast("array<struct<start:double,end:double,text:string>>"))
    rows = found.select(key, F.posexplode(checked).alias("cue", "s"))
    return rows.select(key, "cue", F.when(_bad_segment(F.col("s")), F.raise_error(F.lit("bad segment")).cast("string")).otherwise(F.col("s.text")).alias("text"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def caption_characters(cues: DataFrame, key: str = "episode", least: float = 0.05) -> DataFrame:
    """(key, cue, i, ch, start, end): a cue's characters, letters and numbers in lower case, evenly over its time."""
    chars = F.filter(F.split(F.lower("text"), ""), lambda c: c.rlike(r"[\p{L}\p{N}]"))
    rows = cues.withColumn("chars", chars).withColumn("n", F.size("chars")).where("n > 0")
    rows = rows.withColumn("each", F.greatest((F.col("end") - F.col("start")) / F.col("n"), F.lit(least)))
    rows = rows.select(key, "cue", "start", "each", F.posexplode("chars").alias("i", "ch"))
    return rows.select(key, "cue", "i", "ch", (F.col("start") + F.col("i") * F.col("each")).alias("start"), (F.col("start") + (F.col("i") + 1) * F.col("each")).alias("end"))


# ---- Overrides -------------------------------------------------------------------------------------------------------


def overrides(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four small tables of a source-overrides file, checked."""
    form = "youtubeEpisodeOverrides map<string,int>, scriptEpisodeOverrides map<string,int>, preferredScriptUrlsByEpisode map<string,string>, preferredAsrEpisodes array<int>"
    raw = spark.read.schema(form).option("multiLine", True).json(path)
    bad = lambda ok, what, value: F.when(ok, value).otherwise(F.raise_error(F.lit(what)))
    pairs = lambda c, k, v: raw.select(F.explode(c).alias(k, v))
    by_video, by_script = pairs("youtubeEpisodeOverrides", "video_id", "episode"), pairs("scriptEpisodeOverrides", "url", "episode")
    by_episode = pairs("preferredScriptUrlsByEpisode", "key", "url")
    number = F.col("key").cast("int")
    return {
        "videos": by_video.withColumn("video_id", bad(F.col("video_id").rlike(text.VIDEO_ID) & (F.col("episode") > 0), "bad video override", F.col("video_id"))),
        "scripts": by_script.withColumn("url", bad(F.try_parse_url(F.col("url"), F.lit("HOST")).isNotNull() & (F.col("episode") > 0), "bad script override", F.col("url"))),
        "preferred": by_episode.select(bad(number.cast("string") == F.col("key"), "bad episode", number).cast("int").alias("episode"), "url"),
        "asr": raw.select(F.explode(F.array_sort(F.array_distinct("preferredAsrEpisodes"))).alias("episode")),
    }
