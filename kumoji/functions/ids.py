"""Column expressions for identifiers, hashes, rounding and time formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PER_EPISODE = 100_000


def checked(value: Column, ok: Column, message: str) -> Column:
    """value where ok holds; else the query fails with the message."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("bigint"))


def segment_id(episode: Column, index: Column) -> Column:
    ok = (episode > 0) & (index >= 0) & (index < PER_EPISODE)
    return checked(episode.cast("bigint") * PER_EPISODE + index, ok, "episode must be positive and index within 0 to 99999")


def episode_of(segment: Column) -> Column:
    return checked(F.floor(segment / PER_EPISODE), segment >= PER_EPISODE, "not a segment id")


def index_of(segment: Column) -> Column:
    return checked(segment % PER_EPISODE, segment >= PER_EPISODE, "not a segment id")


def episode_key(episode: Column) -> Column:
    return F.concat(F.lit("ep"), episode.cast("string"))


def segment_key(episode: Column, index: Column) -> Column:
    return F.concat(episode_key(episode), F.lit("-s"), F.lpad(index.cast("string"), 5, "0"))


def bucket(key: Column) -> Column:
    """One of 256 names: the first byte of the key's SHA-256."""
    return F.substring(F.sha2(key, 256), 1, 2)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def cache_name(url: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(url, 256), 1, digits)


def milli(x: Column) -> Column:
    """Rounded to three places, halves up, on the binary number; round() differs on half-way values."""
    return F.floor(x * 1000 + 0.5) / 1000


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; never negative."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("bigint")
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def precise_clock(seconds: Column) -> Column:
    """m:ss.ff"""
    s = F.greatest(seconds, F.lit(0.0))
    hundredths = F.floor(s % 60 * 100).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.floor(s / 60).cast("bigint").cast("string"), F.lit(":"), two(F.floor(hundredths / 100).cast("bigint")), F.lit("."), two(hundredths % 100))


def watch_url(video: Column, start: Column, lead: float = 1.0) -> Column:
    at = F.greatest(F.floor(start - lead), F.lit(0)).cast("bigint")
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video, F.lit("&t="), at.cast("string"), F.lit("s"))


def safe_part(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-")


def published_at(epoch: Column, released: Column, day: Column) -> Column:
    """ISO time of the first positive epoch, else of a YYYYMMDD day; UTC."""
    form = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    first = F.when(epoch > 0, epoch).when(released > 0, released)
    by_day = F.when(day.rlike(r"^\d{8}$"), F.try_to_timestamp(day, F.lit("yyyyMMdd")))
    return F.coalesce(F.date_format(F.timestamp_seconds(first), form), F.date_format(by_day, form))
