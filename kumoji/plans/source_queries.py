"""Registered queries: pages, captions, manifest, reports and time operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import capture, corpus, manifest as m, reports, timeline
from ..sources import landed
from .corpus_queries import SEG


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(column: str) -> F.Column:
    """Whole seconds of a time stamp without a zone, as a double, with its fraction."""
    return F.unix_micros(F.col(column).cast("timestamp")) / 1_000_000


def page_title_text(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    return pages.select("page_id", text.visible_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), False).alias("title"))


def page_visible_text(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    return pages.select("page_id", text.visible_text(text.between(F.col("html"), "<article>", "</article>"), False).alias("text"))


def page_url_parts(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("PATH")).alias("path"))


def episode_from_url(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").withColumn("label", F.concat(F.lit("ep. "), F.regexp_extract("url", r"/(\d+)", 1)))
    return pages.select("page_id", text.episode_from_page(F.col("label")).cast("bigint").alias("episode"))


def boilerplate_strip(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", text.without_boilerplate(F.col("text"), ("(?i)licen[sc]e", "(?i)^the "), r"^[\s\-*・●]+").alias("text"))


def script_page_status(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").withColumn("url", F.concat("url", F.lit(" ep "), F.col("page_id").cast("string")))
    return landed.script_pages(pages, numeric=False).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("episode").alias("n_episodes"))


def caption_spoken_end(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("start", _seconds("ts"))
    return e.select("event_id", timeline.spoken_end(F.col("start"), F.col("value"), "user_id", ["ts", "event_id"], 3.0, 0.1).alias("spoken_end"))


def caption_characters(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").where("text is not null")
    cues = c.select(F.col("conv_id").alias("episode"), F.col("turn").alias("cue"), "text", (F.col("turn") * 8.0).alias("start"), (F.col("turn") * 8.0 + 6).alias("end"))
    rows = landed.caption_characters(cues)
    return rows.groupBy("episode", "cue").agg(F.count(F.lit(1)).alias("n"), F.max(F.floor(F.col("end") * 1000 + 0.5) / 1000).alias("last_end"))


def active_caption_asof(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    probes = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("probe_id"))
    rows = e.where("event_type <> 'click'").select("user_id", F.col("ts").alias("start"), "event_id")
    return timeline.asof_backward(probes, rows, "user_id", "ts", "start", "event_id").select("probe_id", F.col("found").alias("event_id"))


def cues_in_gap(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("at", _seconds("ts"))
    gaps = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("gap_id"), (F.col("at") - 5).alias("l_start"), (F.col("at") + 3600).alias("l_end"))
    cues = e.where("event_type <> 'click'").select("user_id", "event_id", F.col("at").alias("r_start"), (F.col("at") + 2).alias("r_end"))
    return timeline.overlapping(gaps, cues, "user_id", 3600.0).groupBy("gap_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def prev_next_context(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    out = timeline.context(c.select("conv_id", "turn", "text"), "conv_id", "turn", "text")
    return out.select("conv_id", "turn", "previous", "n_following")


def discovery_report(spark, sf_dir):
    """Documents as pages: an episode by the title unless it is Spanish, another one by the address for every seventh length, failed if very short."""
    d = _t(spark, sf_dir, "documents")
    rows = d.select("doc_id", "n_chars", F.when(F.col("lang") != "es", F.floor(F.col("doc_id") / 2)).alias("episode"), F.floor(F.col("doc_id") / 2 + F.when(F.col("n_chars") % 7 == 0, 1).otherwise(0)).alias("url_episode"))
    return reports.report(rows, "episode", "doc_id", {"failed": F.col("n_chars") < 20}, "url_episode")


def transcript_capture(spark, sf_dir):
    """From each tenth of a conversation's characters, two tenths of them, as clips; a turn takes eight seconds."""
    c = _t(spark, sf_dir, "conversations").where("text is not null")
    w = Window.partitionBy("conv_id").orderBy("turn")
    segs = c.select("conv_id", (F.row_number().over(w) - 1).alias("local_index"), "text", F.lit("abcdefghijk").alias("video_id"))
    segs = segs.withColumns({"start": F.col("local_index") * 8.0, "end": F.col("local_index") * 8.0 + 7.5})
    total = segs.groupBy("conv_id").agg(F.sum(F.length("text") + 1).alias("size"))
    tenth = lambda k: F.floor(F.col("size") * k / 10).cast("bigint")
    picked = total.select("conv_id", "size", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("selection")).select("conv_id", "selection", tenth(F.col("selection")).alias("a"), tenth(F.col("selection") + 2).alias("b"))
    found = capture.captures(segs, picked, "conv_id")
    return found.select("conv_id", "selection", F.length("selected_text").alias("n_chars"), F.size("lines").alias("n_lines"), "start_ms", "end_ms", "valid", F.sha2("selected_text", 256).alias("hash"))


def monotonic_violations(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("start", _seconds("ts")).withColumn("end", F.col("start") + F.col("value"))
    return timeline.monotonic_violations(e, "user_id", ["ts", "event_id"], "start", "end").select("user_id", "event_id", "previous_end")


def contiguity_check(spark, sf_dir):
    return timeline.contiguous(_t(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "n", F.col("b").alias("last_turn"))


def interpolated_gap(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("known", F.when(F.col("event_id") % 5 == 0, F.col("event_id").cast("double"))).withColumn("weight", F.lit(1.0))
    return timeline.interpolated(e, "user_id", "event_id", "known", "weight").select("event_id", (F.floor(F.col("filled") * 1000 + 0.5) / 1000).alias("filled"))


def canonical_choice(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return m.first_of(o, "o_custkey", [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").asc()]).select("o_custkey", "o_orderkey", F.col("copies").alias("n_orders"))


def duplicate_groups(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", ids.content_hash(F.col("text")).alias("hash"))
    return m.duplicates(docs, "hash", "doc_id")


def missing_in_range(spark, sf_dir):
    return m.missing(_t(spark, sf_dir, "labels"), "doc_id")


def _manifest(spark, sf_dir):
    docs, labels, conv = (_t(spark, sf_dir, n) for n in ("documents", "labels", "conversations"))
    videos = docs.select(F.floor(F.col("doc_id") / 2).alias("episode"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id"), F.col("n_chars").cast("string").alias("published_at"))
    scripts = labels.select((F.col("doc_id") * 2).alias("episode"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("published_at"), F.lit(None).cast("string").alias("modified_at"), F.lit(None).cast("string").alias("lastmod"))
    states = conv.groupBy(F.col("conv_id").alias("episode")).agg(F.concat(F.lit("v"), (F.first("conv_id") * 2).cast("string")).alias("video_id"), F.lit(True).alias("valid"), F.count_if(F.col("role") == "system").alias("low_confidence"))
    return m.manifest(videos, m.canonical_scripts(scripts), states)


def manifest_status(spark, sf_dir):
    return _manifest(spark, sf_dir)


def status_counts(spark, sf_dir):
    return _manifest(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _overrides(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id"), F.col("doc_id").alias("episode"))
    wanted = spark.range(40).select(F.concat(F.lit("v"), (F.col("id") * 37).cast("string")).alias("video_id"), (F.col("id") + 5000).alias("episode"))
    return docs, wanted


def override_applied(spark, sf_dir):
    docs, wanted = _overrides(spark, sf_dir)
    return m.applied_overrides(docs, wanted, "video_id")


def override_stale(spark, sf_dir):
    docs, wanted = _overrides(spark, sf_dir)
    return m.stale_overrides(docs, wanted, "video_id")


def latest_k(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("discovered").alias("status"), F.lit("v").alias("video_id"), F.lit("s").alias("script_url"))
    return m.latest(o, 10).select("episode", "status")


def review_low_k(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("position", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return m.review(li, "l_returnflag", 30, "l_discount", "position").select("l_returnflag", "position", "rank")


def summary_metrics(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("confidence", F.when(F.col("l_linenumber") > 1, F.col("l_discount") * 10)).withColumn("timing_source", F.when(F.col("l_linestatus") == "F", "interpolated").otherwise("caption"))
    return m.summary(li, "l_shipdate")


def build_report_merge(spark, sf_dir):
    old = _t(spark, sf_dir, "documents").select(ids.episode_key(F.col("doc_id")).alias("episode_key"), F.when(F.col("doc_id") % 3 == 0, "failed").when(F.col("doc_id") % 3 == 1, "processed").otherwise("discovered").alias("status"))
    new = _t(spark, sf_dir, "labels").select(ids.episode_key(F.col("doc_id")).alias("episode_key"), F.when(F.col("quality") == 1, "processed").otherwise("low-confidence").alias("status"))
    return m.rebuilt_report(old, new)


def incremental_skip(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", ids.content_hash(F.col("text")).alias("script_hash"))
    stored = docs.where("doc_id % 2 = 0").withColumn("script_hash", F.when(F.col("doc_id") % 10 == 0, "sha256:0").otherwise(F.col("script_hash")))
    return m.unchanged(docs, stored, "doc_id", ["script_hash"])


def schema_violations(spark, sf_dir):
    """Segments that break a rule, by rule: the tables are sound, so a part is bent first."""
    s = corpus.segments(_t(spark, sf_dir, "documents")).withColumn("start", F.col("local_index") * 2.0).withColumn("end", F.when(F.col("segment_id") % 97 == 0, F.col("local_index") * 2.0).otherwise(F.col("local_index") * 2.0 + 1.5))
    from ..operators import validate

    return validate.segment_violations(s.withColumn("segment_key", F.when(F.col("segment_id") % 101 == 0, "?").otherwise(F.col("segment_key")))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def publish_times(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    at = F.when(F.col("event_id") % 3 > 0, F.col("event_id") * 1000 + 1_600_000_000)
    return e.select("event_id", ids.published_at(at, F.lit(None).cast("bigint"), F.lit("20240229")).alias("published_at"))


QUERIES = {
    f.__name__: f
    for f in (
        page_title_text, page_visible_text, page_url_parts, episode_from_url, boilerplate_strip, script_page_status, caption_spoken_end, caption_characters, active_caption_asof, cues_in_gap,
        prev_next_context, discovery_report, transcript_capture, monotonic_violations, contiguity_check, interpolated_gap, canonical_choice, duplicate_groups, missing_in_range, manifest_status, status_counts, override_applied,
        override_stale, latest_k, review_low_k, summary_metrics, build_report_merge, incremental_skip, schema_violations, publish_times,
    )
}

_VISIBLE = r"""array_to_string(list_filter(list_transform(string_split(
  replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|section|article)>', chr(10), 'g'),
  '(?is)<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&apos;', ''''), '&nbsp;', chr(160)), '&quot;', '"'), '&#39;', ''''),
  chr(10)), lambda l: trim(regexp_replace(l, '[ \t\r\f\v\x{{A0}}]+', ' ', 'g'))), lambda l: length(l) > 0), chr(10))"""
_AT = "(epoch_us(ts) / 1000000.0)"
_SEC = f"cast({_AT} as double)"
_MANIFEST = """
with v as (select doc_id // 2 as episode, 'v' || doc_id as video_id, cast(n_chars as varchar) as p from documents),
bv as (select episode, video_id, count(*) over (partition by episode) as vc, row_number() over (partition by episode order by p desc, video_id) as r from v),
sc as (select doc_id * 2 as episode, min('s' || doc_id) as script_url, count(*) as sc from labels group by doc_id),
st as (select conv_id as episode, 'v' || conv_id * 2 as a_video, count(*) filter (where role = 'system') as low from conversations group by conv_id),
j as (select coalesce(bv.episode, sc.episode) as episode, video_id, script_url, vc, sc from (select * from bv where r = 1) bv full join sc on bv.episode = sc.episode),
mf as (select j.episode, video_id, script_url,
  case when video_id is null then 'missing-video' when script_url is null then 'missing-script' when coalesce(vc, 0) > 1 then 'ambiguous' when a_video is not null and a_video is distinct from video_id then 'failed'
    when a_video = video_id and low > 0 then 'low-confidence' when a_video = video_id then 'processed' else 'discovered' end as status,
  nullif(concat_ws('; ', case when vc > 1 then vc || ' videos' end, case when sc > 1 then sc || ' scripts' end, case when a_video is not null and a_video is distinct from video_id then 'aligned to another video' end), '') as notes
  from j left join st on j.episode = st.episode)
"""

ORACLES = {
    "page_title_text": "select page_id, " + _VISIBLE.format(x=r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + " as title from pages",
    "page_visible_text": "select page_id, " + _VISIBLE.format(x="case when strpos(a, '</article>') > 0 then left(a, strpos(a, '</article>') - 1) else a end") + " as text from (select page_id, case when strpos(html, '<article>') > 0 then substr(html, strpos(html, '<article>') + 9) end as a from pages)",
    "page_url_parts": r"select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path from pages",
    "episode_from_url": r"select page_id, case when length(n) between 1 and 4 and cast(n as bigint) > 0 then cast(n as bigint) end as episode from (select page_id, ltrim(regexp_extract(url, '/(\d+)', 1), '0') as n from pages)",
    "boilerplate_strip": r"select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: not regexp_matches(regexp_replace(l, '^[\s\-*・●]+', ''), '(?i)licen[sc]e') and not regexp_matches(regexp_replace(l, '^[\s\-*・●]+', ''), '(?i)^the ')), chr(10)) as text from documents where text is not null",
    "script_page_status": "select case when length(t) > 0 and page_id > 0 and page_id < 10000 and length(x) > 0 then 'parsed' else 'unparsed' end as status, count(*) as n, count(case when page_id > 0 and page_id < 10000 then 1 end) as n_episodes from (select page_id, coalesce(" + _VISIBLE.format(x=r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ", '') as t, coalesce(" + _VISIBLE.format(x="case when strpos(html, '<article>') > 0 then substr(html, strpos(html, '<article>') + 9) end") + ", '') as x from pages) group by 1",
    "caption_spoken_end": f"select event_id, greatest(least({_SEC} + value, coalesce(lead({_SEC}) over (partition by user_id order by ts, event_id), {_SEC} + 3)), {_SEC} + 0.1) as spoken_end from events",
    "caption_characters": r"with c as (select conv_id as episode, turn as cue, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]')) as n, turn * 8.0::double as s from conversations where text is not null) select episode, cue, cast(n as bigint) as n, floor((s + n * greatest(6.0::double / n, 0.05::double)) * 1000 + 0.5) / 1000 as last_end from c where n > 0",
    "active_caption_asof": "with r as (select user_id, ts, max(event_id) as event_id from events where event_type <> 'click' group by user_id, ts) select p.event_id as probe_id, r.event_id from (select * from events where event_type = 'click') p asof left join r on p.user_id = r.user_id and p.ts >= r.ts",
    "cues_in_gap": f"with e as (select *, {_SEC} as at from events) select g.event_id as gap_id, count(*) as n, min(c.event_id) as first_event from (select * from e where event_type = 'click') g join (select * from e where event_type <> 'click') c on g.user_id = c.user_id and g.at - 5 <= c.at + 2 and c.at <= g.at + 3600 group by 1",
    "prev_next_context": "with c as (select conv_id, turn, coalesce(text, '') as t, sum(length(coalesce(text, ''))) over (partition by conv_id order by turn) as u from conversations) select a.conv_id, a.turn, lag(t) over (partition by a.conv_id order by a.turn) as previous, cast(coalesce((select sum(length(b.t)) + count(*) - 1 from c b where b.conv_id = a.conv_id and b.turn > a.turn and b.u - length(b.t) - a.u < 80), 0) as bigint) as n_following from c a",
    "discovery_report": """
with r as (select cast(doc_id as varchar) as m, n_chars, case when lang <> 'es' then doc_id // 2 end as e, doc_id // 2 + case when n_chars % 7 = 0 then 1 else 0 end as u from documents)
select 'total' as section, cast(null as bigint) as episode, cast(null as varchar) as id, count(*) as n, cast(min(e) as varchar) as first, cast(max(e) as varchar) as last from r having count(*) > 0
union all select 'parsed', null, null, count(*), null, null from r where e is not null having count(*) > 0
union all select 'unparsed', null, m, count(*), null, null from r where e is null group by m
union all select 'duplicate', e, null, count(*), min(m), max(m) from r where e is not null group by e having count(*) > 1
union all select 'total-url', null, null, count(*), cast(min(u) as varchar), cast(max(u) as varchar) from r where u is not null having count(*) > 0
union all select 'duplicate-url', u, null, count(*), min(m), max(m) from r where u is not null group by u having count(*) > 1
union all select 'mismatch', e, m, count(*), null, null from r where e <> u group by e, m
union all select 'failed', e, m, count(*), null, null from r where n_chars < 20 group by e, m
union all select 'missing', i, null, 1, null, null from (select unnest(generate_series(min(e), max(e))) as i from r) where i not in (select e from r where e is not null)
union all select 'missing-url', i, null, 1, null, null from (select unnest(generate_series(min(u), max(u))) as i from r) where i not in (select u from r where u is not null)""",
    "transcript_capture": r"""
with s as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as i, text from conversations where text is not null),
p as (select *, i * 8.0::double as st, i * 8.0::double + 7.5 as en, length(text) as size, coalesce(sum(length(text) + 1) over (partition by conv_id order by i rows between unbounded preceding and 1 preceding), 0) as place from s),
t as (select conv_id, sum(length(text) + 1) as size from s group by conv_id),
q as (select conv_id, k as selection, cast(floor(size * k / 10.0) as bigint) as a, cast(floor(size * (k + 2) / 10.0) as bigint) as b from t, range(9) g(k)),
j as (select q.conv_id, selection, a, b, i, st, en, p.size, place, substr(text, cast(greatest(a - place, 0) + 1 as bigint), cast(greatest(least(b, place + p.size) - greatest(a, place), 0) as bigint)) as piece from q join p on q.conv_id = p.conv_id and a <= place + p.size and place <= b - 1 where b > a),
f as (select conv_id, selection, any_value(a) as a, any_value(b) as b, regexp_replace(string_agg(piece, chr(10) order by i), '^\s+|\s+$', '', 'g') as txt, count(*) as n_lines,
  arg_min(st, i) as s1, arg_min(en, i) as e1, arg_min(size, i) as z1, arg_min(place, i) as p1, arg_max(st, i) as s2, arg_max(en, i) as e2, arg_max(size, i) as z2, arg_max(place, i) as p2 from j group by conv_id, selection),
x as (select *, greatest(s1, s1 + (e1 - s1) * least(greatest(greatest(a - p1, 0) / greatest(z1, 1), 0), 1) - 0.25) as x1, least(e2, s2 + (e2 - s2) * least(greatest(least(b - p2, z2) / greatest(z2, 1), 0), 1) + 0.25) as x2 from f),
y as (select *, case when x2 - x1 < 0.25 then greatest(s1, x2 - 0.25) else x1 end as y1 from x),
z as (select *, case when x2 - x1 < 0.25 then least(e2, y1 + 0.25) else x2 end as y2 from y)
select conv_id, cast(selection as int) as selection, cast(length(txt) as int) as n_chars, cast(n_lines as int) as n_lines, cast(floor(y1 * 1000 + 0.5) as bigint) as start_ms, cast(floor(y2 * 1000 + 0.5) as bigint) as end_ms, y2 - y1 between 0.25 and 30 as valid, sha256(txt) as hash
from z where length(txt) > 0 and y2 > y1""",
    "monotonic_violations": f"select user_id, event_id, p as previous_end from (select user_id, event_id, {_SEC} as s, lag({_SEC} + value) over (partition by user_id order by ts, event_id) as p from events) where s < p - 0.01",
    "contiguity_check": "select conv_id, n, b as last_turn from (select conv_id, count(*) as n, count(distinct turn) as d, min(turn) as a, max(turn) as b from conversations group by conv_id) where not (n = d and a = 0 and b = n - 1)",
    "interpolated_gap": """with e as (select event_id, user_id, case when event_id % 5 = 0 then cast(event_id as double) end as k, row_number() over (partition by user_id order by event_id) as w from events),
f as (select *, last_value(k ignore nulls) over b as a, last_value(case when k is not null then w end ignore nulls) over b as wa, first_value(k ignore nulls) over f as z, first_value(case when k is not null then w end ignore nulls) over f as wz from e
window b as (partition by user_id order by event_id rows between unbounded preceding and current row), f as (partition by user_id order by event_id rows between current row and unbounded following))
select event_id, floor(coalesce(k, a + (z - a) * (cast(w - wa as double) / nullif(wz - wa, 0))) * 1000 + 0.5) / 1000 as filled from f""",
    "canonical_choice": "select o_custkey, o_orderkey, n as n_orders from (select *, count(*) over (partition by o_custkey) as n, row_number() over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey) as r from orders) where r = 1",
    "duplicate_groups": "select 'sha256:' || sha256(text) as hash, count(*) as n, min(doc_id) as first, max(doc_id) as last from documents where text is not null group by 1 having count(*) > 1",
    "missing_in_range": "select i as doc_id from (select unnest(generate_series(min(doc_id), max(doc_id))) as i from labels) where i not in (select doc_id from labels)",
    "manifest_status": _MANIFEST + "select * from mf",
    "status_counts": _MANIFEST + "select status, count(*) as n from mf group by status",
    "override_applied": "select 'v' || i * 37 as video_id, i + 5000 as episode, doc_id as original_episode from range(40) t(i) join documents on doc_id = i * 37",
    "override_stale": "select 'v' || i * 37 as video_id, i + 5000 as episode from range(40) t(i) where i * 37 not in (select doc_id from documents)",
    "latest_k": "select o_orderkey as episode, 'discovered' as status from orders where o_orderstatus <> 'F' order by 1 desc limit 10",
    "review_low_k": "select l_returnflag, position, cast(r as int) as rank from (select l_returnflag, l_orderkey * 10 + l_linenumber as position, row_number() over (partition by l_returnflag order by l_discount, l_orderkey * 10 + l_linenumber) as r from lineitem) where r <= 30",
    "summary_metrics": "select l_shipdate, count(*) as n_segments, count(*) filter (where coalesce(case when l_linenumber > 1 then l_discount * 10 end, 0) < 0.68) as n_low, count(*) filter (where l_linestatus = 'F') as n_inferred, floor(avg(case when l_linenumber > 1 then l_discount * 10 end) * 1000 + 0.5) / 1000 as average_confidence from lineitem group by l_shipdate",
    "build_report_merge": "select 'ep' || doc_id as episode_key, case when doc_id % 3 = 0 then 'failed' else 'discovered' end as status from documents where doc_id % 3 <> 1 and doc_id not in (select doc_id from labels) union all select 'ep' || doc_id, case when quality = 1 then 'processed' else 'low-confidence' end from labels",
    "incremental_skip": "select doc_id, 'sha256:' || sha256(text) as script_hash, doc_id % 2 = 0 and doc_id % 10 <> 0 as skip from documents where text is not null",
    "schema_violations": SEG + "last as (select 1) select 'end' as rule, count(*) as n from seg where segment_id % 97 = 0 union all select 'key', count(*) from seg where segment_id % 101 = 0",
    "publish_times": "select event_id, case when event_id % 3 > 0 then strftime(make_timestamp((event_id * 1000 + 1600000000) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') else '2024-02-29T00:00:00.000Z' end as published_at from events",
}
