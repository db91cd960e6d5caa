"""Registered queries: segments, tokens, index, search, hydration and highlighting over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import corpus, deinflect, highlight, reports, requests, search
from ..sources import export, tables

QUERY, LOOSE_QUERY, STEM_QUERY = "The", "thing", "thingzzq"

LATIN_RULES, DEPTH = deinflect.romanised_rules(), 8

#: Sentences of documents, as the segment operator cuts them.
SEG = r"""
with sent as (select doc_id + 1 as episode, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?.\n]+[。！？!?.]*'), lambda s: trim(s)), lambda s: length(s) > 0 and not regexp_matches(s, '^[-=_ー―—–─ 　]+$|^★|^【[^】]*】$')) as s from documents where text is not null),
seg as (select episode, i - 1 as local_index, episode * 100000 + i - 1 as segment_id, s[i] as text from (select episode, s, unnest(generate_series(1, len(s))) as i from sent)),
tok as (select segment_id, episode, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) as surface from seg),
"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.segments(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Folders of stored indexes by session and data folder.
_STORED: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> corpus.Index:
    """The index of the documents: made once a session in the folder that executors share, then read by bucket and block."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _STORED or not tables.there(spark, _STORED[name]):
        segs = _segments(spark, sf_dir).withColumns({"start": (F.col("local_index") * 4.5).cast("double"), "video_id": F.concat(F.lit("v"), F.col("episode").cast("string"))})
        root = f"{tables.shared_root(spark)}/kumoji-index-{uuid.uuid4().hex}"
        _STORED[name] = tables.publish(spark, root, lambda folder: corpus.write_index(segs, folder))
    return corpus.Index(spark, _STORED[name])


def segments(spark, sf_dir):
    return _segments(spark, sf_dir)


def segment_id_roundtrip(spark, sf_dir):
    s = _segments(spark, sf_dir)
    return s.select("segment_id", ids.episode_of(F.col("segment_id")).alias("episode"), ids.index_of(F.col("segment_id")).alias("local_index"), ids.episode_key(F.col("episode")).alias("episode_key"))


def tokens_filtered(spark, sf_dir):
    return corpus.segment_tokens(_segments(spark, sf_dir)).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("lemma").alias("n_lemmas"))


def _listed(df: DataFrame) -> DataFrame:
    return df.withColumn("segment_ids", F.array_join(F.transform("segment_ids", lambda x: x.cast("string")), ","))


def postings_surface(spark, sf_dir):
    return _listed(corpus.postings(_segments(spark, sf_dir), "surface"))


def deinflect_terms(spark, sf_dir):
    """Every word of the documents, in lower case, back towards dictionary forms by the rules in Latin letters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z]+"), 0))).alias("word")).distinct()
    found = words.select("word", F.posexplode(deinflect.deinflections(F.col("word"), LATIN_RULES, DEPTH)).alias("rank", "d")).where("rank > 0")
    return found.select("word", F.col("d.term").alias("term"), F.array_join("d.reasons", " < ").alias("reasons"), F.col("rank").cast("bigint").alias("rank"))


def postings_lemma(spark, sf_dir):
    return _listed(corpus.postings(_segments(spark, sf_dir), "lemma"))


def bucket_histogram(spark, sf_dir):
    return corpus.bucket_histogram(_segments(spark, sf_dir))


def export_sizes(spark, sf_dir):
    """Lines and bytes of each of the 256 serving files of the surface index."""
    made = export.bucket_lines(corpus.postings(_segments(spark, sf_dir), "surface"))
    size = F.octet_length("lines").cast("bigint") + 1
    return made.groupBy("bucket").agg(F.sum(F.length("lines") - F.length(F.translate("lines", "\n", "")) + 1).cast("bigint").alias("n_lines"), F.sum(size).alias("n_bytes"))


def surface_to_lemmas(spark, sf_dir):
    return corpus.surface_lemmas(_segments(spark, sf_dir)).withColumn("lemmas", F.array_join("lemmas", ","))


def index_counts(spark, sf_dir):
    return corpus.index_counts(_segments(spark, sf_dir))


def search_exact(spark, sf_dir):
    return search.exact(stored_index(spark, sf_dir), QUERY).hits


def search_exact_page2(spark, sf_dir):
    return search.exact(stored_index(spark, sf_dir), QUERY, 25, 25).rows()


def search_auto(spark, sf_dir):
    return search.auto(stored_index(spark, sf_dir), QUERY).hits


def search_loose(spark, sf_dir):
    return search.loose(stored_index(spark, sf_dir), LOOSE_QUERY).hits


def search_prefix_stem(spark, sf_dir):
    return search.loose(stored_index(spark, sf_dir), STEM_QUERY).hits


def search_episode_range(spark, sf_dir):
    return search.within_episodes(search.exact(stored_index(spark, sf_dir), QUERY).hits, 300, 100)


def request_answers(spark, sf_dir):
    """The benchmark's items as requests: their first word, and an episode range in one of five forms by the item's number."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text is not null")
    n = F.col("n")
    low, high = (n * 7 % 400).cast("string"), (n * 13 % 900).cast("string")
    form = F.when(n % 5 == 0, F.concat(low, F.lit("-"), high)).when(n % 5 == 1, F.concat(high, F.lit("-"), low)).when(n % 5 == 2, F.concat(low, F.lit("-"))).when(n % 5 == 3, "")
    asked = items.withColumn("n", F.length("text")).select("item_id", F.concat(F.lit(" "), F.regexp_extract("text", r"[\p{L}\p{N}]+", 0), F.lit("\n")).alias("q"), F.when(n % 2 == 0, "exact").alias("mode"), F.concat(n.cast("string"), F.lit(".0")).alias("clip"), form.alias("episodes"))
    index = stored_index(spark, sf_dir)
    status = reports.corpus_status(index.segments()).first()
    asked = requests.cleaned(asked, F.lit(status.first_episode), F.lit(status.last_episode))
    found = requests.exact_answers(index, asked, "item_id", 5)
    out = asked.join(found, "item_id").select("item_id", "q", "mode", "clip", "episodes", "low", "high", "total", F.array_join(F.transform("segment_ids", lambda x: x.cast("string")), ",").alias("shown"))
    return out


def hydrate(spark, sf_dir):
    index = stored_index(spark, sf_dir)
    return search.hydrated(search.exact(index, QUERY).hits, index.segments().drop("segment_key"))


def highlight_exact(spark, sf_dir):
    s = _segments(spark, sf_dir).where(F.contains("text", F.lit("the")))
    return s.select("segment_id", highlight.bracketed(F.col("text"), highlight.exact_ranges(F.col("text"), "the")).alias("marked"))


def highlight_ranges_merged(spark, sf_dir):
    """Occurrences of two terms, widened by two characters, merged."""
    s = _segments(spark, sf_dir)
    found = F.concat(*(highlight.exact_ranges(F.col("text"), q) for q in ("the", "ea")))
    wide = F.transform(found, lambda r: F.struct(F.greatest(r["start"] - 2, F.lit(0)).alias("start"), F.least(r["end"] + 2, F.length("text")).alias("end")))
    rows = s.select("segment_id", F.explode(highlight.merged(wide)).alias("r"))
    return rows.select("segment_id", F.col("r.start").cast("bigint").alias("start"), F.col("r.end").cast("bigint").alias("end"))


def token_spans(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    spans = highlight.token_spans(F.col("text"), corpus.regex_tokenizer(F.col("text")))
    return rows.select("conv_id", "turn", F.size(spans).cast("bigint").alias("n_spans"), F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0)).cast("bigint").alias("last_end"))


QUERIES = {
    f.__name__: f
    for f in (
        segments, segment_id_roundtrip, tokens_filtered, postings_surface, postings_lemma, bucket_histogram, export_sizes, surface_to_lemmas, index_counts, deinflect_terms, search_exact, search_exact_page2,
        search_auto, search_loose, search_prefix_stem, search_episode_range, request_answers, hydrate, highlight_exact, highlight_ranges_merged, token_spans,
    )
}

_POSTINGS = SEG + """
k as (select distinct {key} as key, segment_id, episode from tok)
select left(sha256(key), 2) as bucket, key, cast(floor(episode / 512) as bigint) as block, count(*) as n, string_agg(cast(segment_id as varchar), ',' order by segment_id) as segment_ids
from k group by key, cast(floor(episode / 512) as bigint)
"""

_RULES = ", ".join(f"({k}, '{r.name}', '{r.ending}', '{r.base}', {deinflect.flags(r.of)}, {deinflect.flags(r.gives)})" for k, r in enumerate(LATIN_RULES))

ORACLES = {
    "deinflect_terms": f"""
with recursive rules(n, name, ending, base, o, g) as (values {_RULES}),
w as (select distinct unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) as word from documents),
d(word, term, state, reasons, path, level) as (select word, word, 0, '', '', 0 from w
  union all select word, substr(term, 1, length(term) - length(ending)) || base, g, case when reasons = '' then name else name || ' < ' || reasons end, path || lpad(cast(n as varchar), 4, '0'), level + 1
  from d join rules on suffix(term, ending) and (state = 0 or (state & o) <> 0) and length(term) - length(ending) + length(base) > 0 where level < {DEPTH}),
f as (select *, row_number() over (partition by word, term order by level, path) as k from d)
select word, term, reasons, rank from (select word, term, reasons, row_number() over (partition by word order by level, path) - 1 as rank from f where k = 1) where rank > 0
""",
    "export_sizes": SEG + """
k as (select surface, count(*) as n, sum(length(cast(segment_id as varchar))) as digits from (select distinct surface, segment_id from tok) group by surface),
b as (select left(sha256(surface), 2) as bucket, count(*) as keys, sum(n) as n, sum(strlen(surface)) as key_bytes, sum(digits) as digits from k group by 1),
names as (select format('{:02x}', i) as bucket from range(256) t(i))
select bucket, cast(case when keys is null then 1 else 2 + 2 * keys + n end as bigint) as n_lines, cast(case when keys is null then 3 else 2 + 2 + keys * (2 + 2 + 4 + 5) - 1 + key_bytes + digits + n * 6 - keys end as bigint) as n_bytes from names left join b using (bucket)
""",
    "segments": SEG + "last as (select 1) select segment_id, 'ep' || episode || '-s' || lpad(cast(local_index as varchar), 5, '0') as segment_key, episode, cast(local_index as int) as local_index, text from seg",
    "segment_id_roundtrip": SEG + "last as (select 1) select segment_id, segment_id // 100000 as episode, segment_id % 100000 as local_index, 'ep' || episode as episode_key from seg",
    "tokens_filtered": SEG + "last as (select 1) select segment_id, count(*) as n_tokens, count(distinct lower(surface)) as n_lemmas from tok group by segment_id",
    "postings_surface": _POSTINGS.replace("{key}", "surface"),
    "postings_lemma": _POSTINGS.replace("{key}", "lower(surface)"),
    "bucket_histogram": SEG + """
k as (select surface as key, count(distinct segment_id) as n from tok group by surface),
b as (select left(sha256(key), 2) as bucket, count(*) as n_keys, cast(sum(n) as bigint) as n_postings from k group by 1)
select lpad(lower(to_hex(i)), 2, '0') as bucket, coalesce(n_keys, 0) as n_keys, coalesce(n_postings, 0) as n_postings from range(256) t(i) left join b on b.bucket = lpad(lower(to_hex(i)), 2, '0')""",
    "surface_to_lemmas": SEG + "last as (select 1) select surface, lower(surface) as lemmas from tok group by surface",
    "index_counts": SEG + "last as (select 1) select (select count(distinct episode) from seg) as episodes, (select count(*) from seg) as segments, (select count(distinct lower(surface)) from tok) as lemmas, (select count(distinct surface) from tok) as surfaces",
    "search_exact": SEG + "last as (select 1) select distinct segment_id from tok where surface = 'The'",
    "search_exact_page2": SEG + "last as (select 1) select distinct segment_id from tok where surface = 'The' order by segment_id limit 25 offset 25",
    "search_auto": SEG + "last as (select 1) select distinct segment_id from tok where lower(surface) = 'the' and not exists (select 1 from tok where lower(surface) = 'The')",
    "search_loose": SEG + "last as (select 1) select distinct segment_id from tok where lower(surface) = 'thing'",
    "search_prefix_stem": SEG + """
p as (select surface, rank() over (order by length(surface) desc) as r from (select distinct surface from tok where starts_with('thingzzq', surface) and length(surface) > 1 and length(surface) < 8))
select distinct segment_id from tok where lower(surface) in (select lower(surface) from p where r = 1) or lower(surface) = 'thingzzq'""",
    "search_episode_range": SEG + "last as (select 1) select distinct segment_id from tok where surface = 'The' and episode between 100 and 300",
    "request_answers": SEG + r"""
bounds as (select min(episode) as lo, max(episode) as hi from seg),
i as (select item_id, length(text) as n, regexp_extract(text, '[\p{L}\p{N}]+') as q from benchmark where text is not null),
r as (select item_id, nullif(q, '') as q, case when n % 2 = 0 then 'exact' else 'loose' end as mode, n as clip, case when n % 5 < 2 then least(n * 7 % 400, n * 13 % 900) end as a, case when n % 5 < 2 then greatest(n * 7 % 400, n * 13 % 900) end as b from i),
c as (select item_id, q, mode, case when clip > 0 then clip end as clip, least(hi, greatest(lo, coalesce(a, lo))) as low, least(hi, greatest(lo, coalesce(b, hi))) as high, lo, hi from r, bounds),
h as (select distinct item_id, t.segment_id from c join tok t on t.surface = c.q and t.episode between low and high),
k as (select item_id, segment_id, row_number() over (partition by item_id order by segment_id) as rank from h),
s as (select item_id, count(*) as total, string_agg(cast(segment_id as varchar), ',' order by segment_id) filter (where rank <= 5) as shown from k group by item_id)
select item_id, q, mode, cast(clip as bigint) as clip, case when low <> lo or high <> hi then low || '-' || high end as episodes, low, high, coalesce(total, 0) as total, coalesce(shown, '') as shown from c left join s using (item_id)
""",
    "hydrate": SEG + """
h as (select distinct segment_id from tok where surface = 'The'),
t as (select segment_id, episode, cast(local_index as int) as local_index, text, cast(local_index * 4.5 as double) as start, 'v' || episode as video_id from h join seg using (segment_id))
select *, case when start >= 3600 then cast(floor(start / 3600) as bigint) || ':' || lpad(cast(cast(floor(start) as bigint) % 3600 // 60 as varchar), 2, '0') else cast(cast(floor(start) as bigint) // 60 as varchar) end || ':' || lpad(cast(cast(floor(start) as bigint) % 60 as varchar), 2, '0') as timestamp,
'https://www.youtube.com/watch?v=' || video_id || '&t=' || greatest(cast(floor(start - 1) as bigint), 0) || 's' as url from t""",
    "highlight_exact": SEG + "last as (select 1) select segment_id, replace(text, 'the', '[the]') as marked from seg where contains(text, 'the')",
    "highlight_ranges_merged": SEG + """
occ as (select segment_id, text, q, list_transform(generate_series(1, len(string_split(text, q)) - 1), lambda i: list_sum(list_transform(list_slice(string_split(text, q), 1, i), lambda x: length(x))) + (i - 1) * length(q)) as a from seg, (values ('the'), ('ea')) v(q) where contains(text, q)),
r as (select segment_id, greatest(s - 2, 0) as b, least(s + length(q) + 2, length(text)) as e from (select segment_id, text, q, unnest(a) as s from occ)),
m as (select *, case when b <= max(e) over (partition by segment_id order by b, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from r),
g as (select *, sum(new) over (partition by segment_id order by b, e rows unbounded preceding) as island from m)
select segment_id, cast(min(b) as bigint) as start, cast(max(e) as bigint) as "end" from g group by segment_id, island""",
    "token_spans": r"""
with t as (select conv_id, turn, text, regexp_extract_all(text, '[\p{L}\p{N}]+') as w from conversations where text is not null)
select conv_id, turn, cast(len(w) as bigint) as n_spans, cast(length(regexp_replace(text, '[^\p{L}\p{N}]+$', '')) as bigint) as last_end from t""",
}
