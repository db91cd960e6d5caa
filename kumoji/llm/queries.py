"""The registered queries of the llm operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cotrain, decontaminate, divergence, licenses, multiindex, quality_lines, ring, simhash, substring, toxicity, variants
from .common import table, tokenizer_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.shard(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


#: The contract's further conversation: its texts are made of what a format's marks are made of.
EXTRA = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    return chat.digests(rows.unionByName(extra))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.judged(table(spark, sf_dir, "documents"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotrain.scores(docs, cotrain.fit(docs, table(spark, sf_dir, "labels")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(table(spark, sf_dir, "embeddings"))


ALL = (op1_simhash, op2_ring_shards, op3_decontaminate, op4_chat_format, op5_toxicity, op6_license_scan, op7_line_rules, op8_substring, op9_bpe, op10_cotrained_quality, op11_source_divergence, op12_spelling_variants, op13_near_vectors)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}

#: SQL for what SQL can express; the others have brute-force tests in tests/llm.
ORACLES: dict[str, str] = {
    "op3_decontaminate": r"""
with item as (select coalesce(cast(item_id as varchar), 'null') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as s from (select item, w, least(10, len(w)) as k, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from item where len(w) > 0)),
doc as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
hit as (select r, i, d.k, item from (select r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as s from (select r, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from doc, (select distinct k from win) where len(w) >= k)) d join win using (k, s)),
cov as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(i, i + k - 1)) as p from hit) group by r),
its as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join cov using (r) left join its using (r)
""",
    "op4_chat_format": r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized as (select *, length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) + 14 as size from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(size) as bigint) as formatted_chars
from sized group by conv_id
""",
    "op8_substring": r"""
with doc as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) as h from (select r, doc_id, w, unnest(generate_series(1, len(w) - 49)) as i from doc where len(w) >= 50)),
dup as (select r, i from (select r, doc_id, i, min(doc_id) over (partition by h) as first from win) where doc_id > first),
gone as (select distinct r, p from (select r, unnest(generate_series(i, i + 49)) as p from dup)),
word as (select r, p, x from (select r, unnest(generate_series(1, len(w))) as p, unnest(w) as x from doc)),
kept as (select r, string_agg(x, ' ' order by p) as t, count(*) as n from word anti join gone using (r, p) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from doc left join kept using (r)
""",
    "op11_source_divergence": r"""
with doc as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
word as (select r, lang, source, unnest(w) as term from doc),
kept as (select lang, term from word group by lang, term having count(distinct r) >= 30),
cnt as (select lang, source, term, count(*) as n from word join kept using (lang, term) group by lang, source, term),
grp as (select lang, source, coalesce(sum(n), 0)::hugeint as total from (select distinct lang, source from doc) left join cnt using (lang, source) group by lang, source),
voc as (select lang, count(*)::hugeint as v from kept group by lang),
full_ as (select lang, source, term, coalesce(n, 0) as n, 1 + 1000000000::hugeint * (coalesce(n, 0) + 5) // (total + 5 * v) as p from grp join voc using (lang) join kept using (lang) left join cnt using (lang, source, term)),
lng as (select lang, sum(total) as total from grp group by lang),
q as (select lang, term, 1 + 1000000000::hugeint * (sum(n) + 5) // (any_value(total) + 5 * any_value(v)) as q from cnt join lng using (lang) join voc using (lang) group by lang, term),
pair as (select a.lang, a.source, b.source as item, coalesce(f, 0) as f from grp a join grp b on a.lang = b.lang and a.source <> b.source left join
  (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as f from full_ x join full_ y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by x.lang, x.source, y.source) s on a.lang = s.lang and a.source = s.source and b.source = s.item),
ranked as (select lang, source, 'pair' as part, item, f, row_number() over (partition by lang, source order by f desc, item) as rank from pair
  union all select * from (select lang, source, 'term', term, p - q, row_number() over (partition by lang, source order by p - q desc, term) as rank from full_ join q using (lang, term) where n > 0 and p > q) where rank <= 50)
select lang, source, part, item, cast(f as bigint) as value, cast(rank as int) as rank from ranked
""",
}
