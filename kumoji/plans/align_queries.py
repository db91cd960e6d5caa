"""Registered queries: similarity, anchors, units and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..operators import align, anchor, units


def _starts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple]:
    """Where benchmark items may start in documents, by their anchors, and the two tables."""
    items, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "documents"))
    sides = (items, "item_id", "text", docs, "doc_id", "text")
    return anchor.candidates(*sides), sides


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole items against windows of as many words at each candidate start."""
    found, sides = _starts(spark, sf_dir)
    return anchor.windows(found, *sides)


def dice_similarity(spark, sf_dir):
    """Multiset bigram Dice: for each bigram the smaller of its two counts."""
    rows = _scored(spark, sf_dir).where("length(a) > 1 and length(b) > 1")
    return rows.select("item_id", "doc_id", "start", (F.floor(sim.dice_similarity("a", "b") * 1000 + 0.5) / 1000).alias("dice"))


def lcs_similarity(spark, sf_dir):
    return _scored(spark, sf_dir).select("item_id", "doc_id", "start", sim.both_similarities("a", "b").alias("s")).select("item_id", "doc_id", "start", "s.lcs", "s.similarity")


def best_candidate(spark, sf_dir):
    """The most similar span of each document for each item that has an anchor in it."""
    found, sides = _starts(spark, sf_dir)
    return anchor.best_spans(found, *sides)


def anchor_candidates(spark, sf_dir):
    found, _ = _starts(spark, sf_dir)
    per_doc = found.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_starts"), F.min("doc_id").alias("first_doc"))


def combine_short_units(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return units.script_units(docs, "doc_id", "text", units.text.TERMINATORS + ".").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.max("block").alias("last_block"))


def align_benchmark(spark, sf_dir):
    """Conversations as scripts, their own text without its vowels' accents as captions of eight seconds a turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    script = units.script_units(rows.withColumn("key", F.col("conv_id") * 1000 + F.col("turn")), "key", "text", units.text.TERMINATORS + ".")
    script = script.select(F.floor(F.col("key") / 1000).alias("episode"), ((F.col("key") % 1000) * 1000 + F.col("unit_index")).cast("int").alias("unit_index"), (F.col("key") % 1000).cast("int").alias("block"), "text")
    cues = rows.select(F.col("conv_id").alias("episode"), (F.col("turn") * 8.0).alias("start"), (F.col("turn") * 8.0 + 7.5).alias("end"), F.translate("text", "éèêàù", "eeeau").alias("text"))
    found = align.aligned(script, cues)
    return found.groupBy("episode").agg(F.count("local_index").alias("n_segments"), F.count("issue").alias("n_issues"), F.avg("confidence").alias("confidence"))


QUERIES = {f.__name__: f for f in (dice_similarity, lcs_similarity, best_candidate, anchor_candidates, combine_short_units, align_benchmark)}

_STARTS = r"""with i as (select item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as a from benchmark),
n as (select item_id, unnest([0, (len(a) - least(3, len(a))) // 2, len(a) - least(3, len(a))]) as o, least(3, len(a)) as g, a from i where len(a) > 0),
h as (select distinct item_id, o, array_to_string(a[o + 1:o + g], ' ') as gram from n),
d as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents where text is not null),
t as (select doc_id, unnest(range(1, len(w) + 1)) as place, unnest(w) as x, unnest(w[2:]) as y, unnest(w[3:]) as z from d),
m as (select doc_id, place, x || ' ' || y || ' ' || z as gram from t where z is not null union all select doc_id, place, x || ' ' || y from t where y is not null union all select doc_id, place, x from t),
c as (select distinct item_id, doc_id, greatest(place - o, 1) as pos from m join h using (gram))"""
ORACLES = {
    "anchor_candidates": _STARTS + " select item_id, count(distinct doc_id) as n_docs, count(*) as n_starts, min(doc_id) as first_doc from c group by item_id",
    "dice_similarity": _STARTS + """,
p as (select item_id, doc_id, pos, array_to_string(i.a, ' ') as a, array_to_string(list_slice(w, pos, pos + len(i.a) - 1), ' ') as b from c join i using (item_id) join d using (doc_id)),
x as (select item_id, doc_id, pos, g, count(*) as n from (select item_id, doc_id, pos, unnest(list_transform(generate_series(1, length(a) - 1), lambda k: substr(a, k, 2))) as g from p) group by all),
y as (select item_id, doc_id, pos, g, count(*) as n from (select item_id, doc_id, pos, unnest(list_transform(generate_series(1, length(b) - 1), lambda k: substr(b, k, 2))) as g from p) group by all),
s as (select item_id, doc_id, pos, sum(least(x.n, y.n)) as same from x join y using (item_id, doc_id, pos, g) group by all)
select item_id, doc_id, pos as start, floor(2 * coalesce(same, 0)::double / (length(a) + length(b) - 2) * 1000 + 0.5) / 1000 as dice from p left join s using (item_id, doc_id, pos) where length(a) > 1 and length(b) > 1""",
}
