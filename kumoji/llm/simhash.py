"""SimHash near-dedup by a binary-trie self-join.

A document's fingerprint has a bit set where over half of its shingles' 64-bit hashes do. Fingerprints within three
bits are linked, and documents of linked fingerprints form a component. The join works on distinct fingerprints, so
exact copies cost one row. It is dealt out by the trie's upper part: with the 64 bits in five blocks, two
fingerprints that differ in at most three bits agree on two whole blocks, so each of the ten block pairs is one
ordering of the bits whose trie starts with those two blocks, and the nodes at that depth are the tasks' groups.
Inside a group the trie is walked by pairs of nodes (see trie.py). A group beyond `max_group` fingerprints is dealt
out in pairs of PARTS parts, and again until all groups fit. For near-dedup at a given similarity see widehash.py.

Nulls and odd rows: a null or empty text has fingerprint zero and is linked like any other; a null doc_id gets the
component of its fingerprint but never names one; repeated rows come out as often as they went in; other columns,
whatever their names, are neither read nor returned. Ids are whole numbers or strings of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, arrow_map, as_text
from .trie import classes

SEED = 42
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PARTS = 8
#: Hashes whose bits are counted at once.
SLICE = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, width: int = 3) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    n = len(words) - width + 1
    if n <= 1:
        return xxh64_intdigest(b" ".join(words), SEED)
    counts = np.zeros(64, np.int64)
    join = b" ".join
    for start in range(0, n, SLICE):
        part = words[start : start + SLICE + width - 1]
        grams = zip(*(part[k:] for k in range(width)), strict=False)
        hashes = np.fromiter((xxh64_intdigest(join(g), SEED) for g in grams), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_text(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [_signed(fingerprint(t.as_py(), width)) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return arrow_map(rows, run, "doc_id bigint, fp bigint")


def _joined(rows: DataFrame, budget: int, max_group: int) -> DataFrame:
    """rows (g binary, fp): links (u < v, g null) that span each group's classes, and the rows of groups too large."""

    def solve(fps: np.ndarray, groups: np.ndarray) -> pa.RecordBatch | None:
        labels = classes(fps, groups, budget)
        member = np.flatnonzero(labels != np.arange(len(fps)))
        if len(member):
            return out(fps[labels[member]].view(np.int64), fps[member].view(np.int64), [None] * len(member))

    def out(u, v, g) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(g, pa.binary())], ["u", "v", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # fingerprints of whole groups, with their sizes
        sizes: list[int] = []
        group: list[np.ndarray] = []
        name, size, hot = None, 0, False

        def flush():
            if sizes:
                ids = np.repeat(np.arange(len(sizes)), sizes)
                done = solve(np.concatenate(held), ids)
                held.clear(), sizes.clear()
                return done

        def close():
            nonlocal group, size, hot
            if size > 1 and not hot:
                fps = np.unique(np.concatenate(group))
                held.append(fps), sizes.append(len(fps))
            group, size, hot = [], 0, False
            if sum(sizes) > 1 << 18:
                return flush()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = batch.column("g").dictionary_encode(), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            codes = keys.indices.to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes)]
            names = keys.dictionary.to_pylist()
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if names[codes[a]] != name:
                    if (done := close()) is not None:
                        yield done
                    name = names[codes[a]]
                group.append(fps[a:b])
                size += b - a
                if size > max_group:  # passed on as it comes, never held whole
                    hot = True
                    fp = np.concatenate(group)
                    yield out(fp.view(np.int64), np.zeros(len(fp), np.int64), [name] * len(fp))
                    group = []
        if (done := close()) is not None:
            yield done
        if (done := flush()) is not None:
            yield done

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u bigint, v bigint, g binary")


def _resplit(rows: DataFrame, round_: int) -> DataFrame:
    """Rows (g, fp) of large groups, dealt out in pairs of PARTS parts: each two rows of a group meet in one of them."""
    block = F.pmod(F.xxhash64("fp", F.lit(round_)), F.lit(PARTS))
    pairs = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    name = F.concat_ws(",", F.hex("g"), F.least("block", "other"), F.greatest("block", "other"), F.lit(round_))
    return pairs.select(F.unhex(F.md5(F.encode(name, "utf-8"))).alias("g"), "fp")


def links(distinct: DataFrame, budget: int = 3, max_group: int = 1 << 17, scratch: Scratch | None = None) -> DataFrame:
    """(u, v): pairs of fingerprints within `budget` bits (at most 3) that connect all that are so linked. distinct has fp, without repeats."""
    if not 0 < budget <= 3:
        raise ValueError("the five blocks guarantee at most three differing bits")
    spark = distinct.sparkSession
    keys = []
    for k, pair in enumerate(combinations(BLOCKS, 2)):
        mask = sum(((1 << width) - 1) << at for at, width in pair)
        keys.append(F.concat(F.lit(bytes([k])), F.unhex(F.lpad(F.hex(F.col("fp").bitwiseAND(F.lit(_signed(mask)))), 16, "0"))))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("g"))
    scratch, found, round_ = scratch or Scratch(spark, "simhash"), [], 0
    while True:
        done = scratch.keep(_joined(rows, budget, max_group))
        found.append(done.where(F.col("g").isNull()).select("u", "v"))
        hot = done.where(F.col("g").isNotNull()).select("g", F.col("u").alias("fp"))
        if not hot.take(1):
            break
        rows, round_ = _resplit(hot, round_), round_ + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.distinct()


def connected(edges: DataFrame, spark: SparkSession, max_rounds: int = 60) -> DataFrame:
    """(node, root): each node of edges (u, v) with its component's smallest node, by alternating large and small stars.

    A round only sends each node's smallest neighbour to its other neighbours; the minimum is pre-aggregated, so a
    node with very many links needs no task of its own. Joins are merges: a broadcast of each round's neighbours would be
    one more job and pass through the driver. It ends when all edges are stars: a node has one edge up, or is a root.
    """
    scratch, last = Scratch(spark, "connected"), None
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        out = both.join(least.hint("merge"), "u")
        if large:
            out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    for _ in range(max_rounds):
        edges, path = scratch.write(star(star(edges, True), False))
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionAll(edges.select("v", F.lit(0)))
        loose = ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 or n = 1 and least = 0")
        settled = not loose.agg(F.count(F.lit(1))).first()[0]
        if last:
            scratch.drop(last)
        if settled:
            break
        last = path
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3, max_group: int = 1 << 17) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    own = scratch.keep(fingerprints(docs, id_col, text_col, width))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected(links(distinct.select("fp"), budget, max_group, scratch), spark)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
