"""Near-dedup by wide SimHash fingerprints and binary tries, with every link verified on the texts' word shingles.

Two sets of word shingles with Jaccard similarity s have vectors at an angle of acos(2s / (1 + s)), and each bit of a
SimHash differs with that angle's share of a half turn. Candidates are documents whose fingerprints of BITS bits differ
in no more bits than a pair of just this similarity does with a probability of FOUND. At 0.8 that is some 18 % of the
bits, and within so large a budget the upper levels of a single trie prune nothing. So there is a forest: each text has
`trees` keys, of ROWS minima of its shingles each, so many that a pair at the limit misses all tries with a
probability of MISS at most; texts with the same key are one trie, which is joined with itself as in trie.py: node
pairs are walked together, differing bits add up, and a pair is dropped beyond the budget or when it can link nothing
new. Keys that one node alone has leave first, so fingerprints travel only for tries that join something.

A first walk gives pairs that span each trie's classes, nearest first. They are verified: a pair is linked if the exact
similarity of its shingles is at least the limit. Each node's nearest pair goes first, then what still joins different
components. Where a class of the fingerprints has fallen apart, its nodes are walked again, and every pair of different
components within the budget is verified, so no link among the candidates is lost to one that failed. Of the tries
that hold such a pair the first one sends it. Pairs of one
verified component are never made. Shingles are read again for the texts in question only, which a Bloom filter of at
most 64 MB finds in the table; the same filter finds the rows that go, so that no other text is shuffled.

Texts with equal fingerprints and keys are one node, so exact copies cost one row. A trie of more than `max_group`
nodes is dealt out in pairs of BLOCKS blocks, and again until all fit; every pair of nodes meets in one of them. Each
round of this multiplies such a trie's rows by BLOCKS and quarters it.

Words split at the six ASCII blanks, A-Z in lower case; a text of fewer words than a shingle is one shingle. Shingles
are compared by 64-bit hashes.

Nulls and odd rows: null texts and texts without words are copies of each other; of a group the row with the smallest
id stays (a row without an id only if none has one; of several texts with that id the one of the smallest hash), once
if it is repeated, whichever of the repeated ones; other columns, whatever their names, are kept. Ids are whole
numbers or strings of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import Scratch, as_text, free_name, in_slices, maybe_in, maybe_in_column, tidy
from .simhash import SEED, connected
from .substring import window_hashes, word_hashes
from .trie import classes

BITS = 512
ROWS, MISS, FOUND = 4, 1e-4, 0.95
#: The normal quantile of FOUND.
Z = 1.645
BLOCKS = 8
#: Shingles that are hashed at once, and trie nodes walked at once.
SLICE, FLUSH = 1 << 12, 1 << 15
WORDS = BITS // 64


def budget_for(similarity: float) -> int:
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(BITS * p + Z * math.sqrt(BITS * p * (1 - p)))


def trees_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-(similarity**ROWS)))


def shingles(text: str, width: int) -> np.ndarray:
    """Hashes of the text's distinct shingles."""
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower().split())
    return np.unique(window_hashes(words, min(width, len(words)))) if len(words) else words


def fingerprint(s: np.ndarray) -> bytes:
    """BITS bits, each set where over half of the shingles' hashes have it."""
    if not len(s):
        return bytes(BITS // 8)
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(s), SLICE):
        h = s[a : a + SLICE, None] * factors
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        counts += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(s)).tobytes()


def keys(s: np.ndarray, trees: int) -> list[int]:
    """A key for each trie: the least values of the set under ROWS functions."""
    if not len(s):
        return []
    factor = np.random.default_rng(SEED + 1).integers(0, 1 << 32, (2, trees * ROWS), dtype=np.uint32) | np.uint32(1)
    low, high = s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(trees * ROWS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(s), SLICE):
        x = (low[a : a + SLICE, None] ^ factor[0]) * factor[1] + high[a : a + SLICE, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(axis=0), out=least)
    raw = least.tobytes()
    return [xxh64_intdigest(raw[k * ROWS * 4 : (k + 1) * ROWS * 4], k) for k in range(trees)]


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, trees: int) -> DataFrame:
    """(doc_id, version, s1, s2, fp, keys) of each row; version is Spark's xxhash64 of the text, s1 and s2 name fp and keys."""
    text = as_text(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text", 4 << 20):
                found = [shingles(t.as_py(), width) for t in part.column("text")]
                own = [np.array(keys(s, trees), np.uint64).view(np.int64) for s in found]
                fps = [fingerprint(s) for s in found]
                names = np.frombuffer(b"".join(xxh3_128_digest(f + k.tobytes()) for f, k in zip(fps, own, strict=True)), np.int64).reshape(-1, 2)
                columns = [part.column("doc_id"), part.column("version"), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(fps, pa.binary()), pa.array(own, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "s1", "s2", "fp", "keys"])

    return rows.mapInArrow(run, "doc_id bigint, version bigint, s1 bigint, s2 bigint, fp binary, keys array<bigint>")


def _matrix(fps: pa.Array) -> np.ndarray:
    """Binary values of BITS bits as rows of unsigned words."""
    return np.frombuffer(b"".join(fps.to_pylist()), ">u8").astype(np.uint64).reshape(-1, WORDS)


def _earlier(own: np.ndarray, keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs' nodes meet in a trie before this one, whose first key is `own`; keys that are 0 tell of no trie."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), FLUSH):
        left, right = keys[i[a : a + FLUSH]], keys[j[a : a + FLUSH]]
        same = (left == right) & (left != 0)
        first = left[np.arange(len(left)), same.argmax(axis=1)]
        out[a : a + FLUSH] = same.any(axis=1) & (first != own[i[a : a + FLUSH]])
    return out


def _trie_links(key: np.ndarray, node: np.ndarray, fp: np.ndarray, label: np.ndarray, own: np.ndarray, keys: np.ndarray, budget: int, every: bool) -> tuple[np.ndarray, ...]:
    """Near pairs (u, v, bits) of each trie, a run of equal keys: such that span its classes, or every one of different
    labels, but for those that an earlier trie has as well."""
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    order = np.lexsort((node, *(fp[:, w] for w in range(WORDS - 1, -1, -1)), group))
    group, node, fp, label, own, keys = (x[order] for x in (group, node, fp, label, own, keys))
    fresh = np.r_[True, (group[1:] != group[:-1]) | (fp[1:] != fp[:-1]).any(axis=1)]
    at = np.flatnonzero(fresh)
    first = at[np.cumsum(fresh) - 1]
    twin = np.flatnonzero((node != node[first]) & (~every | (label != label[first])))
    found = [(first[twin], twin, np.zeros(len(twin), np.int16))]
    near: list[tuple[np.ndarray, ...]] = []
    if every:
        within = np.unique(np.stack([group[at], label[at]]), axis=1, return_inverse=True)[1]  # labels within a trie
        classes(fp[at], group[at], budget, (budget,), near, within)
    else:
        classes(fp[at], group[at], budget, tuple(budget * k // 4 for k in (1, 2, 3, 4)), near)
    found += [(at[i], at[j], bits) for i, j, bits in near]
    i, j, bits = (np.concatenate(x) for x in zip(*found, strict=True))
    if every:
        new = ~_earlier(own, keys, i, j)
        i, j, bits = i[new], j[new], bits[new]
    return np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), bits


def _shared(rows: DataFrame) -> DataFrame:
    """rows (k, node) of the keys that two nodes have at least."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, None  # the last key, and its first row as long as it is alone

        for batch in batches:
            if not batch.num_rows:
                continue
            k, node = batch.column("k").to_numpy(), batch.column("node").to_numpy()
            same = np.r_[k[0] == last, k[1:] == k[:-1]]  # as the row before
            if same[0] and waiting is not None:
                yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([waiting], pa.int64())], ["k", "node"])
            keep = same | np.r_[same[1:], False]
            if keep.any():
                yield batch.filter(pa.array(keep))
            last, waiting = int(k[-1]), None if keep[-1] else int(node[-1])

    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(run, "k bigint, node bigint")


WALKED = "u bigint, v bigint, bits int, k bigint, fp binary, own bigint, keys array<bigint>"


def _walked(rows: DataFrame, budget: int, max_group: int, round_: int, every: bool) -> DataFrame:
    """rows (k, node, fp, label, own, keys): near pairs (u, v, bits), and the rows of tries too large under new keys (u, v
    the label, k, fp, own, keys). own is the trie's first key; keys, of each node as many, are read with every only."""

    def out(u, v, bits=None, k=None, fp=None, own=None, keys=None) -> pa.RecordBatch:
        n = len(u)
        kinds = (bits, pa.int32()), (k, pa.int64()), (fp, pa.binary()), (own, pa.int64()), (keys, pa.list_(pa.int64()))
        columns = [pa.array(u, pa.int64()), pa.array(v, pa.int64())] + [pa.array(x if x is not None else [None] * n, kind) for x, kind in kinds]
        return pa.RecordBatch.from_arrays(columns, ["u", "v", "bits", "k", "fp", "own", "keys"])

    def dealt(name: int, node: np.ndarray, fp: np.ndarray, label: np.ndarray, own: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        raw = [row.astype(">u8").tobytes() for row in fp]
        block = np.array([xxh64_intdigest(int(n).to_bytes(8, "little", signed=True), round_) % BLOCKS for n in node])
        for other in range(BLOCKS):
            low, high = np.minimum(block, other), np.maximum(block, other)
            k = [xxh64_intdigest(b"%d %d %d" % (name, a, b), round_) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            yield out(node, label, None, np.array(k, np.uint64).view(np.int64), raw, own, list(keys))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        large = None  # the key of the trie that is being dealt out

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal large, held
            key, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            if large is not None:
                n = np.searchsorted(key, large, "right") if key[0] == large else 0
                if n:
                    yield from dealt(large, *(x[:n] for x in rest))
                    key, *rest = (x[n:] for x in (key, *rest))
            if len(key):
                cut = len(key) if last else np.searchsorted(key, key[-1])
                if cut:
                    u, v, bits = _trie_links(key[:cut], *(x[:cut] for x in rest), budget, every)
                    if len(u):
                        yield out(u, v, bits)
                    key, *rest = (x[cut:] for x in (key, *rest))
            if len(key) > max_group:
                large = int(key[-1])
                yield from dealt(large, *rest)
                key, *rest = (x[:0] for x in (key, *rest))
            held = [(key, *rest)] if len(key) else []

        for batch in batches:
            if batch.num_rows:
                keys = batch.column("keys").flatten().to_numpy().reshape(batch.num_rows, -1)
                held.append((batch.column("k").to_numpy(), batch.column("node").to_numpy(), _matrix(batch.column("fp")), batch.column("label").to_numpy(), batch.column("own").to_numpy(), keys))
                if sum(len(h[0]) for h in held) > FLUSH:
                    yield from done(False)
        if held:
            yield from done(True)

    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(run, WALKED)


def near_pairs(shared: DataFrame, nodes: DataFrame, similarity: float, scratch: Scratch, max_group: int = 1 << 16, every: bool = False) -> DataFrame:
    """(u, v, bits): near pairs of nodes (node, fp, label, keys) in the tries of shared (k, node); see _trie_links."""
    rows, found, round_ = shared.join(nodes.hint("merge"), "node").select("k", "node", "fp", "label", F.col("k").alias("own"), "keys"), [], 0
    while True:
        done = scratch.keep(_walked(rows, budget_for(similarity), max_group, round_, every))
        found.append(done.where(F.col("k").isNull()).select("u", "v", "bits"))
        large = done.where(F.col("k").isNotNull())
        if not large.take(1):
            break
        rows, round_ = large.select("k", F.col("u").alias("node"), "fp", F.col("v").alias("label"), "own", "keys"), round_ + 1
    return reduce(DataFrame.unionAll, found).groupBy("u", "v").agg(F.min("bits").alias("bits"))


def shingled(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, s): the hashes of the shingles of wanted nodes (node, least), from the row that `least` names."""
    names = wanted.select("node", F.col("least.doc_id").alias("doc_id"), F.col("least.version").alias("version"))
    text = as_text(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    name = F.xxhash64("doc_id", "version")
    sent = maybe_in(names.select(name), names.count())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                batch = batch.filter(pa.array(sent.value.test(batch.column("k").to_numpy())))
            for part in in_slices(batch, "text", 4 << 20):
                own = [shingles(t.as_py(), width).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "version", "s"])

    # Tested within the same function: two Python steps in a stage would be two workers for each task.
    found = rows.withColumn("k", name).mapInArrow(run, "doc_id bigint, version bigint, s array<bigint>")
    both = names.join(found, names["doc_id"].eqNullSafe(found["doc_id"]) & (names["version"] == found["version"]))
    return both.select("node", "s").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v, same): whether the pairs' sets are at least so similar."""
    left, right = sets.select(F.col("node").alias("u"), F.col("s").alias("a")), sets.select(F.col("node").alias("v"), F.col("s").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    enough = both >= similarity * (F.size("a") + F.size("b") - both)
    return pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").select("u", "v", enough.alias("same"))


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes have different roots; a node without one is its own."""
    out = pairs
    for c in ("u", "v"):
        out = out.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")).hint("merge"), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    return out.where("u_root <> v_root").select(pairs.columns)


def joined(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, scratch: Scratch, max_group: int) -> DataFrame:
    """(node, root) of the nodes that are linked with others. nodes has node, least, fp and keys."""
    spark = docs.sparkSession
    shared = scratch.keep(_shared(nodes.select(F.explode("keys").alias("k"), "node")))
    bare = nodes.select("node", "fp", F.col("node").alias("label"), F.array().cast("array<bigint>").alias("keys"))
    spanning = scratch.keep(near_pairs(shared, bare, similarity, scratch, max_group))
    if not spanning.take(1):
        return spark.createDataFrame([], "node bigint, root bigint")
    ends = spanning.select(F.explode(F.array("u", "v")).alias("node"), "u", "v", "bits")
    inside = ends.select("node").distinct()
    sets = scratch.keep(shingled(docs, nodes.select("node", "least").join(inside, "node", "left_semi"), id_col, text_col, width))
    nearest = ends.groupBy("node").agg(F.min(F.struct("bits", "u", "v")).alias("p")).select("p.u", "p.v").distinct()
    first = scratch.keep(verified(nearest, sets, similarity))
    roots = connected(first.where("same").select("u", "v"), spark)
    rest = _across(spanning.select("u", "v").join(nearest, ["u", "v"], "left_anti"), roots)
    second = scratch.keep(verified(rest, sets, similarity))
    tried = first.unionAll(second)
    linked = lambda more, roots: more.where("same").select("u", "v").unionAll(roots.select("node", "root"))
    roots = connected(linked(second, roots), spark)
    # Classes of the fingerprints that have fallen apart: those with a failed pair that joins different components.
    torn = connected(spanning.select("u", "v"), spark).withColumnRenamed("root", "class")
    torn = torn.unionAll(torn.select(F.col("class").alias("node"), "class").distinct())  # connected() does not list the roots
    failed = _across(tried.where("not same").select("u", "v"), roots)
    bad = torn.join(failed.select(F.col("u").alias("node")).distinct(), "node", "left_semi").select("class").distinct()
    again = torn.join(bad, "class", "left_semi").select("node")
    labelled = nodes.select("node", "fp", "keys").join(again, "node", "left_semi").join(roots, "node", "left").select("node", "fp", F.coalesce("root", "node").alias("label"), "keys")
    # A trie walks one of several nodes of one fingerprint only, so of these no trie may leave a pair to an earlier one.
    twins = labelled.groupBy("fp").agg(F.count(F.lit(1)).alias("twins")).where("twins > 1")
    alone = F.col("twins").isNull()
    labelled = labelled.join(twins, "fp", "left").withColumn("keys", F.transform("keys", lambda k: F.when(alone, k).otherwise(F.lit(0)))).drop("twins")
    third = near_pairs(shared.join(again, "node", "left_semi"), labelled, similarity, scratch, max_group, every=True)
    third = scratch.keep(verified(third.select("u", "v").join(tried.select("u", "v"), ["u", "v"], "left_anti"), sets, similarity))
    return connected(linked(third, roots), spark)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, scratch: Scratch | None = None, max_group: int = 1 << 16) -> DataFrame:
    """(doc_id, version, least) of each row; least is the (no_id, doc_id, version) of the row that stays of its group."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "widehash")
    own = scratch.keep(sketches(docs, id_col, text_col, width, trees_for(similarity)))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")
    # Written, so that a node's number stays what it is if a task runs again; from then on only the narrow columns move.
    nodes = own.groupBy("s1", "s2").agg(F.min(row).alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()))
    roots = joined(nodes, docs, id_col, text_col, width, similarity, scratch, max_group)
    rooted = nodes.select("s1", "s2", "least", "node").join(roots, "node", "left").select("s1", "s2", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    of = rooted.drop("least").join(least, "root").select("s1", "s2", "least")
    return own.select("doc_id", "version", "s1", "s2").join(of, ["s1", "s2"]).select("doc_id", "version", "least")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the near copies: of each group the row with the smallest id stays, once."""
    spark = docs.sparkSession
    scratch, kept = Scratch(spark, "widehash"), Scratch(spark, "widehash-gone")
    found = components(docs, id_col, text_col, width, similarity, scratch)
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("version") == F.col("least.version"))
    # Of rows with one id and text: do they go, or are there several to choose from?
    odd = found.groupBy("doc_id", "version").agg(F.min(stays).alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1")
    g_id, g_version, g_stays = (free_name(docs, f"gone_{c}") for c in ("id", "version", "stays"))
    odd = kept.keep(odd.select(F.col("doc_id").alias(g_id), F.col("version").alias(g_version), F.col("stays").alias(g_stays)))
    scratch.drop(scratch.root)
    named = docs.withColumns({g_id: F.col(id_col).cast("bigint"), g_version: F.xxhash64(as_text(text_col))})
    name = F.xxhash64(g_id, g_version)
    test = maybe_in_column(maybe_in(odd.select(name), odd.count()))
    asked = named.where(test(name)).alias("d").join(odd.alias("o"), F.col(f"d.{g_id}").eqNullSafe(F.col(f"o.{g_id}")) & (F.col(f"d.{g_version}") == F.col(f"o.{g_version}")), "left")
    asked = asked.where(F.coalesce(F.col(f"o.{g_stays}"), F.lit(True))).select("d.*").dropDuplicates([g_id, g_version])
    return named.where(~test(name)).unionByName(asked).drop(g_id, g_version)
