"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Rows and virtual nodes have places on a ring of `cells` cells. A row goes to the next virtual node clockwise whose
shard has room, so a full shard's overflow continues clockwise. Rows are served in ring order, which lets counts
stand for rows: what a shard takes is a range of ranks within a cell. So only the counts of the cells (a fixed
number, whatever the input) are brought to the driver, the ring is filled there by counts, and the plan (at most
`cells` + `shards` ranges) is broadcast and joined to the rows' ranks. One shuffle of a few numbers per row; a cell
holds a cells-th of all rows, as places come from hashes of the keys.

By default capacities are exact: counts of shards differ by at most one (law "rows"). With load > 1 a shard's bound
is load times the mean, and fewer rows move when shards change.

Nulls and odd rows: a null key has a place of its own; a null text has no bytes; rows with the same key are placed
next to each other, in the order of their texts' checksums, and repeated rows take as many slots as they are; other
columns are not read.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

SEED = 17


def virtual_nodes(shards: int, each: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) in ring order."""
    nodes = sorted((xxh64_intdigest(f"{s}/{v}", SEED), s) for s in range(shards) for v in range(each))
    return [((place * cells) >> 64, s) for place, s in nodes]


def capacities(total: int, shards: int, load: float | None) -> list[int]:
    if load is None:
        return [total // shards + (s < total % shards) for s in range(shards)]
    if load < 1:
        raise ValueError("load is at least 1")
    return [math.ceil(load * total / shards)] * shards


def filled(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, from rank, to rank, shard, slot of the first) for all rows."""
    n, used, room = len(nodes), [0] * len(room), list(room)
    at: list[list[int]] = [[] for _ in room]
    for i, (_, s) in enumerate(nodes):
        at[s].append(i)
    ahead = list(range(n))  # ahead[i] == i: node i has room; else where to go on from. Nothing is sought once all are full

    def find(i: int) -> int:
        path = []
        while ahead[i] != i:
            path.append(i)
            i = ahead[i]
        for p in path:
            ahead[p] = i
        return i

    def shut(s: int) -> None:
        for i in at[s]:
            ahead[i] = (i + 1) % n

    for s, r in enumerate(room):
        if not r:
            shut(s)
    cells, out = [c for c, _ in nodes], []
    for cell in sorted(counts):
        left, rank = counts[cell], 0
        while left:
            s = nodes[find(bisect.bisect_left(cells, cell) % n)][1]
            take = min(left, room[s] - used[s])
            out.append((cell, rank, rank + take, s, used[s]))
            used[s] += take
            rank, left = rank + take, left - take
            if used[s] == room[s]:
                shut(s)
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", each: int = 128, cells: int = 8192, load: float | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slots of a shard run from 0 without gaps."""
    spark = docs.sparkSession
    place = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(SEED)), 64 - (cells - 1).bit_length()).cast("int")
    if cells & (cells - 1):
        raise ValueError("cells is a power of two")
    counts = {r["cell"]: r["n"] for r in docs.select(place.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = filled(counts, virtual_nodes(shards, each, cells), capacities(sum(counts.values()), shards, load))
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    for cell, *rest in plan:
        ranges.setdefault(cell, []).append(tuple(rest))
    kind = "cell int, ranges array<struct<low:bigint,high:bigint,shard:int,slot:bigint>>"
    of_cell = spark.createDataFrame(list(ranges.items()), kind)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text).alias("text_crc32"), place.alias("cell"))
    within = Window.partitionBy("cell").orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within).cast("bigint") - 1)
    joined = ranked.join(F.broadcast(of_cell), "cell")  # at most cells + shards ranges
    own = F.element_at(F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"])), 1)
    placed = joined.withColumn("own", own)
    return placed.select("doc_id", "size", "text_crc32", F.col("own.shard").alias("shard"), (F.col("own.slot") + F.col("rank") - F.col("own.low")).alias("slot"))
