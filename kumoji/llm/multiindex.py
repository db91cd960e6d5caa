"""Near-duplicate vectors by an inverted multi-index: links of pairs with a cosine of `cosine` or more, and components.

Each half of the unit vectors has its own codebook (k-means in numpy on a bounded sample), and the products of their
cells are the cells of a grid, where each vector has its home. A vector searches the grid by a multi-sequence
traversal: the cells of either half are sorted by how far the vector is from their border with its own cell, and pairs
of cells are visited in the order of the sum of both squares. A vector within the linking radius can't be in a cell
beyond twice (1 - cosine); the traversal stops at a lower sum, at which `recall` of the pairs are found that are just at
the limit: the sum is learned from the sample's vectors with random ones put at this cosine from them. Recall 1 uses the
bound itself. A cell's task verifies: it multiplies what searches with what lives there, in double precision.

A pair counts if either vector visits the other's cell. It is credited where it is found, and the one that lives
there is credited as well unless it visits the searcher's cell itself, so no pair is sent anywhere. Links leave a
task as a spanning forest. Equal vectors are one node with a weight. A cell of more than `members` nodes is split into
blocks, and each of its searchers visits them all; block counts are broadcast, for 2^20 cells at most.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do vectors of
different lengths with each other (lengths other than the commonest use its codebooks, cut or filled with zeros).
Repeated rows are linked. A null id never names a component. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Scratch
from .simhash import connected
from .trie import merged

SEED = 42
#: Vectors of the sample at most, and bytes of it.
SAMPLE, SAMPLE_BYTES = 1 << 15, 32 << 20
#: Vectors of a cell on average, as long as the codebooks have fewer than MOST entries.
CELL, MOST = 64, 1024
#: Nodes of a block of a cell, and searching vectors that are multiplied with it at once.
MEMBERS, ASKING = 4096, 512
ITERATIONS, PLANTED = 10, 1 << 14


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows from a codebook's entries."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1), 0)


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most k centres of the rows, by Lloyd's iterations; an empty cell keeps its centre."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    book = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(ITERATIONS):
        own = np.concatenate([distances(x[a : a + 4096], book).argmin(axis=1) for a in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        cells, starts = np.unique(own[order], return_index=True)
        book[cells] = np.add.reduceat(x[order], starts) / np.diff(np.r_[starts, len(x)])[:, None]
    return book


class Grid:
    """Two codebooks and the sum up to which a traversal goes on."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], limit: float):
        self.books, self.limit = books, limit
        self.gaps = tuple(np.sqrt(distances(b, b)) for b in books)
        self._fitted: dict[int, tuple] = {}

    @property
    def size(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def of(self, size: int) -> tuple:
        """The codebooks and the gaps between their entries for vectors of this length."""
        if size == self.size:
            return self.books, self.gaps
        if size not in self._fitted:
            self._fitted.clear()
            fit = lambda b, n: np.pad(b, ((0, 0), (0, max(0, n - b.shape[1]))))[:, :n]
            books = fit(self.books[0], size // 2), fit(self.books[1], size - size // 2)
            self._fitted[size] = books, tuple(np.sqrt(distances(b, b)) for b in books)
        return self._fitted[size]

    def borders(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For unit vectors of one length: home cells, and the squared distances from the borders of each half's cells."""
        books, gaps = self.of(x.shape[1])
        home, out = [], []
        for half, book, gap in zip((x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]), books, gaps, strict=True):
            d = distances(half, book)
            own = d.argmin(axis=1)
            between = gap[own]
            border = (d - d[np.arange(len(x)), own][:, None]) / (2 * np.where(between > 0, between, 1))
            home.append(own), out.append(border * border)
        return home[0] * len(books[1]) + home[1], out[0], out[1]

    def visits(self, first: np.ndarray, second: np.ndarray) -> list[int]:
        """Cells in the order of the sum of both halves' squares, up to the limit: a multi-sequence traversal."""
        a, b = (np.flatnonzero(s <= self.limit) for s in (first, second))
        a, b = a[np.argsort(first[a], kind="stable")], b[np.argsort(second[b], kind="stable")]
        x, y = first[a].tolist(), second[b].tolist()
        heap, out = [(x[0] + y[0], 0, 0)], []
        while heap:
            total, i, j = heapq.heappop(heap)
            if total > self.limit:
                break
            out.append(int(a[i]) * len(self.books[1]) + int(b[j]))
            if j + 1 < len(y):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(x):  # each pair is reached once: along its row, rows along the first column
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        return out


def fit(sample: np.ndarray, k: int, cosine: float, recall: float) -> Grid:
    """The grid of a sample of vectors of one length."""
    x = unit(sample)
    m = x.shape[1] // 2
    grid = Grid((codebook(x[:, :m], k, SEED), codebook(x[:, m:], k, SEED + 1)), 2 * (1 - cosine) + 1e-9)
    if recall < 1:
        rng = np.random.default_rng(SEED)
        near = x[rng.integers(0, len(x), PLANTED)]
        z = rng.standard_normal(near.shape)
        z -= (z * near).sum(axis=1, keepdims=True) * near
        y = cosine * near + math.sqrt(1 - cosine**2) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
        (home, *own), (other, *its) = grid.borders(near), grid.borders(y)
        at, width = np.arange(len(near)), len(grid.books[1])
        sums = np.sort(np.minimum(own[0][at, other // width] + own[1][at, other % width], its[0][at, home // width] + its[1][at, home % width]))
        grid.limit = min(grid.limit, float(sums[math.ceil(recall * len(sums)) - 1]) + 1e-9)
    return grid


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles, times a power of two that brings the largest component near one: exact, and no square overflows."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _read(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, np.dtype]:
    """(vec_id, s1, s2, size, raw): raw is the vector's bytes, or null if it links with nothing; s1 and s2 name it."""
    kind = dict(vectors.dtypes)[vector_col]
    dtype = np.dtype(np.float32 if kind == "array<float>" else np.float64)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<float>" if dtype == np.float32 else "array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, raw = batch.column("v"), []
            offsets, present = column.offsets.to_pylist(), column.is_valid().to_pylist()
            values = column.values.to_numpy(zero_copy_only=False).astype(dtype, copy=False) + dtype.type(0)  # -0 becomes 0, null NaN
            for a, b, there in zip(offsets[:-1], offsets[1:], present, strict=True):
                v = values[a:b]
                raw.append(v.tobytes() if there and v.any() and np.isfinite(v).all() else None)
            names = np.frombuffer(b"".join(xxh3_128_digest(r or b"") for r in raw), np.int64).reshape(-1, 2)
            columns = [batch.column("vec_id"), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array([r and len(r) // dtype.itemsize for r in raw], pa.int32()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "s1", "s2", "size", "raw"])

    return rows.mapInArrow(run, "vec_id bigint, s1 bigint, s2 bigint, size int, raw binary"), dtype


def _runs(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[tuple, int, int]]:
    """Runs of equal keys of a batch."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield keys[start], start, i
            start = i


def visiting(nodes: DataFrame, grid: Grid, dtype: np.dtype) -> DataFrame:
    """nodes with home and visits, the cells that each visits (its own comes first)."""
    sent = nodes.sparkSession.sparkContext.broadcast(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = sent.value
        for batch in batches:
            order = np.argsort(batch.column("size").to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            for (size,), a, b in _runs(batch, ("size",)):
                for start in range(a, b, 1024):
                    part = batch.slice(start, min(1024, b - start))
                    x = unit(_scaled(np.frombuffer(b"".join(part.column("raw").to_pylist()), dtype).reshape(-1, size)))
                    home, first, second = grid.borders(x)
                    cells = [grid.visits(f, s) for f, s in zip(first, second, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home), pa.array(cells, pa.list_(pa.int64()))], [*part.schema.names, "home", "visits"])

    return nodes.select("node", "w", "size", "raw").mapInArrow(run, "node bigint, w bigint, size int, raw binary, home bigint, visits array<bigint>")


class _Cell:
    """The nodes of one block of a cell; counts and links of what searches it."""

    def __init__(self, grid: Grid, dtype: np.dtype, cosine: float, size: int):
        self.grid, self.dtype, self.cosine, self.size = grid, dtype, cosine, size
        self.nodes, self.weights, self.raw = [], [], []
        self.made = False

    def add(self, batch: pa.RecordBatch) -> None:
        self.nodes.append(batch.column("node").to_numpy()), self.weights.append(batch.column("w").to_numpy())
        self.raw += batch.column("raw").to_pylist()

    def matrix(self, raw: list[bytes]) -> np.ndarray:
        return _scaled(np.frombuffer(b"".join(raw), self.dtype).reshape(-1, self.size))

    def make(self) -> None:
        self.node, self.w = np.concatenate(self.nodes), np.concatenate(self.weights)
        self.x, self.raw, self.made = self.matrix(self.raw), [], True
        self.norm = np.linalg.norm(self.x, axis=1)
        self.credit, self.labels = np.zeros(len(self.node), np.int64), np.arange(len(self.node))
        self.border = None

    def ask(self, batch: pa.RecordBatch, cell: int) -> Iterator[pa.RecordBatch]:
        if not self.made:
            self.make()
        node, w, home = (batch.column(c).to_numpy() for c in ("node", "w", "home"))
        x = self.matrix(batch.column("raw").to_pylist())
        hit = (x @ self.x.T) / (np.linalg.norm(x, axis=1)[:, None] * self.norm) >= self.cosine
        hit &= node[:, None] != self.node
        i, j = np.nonzero(hit)
        if not len(i):
            return
        some = np.flatnonzero(hit.any(axis=1))
        first = hit.argmax(axis=1)
        self.labels = merged(self.labels, first[i], j)
        yield _out(node[some], self.node[first[some]], (hit[some] @ self.w).astype(np.int64))
        guest = home[i] != cell
        i, j = i[guest], j[guest]
        if len(i):  # credited here only if it does not find the guest itself
            if self.border is None:
                self.border = self.grid.borders(unit(self.x))[1:]
            width = len(self.grid.books[1])
            missed = self.border[0][j, home[i] // width] + self.border[1][j, home[i] % width] > self.grid.limit
            np.add.at(self.credit, j[missed], w[i[missed]])

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.made:
            at = np.flatnonzero((self.credit > 0) | (self.labels != np.arange(len(self.node))))
            if len(at):
                yield _out(self.node[at], self.node[self.labels[at]], self.credit[at])


def _out(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["u", "v", "n"])


def verified(rows: DataFrame, grid: Grid, dtype: np.dtype, cosine: float) -> DataFrame:
    """(u, v, n): u has n links that were found in this cell, and belongs together with v. rows: (size, cell, block, guest, node, w, home, raw)."""
    sent = rows.sparkSession.sparkContext.broadcast(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for batch in batches:
            for (size, cell, block, asks), a, b in _runs(batch, ("size", "cell", "block", "asks")):
                if (size, cell, block) != name:
                    if held:
                        yield from held.done()
                    name, held = (size, cell, block), _Cell(sent.value, dtype, cosine, size)
                if not asks:
                    held.add(batch.slice(a, b - a))
                elif held.nodes:
                    for start in range(a, b, ASKING):
                        yield from held.ask(batch.slice(start, min(ASKING, b - start)), cell)
        if held:
            yield from held.done()

    keys = ("size", "cell", "block")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(run, "u bigint, v bigint, n bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, recall: float = 0.99, members: int = MEMBERS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, as described above."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "multiindex")
    read, dtype = _read(vectors, id_col, vector_col)
    own = scratch.keep(read)
    nodes = own.where("raw is not null").groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"), F.first("size").alias("size"), F.first("raw").alias("raw"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()))  # written, so that the numbers stay
    common = nodes.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    alone = F.col("vec_id").alias("component_id")
    if common is None:
        return own.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), alone, F.lit(True).alias("kept"))
    size = common[0]
    rows = min(SAMPLE, max(256, SAMPLE_BYTES // (8 * size)))
    sample = nodes.where(F.col("size") == size).select("raw", F.xxhash64("raw").alias("h")).orderBy("h").limit(rows).collect()
    sample = _scaled(np.frombuffer(b"".join(bytes(r.raw) for r in sample), dtype).reshape(-1, size))
    grid = fit(sample, min(MOST, max(8, math.ceil(math.sqrt(common[1] / CELL)))), cosine, recall)
    placed = scratch.keep(visiting(nodes, grid, dtype))
    many = placed.groupBy(F.col("home").alias("cell")).count().where(F.col("count") > members)
    many = F.broadcast(many.select("cell", F.ceil(F.col("count") / members).cast("int").alias("blocks")))
    living = placed.withColumn("cell", F.col("home")).join(many, "cell", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int"))
    asking = placed.withColumn("cell", F.explode("visits")).join(many, "cell", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    columns = ("size", "cell", "block", "node", "w", "home", "raw")
    rows = living.select(*columns, F.lit(False).alias("asks")).unionByName(asking.select(*columns, F.lit(True).alias("asks")))
    found = scratch.keep(verified(rows, grid, dtype, cosine))
    links = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected(found.select("u", "v"), spark)
    rooted = nodes.select("s1", "s2", "node", "w", "least").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(names, "root").select("s1", "s2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    linked = own.where("raw is not null").select("vec_id", "s1", "s2").join(of, ["s1", "s2"]).select("vec_id", "n_links", "component_id")
    rest = own.where("raw is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), alone)
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
