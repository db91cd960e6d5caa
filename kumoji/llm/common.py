"""Shared helpers of the llm operators: tables, scratch storage in the shared folder, and Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words in several contracts: space and 0x09 to 0x0D, which is what bytes.split() takes.
BLANKS = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests, one machine)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='kumoji-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables in the shared folder that cut lineage; drop() removes one when its readers are done."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kumoji-{label}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def as_text(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def release() -> None:
    """Gives free memory back to the system: Arrow's, and the C library's where it can (glibc)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases memory at each task's end. A worker outlives its tasks, and would keep the
    most that any of them took."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch; empty batches are skipped."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def in_slices(batch: pa.RecordBatch, column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of one string column, so that memory follows bytes and not rows."""
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


#: Bits of a filter for each key, and at most: 64 MB, whatever the number of keys.
FILTER_BITS, FILTER_MOST, FILTER_PARTS, FILTER_HASHES = 12, 1 << 29, 64, 4


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """A row of FILTER_HASHES places within one part of a filter for each key."""
    x = keys.view(np.uint64)
    step = (x >> np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return ((x[:, None] + np.arange(1, FILTER_HASHES + 1, dtype=np.uint64) * step[:, None]) >> np.uint64(20)) % np.uint64(bits // FILTER_PARTS)


class MaybeIn:
    """A Bloom filter: tells of hashes whether they may be among those that it was made of."""

    def __init__(self, bits: int, held: np.ndarray):
        self.bits, self.held = bits, held

    def test(self, x: np.ndarray) -> np.ndarray:
        at = (x.view(np.uint64) % np.uint64(FILTER_PARTS))[:, None] * np.uint64(self.bits // FILTER_PARTS) + _places(x, self.bits)
        return (((self.held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1) != 0).all(axis=1)


def maybe_in(keys: DataFrame, count: int):
    """A broadcast MaybeIn of keys' one column of hashes: true for all of them, and for few others.

    It has at most 64 MB: with more keys than it has room for, more others pass, and none is lost. Its parts are made on
    the executors, one a task, and are all that comes to the driver.
    """
    bits = max(1 << 16, min(FILTER_MOST, 1 << (FILTER_BITS * max(1, count) - 1).bit_length()))
    name = keys.columns[0]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch.column("k").to_numpy()
            part = (own.view(np.uint64) % np.uint64(FILTER_PARTS)).astype(np.int64)
            for p in np.unique(part).tolist():
                at = _places(own[part == p], bits).ravel()
                made.setdefault(p, np.zeros(bits // FILTER_PARTS, bool))[at] = True
        for p, part in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], ["p", "bits"])

    parts = keys.select(F.col(name).alias("k")).withColumn("p", F.pmod("k", F.lit(FILTER_PARTS))).repartition("p").select("k").mapInArrow(run, "p int, bits binary")
    whole = np.zeros(bits // 8, np.uint8)
    size = bits // FILTER_PARTS // 8
    for r in parts.collect():
        whole[r.p * size : (r.p + 1) * size] |= np.frombuffer(bytes(r.bits), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(MaybeIn(bits, whole))


def maybe_in_column(sent) -> Callable[[F.Column], F.Column]:
    """The test of a broadcast MaybeIn for a column."""

    @F.arrow_udf("boolean")
    def test(column: pa.Array) -> pa.Array:
        return pa.array(sent.value.test(column.to_numpy(zero_copy_only=False)))

    return test


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file: $KUMOJI_TOKENIZER if set, else what the public_tokenizers package has."""
    if path := os.environ.get("KUMOJI_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


_held: dict[str, object] = {}


def worker_held(key: str, make: Callable[[], object]):
    """What a Python worker keeps from task to task. One thing at a time: workers outlive a stage, and what an earlier
    operator left behind would take memory from the next one."""
    if key not in _held:
        _held.clear()
        gc.collect()
        release()
        _held[key] = make()
    return _held[key]
