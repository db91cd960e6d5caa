"""Spelling variants of a corpus's words, grouped by a bidirectional FM-index with search schemes of one error.

Runs of the letters A-Z, a-z and U+00C0 to U+00FF are counted over all documents, A-Z in lower case. In one of `noise`
(document, run) pairs, told by a checksum of both, one character is left out, as if it were mistyped. Words have at
least `shortest` characters and `least` occurrences. Two words are near if they differ by exactly one inserted,
deleted or replaced character. A word's form is its near word with the most occurrences (of several the smallest), if
it has `factor` times the word's own at least; its root is where the forms lead.

If two words are near, the shorter one (or either, of equal lengths) has a half that the other one starts or ends
with. So words are dealt out by halves: each to the first half of a word of its own length and of one character
less, and to the second half likewise. A task makes an FM-index of the words that it is dealt, CHUNK at a time, and
searches them in it: a half exactly, and across the other half with one error (fmindex.py). A half that more than
HOT times CHUNK words share is dealt anew: its words to blocks, its searches to each of these blocks. What a search
costs depends on the word and not on the size of the index.

Null texts have no words; a null id counts as empty. Repeated rows count as often as they come. Empty tables give no
rows. Other columns are not read. Ties are broken in code-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_text
from .fmindex import FMIndex, near

#: Words of an index, and how many times that a task holds of one half.
CHUNK, HOT = 100_000, 2
#: Bytes that are split at once, and distinct words that a task counts before it passes them on.
PIECE, HELD = 1 << 20, 400_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
#: Codes of the letters, in code-point order; 0 is the delimiter.
_CODES = np.zeros(256, np.int64)
_CODES[[*range(97, 123), *range(192, 256)]] = np.arange(1, 91)


def runs(text: str) -> Iterator[list[bytes]]:
    """The text's runs in Latin-1, about PIECE bytes at a time; what Latin-1 lacks is no letter here."""
    folded, start = text.encode("latin-1", "replace").translate(_FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def mistyped(prefix: int, run: bytes, noise: int) -> bytes:
    """The run, without one character if the checksum of document and run says so; prefix is the checksum of the id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    return run if h % noise else run[: h % len(run)] + run[h % len(run) + 1 :]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 31, shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n) of all words."""
    rows = docs.select(as_text(id_col).alias("doc_id"), as_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                prefix = zlib.crc32(f"{doc_id}:".encode())
                for part in runs(text.as_py()):
                    for word, n in Counter(part).items():
                        if len(word) >= shortest and len(word := mistyped(prefix, word, noise)) >= shortest:
                            held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _dealt(counted: DataFrame) -> DataFrame:
    """(side, half, word, n, asks): each word under the halves by which it may be found; asks: by which it searches as well."""
    size = F.length("word")
    rows = counted.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))  # 0: the last half is exact, 1: the first
    exact = lambda length: F.when(F.col("side") == 0, F.ceil(length / 2)).otherwise(F.floor(length / 2)).cast("int")
    rows = rows.withColumn("exact", F.explode(F.array_distinct(F.array(exact(size), exact(size - 1)))))
    half = F.when(F.col("side") == 0, F.expr("right(word, exact)")).otherwise(F.expr("left(word, exact)"))
    return rows.select("side", half.alias("half"), "word", "n", (F.col("exact") == exact(size)).alias("asks"))


FOUND = "word string, other string, n bigint, side int, half string, asks boolean"


def _index(own: list[bytes]) -> FMIndex:
    raw = b"".join(own)
    return FMIndex(_CODES[np.frombuffer(raw, np.uint8)], np.concatenate([[0], np.cumsum([len(w) for w in own], dtype=np.int64)]))


class _Vocabulary:
    """Words of one side with their counts, and the index of them; for side 1 they are read backward."""

    def __init__(self, side: int, rows: list[tuple[bytes, int, bool]]):
        self.side = side
        counts = {self.turned(w): n for w, n, _ in rows}
        self.words = sorted(counts)
        self.counts = np.array([counts[w] for w in self.words], np.int64)
        self.index = _index(self.words)

    def turned(self, word: bytes) -> bytes:
        return word[::-1] if self.side else word

    def pairs(self, asking: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        """(word, other, n of the other) of the asking words and those near them, both ways."""
        asking = list(dict.fromkeys(asking))
        own = [self.turned(w) for w, _ in asking]
        lengths = np.array([len(w) for w in own], np.int64)
        codes = _CODES[np.frombuffer(b"".join(w[::-1] for w in own), np.uint8)]
        exact = lengths // 2 if self.side else (lengths + 1) // 2
        q, w = near(self.index, codes, np.concatenate([[0], np.cumsum(lengths)]), exact)
        if not len(q):
            return
        q, w = np.unique(np.stack([q, w]), axis=1)
        left, right = [asking[i] for i in q.tolist()], [self.turned(self.words[i]) for i in w.tolist()]
        word = [x.decode("latin-1") for x, _ in left]
        other = [x.decode("latin-1") for x in right]
        yield _found(word + other, other + word, self.counts[w].tolist() + [n for _, n in left])


def _found(word: list, other: list, n: list, side: int | None = None, half: str | None = None, asks: list | None = None) -> pa.RecordBatch:
    size = len(word)
    columns = [pa.array(word, pa.string()), pa.array(other, pa.string()), pa.array(n, pa.int64()), pa.array([side] * size, pa.int32()), pa.array([half] * size, pa.string()), pa.array(asks or [None] * size, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["word", "other", "n", "side", "half", "asks"])


class _Task:
    """What a task of _searched holds: the words of whole groups, and of the last one so far."""

    def __init__(self, chunk: int):
        self.chunk = chunk
        self.held: list[tuple[bytes, int, bool]] = []
        self.asking: list[tuple[bytes, int]] = []
        self.made: _Vocabulary | None = None  # the index of what is held
        self.group, self.began, self.hot = None, 0, False

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The index of what is held, and what its own words find in it."""
        if self.held and self.made is None:
            self.made = _Vocabulary(self.group[0], self.held)
            own = [(w, n) for w, n, asks in self.held if asks]
            for k in range(0, len(own), self.chunk):
                yield from self.made.pairs(own[k : k + self.chunk])

    def ask(self) -> Iterator[pa.RecordBatch]:
        if self.asking and self.made is not None:
            yield from self.made.pairs(self.asking)
        self.asking = []

    def pass_on(self) -> Iterator[pa.RecordBatch]:
        """The rows of a half that too many words share, as they are."""
        rows = self.held[self.began :]
        del self.held[self.began :]
        if rows:
            yield _found([w.decode("latin-1") for w, _, _ in rows], [None] * len(rows), [n for _, n, _ in rows], self.group[0], self.group[1], [a for _, _, a in rows])

    def turn(self, name: tuple | None) -> Iterator[pa.RecordBatch]:
        """The last group has ended."""
        yield from self.ask()
        if self.hot:
            yield from self.pass_on()
        if self.group is not None and (name is None or len(self.held) >= self.chunk or self.made is not None or name[0] != self.group[0]):
            yield from self.flush()
            self.held, self.made = [], None
        self.group, self.began, self.hot = name, len(self.held), False

    def add(self, row: tuple[bytes, int, bool], only: bool) -> Iterator[pa.RecordBatch]:
        if only:
            yield from self.flush()
            self.asking.append(row[:2])
            return
        self.held.append(row)
        if len(self.held) - self.began > (self.chunk if self.hot else HOT * self.chunk) and self.group[2] < 0:
            self.hot = True
            yield from self.pass_on()


def _searched(rows: DataFrame, chunk: int) -> DataFrame:
    """rows (side, half, block, only, word, n, asks), only: it searches but is not searched. Near pairs, and the rows of halves too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(chunk)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("side", "half", "block", "only", "word", "n", "asks")]
            for side, half, block, only, word, n, asks in zip(*columns, strict=True):
                if (side, half, block) != task.group:
                    yield from task.turn((side, half, block))
                yield from task.add((word.encode("latin-1"), n, asks), only)
            yield from task.ask()
        yield from task.turn(None)

    keys = ("side", "half", "block")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "only").mapInArrow(run, FOUND)


def near_words(counted: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """(word, other, n): all pairs of near words, both ways, n of the other."""
    rows = _dealt(counted)
    first = scratch.keep(_searched(rows.withColumns({"block": F.lit(-1), "only": F.lit(False)}), chunk))
    found = first.where("other is not null").select("word", "other", "n")
    hot = first.where("other is null").select("side", "half", "word", "n", "asks")
    if hot.take(1):
        blocks = hot.groupBy("side", "half").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("blocks"))
        rows = hot.join(blocks, ["side", "half"])
        index = rows.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).withColumns({"only": F.lit(False), "asks": F.lit(False)})
        asking = rows.where("asks").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("only", F.lit(True))
        again = _searched(index.drop("blocks").unionByName(asking.drop("blocks")), chunk)
        found = found.unionAll(again.select("word", "other", "n"))
    return found.distinct()


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 31, shortest: int = 7, least: int = 2, factor: int = 10, chunk: int = CHUNK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word, as described above."""
    scratch = Scratch(docs.sparkSession, "variants")
    counted = scratch.keep(words(docs, id_col, text_col, noise, shortest, least))
    best = near_words(counted, scratch, chunk).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), "other")).alias("best"))
    of = counted.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.minus")).alias("form_n"), F.col("best.other").alias("form"))
    enough = F.col("form_n") >= factor * F.col("n")
    of = scratch.keep(of.withColumn("form", F.when(enough, F.col("form"))).withColumn("form_n", F.when(enough, F.col("form_n"))))
    roots = of.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # a form has `factor` times the occurrences, so this doubling ends after a few rounds
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = scratch.keep(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if not step.where("moved").take(1):
            break
    return of.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
