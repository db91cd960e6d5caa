"""Substring dedup by difference-cover anchors.

A window is `window` consecutive words of one document; a word goes if a window over it also starts in a document
with a smaller id. Hashing every window of every document would shuffle far more than the text. Instead only the
positions in a perfect difference set modulo 31 are hashed, over anchors of `window` - 30 words: two equal windows
that start at i and j share a shift d < 31 with i+d and j+d both in the set, so they share an aligned anchor. Only
where an anchor occurs in a second text is it extended: the windows over it are hashed in full, with 128 bits, and the
smallest id of each window's documents decides.

Equal texts are one text first: all but the copy with the smallest id lose every word if there is a window at all, and
need no anchors. Texts are shuffled once, compressed, by a 128-bit hash; anchors, windows and the result read that one
exchange. What a map task sees of one text, anchor or window in several documents it settles itself: it sends one row
on to meet other tasks, and the settled ones as runs that are dealt out evenly. So a text or passage that a third of
all documents share sends a row per batch and not one per document.

Nulls and odd rows: a null or empty text has no words; a document without an id keeps all its words and takes none
from others; rows with the same id are never smaller than each other and are judged one by one; other columns,
whatever their names, are not touched. Ids are whole numbers (or strings of them; other strings fail the cast). Texts
may be of any length: positions are 32-bit numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import arrow_map, in_slices, tidy, worker_held

#: A perfect difference set modulo 31; each remainder but 0 is one difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Odd factors of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: What is known of a text after the first look: nothing can be removed; a smaller id has the same text; to be looked up.
WHOLE, GONE, OPEN = 0, 1, 2


class _Hashes(dict):
    """Word hashes, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxh64_intdigest(word, 8)
        return value


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get(base, ((),))[0]) < n:
        size = max(n, 4096)
        ones = [np.uint64(1)]
        _powers[base] = tuple(np.concatenate([ones, np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
    up, down = _powers[base]
    return up[:n], down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(worker_held("word hashes", _Hashes).__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each run of `width` words."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _power(n, base)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up)])
    return _mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns], names)


def _text(z: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogatepass")


def _looked_at(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Texts (r1, r2, doc, state, n_words, z, rows), one row per id and text of a slice of a batch.

    r1 and r2 are the text's hash if it is OPEN; settled texts have a hash of their own in r1, which deals them out
    evenly, and no r2. rows: the other columns of the documents it stands for.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"), rest.alias("row"))
    # r1 is not nullable: else an inner join adds a filter below the exchange, which then is not the one of the other consumers.
    schema = T.StructType([T.StructField(n, t, n != "r1") for n, t in (("r1", T.LongType()), ("r2", T.LongType()), ("doc", T.LongType()), ("state", T.IntegerType()), ("n_words", T.LongType()), ("z", T.BinaryType()), ("rows", T.ArrayType(rows.schema["row"].dataType)))])

    def look(part: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        at: dict[tuple[bytes, int | None], list[int]] = {}
        least: dict[bytes, int] = {}
        texts = part.column("text").to_pylist()
        for i, (doc, text) in enumerate(zip(part.column("doc").to_pylist(), texts, strict=True)):
            digest = b"" if text is None else xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
            at.setdefault((digest, doc), []).append(i)
            if doc is not None:
                least[digest] = min(least.get(digest, doc), doc)
        out = []
        for (digest, doc), own in at.items():
            text = texts[own[0]]
            raw = (text or "").encode("utf-8", "surrogatepass")
            n = len(raw.split())
            state = WHOLE if doc is None or n < window else GONE if doc > least[digest] else OPEN
            if state == OPEN:
                r1, r2 = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))
            else:
                r1, r2 = int(np.uint64(xxh64_intdigest(b"%b %r" % (digest, doc))).view(np.int64)), None
            out.append((r1, r2, doc, state, n, None if text is None or state == GONE else pack(raw)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        order = pa.array([i for own in at.values() for i in own], pa.int64())
        offsets = pa.array(np.cumsum([0, *map(len, at.values())]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, part.column("row").take(order))
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, lists], schema.names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text"):
                yield look(part)

    return rows.mapInArrow(run, schema)


def _anchors(texts: DataFrame, window: int) -> DataFrame:
    """(key, r1, at, met) of the anchors of OPEN texts.

    met: the batch has the anchor in two texts. Then all its rows are settled and, under keys that deal them out
    evenly, only pass by; one further row (at < 0) tells other batches.
    """
    width = window - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, of, at = [], [], []
        for r1, doc, least, state, z in zip(*(batch.column(c) for c in ("r1", "doc", "least", "state", "z")), strict=True):
            if state.as_py() != OPEN or doc.as_py() != least.as_py():
                continue
            hashes = window_hashes(word_hashes(_words(_text(z.as_py()))), width)
            own = np.flatnonzero(np.resize(cover, len(hashes)))
            keys.append(hashes[own]), at.append(own.astype(np.int32))
            of.append(np.full(len(own), r1.as_py(), np.int64))
        if not keys:
            return None
        keys, of, at = np.concatenate(keys), np.concatenate(of), np.concatenate(at)
        order = np.lexsort((of, keys))
        keys, of, at = keys[order], of[order], at[order]
        new = np.r_[True, keys[1:] != keys[:-1]]
        group = np.cumsum(new) - 1
        met = (of[new] != of[np.r_[np.flatnonzero(new)[1:] - 1, len(keys) - 1]])[group]
        tell = met & new
        spread = _mix(of.view(np.uint64) ^ (at.astype(np.uint64) << np.uint64(32)))
        return _batch(["key", "r1", "at", "met"], np.r_[np.where(met, spread, keys), keys[tell]], np.r_[of, of[tell]], np.r_[at, np.full(tell.sum(), -1, np.int32)], np.r_[met, met[tell]])

    return arrow_map(texts, run, "key bigint, r1 bigint, at int, met boolean")


def _shared(anchors: DataFrame) -> DataFrame:
    """(r1, at) of the anchors that two texts have."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, shared = None, None, False  # of the group that the last batch ended in
        of: list[np.ndarray] = []  # its rows so far, while they are all of one text
        at: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k, r, a = (batch.column(x).to_numpy() for x in ("key", "r1", "at"))
            m = batch.column("met").to_numpy(zero_copy_only=False)
            passing = m & (a >= 0)
            if passing.any():
                yield _batch(["r1", "at"], r[passing], a[passing])
                k, r, a, m = (x[~passing] for x in (k, r, a, m))
                if not len(k):
                    continue
            new = np.r_[k[0] != key, k[1:] != k[:-1]]
            starts = np.flatnonzero(new)
            group = np.cumsum(new)
            firsts = np.r_[first if first is not None else 0, r[starts]]
            is_shared = np.zeros(len(starts) + 1, bool)
            is_shared[0] = shared
            np.logical_or.at(is_shared, group, m | (r != firsts[group]))
            if of and is_shared[0] and not shared:
                yield _batch(["r1", "at"], np.concatenate(of), np.concatenate(at))
            if is_shared[0] or len(starts):
                of, at = [], []
            take = is_shared[group] & (a >= 0)
            if take.any():
                yield _batch(["r1", "at"], r[take], a[take])
            if not is_shared[-1]:
                tail = group == len(starts)
                of.append(r[tail]), at.append(a[tail])
            key, first, shared = k[-1], firsts[-1], is_shared[-1]

    return anchors.repartition("key").sortWithinPartitions("key").mapInArrow(run, "r1 bigint, at int")


def _runs(of: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts (r1, doc, at, n) as runs of n consecutive ones."""
    order = np.lexsort((at, doc, of))
    of, doc, at = of[order], doc[order], at[order]
    new = np.r_[True, (of[1:] != of[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]
    return of[new], doc[new], at[new], np.diff(np.r_[np.flatnonzero(new), len(of)]).astype(np.int32)


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(k1, k2, doc, r1, at, n) of all windows over the anchors at `at`; n is 0, or the length of a run that the batch has settled."""
    names = ["k1", "k2", "doc", "r1", "at", "n"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        k1, k2, docs, of, starts = [], [], [], [], []
        for r1, doc, least, state, z, at in zip(*(batch.column(x) for x in ("r1", "doc", "least", "state", "z", "at")), strict=True):
            if state.as_py() != OPEN or doc.as_py() != least.as_py():
                continue
            hashes = word_hashes(_words(_text(z.as_py())))
            ends, n = np.asarray(at.values.to_numpy(), np.int64), max(0, len(hashes) - window + 1)
            near = np.zeros(n + 1, np.int32)
            np.add.at(near, np.clip(ends - PERIOD + 1, 0, n), 1)
            np.add.at(near, np.clip(ends + 1, 0, n), -1)
            pick = np.flatnonzero(np.cumsum(near[:n]) > 0)
            k1.append(window_hashes(hashes, window)[pick]), k2.append(window_hashes(hashes, window, BASES[1])[pick])
            docs.append(np.full(len(pick), doc.as_py(), np.int64)), of.append(np.full(len(pick), r1.as_py(), np.int64))
            starts.append(pick.astype(np.int32))
        if not sum(map(len, k1)):
            return None
        k1, k2, docs, of, starts = map(np.concatenate, (k1, k2, docs, of, starts))
        order = np.lexsort((docs, k2, k1))
        k1, k2, docs, of, starts = (x[order] for x in (k1, k2, docs, of, starts))
        new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
        gone = docs != docs[new][np.cumsum(new) - 1]
        out = _batch(names, *(x[~gone] for x in (k1, k2, docs, of, starts)), np.zeros((~gone).sum(), np.int32))
        if not gone.any():
            return out
        r1, doc, at, n = _runs(of[gone], docs[gone], starts[gone])
        spread = _mix(r1.view(np.uint64) ^ (at.astype(np.uint64) << np.uint64(32)))
        both = pa.Table.from_batches([out, _batch(names, spread, spread, doc, r1, at, n)])
        return both.combine_chunks().to_batches()[0]

    return arrow_map(texts, run, "k1 bigint, k2 bigint, doc bigint, r1 bigint, at int, n int")


def _taken(windows: DataFrame) -> DataFrame:
    """(r1, doc, at, n): runs of windows that a smaller document has."""
    names = ["r1", "doc", "at", "n"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None  # of the group that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, doc, r1, at, n = (batch.column(x).to_numpy() for x in ("k1", "k2", "doc", "r1", "at", "n"))
            if (settled := n > 0).any():
                yield _batch(names, *(x[settled] for x in (r1, doc, at, n)))
                k1, k2, doc, r1, at = (x[~settled] for x in (k1, k2, doc, r1, at))
                if not len(k1):
                    continue
            new = np.r_[(k1[0], k2[0]) != key, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
            firsts = np.r_[first if first is not None else 0, doc[new]]
            take = doc != firsts[np.cumsum(new)]
            if take.any():
                yield _batch(names, *_runs(r1[take], doc[take], at[take]))
            key, first = (k1[-1], k2[-1]), firsts[-1]

    return windows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "doc").mapInArrow(run, "r1 bigint, doc bigint, at int, n int")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Texts as _looked_at() has them, with `least`, the smallest id that has the text, and `runs`, a list of (doc, at, n):
    starts of repeated windows of the text if it is OPEN and its id the least one; null if there are none.

    A document's length bounds its lists. Consumers take all columns, so that all of them read one exchange.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window needs over {PERIOD} words")
    same = Window.partitionBy("r1", "r2")
    texts = _looked_at(docs, id_col, text_col, window).repartition("r1").withColumn("least", F.min("doc").over(same))
    found = _shared(_anchors(texts, window)).groupBy("r1").agg(F.collect_list("at").alias("at"))
    again = _taken(_windows(texts.join(found, "r1"), window))
    runs = again.groupBy("r1").agg(F.collect_list(F.struct("doc", "at", "n")).alias("runs"))
    return texts.join(runs, "r1", "left")


def _covered(n: int, doc: int | None, runs: pa.Scalar, window: int) -> np.ndarray:
    """Which of n words the runs of a document cover."""
    edge = np.zeros(n + 1, np.int32)
    if runs.is_valid:
        own, at, k = (runs.values.field(c).to_numpy() for c in ("doc", "at", "n"))
        at, k = at[own == doc].astype(np.int64), k[own == doc]
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + k - 1 + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _judged(batch: pa.RecordBatch, window: int) -> Iterator[tuple[str | None, int, np.ndarray | None]]:
    """(text, n_words, which words go) of each row; None for the words: all of them do."""
    for doc, least, state, n, z, runs in zip(*(batch.column(c) for c in ("doc", "least", "state", "n_words", "z", "runs")), strict=True):
        doc, n = doc.as_py(), n.as_py()
        if state.as_py() == GONE or state.as_py() == OPEN and doc > least.as_py():
            yield "", n, None
        else:
            text = _text(z.as_py()) if z.is_valid else None
            yield text, n, _covered(n, doc, runs, window) if state.as_py() == OPEN else np.zeros(n, bool)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): one row per document."""
    found = repeats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", window)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, digests = [], [], []
        for text, n, gone in _judged(batch, window):
            words = [] if gone is None else _words(text or "")
            if gone is not None and gone.any():
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            n_words.append(n), n_removed.append(n - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        rows = batch.column("rows")
        of = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy())
        columns = [pa.array(x, k).take(pa.array(of)) for x, k in ((n_words, pa.int64()), (n_removed, pa.int64()), (digests, pa.string()))]
        return pa.RecordBatch.from_arrays([rows.flatten().field("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return arrow_map(found, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string")


def cut_text(text: str, gone: np.ndarray) -> str:
    """The text without the words that go; what stands between kept words stays as it is."""
    if not gone.any():
        return text
    out, at = [], 0
    for m, g in zip(re.finditer(r"[^\x20\x09-\x0d]+", text), gone.tolist(), strict=True):
        if not g:
            out.append(text[at : m.end()])
        at = m.end()
    out.append("" if gone[-1] else text[at:])
    return "".join(out)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """docs with the repeated words cut from the text column; all other columns as they were."""
    found, names = repeats(docs, id_col, text_col, window), docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = ["" if gone is None else text and cut_text(text, gone) for text, _, gone in _judged(batch, window)]
        rows = batch.column("rows")
        of = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy())
        other = rows.flatten()
        columns = [pa.array(texts, pa.string()).take(pa.array(of)) if c == text_col else other.field(c) for c in names]
        return pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(found, run, docs.schema)
