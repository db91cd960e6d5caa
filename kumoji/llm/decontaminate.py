"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items go into one automaton over normalised text; each document is normalised and
scanned once, without a shuffle. Words are what remains between ASCII characters other than letters and digits, in
lower case (A-Z only); windows are `width` consecutive words of an item, or all of a shorter item.

The automaton's size follows the benchmark and not the documents. Windows are broadcast in parts of at most
`part_bytes`; with more than one part, a worker holds one automaton at a time and scans each batch with each part.

Nulls and odd rows: null and empty texts have no words and no hits, and as items no windows; an item without an id
hits as the item "null"; items with equal ids are one item; repeated documents come out as often as they went in;
other columns are not read. Words of any length and texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_text, tidy, worker_held

#: Lower case for A-Z; a blank for the other ASCII characters that are not letters or digits.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(items: DataFrame, id_col: str, text_col: str, width: int, part_bytes: int) -> list[dict[bytes, tuple[str, ...]]]:
    """Windows with their items' ids, in parts of bounded size."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), as_text(text_col).alias("t"))
    parts: list[dict[bytes, set[str]]] = [{}]
    size = 0
    for item, text in rows.toLocalIterator():
        own = words(text)
        for k in range(max(1, len(own) - width + 1) if own else 0):
            window = b" ".join(own[k : k + width])
            if window not in parts[-1]:
                size += len(window)
            parts[-1].setdefault(window, set()).add(item)
        if size > part_bytes:
            parts.append({})
            size = 0
    return [{w: tuple(sorted(ids)) for w, ids in part.items()} for part in parts]


class Scanner:
    def __init__(self, part: dict[bytes, tuple[str, ...]]):
        self.automaton = ahocorasick.Automaton()
        for window, items in part.items():
            self.automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
        self.automaton.make_automaton() if part else None

    def scan(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of the windows that occur, and their items."""
        if not own or not len(self.automaton):
            return [], set()
        line = b" " + b" ".join(own) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return [], set()
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        ends = np.searchsorted(blanks, [end for end, _ in found]).tolist()
        return [(end - n, end) for end, (_, (n, _)) in zip(ends, found, strict=True)], {i for _, (_, items) in found for i in items}


def _scanner(shared, key: str, alone: bool) -> Scanner:
    if not alone:
        return Scanner(shared.value)
    return worker_held(f"decontamination {key}", lambda: Scanner(shared.value))


def _hits(texts: list[str], shared: list, key: str) -> list[tuple[list[bytes], list[tuple[int, int]], set[str]]]:
    out = [(words(t), [], set()) for t in texts]
    for k, part in enumerate(shared):
        scanner = _scanner(part, f"{key}-{k}", len(shared) == 1)
        for own, ranges, items in out:
            more, ids = scanner.scan(own)
            ranges.extend(more)
            items.update(ids)
    return out


def _covered(n: int, ranges: list[tuple[int, int]]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    for a, b in ranges:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:n]) > 0


def _prepared(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, width: int, part_bytes: int):
    import uuid

    sc = docs.sparkSession.sparkContext
    return [sc.broadcast(p) for p in windows(benchmark, item_col, item_text, width, part_bytes)], uuid.uuid4().hex


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10, part_bytes: int = 16 << 20
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans: the hit stretches as
    (start, end) in characters of the original text."""
    shared, key = _prepared(docs, benchmark, item_col, item_text, width, part_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), as_text(text_col).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_py() for t in batch.column("text")]
        n_words, n_hit, n_items, digest, spans = [], [], [], [], []
        for text, (own, ranges, items) in zip(texts, _hits(texts, shared, key), strict=True):
            n_words.append(len(own)), n_items.append(len(items))
            digest.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            runs, hit = [], 0
            if ranges:
                covered = _covered(len(own), ranges)
                hit = int(covered.sum())
                at = [m.span() for m in WORD.finditer(text)]
                edges = np.flatnonzero(np.diff(np.r_[0, covered, 0])).reshape(-1, 2).tolist()
                runs = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in edges]
            n_hit.append(hit), spans.append(runs)
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_hit, n_items)), pa.array(digest), pa.array([h > 0 for h in n_hit]), pa.array(spans, kinds)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return arrow_map(rows, run, f"doc_id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start:bigint,end:bigint>>")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10, part_bytes: int = 16 << 20) -> DataFrame:
    """docs without those that hold any window of the benchmark."""
    shared, key = _prepared(docs, benchmark, item_col, item_text, width, part_bytes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(text_col)]
            yield batch.filter(pa.array([not ranges for _, ranges, _ in _hits(texts, shared, key)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
