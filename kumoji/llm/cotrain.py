"""A quality classifier by co-training of two views.

One view sees only the text (shares of characters and of word shapes, repetition, lengths), the other only the page's
metadata (source, language, recorded length). Both are logistic regressions in numpy. In each round each view scores
all unlabelled documents, labels the `take` it is surest of and hands them to the other view. Afterwards each view's
logit is calibrated on a quarter of the labelled sample that neither was trained on (on all of it where that quarter
lacks a class), and a third logistic regression combines the two calibrated views.

Training takes at most `per_class` labelled documents of each class, chosen by a hash of the id. The unlabelled ones
are told by a Bloom filter of the labels' ids; what it stops wrongly is found by a join of ids alone and added, so that
none is lost and no text is shuffled but theirs. The features are made once, into a table in the shared folder; in a
round each task sends on the few it is surest of, and the driver gets `take` a view. Scoring covers every document in one
pass without a shuffle. A model is a few hundred numbers.

Nulls and odd rows: null and empty texts, sources and languages are values of their own; a null length is the text's;
labels that are null or of unknown documents are not used; a document with several labels counts as good if one says
so; without labels of both classes every score is their share (0.5 without labels); repeated rows come out as often as
they went in (as unlabelled ones they are handed over once); other columns are not read. Ids of labels are whole numbers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_text, in_slices, maybe_in, maybe_in_column
from .toxicity import held_out

SHAPES, SOURCES, PAIRS, KEPT = 256, 64, 128, 250_000
RUNS = re.compile(r"(.)\1+", re.S)
_BYTES = np.array([0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in b" \t\n\r\x0b\x0c" else 4 if c in b".,;:!?'\"-" else 5 if c < 128 else 6 for c in range(256)])


class _Shapes(dict):
    """A word's shape (runs of upper and lower case letters, digits and marks) as a bucket."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
        value = zlib.crc32(RUNS.sub(r"\1", kinds).encode("utf-8", "surrogatepass")) % SHAPES
        if len(word) <= 64:  # longer ones hardly come again
            self[word] = value
        return value


_shapes = _Shapes()


def text_view(text: str) -> np.ndarray:
    words = text.split()
    n = len(words)
    out = np.zeros(16 + SHAPES, np.float32)
    if not n:
        out[15] = 1
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_BYTES, weights=np.bincount(raw, minlength=256), minlength=7) / len(raw)
    lines = [x for x in text.split("\n") if x]
    out[:7] = 4 * kinds
    out[7] = len(set(words)) / n
    out[8] = len(set(lines)) / max(1, len(lines))
    out[9] = np.log1p(n) / 8
    out[10] = min(len(raw) / n, 30) / 10
    out[11] = np.log1p(n / max(1, len(lines))) / 5
    out[12] = float(n < 10)
    out[16:] = 2 * np.bincount(np.fromiter(map(_shapes.__getitem__, words), np.int64, n), minlength=SHAPES) / n
    return out


def page_view(source: str | None, lang: str | None, chars: int | None) -> np.ndarray:
    out = np.zeros(SOURCES + 32 + 24 + PAIRS, np.float32)
    bucket = lambda x, size: zlib.crc32(repr(x).encode("utf-8", "surrogatepass")) % size
    out[bucket(source, SOURCES)] = 1
    out[SOURCES + bucket(lang, 32)] = 1
    out[SOURCES + 32 + min(23, int(max(0, chars or 0)).bit_length())] = 1
    out[SOURCES + 56 + bucket((source, lang), PAIRS)] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, decay: float = 1e-3, steps: int = 300, rate: float = 0.1) -> np.ndarray:
    """Weights with the bias last, by Adam on the whole matrix."""
    x = np.c_[x, np.ones(len(x), np.float32)]
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    keep = np.r_[np.full(len(w) - 1, decay), 0]
    for step in range(1, steps + 1):
        g = x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) + keep * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _prob(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    def __init__(self, views: list[np.ndarray], scales: list[np.ndarray], mix: np.ndarray):
        self.views, self.scales, self.mix = views, scales, mix

    def score(self, *x: np.ndarray) -> list[np.ndarray]:
        """Each view's calibrated probability, and the combined one."""
        z = [s[0] * _logit(v, w) + s[1] for v, w, s in zip(x, self.views, self.scales, strict=True)]
        return [*map(_prob, z), _prob(np.stack(z, 1) @ self.mix[:-1] + self.mix[-1])]


#: (view that is sure, label): what a round hands over.
HANDED = ((0, 1), (0, 0), (1, 1), (1, 0))


def cotrained(views: list[np.ndarray], y: np.ndarray, surest: Callable[[list[np.ndarray], list[int], set[int]], dict[tuple[int, int], tuple[list[int], list[np.ndarray]]]], rounds: int = 5, take: int = 100) -> Model:
    """views: features of the labelled rows, one matrix a view. surest(models, numbers, taken): for each of HANDED the ids
    and both views' features of so many unlabelled documents that the view is surest of, none of those taken."""
    held = np.arange(len(y)) % 4 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    ys = [y[~held], y[~held]]
    xs = [v[~held] for v in views]
    taken: set[int] = set()
    models = [logistic(x, t) for x, t in zip(xs, ys, strict=True)]
    for _ in range(rounds):
        shares = [float(t.mean()) for t in ys]
        numbers = [max(1, round(take * (shares[a] if label else 1 - shares[a]))) for a, label in HANDED]
        handed = surest(models, numbers, taken)
        if not any(ids for ids, _ in handed.values()):
            break
        for (a, label), (ids, features) in handed.items():
            if ids:
                b = 1 - a
                xs[b], ys[b] = np.concatenate([xs[b], features[b]]), np.concatenate([ys[b], np.full(len(ids), float(label))])
                taken.update(ids)
        models = [logistic(x, t) for x, t in zip(xs, ys, strict=True)]
    own = held if held.any() else ~held
    z = [_logit(v[own], w) for v, w in zip(views, models, strict=True)]
    scales = [logistic(a[:, None], y[own]) for a in z]
    calibrated = np.stack([s[0] * a + s[1] for a, s in zip(z, scales, strict=True)], 1)
    return Model(models, scales, logistic(calibrated, y[own]))


def _constant(share: float) -> Model:
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    sizes = (16 + SHAPES, SOURCES + 56 + PAIRS)
    return Model([np.r_[np.zeros(s), bias] for s in sizes], [np.array([1.0, 0.0])] * 2, np.array([0.5, 0.5, 0.0]))


_SCHEMA = "id bigint, y int, a array<float>, b array<float>"


def _features(rows: DataFrame, skip=None) -> DataFrame:
    """(id, y, a, b) of rows (id, y, text, source, lang, chars), but for those whose hash h a broadcast filter `skip` may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float32())
        for batch in batches:
            if skip is not None:
                batch = batch.filter(pa.array(~skip.value.test(batch.column("h").to_numpy())))
            for part in in_slices(batch, "text", 4 << 20):
                a, b = _views(part)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(list(a), kind), pa.array(list(b), kind)], ["id", "y", "a", "b"])

    return rows.mapInArrow(run, _SCHEMA)


def _unlabelled(rows: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, a, b) of all rows with an id that is not among ids (one column, id)."""
    own = rows.where("id is not null").withColumns({"y": F.lit(-1), "h": F.xxhash64("id")})
    known = maybe_in(ids.select(F.xxhash64("id").alias("h")), ids.count())
    stopped, _ = scratch.write(own.select("id", "h").where(maybe_in_column(known)("h")).select("id").join(ids, "id", "left_anti").distinct())
    found = _features(own, known)
    if n := stopped.count():
        again = maybe_in_column(maybe_in(stopped.select(F.xxhash64("id").alias("h")), n))
        found = found.unionAll(_features(own.where(again("h")).join(stopped, "id", "left_semi")))
    return found.drop("y")


def _columns(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str) -> DataFrame:
    text = as_text(text_col)
    chars = F.coalesce(F.col(chars_col).cast("bigint"), F.length(text).cast("bigint"))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), chars.alias("chars"))


def _views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    pages = zip(*(part.column(c).to_pylist() for c in ("source", "lang", "chars")), strict=True)
    return np.stack([text_view(t.as_py()) for t in part.column("text")]), np.stack([page_view(*p) for p in pages])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _surest(pool: DataFrame, models: list[np.ndarray], numbers: list[int], taken: set[int], sure: float, scratch: Scratch) -> dict[tuple[int, int], tuple[list[int], list[np.ndarray]]]:
    """Of all rows of pool (id, a, b): what cotrained() asks for, ties in the order of a hash. The driver gets sum(numbers) rows."""
    shared = pool.sparkSession.sparkContext.broadcast((models, np.array(sorted(taken), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, taken = shared.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            free = np.unique(ids, return_index=True)[1]  # rows of one id count once
            free = free[~np.isin(ids[free], taken)]
            tie = (ids[free].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
            x = [_matrix(batch.column(c)) for c in ("a", "b")]
            at, kinds, certain, ties = [], [], [], []
            for kind, ((view, label), n) in enumerate(zip(HANDED, numbers, strict=True)):
                p = _prob(_logit(x[view][free], models[view]))
                p = p if label else 1 - p
                best = np.lexsort((tie, -p))[:n]
                best = best[p[best] >= sure]
                at.append(free[best]), kinds.append(np.full(len(best), kind, np.int32)), certain.append(p[best]), ties.append(tie[best])
            rows = batch.take(pa.array(np.concatenate(at)))
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(certain)), pa.array(np.concatenate(ties).view(np.int64)), *rows.columns], ["kind", "p", "tie", "id", "a", "b"])

    found, path = scratch.write(pool.mapInArrow(run, "kind int, p double, tie bigint, id bigint, a array<float>, b array<float>"))
    best = None
    for kind, n in enumerate(numbers):
        part = found.where(F.col("kind") == kind).dropDuplicates(["id"]).orderBy(F.col("p").desc(), "tie", "id").limit(n)
        best = part if best is None else best.unionAll(part)
    rows = best.toArrow().combine_chunks().sort_by([("kind", "ascending"), ("p", "descending"), ("tie", "ascending"), ("id", "ascending")])
    out, used = {pair: ([], [[], []]) for pair in HANDED}, set()
    for kind, i, a, b in zip(*(rows[c] for c in ("kind", "id", "a", "b")), strict=True):
        if i.as_py() not in used:  # two views may be sure of one document; the first one hands it over
            used.add(i.as_py())
            ids, features = out[HANDED[kind.as_py()]]
            ids.append(i.as_py()), features[0].append(a.values.to_numpy()), features[1].append(b.values.to_numpy())
    scratch.drop(path)
    shared.destroy()
    return {pair: (ids, [np.stack(f) for f in features] if ids else []) for pair, (ids, features) in out.items()}


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars",
    label_id: str = "doc_id", label_col: str = "quality", per_class: int = 1500, rounds: int = 5, take: int = 100, sure: float = 0.95,
) -> Model:
    """The model of a bounded sample of labelled documents and of all unlabelled ones; labels of held-out documents are never read."""
    usable = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isin(0, 1))
    known = usable.where(~held_out(label_id)).groupBy(F.col(label_id).cast("bigint").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    counts = {y: n for y, n in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return _constant(counts.get(1, 0) / sum(counts.values()) if counts else 0.5)
    order = [F.xxhash64("id", F.lit(13)), F.col("id")]
    chosen = known.where("y = 0").orderBy(*order).limit(per_class).unionAll(known.where("y = 1").orderBy(*order).limit(per_class))
    rows = _columns(docs, id_col, text_col, source_col, lang_col, chars_col).withColumn("id", F.col("id").cast("bigint"))

    # At most 2 * per_class ids: a bounded broadcast; the smallest row stands for an id that several rows have.
    sample = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.struct("text", "source", "lang", "chars")).alias("r")).select("id", "y", "r.*")
    found = _features(sample).toArrow().combine_chunks().sort_by("id")
    y = found["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return _constant(float((y == 1).sum() / max(1, len(y))))
    a, b = (np.stack(found[c].to_numpy()) for c in ("a", "b"))
    scratch = Scratch(docs.sparkSession, "cotrain")
    pool = scratch.keep(_unlabelled(rows, usable.select(F.col(label_id).cast("bigint").alias("id")), scratch))
    model = cotrained([a, b], y.astype(float), lambda models, numbers, taken: _surest(pool, models, numbers, taken, sure, scratch), rounds, take)
    scratch.drop(scratch.root)
    return model


def scores(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", threshold: float = 0.5,
) -> DataFrame:
    """(doc_id, held_out, text_score, page_score, score, kept) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = _columns(docs, id_col, text_col, source_col, lang_col, chars_col).withColumn("held_out", held_out("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text", 4 << 20):
                a, b, both = shared.value.score(*_views(part))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= threshold)], ["doc_id", "held_out", "text_score", "page_score", "score", "kept"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['id']}, held_out boolean, text_score double, page_score double, score double, kept boolean")


