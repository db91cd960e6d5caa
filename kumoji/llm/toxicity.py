"""Toxicity scores from subword bags: embeddings of a word's character n-grams, averaged into a linear softmax.

A word's vector is the mean of the vectors of its hashed n-grams and of itself, a segment's vector the mean over its
words, where a repeated word counts once, and the softmax is linear in that. Embeddings of all n-grams and the softmax
are trained together in numpy, from nothing but texts and labels. A misspelling that was never seen shares most
n-grams, and so most of its vector, with what was. A text is scored in segments of `segment` words, whose most toxic
one decides, so that a few lines in a very long text are not averaged away. A run of over LONGEST characters without a
blank is cut into pieces that overlap by all but one character of the longest n-gram and count as words of their own,
so text without blanks is read to its end and by segments too.

Training takes at most `per_class` labelled documents of each class, chosen by a hash of the id and not by the order
of rows, in at most PARTS partitions: in each round every partition steps through its own documents from the common model, and
the driver averages their models. So texts stay on the executors, however long they are. An eighth of the sample is
not trained on and sets slope and offset of the logit. Scoring covers every document in one pass without a shuffle: as
the model is linear, a word's share of the logit is one number, which the workers keep.

Nulls and odd rows: null and empty texts get the score of no words, for which each step learns that it is clean; labels that are null or of
unknown documents are not used; a document with several labels counts as toxic if one says so; of several texts with
one id the smallest is learnt from; without a label of each class, every score is the share of toxic labels (0 without
labels); repeated rows come out as often as they went in; other columns are not read by scores() and kept by keep().
Ids of labels and documents are compared as whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, in_slices, tidy, worker_held

BITS = 18
BUCKETS, DIMS = 1 << BITS, 2
SIZES = (3, 4, 5, 6)
STRIP = ".,;:!?*&%$#\"'()[]{}<>"
#: Characters of the longest word that stays whole, and of the pieces that longer ones are cut into, which share OVERLAP with the next.
LONGEST, PIECE, OVERLAP = 64, 16, SIZES[-1] - 1
#: Words of a segment.
SEGMENT = 64
#: Words a worker keeps before it starts anew, words whose n-grams are laid out at once, and bytes of text that are scored at once.
KEPT, AT_ONCE, SLICE = 250_000, 1 << 14, 1 << 20


def split_words(text: str) -> list[str]:
    """The text's words in lower case; a piece of a longer word starts with a blank, which no word does."""
    words = text.lower().split()
    if not words or len(max(words, key=len)) <= LONGEST:
        return words
    out = []
    for w in words:
        if len(w) <= LONGEST or len(bare := w.strip(STRIP)) <= LONGEST:
            out.append(w)
        else:
            marked = f"<{bare}>"
            out += [" " + marked[a : a + PIECE] for a in range(0, len(marked) - OVERLAP, PIECE - OVERLAP)]
    return out


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams and of the words themselves, and which word each belongs to."""
    marked = [w[1:] if w[0] == " " else f"<{w.strip(STRIP)}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(m) for m in marked])
    word = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = _POWERS[np.arange(len(chars)) - starts[word]]
    whole = np.add.reduceat(chars * place, starts)
    buckets, owners = [_bucket(whole)], [np.arange(len(words))]
    for n in SIZES:
        if len(chars) < n:
            continue
        h = np.zeros(len(chars) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + chars[k : len(chars) - n + 1 + k] + np.uint64(n)
        inside = word[: len(h)] == word[n - 1 :]
        buckets.append(_bucket(h[inside])), owners.append(word[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


_POWERS = np.cumprod(np.full(LONGEST + 2, 0x9E3779B97F4A7C55, np.uint64))


def segments(text: str, size: int) -> list[list[str]]:
    """Runs of `size` words; the last one is filled up from the words before it."""
    words = split_words(text)
    if len(words) <= size:
        return [words]
    starts = [*range(0, len(words) - size, size), len(words) - size]
    return [words[s : s + size] for s in starts]


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(3)) == 1, F.lit(False))


#: Fixed factor between the mean vector and the softmax, so that a few words among hundreds can decide.
SCALE = 60.0
#: Partitions that learn side by side, with PART documents each if there are fewer, rounds in which their models are averaged, documents of a step, least steps of a round.
PARTS, PART, ROUNDS, STEP, LEAST_STEPS = 8, 500, 16, 16, 40
#: Learning rate, and what damps the steps of n-grams that were hardly ever seen.
RATE, DAMP = 1.0, 3e-6


class Model:
    """Embeddings and a two-class softmax, and how far each embedding has moved (which slows it down)."""

    PARAMS = ("table", "soft", "bias", "moved", "soft_moved")

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
        self.soft = rng.normal(0, 0.3, (DIMS, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.moved, self.soft_moved = np.zeros(BUCKETS, np.float32), np.zeros(1, np.float32)
        self.slope, self.offset = 1.0, 0.0

    @classmethod
    def constant(cls, share: float) -> Model:
        """Scores everything with the share."""
        model = cls()
        model.slope, model.offset = 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return model

    def packed(self) -> bytes:
        return b"".join(getattr(self, p).tobytes() for p in self.PARAMS)

    def filled(self, raw: bytes) -> Model:
        """A model of the same shape with packed() parameters."""
        out, values, at = Model.__new__(Model), np.frombuffer(raw, np.float32).copy(), 0
        out.slope, out.offset = self.slope, self.offset
        for p in self.PARAMS:
            shape = getattr(self, p).shape
            n = int(np.prod(shape))
            setattr(out, p, values[at : at + n].reshape(shape))
            at += n
        return out

    def step(self, docs: list[list[list[str]]], labels: np.ndarray, weights: np.ndarray, rate: float, widest: bool) -> None:
        """One gradient step over documents, each a list of segments; widest: its most toxic segment learns, else all do."""
        words: dict[str, int] = {}
        seq, sizes, lengths, of = [], [], [], []
        for k, segs in enumerate(docs):
            for words_in in segs:
                own = dict.fromkeys(words_in)
                seq += [words.setdefault(w, len(words)) for w in own]
                sizes.append(len(own)), lengths.append(max(1, len(words_in))), of.append(k)
        if not words:
            return
        buckets, owners = subwords(list(words))
        shares = 1 / np.bincount(owners)
        seq, of, lengths = np.array(seq), np.array(of), np.array(lengths)
        segment = np.repeat(np.arange(len(of)), sizes)
        of_words = [np.bincount(owners, weights=self.table[buckets, d]) * shares for d in range(DIMS)]
        means = np.stack([np.bincount(segment, weights=w[seq], minlength=len(of)) for w in of_words], 1) / lengths[:, None] * SCALE
        lean = self.soft[:, 1] - self.soft[:, 0]
        logit = means @ lean + self.bias[1] - self.bias[0]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        if widest:
            learns = (logit == np.maximum.reduceat(logit, first)[of]).astype(float)
        else:
            learns = np.ones(len(of))
        learns /= np.add.reduceat(learns, first)[of]
        error = weights[of] * learns * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[of]) / len(docs)
        of_word = np.bincount(seq, weights=(error / lengths)[segment], minlength=len(words)) * SCALE * shares
        grad = np.bincount(buckets, weights=of_word[owners])
        at = np.flatnonzero(grad)
        moves = grad[at, None] * lean
        self.moved[at] += (moves * moves).mean(axis=1)
        self.table[at] -= (rate * moves / np.sqrt(self.moved[at] + DAMP)[:, None]).astype(np.float32)
        up = means.T @ error
        self.soft_moved += np.float32((up * up).mean())
        up = (0.3 * rate * up / np.sqrt(self.soft_moved + 1e-8)).astype(np.float32)
        self.soft += np.stack([up, -up], 1)
        empty = 1 / (1 + np.exp(-float(self.bias[1] - self.bias[0]))) / len(docs)  # a clean document without words in each step
        self.bias += np.array([1, -1], np.float32) * np.float32(0.3 * (error.sum() + empty))

    def calibrate(self, logit: np.ndarray, labels: np.ndarray, prior: float) -> None:
        """Slope and offset by logistic regression over documents not trained on, held near (1, 0) where there are few; prior:
        how much likelier the toxic class is than in the training, as the log of the ratio of odds."""
        x = np.stack([logit, np.ones(len(logit))], 1)
        counts = np.bincount(labels.astype(int), minlength=2)
        weight = np.where(labels == 1, len(labels) / max(1, 2 * counts[1]), len(labels) / max(1, 2 * counts[0]))
        base, hold = np.array([1.0, 0.0]), np.array([0.1, 0.1])
        theta = base.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            grad = x.T @ (weight * (p - labels)) + hold * (theta - base)
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold)
            move = np.linalg.solve(hess, grad)
            theta -= np.clip(move, -2, 2)
        self.slope, self.offset = max(0.1, float(theta[0])), float(theta[1]) + prior


class Scorer:
    """Scores texts; keeps words' shares of the logit."""

    def __init__(self, model: Model):
        self.weights = (model.table @ (model.soft[:, 1] - model.soft[:, 0]) * SCALE * model.slope).astype(np.float32)
        self.bias = float(model.bias[1] - model.bias[0]) * model.slope + model.offset
        self.known: dict[str, float] = {}

    def learn(self, words: set[str]) -> None:
        known = self.known
        if missed := [w for w in words if w not in known]:
            if len(known) + len(missed) > KEPT:
                known.clear()
                missed = list(words)
            for a in range(0, len(missed), AT_ONCE):
                part = missed[a : a + AT_ONCE]
                buckets, owners = subwords(part)
                means = np.bincount(owners, weights=self.weights[buckets]) / np.bincount(owners)
                known.update(zip(part, means.tolist(), strict=True))

    def logits(self, texts: list[str], size: int) -> np.ndarray:
        split = [segments(text, size) for text in texts]
        self.learn({w for segs in split for words in segs for w in words})
        share = self.known.__getitem__
        return np.array([max(sum(map(share, set(words))) / max(1, len(words)) for words in segs) for segs in split]) + self.bias

    def scores(self, texts: list[str], size: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts, size), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", per_class: int = 5000, segment: int = SEGMENT) -> Model:
    """The model of at most per_class labelled documents of each class, none of them held out."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(label_id))
    known = known.groupBy(F.col(label_id).cast("bigint").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    counts = {y: n for y, n in known.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Model.constant(share)
    order = [F.xxhash64("id", F.lit(11)), F.col("id")]
    chosen = known.where("y = 0").orderBy(*order).limit(per_class).unionAll(known.where("y = 1").orderBy(*order).limit(per_class))
    # At most 2 * per_class ids: a bounded broadcast; the smallest text stands for an id that several rows have.
    sample = docs.select(F.col(id_col).cast("bigint").alias("id"), as_text(text_col).alias("text"))
    sample = sample.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    sample = sample.withColumn("tells", F.pmod(F.xxhash64("id", F.lit(12)), F.lit(8)) == 0)  # not trained on
    # Lost partitions are made again from the tables; order by a hash, so that they are made alike.
    parts = max(1, min(PARTS, sum(min(k, per_class) for k in counts.values()) // PART))
    sample = sample.repartition(parts, "id").sortWithinPartitions(F.xxhash64("id", F.lit(13)), "id")
    sample = sample.coalesce(parts).persist()  # so many models at most, whatever the session's least number of partitions
    sizes = {(r["y"], r["tells"]): r["count"] for r in sample.groupBy("y", "tells").count().collect()}
    n = [sizes.get((y, False), 0) for y in (0, 1)]
    if not all(n):
        sample.unpersist()
        return Model.constant(share)
    balance = np.array([sum(n) / (2 * n[0]), sum(n) / (2 * n[1])])

    def learned(shared, round_: int):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, done, steps = shared.value, 0, 0
            model = model.filled(model.packed())  # the broadcast value is shared by the worker's tasks
            rate = RATE * (1 - round_ / (ROUNDS + 1))
            first: list[tuple[list, np.ndarray]] = []  # the first steps, taken again while there are few
            for batch in batches:
                for part in in_slices(batch.filter(pa.compute.invert(batch.column("tells"))), "text", 1 << 20):
                    for a in range(0, part.num_rows, STEP):
                        some = part.slice(a, STEP)
                        own = [segments(t, segment) for t in some.column("text").to_pylist()]
                        y = some.column("y").to_numpy().astype(float)
                        model.step(own, y, balance[y.astype(int)], rate, round_ > 0)
                        done, steps = done + len(y), steps + 1
                        if steps < LEAST_STEPS:
                            first.append((own, y))
                        else:
                            first.clear()
            for k in range(LEAST_STEPS - steps if first else 0):
                own, y = first[k % len(first)]
                model.step(own, y, balance[y.astype(int)], rate, round_ > 0)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64()), pa.array([model.packed()], pa.binary())], ["n", "model"])

        return run

    model = Model()
    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)  # 3 MB, whatever the input
        mean, total = 0.0, 0
        for batch in sample.mapInArrow(learned(shared, round_), "n bigint, model binary").toArrow().to_batches():  # at most PARTS models
            for done, raw in zip(batch.column("n").to_pylist(), batch.column("model"), strict=True):
                mean, total = mean + done * np.frombuffer(raw.as_buffer(), np.float32), total + done
        shared.destroy()
        model = model.filled((mean / total).astype(np.float32).tobytes())

    shared = spark.sparkContext.broadcast(model)

    @tidy
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in in_slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(scorer.logits(part.column("text").to_pylist(), segment))], ["y", "logit"])

    seen = sample.where("tells").select("y", "text").mapInArrow(told, "y int, logit double").toArrow()  # a number for each of an eighth of the sample
    sample.unpersist()
    shared.destroy()
    y = seen["y"].to_numpy().astype(float)
    model.calibrate(seen["logit"].to_numpy(), y, float(np.log(counts[1] / counts[0])))
    return model


def _shared(docs: DataFrame, model: Model):
    import uuid

    return docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # 3 MB


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    shared, key = _shared(docs, model)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), as_text(text_col).alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_held(f"toxicity {key}", lambda: Scorer(shared.value))
        for batch in batches:
            for part in in_slices(batch, "text", SLICE):
                score = scorer.scores(part.column("text").to_pylist(), segment)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7, segment: int = SEGMENT) -> DataFrame:
    """docs without those scored at the threshold or above."""
    shared, key = _shared(docs, model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_held(f"toxicity {key}", lambda: Scorer(shared.value))
        for batch in batches:
            for part in in_slices(batch, text_col, SLICE):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(scorer.scores(texts, segment) < threshold))

    return docs.mapInArrow(run, docs.schema)
