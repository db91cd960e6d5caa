"""Alignment of script units to caption timing, one episode at a time.

Each unit depends on where the one before it ended, so an episode is a fold; episodes are independent and are grouped
with their captions by cogroup. The kernel is plain Python over one episode and needs no Spark.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.similarity import anchors, similarity, span_lengths
from ..functions.text import comparable_each, comparable_text
from ..functions.windows import Neighbours, Text, mixed

#: Fixed values of the matching rules.
MIN_CONFIDENCE, INTERPOLATED = 0.58, 0.25
SHORTEST, SLOWEST = 0.25, 0.55  # seconds of a segment; seconds a character
WINDOW, OCCURRENCES = 2600, 40
PREVIOUS_WEIGHT, NEXT_WEIGHT, DISTANCE_WEIGHT = 0.08, 0.45, 0.18
JUMP_SECONDS, JUMP_PENALTY = 20.0, 0.8
OVERLAP, CUE_SCORE = 5.0, 0.12
EARLY_PART = 0.35  # of a unit: anchors behind it don't place its start
LATE_SECONDS, LATE_SHARE = 2.5, 0.45  # a first anchor so late in its cue is drawn back to this share of the delay
LATIN_LEAD = 1.5
FEW = 6  # windows: so few are compared one by one
FIRST_LOOK = 64  # spans whose contexts are compared first, the most promising ones

_LATIN = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class Unit:
    index: int
    block: int
    text: str
    norm: str
    reading: str = ""  # normalised


@dataclass(frozen=True)
class Lattice:
    """Caption characters and their times, and the cues they came from."""

    text: str
    starts: list[float]
    ends: list[float]
    cues: list[tuple[float, float, str]] = field(default_factory=list)

    @cached_property
    def windows(self) -> Text:
        return Text(self.text)

    @cached_property
    def times(self) -> np.ndarray:
        return np.array(self.starts)


@dataclass(frozen=True)
class Draft:
    unit: Unit
    start: float
    end: float
    confidence: float
    source: str


@dataclass(frozen=True)
class Candidate:
    at: int
    length: int
    confidence: float
    score: float
    by: str = "surface"  # or reading: which lattice the span is of


def milli(x: float) -> float:
    return math.floor(x * 1000 + 0.5) / 1000


def lattice(cues: Iterable[tuple[float, float, str]]) -> Lattice:
    chars, starts, ends, kept = [], [], [], []
    for start, end, text in cues:
        kept.append((start, end, text))
        own = comparable_each(text)
        each = max((end - start) / len(own), 0.05) if own else 0
        chars.append(own)
        starts += [start + i * each for i in range(len(own))]
        ends += [start + i * each for i in range(1, len(own) + 1)]
    return Lattice("".join(chars), starts, ends, kept)


def reading_lattice(cues: Iterable[tuple[float, float, str]]) -> Lattice:
    """The phonetic twin of a lattice: cues with their readings as text; one without a reading is left out."""
    chars, starts, ends, kept = [], [], [], []
    for start, end, reading in cues:
        own = comparable_text(reading)
        if not own:
            continue
        kept.append((start, end, own)), chars.append(own)
        each = (max(end, start + 0.05) - start) / len(own)
        starts += [start + i * each for i in range(len(own))]
        ends += [start + (i + 1) * each for i in range(len(own))]
    return Lattice("".join(chars), starts, ends, kept)


def _occurrences(text: str, part: str, low: int, high: int) -> Iterable[int]:
    at = text.find(part, low)
    while 0 <= at < high:
        yield at
        at = text.find(part, at + 1)


def _window(context: str) -> int:
    return min(220, max(30, math.ceil(1.8 * len(context)) + 24))


def _all_there(context: str, near: str) -> float | None:
    """The similarity of a neighbour's text, its first 120 characters, and what is near, if that has all of these; else
    None. Fewer than six characters don't count."""
    a, n = context[:120], min(120, len(context))
    if n < 6:
        return 0.0
    return float(mixed(n, len(near), n, n - 1)) if a in near else None


def best_candidate(needle: str, before: str, after: str, lat: Lattice, cursor: int, previous_end: float, matched: bool) -> Candidate | None:
    """The span of a lattice's text with the highest score; the first one wins ties.

    All spans are scored with the most that their contexts can add; contexts are compared only for those that may still
    be the best, until that is one whose contexts are known.
    """
    text = lat.text
    if not needle or not text:
        return None
    low = max(0, cursor - 25)
    high = min(len(text), low + WINDOW + len(needle))
    found = {at - offset for part, offset in anchors(needle) for at in islice(_occurrences(text, part, low, high), OCCURRENCES)}
    found = sorted({max(0, at) for at in found})  # a part at the window's start may belong to a span that begins before it
    n, behind, ahead = len(needle), _window(before), _window(after)
    lengths = span_lengths(n, 2 * n + 19)  # all of them
    if len(found) == 1 and text.startswith(needle, found[0]) and found[0] + lengths[-1] + ahead <= len(text):
        # with all that follows there too, other lengths score less, as what follows them is as much text
        at = found[0]
        previous, following = _all_there(before, text[max(0, at - behind) : at]), _all_there(after, text[at + n : at + n + ahead])
        if previous is not None and following is not None:
            jump = JUMP_PENALTY if matched and lat.starts[at] - previous_end > JUMP_SECONDS else 0.0
            score = 1.0 + (-DISTANCE_WEIGHT * min(abs(at - cursor), WINDOW) / WINDOW + PREVIOUS_WEIGHT * previous - jump)
            return Candidate(at, n, 1.0, score + NEXT_WEIGHT * following)
    starts, lengths = np.array(found or range(low, high, max(1, n // 3))), np.array(lengths)
    starts = starts[starts + lengths[0] <= len(text)]
    if not len(starts):
        return None
    common, shared = lat.windows.prefixes(needle, starts, lengths)
    confidence = 0.65 * 2 * common / (n + lengths) + 0.35 * 2 * shared / np.maximum(1, max(1, n - 1) + lengths - 1)
    confidence[(lengths == n) & (common == n)] = 1.0
    ends = starts[:, None] + lengths
    confidence[ends > len(text)] = -np.inf
    np.minimum(ends, len(text), out=ends)
    fixed = -DISTANCE_WEIGHT * np.minimum(np.abs(starts - cursor), WINDOW) / WINDOW
    jump = np.where(matched & (lat.times[starts] - previous_end > JUMP_SECONDS), JUMP_PENALTY, 0.0)
    previous = Neighbours(lat.windows, before[:120], int(starts[0]) - behind, int(starts[-1]) - behind, behind) if len(before) >= 6 else None
    following = Neighbours(lat.windows, after[:120], int(ends[0, 0]), int(ends.max()), ahead) if len(after) >= 6 else None
    most = FIRST_LOOK
    while True:
        score, sure = confidence, np.ones_like(confidence, bool)
        if previous:
            at = starts - behind - previous.first
            score, sure = score + (fixed + PREVIOUS_WEIGHT * previous.value[at] - jump)[:, None], sure & previous.known[at][:, None]
        else:
            score = score + (fixed - jump)[:, None]
        if following:  # what follows only depends on where a span ends
            score, sure = score + NEXT_WEIGHT * following.value[ends - following.first], sure & following.known[ends - following.first]
        i, j = divmod(int(np.argmax(score)), len(lengths))
        if sure[i, j]:
            return Candidate(int(starts[i]), int(lengths[j]), float(confidence[i, j]), float(score[i, j]))
        rest = np.flatnonzero(~sure & (score >= np.where(sure, score, -np.inf).max()))
        if len(rest) > most:
            rest = rest[np.argpartition(-score.ravel()[rest], most)[:most]]
        if previous:
            previous.find(starts[rest // len(lengths)] - behind)
        if following:
            following.find(ends.ravel()[rest])
        most *= 4


def chosen(surface: Candidate | None, reading: Candidate | None) -> Candidate | None:
    """The better of the two lattices' candidates; a reading has to be strictly better than the surface."""
    if reading and (surface is None or reading.score > surface.score):
        return replace(reading, by="reading")
    return surface


def _cursor(lat: Lattice, previous_end: float) -> int:
    """The first character that ends after the last match, less a second and a half."""
    return max(0, min(bisect.bisect_left(lat.ends, max(0.0, previous_end - 1.5)), len(lat.text) - 1))


def _timing(c: Candidate, lat: Lattice) -> tuple[float, float]:
    start = lat.starts[c.at]
    return start, max(lat.ends[min(c.at + c.length, len(lat.ends)) - 1], start + SHORTEST)


def interpolate(units: list[Unit], start: float, end: float, limit: float = 12.0) -> list[Draft]:
    """Units spread over a gap by their characters; empty if they don't fit or the gap is far too long for them."""
    chars = [max(1, len(u.norm)) for u in units]
    gap, n = end - start, len(units)
    if not n or gap < SHORTEST * n or gap > max(limit, SLOWEST * sum(chars)):
        return []
    at = start + (min(3.0, 0.2 * gap) if n > 1 and gap > 6 else 0.0)
    out = []
    for i, u in enumerate(units):
        share = end - at if i == n - 1 else max(SHORTEST, (end - at) * chars[i] / sum(chars[i:]))
        stop = milli(min(at + share, end - SHORTEST * (n - 1 - i)))
        out.append(Draft(u, milli(at), stop, INTERPOLATED, "interpolated"))
        at = stop
    return out


@dataclass(frozen=True)
class Spoken:
    """Characters of the cues of a gap: each is spoken for an even share of its own cue."""

    text: str
    times: list[tuple[float, float, float]]  # start, end, start of the cue

    @cached_property
    def windows(self) -> Text:
        return Text(self.text)

    def similarities(self, a: str, starts: list[int], width: int) -> list[float]:
        """similarity of a and the text's windows of a width."""
        if len(starts) < FEW:
            return [similarity(a, self.text[at : at + width]) for at in starts]
        found = Neighbours(self.windows, a, starts[0], starts[-1], width)
        found.find(np.array(starts))
        return [float(found.value[at - starts[0]]) for at in starts]


def spoken(lat: Lattice, low: float, high: float) -> Spoken:
    """The cues that overlap a stretch of time."""
    chars, times = [], []
    for start, end, text in lat.cues:
        if end < low or start > high:
            continue
        own = comparable_text(text)
        each = max(end - start, 0.05) / max(1, len(own))
        chars.append(own)
        times += [(start + i * each, start + (i + 1) * each, start) for i in range(len(own))]
    return Spoken("".join(chars), times)


def _cue_parts(needle: str) -> list[tuple[str, int]]:
    """Parts near a unit's beginning and their offsets, longest first: its head at five lengths, shifted heads, general anchors that lie early, a first Latin word."""
    parts = [(needle[:n], 0) for n in (8, 6, 4, 3, 2) if len(needle) >= n]
    parts += [(needle[o : o + 8], o) for o in (1, 2, 3, 4) if len(needle) >= o + 4]
    parts += [(p, o) for p, o in anchors(needle) if o <= EARLY_PART * len(needle)]
    if (word := _LATIN.match(needle)) and len(word[0]) > 1:
        parts.append((word[0][:8], 0))
    return sorted(dict.fromkeys(parts), key=lambda p: -len(p[0]))


def anchor_in(unit: Unit, cues: Spoken, low: float, high: float) -> tuple[float, float] | None:
    """(start, score) of the best place in a time window where a part of the unit's beginning occurs; a Latin unit without one goes just before the first Latin character."""
    best, needle = None, unit.norm
    for part, offset in _cue_parts(needle):
        share = 0.3 * len(part) / min(8, max(1, len(needle)))
        if best is not None and 0.7 + share <= best[1]:
            continue  # not even an equal window
        places = [at for at in _occurrences(cues.text, part, 0, len(cues.text)) if not (cues.times[at][1] < low or cues.times[at][0] > high)]
        for at, alike in zip(places, cues.similarities(needle[offset:], places, max(len(needle) - offset, len(part) + 16)), strict=True):
            score = 0.7 * alike + share
            if best is None or score > best[1]:
                start, end, cue = cues.times[at]
                late = offset == 0 and not _LATIN.match(part) and start - cue > LATE_SECONDS
                placed = cue + LATE_SHARE * (start - cue) if late else start - offset * min(0.25, max(0.04, end - start))
                best = (max(0.0, placed), score)
    if best is None and _LATIN.fullmatch(needle):
        first = next((t[0] for c, t in zip(cues.text, cues.times, strict=True) if _LATIN.match(c) and low <= t[0] <= high), None)
        best = None if first is None else (max(low, first - LATIN_LEAD), CUE_SCORE)
    return best


def cue_anchor(unit: Unit, lat: Lattice, low: float, high: float) -> tuple[float, float] | None:
    return anchor_in(unit, spoken(lat, low, high), low, high)


def anchored(units: list[Unit], rejected: dict[int, tuple[float, float, float]], lat: Lattice, start: float, end: float) -> list[Draft]:
    """Units placed at cue anchors within a gap; what has none is put between its neighbours."""
    places: list[float | None] = []
    low = max(0.0, start - OVERLAP)
    cues = spoken(lat, low, end)
    if not cues.text:
        return []
    for u in units:
        found = anchor_in(u, cues, low, end)
        if found and found[1] >= CUE_SCORE:
            places.append(found[0])
        else:
            r = rejected.get(u.index)
            places.append(r[0] if r and r[2] >= MIN_CONFIDENCE else None)
    if all(p is None for p in places):
        return []
    weights = [0.0]
    for u in units:
        weights.append(weights[-1] + max(1, len(u.norm)))
    known = [(-1, start, 0.0), *((i, p, weights[i]) for i, p in enumerate(places) if p is not None), (len(units), end, weights[-1])]
    out: list[Draft] = []
    for i, u in enumerate(units):
        at = places[i]
        if at is None:
            a, b = max(k for k in known if k[0] < i), min(k for k in known if k[0] > i)
            at = a[1] + (b[1] - a[1]) * (weights[i] - a[2]) / max(1.0, b[2] - a[2])
        if out and (at < out[-1].start or out[-1].end - at > OVERLAP):
            at = out[-1].end
        following = next((p for p in places[i + 1 :] if p is not None), None) if i + 1 < len(units) else end
        stop = following if following is not None and following > at else at + max(1.0, 0.08 * len(u.norm))
        out.append(Draft(u, milli(at), milli(max(stop, at + SHORTEST)), INTERPOLATED, "caption" if places[i] is not None else "interpolated"))
    return out


def rescued(units: list[Unit], rejected: dict[int, tuple[float, float, float]], start: float, end: float) -> list[Draft]:
    """All units at their rejected candidates, or none."""
    out: list[Draft] = []
    for u in units:
        r = rejected.get(u.index)
        if not r or r[2] < 0.45 or r[1] > end or r[1] - r[0] < min(2.5, max(0.75, 0.05 * len(u.norm))):
            return []
        before = out[-1] if out else None
        if r[0] < (before.start if before else start - OVERLAP) or before and before.end - r[0] > OVERLAP:
            return []
        out.append(Draft(u, milli(r[0]), milli(r[1]), r[2], "caption"))
    return out


def monotonic(drafts: list[Draft]) -> list[Draft]:
    """Overlaps removed: a caption's small overlap trims the row before it, others are pushed behind it."""
    out: list[Draft] = []
    for d in drafts:
        if out and d.start < out[-1].end:
            last = out[-1]
            if d.source == "caption" and last.end - d.start <= OVERLAP and d.start - last.start >= SHORTEST:
                out[-1] = replace(last, end=d.start)
            else:
                d = replace(d, start=last.end)
        out.append(replace(d, end=max(d.end, milli(d.start + SHORTEST))))
    return out


def align(units: list[Unit], lat: Lattice, readings: Lattice | None = None) -> tuple[list[Draft], list[tuple[Unit, str]]]:
    """(drafts in order, units that could not be placed with the reason). Units are looked for in the captions' text and,
    if there are readings, in these as well; gaps are filled from the captions' text only."""
    matches: list[Draft] = []
    reasons: dict[int, str] = {}
    rejected: dict[int, tuple[float, float, float]] = {}
    previous_end = 0.0
    for k, unit in enumerate(units):
        if not lat.text:
            reasons[unit.index] = "empty-caption-lattice"
            continue
        last = units[k - 1] if k and units[k - 1].block == unit.block else None
        coming, n = [], 0
        for later in units[k + 1 :]:
            if later.block != unit.block or n >= 80:
                break
            coming.append(later)
            n += len(later.norm)
        rest = (previous_end, bool(matches))
        found = best_candidate(unit.norm, last.norm if last else "", "".join(u.norm for u in coming), lat, _cursor(lat, previous_end), *rest)
        if readings and unit.reading:
            found = chosen(found, best_candidate(unit.reading, last.reading if last else "", "".join(u.reading for u in coming), readings, _cursor(readings, previous_end), *rest))
        if found is None:
            reasons[unit.index] = "no-candidate"
            continue
        start, end = _timing(found, readings if found.by == "reading" else lat)
        if found.confidence >= MIN_CONFIDENCE or found.score >= MIN_CONFIDENCE + 0.05:
            start = milli(max(milli(start), previous_end))
            matches.append(Draft(unit, start, milli(max(milli(end), start + SHORTEST)), min(1.0, found.confidence), "caption"))
            previous_end = matches[-1].end
        else:
            reasons[unit.index] = "below-threshold"
            rejected[unit.index] = (start, end, found.confidence)
    order = {u.index: k for k, u in enumerate(units)}
    out: list[Draft] = []
    for i, match in enumerate(matches):
        out.append(match)
        following = matches[i + 1] if i + 1 < len(matches) else None
        a, b = order[match.unit.index] + 1, order[following.unit.index] if following else len(units)
        gap = units[a:b]
        if not gap:
            continue
        if following is None:
            if len(gap) <= 3:
                chars = sum(max(1, len(u.norm)) for u in gap)
                out += interpolate(gap, match.end, match.end + min(10.0, max(len(gap), 0.08 * chars)))
            continue
        fill = anchored(gap, rejected, lat, match.end, following.start) or rescued(gap, rejected, match.end, following.start) or interpolate(gap, match.end, following.start)
        if not fill and i and len(gap) <= 12:
            borrowed = interpolate([match.unit, *gap], matches[i - 1].end, following.start, 18.0)
            if borrowed:
                out[-1:] = borrowed
                continue
        out += fill
    drafts = monotonic(out)
    placed = {d.unit.index for d in drafts}
    return drafts, [(u, reasons.get(u.index, "unplaced")) for u in units if u.index not in placed]


SCHEMA = "episode bigint, local_index int, unit_index int, text string, start double, end double, confidence double, timing_source string, issue string"
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in map(str.split, SCHEMA.split(", "))])


def _numbers(column: pa.ChunkedArray) -> list[float]:
    """The values; one that is null is not a number."""
    return [math.nan if x is None else x for x in column.to_pylist()]


def _texts(table: pa.Table, name: str) -> list[str]:
    return [x or "" for x in table[name].to_pylist()]


def aligned(units: DataFrame, cues: DataFrame) -> DataFrame:
    """Segments and issues of all episodes: units (episode, unit_index, block, text), cues (episode, start, end, text).

    If both have a column `reading`, the phonetic lattice is searched too. An episode that fails is one row with the
    issue "failed" and what went wrong as its text; the others are not touched by it.

    Episodes are dealt to as many tasks as the session has shuffle partitions, whatever their bytes: they are few bytes and
    much work, so tasks made from bytes are few and uneven.
    """
    phonetic = "reading" in units.columns and "reading" in cues.columns

    def rows_of(episode: int, u: pa.Table, c: pa.Table) -> list[tuple]:
        numbers, blocks, texts = _numbers(u["unit_index"]), _numbers(u["block"]), _texts(u, "text")
        spoken_as = _texts(u, "reading") if phonetic else [""] * len(texts)
        own = [Unit(int(numbers[i]), int(blocks[i]), texts[i], comparable_text(texts[i]), comparable_text(spoken_as[i])) for i in np.argsort(numbers, kind="stable")]
        starts, ends = _numbers(c["start"]), _numbers(c["end"])
        order = np.lexsort((ends, starts))
        of = lambda texts: [(float(starts[i]), float(ends[i]), texts[i]) for i in order]
        drafts, issues = align([x for x in own if x.norm], lattice(of(_texts(c, "text"))), reading_lattice(of(_texts(c, "reading"))) if phonetic else None)
        out = [(episode, i, d.unit.index, d.unit.text, d.start, d.end, milli(d.confidence), d.source, None) for i, d in enumerate(drafts)]
        return out + [(episode, None, x.index, x.text, None, None, None, None, why) for x, why in issues]

    def one(key: tuple[pa.Scalar, ...], u: pa.Table, c: pa.Table) -> pa.Table:
        episode = key[0].as_py()
        try:
            out = rows_of(episode, u, c)
        except Exception as e:  # of this episode's data only; it becomes its result
            out = [(episode, None, None, f"{type(e).__name__}: {e}", None, None, None, None, "failed")]
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), _ARROW.types, strict=True)], _ARROW) if out else _ARROW.empty_table()

    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units, cues = units.repartition(tasks, "episode"), cues.repartition(tasks, "episode")
    return units.groupBy("episode").cogroup(cues.groupBy("episode")).applyInArrow(one, SCHEMA)
