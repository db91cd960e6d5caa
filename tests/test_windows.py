"""The alignment's kernel, which compares a string with many windows at once, against one comparison after the other."""

import random
import re
import sys
from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from kumoji.functions import similarity as sim
from kumoji.functions import text, windows
from kumoji.operators import align


def drawn(rng, n, letters="abcdé語😀"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(params=[None, 300])
def limits(request, monkeypatch):
    """As they are, and so low that windows are compared a few at a time."""
    if request.param:
        monkeypatch.setattr(windows, "TABLE_BITS", request.param)


def test_windows_against_single_comparisons(limits):
    rng = random.Random(7)
    for _ in range(150):
        a, b = drawn(rng, rng.choice([1, 2, 3, 9, 40]), rng.choice(["ab", "abcdé語😀xyz"])), drawn(rng, rng.choice([1, 2, 17, 90]), rng.choice(["ab", "abcdé語😀"]))
        t, width = windows.Text(b), rng.choice([1, 2, 8, 30, 120])
        first = rng.randint(-width, len(b) - 1)
        last = rng.randint(first, len(b))
        near = windows.Neighbours(t, a, first, last, width)
        want = [sim.similarity(a, b[max(0, s) : max(0, s + width)]) for s in range(first, last + 1)]
        assert all(x >= y for x, y in zip(near.value, want, strict=True))  # the most that it can be
        some = np.array(sorted({first, last, rng.randint(first, last)}))
        near.find(some)
        assert near.value[some - first].tolist() == [want[s - first] for s in some] and near.known.sum() == len(some)
        near.find(np.arange(first, last + 1))
        assert near.value.tolist() == want
        starts = np.array(sorted(rng.sample(range(len(b)), min(len(b), 5))))
        lengths = np.array(sorted(rng.sample(range(1, 60), 7)))
        common, shared = t.prefixes(a, starts, lengths)
        for i, s in enumerate(starts):
            for j, n in enumerate(lengths):
                assert common[i, j] == sim.lcs_length(a, b[s : s + n])
                if s + n <= len(b):
                    assert shared[i, j] == sim.prefix_shared_bigrams(a, b[s : s + n])[-1]


def all_spans(needle, before, after, lat, cursor, previous_end, matched):
    """best_candidate by its definition: every span with both contexts."""
    body, n, low = lat.text, len(needle), max(0, cursor - 25)
    high = min(len(body), low + align.WINDOW + n)
    starts = {at - o for part, o in sim.anchors(needle) for at in islice(align._occurrences(body, part, low, high), align.OCCURRENCES)}
    starts = sorted({max(0, at) for at in starts}) or range(low, high, max(1, n // 3))
    like = lambda a, b: 0.0 if len(a) < 6 else sim.similarity(a[:120], b)
    best = None
    for at in starts:
        fixed = -align.DISTANCE_WEIGHT * min(abs(at - cursor), align.WINDOW) / align.WINDOW + align.PREVIOUS_WEIGHT * like(before, body[max(0, at - align._window(before)) : at])
        fixed -= align.JUMP_PENALTY if matched and lat.starts[at] - previous_end > align.JUMP_SECONDS else 0.0
        for length in sim.span_lengths(n, len(body) - at):
            span, end = body[at : at + length], at + length
            shared = sim.prefix_shared_bigrams(needle, span)[-1]
            confidence = 1.0 if span == needle else 0.65 * 2 * sim.lcs_length(needle, span) / (n + length) + 0.35 * 2 * shared / max(1, max(1, n - 1) + length - 1)
            score = confidence + fixed + align.NEXT_WEIGHT * like(after, body[end : end + align._window(after)])
            if best is None or score > best.score:
                best = align.Candidate(at, length, confidence, score)
    return best


def test_best_candidate_against_all_spans(limits):
    rng = random.Random(11)
    for k in range(120):
        letters = rng.choice(["ab", "abcde", "abcdefghijklmnopé語"])
        units = [drawn(rng, rng.choice([1, 2, 5, 14, 30, 60]), letters) for _ in range(rng.randint(1, 9))]
        noisy = units if k % 3 == 0 else [u.translate({ord("b"): "y"}) if k % 3 == 1 else "".join(c for c in u if rng.random() > 0.2) for u in units]
        lat = align.lattice([(i * 9.0, i * 9.0 + 8, u) for i, u in enumerate(noisy)])
        i = rng.randrange(len(units))
        own = (units[i], units[i - 1] if i and rng.random() < 0.8 else "", "".join(units[i + 1 :])[: rng.choice([0, 4, 50, 200])], lat, rng.randint(0, max(0, len(lat.text) - 1)), rng.choice([0.0, 9.0]), rng.random() < 0.5)
        assert align.best_candidate(*own) == (all_spans(*own) if lat.text else None)


def test_cue_anchors_against_single_comparisons():
    rng = random.Random(13)
    for _ in range(60):
        letters = rng.choice(["ab", "abcdé"])
        cues = align.spoken(align.lattice([(i * 3.0, i * 3.0 + 2, drawn(rng, rng.randint(1, 40), letters)) for i in range(rng.randint(1, 12))]), 0.0, 30.0)
        norm, low, high = drawn(rng, rng.randint(1, 40), letters), rng.choice([0.0, 5.0]), rng.choice([8.0, 30.0])
        best = None
        for part, offset in align._cue_parts(norm):
            for at in align._occurrences(cues.text, part, 0, len(cues.text)):
                if cues.times[at][1] >= low and cues.times[at][0] <= high:
                    near = cues.text[at : at + max(len(norm) - offset, len(part) + 16)]
                    best = max(best or 0.0, 0.7 * sim.similarity(norm[offset:], near) + 0.3 * len(part) / min(8, len(norm)))
        found = align.anchor_in(align.Unit(0, 0, norm, norm), cues, low, high)
        if best is None:
            assert found is None or found[1] == align.CUE_SCORE
        else:
            assert found[1] == best


def test_an_episode_takes_few_steps():
    """Calls made for an episode whose captions lack its accents; they were 56,967 for a unit."""
    rng, syllables = random.Random(17), ["que", "é", "ment", "la", "è", "tion", "en", "re", "vi", "ou"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(10, 40))) for _ in range(60)]
    units = [align.Unit(i, i // 6, w, text.comparable_text(w)) for i, w in enumerate(words)]
    cues = [(i * 8.0, i * 8.0 + 7.5, "".join(words[6 * i : 6 * i + 6]).translate(str.maketrans("éè", "ee"))) for i in range(10)]
    calls = 0

    def count(_, event, __):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        drafts, issues = align.align(units, align.lattice(cues))
    finally:
        sys.setprofile(None)
    assert len({d.unit.index for d in drafts} | {u.index for u, _ in issues}) == 60
    assert calls < 6_000 * 60


def test_episodes_are_dealt_to_all_tasks(spark):
    """A few bytes of many episodes were one task."""
    units = spark.createDataFrame([(i, 0, 0, "nobody knows what comes next") for i in range(40)], "episode bigint, unit_index int, block int, text string")
    cues = spark.createDataFrame([(i, 0.0, 4.0, "nobody knows what comes next") for i in range(40)], "episode bigint, start double, end double, text string")
    found = align.aligned(units, cues)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.episode, r.confidence) for r in found.collect()) == [(i, 1.0) for i in range(40)]


def test_episodes_with_nulls_and_one_side_only(spark):
    units = spark.createDataFrame([(1, 0, 0, None), (1, 1, 0, "nobody knows what comes next"), (2, None, 0, "x"), (3, 0, 0, "alone")], "episode bigint, unit_index int, block int, text string")
    cues = spark.createDataFrame([(1, 0.0, 4.0, None), (1, 5.0, 9.0, "nobody knows what comes next"), (2, 0.0, 1.0, "x"), (4, None, None, "alone"), (None, 0.0, 1.0, "x")], "episode bigint, start double, end double, text string")
    got = sorted((r.episode, r.unit_index, r.text, r.issue) for r in align.aligned(units, cues).collect())
    assert got == [(1, 1, "nobody knows what comes next", None), (2, None, "ValueError: cannot convert float NaN to integer", "failed"), (3, 0, "alone", "empty-caption-lattice")]


def test_comparable_characters():
    composed, apart = "caf\u00e9", "cafe\u0301"
    assert text.comparable_text("Ｃａｆe\u0301 5 ｶﾞー!") == composed + "5ガー"
    assert text.comparable_each(apart) == "cafe" and text.comparable_each("ｶﾞ㌢ İ") == "カセンチi\u0307"


def test_sentences_of_any_characters(spark):
    """The class of what ends no sentence is written as ranges; it is the same as the negated list."""
    rng, near = random.Random(19), [chr(ord(c) + d) for c in "。！？!?.\n" for d in (-1, 1)] + [" ", "\x00", "é", "￿", "😀", "\U0010ffff"]
    for marks in (text.TERMINATORS, text.TERMINATORS + ".", "😀"):
        rows = [(i, drawn(rng, 30, [*marks, "\n", *near])) for i in range(200)]
        got = spark.createDataFrame(rows, "i int, t string").select("i", text.sentences(F.col("t"), marks).alias("s")).collect()
        pattern = re.compile(rf"[^{re.escape(marks)}\n]+[{re.escape(marks)}]*")
        want = {i: [s for s in (x.strip(" ") for x in pattern.findall(t)) if s and not re.search(text.STRUCTURAL, s)] for i, t in rows}
        assert {r.i: r.s for r in got} == want
