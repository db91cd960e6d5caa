"""The engine's own operators where they once did less than the whole job."""

import random

from kumoji.operators import align, anchor, timeline


def test_context_reaches_over_any_number_of_blank_rows(spark):
    rng = random.Random(3)
    texts = {1: ["x" * 50, *[""] * 200, "after " * 30, "last"], 2: [None, None, "only", None, "end"], 3: [rng.choice(["", None, "ab", "word " * 9, "y" * 79, "z" * 80]) for _ in range(400)]}
    rows = [(k, i, t) for k, own in texts.items() for i, t in enumerate(own)]
    got = {(r.conv, r.turn): (r.previous, r.following) for r in timeline.context(spark.createDataFrame(rows, "conv int, turn int, text string"), "conv", "turn", "text").collect()}
    for k, own in texts.items():
        for i in range(len(own)):
            ahead, size = [], 0
            for t in own[i + 1 :]:
                if size >= 80:
                    break
                ahead.append(t)
                size += len(t or "")
            assert got[k, i] == (own[i - 1] if i else None, " ".join(t for t in ahead if t is not None))
    assert len(got) == len(rows)


def test_cue_anchor_looks_at_every_occurrence():
    cues = [(float(k), k + 0.9, "abyy") for k in range(60)] + [(60.0, 60.9, "abxd")]  # only "ab" is shared
    found = align.cue_anchor(align.Unit(0, 0, "abcd", "abcd"), align.lattice(cues), 0.0, 100.0)
    assert found[0] == 60.0


def test_anchor_candidates_hold_every_occurrence_in_whole_texts(spark):
    rng = random.Random(5)
    draw = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    needles = [(i, t) for i, t in enumerate([None, "", " \n ", "a", "b c", "a b c", *(draw(n) for n in range(4, 14))])]
    texts = [(i, t) for i, t in enumerate([None, "", "a", "c b", "x\n\ta  b c ", *(draw(n) for n in (3, 9, 40, 400)), "q " * 30_000 + "a b c"])]
    frames = spark.createDataFrame(needles, "item int, t string"), spark.createDataFrame(texts, "doc int, t string")
    sides = (frames[0], "item", "t", frames[1], "doc", "t")
    found = anchor.candidates(*sides)
    want = set()
    for item, t in needles:
        a = (t or "").split()
        g = min(3, len(a))
        for o in {0, (len(a) - g) // 2, len(a) - g} if a else ():
            for doc, u in texts:
                b = (u or "").split()
                want |= {(item, doc, max(p - o, 0) + 1) for p in range(len(b) - g + 1) if b[p : p + g] == a[o : o + g]}
    got = found.collect()
    assert {(r.item, r.doc, r.start) for r in got} == want and len(got) == len(want)
    a, b = dict(needles), dict(texts)
    for r in anchor.windows(found, *sides).collect():
        own = a[r.item].split()
        assert r.a == " ".join(own) and r.b == " ".join(b[r.doc].split()[r.start - 1 : r.start - 1 + len(own)])
    empty = frames[0].where("false")
    assert anchor.candidates(empty, "item", "t", frames[1], "doc", "t").count() == 0
