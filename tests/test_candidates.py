"""Batch deinflection, spans of text for needles, and windows, against plain Python."""

import random

from pyspark.sql import functions as F

from kumoji.functions import similarity as sim
from kumoji.operators import anchor, deinflect


def test_a_column_deinflects_as_a_string_does(spark):
    words = ["食べました", "飲んで", "行かない", "高かった", "書きたかった", "見られない", "待っている", "食べさせられませんでした", "しました", "来た", "猫", "た", "", "って"]
    for table in (deinflect.RULES, deinflect.RULES[::-1], [deinflect.Rule("a", "x", "xy", (), ("v1",)), deinflect.Rule("b", "y", "", ("v1",), ("v5",)), deinflect.Rule("c", "x", "", ("v5",), ("v5",))]):
        own = [*words, "xx", "yx", "x"]
        df = spark.createDataFrame([(w,) for w in [*own, None]], "w string")
        got = {r.w: r.d for r in df.select("w", deinflect.deinflections(F.col("w"), table, 5).alias("d")).collect()}
        assert got.pop(None) is None
        assert {w: [(d.term, tuple(d.reasons)) for d in found] for w, found in got.items()} == {w: deinflect.deinflect(w, table, 5) for w in own}
    plan = df.select(deinflect.deinflections(F.col("w")).alias("d"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_second_derivation_of_another_class_goes_on():
    table = [deinflect.Rule("first", "b", "", (), ("v1",)), deinflect.Rule("other", "b", "", (), ("v5",)), deinflect.Rule("then", "a", "z", ("v5",), ("v5",))]
    assert deinflect.deinflect("ab", table) == [("ab", ()), ("a", ("first",)), ("z", ("then", "other"))]


def test_romanised_rules():
    assert deinflect.romanised("かった") == "katta" and deinflect.romanised("って") == "tte"
    found = dict(deinflect.deinflect("kakitakatta", deinflect.romanised_rules()))
    assert found["kaku"] == ("wish", "past") and "kakitai" in found


def sides(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7))) for _ in range(200)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for k in range(12)] + [(90, ""), (91, None), (92, "  ")]
    docs = []
    for d in range(25):
        own = [rng.choice(words) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            part = (items[rng.randrange(12)][1] or "").split()
            part = [w if rng.random() < 0.9 else "zz" for w in part]
            at = rng.randrange(len(own) + 1)
            own[at:at] = part
        docs.append((d, rng.choice([" ", "  ", "\n"]).join(own)))
    docs += [(90, None), (91, "")]
    return items, docs, spark.createDataFrame(items, "item long, text string"), spark.createDataFrame(docs, "doc long, body string")


def test_windows_and_scores(spark):
    items, docs, left, right = sides(spark)
    args = (left, "item", "text", right, "doc", "body")
    found = anchor.candidates(*args)
    want_items, want_docs = ({k: (t or "").split() for k, t in rows} for rows in (items, docs))
    starts = {(r.item, r.doc, r.start) for r in found.collect()}
    brute = set()
    for k, w in want_items.items():
        g = min(3, len(w))
        for o in {0, (len(w) - g) // 2, len(w) - g} if w else ():
            for d, b in want_docs.items():
                brute |= {(k, d, max(1, p + 1 - o)) for p in range(len(b) - g + 1) if b[p : p + g] == w[o : o + g]}
    assert starts == brute and len(brute) > 20
    got = {(r.item, r.doc, r.start): (r.a, r.b, r.s.lcs, r.s.similarity) for r in anchor.windows(found, *args).withColumn("s", sim.both_similarities("a", "b")).collect()}
    for (k, d, p), (a, b, lcs, mixed) in got.items():
        assert a == " ".join(want_items[k]) and b == " ".join(want_docs[d][p - 1 : p - 1 + len(want_items[k])])
        assert (lcs, mixed) == (sim.lcs(a, b), sim.similarity(a, b))
    assert set(got) == brute


def test_best_spans_against_every_start_and_length(spark):
    items, docs, left, right = sides(spark)
    args = (left, "item", "text", right, "doc", "body")
    found = anchor.candidates(*args)
    want = {}
    texts = {d: (t or "").split() for d, t in docs}
    for r in found.collect():
        needle, words = " ".join(dict(items)[r.item].split()), texts[r.doc]
        text, at = " ".join(words), len(" ".join(words[: r.start - 1])) + (r.start > 1)
        for length in sim.span_lengths(len(needle), len(text) - at):
            rank = (-sim.similarity(needle, text[at : at + length]), at, length)
            if (r.item, r.doc) not in want or rank < want[r.item, r.doc]:
                want[r.item, r.doc] = rank
    got = {(r.item, r.doc): (r.start, r.length, r.confidence) for r in anchor.best_spans(found, *args).collect()}
    assert set(got) == set(want)
    for key, (start, length, confidence) in got.items():
        assert abs(confidence + want[key][0]) < 1e-12 and (start, length) == want[key][1:]
