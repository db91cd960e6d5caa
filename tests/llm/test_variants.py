"""Spelling variants and the FM-index below them, against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from kumoji.llm import variants
from kumoji.llm.fmindex import near


def near_pairs(words):
    """All pairs with one inserted, deleted or replaced character, by trying every edit."""
    own, found = set(words), set()
    letters = sorted({c for w in words for c in w})
    for w in words:
        for i in range(len(w) + 1):
            for c in letters:
                found |= {(w, v) for v in (w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]) if v in own and v != w}
            found |= {(w, v) for v in (w[:i] + w[i + 1 :],) if v in own and v != w}
    return found | {(b, a) for a, b in found}


def brute(docs):
    """The contract, word by word."""
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    of = {}
    for a, b in near_pairs(counts):
        of.setdefault(a, []).append(b)
    form = {}
    for w, others in of.items():
        best = min(others, key=lambda v: (-counts[v], v))
        if counts[best] >= 10 * counts[w]:
            form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(of.get(w, [])), counts[form[w]] if w in form else None))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdéÿ") for _ in range(rng.randrange(6, 13))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaaaa", "abababab", "babababa"]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(60)):
            w = rng.choice(stems[: 1 + int(len(stems) * rng.random() ** 3)])
            if rng.random() < 0.1:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + "d" + w[k + 1 :]])
            text.append(w if rng.random() < 0.9 else w.upper())
        rows.append((i, rng.choice([" ", ", ", "1", "Ā"]).join(text)))
    return rows


def test_fm_index_finds_every_near_word():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(2, 8))) for _ in range(700)})
    for side in (0, 1):
        own = variants._Vocabulary(side, [(w.encode(), 1, True) for w in words])
        asking = [w.encode()[::-1] if side else w.encode() for w in words]
        exact = np.array([len(w) // 2 if side else (len(w) + 1) // 2 for w in words])
        raw = np.frombuffer(b"".join(w[::-1] for w in asking), np.uint8)
        q, w = near(own.index, variants._CODES[raw], np.concatenate([[0], np.cumsum([len(x) for x in asking])]), exact)
        got = {(words[a], own.turned(own.words[b]).decode()) for a, b in zip(q.tolist(), w.tolist(), strict=True)}
        half = lambda x, n, side=side: x[:n] if side else x[len(x) - n :]
        want = {(a, b) for a, b in near_pairs(words) if len(b) >= len(a) and half(a, len(a) // 2 if side else (len(a) + 1) // 2) == half(b, len(a) // 2 if side else (len(a) + 1) // 2)}
        assert want <= got <= near_pairs(words)


def test_variants_against_brute_force(spark):
    rows = corpus(1, 400) + [(None, "aaaaaaaa aaaaaaaa"), (7, None), (7, ""), (8, "ABABABAB abababab"), (8, "ABABABAB abababab"), (9, "x" * 3000 + " " + "x" * 3001 + " " + "x" * 3000 + " " + "x" * 3001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for chunk in (variants.CHUNK, 12):  # small: halves that too many words share are dealt anew
        got = [tuple(r) for r in variants.variants(docs, chunk=chunk).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert sum(w[1] is not None for w in want) > 20


def test_chained_forms_and_a_large_half(spark):
    """Forms lead on to their own forms; one half is shared by far more words than a chunk has."""
    rows = [(i, " ".join(["aaaabbbb"] * 3)) for i in range(100)] + [(i, "aaaabbbc aaaabbbc") for i in range(10)] + [(1, "aaaabbcc aaaabbcc")]
    rows += [(i, " ".join("wxyz" + c + d + "abc"[i % 3] for c in "abcdefgh" for d in "ijklmnop")) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert ("aaaabbcc", "aaaabbbc", "aaaabbbb") in {w[:3] for w in want}
    for chunk in (30, variants.CHUNK):
        assert {tuple(r) for r in variants.variants(docs, chunk=chunk).collect()} == want


def test_odd_tables(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    clash = spark.createDataFrame([(1, "wordword wordword wordwore wordwore", 5, "x")], "doc_id long, text string, n int, word string")
    assert variants.variants(clash).columns == ["word", "form", "root", "n", "n_near", "form_n"]
