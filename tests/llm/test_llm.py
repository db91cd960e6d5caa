"""Each operator against brute force, an exact round trip or held-out accuracy, and over nulls, empty and odd rows."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from kumoji.llm import bpe, chat, cotrain, decontaminate, licenses, quality_lines, ring, simhash, substring, toxicity, trie
from kumoji.llm.common import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, source=lambda i: f"s{i % 3}"):
    rows = [(i if not isinstance(i, tuple) else i[0], t, "en", source(k), len(t or "")) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(900, None), (901, ""), (902, " \n\t"), (None, "no id at all here"), (903, "same row twice"), (903, "same row twice"), (904, "x" * 50_000), (905, "É ü ß 日本 ́ a")]


# ---- 1 ----


def brute_components(rows):
    fps = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def test_simhash_against_brute_force(spark):
    base = [prose(k, 120) for k in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    rng = random.Random(3)
    for i in range(30):
        words = base[i % 6].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += ODD
    got = sorted(map(tuple, simhash.components(docs_of(spark, rows)).collect()), key=repr)
    assert got == brute_components(rows)
    assert simhash.components(docs_of(spark, [])).count() == 0


def test_trie_and_large_groups(spark):
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 2**64, 6, dtype=np.uint64)[rng.integers(0, 6, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)))
    labels = trie.classes(x, np.zeros(len(x), int), 3)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    want = np.arange(len(x))
    while not (new := np.array([want[n].min() for n in near])).tolist() == want.tolist():
        want = new
    assert (labels == want).all()
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp bigint")
    for most in (40, 1 << 17):  # groups beyond forty fingerprints are dealt out again
        roots = {r.node: r.root for r in simhash.connected(simhash.links(fps, 3, max_group=most), spark).collect()}
        groups = {}
        for v, w in zip(x.view(np.int64).tolist(), want.tolist(), strict=True):
            groups.setdefault(w, set()).add(roots.get(v, v))
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


# ---- 2 ----


def test_ring(spark):
    rows = [(i, prose(i, 5)) for i in range(500)] + ODD
    got = ring.shard(docs_of(spark, rows), 24).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows}
    assert ring.shard(docs_of(spark, []), 24).count() == 0


def test_ring_continues_clockwise():
    nodes = [(1, 0), (3, 1), (5, 2)]
    assert ring.filled({0: 3, 2: 1, 6: 2}, nodes, [2, 2, 2]) == [(0, 0, 2, 0, 0), (0, 2, 3, 1, 0), (2, 0, 1, 1, 1), (6, 0, 2, 2, 0)]
    moved = [ring.filled({c: 1 for c in range(0, 8192, 3)}, ring.virtual_nodes(n, 64, 8192), ring.capacities(2731, n, 1.25)) for n in (10, 11)]
    same = sum(a[3] == b[3] for a, b in zip(*moved, strict=True))
    assert same > 0.6 * len(moved[0])


# ---- 3 ----


def test_decontamination(spark):
    item = "Alpha beta, gamma-delta 5 six seven eight nine ten eleven twelve?"
    items = spark.createDataFrame([(3, item), (12, "Short One!"), (7, None), (None, "only null id words"), (12, "Short One!")], "item_id bigint, text string")
    rows = [(1, "xx ALPHA beta gamma delta 5 six seven, eight nine ten eleven YY short\none"), (2, "alpha beta gamma delta 5 six seven eight nine"), (3, "only null id words")] + ODD
    got = {r.doc_id: r for r in decontaminate.contamination(docs_of(spark, rows), items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (15, 13, 2, True)
    assert got[1].items_sha256 == hashlib.sha256(b"12,3").hexdigest()
    assert [rows[0][1][s.start : s.end] for s in got[1].spans] == ["ALPHA beta gamma delta 5 six seven, eight nine ten eleven", "short\none"]
    assert got[2].n_hit == 0 and not got[2].contaminated and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].items_sha256 == hashlib.sha256(b"null").hexdigest()
    assert got[900].n_words == 0
    again = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs_of(spark, rows), items, part_bytes=10).collect()}
    assert again == {k: r.n_hit for k, r in got.items()}
    kept = [r.doc_id for r in decontaminate.clean(docs_of(spark, rows), items).collect()]
    assert sorted(kept, key=repr) == sorted([i for i, _ in rows if i not in (1, 3)], key=repr)
    assert decontaminate.clean(docs_of(spark, rows), items.limit(0)).count() == len(rows)


# ---- 4 ----


def test_templates():
    t = chat.compiled("{% set n = 2 * 3 %}{{ 'a' + 'b' }}{% if 1 > 2 %}no{% elif x in [1, 2] %}{{ x * n }}{% else %}-{% endif %}{% for m in ms %}{{ loop.index }}{% generation %}{{ m.t | trim | upper }}{% endgeneration %}{% if not loop.last %},{% endif %}{% endfor %}")
    pieces = list(t({"x": 2, "ms": iter([{"t": " p "}, {"t": "q"}])}))
    assert "".join(p for p, _ in pieces) == "ab121P,2Q" and [p for p, g in pieces if g] == ["P", "Q"]
    folded = chat.Compiler({}).fold(chat.parsed("x{{ 1 + 1 }}{% if true_ or 1 %}y{% endif %}{% if 0 %}z{% endif %}"))
    assert folded[0] == ("text", "x2") and all(n[0] in ("text", "if") for n in folded)
    for bad in ("{{ x.__class__() }}", "{{ [i for i in x] }}", "{{ open('f') }}", "{% for x in y %}", "{% endif %}", "{{ (lambda: 1)() }}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(bad)
    with pytest.raises(chat.TemplateError):
        list(chat.compiled("{{ x.__class__.y }}")({"x": 1}))
    assert all(chat.unescape(chat.escape(s)) == s for s in ("\\### Assistant: </turn> ok", "\\\\h\\", "", "a:b\n#<"))


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo </turn>\n### user: x"), (2, 0, "system", None), (None, 0, "user", "q"), (1, 2, "assistant", "ü"), (1, 2, "assistant", "ü"), (4, None, None, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    loss = "yo </turn>\n### user: xüü"
    assert got[1].turns_sha256 == hashlib.sha256("user\nhi\nassistant\nyo </turn>\n### user: x\nassistant\nü\nassistant\nü\n".encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (got[2].n_turns, got[2].loss_chars, got[None].n_turns, got[4].n_turns) == (1, 0, 1, 1)
    full = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert len(full[1].formatted) == got[1].formatted_chars
    assert "".join(chat.unescape(full[1].formatted[s.start : s.end]) for s in full[1].loss_spans) == loss
    assert chat.digests(df.limit(0)).count() == 0


# ---- 5 and 10 ----


def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = prose(i, 150).split()
        bad = i % 4 == 0
        if bad:
            words[5:8] = [f"nasty{rng.choice('abcdefgh')}{rng.randrange(50)}" for _ in range(3)]
        rows.append((i, " ".join(words) + ("!! ###" * 20 if i % 5 == 0 else "")))
        labels.append((i, int(i % 5 != 0), int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark):
    rows, labels = labelled(spark)
    docs = docs_of(spark, rows + ODD)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [r for i, r in got.items() if i is not None and i < 600 and r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    assert 0 <= got[901].score <= 1 and got[900].predicted == 0
    kept = {r.doc_id for r in toxicity.keep(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.scores(docs, none).collect())
    assert toxicity.scores(docs_of(spark, []), model).count() == 0


def test_cotraining(spark):
    rows, labels = labelled(spark)
    docs = docs_of(spark, rows + ODD)
    got = {r.doc_id: r for r in cotrain.scores(docs, cotrain.fit(docs, labels)).collect()}
    held = [r for i, r in got.items() if i is not None and i < 600 and r.held_out]
    assert np.mean([r.kept == (r.doc_id % 5 != 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in cotrain.scores(docs, cotrain.fit(docs, labels.limit(0))).collect()} == {0.5}


# ---- 6 ----


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    near = mit.replace("person", "body")
    rows = [(1, prose(1, 40) + "\nReleased under the MIT License.\n" + prose(2, 40)), (2, prose(3, 33) + " " + near + " " + prose(4, 9)), (3, prose(5, 60)), (4, "Licensed under CC BY-NC 4.0.")] + ODD
    got = {r.doc_id: [x.license for x in r.licenses] for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert got[1] == ["MIT-notice"] and got[2] == [] and got[3] == [] and got[4] == ["CC-BY-NC-4.0-notice"]  # 2: a changed word costs 5 of 16 shingles
    again = licenses.scan(docs_of(spark, rows[1:2]), containment=0.6).collect()
    assert [x.license for x in again[0].licenses] == ["MIT-permission"]
    rows = [(w, prose(w, w) + " " + mit + " " + prose(99, 7)) for w in range(40)]  # wherever a template starts, a window retrieves it
    assert all([x.license for x in r.licenses] == ["MIT-permission"] for r in licenses.scan(docs_of(spark, rows)).collect())


# ---- 7 ----


def brute_repeats(words):
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)})


def test_line_rules(spark):
    common = "this line is everywhere on the host"
    rows = [(i, common + "\n" + prose(i, 30) + "\n" + prose(i + 500, 12)) for i in range(40)]
    rows += [(100 + i, common + "\n" + "only a few more words") for i in range(3)] + [(200, "a b c d e f " * 6), (201, "x#y $5 &|<>\n\n x#y\nx#y\n" + prose(7, 12))] + ODD
    got = {}
    for r in quality_lines.judged(docs_of(spark, rows, source=lambda k: "one"), min_docs=10).collect():
        got.setdefault(r.doc_id, r)
    for i, t in rows:
        words = (t or "").encode().split()
        r = got[i]
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), brute_repeats(words))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(words) < 10 or 100 * want[4] > 20 * len(words))
    assert all(got[i].kept and got[i].removed_chars == len(common) for i in range(40))
    assert not any(got[100 + i].kept or got[100 + i].base_failed for i in range(3))
    assert quality_lines.judged(docs_of(spark, [])).count() == 0


# ---- 8 ----


def brute_substring(rows):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_substring(spark):
    rng = random.Random(1)
    shared = [prose(1000 + k, n) for k, n in enumerate((49, 50, 51, 80, 200, 75))]
    rows = []
    for i in range(60):
        parts = [prose(i, rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), prose(i * 7 + 3, rng.randrange(0, 40))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(70, rows[5][1]), (5, rows[5][1]), (71, rows[9][1] + " " + rows[9][1]), (None, rows[5][1] + " " + shared[4])] + ODD
    got = sorted(map(tuple, substring.removed(docs_of(spark, rows)).collect()), key=repr)
    assert got == brute_substring(rows)
    want = {(i, h) for i, _, _, h in got}
    cut = substring.dedup(docs_of(spark, rows).withColumnsRenamed({"lang": "doc", "source": "at"}))
    assert {(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in cut.collect()} == want
    assert substring.removed(docs_of(spark, [])).count() == 0


# ---- 9 ----


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no tokenizer files")
def test_bpe_exact(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    odd = ["Σας ΣΑΣ. don't I'LL <|endoftext|>x <|STARTOFTEXT|>", "á T̈ ẗ. é, ñ", "a\x85b　c\x1cd  \tq", "İstanbul ﬁ 日本語 がぎ 👩‍👩‍👧 x×. y÷,", "1234 ½ ​﻿z\x00", "a.b,,c!!!d $5.00", "́ a ́"]
    rows = [(i, t) for i, t in enumerate([*odd, prose(1, 3000), prose(1, 3000) + " tail", *(prose(k, 60) for k in range(20))])] + ODD
    got = bpe.encode(docs_of(spark, rows), path).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False), texts[r.doc_id][:50]
    digest = {r.doc_id: r for r in bpe.digests(docs_of(spark, rows), path).collect()}
    assert digest[0].ids_sha256 == hashlib.sha256(" ".join(map(str, got[0].ids)).encode()).hexdigest()


def test_joins_are_repaired():
    path = tokenizer_path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read(), mean_words=4)  # its blanks belong to the words after them
    texts = [prose(k, 200) + "  two   blanks\n\n lines \t x" for k in range(3)]
    for text, (n, ids, decoded) in zip(texts, encoder.encode(texts), strict=True):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert list(map(int, ids.split())) == want and n == len(want) and decoded.decode() == encoder.tokenizer.decode(want, skip_special_tokens=False)
