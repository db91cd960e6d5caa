"""The llm operators where they once did less than the whole job."""

import random

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

import corpus_pipeline
from kumoji.llm import bpe, common, cotrain, decontaminate, simhash, substring, toxicity, widehash

from test_llm import ODD, docs_of, labelled, prose


def edited(text, rng, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def brute_near(rows, similarity=0.8):
    """(row, what stays of its group), by all pairs of fingerprints and of sets of shingles."""
    fps = [int.from_bytes(widehash.fingerprint(widehash.shingles(t or "", 5)), "big") for _, t in rows]
    budget, label, changed = widehash.budget_for(similarity), list(range(len(rows))), True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if label[j] < label[i] and (a ^ b).bit_count() <= budget and alike(rows[i][1] or "", rows[j][1] or "", similarity):
                    label[i], changed = label[j], True
    best = {}
    for row, k in zip(rows, label, strict=True):
        rank = (row[0] is None, row[0] or 0, signed(xxh64_intdigest((row[1] or "").encode(), 42)))
        if k not in best or rank < best[k][0]:
            best[k] = (rank, (row[0], row[1]))
    return sorted(((row[0], best[k][1]) for row, k in zip(rows, label, strict=True)), key=repr)


def alike(a, b, similarity):
    a, b = (set(widehash.shingles(t, 5).tolist()) for t in (a, b))
    return len(a & b) >= similarity * len(a | b)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def jaccard(a, b):
    a, b = (set(widehash.shingles(t, 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_with_edited_words(spark):
    rng = random.Random(8)
    base = [prose(k, 150, 4000) for k in range(5)]
    rows = list(enumerate(base)) + [(100 + i, edited(base[i % 5], rng, 1 + i // 5 % 9)) for i in range(90)]
    found = {(i, of) for i, of in brute_near(rows)}
    near = [i for i, t in rows[5:] if jaccard(t, base[i % 5]) >= 0.8]
    assert len(near) > 30 and sum((i, (i % 5, base[i % 5])) in found for i in near) >= 0.95 * len(near)
    bits = [(simhash.fingerprint(t) ^ simhash.fingerprint(base[i % 5])).bit_count() for i, t in rows[5:] if i in near]
    assert sum(b > 3 for b in bits) > 5  # op1's three bits miss these
    rows += ODD + [(0, "another text of the id 0"), (None, base[0]), (None, prose(77, 40)), (None, prose(77, 40))]
    want = brute_near(rows)
    for most in (1 << 16, 12):  # tries of over twelve nodes are dealt out in blocks
        got = widehash.components(docs_of(spark, rows), max_group=most).collect()
        assert sorted(((r.doc_id, r.least.doc_id, r.least.version) for r in got), key=repr) == sorted(((i, d, signed(xxh64_intdigest((t or "").encode(), 42))) for i, (d, t) in want), key=repr)
    docs = docs_of(spark, rows).withColumnsRenamed({"lang": "gone_id", "source": "fp", "n_chars": "version"})
    kept = sorted(((r.doc_id, r.text or "") for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=repr)
    assert kept == sorted({(d, t or "") for _, (d, t) in want}, key=repr)
    assert corpus_pipeline.near_dedup(spark, docs_of(spark, []), "").count() == 0


def test_near_copies_at_the_limit():
    rng = np.random.default_rng(4)
    trees, budget, met, linked, far = widehash.trees_for(0.8), widehash.budget_for(0.8), 0, 0, 0
    for _ in range(600):
        x = rng.integers(0, 1 << 64, 440, dtype=np.uint64)
        a, b = np.sort(x[:396]), np.sort(x[44:])  # 352 of 440
        met += bool(set(enumerate(widehash.keys(a, trees))) & set(enumerate(widehash.keys(b, trees))))
        bits = [int.from_bytes(widehash.fingerprint(s), "big") for s in (a, b, np.sort(x[110:]))]  # the third: 286 of 440
        linked += (bits[0] ^ bits[1]).bit_count() <= budget
        far += (bits[0] ^ bits[2]).bit_count() <= budget
    assert met == 600 and linked > 0.92 * 600 and far < 0.1 * 600


def test_toxic_words_beyond_the_first_characters_of_a_text_without_blanks(spark):
    rows, labels = labelled(spark)
    model = toxicity.fit(docs_of(spark, rows), labels)
    texts = []
    for k in range(8):
        words = prose(7000 + k, 150).split()
        bad = [*words[:60], *(f"nasty{c}7" for c in "abcdef"), *words[60:]]
        texts += [glue.join(x) for glue in ("_", "-", "") for x in (words, bad)]
    got = {r.doc_id: r for r in toxicity.scores(docs_of(spark, list(enumerate(texts))), model).collect()}
    assert [got[k].predicted for k in range(len(texts))] == [k % 2 for k in range(len(texts))]
    kept = toxicity.keep(docs_of(spark, list(enumerate(texts))), model).collect()
    assert {r.doc_id for r in kept} == set(range(0, len(texts), 2))


def test_every_ngram_of_a_long_word_is_in_a_piece():
    for n in (64, 65, 66, 75, 76, 77, 200, 1001):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity.split_words(f"a {word}. b")[1:-1]
        parts = [p[1:] if p[0] == " " else f"<{p.strip(toxicity.STRIP)}>" for p in pieces]
        marked = f"<{word}>"
        for size in toxicity.SIZES:
            assert {marked[i : i + size] for i in range(len(marked) - size + 1)} == {p[i : i + size] for p in parts for i in range(len(p) - size + 1)}
    assert cotrain._shapes["a" * 64 + "0"] != cotrain._shapes["a" * 64]


def test_unlabelled_documents_need_no_shuffle_of_texts(spark):
    rng, store = random.Random(8), spark.sparkContext._jsc.sc()
    docs = spark.createDataFrame([(i, "%0999x word" % rng.getrandbits(3996), "s", "en", 1) for i in range(1500)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")

    def shuffled():
        store.listenerBus().waitUntilEmpty(30_000)
        executors = store.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        cotrain.fit(docs, labels, per_class=20, rounds=1, take=5)
        assert shuffled() - before < 200_000  # texts: 1,500,000 bytes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_unlabelled_documents_are_all_of_them(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 900 if i % 50 else None, f"text {i}", "s", "en", 1) for i in range(1000)], "id long, text string, source string, lang string, chars long")
    ids = spark.createDataFrame([(i // 2 * 3,) for i in range(600)] + [(None,)], "id long")
    want = sorted(i % 900 for i in range(1000) if i % 50 and i % 900 % 3)
    for most in (common.FILTER_MOST, 64 * 8):  # the small filter is full, and stops everything
        monkeypatch.setattr(common, "FILTER_MOST", most)
        monkeypatch.setattr(common, "max", lambda *x, most=most: min(most, max(*x)), raising=False)
        scratch = common.Scratch(spark, "test")
        got = cotrain._unlabelled(docs, ids, scratch)
        assert sorted(r.id for r in got.collect()) == want and got.columns == ["id", "a", "b"]


def test_pipeline_batches_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)

    docs = spark.range(0, 9000, 1, 1).selectExpr("id as doc_id", "repeat('x', 2000) as text")
    try:
        for _, stage in corpus_pipeline.STAGES:
            assert stage.__wrapped__.__name__ == stage.__name__
        found = [r.n for r in corpus_pipeline.small_batches(lambda spark, docs, _: docs.mapInArrow(sizes, "n bigint"))(spark, docs, "").collect()]
        assert max(found) < 1.1 * corpus_pipeline.BATCH and sum(found) > 18_000_000
    finally:
        spark.conf.set(key, before)


def test_pipeline_workers_give_memory_back_after_each_task(spark, monkeypatch):
    seen, before = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, *a, **b: seen.append(f) or before(self, f, *a, **b))
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    items = spark.createDataFrame([("i", " ".join("abcdefghijk"))], "item_id string, text string")
    model = toxicity.Model()
    for df in (toxicity.keep(docs, model), widehash.near_dedup(docs), substring.dedup(docs), decontaminate.clean(docs, items), bpe.digests(docs, common.tokenizer_path())):
        assert df.columns[0] == "doc_id"
    freed = []
    monkeypatch.setattr(common, "release", lambda: freed.append(1))
    assert len(seen) >= 10
    for f in seen:
        n = len(freed)
        assert list(f(iter(()))) == [] and len(freed) > n


def test_near_dedup_sends_a_pair_from_its_first_trie_only(spark):
    keys = {n: [7, 70 + n % 2, 700] for n in range(12)} | {12: [8, 70, 700], 13: [0, 0, 0]}  # 12 meets the even ones first at 70
    fp = lambda n: bytes(62) + n.to_bytes(2, "big")
    own = [(k, n, fp(n), n, k, ks) for n, ks in keys.items() if n < 13 for k in ks] + [(700, 13, fp(13), 13, 700, keys[13])]
    rows = spark.createDataFrame(own, "k long, node long, fp binary, label long, own long, keys array<long>")
    want = sorted((a, b) for a in range(14) for b in range(a + 1, 14))
    for max_group in (1 << 16, 8):
        found, left = [], rows
        for round_ in range(9):
            done = widehash._walked(left, 90, max_group, round_, True).cache()
            found += [(r.u, r.v) for r in done.where("k is null").collect()]
            left = done.where("k is not null").selectExpr("k", "u as node", "fp", "v as label", "own", "keys")
            if not left.take(1):
                break
        assert sorted(set(found)) == want
        if max_group > 8:
            assert len(found) == len(want)  # before: once for each of up to three tries


def test_components_end_when_all_edges_are_stars(spark, monkeypatch):
    written, write = [], common.Scratch.write
    monkeypatch.setattr(common.Scratch, "write", lambda self, df: written.append(1) or write(self, df))
    got = simhash.connected(spark.createDataFrame([(n, n // 100 * 100) for n in range(300)], "u long, v long"), spark)
    assert {(r.node, r.root) for r in got.collect()} == {(n, n // 100 * 100) for n in range(300) if n % 100} and len(written) == 1
    rng, root = random.Random(3), list(range(400))
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(n, n + 1) for n in range(300, 360)]
    for _ in range(400):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = simhash.connected(spark.createDataFrame(edges, "u long, v long"), spark)
    assert {(r.node, r.root) for r in got.collect()} == {(n, r) for n, r in enumerate(root) if n != r}
