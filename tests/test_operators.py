"""Operators on small tables of our own: Japanese text, captions, pages, manifests, alignment, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from kumoji.functions import ids, text
from kumoji.functions import similarity as sim
from kumoji.operators import align, corpus, deinflect, highlight, manifest, search, timeline, units, validate
from kumoji.sources import landed, tables

WORDS = {
    "昨日": ("昨日", ["名詞"], "キノウ"), "パン": ("パン", ["名詞"], "パン"), "を": ("を", ["助詞"], "ヲ"), "食べ": ("食べる", ["動詞"], "タベ"), "まし": ("ます", ["助動詞"], "マシ"), "た": ("た", ["助動詞"], "タ"),
    "今日": ("今日", ["名詞"], "キョウ"), "食べる": ("食べる", ["動詞"], "タベル"), "行く": ("行く", ["動詞"], "イク"), "。": ("。", ["補助記号"], None),
}


@pytest.fixture(scope="module")
def segs(spark):
    rows = [(100000, "ep1-s00000", 1, 0, "昨日パンを食べました。"), (200000, "ep2-s00000", 2, 0, "今日食べる。"), (200001, "ep2-s00001", 2, 1, "行く。")]
    return spark.createDataFrame(rows, "segment_id bigint, segment_key string, episode bigint, local_index int, text string")


def found(page):
    return [r.segment_id for r in page.rows().collect()]


def test_search_modes(spark, segs, tmp_path):
    tokenizer = corpus.dictionary_tokenizer(WORDS)
    corpus.write_index(segs, str(tmp_path), tokenizer)
    for index in (corpus.Index.of(segs, tokenizer), corpus.Index(spark, str(tmp_path))):
        assert found(search.exact(index, "食べ")) == [100000]
        assert found(search.auto(index, "食べる")) == [100000, 200000]
        assert found(search.auto(index, "食べ")) == [100000, 200000]  # not a lemma, but a surface with one
        loose = search.loose(index, "食べたい")  # deinflects
        assert found(loose) == [100000, 200000] and "食べる" in search.matched_terms(index, loose)
        assert found(search.loose(index, "　")) == [] and found(search.exact(index, "パン", 1, 1)) == []
        page = search.loose(index, "食べる", 1, 0)
        assert (page.total(), page.next_cursor()) == (2, 1)
        assert found(search.lemma(index, "食べる")) == [100000, 200000] and found(search.lemma(index, "食べ")) == [] and found(search.surface(index, "食べ")) == [100000]
        assert search.surface(index, "食べ").searched() == ["surface:食べ"] and search.auto(index, "食べ").searched() == ["lemma:食べる"]
        assert [r.text for r in search.hydrated(page.rows(), index.segments_of(page.rows(), 1)).collect()] == ["昨日パンを食べました。"]
        assert [r.segment_id for r in search.within_episodes(search.auto(index, "食べる").hits, 2, 2).collect()] == [200000]
    plan = index.segments_of(page.rows(), 1)._jdf.queryExecution().executedPlan().toString() + index.surface_lemmas(["食べ"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 2 and "PartitionFilters: []" not in plan
    for mode in (search.auto, search.lemma, search.surface):
        with pytest.raises(ValueError):
            mode(index, " ")
    assert [search.limit_of(x) for x in (None, 0, 500, 7.9, float("nan"))] == [25, 1, 100, 7, 25] and search.cursor_of(-3) == 0
    lost = spark.createDataFrame([(5,)], "segment_id bigint")
    with pytest.raises(Exception, match="no segment 5"):
        search.hydrated(lost, segs).collect()


def test_stem_of_one_character(spark):
    rows = [(100000, "ep1-s00000", 1, 0, "見")]
    one = spark.createDataFrame(rows, "segment_id bigint, segment_key string, episode bigint, local_index int, text string")
    index = corpus.Index.of(one, corpus.dictionary_tokenizer({"見": ("見る", ["動詞"], "ミ")}))
    assert search.stems(index, "見なかった") == ["見る"] and search.stems(index, "見ませんでした") == ["見る"] and search.stems(index, "見猫") == []


def test_deinflection():
    terms = lambda s: {t for t, _ in deinflect.deinflect(s)}
    for inflected, base in (("食べました", "食べる"), ("飲んで", "飲む"), ("行かない", "行く"), ("高かった", "高い"), ("書きたかった", "書く"), ("見られない", "見る"), ("待っている", "待つ"), ("しました", "する"), ("来た", "来る")):
        assert base in terms(inflected), inflected
    assert deinflect.deinflect("猫")[0] == ("猫", ())
    assert "食べる" not in terms("パン")


def test_highlight(spark, segs):
    rows = segs.withColumn("tokens", corpus.dictionary_tokenizer(WORDS)("text"))
    terms = F.array(F.lit("食べる"))
    marked = rows.select(highlight.bracketed(F.col("text"), highlight.search_ranges(F.col("text"), F.col("tokens"), terms, "食べる")).alias("m"))
    assert [r.m for r in marked.collect()] == ["昨日パンを[食べました]。", "今日[食べる]。", "行く。"]
    one = spark.createDataFrame([("a.a.b", [(0, 2), (2, 3), (5, 6), (4, 5)])], "t string, r array<struct<start:int,end:int>>")
    got = one.select(highlight.exact_ranges(F.col("t"), "a.").alias("e"), highlight.merged(F.col("r")).alias("m"), highlight.exact_ranges(F.col("t"), "").alias("n")).first()
    assert [tuple(x) for x in got.e] == [(0, 2), (2, 4)] and [tuple(x) for x in got.m] == [(0, 3), (4, 6)] and got.n == []


def test_text(spark):
    titles = ["ep.12 title", "第 3 回", "Episode 007!", "1234 trailer", "2024年", "ep12345", "deep 5", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r.e for r in df.select(text.episode_from_title(F.col("t")).alias("e")).collect()] == [12, 3, 7, None, None, None, None, None]
    titles = ["ep 0 第5回", "大第5回", "第5回戦", "episode_09", "ep#4", "第　6 回"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r.e for r in df.select(text.episode_from_title(F.col("t")).alias("e")).collect()] == [5, None, None, 9, None, 6]
    df = spark.createDataFrame([(t,) for t in ("p 12", "p-12", "p_12", "p12", "up 12", "p 0")], "t string")
    assert [r.e for r in df.select(text.episode_from_page(F.col("t")).alias("e")).collect()] == [12, 12, 12, 12, None, None]
    lines = "■ サポートお願いします！\nBuy Me a Coffee\nhttps://buymeacoffee.com/someone/\nサポートお願いします Buy Me a Coffee https://buymeacoffee.com/x\nBuy Me a Coffee please\n寄付の話\ndonating"
    assert spark.range(1).select(text.without_boilerplate(F.lit(lines)).alias("v")).first().v == "Buy Me a Coffee please\n寄付の話\ndonating"
    odd = "<br class=x>a&NBSP;b&AMP;lt;<BR/>&#X41;&#38;#x42;&#9999999;<>"
    assert spark.range(1).select(text.visible_text(F.lit(odd)).alias("v")).first().v.startswith("a b&lt;".replace("&lt;", "<"))
    post = '<div data-hook="post-description" x><p>one</p><footer>no</footer>{}<footer class=y data-hook="post-footer">f</footer><div data-hook="recent-posts">r</div>'
    pages = [post.format("<p>two</p>"), post.replace("post-footer", "other").format(""), "<p>none</p>", '<div data-hook="post-description">all', None]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").select("i", text.post_text(F.col("h")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == ["one\nnotwo", "one\nnof<div", "", "all", None]  # a footer tag breaks no line; the cut is at the hook, within its tag
    html = "<p>a&amp;lt;b</p><script>var x='</p>'</script>c<br/> d&nbsp; e &#x41;&#66;<h2></h2>"
    assert spark.range(1).select(text.visible_text(F.lit(html)).alias("v")).first().v == "a<b\nc\nd e AB"
    got = spark.range(1).select(text.sentences(F.lit("一。二！？三\n---\n★四\n五")).alias("s"), text.nfkc(F.lit("ｶﾞＡ")).alias("n"), text.comparable(F.lit("ｶﾞ, A!")).alias("c")).first()
    assert got.s == ["一。", "二！？", "三", "五"] and got.n == "ガA" and got.c == "ガa"
    urls = ["https://www.youtube.com/watch?v=abcdefghijk&t=1", "https://youtu.be/abcdefghijk", "abcdefghijk", "https://evil.com/watch?v=abcdefghijk", "https://youtube.com/shorts/abcdefghijk"]
    ok = [r.v for r in spark.createDataFrame([(u,) for u in urls], "u string").select(text.video_id(F.col("u")).alias("v")).collect()]
    assert ok == ["abcdefghijk"] * 3 + [None, "abcdefghijk"]


def test_ids(spark):
    r = spark.range(1).select(ids.clock(F.lit(3725.9)).alias("a"), ids.clock(F.lit(-2)).alias("b"), ids.precise_clock(F.lit(65.257)).alias("c"), ids.milli(F.lit(0.5005)).alias("d"), ids.watch_url(F.lit("v"), F.lit(0.4)).alias("e")).first()
    assert tuple(r) == ("1:02:05", "0:00", "1:05.25", 0.501 if int(0.5005 * 1000 + 0.5) == 501 else 0.5, "https://www.youtube.com/watch?v=v&t=0s")
    with pytest.raises(Exception, match="not a segment id"):
        spark.range(1).select(ids.episode_of(F.lit(5))).collect()


def test_captions(spark):
    events = {"events": [{"tStartMs": 0, "dDurationMs": 5000, "segs": [{"utf8": "ab"}, {"utf8": "\n"}]}, {"tStartMs": 2000, "segs": [{"utf8": "\n"}]}, {"tStartMs": 4000, "dDurationMs": 10, "segs": [{"utf8": "c"}]}, {"segs": [{"utf8": "x"}]}]}
    df = spark.createDataFrame([(1, json.dumps(events))], "episode int, json string")
    assert [(r.text, r.start, r.end) for r in landed.caption_cues(df).orderBy("cue").collect()] == [("ab", 0.0, 2.0), ("c", 4.0, 4.1)]
    noisy = 'loading...\n{"engine": "e", "segments": [{"start": 0, "end": 1.5, "text": "hi"}]}'
    rows = landed.transcript_cues(spark.createDataFrame([(1, noisy)], "episode int, stdout string")).collect()
    assert [(r.text, r.end) for r in rows] == [("hi", 1.5)]
    with pytest.raises(Exception, match="no transcript"):
        landed.transcript_cues(spark.createDataFrame([(1, "nothing")], "episode int, stdout string")).collect()


def test_videos_and_pages(spark, tmp_path):
    entries = [{"id": "abcdefghijk", "title": " ep.5 x ", "duration": 3.0, "timestamp": 86400}, {"id": "bad", "url": "https://youtu.be/abcdefghijk", "title": "y"}, {"id": None, "url": "https://youtu.be/zzzzzzzzzzz", "title": "z", "upload_date": "20240102"}]
    (tmp_path / "p.json").write_text(json.dumps({"entries": entries}))
    over = spark.createDataFrame([("zzzzzzzzzzz", 9)], "video_id string, episode int")
    got = landed.videos(landed.playlist(spark, str(tmp_path / "p.json")), over).orderBy(*landed.video_order()).collect()
    assert [(r.video_id, r.episode, r.published_at) for r in got] == [("abcdefghijk", 5, "1970-01-02T00:00:00.000Z"), ("zzzzzzzzzzz", 9, "2024-01-02T00:00:00.000Z")]
    ld = '<script type="application/ld+json">{"@type": "BlogPosting", "headline": "ep 7 &amp; more", "datePublished": "2024-01-01"}</script>'
    page = spark.createDataFrame([("http://x/1", f"<title>t</title>{ld}<article><p>body</p></article>"), ("http://x/2", "<title>none</title>")], "url string, html string")
    parsed = {r.url: r for r in landed.script_pages(page).collect()}
    assert (parsed["http://x/1"].episode, parsed["http://x/1"].text, parsed["http://x/1"].status, parsed["http://x/2"].status) == (7, "body", "parsed", "unparsed")
    xml = spark.createDataFrame([("<url><loc>http://a/ep-3</loc><lastmod>2024-01-01</lastmod></url><url><loc>http://a/b</loc><lastmod>x</lastmod></url>",)], "xml string")
    assert sorted(tuple(r) for r in landed.sitemap(xml).collect()) == sorted([("http://a/ep-3", "2024-01-01", 3), ("http://a/b", None, None)])


def test_stable_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5)], "k int, v string, generated_at int")
    path = str(tmp_path / "t")
    assert tables.write_stable(df, path) and not tables.write_stable(df.withColumn("generated_at", F.lit(6)), path) and tables.write_stable(df.withColumn("v", F.lit("b")), path)
    assert tables.upserted(df, df.withColumn("v", F.lit("z")), "k").first().v == "z"


def test_manifest(spark):
    videos = spark.createDataFrame([(1, "v1", "b"), (2, "v2", "a"), (2, "v2b", "b"), (4, "v4", "a"), (5, "v5", "a"), (6, "v6", "a")], "episode bigint, video_id string, published_at string")
    scripts = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3"), (4, "s4"), (4, "s4b"), (6, "s6")], "episode bigint, url string").select("*", *(F.lit(None).cast("string").alias(c) for c in ("published_at", "modified_at", "lastmod")))
    preferred = spark.createDataFrame([(4, "s4b")], "episode bigint, url string")
    states = spark.createDataFrame([(1, "v1", True, 0), (4, "v4", True, 2), (6, "other", True, 0)], "episode bigint, video_id string, valid boolean, low_confidence bigint")
    got = {r.episode: r for r in manifest.manifest(videos, manifest.canonical_scripts(scripts, preferred), states).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "processed", 2: "ambiguous", 3: "missing-video", 4: "low-confidence", 5: "missing-script", 6: "failed"}
    assert got[2].video_id == "v2b" and got[4].script_url == "s4b" and got[6].notes == "aligned to another video"


def test_similarity():
    assert sim.lcs_length("abcde", "axcye") == 3 and sim.lcs("", "") == 0 and sim.prefix_lcs("ab", "xaab") == [0, 1, 1, 2]
    assert sim.dice("night", "nacht") == 0.25 and sim.similarity("a", "a") == 1 and sim.dice("a", "a") == 1
    assert sim.anchors("abcdefghijkl") == [("abcd", 0), ("efgh", 4), ("ijkl", 8)]


def test_alignment(spark):
    words = ["the quick brown fox jumps over", "a lazy dog sleeps in the sun", "and then it rains all day long", "nobody knows what comes next here"]
    cues = [(i * 5.0, i * 5.0 + 4.5, w) for i, w in enumerate(words)]
    rows = [align.Unit(i, 0, w, align.comparable_text(w)) for i, w in enumerate([words[0], words[1], "zzzz qqqq", words[3]])]
    drafts, issues = align.align(rows, align.lattice(cues))
    starts = {d.unit.index: d.start for d in drafts}
    assert abs(starts[0]) < 0.5 and abs(starts[1] - 5) < 0.5 and abs(starts[3] - 15) < 0.5
    assert all(a.end <= b.start + 1e-9 for a, b in zip(drafts, drafts[1:], strict=False))
    assert align.align(rows, align.lattice([])) == ([], [(u, "empty-caption-lattice") for u in rows])
    u = spark.createDataFrame([(1, i, 0, w) for i, w in enumerate(words)] + [(2, 0, 0, "alone")], "episode bigint, unit_index int, block int, text string")
    c = spark.createDataFrame([(1, a, b, w) for a, b, w in cues], "episode bigint, start double, end double, text string")
    got = align.aligned(u, c).collect()
    assert sum(r.episode == 1 and r.issue is None for r in got) == 4 and [r.issue for r in got if r.episode == 2] == ["empty-caption-lattice"]
    gap = align.interpolate(rows[:2], 0.0, 4.0)
    assert [d.start for d in gap][0] == 0.0 and gap[-1].end == 4.0 and align.interpolate(rows[:2], 0.0, 0.1) == []


def test_cue_anchors():
    unit = lambda s: align.Unit(0, 0, s, align.comparable_text(s))
    cues = align.spoken(align.lattice([(0.0, 10.0, "あいうえおかきくけこ"), (20.0, 30.0, "kakuabcdef")]), 0.0, 40.0)
    assert cues.text == "あいうえおかきくけこkakuabcdef" and cues.times[0] == (0.0, 1.0, 0.0)
    start, score = align.anchor_in(unit("かきくけこ"), cues, 0.0, 40.0)
    assert start == 5.0 * 0.45 and score > 0.5  # late in its cue
    assert align.anchor_in(unit("うえお"), cues, 0.0, 40.0)[0] == 2.0
    assert align.anchor_in(unit("abcdef"), cues, 0.0, 40.0)[0] == 24.0  # Latin text is not drawn back
    assert align.anchor_in(unit("zz"), cues, 0.0, 40.0) == (18.5, align.CUE_SCORE)
    assert align.anchor_in(unit("zz"), cues, 0.0, 15.0) is None and align.anchor_in(unit("猫"), cues, 0.0, 40.0) is None
    many = align.spoken(align.lattice([(float(i), i + 1.0, "あい") for i in range(60)] + [(60.0, 61.0, "あいうえお")]), 0.0, 70.0)
    assert align.anchor_in(unit("あいうえお"), many, 0.0, 70.0)[0] == 60.0


def test_units_and_time(spark):
    df = spark.createDataFrame([(1, "短い。これは十分に長い文なのでそのまま残ります。\n---\n次の行もそれなりに長い文になっています。はい。")], "episode int, text string")
    assert [(r.block, r.text) for r in units.script_units(df).orderBy("unit_index").collect()] == [(0, "短い。これは十分に長い文なのでそのまま残ります。"), (2, "次の行もそれなりに長い文になっています。はい。")]
    a = spark.createDataFrame([(1, 0.0, 9.0)], "k int, l_start double, l_end double")
    b = spark.createDataFrame([(1, 8.5, 30.0), (1, 9.5, 9.9), (2, 0.0, 1.0)], "k int, r_start double, r_end double")
    assert timeline.overlapping(a, b, "k", 2.0).count() == 1
    bad = spark.createDataFrame([(100000, "ep1-s00000", 1, 0, 1.0, 1.0)], "segment_id bigint, segment_key string, episode bigint, local_index int, start double, end double")
    assert [r.rule for r in validate.segment_violations(bad).collect()] == ["end"]
    with pytest.raises(validate.ValidationError):
        validate.require(validate.segment_violations(bad))


def test_streaming(spark, tmp_path):
    from kumoji.streaming import ingest

    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    row = {"episode": 1, "title": "t", "url": "u", "text": "x", "lastmod": "2024-01-01"}
    (source / "1.json").write_text(json.dumps(row))
    for n in (1, 2):
        ingest.ingest(spark, str(source), target, str(tmp_path / "check")).awaitTermination()
        assert tables.read(spark, target).count() == n
        (source / "2.json").write_text(json.dumps(row | {"episode": 2}))


def test_entry_without_llm(spark):
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport builtins\nreal = builtins.__import__\ndef blocked(name, *a, **k):\n    if name == 'corpus_pipeline': raise ModuleNotFoundError(name=name)\n    return real(name, *a, **k)\nbuiltins.__import__ = blocked\nimport __spark_entry__ as e\nassert 'search_exact' in e.queries() and 'pipeline' not in e.queries() and not any(k.startswith('op') for k in e.queries())"
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
