"""The incremental job: sources, readings, skipping, failures, reviews, and tables that survive a crash."""

import json

import pytest
from pyspark.sql import functions as F

from kumoji import cli
from kumoji.operators import align, corpus, process, validate
from kumoji.sources import tables


def caption(*cues):
    return json.dumps({"events": [{"tStartMs": a * 1000, "dDurationMs": (b - a) * 1000, "segs": [{"utf8": t}]} for a, b, t in cues]})


def transcript(*cues, model="base"):
    return "noise\n" + json.dumps({"model": model, "segments": [{"start": a, "end": b, "text": t} for a, b, t in cues]})


ONE, TWO = "昨日は友だちと一緒に大きな公園まで歩いて行きました。", "それから家に帰って美味しい晩ご飯を作って食べました。"


def inputs(spark, **more):
    """Episodes 1 captions, 2 a transcript only, 3 captions without words and a transcript, 4 nothing timed, 5 no script, 6 a bad transcript, 7 not listed."""
    both = ((0, 5, ONE), (6, 12, TWO))
    captions = {1: caption(*both), 3: caption((0, 5, "♪♪")), 5: caption(*both), **more.get("captions", {})}
    heard = {2: transcript(*both), 3: transcript(*both, model="tiny"), 6: transcript((5, 1, "x")), 1: transcript(*both)}
    entries = [(e, f"v{e}", f"s{e}", "discovered") for e in (1, 2, 3, 4, 6)] + [(5, "v5", "s5", "discovered"), (8, "v8", None, "missing-script")]
    scripts = {e: f"{ONE}\n{TWO}" for e in (1, 2, 3, 4, 6)} | more.get("scripts", {})
    return (
        spark.createDataFrame([(e,) for e in more.get("wanted", range(1, 9))], "episode bigint"),
        spark.createDataFrame(entries, "episode bigint, video_id string, script_url string, status string"),
        spark.createDataFrame([(f"v{e}", more.get("duration", 60.0), f"title {e}") for e in (1, 2, 3, 4, 5, 6, 8)], "video_id string, duration double, title string"),
        spark.createDataFrame([(e, f"s{e}", t) for e, t in scripts.items()], "episode bigint, url string, text string"),
        spark.createDataFrame(list(captions.items()), "episode bigint, json string"),
        spark.createDataFrame(list(heard.items()), "episode bigint, stdout string"),
    )


def test_every_branch_of_the_sources(spark):
    got = {r.episode: r for r in process.resolved(*inputs(spark)).collect()}
    assert {e: r.caption_track for e, r in got.items() if not r.error} == {1: "ja-orig", 2: "asr-base", 3: "asr-tiny"}
    assert {e: r.error for e, r in got.items() if r.error} == {4: "no captions and no transcript", 5: "no script", 6: "bad segment", 7: "not in the manifest", 8: "status is missing-script"}
    assert {r.episode: r.alignment_method for r in process.resolved(*inputs(spark), spark.createDataFrame([(1,)], "episode int")).collect()}[1] == "asr"
    assert {r.episode: r.alignment_method for r in process.resolved(*inputs(spark), prefer_asr=True).collect()}[1] == "asr"


def test_a_second_run_aligns_nothing_and_failures_are_rows(spark, tmp_path, monkeypatch):
    data, aligned = str(tmp_path), []
    real = align.aligned
    monkeypatch.setattr(align, "aligned", lambda u, c: aligned.append(sorted(r.episode for r in u.select("episode").distinct().collect())) or real(u, c))

    def go(force=False, **more):
        return {r.episode: r for r in process.run(spark, data, process.resolved(*inputs(spark, **more)), force=force).collect()}

    first = go()
    assert {e: r.status for e, r in first.items()} == {1: "processed", 2: "processed", 3: "processed", 4: "failed", 5: "failed", 6: "failed", 7: "failed", 8: "failed"}
    assert (first[1].segment_count, first[1].unmatched_count, first[1].skipped, first[6].message) == (2, 0, False, "bad segment")
    second = go()
    assert aligned == [[1, 2, 3], []] and {e for e, r in second.items() if r.skipped} == {1, 2, 3} and second[1].average_confidence == first[1].average_confidence
    assert len(tables.versions(spark, f"{data}/sources")) == 1  # nothing new to say
    third = go(scripts={2: ONE})
    assert aligned[-1] == [2] and third[2].segment_count == 1 and not third[2].skipped and third[1].skipped
    store = process.Store(spark, data)
    assert sorted((r.episode, r.local_index) for r in store.segments().collect()) == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1)]
    assert go(force=True)[1].skipped is False and aligned[-1] == [1, 2, 3]
    assert validate.alignment_report(store.segments(), store.sources(), store.reviews(), spark.createDataFrame([], "episode bigint, duration double")).count() == 0


def test_one_bad_episode_does_not_stop_the_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(align, "align", lambda units, lat, readings=None: (_ for _ in ()).throw(ValueError("broken")) if any("公園" in u.text for u in units) else ([], [(u, "unplaced") for u in units]))
    got = {r.episode: r for r in process.run(spark, str(tmp_path), process.resolved(*inputs(spark, wanted=(1, 2), scripts={2: TWO}))).collect()}
    assert got[1].status == "failed" and got[1].message == "ValueError: broken" and got[2].status == "low-confidence" and got[2].unmatched_count == 1


def test_an_unsound_result_is_made_again_and_a_lost_review_alone(spark, tmp_path, monkeypatch):
    data, aligned = str(tmp_path), []
    real = align.aligned
    monkeypatch.setattr(align, "aligned", lambda u, c: aligned.append(sorted(r.episode for r in u.select("episode").distinct().collect())) or real(u, c))
    sources = process.resolved(*inputs(spark, wanted=(1, 2)))
    process.run(spark, data, sources)
    name = process.Store(spark, data).sources().first().run
    tables.remove(spark, f"{data}/reviews/run={name}")
    spark.createDataFrame([], process.REVIEWS).drop("run").write.parquet(f"{data}/reviews/run={name}")
    got = {r.episode: r for r in process.run(spark, data, sources).collect()}
    assert aligned == [[1, 2], []] and got[1].skipped and process.Store(spark, data).reviews().count() == 2
    rows = spark.read.parquet(f"{data}/alignments/run={name}").collect()
    broken = spark.createDataFrame([r.asDict() | ({"end": r.start - 1} if r.episode == 1 and r.local_index == 0 else {}) for r in rows], process.SEGMENTS.removeprefix("run string, "))
    tables.remove(spark, f"{data}/alignments/run={name}")
    broken.write.parquet(f"{data}/alignments/run={name}")
    got = {r.episode: r for r in process.run(spark, data, sources).collect()}
    assert aligned[-1] == [1] and not got[1].skipped and got[2].skipped


def test_validation_tells_every_fault_with_its_place(spark, tmp_path):
    data = str(tmp_path)
    process.run(spark, data, process.resolved(*inputs(spark, wanted=(1,))))
    store = process.Store(spark, data)
    segs, states, reviews = store.segments(), store.sources(), store.reviews()
    none = spark.createDataFrame([], "episode bigint, duration double")
    short = spark.createDataFrame([(1, 5.0)], "episode bigint, duration double")
    of = lambda *a, **k: sorted((r.path, r.issue) for r in validate.alignment_report(*a, **k).collect())
    assert of(segs, states, reviews, none) == []
    assert [p for p, _ in of(segs, states, reviews, short)] == ["segments.1.end"]
    assert of(segs, states, reviews.where("false"), none) == [("review", "is missing")] and of(segs, states, reviews.where("false"), none, need_review=False) == []
    assert [p for p, _ in of(segs, states, reviews.withColumn("video_id", F.lit("x")).withColumn("low_count", F.lit(7)).withColumn("inferred", F.array(F.get("low", F.lit(0)))), none)] == ["review.inferred", "review.summary", "review.video_id"]
    bad = segs.withColumn("end", F.when(F.col("local_index") == 0, F.col("start")).otherwise(F.col("end"))).withColumn("local_index", F.col("local_index") * 2).withColumn("confidence", F.lit(0.1))
    assert {p for p, _ in of(bad, states, reviews, none)} == {"segments.0.end", "segments.2.local_index", "summary.low_count", "summary.average_confidence"}
    assert of(segs, states.where("false"), reviews, none) == [("summary", "is missing")]


def test_a_unit_found_only_by_its_reading(spark):
    kana = "キカレタトキハコタエニコマリマス"
    text = "聞かれたときは、答えに困ります。"
    unit = align.Unit(0, 0, text, align.comparable_text(text), align.comparable_text(kana))
    lat, readings = align.lattice([(1.0, 4.0, "まったく違う字幕です。")]), align.reading_lattice([(5.0, 8.0, kana), (9.0, 9.0, ""), (9.0, 9.0, "キ")])
    drafts, issues = align.align([unit], lat, readings)
    assert issues == [] and drafts[0].start == 5.0 and readings.ends[-1] == 9.05 and len(readings.cues) == 2
    assert align.align([unit], lat)[0] == []
    a, b = align.Candidate(0, 1, 0.5, 0.7), align.Candidate(3, 1, 0.9, 0.7)
    assert align.chosen(a, b) is a and align.chosen(None, b).by == "reading" and align.chosen(a, None) is a and align.chosen(None, None) is None
    assert align.chosen(a, align.Candidate(3, 1, 0.1, 0.71)).by == "reading"
    words = {"聞かれた": ("聞く", ["動詞"], "キカレタ"), "とき": ("とき", ["名詞"], "*"), "は": ("は", ["助詞"], "")}
    df = spark.createDataFrame([(1, 0, 0, "聞かれた とき は、")], "episode bigint, unit_index int, block int, text string").withColumn("reading", corpus.reading(F.col("text"), corpus.dictionary_tokenizer(words)))
    assert df.first().reading == "キカレタときは、"
    units = spark.createDataFrame([(1, 0, 0, text, kana)], "episode bigint, unit_index int, block int, text string, reading string")
    cues = spark.createDataFrame([(1, 1.0, 4.0, "まったく違う字幕です。", ""), (1, 5.0, 8.0, "ほかの文字", kana)], "episode bigint, start double, end double, text string, reading string")
    assert [(r.start, r.issue) for r in align.aligned(units, cues).collect()] == [(5.0, None)]


def test_a_match_does_not_start_before_the_one_before_it_ends():
    words = ["the quick brown fox jumps over", "the quick brown fox jumps over"]
    rows = [align.Unit(i, 0, w, align.comparable_text(w)) for i, w in enumerate(words)]
    drafts, _ = align.align(rows, align.lattice([(0.0, 5.0, words[0]), (4.0, 9.0, words[1])]))
    assert len(drafts) == 2 and drafts[1].start >= drafts[0].end


def test_a_crash_before_the_switch_leaves_the_old_table(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert tables.read(spark, root, "k int, v string").count() == 0 and not tables.exists(spark, root)
    with pytest.raises(FileNotFoundError):
        tables.read(spark, root)
    assert tables.write_stable(df, root)
    monkeypatch.setattr(tables, "switch", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        tables.write_stable(df.withColumn("v", F.lit("b")), root)
    assert tables.read(spark, root).first().v == "a"
    monkeypatch.undo()
    reader = tables.read(spark, root)
    assert tables.write_stable(tables.read(spark, root).withColumn("v", F.lit("c")), root) and reader.first().v == "a" and tables.read(spark, root).first().v == "c"
    for v in "def":
        tables.write_stable(df.withColumn("v", F.lit(v)), root)
    assert len(tables.versions(spark, root)) == tables.KEEP


def test_commands(spark, tmp_path, capsys):
    data = str(tmp_path)
    entries = [{"id": "abcdefghijk", "title": "ep.1 park", "duration": 60.0, "timestamp": 86400}, {"id": "zzzzzzzzzzz", "title": "no number", "duration": 60.0, "timestamp": 86400}]
    (tmp_path / "p.json").write_text(json.dumps({"entries": entries}))
    (tmp_path / "o.json").write_text(json.dumps({"youtubeEpisodeOverrides": {"zzzzzzzzzzz": 2}, "scriptEpisodeOverrides": {}, "preferredScriptUrlsByEpisode": {}, "preferredAsrEpisodes": [2]}))
    kind = "url string, title string, episode int, published_at string, modified_at string, text string, status string"
    tables.write_stable(spark.createDataFrame([(f"http://x/{e}", "t", e, None, None, f"{ONE}\n{TWO}", "parsed") for e in (1, 2)], kind), f"{data}/scripts")
    spark.createDataFrame([(e, caption((0, 5, ONE), (6, 12, TWO))) for e in (1, 2)], "episode bigint, json string").write.parquet(f"{data}/captions")
    spark.createDataFrame([(2, transcript((0, 5, ONE), (6, 12, TWO)))], "episode bigint, stdout string").write.parquet(f"{data}/transcripts")
    over = str(tmp_path / "o.json")
    cli.list_videos(spark, data, str(tmp_path / "p.json"), over)
    assert {(r.section, r.episode, r.id) for r in tables.read(spark, f"{data}/video_report").collect()} == {("total", None, None), ("parsed", None, None), ("applied-override", 2, "zzzzzzzzzzz")}
    with pytest.raises(ValueError, match="allow-empty"):
        cli.rebuild_index(spark, data)
    cli.build_manifest(spark, data, over)
    cli.show(cli.process_latest(spark, data, 5, overrides=over))
    assert "ep1 processed: 2 segments" in capsys.readouterr().out
    assert {r.episode: r.caption_track for r in process.Store(spark, data).sources().collect()} == {1: "ja-orig", 2: "asr-base"}
    assert [r.skipped for r in cli.process_latest(spark, data, 5, overrides=over).collect()] == [True, True]
    assert [r.skipped for r in cli.process_episode(spark, data, 1, force=True).collect()] == [False]
    cli.build_manifest(spark, data, over)
    assert {r.episode: r.status for r in tables.read(spark, f"{data}/manifest").collect()} == {1: "processed", 2: "processed"}
    cli.rebuild_index(spark, data)
    cli.run_search(spark, data, "公園まで歩いて行きました", "exact", 5)
    cli.run_search(spark, data, ONE.rstrip("。"), "exact", 5)
    out = capsys.readouterr().out
    assert "ep.1 ep.1 park 0:00" in out and "2 results" in out
    cli.run_validate(spark, data)
