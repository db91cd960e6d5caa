"""Serving files against json.dumps and the order that such objects have."""

import json
import os
from hashlib import sha256

from pyspark.sql import functions as F

from kumoji.operators import corpus
from kumoji.sources import export, tables


def files(folder):
    return {name: open(os.path.join(folder, name), encoding="utf-8").read() for name in os.listdir(folder) if name.endswith(".json")}


def test_files_are_whole_and_the_same_each_time(spark, tmp_path):
    texts = ["い ア あ b A a 猫 漢字 10 9 007 ー", "あ 猫 4294967294 4294967295 \"q\" é", "10 a B 日本", ""]
    rows = [(e * 100000, f"ep{e}-s00000", e, 0, texts[e % 4]) for e in (1, 2, 3, 600, 1200)]
    segs = spark.createDataFrame(rows, "segment_id bigint, segment_key string, episode bigint, local_index int, text string")
    corpus.write_index(segs, str(tmp_path / "index"))
    first, second = (export.write_index(spark, str(tmp_path / "index"), str(tmp_path / name)) for name in ("a", "b"))
    want: dict[str, dict[str, set]] = {"surface": {}, "lemma": {}, "surface-to-lemmas": {}}
    for r in corpus.segment_tokens(segs).collect():
        want["surface"].setdefault(r.surface, set()).add(r.segment_id)
        want["lemma"].setdefault(r.lemma, set()).add(r.segment_id)
        want["surface-to-lemmas"].setdefault(r.surface, set()).add(r.lemma)
    for kind, keys in want.items():
        got = files(f"{first}/{kind}")
        assert got == files(f"{second}/{kind}") and sorted(got) == [f"{k:02x}.json" for k in range(256)]
        seen = {}
        for name, body in got.items():
            value = json.loads(body)
            assert body == json.dumps(value, ensure_ascii=False, indent=2) + "\n"
            assert all(sha256(k.encode()).hexdigest()[:2] == name[:2] for k in value)
            seen |= value
        assert seen == {k: sorted(v) for k, v in keys.items()}


def test_order_of_keys(spark):
    keys = ["い", "ア", "あ", "b", "A", "a", "猫", "漢字", "10", "9", "007", "4294967295", "4294967294", "ー"]
    found = spark.createDataFrame([("00", k, b, [b]) for k in keys for b in (2, 1)], "bucket string, key string, block int, segment_ids array<int>")
    body = "\n".join(r.lines for r in export.bucket_lines(found).where("bucket = '00'").collect())
    value = json.loads(body)
    assert list(value) == ["9", "10", "4294967294", "ー", "007", "4294967295", "a", "A", "b", "あ", "ア", "い", "漢字", "猫"]
    assert all(v == [1, 2] for v in value.values())


def test_order_of_videos(spark):
    rows = [("v1", None, "b"), ("v2", 2, "い"), ("v4", 2, "ア"), ("v3", 2, "ア"), ("v5", 1, "z"), ("v6", None, "a")]
    got = spark.createDataFrame(rows, "video_id string, episode int, title string").orderBy(*export.video_order()).collect()
    assert [r.video_id for r in got] == ["v5", "v3", "v4", "v2", "v6", "v1"]


def test_a_broken_export_leaves_the_old_one(spark, tmp_path, monkeypatch):
    segs = spark.createDataFrame([(100000, "ep1-s00000", 1, 0, "a b")], "segment_id bigint, segment_key string, episode bigint, local_index int, text string")
    corpus.write_index(segs, str(tmp_path / "index"))
    root = str(tmp_path / "out")
    folder = export.write_index(spark, str(tmp_path / "index"), root)
    real = export.lemma_lists
    monkeypatch.setattr(export, "lemma_lists", lambda pairs: real(pairs).withColumn("key", F.raise_error(F.lit("disk full")).cast("string")))
    try:
        export.write_index(spark, str(tmp_path / "index"), root)
        raise AssertionError("it should have failed")
    except Exception as e:
        assert "disk full" in str(e)
    assert tables.current(spark, root) == folder and len(files(f"{folder}/surface")) == 256
