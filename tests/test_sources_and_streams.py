from __future__ import annotations

import datetime as dt
import json
import plistlib

import pytest
from pyspark.sql import functions as F

from cadenza.operators import library
from cadenza.sources import readers
from cadenza.streaming import watch

XML = """<?xml version="1.0"?><DJ_PLAYLISTS><COLLECTION Entries="2">
<TRACK TrackID="1" Name="One &amp; all" Artist="Ana" AverageBpm="120.50" Tonality="Am" TotalTime="300" Location="file://localhost/C:/Music/a%20b+c.mp3">
<POSITION_MARK Name="in" Type="0" Start="1.5" Num="0"/><POSITION_MARK Name="m" Type="0" Start="2.25" Num="-1"/><POSITION_MARK Name="l" Type="4" Start="10.0" End="18.0" Num="-1"/><POSITION_MARK Type="9" Start="1"/></TRACK>
<TRACK TrackID="2" Name="Two" Artist="" AverageBpm="x" Location="file://localhost/home/z.mp3"/></COLLECTION></DJ_PLAYLISTS>"""


def test_collection(spark, tmp_path):
    (tmp_path / "c.xml").write_text(XML)
    tracks = readers.collection(spark, str(tmp_path / "c.xml")).cache()
    got = {r.track_id: r for r in tracks.collect()}
    assert (got["1"].location, got["1"].bpm, got["1"].key, got["1"].title) == ("C:/Music/a b+c.mp3", 120.5, "8A", "One & all")
    assert got["2"].bpm == 0.0 and got["2"].location == "/home/z.mp3" and got["2"].marks is None
    marks = [(r.kind, r.num, r.start_ms, r.end_ms) for r in readers.collection_marks(tracks).orderBy("seq").collect()]
    assert marks == [("cue", 0, 1500, None), ("memory", None, 2250, None), ("loop", None, 10000, 18000)]


def test_files(spark, tmp_path):
    for name in ("a/1.mp3", "a/.hidden.mp3", "b 10/2.WAV", "b 2/3.flac", "b 2/4.txt", "b 2/~$5.mp3", "b 2/6.part.mp3"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = readers.audio_files(spark, str(tmp_path)).cache()
    assert {r.path.rsplit("/", 1)[1] for r in files.collect()} == {"1.mp3", "2.WAV", "3.flac"}
    assert [r.folder.rsplit("/", 1)[1].replace("%20", " ") for r in readers.folders(files).collect()] == ["a", "b 2", "b 10"]


def test_json_and_plist_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"decisions": [{"path": "x", "state": "ok"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"path": "x", "state": "ok"}]))
    assert [readers.decisions(spark, str(tmp_path / f)).first().asDict() for f in ("a.json", "b.json")] == [{"path": "x", "state": "ok"}] * 2
    blob = plistlib.dumps({"Tracks": {"1": {"Location": "file:///a.mp3"}, "2": {"Name": "none"}}})
    assert [r.location for r in readers.plist_locations(spark.createDataFrame([(blob,)], "content binary")).collect()] == ["file:///a.mp3"]
    (tmp_path / "c.csv").write_text("﻿a;b\n1;x\n", encoding="utf-8")
    assert readers.csv(spark, str(tmp_path / "c.csv"), ";").dtypes == [("a", "string"), ("b", "string")]


def test_unique_paths(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "path string, v int")
    assert library.unique_paths(df).count() == 2
    with pytest.raises(Exception, match="differ"):
        library.unique_paths(df.unionByName(spark.createDataFrame([("a", 9)], "path string, v int"))).collect()


def test_reconcile_and_upsert(spark):
    disk = spark.createDataFrame([("/r/a", 1.0), ("/r/b", 2.0), ("/r/c", 1.0)], "path string, mtime double")
    known = spark.createDataFrame([("/r/a", 1.0), ("/r/b", 1.0), ("/r/d", 1.0), ("/s/e", 1.0)], "path string, mtime double")
    assert {r.path: r.state for r in library.reconcile(disk, known, "/r/").collect()} == {"/r/a": "unchanged", "/r/b": "updated", "/r/c": "new", "/r/d": "deleted"}
    assert {r.path: r.mtime for r in library.upsert(known, disk, ["path"]).collect()} == {"/r/a": 1.0, "/r/b": 2.0, "/r/c": 1.0, "/r/d": 1.0, "/s/e": 1.0}


def test_watching_a_folder(spark, tmp_path):
    """Three batches: a file is seen, is stable and fails, then is due again and done."""
    t = lambda s: (dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)).isoformat()
    source, registry = tmp_path / "in", str(tmp_path / "registry")
    source.mkdir()
    clock = {"now": 0, "fail": True}

    def process(ready):
        return ready.select("path", F.when(F.lit(clock["fail"]), F.lit("io")).alias("failure"))

    def cycle(name, rows):
        (source / f"{name}.json").write_text("\n".join(json.dumps({"path": p, "size": s, "mtime": t(m), "observed_at": t(o)}) for p, s, m, o in rows))
        stream = spark.readStream.schema("path string, size bigint, mtime timestamp, observed_at timestamp").json(str(source))
        watch.watch(stream, registry, process, str(tmp_path / "checkpoint"), lambda: F.timestamp_seconds(F.lit(1_704_067_200 + clock["now"]))).awaitTermination()
        return {r.path: (r.state, r.attempts) for r in watch.latest(spark, registry).collect()}

    assert cycle("1", [("/a", 5, 1, 10), ("/b", 5, 1, 10), ("/b", 6, 2, 20)]) == {}
    assert cycle("2", [("/a", 5, 1, 30), ("/a", 5, 1, 40)]) == {"/a": ("failed", 1)}
    clock |= {"now": 60, "fail": False}
    assert cycle("3", [("/a", 5, 1, 50), ("/a", 5, 1, 60)]) == {"/a": ("failed", 1)}
    clock |= {"now": 121}
    assert cycle("4", [("/a", 5, 1, 70), ("/a", 5, 1, 80)]) == {"/a": ("done", 0)}


def test_batches_never_repeat_a_name(spark):
    files = spark.createDataFrame([(f"/{d}/x{i}.wav",) for d in "abc" for i in range(10)], "path string")
    got = watch.batched(files, 4).collect()
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append(r.path.rsplit("/", 1)[1])
    assert all(len(v) == len(set(v)) <= 4 for v in by.values()) and sum(map(len, by.values())) == 30


def test_pages(spark, sf):
    got = readers.html_fields(spark.read.parquet(f"{sf}/pages.parquet"), {"title": r"<title>([^<]*)</title>"})
    assert got.where("title IS NOT NULL").count() == got.count() > 0
