"""Playlist trees out of XML, typed names, frames and ranges of bytes, batches tried alone."""

from __future__ import annotations

import datetime as dt
import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.functions import frames
from cadenza.operators import resolve, trees
from cadenza.plans import intake
from cadenza.sources import playlist_xml
from cadenza.streaming import watch

HEAD = '<?xml version="1.0" encoding="UTF-8"?><DJ_PLAYLISTS><COLLECTION Entries="1"><TRACK TrackID="1" Name="n"><TEMPO Inizio="0"/></TRACK></COLLECTION>'
TREE = """<PLAYLISTS><NODE Type="0" Name="ROOT" Count="2">
<NODE Name=" Ãfter " Type="0"><NODE Name="ROOT" Type="0"><NODE Name="A &amp; B" Type="1" KeyType="0"><TRACK Key=" 1 "/><TRACK Key="2"/><TRACK Key="1"/></NODE></NODE></NODE>
<NODE Name="" Type="0"><NODE Name="" Type="1" KeyType="1"><TRACK Key="file://localhost/C:/x%20y+z.mp3"/><NODE Name="no" Type="1"/></NODE></NODE>
<NODE Name="strange" Type="3"><NODE Name="lost" Type="1"><TRACK Key="9"/></NODE></NODE><NODE Name="empty" Type="1"/></NODE></PLAYLISTS></DJ_PLAYLISTS>"""


def blobs(spark, contents: dict[str, bytes]):
    return spark.createDataFrame([(p, len(c) if c is not None else 0, c) for p, c in contents.items()], "path string, length long, content binary")


def test_trees_out_of_xml(spark):
    rows = playlist_xml.parsed(blobs(spark, {"a.xml": (HEAD + TREE).encode(), "b.xml": (HEAD + "</DJ_PLAYLISTS>").encode()})).cache()
    nodes = playlist_xml.nodes(rows)
    routes = {r.node: r.route for r in trees.routes(nodes.select("node", "parent", "name")).collect()}
    lists = {routes[r.node]: r.place for r in nodes.where("kind = 'playlist'").collect()}
    assert sorted(lists, key=lists.get) == ["Ãfter / ROOT / A & B", "Folder / Playlist", "empty"]
    found = sorted((routes[r.node], r.place, r.by_location, r.key) for r in playlist_xml.listed(rows).collect())
    assert found == [("Folder / Playlist", 0, True, "C:/x y+z.mp3"), ("Ãfter / ROOT / A & B", 0, False, "1"), ("Ãfter / ROOT / A & B", 1, False, "2"), ("Ãfter / ROOT / A & B", 2, False, "1")]
    assert playlist_xml.refused(rows).count() == 0


def test_depth_is_no_limit(spark):
    deep = HEAD + "<PLAYLISTS>" + "".join(f'<NODE Type="0" Name="{i}">' for i in range(3000)) + '<NODE Type="1" Name="last"/>' + "</NODE>" * 3000 + "</PLAYLISTS></DJ_PLAYLISTS>"
    rows = playlist_xml.parsed(blobs(spark, {"d.xml": deep.encode()})).cache()
    assert rows.count() == 3001 and rows.where("kind = 'playlist' AND parent = 2999").count() == 1


def test_refusals(spark):
    ok = HEAD + TREE
    cases = {
        "empty": b"", "blank": b" \n\t", "null": None, "utf16": ok.encode("utf-16"), "bare16": ok.encode("utf-16-be"), "nul": ok.encode() [:200] + b"\x00" + ok.encode()[200:],
        "doctype": b"<!DOCTYPE x [<!ENTITY a 'b'>]>" + ok.encode(), "cut": ok.encode()[:-20], "other": b"<plist><COLLECTION/></plist>", "bare": b"<DJ_PLAYLISTS/>", "fine": ok.encode(), "bad8": ok.encode().replace("Ã".encode(), b"\xc3\x28"),
    }
    got = {r.path: r.reason for r in playlist_xml.refused(playlist_xml.parsed(blobs(spark, cases))).collect()}
    assert got == {"empty": "empty", "blank": "empty", "null": "empty", "utf16": "encoding", "bare16": "encoding", "nul": "encoding", "doctype": "doctype", "cut": "broken", "other": "no-collection", "bare": "no-collection", "bad8": "broken"}


def test_a_worker_copies_one_file_at_a_time():
    """20 files of 2 MB in one batch, one of them refused: copies of all would be 40 MB."""
    body = (HEAD + TREE).encode().replace(b"<PLAYLISTS>", b"<PLAYLISTS><!--" + b"x" * 2_000_000 + b"-->")
    batch = pa.RecordBatch.from_pydict({"path": [f"f{i}" for i in range(20)], "content": [body] * 19 + [None], "why": [None] * 19 + ["doctype"]})
    tracemalloc.start()
    got = [r for out in playlist_xml._rows(iter([batch])) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000
    assert [r["path"] for r in got if r["kind"] == "playlist"] == [f"f{i}" for i in range(19) for _ in range(3)]
    assert [(r["path"], r["name"]) for r in got if r["kind"] == "refused"] == [("f19", "doctype")]


def test_large_files_are_never_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(playlist_xml, "LARGEST", 500)
    (tmp_path / "small.xml").write_text(HEAD + "</DJ_PLAYLISTS>")
    (tmp_path / "large.xml").write_text(HEAD + "<!--" + "x" * 500 + "--></DJ_PLAYLISTS>")
    (tmp_path / "other.txt").write_text("x")
    files = playlist_xml.files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.content is None for r in files.collect()} == {"small.xml": False, "large.xml": True}
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in playlist_xml.refused(playlist_xml.parsed(files)).collect()] == [("large.xml", "too-large")]


# --- typed names -----------------------------------------------------------------------------------


def test_typed_names_against_all_items(spark):
    draw = np.random.default_rng(3)
    rows = [(f"/m/{i}/{''.join(draw.choice(list('abé ß-'), 5))}.mp3", None if i % 5 == 0 else f"Ana {i % 3}", None if i % 7 == 0 else f"Title {i}") for i in range(60)]
    asked = [rows[3][0], "TITLE 1", "title 59", "ana 1 — title 4", "a", "é", "zz", "", None, "ba", "ß", "SS", ".MP3", "ana 0 — ", "title 5\x00"]
    lib = spark.createDataFrame(rows, "path string, artist string, title string")
    got = resolve.typed(spark.createDataFrame([(a,) for a in asked], "asked string"), lib)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in got.collect():
        found.setdefault(r.asked, []).append((r.outcome, r.n, r.path))
    fold = lambda s: s.lower().replace("ß", "ss")
    for a in {a for a in asked if a}:
        hits = [p for p, artist, title in rows if fold(a) in fold(p.rsplit("/", 1)[1]) or fold(a) in fold(" — ".join(x for x in (artist, title or "") if x is not None))]
        if any(a == p for p, *_ in rows):
            want = [("path", 1, a)]
        else:
            want = [("one" if len(hits) == 1 else "several", len(hits), p) for p in hits] or [("none", 0, None)]
        assert sorted(found[a]) == sorted(want), a
    assert set(found) == {a for a in asked if a}


# --- frames ----------------------------------------------------------------------------------------


def test_first_frame_against_every_byte():
    def plain(data: bytes) -> int:
        def length(i):
            if i + 4 > len(data) or data[i] != 0xFF or data[i + 1] & 0xFE != 0xFA:
                return 0
            rate, sample = data[i + 2] >> 4, data[i + 2] >> 2 & 3
            return 0 if rate in (0, 15) or sample == 3 else 144000 * frames.BIT_RATES[rate] // frames.SAMPLE_RATES[sample] + (data[i + 2] >> 1 & 1)

        return next((k for k in range(min(len(data), frames.SEARCHED)) if (a := length(k)) and (b := length(k + a)) and length(k + a + b)), -1)

    draw = np.random.default_rng(4)
    frame = lambda third, n: bytes([0xFF, 0xFB, third, 0]) + bytes(n - 4)
    good = frame(0x90, 417) + frame(0x92, 418) + frame(0x90, 417)
    cases = [b"", b"\xff", bytes(3), good, bytes(77) + good, good[:-414], b"ID3" + bytes(500) + frame(0x90, 300) + good, b"\xff\xfb\xf0\x00" + good, frame(0x90, 417) * 2, bytes(frames.SEARCHED) + good, bytes(frames.SEARCHED - 1) + good]
    cases += [draw.choice(np.array([0xFF, 0xFB, 0xFA, 0x90, 0x10, 0], np.uint8), 3_000).tobytes() for _ in range(20)]
    for data in cases:
        assert frames.first_frame(data) == plain(data)
    assert frames.first_frame(None) == -1


def test_first_frames_of_streams_end_to_end(spark, sf, monkeypatch):
    """A chain that only the next stream would end is none; streams of a batch are looked at together, in parts of few bytes as well; one file of events is many tasks."""
    frame = lambda third, n: bytes([0xFF, 0xFB, third, 0]) + bytes(n - 4)
    good = frame(0x90, 417) + frame(0x92, 418) + frame(0x90, 417)
    streams = [good, None, frame(0x90, 417) * 2, good, b"", bytes(7) + good, good[:837], b"\x92\x00" + good, bytes(frames.SEARCHED) + good, bytes(frames.SEARCHED - 1) + good, b"\xff", b"\xfb\x90\x00" + good, None]
    want = [0, -1, -1, 0, -1, 7, -1, 2, -1, frames.SEARCHED - 1, -1, 3, -1]
    assert frames.first_in_each(streams).tolist() == want and frames.first_in_each([]).tolist() == []
    rows = spark.createDataFrame(list(enumerate(streams)), "i int, content binary").coalesce(1)
    for at_once in (frames.AT_ONCE, 1_000):
        monkeypatch.setattr(frames, "AT_ONCE", at_once)
        assert [r.at for r in rows.select("i", frames.first_frames(F.col("content")).alias("at")).orderBy("i").collect()] == want
    assert intake.first_frames(spark, sf).rdd.getNumPartitions() == intake.PARTS


def test_middle_of_a_file(spark):
    rows = [(300.0, 4_800_000), (150.0, 10_000), (150.5, 1_000), (None, 5), (200.0, None), (0.0, 10), (-5.0, 10), (200.0, 0), (float("nan"), 100), (float("inf"), 100), (300.0, 1)]
    got = [r.r for r in spark.createDataFrame(rows, "s double, n long").select(frames.middle_range(F.col("s"), F.col("n")).alias("r")).collect()]
    assert tuple(got[0]) == (1_280_000, 3_520_000, 80.0, 140.0) and tuple(got[10]) == (0, 0, 80.0, 140.0)
    assert [g is None for g in got[1:10]] == [True, False, True, True, True, True, True, True, True]


# --- batches ---------------------------------------------------------------------------------------


def test_one_bad_file_holds_nobody_up(spark, tmp_path):
    """Ten files in batches of four, one of them bad: it fails its batch, then only itself; a file without a row of its own fails too."""
    source, registry = tmp_path / "in", str(tmp_path / "registry")
    source.mkdir()
    clock, tried = {"now": 0}, []

    def process(plan):
        tried.append(sorted((r.batch, r.path) for r in plan.collect()))
        bad = plan.groupBy("batch").agg(F.bool_or(F.col("path") == "/bad.wav").alias("b")).select("batch", F.when(F.col("b"), "io").alias("failure"))
        return bad, plan.where("path <> '/lost.wav'").select("path", F.lit(None).cast("string").alias("failure"))

    t = lambda s: (dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)).isoformat()
    names = [f"/f{i}.wav" for i in range(8)] + ["/bad.wav", "/lost.wav"]

    def cycle(number):
        rows = [{"path": p, "size": 5, "mtime": t(1), "observed_at": t(100 * number + k)} for p in names for k in (0, 1)]
        (source / f"{number}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema("path string, size bigint, mtime timestamp, observed_at timestamp").json(str(source))
        watch.watch_batches(stream, registry, process, str(tmp_path / "checkpoint"), lambda: F.timestamp_seconds(F.lit(1_704_067_200 + clock["now"])), per_cycle=8, limit=4).awaitTermination()
        return {r.path: (r.state, r.attempts) for r in watch.latest(spark, registry).collect()}

    first = cycle(1)  # /bad, /f0, /f1, /f2 in one batch, /f3 to /f6 in the other
    assert {p for p, s in first.items() if s[0] == "alone"} == {"/bad.wav", "/f0.wav", "/f1.wav", "/f2.wav"} and first["/f3.wav"] == ("done", 0) and "/f7.wav" not in first
    second = cycle(2)
    assert [b for b, _ in tried[1] if b.startswith("alone-")] == ["alone-/bad.wav", "alone-/f0.wav", "alone-/f1.wav", "alone-/f2.wav"]
    assert second["/bad.wav"] == ("failed", 1) and second["/f0.wav"] == ("done", 0) and second["/f7.wav"] == ("done", 0) and second["/lost.wav"] == ("failed", 1)
    clock["now"] = 121
    third = cycle(3)
    assert third["/bad.wav"] == ("failed", 2) and third["/lost.wav"] == ("failed", 1)  # what has no row isn't tried again
    # The last cycle once more, from the versions before it: the same registry.
    again = watch.latest(spark, registry, 2)
    plan = watch.planned(watch.pending(spark.createDataFrame([(p, 5, dt.datetime(2024, 1, 1, 0, 0, 1)) for p in names], "path string, size bigint, mtime timestamp"), again, F.timestamp_seconds(F.lit(1_704_067_321))), again, 8, 4)
    assert {r.path: (r.state, r.attempts) for r in watch.settled(again, plan, *process(plan), F.timestamp_seconds(F.lit(1_704_067_321))).collect()} == third


def test_singles_come_first(spark):
    files = spark.createDataFrame([(f"/{c}/x.wav", 1, None) for c in "abcdefgh"], "path string, size bigint, mtime timestamp")
    registry = spark.createDataFrame([("/h/x.wav", 1, None, "alone", 0, None), ("/g/x.wav", 1, None, "alone", 1, None)], watch.REGISTRY)
    got = {r.path: (r.alone, r.batch) for r in watch.planned(files, registry, per_cycle=5, limit=8).collect()}
    assert set(got) == {"/g/x.wav", "/h/x.wav", "/a/x.wav", "/b/x.wav", "/c/x.wav"} and got["/h/x.wav"] == (True, "alone-/h/x.wav") and len({b for _, b in got.values()}) == 5


@pytest.mark.parametrize("failure, state", [(None, "done"), ("format", "failed")])
def test_a_single_file_keeps_its_attempts(spark, failure, state):
    at = dt.datetime(2024, 1, 1)
    registry = spark.createDataFrame([("/a", 1, at, "alone", 2, None), ("/b", 1, at, "done", 0, None)], watch.REGISTRY)
    tried = spark.createDataFrame([("/a", 1, at, "alone-/a")], "path string, size bigint, mtime timestamp, batch string")
    outcomes = spark.createDataFrame([("alone-/a", failure)], "batch string, failure string")
    rows = spark.createDataFrame([("/a", None)], "path string, failure string")
    got = {r.path: (r.state, r.attempts) for r in watch.settled(registry, tried, outcomes, rows, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()}
    assert got == {"/a": (state, 3 if failure else 0), "/b": ("done", 0)}
    # A batch that was cut off leaves no trace.
    assert {r.path: r.state for r in watch.settled(registry, tried, outcomes.where("false"), rows, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()} == {"/a": "alone", "/b": "done"}
