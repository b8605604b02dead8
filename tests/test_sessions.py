from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import rules, tempo
from cadenza.operators import audits, export, sessions, station, trees


def test_routes_of_deep_trees_and_loops(spark):
    deep = [(i, i - 1 if i else None, f"n{i}") for i in range(40)] + [(100, 999, "lost")]
    got = {r.node: r.route for r in trees.routes(spark.createDataFrame(deep, "node long, parent long, name string")).collect()}
    assert got[0] == "n0" and got[39] == " / ".join(f"n{i}" for i in range(40)) and got[100] == "lost"
    with pytest.raises(ValueError):
        trees.routes(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "node long, parent long, name string"))
    assert trees.routes(spark.createDataFrame([], "node long, parent long, name string")).count() == 0


def test_entries_by_number_and_place(spark):
    tracks = spark.createDataFrame([("7", "/M/A.mp3"), ("3", "/m/a.mp3"), ("9", "")], "track_id string, location string")
    rows = [(1, 1, False, " 7 "), (1, 2, False, "8"), (1, 3, True, "/m/A.MP3"), (1, 4, True, "/gone.mp3"), (1, 5, True, ""), (1, 6, False, "7"), (1, 7, False, None)]
    found = trees.entries(spark.createDataFrame(rows, "node int, place int, by_location boolean, key string"), tracks)
    assert [r.track_id for r in found.orderBy("place").collect()] == ["7", None, "3", "loc:/gone.mp3", None, "7", None]
    states = spark.createDataFrame([("7", "ok"), ("3", "ambiguous")], "track_id string, state string")
    assert tuple(trees.summary(found, states).first()) == (1, 4, 2, 1, 1, 3)


def test_mode_is_not_the_relative(spark):
    pairs = [("8A", "11B"), ("8A", "8B"), ("8A", "8A"), ("?", "8A"), (None, "8A")]
    got = spark.createDataFrame(pairs, "a string, b string").select(sessions.mode_error(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False, False, False]


def test_samples_hold_and_sessions_resume(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("p"), "id").alias("path"))
    one = [r.path for r in sessions.sampled(rows, "path", 20, 3).collect()]
    assert one == sorted(one) and len(one) == 20
    assert one == [r.path for r in sessions.sampled(rows.repartition(5).orderBy(F.rand()), "path", 20, 3).collect()] != [r.path for r in sessions.sampled(rows, "path", 20, 4).collect()]
    worked = []

    def work(df):
        worked.append(df.count())
        return df.withColumn("done", F.lit(1))

    where = str(tmp_path / "session")
    assert sessions.resumed(rows.where("path < 'p15'"), where, ["path"], work).count() == rows.where("path < 'p15'").count()
    assert sessions.resumed(rows, where, ["path"], work).count() == 200 == sum(worked)


def test_passes_put_together(spark):
    first = spark.createDataFrame([("a", "8A"), ("b", "1A"), ("c", "2A"), (None, "3A")], "path string, key string")
    second = spark.createDataFrame([("a", "2/3", "x"), ("b", "1/3", "x"), ("b", "3/3", "y"), ("d", "1/1", "z")], "path string, agreement string, votes string")
    got = {r.path: (r.key, r.agreement, r.outcome) for r in sessions.merged_agreement(first, second).collect()}
    assert got == {"a": ("8A", "2/3", "merged"), "b": ("1A", None, "repeated"), "c": ("2A", None, "unpaired"), None: ("3A", None, "unpaired")}


def test_records_of_a_service(spark):
    texts = [
        '{"id": 5, "title": " A ", "user": {"username": "u"}, "full_duration": 0, "duration": 90050, "media": {"transcodings": [{"snipped": false, "format": {"protocol": "progressive"}}]}}',
        '{"id": 6, "title": "B", "policy": "SNIP", "media": {"transcodings": [{"format": {"protocol": "hls"}}]}}',
        '{"id": 7, "title": "C", "kind": "playlist"}', '{"id": "x", "title": "D"}', '{"id": 8, "title": " "}', "junk", None, '{"id": 9, "title": "E", "streamable": false, "media": null}',
    ]
    got = station.tracks(spark.createDataFrame(list(enumerate(texts)), "place int, record string")).collect()
    assert [(r.track_id, r.title, r.artist, r.duration, r.playable, r.preview) for r in got] == [("5", "A", "u", 90.1, True, False), ("6", "B", "", None, False, True), ("9", "E", "", None, False, False)]
    rows = spark.createDataFrame([(1, 1, "5", "5"), (1, 2, "6", "5"), (1, 3, "6", "5"), (1, 4, "7", "5")], "station int, place int, track_id string, seed string")
    assert [(r.place, r.track_id) for r in station.others(rows, "station", "track_id", "place", "seed").orderBy("place").collect()] == [(1, "6"), (2, "7")]


def test_mixing_order_names_what_is_left(spark):
    draw = np.random.default_rng(4)
    vector = lambda: draw.normal(size=6).tolist()
    rows = [(1, i, f"t{i}", bpm, "8A", 0.5, "a", length, v) for i, (bpm, length, v) in enumerate([(None, 200.0, None), (120.0, 200.0, vector()), (122.0, 200.0, vector()), (121.0, 40.0, vector()), (95.0, 200.0, vector()), (123.0, 200.0, vector())])]
    df = spark.createDataFrame([*rows, rows[2], (2, 0, "x", None, None, None, None, None, None)], "station int, position int, track_id string, bpm double, key string, energy double, artist string, duration double, timbre array<double>")
    got = {(r.station, r.track_id): (r.place, r.part, r.reason) for r in station.mixing_order(df).collect()}
    assert got[(1, "t1")] == (0, "set", "") and {got[(1, t)][1] for t in ("t2", "t5")} == {"set"}
    assert got[(1, "t3")][1:] == ("left", "fragment") and got[(1, "t4")][1:] == ("left", "out-of-range")
    assert got[(1, "t0")] == (5, "unanalysed", "not-analysed") and got[(2, "x")][1] == "unanalysed" and len(got) == 7
    c = spark.createDataFrame([(95.0, [120.0], 200.0), (121.0, [120.0], 200.0), (121.0, [120.0], 40.0)], "b double, t array<double>, d double")
    assert [r[0] for r in c.select(station.left_out(F.col("b"), F.col("t"), F.col("d"), tempo.passes)).collect()] == ["out-of-range", "cut-off", "fragment"]


def test_windows_against_loops(spark):
    x = [0.1, 0.9, 0.3, 0.2, 0.8, 0.4, 0.7]
    row = spark.createDataFrame([(x,)], "x array<double>").select(audits.max_after(F.col("x"), 3).alias("a"), audits.line_maxima(F.col("x"), F.lit(0.1), F.lit(0.3), -0.1, 0.1, 10).alias("l")).first()
    assert row.a == [max(x[i : i + 3]) for i in range(len(x))]
    assert row.l == [max(x[i : i + 3]) for i in (0, 3)]
    rows = spark.createDataFrame([(1, float(w)) for w in (1, 2, 3, 3, 3)], "g int, w double")
    assert sorted(r.w for r in audits.largest(rows, "w", 0.2, ["g"]).collect()) == [3.0, 3.0, 3.0]


def test_faults(spark):
    rows = [(None, None), ("2/3", "a|b|c"), ("0/0", ""), ("3/2", "a|b"), ("2/3", "a"), ("x", "a"), (None, "a")]
    got = spark.createDataFrame(rows, "a string, v string").select(rules.agreement_fault(F.col("a"), F.col("v"))).collect()
    assert [r[0] for r in got] == [None, None, None, "more-than-all", "votes-differ", "form", "half-absent"]
    rows = [("ok", None), ("bad", " "), ("bad", "x"), ("Bad", "x"), (None, None), ("fair", "y" * 1001)]
    assert [r[0] for r in spark.createDataFrame(rows, "a string, v string").select(rules.rating_fault(F.col("a"), F.col("v"))).collect()] == [None, "no-reason", None, "rating", "rating", "long-reason"]


def test_play_list_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "/a.mp3", 120.0, "8A", 0.5, "Ann", "Tüne", 60.0), (2, 1, "/b.mp3", None, None, None, None, "B", None)], "set_id int, position int, path string, bpm double, key string, energy double, artist string, title string, duration double")
    export.write_playlists(rows, str(tmp_path / "lists"))
    (file,) = (tmp_path / "lists" / "set_id=1").glob("*.txt")
    assert file.read_bytes().decode("utf-8") == export.playlists(rows).where("set_id = 1").first().text and not file.read_bytes().startswith(b"\xef\xbb\xbf")
