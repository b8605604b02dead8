from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.operators import edits, migrations, review, similar, tags

ITEM = "crate_id long, item_id long, position int, path string, name_id string"


def test_additions(spark):
    stored = spark.createDataFrame([(1, 10, 1, "/A.mp3", "a"), (1, 11, 2, None, "b")], ITEM)
    new = spark.createDataFrame([(1, 1, "/a.MP3", "z"), (1, 2, "/other.mp3", "a"), (1, 3, "/b.mp3", "b"), (1, 4, None, "a"), (1, 5, None, "c"), (1, 6, None, "c"), (2, 1, None, "c")], "crate_id long, seq long, path string, name_id string")
    decided = edits.outcomes(stored, new)
    got = {(r.crate_id, r.seq): (r.outcome, r.item_id) for r in decided.collect()}
    assert got == {(1, 1): ("known", 10), (1, 2): ("added", None), (1, 3): ("completed", 11), (1, 4): ("known", 10), (1, 5): ("added", None), (1, 6): ("known", None), (2, 1): ("added", None)}
    after = {(r.crate_id, r.item_id): (r.position, r.path) for r in edits.added(stored, decided, F.col("seq") + 100).collect()}
    assert after == {(1, 10): (1, "/A.mp3"), (1, 11): (2, "/b.mp3"), (1, 102): (3, "/other.mp3"), (1, 105): (4, None), (2, 101): (1, None)}


def test_copies_are_whole(spark):
    items = spark.createDataFrame([(1, 10, 1, None, "a"), (1, 11, 2, None, "b")], ITEM)
    wanted = spark.createDataFrame([(7, 1, 11, 0), (7, 1, 10, 1), (8, 1, 10, 0), (8, 1, 99, 1)], "new_crate long, crate_id long, item_id long, place int")
    assert sorted((r.crate_id, r.position, r.item_id) for r in edits.copied(items, wanted).collect()) == [(7, 1, 11), (7, 2, 10)]
    assert edits.copied(items, wanted.limit(0)).count() == 0


def test_crates(spark):
    crates = spark.createDataFrame([(1, "x", "r", True), (2, "x", "r", False), (3, None, None, False)], "crate_id long, origin string, origin_ref string, active boolean")
    assert [r.crate_id for r in edits.activated(crates, 2).where("active").collect()] == [2]
    assert [tuple(r) for r in edits.imported(crates).collect()] == [("x", "r", 1)]
    history = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "kind string, id long")
    assert sorted((r.kind, r.id) for r in edits.newest(history, 2).collect()) == [("a", 3), ("a", 4), ("b", 9)]
    genres = spark.createDataFrame([(" Deep \t House ",), ("",), (None,), ("x" * 80,)], "g string").select(edits.genre_to_store(F.col("g")).alias("g"))
    assert [r.g for r in genres.collect()] == ["Deep House", None, None, "x" * 60]


def test_tags(spark):
    raw = [("/in/One - Two (1).mp3", {"TPE1": " ", "ARTIST": "One", "----:x:initialkey": "8A", "COMM::eng": "8A - Energy 7"}), ("/in/x.mp3", None), ("/in/y.mp3", {"TIT2": "A - B (Official Video)", "TPE1": "C", "TKEY": "F#m"})]
    rows = {r.path: r for r in tags.diagnosed(spark.createDataFrame(raw, "path string, raw map<string,string>")).collect()}
    one, none, other = rows["/in/One - Two (1).mp3"], rows["/in/x.mp3"], rows["/in/y.mp3"]
    assert (one.artist, one.key, one.key_origin, one.comment_origin, one.tools, one.name_junk) == ("One", "8A", "mixed", "mixed", ["mixed"], ["copy number"])
    assert tuple(one.suggested) == ("One", "Two (1)")
    assert (none.n_tags, none.artist, none.key_origin, none.suggested, none.junk) == (0, "", "none", None, [])
    assert (other.suggested, other.junk, other.junk_fields, other.key_origin) == (None, ["official video"], ["title"], "external")
    assert {r.name: r.n for r in tags.audit(spark.createDataFrame(raw, "path string, raw map<string,string>").transform(tags.diagnosed)).collect()}["no title"] == 2


def test_write_plan(spark):
    columns = "path string, " + ", ".join(f"{f} string" for f in tags.FIELDS)
    before = spark.createDataFrame([("/a", "One", "T", "", "", "8A", "junk")], columns)
    after = spark.createDataFrame([("/a", "One", "New", None, "120", None, "")], columns)
    got = {r.field: (r.action, r.value) for r in tags.write_plan(before, after).collect()}
    assert got == {"artist": ("preserve", "One"), "title": ("write", "New"), "genre": ("omit", None), "bpm": ("write", "120"), "key": ("preserve", "8A"), "comment": ("empty", None)}


def test_reviews(spark):
    files = spark.createDataFrame([("suspicious", 3, " ", "t", 10.0), ("ok", 0, "a", "t", 300.0), ("ok", None, "a", "t", None)], "flag string, group int, artist string, title string, duration double")
    assert [(r.reasons, r.state, r.section) for r in review.reviewed(files).collect()] == [(list(review.REASONS), "pending", "suspicious"), ([], "approved", "approved"), (["not-a-track"], "pending", "not-a-track")]
    notes = spark.createDataFrame([("3/3",), ("2/3",), ("0/3",), (None,), ("odd",)], "a string").select(review.doubt_note(F.col("a"), F.lit(True)).alias("n"))
    assert [r.n for r in notes.collect()] == [None, "key 2/3", "key ?", "key ?", "key ?"]
    names = spark.createDataFrame([(".x",), ("~$x",), ("a.part",), ("a.temp.mp3",), ("a.mp3",), (None,)], "n string").select(review.in_the_way(F.col("n")).alias("x"))
    assert [r.x for r in names.collect()] == [True, True, True, True, False, None]


def test_similar(spark):
    rows = spark.createDataFrame([(1, i, "electronic", "House" if i < 5 else "Rock") for i in range(8)], "seed_id int, rank int, family string, genre string")
    assert similar.of_family(rows).count() == 8 and similar.of_family(rows, floor=5).count() == 5
    order = spark.createDataFrame([(1, 6, 0), (1, 2, 1), (1, 99, 2)], "seed_id int, rank_id int, wanted int")
    placed = similar.in_given_order(rows.withColumn("rank_id", F.col("rank")), order, "rank_id", "seed_id")
    assert [r.rank for r in placed.orderBy("place").collect()] == [6, 2, 0, 1, 3, 4, 5, 7]


def test_migrations(spark):
    old = spark.createDataFrame([("/A", -1.0, 1), ("/a", 2.0, 2)], "path string, rms double, analysed_at int")
    assert [(r.path, r.rms, r.agreement) for r in migrations.migrated(old, 0).collect()] == [("/a", 2.0, None)]
    with pytest.raises(ValueError):
        migrations.migrated(old, 9)
    cache = spark.range(20).select(F.col("id").cast("string").alias("path"), F.col("id").alias("mtime"))
    assert migrations.cache_kept(cache, 20).count() == 20
    assert sorted(r.mtime for r in migrations.cache_kept(cache, 10).collect()) == list(range(11, 20))
    marks = spark.createDataFrame([(5, "cue", 1, 0, None), (6, "memory", 1, 0, None), (7, "loop", None, 9, None), (8, "loop", None, 9, 9), (9, "odd", None, 0, None)], "mark_id long, kind string, num int, start_ms long, end_ms long")
    kept, lost = migrations.rebuilt_marks(marks)
    assert [r.mark_id for r in kept.collect()] == [5] and {r.mark_id: r.rule for r in lost.collect()} == {6: "memory-with-more", 7: "end-and-loop", 8: "end-before-start", 9: "kind"}
    assert migrations.next_id(marks, 50).first().next_id == 51 and migrations.next_id(marks.limit(0)).first().next_id == 1
