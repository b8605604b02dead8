"""Queries over keys that only larger tables have."""

from __future__ import annotations

import shutil

import duckdb
import pandas as pd
import pytest

from cadenza.operators import export, resolve, station
from cadenza.plans import queries, session_sql


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """The smallest tables with parts beyond 1,000,000 in every other line, so that a later line has the smaller number."""
    out = tmp_path_factory.mktemp("large")
    for t in ("part", "lineitem"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", out)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{out}/part.parquet' UNION ALL SELECT * REPLACE (p_partkey + 1200000 AS p_partkey) FROM '{out}/part.parquet') TO '{out}/p.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (l_partkey + CASE WHEN l_linenumber % 2 = 1 THEN 1200000 ELSE 0 END AS l_partkey) FROM '{out}/lineitem.parquet') TO '{out}/l.parquet'")
    shutil.move(f"{out}/p.parquet", f"{out}/part.parquet")
    shutil.move(f"{out}/l.parquet", f"{out}/lineitem.parquet")
    return str(out)


def wanted(folder, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(session_sql.SQL[name])
    names = [d[0] for d in found.description]
    return sorted(tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in found.fetchall())


def test_artist_repeats_by_line_then_part(spark, large):
    got = queries.QUERIES["artist_repeats"](spark, large)
    assert sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) == wanted(large, "artist_repeats")


def test_station_tracks_of_one_place_have_an_order(spark):
    """Line 1 of part 1,000,050 and line 2 of part 50 have one place."""
    rows = [("s", 2_000_050, t, "0") for t in ("1000050", "50", "7")]
    for given in (rows, rows[::-1]):
        got = station.others(spark.createDataFrame(given, "station string, place long, track_id string, seed string").coalesce(1), "station", "track_id", "place", "seed")
        assert [(r.place, r.track_id) for r in got.orderBy("place").collect()] == [(1, "1000050"), (2, "50"), (3, "7")]


def test_typed_names_meet_few_items(spark):
    """Texts longer than a gram of three letters: what they meet grows with what they mean."""
    library = spark.createDataFrame([(f"/lib/{i:06d}", f"Artist_{i % 40}", f"Title {i}") for i in range(100_000, 102_000)], "path string, artist string, title string")
    asked = [f"TITLE {i}" for i in range(100_000, 102_000, 2)] + ["artist_7 — title 100847", "e 1000", "40 — Title 1", "9", "2_", "t_1 ", "title 10184", "nobody 5"]
    got = resolve.typed(spark.createDataFrame([(a,) for a in asked], "asked string"), library).collect()
    items = [(r.path, r.path[5:], f"{r.artist} — {r.title}".lower()) for r in library.collect()]
    want = set()
    for a in asked:
        hits = [p for p, name, label in items if a.lower() in name or a.lower() in label]
        want |= {(a, "one" if len(hits) == 1 else "several", len(hits), p) for p in hits} or {(a, "none", 0, None)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    met = resolve.met(spark.createDataFrame([(a.lower(),) for a in asked[:1000]], "text string"), library.selectExpr("path", "substr(path, 6) AS name", "lower(concat_ws(' — ', artist, title)) AS label"))
    assert met.count() <= 2 * 1000


def test_collections_with_repeats_ties_and_bare_tracks(spark):
    rows = [(1, 1, "/b"), (1, 0, "/a"), (1, 2, "/b"), (1, 3, None), (2, 0, "/c"), (3, 0, None)]
    items = spark.createDataFrame([(*r, r[2], None, 120.0, "8A", 200.0) for r in rows], "crate_id long, position int, path string, title string, artist string, bpm double, key string, duration double")
    # Two loops of one start: by their ends as numbers, not as text.
    marks = spark.createDataFrame([("/b", "loop", None, 5, 10_000), ("/b", "loop", None, 5, 9_000), ("/b", "cue", 1, 1, None)], "path string, kind string, num int, start_ms long, end_ms long")
    got = {r.crate_id: r.xml for r in export.collections(items, marks).collect()}
    assert got.keys() == {1, 2}
    assert '<COLLECTION Entries="2"><TRACK TrackID="2" Name="/a"' in got[1] and '<NODE Name="1" Type="1" KeyType="0" Entries="3"><TRACK Key="2"/><TRACK Key="3"/><TRACK Key="3"/>' in got[1]
    assert got[1].index('Num="1" Start="0.001"') < got[1].index('End="9.000"') < got[1].index('End="10.000"') and "POSITION_MARK" not in got[2]
    # Marks travel deflated.
    text = "".join(f'<POSITION_MARK Type="0" Num="-1" Start="{i * 7.123:.3f}"/>' for i in range(30))
    packed = export._packed(pd.Series([text, None]))
    assert export._unpacked(packed[0]) == text and packed[1] is None and len(packed[0]) < len(text) / 4
