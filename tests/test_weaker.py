"""Agreement groups, genre filters, long editions, stored standards, grids in collections."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import export, identity, library, search, sessions


def test_a_second_pass_without_consensus_is_refused(spark):
    first = spark.createDataFrame([("a", "8A")], "path string, key string")
    for second in ([("a", None, "8A")], [("a", "  ", "8A")], []):
        with pytest.raises(ValueError):
            sessions.merged_agreement(first, spark.createDataFrame(second, "path string, agreement string, votes string"))
    got = sessions.merged_agreement(first, spark.createDataFrame([(" a ", "2/3", "8A"), ("b", None, "")], "path string, agreement string, votes string")).first()
    assert (got.agreement, got.outcome) == ("2/3", "merged")


def test_genres(spark):
    rows = [("Deep House", "x"), ("house", "x"), ("Techno", "House Music"), (None, "y"), ("", "y"), ("Rock", None), ("ous", "z")]
    got = {(r.genre, r.title): r.likeness for r in search.by_genre(spark.createDataFrame(rows, "genre string, title string"), F.lit("HOUSE")).collect()}
    assert got == {("Deep House", "x"): 1.0, ("house", "x"): 1.0, ("Techno", "House Music"): 0.7, (None, "y"): 1.0, ("", "y"): 1.0, ("ous", "z"): 1.0}


@pytest.mark.parametrize(
    "wanted, found, yes",
    [
        (("Ana", "Song"), ("Ana", "Song (Extended Mix)"), True), (("Ana", "Song (Radio Edit)"), ("Ana", "Song (Extended)"), True), (("Ana", "Song"), ("Ana", "Song (Original Mix)"), True), (("Ana", "Song"), ("Ana", "Song"), False),
        (("Ana", "Song (Omnya Remix)"), ("Ana", "Song (Omnya Remix Extended)"), True), (("Ana", "Song (Omnya Remix)"), ("Ana", "Song (Extended Mix)"), False), (("Ana", "Song"), ("Ana", "Song (Omnya Remix Extended)"), False),
        (("Ana", "Song"), ("Bo", "Song (Extended Mix)"), False), (("Ana", "Song"), ("Ana", "Other (Extended Mix)"), False), (("Ana", "Song (Omnya Remix)"), ("Ana", "Song (Bo Remix Extended)"), False),
    ],
)
def test_long_editions(spark, wanted, found, yes):
    df = spark.createDataFrame([(*wanted, *found)], "w_artist string, w_title string, c_artist string, c_title string")
    assert identity.extended_of(identity.identified(identity.identified(df, "w_"), "c_")).first().extended == yes


def test_stored_standards_give_the_librarys_own_rows(spark):
    draw = np.random.default_rng(4)
    rows = [(f"p{i}", [*draw.normal(size=5).tolist(), 3.0], float(i)) for i in range(30)]
    lib = spark.createDataFrame(rows, "path string, embedding array<double>, energy_raw double")
    stats = library.dimension_stats(lib)
    a, b = ({r.path: r.timbre for r in df.collect()} for df in (library.contextual(lib), library.standardised(lib.select("path", "embedding"), stats)))
    assert a.keys() == b.keys() and all(np.array_equal(a[p], b[p]) for p in a)
    mean = [r["mean"] for r in stats.orderBy("place").collect()]
    assert library.standardised(spark.createDataFrame([("m", mean)], "path string, embedding array<double>"), stats).first().timbre == [0.0] * 6


def test_grids_in_collections(spark):
    items = spark.createDataFrame([(1, i, p, p, None, 120.0, "8A", 200.0) for i, p in enumerate(("/a", "/b", "/c", "/d"))], "crate_id int, position int, path string, title string, artist string, bpm double, key string, duration double")
    marks = spark.createDataFrame([("/a", "cue", 0, 1500, None), ("/b", "cue", 1, 10, None)], "path string, kind string, num int, start_ms long, end_ms long")
    grids = spark.createDataFrame([("/a", 120.004, 0.1, 0.6), ("/c", 99.5, 0.0, 0.0), ("/d", 120.0, 0.2, None)], "path string, bpm double, first_beat double, bar_start double")
    xml = export.collections(items, marks, grids=grids).first().xml
    assert '<TEMPO Inizio="0.600" Bpm="120.00" Metro="4/4" Battito="1"/><POSITION_MARK Type="0" Num="0"' in xml and xml.count("<TEMPO") == 2 and xml.count("<POSITION_MARK") == 2
    assert '<TEMPO Inizio="0.000" Bpm="99.50" Metro="4/4" Battito="1"/></TRACK>' in xml
    assert export.collections(items, marks).first().xml.count("TEMPO") == 0
