"""Readings of titles: layouts that uploads use, and what is cleaned off them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.operators import titles

CLEAN = {
    "Song (Official Video)": "Song", "Song [Drumcode]": "Song", "Song (Nuxx)": "Song (Nuxx)", "Creep [Part 2]": "Creep [Part 2]".replace("[", "(").replace("]", ")"), "Song (Radio Edit)": "Song (Radio Edit)",
    "Song (Original Mix) [Filth on Acid]": "Song (Original Mix)", "Song [KNTXT010]": "Song", "Song [Monstercat Release]": "Song", "Song #techno": "Song", "Part #52": "Part #52", "10. Song": "Song", "A2) Song": "Song", "1.5 Hours": "1.5 Hours",
    "Song.mp3": "Song", "PREMIERE: A - Song": "A - Song", "Song FREE DOWNLOAD": "Song", "Song （Official Audio）": "Song", "Song (Last Night in Vegas Visual)": "Song", "M83 'Midnight City' Official video": "M83 'Midnight City'",
    "Song (1998 Remastered Version) #02": "Song (1998 Remastered Version)", "Song (Album (Explicit))": "Song (Album )", "Song ()": "Song", "- Song |": "Song", "Song (Live at X) (Official Video)": "Song (Live at X)", "": "", "Song [Techno]": "Song",
}


def test_cleaned(spark):
    df = spark.createDataFrame([(k,) for k in CLEAN], "t string")
    got = {r.t: r.c for r in df.select("t", titles.cleaned_title(F.col("t")).alias("c")).collect()}
    assert got == CLEAN


READINGS = [
    ("Drake - God's Plan", "Some Channel", [("sides", "Drake", "God's Plan"), ("swapped", "God's Plan", "Drake")]),
    ("God's Plan - Drake (X Remix)", "Drake - Topic", [("turned", "Drake", "God's Plan (X Remix)")]),
    ("Kanye West- Stronger", "x", [("sides", "Kanye West", "Stronger"), ("swapped", "Stronger", "Kanye West")]),
    ("blink-182", "blink182VEVO", [("uploader", "blink182VEVO", "blink-182")]),
    ("YOASOBI「夜に駆ける」 Racing Into The Night", "Ayase", [("quoted", "YOASOBI", "夜に駆ける")]),
    ("YOASOBI「アイドル」", "Ayase", [("quoted", "YOASOBI", "アイドル")]),
    ("M83 'Midnight City' Official video", "m83", [("quoted", "M83", "Midnight City")]),
    ("Adele | Hello", "someone", [("bars", "Adele", "Hello")]),
    ("BICEP | GLUE (Official Video)", "BICEP", [("bars", "BICEP", "GLUE")]),
    ("Coldplay - Fix You | Glastonbury 2024", "BBC Music", [("sides", "Coldplay", "Fix You")]),
    ("GTG Premiere | Kashpitzky - For The Vision", "Get The Groove", [("sides", "Kashpitzky", "For The Vision"), ("swapped", "For The Vision", "Kashpitzky")]),
    ("Audio Bullys | We Don't Care - Radio Edit", "Audio Bullys", [("bars", "Audio Bullys", "We Don't Care - Radio Edit")]),
    ("Daft Punk Around the World", "Daft Punk", [("uploader", "Daft Punk", "Around the World")]),
    ("A - Song // CLIP", "x", [("sides", "A", "Song"), ("swapped", "Song", "A")]),
    (None, None, [("uploader", "", "")]), ("", "Ana", [("uploader", "Ana", "")]),
]


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(i, t, u, "x") for i, (t, u, _) in enumerate(READINGS)], "i int, title string, uploader string, readings_of string")
    return {r.i: r for r in titles.readings(df).collect()}


@pytest.mark.parametrize("i", range(len(READINGS)))
def test_readings(read, i):
    assert [(r.how, r.artist, r.title) for r in read[i].readings] == READINGS[i][2]


def test_second_names_and_occasions(read):
    at = {t: read[i].readings[0] for i, (t, _, _) in enumerate(READINGS)}
    assert at["YOASOBI「夜に駆ける」 Racing Into The Night"].other == "Racing Into The Night"
    assert at["Coldplay - Fix You | Glastonbury 2024"].event == "Glastonbury 2024" and at["Adele | Hello"].event is None


def test_titles_in_another_script(spark):
    cases = {"봄날 (Spring Day)": ["봄날", "Spring Day"], "Группа крови (Blood Type)": ["Группа крови", "Blood Type"], "Born Slippy (Nuxx)": [], "One (Your Name)": [], "봄날": [], "1979 (Live)": [], "봄날 (봄)": []}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.o for r in df.select("t", titles.other_titles(F.col("t")).alias("o")).collect()} == cases


def test_names(spark):
    cases = {"A & B feat. C": ["A", "B", "C"], "BTS (방탄소년단)": ["BTS"], "Yaz - Topic": ["Yaz"], "AdeleVEVO": ["Adele"], "A x B vs. C": ["A", "B", "C"], "": [], "Band Official": ["Band"], "Sandy": ["Sandy"], "A, , B": ["A", "B"], "Song 100, 01": ["Song 100", "01"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.o for r in df.select("t", titles.artist_names(F.col("t")).alias("o")).collect()} == cases


def test_search_texts(spark):
    rows = [("Chase & Status", "end credits", "radio edit", []), ("BTS", "봄날 spring day", None, ["spring day", "봄날"]), ("", "song", None, []), ("A", "", None, []), ("A, B, C, D", "t", "", [])]
    df = spark.createDataFrame(rows, "a string, t string, v string, o array<string>")
    got = [r.q for r in df.select(titles.search_texts(F.col("a"), F.col("t"), F.col("v"), F.col("o")).alias("q")).collect()]
    assert got[0] == ['artist:"Chase" track:"end credits"', 'artist:"Status" track:"end credits"', "Chase & Status end credits", "Chase & Status end credits radio edit", "Chase end credits", "Status end credits"]
    assert got[1] == ['artist:"BTS" track:"봄날 spring day"', "BTS 봄날 spring day", 'artist:"BTS" track:"spring day"', 'artist:"BTS" track:"봄날"']
    assert got[2] == got[3] == [] and len(got[4]) == 7
