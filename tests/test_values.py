from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import values


def of(spark, rows, f, schema):
    df = spark.createDataFrame(rows, schema)
    return [r.x for r in df.select(f(*map(F.col, df.columns)).alias("x")).collect()]


def test_numbers(spark):
    assert of(spark, [(0.0125,), (-1.0,), (86400.0,), (float("nan"),), (float("inf"),), (None,)], values.milliseconds, "s double") == [12, None, 86_400_000, None, None, None]
    assert of(spark, [(0.125,), (0.005,), (0.015,)], values.percent_shown, "s double") == [12, 0, 2]
    assert of(spark, [(1250,), (0,), (None,)], values.seconds_shown, "s long") == [1.3, None, None]


def test_marks(spark):
    assert of(spark, [("cue", 0), ("cue", 8), ("cue", None), ("loop", None), ("memory", None)], values.mark_colour, "k string, n int") == ["#ff4d5a", None, None, "#ff9a2e", None]
    assert of(spark, [("0", "-1"), ("4", "6"), ("9", "8"), ("0", "x")], values.mark_class, "k string, n string") == ["memory cue", "hot loop G", "Type 9 (Num 8)", "cue (Num x)"]
    assert of(spark, [(120.0, 0.1, 1.5), (120.0, None, 1.5), (0.0, 0.1, 1.5), (120.0, 0.1, -1.0)], values.tempo_attributes, "b double, f double, d double") == ['Inizio="1.500" Bpm="120.00" Metro="4/4" Battito="1"', None, None, None]


def test_texts(spark):
    assert of(spark, [("A - B", "A"), ("a - B", "A"), ("A - ", "A"), ("A - B", None)], values.title_alone, "t string, a string") == ["B", "a - B", "A - ", "A - B"]
    assert of(spark, [("file://localhost/C:/a%20b+c.wav",), ("file:///home/x.wav",), (None,)], values.local_path, "a string") == ["C:/a b+c.wav", "/home/x.wav", None]
    assert of(spark, [("a\\b",), ("/a",), ("C:\\a",), ("a/../b",), ("./a//b",), ("a..b",)], values.relative_path, "t string") == ["a/b", None, None, None, "a/b", "a..b"]
    assert of(spark, [('{"curve": "flat"}',), ("{",), (None,), ("{}",)], values.curve_of, "c string") == ["flat", None, None, None]
    assert of(spark, [("a/b: c. ",), (" . ",), ("x" * 200,)], values.safe_file_name, "t string") == ["a_b_ c", "unnamed", "x" * 120]
