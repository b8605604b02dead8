"""Work by classes of equal rows: the results are those of all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cadenza.functions.scoring import SetConfig
from cadenza.operators import bridge, duplicates, identity, neighbours, setbuilder


def test_degree_is_that_of_all_pairs(spark, monkeypatch):
    bpms, keys = (0.0, 60.0, 61.0, 120.0, 120.5, 125.0, 240.0, None), ("8A", "08a", "9A", "?", None, "3B")
    rows = [(f"/{i:03d}", bpms[i % 8], keys[i % 6]) for i in range(120)] + [("/005", 90.0, "8A"), ("/011", 121.0, "9A")]
    df = spark.createDataFrame(rows, "path string, bpm double, key string")
    pairs = neighbours.mixable_pairs(df, df).groupBy("from_path").agg(F.count(F.lit(1)).alias("partners"), F.round(F.max("mix"), 9).alias("best"), F.round(F.avg("mix"), 9).alias("mean"))
    sizes = []
    plain = neighbours.mixable_pairs
    monkeypatch.setattr(neighbours, "mixable_pairs", lambda a, b: sizes.append(a.count() * b.count()) or plain(a, b))
    got = neighbours.mixable_degree(df).select("from_path", "partners", F.round("best", 9).alias("best"), F.round("mean", 9).alias("mean"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))
    assert sum(sizes) < 45 * 45


def test_matched_is_all_pairs_arbitrated(spark):
    artists = ("Ana", "Ana & Bo", "The Great Bo", "Bo feat. Ana", "Cy", "", "The Tribute Bo")
    titles = ("Sun", "Sun (Extended Mix)", "Sun (Radio Edit)", "Sun (feat. Ana)", "Moon (Di Remix)", "Moon", "Lone", "")
    lengths = (200.0, 204.0, 260.0, None)
    rows = [(i, artists[i * 5 % 7], titles[6 if i == 0 else (i * 3 + i // 7) % 8], lengths[i * i % 11 % 4]) for i in range(330)]
    rows = [r for r in rows if r[0] == 0 or r[2] != "Lone"] + [(1_000, "Di", "Fog", 200.0), (1_001, "Di", "Fog", 300.0), (1_002, "Di", "Fog", 400.0)]
    known = identity.identified(spark.createDataFrame(rows, "id long, artist string, title string, seconds double"))
    w, c = (known.select(*(F.col(x).alias(f"{n}_{x}") for x in known.columns)) for n in ("w", "c"))
    pairs = w.join(c, (F.col("w_base") == F.col("c_base")) & (F.col("w_id") != F.col("c_id"))).withColumn("isrc", F.lit(False))
    want = identity.arbitrated(identity.evidence(pairs).withColumnsRenamed({"w_id": "wanted_id", "c_id": "candidate_id"}))
    columns = ["wanted_id", "candidate_id", "grade", "outcome"]
    want = sorted(map(str, want.select(*columns).collect()))
    assert sorted(map(str, identity.matched(known).select(*columns).collect())) == want
    assert len({x.split("outcome=")[1] for x in want}) >= 3


def test_bridges_over_equal_items_take_the_least(spark):
    """Many items of one tempo and key: only as many are tried as a bridge can use, those of least path."""
    rows = [("S", 120.0, "8A", 300.0), ("G", 128.0, "9A", 300.0), ("a0", 124.0, "8A", 30.0)] + [(f"a{i:02d}", 124.0, "8A", 300.0) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "path string, bpm double, key string, duration double")
    assert bridge.stand_ins(df.where("duration >= 90"), 4).where("path LIKE 'a%'").count() == 4
    pairs = spark.createDataFrame([("S", "G")], "start string, goal string")
    assert bridge.bridges(pairs, df, 1, 2).first().found == ["S", "a01", "G"]
    assert bridge.bridges(pairs, df, 2, 2).first().found == ["S", "a01", "a02", "G"]


def test_a_set_looks_at_few_items_and_takes_the_best(monkeypatch):
    """Every look at ranges of tempo gives the set that a look at all tracks gives."""
    rng = np.random.default_rng(3)
    n = 600
    v = rng.normal(size=(n, 8))
    rows = pd.DataFrame({"path": [f"/m/{i:04}" for i in range(n)], "bpm": rng.integers(120, 400, n) / 2.0, "key": [f"{i % 12 + 1}{'AB'[i % 2]}" if i % 19 else "?" for i in range(n)], "energy": rng.random(n), "artist": [f"a{i % 40}" for i in range(n)], "track": rng.random(n) < 0.9})
    rows["timbre"] = list(v / np.linalg.norm(v, axis=1, keepdims=True))
    rows.loc[::97, "bpm"] = 0.0
    shelf, looks = setbuilder.Shelf(rows), []
    near = setbuilder.Shelf.near
    monkeypatch.setattr(setbuilder.Shelf, "near", lambda self, at, least: looks.append(len(got := near(self, at, least))) or got)
    few = [setbuilder.one_set(shelf, s, SetConfig()) for s in range(0, n, 12)]
    assert np.mean(looks) < n / 8
    monkeypatch.setattr(setbuilder, "FIRST_LOOK", 0.0)
    assert [[r[2] for r in s] for s in few] == [[r[2] for r in setbuilder.one_set(shelf, s, SetConfig())] for s in range(0, n, 12)]


def test_explained_pairs_of_classes_are_those_of_items(spark):
    rows = [(f"/{i % 70}", [120.0, 121.5, 62.0, 0.0, 124.0][i % 5], ["8A", "9A", "?", " 08a"][i % 4]) for i in range(75)]
    lib = spark.createDataFrame(rows, "path string, bpm double, key string")
    columns = ["from_path", "to_path", "mix", "delta_percent", "reading", "relation", "compat"]
    want = neighbours.explained(neighbours.mixable_pairs(lib, lib)).select(*columns)
    got = neighbours.mixable_explained(lib).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_duplicates_in_blocks_are_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"/{i % 115:03}", float(rng.integers(80, 130)), rng.normal(size=4 if i % 9 else 5).tolist()) for i in range(120)] + [("/x", 90.0, [1.0] * 4), ("/y", 0.0, [1.0, 2.0, 3.0, 4.0])]
    lib = spark.createDataFrame(rows, "path string, duration double, print array<double>")
    monkeypatch.setattr(duplicates, "BLOCK", 10)
    monkeypatch.setattr(duplicates, "AT_ONCE", 2)
    got = sorted((r.a, r.b, round(r.similarity, 9)) for r in duplicates.pairs(lib, 0.5).collect())
    agree = lambda x, y: min(x, y) > 0 and abs(x - y) <= max(2.0, min(x, y) * 0.02)
    known = [r for r in rows if np.std(r[2]) > 0]
    met = [(a[0], b[0], float(np.corrcoef(a[2], b[2])[0, 1])) for a in known for b in known if a[0] < b[0] and len(a[2]) == len(b[2]) and agree(a[1], b[1])]
    assert got == sorted((a, b, round(c, 9)) for a, b, c in met if c >= 0.5) and len(got) > 20
