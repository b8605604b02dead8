"""Work and intermediate tables of queries that must grow no faster than what they read."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions import grids, keys
from cadenza.operators import crates, duplicates, edits, neighbours, resolve, review, search
from cadenza.plans import queries, upkeep
from cadenza.sources.staging import shared_dir


def test_prints_on_other_grids_store_no_pairs(spark, monkeypatch):
    """60 recordings of near lengths, over two grids, in blocks of few: copies are found, and no table has a row for each pair of lengths."""
    monkeypatch.setattr(duplicates, "PRINT_BLOCK", 4_000, raising=False)
    rate, rows = 208, []
    for i in range(30):
        draw = np.random.default_rng(i)
        y = draw.normal(size=97 * rate) * np.repeat(draw.uniform(0.1, 3, 97), rate)
        rows += [(f"a{i:02}", y[: int(95.5 * rate)]), (f"b{i:02}", y)]
    audio = spark.createDataFrame([(p, len(y) / rate, y.tolist()) for p, y in rows], "path string, duration double, pcm array<double>")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    got = {(r.a, r.b): r.regridded for r in duplicates.regridded_pairs(audio, rate, low=2.0, high=100.0).collect()}
    assert got == {(f"a{i:02}", f"b{i:02}"): True for i in range(30)}
    assert max(spark.read.parquet(str(p)).count() for p in set(folder.iterdir()) - before) <= 3 * len(rows)


def test_bins_of_curves_are_in_no_shuffle(spark):
    rows = spark.createDataFrame([(1, 0.1, 1.0, 0.5, 2.0)], "key long, t double, w double, period double, beats double")
    plan = grids.phase_curves(rows, "key", 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_bands_are_sorted_once(spark):
    rows = spark.createDataFrame([([[1.0, 0.5], [0.2, 0.1]],)], "bands array<array<double>>")
    plan = rows.select(grids.normalised(rows.bands).alias("q"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("sort_array(") + plan.count("array_sort(") == 1


def test_tops_are_those_of_curves():
    draw = np.random.default_rng(4)
    t, w, bpms = np.sort(draw.uniform(0, 12, 200)), draw.uniform(0, 1, 200), np.arange(119.5, 120.5, 0.01)
    height, top, bins = grids._tops(t, w, 60 / bpms, 12 * bpms / 60, 100)
    for i, bpm in enumerate(bpms):
        curve = grids.phase_curve(t, w, 60 / bpm, 12 * bpm / 60, 100)
        assert (height[i], top[i], bins[i]) == (curve.max(), curve.argmax(), len(curve))


def test_vectors_are_copied_a_bounded_number_of_times(spark, monkeypatch):
    """20 copies of a row at 600,000 and 7 a side below; blocks of few give the same, also of many equal vectors."""
    for name, value in (("SMALL_BLOCK", 10), ("SAMPLE", 12), ("AT_ONCE", 50)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    draw = np.random.default_rng(6)
    x = np.concatenate([np.repeat(draw.normal(size=(4, 64)), 15, axis=0), draw.normal(size=(20, 64))])
    lib = spark.createDataFrame([(f"p{i:03}", v.tolist()) for i, v in enumerate(x)] + [("nan", [float("nan")] * 64)], "path string, timbre array<double>")
    got = sorted((r.seed, r["rank"], r.path) for r in neighbours.nearest(lib, lib, 5).collect())
    score = (x[:, None, :] * x[None, :, :]).sum(axis=2)
    best = [[j for j in np.lexsort((np.arange(80), -score[i])) if j != i][:5] for i in range(80)]
    assert got == [(f"p{i:03}", k + 1, f"p{j:03}") for i in range(80) for k, j in enumerate(best[i])]
    monkeypatch.undo()
    assert neighbours.blocks(100_000) == neighbours.blocks(10_000) and 2 * neighbours.blocks(600_000) <= 20


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_additions_are_shuffled_once(spark):
    items = spark.createDataFrame([(1, 1, 1, "/a", "x"), (1, 2, 2, None, "y"), (None, 3, 1, "/n", "n")], "crate_id long, item_id long, position int, path string, name_id string")
    new = spark.createDataFrame([(1, 1, "/A", "q"), (1, 2, "/B", "y"), (1, 3, None, None), (1, 4, "/b", None), (None, 5, "/N", "n")], "crate_id long, seq long, path string, name_id string")
    out = edits.outcomes(items, new)
    assert _exchanges(out) == 1
    assert {(r.seq, r.outcome, r.item_id) for r in out.collect()} == {(1, "known", 1), (2, "completed", 2), (3, "added", None), (4, "added", None), (5, "added", None)}


def test_exports_read_their_items_once(spark):
    items = spark.createDataFrame([(1, 1, 2, "/b", True, "analysed"), (1, 2, 1, "/a", True, "analysed"), (1, 3, 3, "/b", True, "analysed"), (1, 4, 0, "/c", False, "analysed"), (1, 5, 4, None, True, "analysed")], "crate_id long, item_id long, position int, path string, file_ok boolean, state string")
    lib = spark.createDataFrame([("/a", True), ("/b", True), ("/c", True)], "path string, current boolean")
    out = review.export_status(items, lib, lib.select("path"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD[crate_id") == 1
    assert {(r.item_id, r.status, r.entry) for r in out.collect()} == {(1, "ready", 2), (2, "ready", 1), (3, "ready", 2), (4, "no-file", None), (5, "not-analysed", None)}


def test_counts_of_eligibility_without_a_row_for_each_genre(spark, sf):
    items = upkeep.ordered_items(spark, sf)
    more = items.unionByName(items.withColumn("item_id", F.col("item_id") + 10**9).withColumn("position", F.col("position") + 10))
    for rows in (items, more):
        want, got = crates.eligibility_summary(crates.eligible(rows)), crates.eligibility_counts(rows)
        assert want.dtypes == got.dtypes and sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))


def test_a_key_is_read_once_for_each_item_of_a_pair(spark):
    """Number and side of two keys: eight patterns at most (they were 76, 466 and 154), whatever the rule does with them; all spellings and what is no key give what they gave."""
    texts = ["1A", " 1b ", "01A", "12A", "2A", "3A", "11B", "7A", "?", "", None, "13A"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for rule in (keys.relation, keys.compat, keys.steps):
        plan = rows.select(rule(F.col("a"), F.col("b")))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") <= 8  # NULLIF may name its own twice

    def plain(a: str | None, b: str | None) -> str:
        read = [re.fullmatch(r"\s*(0?[1-9]|1[0-2])\s*([ABab])\s*", x or "") for x in (a, b)]
        if None in read:
            return "unknown"
        turn = (int(read[0][1]) - int(read[1][1])) % 12
        turn, level = min(turn, 12 - turn), read[0][2].upper() == read[1][2].upper()
        return ("same", "neighbour", "two")[turn] if level and turn < 3 else "relative" if turn == 0 else "far"

    got = rows.select("a", "b", *(f(F.col("a"), F.col("b")).alias(n) for n, f in (("r", keys.relation), ("c", keys.compat), ("s", keys.steps)))).collect()
    for r in got:
        name = plain(r.a, r.b)
        assert (r.r, r.c, r.s) == (name, keys.COMPAT[name], {"same": 0, "neighbour": 1, "relative": 1}.get(name, 2)), r


def test_a_result_is_taken_apart_once(spark, sf):
    """Once for each text that scores need, not once for each place in their rule; and tokens are in no shuffle."""
    rows = spark.createDataFrame([(1, "one two", "x y")], "query_id long, title string, artist string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(search.scored(rows, F.lower("title"))).count("sort_array(") == 2
    text = plan(queries.search_relevance(spark, sf))
    assert text.count("sort_array(") == 1 and text.index("sort_array(") < text.index("Exchange hashpartitioning")


def test_locations_and_files_of_a_common_name_are_not_paired(spark):
    """40 of each with one name: no join, and the path, a tail, the name and nothing are told apart; a location with .. has no tails; nulls count for nothing."""
    files = spark.createDataFrame([(f"/r/{i}/same.mp3",) for i in range(40)] + [(None,), ("/r/1/same.mp3",), ("/r/only.mp3",)], "path string")
    asked = [f"/x/{i}/same.mp3" for i in range(40)] + ["/r/3/same.mp3", "D:\\r\\4\\SAME.mp3", "/y/same.mp3", "/r/../5/same.mp3", "/z/only.mp3", "/z/none.mp3", "", "/r/", None]
    got = resolve.resolved(spark.createDataFrame([(a,) for a in asked], "location string"), files)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r.location: (r.state, r.path, r.step) for r in got.collect()}
    want = {f"/x/{i}/same.mp3": ("ok", f"/r/{i}/same.mp3", "tail") for i in range(40)} | {"/r/3/same.mp3": ("ok", "/r/3/same.mp3", "exact"), "D:\\r\\4\\SAME.mp3": ("ok", "/r/4/same.mp3", "tail")}
    want |= {"/y/same.mp3": ("ambiguous", None, "name"), "/r/../5/same.mp3": ("ambiguous", None, "name"), "/z/only.mp3": ("ok", "/r/only.mp3", "name")}
    assert found == want | {k: ("not-found", None, None) for k in ("/z/none.mp3", "", "/r/")}
