"""Metric levels, phases, beat grids, bands and prints on grids, against plain versions and planted sounds."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import grids, signal
from cadenza.operators import duplicates

RATE = grids.RATE


def test_comb_and_level_by_definition(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=60).tolist(), float(draw.uniform(2, 25)), float(draw.uniform(30, 200))) for i in range(200)] + [(200, [], 4.0, 100.0), (201, [1.0] * 60, 3.0, 120.0), (202, [0.0] * 60, 3.0, 120.0)]
    df = spark.createDataFrame(rows, "i int, ac array<double>, lag double, bpm double")
    got = {r.i: r for r in df.select("i", grids.comb(df.ac, df.lag).alias("comb"), grids.metric_level(df.ac, df.lag, df.bpm).alias("level")).collect()}
    comb = lambda ac, lag: sum(max(ac[k], 0.0) for m in range(1, 5) if (k := round(m * lag)) < len(ac))
    for i, ac, lag, bpm in rows:
        base, faster = comb(ac, lag), comb(ac, lag / 1.5)
        raised = 60 <= bpm * 1.5 <= 210 and faster > base and faster > base * 1.03
        assert math.isclose(got[i].comb, base, abs_tol=1e-12) and got[i].level == (bpm * 1.5 if raised else bpm)


def test_a_triplet_is_raised(spark):
    """A pulse of 170 that was read as 113.3: the comb of the shorter lag holds all of it."""
    lag = 60 / 170 * 100
    ac = [1.0 if min(k % lag, lag - k % lag) < 1 else 0.05 for k in range(600)]
    got = spark.createDataFrame([(ac,)], "ac array<double>").select(grids.metric_level(F.col("ac"), F.lit(lag * 1.5), F.lit(340 / 3))).first()[0]
    assert math.isclose(got, 170.0)


def plain_curve(t, w, period, beats, rate):
    bins = max(1, round(period / 0.001))
    width = period / bins
    half = max(1, round(1 / rate / width))
    h = [0.0] * bins
    for at, size in zip(t, w, strict=True):
        place = (at % period) / width
        left = math.floor(place)
        h[left % bins] += size * (1 - (place - left))
        h[(left + 1) % bins] += size * (place - left)
    return [sum(h[(i + k) % bins] * (1 - abs(k) / half) for k in range(1 - half, half)) / max(beats, 1.0) for i in range(bins)]


@pytest.mark.parametrize("period, rate", [(0.05, 100), (0.1234, 100), (0.02, 10), (0.3, 1000)])
def test_phase_curves_by_definition(spark, period, rate):
    draw = np.random.default_rng(2)
    t, w = np.sort(draw.uniform(0, 5, 30)), draw.uniform(0, 1, 30)
    want = plain_curve(t, w, period, 5 / period, rate)
    assert np.allclose(grids.phase_curve(t, w, period, 5 / period, rate), want)
    rows = spark.createDataFrame([("a", float(x), float(y), period, 5 / period) for x, y in zip(t, w, strict=True)], "key string, t double, w double, period double, beats double")
    got = {r.bin: r.level for r in grids.phase_curves(rows, "key", rate).collect()}
    assert np.allclose([got.get(i, 0.0) for i in range(len(want))], want)


def track(bpm: float, first: float, seconds: float = 60.0, hat: float = 0.4, drop: int = 0, noise: float = 0.0):
    """Envelopes of kicks on the beats and hats between; every 16th beat from ``drop`` a new sound of the highs begins."""
    n, period = int(seconds * RATE), 60 / bpm
    low, mid, high = (np.random.default_rng(7 + i).uniform(0, noise, n) if noise else np.zeros(n) for i in range(3))
    for j in range(int((seconds - first) / period)):
        k = round((first + j * period) * RATE)
        for band, sizes in ((mid, (0.9, 0.5, 0.2)), (low, (0.6, 1.0, 0.8, 0.5, 0.3))):
            part = band[k : k + len(sizes)]
            part[:] = np.maximum(part, sizes[: len(part)])
        k = round((first + (j + 0.5) * period) * RATE)
        high[k : k + 4] = np.maximum(high[k : k + 4], hat)
        if drop and j % 16 == drop:
            a = round((first + j * period) * RATE)
            high[a : a + 400] = np.maximum(high[a : a + 400], 0.9)
    return low, mid, high


@pytest.mark.parametrize("bpm, given, first", [(128.0, 128.0, 0.2), (125.5, 125.3, 0.31), (100.0, 100.0, 0.0), (140.0, 140.4, 0.13)])
def test_planted_grids(bpm, given, first):
    g = grids.beat_grid(*track(bpm, first), given)
    assert g["reason"] is None and abs(g["bpm"] - bpm) < 0.03 and g["base_bpm"] == given and g["confidence"] >= 0.2
    # The attack's edge is one frame before its full height.
    away = (g["first_beat"] - first + g["period"] / 2) % g["period"] - g["period"] / 2
    assert abs(away) <= 0.02


def test_the_beat_is_no_hat():
    """Hats louder than the kick's attack: the line is still the kick's."""
    low, mid, high = track(120.0, 0.25, hat=1.0)
    mid = np.maximum(mid, high * 0.95)
    low = np.maximum(low, np.roll(high, 1) * 0.6)
    g = grids.beat_grid(low, mid, high, 120.0)
    assert g["reason"] is not None or abs((g["first_beat"] - 0.25 + 0.25) % 0.5 - 0.25) <= 0.02


def test_grids_that_are_refused():
    draw = np.random.default_rng(3)
    noise = tuple(draw.uniform(0, 1, 6000) for _ in range(3))
    flat = (np.zeros(6000),) * 3
    reason = lambda *a: grids.beat_grid(*a)["reason"]
    assert reason(*noise, 128.0) in ("offbeat-alike", "no-grid")
    assert [reason(*flat, b) for b in (None, 0.0, float("nan"), 128.0)] == ["no-tempo", "no-tempo", "no-tempo", "no-beats"]
    low, mid, high = track(128.0, 0.2)
    assert reason(low[:300], mid[:300], high[:300], 128.0) == "too-short"
    assert reason(*(np.zeros(RATE * (grids.LONGEST + 1)),) * 3, 128.0) == "too-long"
    assert reason(low, np.zeros_like(low), high, 128.0) == "no-attacks"
    quiet = np.zeros_like(low)
    quiet[3000:3010] = np.arange(10) / 10
    assert reason(quiet, np.where(np.arange(6000) % 50 == 0, 1.0, 0.0) * (np.arange(6000) < 2000), high, 128.0) == "no-kicks"
    both = track(128.0, 0.2)
    again = track(128.0, 0.2 + 60 / 256)
    assert reason(*(np.maximum(x, y) for x, y in zip(both, again, strict=True)), 128.0) == "offbeat-alike"
    # A period can be clean though the beat isn't known.
    assert grids.beat_grid(*(np.maximum(x, y) for x, y in zip(both, again, strict=True)), 128.0)["tuned_bpm"] is not None


@pytest.mark.parametrize("place", [1, 2, 3])
def test_planted_bars(place):
    document = grids.grid_document(*track(128.0, 0.2, 120.0, drop=place), 128.0)
    assert document["reason"] is None and abs(document["bar_start"] - (0.2 + place * 60 / 128)) < 0.03 and document["bar_confidence"] >= 0.5
    assert document["period"] == round(60 / 128, 6)


def test_no_bar_without_changes():
    document = grids.grid_document(*track(128.0, 0.2), 128.0)
    assert document["reason"] is None and document["bar_start"] is None and document["bar_reason"] == "no-changes"
    assert grids.bar_start(np.zeros((3, 100)), 0.0, 0.5) == (None, 0.0)


def test_grid_documents_in_spark(spark):
    a = track(128.0, 0.2)
    rows = [("a", *(x.tolist() for x in a), 128.0), ("none", None, None, None, 128.0), ("empty", [], [], [], 128.0), ("cut", a[0].tolist(), a[1].tolist()[:4000], a[2].tolist(), 128.0), ("bpm", *(x.tolist() for x in a), None)]
    df = spark.createDataFrame(rows, "k string, low array<double>, mid array<double>, high array<double>, bpm double")
    got = {r.k: r.g for r in df.select("k", grids.grid_documents()("low", "mid", "high", "bpm").alias("g")).collect()}
    want = grids.grid_document(*a, 128.0)
    assert got["a"].asDict() == want and got["cut"].reason is None
    assert [got[k].reason for k in ("none", "empty", "bpm")] == ["too-short", "too-short", "no-tempo"]


def test_bands_by_definition(spark):
    draw = np.random.default_rng(5)
    sounds = [draw.exponential(s, (3, 50)) * np.array([[1.0], [0.1], [0.0005]]) for s in (1.0, 0.05, 0.3)] + [np.zeros((3, 50)), np.where(draw.uniform(size=(3, 50)) < 0.04, 1.0, 0.0)]
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sounds)], "i int, bands array<array<double>>")
    got = {r.i: r for r in df.select("i", grids.normalised(df.bands).alias("b")).collect()}
    for i, s in enumerate(sounds):
        peaks = np.array([np.percentile(x[x > 0.01], 99) if (x > 0.01).any() else 0.0 for x in s])
        refs = np.maximum(peaks, max(peaks.max() * 0.01, 0.01))
        assert np.allclose(got[i].b.references, refs) and np.abs(np.array(got[i].b.levels) - np.round(np.minimum(s / refs[:, None], 1) * 255)).max() == 0


def test_ranges_by_definition(spark):
    levels = [[int(x) for x in np.random.default_rng(k).integers(0, 256, 70)] for k in range(3)]
    cases = [(0.0, 0.7, 10), (0.123, 0.456, 7), (0.5, 0.5, 3), (-1.0, 9.0, 64), (0.69, 0.7, 5), (0.7, 0.9, 5), (0.1, 0.2, 100)]
    for a, z, points in cases:
        df = spark.createDataFrame([(levels, a, z)], "q array<array<int>>, a double, z double")
        r = df.select(grids.ranged(df.q, df.a, df.z, points).alias("r")).first().r
        k0 = min(max(0, math.floor(a * RATE + 1e-9)), 69)
        k1 = min(max(k0 + 1, math.ceil(z * RATE - 1e-9)), 70)
        m = k1 - k0
        want = [x[k0:k1] if m <= points else [max(x[k0:k1][i * m // points : (i + 1) * m // points]) for i in range(points)] for x in levels]
        assert (r.begin, r.end, r.points) == (k0 / RATE, k1 / RATE, want)
    empty = spark.createDataFrame([([[], [], []],)], "q array<array<int>>")
    assert empty.select(grids.ranged(empty.q, F.lit(0.0), F.lit(1.0), 5)).first()[0] is None


def test_print_grids(spark):
    def plain(d):
        start = 30.0 if d > 100 else 0.0
        rest = d - start
        if rest <= 0:
            return []
        if rest < 60:
            return [(start, rest)]
        step = max(2.5, math.floor(rest / 24 / 0.5) * 0.5)
        return [(start + k * step, 2.5) for k in range(24)]

    lengths = [0.0, -3.0, 1.5, 59.9, 60.0, 95.0, 96.0, 100.0, 100.1, 119.0, 346.0, 351.0, 3600.0]
    df = spark.createDataFrame([(d,) for d in [*lengths, None, float("inf"), float("nan")]], "d double")
    got = [r.w for r in df.select(signal.print_windows(signal.print_grid(df.d)).alias("w")).collect()]
    assert [[tuple(w) for w in g or []] for g in got[: len(lengths)]] == [plain(d) for d in lengths] and got[len(lengths) :] == [None] * 3


def test_copies_on_other_grids(spark):
    """95 s against 96 s, a tail cut off: prints look elsewhere, and are still found to be one; another sound isn't."""
    rate, draw = 300, np.random.default_rng(8)

    def sound(seed, seconds):
        r = np.random.default_rng(seed)
        t = np.arange(int(seconds * rate)) / rate
        return sum(np.sin(2 * np.pi * f * t + r.uniform(0, 6)) * (1 + np.sin(2 * np.pi * t / r.uniform(3, 20))) for f in r.uniform(5, 140, 12))

    a, b, c = sound(1, 96.3), sound(2, 96.3), sound(3, 346.0)
    rows = [("a95", a[: int(95.4 * rate)]), ("a96", a + draw.normal(0, 0.01, len(a))), ("b", b), ("c", c), ("cut", c[: int(341.0 * rate)]), ("short", a[: int(45.0 * rate)]), ("shorter", a[: int(44.2 * rate)]), ("silent", np.zeros(96 * rate))]
    audio = spark.createDataFrame([(p, len(y) / rate, y.tolist()) for p, y in rows] + [("null", 96.0, None), ("lies", 96.0, a[: 50 * rate].tolist())], "path string, duration double, pcm array<double>")
    got = {(r.a, r.b): r.regridded for r in duplicates.regridded_pairs(audio, rate, low=4.0, high=145.0).collect()}
    assert got == {("a95", "a96"): True, ("c", "cut"): True, ("short", "shorter"): True}
    grid = audio.select("path", "duration", "pcm").withColumn("grid", signal.print_grid(F.col("duration")))
    prints = grid.select("path", "duration", signal.window_prints(rate, 4.0, 145.0)("pcm", "grid").alias("print"))
    assert duplicates.pairs(prints).count() == 0


def test_unit_prints_correlate(spark):
    draw = np.random.default_rng(9)
    rows = [(draw.normal(size=20).tolist(), draw.normal(size=20).tolist()) for _ in range(20)] + [([1.0] * 20, draw.normal(size=20).tolist()), ([1.0, 2.0], [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r.s for r in df.select(duplicates.product(duplicates.unit(df.a), duplicates.unit(df.b)).alias("s")).collect()]
    assert np.allclose(got[:20], [np.corrcoef(a, b)[0, 1] for a, b in rows[:20]]) and got[20:] == [0.0, 0.0]
