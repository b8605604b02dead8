"""Hops over the tempo gate by intervals, and bridges over classes, against searches over all items."""

from __future__ import annotations

import itertools
import math
from collections import Counter, deque

import numpy as np
import pytest

from cadenza.functions import tempo
from cadenza.operators import reach, routes, setbuilder

SHAPE = "path string, bpm double, key string, duration double"


def mixes(a: float, b: float) -> bool:
    return a > 0 and b > 0 and min(abs(a - b * f) / max(a, b * f) for f in (1.0, 2.0, 0.5)) < tempo.GATE


def plain_hops(start: tuple, rows: list[tuple]) -> dict[str, int]:
    """Breadth first over all tracks."""
    tracks = [r for r in rows if r[3] >= 90 and r[1] > 0]
    found, queue = {start[0]: 0}, deque([start])
    while queue:
        at = queue.popleft()
        for r in tracks:
            if r[0] not in found and mixes(at[1], r[1]):
                found[r[0]] = found[at[0]] + 1
                queue.append(r)
    return {p: n for p, n in found.items() if n}


def tempi(kind: str) -> list[float]:
    draw = np.random.default_rng(7)
    return {
        "dense": [*draw.uniform(60, 200, 60)],
        "sparse": [40.0 * 1.07**i for i in range(40)],
        "islands": [*draw.uniform(60, 66, 8), *draw.uniform(118, 132, 8), *draw.uniform(88, 100, 8), *draw.uniform(178, 199, 8), 30.0, 700.0],
        "octaves": [60.0, 120.0, 240.0, 480.0, 960.0, 65.0, 125.0, 64.8, 129.6, 130.0, 141.5],
        "edges": [100.0, 92.0, np.nextafter(92.0, 93), np.nextafter(92.0, 91), 100 / 0.92, np.nextafter(100 / 0.92, 0), np.nextafter(100 / 0.92, 200), 184.0, 46.0, 50.0, 200.0],
    }[kind]


def test_hops_are_counted_without_a_row_for_each_start_and_track(spark, monkeypatch):
    """Starts that lead their tempo, that are alone at it, and that are in the library twice."""
    rows = [(f"p{i:02}", b, "8A", 300.0) for i, b in enumerate([100.0, 100.0, 100.0, 104.0, 104.0, 111.0, 50.5, 118.0, 126.0, 400.0])] + [("p05", 111.0, "8A", 300.0), ("p07", 100.0, "8A", 300.0), ("short", 100.0, "8A", 20.0)]
    lib = spark.createDataFrame(rows, SHAPE)
    starts = lib.select("path")
    want: dict[tuple, list] = {}
    for r in reach.hops_to_all(starts, lib).collect():
        want.setdefault((r.start, r.hops), []).append(r.path)
    monkeypatch.delattr(reach, "hops_to_all")
    got = {(r.start, r.hops): (r.tracks, r.first) for r in reach.hops_counted(starts, lib).collect()}
    assert got == {k: (len(v), min(v)) for k, v in want.items()} and len(got) > 20


@pytest.mark.parametrize("kind", ["dense", "sparse", "islands", "octaves", "edges"])
def test_hops_against_breadth_first(spark, kind):
    rows = [(f"p{i:03d}", float(b), "8A", 300.0) for i, b in enumerate(tempi(kind))] + [("zero", 0.0, "8A", 300.0), ("short", float(tempi(kind)[0]), "8A", 20.0), ("nan", float("nan"), None, 300.0)]
    lib = spark.createDataFrame(rows, SHAPE)
    starts = [r for r in rows[:: max(1, len(rows) // 7)] if r[1] > 0 and r[3] >= 90]
    got = reach.hops_to_all(spark.createDataFrame([(r[0],) for r in starts], "path string"), lib).collect()
    for s in starts:
        assert {r.path: r.hops for r in got if r.start == s[0]} == plain_hops(s, rows), s
    pairs = [(a[0], b[0]) for a in starts for b in rows if b[1] > 0 and b[3] >= 90 and a[0] != b[0]]
    found = {(r.start, r.goal): r for r in reach.diagnosed(spark.createDataFrame(pairs, "start string, goal string"), lib).collect()}
    assert set(found) == set(pairs)
    every = {r[0]: plain_hops(r, rows) for r in rows if r[1] > 0 and r[3] >= 90}
    for (a, b), r in found.items():
        assert r.hops == every[a].get(b)
        assert (r.from_start, r.to_goal) == ((None, None) if r.hops else (len(every[a]), len(every[b])))


def test_gate_ends_to_the_last_bit():
    bpm = np.random.default_rng(1).uniform(20, 400, 5_000)
    for f, _ in tempo.READINGS:
        low, high = reach.gate_ends(bpm, f)
        inside = lambda c, f=f: np.abs(bpm - c * f) / np.maximum(bpm, c * f) < tempo.GATE
        assert inside(low).all() and inside(high).all() and not inside(np.nextafter(low, 0)).any() and not inside(np.nextafter(high, np.inf)).any()


def test_no_hops_without_tracks(spark):
    lib = spark.createDataFrame([("a", 0.0, "8A", 300.0), ("b", 120.0, "8A", 10.0)], SHAPE)
    assert reach.hops_to_all(lib.select("path"), lib).collect() == []
    assert reach.diagnosed(spark.createDataFrame([("a", "b")], "start string, goal string"), lib).collect() == []


def cost_of(a: tuple, b: tuple) -> float:
    m = float(setbuilder.tempo_scores(a[1], np.array([b[1]]))[0]) * setbuilder.key_compat(a[2], b[2]) ** 0.6
    return -math.log(m) if m > 0 else math.inf


def plain_best(a: tuple, b: tuple, rows: list[tuple], low: int, high: int) -> float:
    rest = [r for r in rows if r[3] >= 90 and r[1] > 0 and r[0] not in (a[0], b[0])]
    return min((sum(cost_of(x, y) for x, y in itertools.pairwise((a, *mid, b))) for n in range(low, high + 1) for mid in itertools.permutations(rest, n)), default=math.inf)


def library_of(kind: str) -> list[tuple]:
    draw = np.random.default_rng(11)
    names = ["8A", "9A", "8B", "3B", "?", None, "12A"]
    if kind == "mixed":  # tempi of their own
        return [(f"p{i:02d}", float(draw.integers(230, 290)) / 2, names[i % 7], 300.0) for i in range(11)]
    if kind == "clones":  # few classes, so the cheapest walk repeats
        return [(f"p{i:02d}", [124.0, 125.0, 128.0][i % 3], names[i % 2], 300.0) for i in range(11)]
    if kind == "tight":  # one cheap hub, which can be used once
        return [(f"p{i:02d}", 120.0 + 8 * (i % 2) + i / 50, names[i % 4], 300.0) for i in range(10)] + [("hub", 124.0, "8A", 300.0)]
    return [(f"p{i:02d}", b, names[i % 3], 300.0) for i, b in enumerate([120.0, 121.0, 60.5, 90.0, 91.0, 181.0, 60.0, 130.0, 139.0, 149.0])]


@pytest.mark.parametrize("kind", ["mixed", "clones", "tight", "islands"])
@pytest.mark.parametrize("low, high", [(0, 1), (2, 2), (3, 4)])
def test_routes_against_permutations(spark, kind, low, high):
    rows = library_of(kind)
    at = {r[0]: r for r in rows}
    lib = spark.createDataFrame([*rows, ("short", 121.0, "8A", 20.0)], SHAPE)
    pairs = [(a[0], b[0]) for a in rows[:3] for b in rows[-3:] if a[0] != b[0]]
    got = {(r.start, r.goal): r for r in routes.routes(spark.createDataFrame(pairs, "start string, goal string"), lib, low, high).collect()}
    assert set(got) == set(pairs)
    for a, b in pairs:
        r, best = got[a, b], plain_best(at[a], at[b], rows, low, high)
        if best == math.inf:
            assert r.found is None and r.stop == ("length" if b in plain_hops(at[a], rows) else "disconnected"), r
        else:
            assert r.stop == "found" and math.isclose(r.cost, best, abs_tol=1e-9), (r, best)
            assert r.found[0] == a and r.found[-1] == b and len(set(r.found)) == len(r.found) and low <= len(r.found) - 2 <= high
            assert math.isclose(sum(cost_of(at[x], at[y]) for x, y in itertools.pairwise(r.found)), r.cost, abs_tol=1e-9)


def test_routes_when_the_first_pass_is_narrow(spark, monkeypatch):
    """A first pass that finds a dear bridge, or none, changes nothing."""
    monkeypatch.setattr(routes, "BEAM", 1)
    rows = library_of("mixed")
    at = {r[0]: r for r in rows}
    pairs = [(a[0], b[0]) for a in rows[:4] for b in rows[-4:]]
    for r in routes.routes(spark.createDataFrame(pairs, "start string, goal string"), spark.createDataFrame(rows, SHAPE), 2, 3).collect():
        best = plain_best(at[r.start], at[r.goal], rows, 2, 3)
        assert (best == math.inf and r.cost is None) or math.isclose(r.cost, best, abs_tol=1e-9)


def test_ends_that_cannot_be_bridged(spark):
    rows = [("a", 120.0, "8A", 300.0), ("b", 121.0, "8A", 300.0), ("c", 0.0, "8A", 300.0), ("d", 120.0, "8A", 20.0), ("e", 122.0, "8A", 300.0)]
    lib, ask = spark.createDataFrame(rows, SHAPE), [("a", "a"), ("a", "c"), ("a", "d"), ("a", "b"), ("a", "unknown")]
    got = {r.goal: r for r in routes.routes(spark.createDataFrame(ask, "start string, goal string"), lib, 3, 4).collect()}
    assert {g: r.stop for g, r in got.items()} == {"a": "same", "c": "no-tempo", "d": "fragment", "b": "length"}
    assert got["b"].hops == 1 and got["b"].direct < 0.2
    with pytest.raises(ValueError):
        routes.routes(lib, lib, 4, 3)


def test_the_bound_never_exceeds_a_rest(spark):
    """For random walks, what is left costs at least the bound."""
    draw = np.random.default_rng(2)
    rows = [(f"{i}", float(draw.uniform(60, 200)), ["8A", "9A", "8B", "3B", "?"][i % 5], 300.0) for i in range(40)]
    code = {"8A": 14, "9A": 16, "8B": 15, "3B": 5, "?": 24}
    cases = []
    for _ in range(400):
        walk = [rows[draw.integers(0, 40)]]
        while len(walk) < 5:
            near = [r for r in rows if mixes(walk[-1][1], r[1])]
            walk.append(near[draw.integers(0, len(near))])
        for n in (1, 2, 3, 4):
            part = walk[-n - 1 :]
            cases.append((math.log2(part[0][1]), code[part[0][2]], math.log2(part[-1][1]), code[part[-1][2]], n, sum(cost_of(x, y) for x, y in itertools.pairwise(part))))
    df = spark.createDataFrame(cases, "x double, k int, gx double, gk int, n int, cost double")
    for n in (1, 2, 3, 4):
        bound = routes.rest_bound(df.x, df.k, df.gx, df.gk, n)
        assert df.where(df.n == n).where(bound > df.cost + 1e-9).count() == 0


def test_needed_by_enumeration():
    """A path stays exactly if some rest fits it and none of the cheaper ones."""
    draw = np.random.default_rng(5)
    for _ in range(300):
        room = {c: int(draw.integers(1, 3)) for c in "abcd"}
        pick = lambda: Counter(c for c in draw.choice(list("abcd"), 3).tolist())
        paths = [p for p in (pick() for _ in range(6)) if all(p[c] <= room[c] for c in p)]
        if not paths:
            continue
        rest = int(draw.integers(0, 3))
        fits = lambda p, more, room=room: all(p[c] + more[c] <= room[c] for c in room)
        wanted = any(fits(paths[-1], m) and not any(fits(k, m) for k in paths[:-1]) for n in range(rest + 1) for m in map(Counter, itertools.combinations_with_replacement("abcd", n)))
        assert routes.needed(paths[-1], paths[:-1], room, rest) == (wanted or len(paths) == 1), (paths, room, rest)
