from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import tempo
from cadenza.functions.scoring import SetConfig
from cadenza.operators import bridge, crates, cues, duplicates, evaluation, export, library, names, neighbours, resolve, search, setbuilder, stats
from cadenza.operators.components import connected

ITEMS = "path string, bpm double, key string, energy_raw double, artist string, duration double, embedding array<double>"


@pytest.fixture(scope="module")
def lib(spark):
    draw = np.random.default_rng(3)
    keys = ["8A", "9A", "8B", "3B", "?", "10A", ""]
    rows = [(f"/m/{i:03d}", 0.0 if i % 25 == 24 else float(120 + draw.integers(0, 24) / 2), keys[i % 7], float(draw.integers(0, 5) / 4), [None, " Ana ", "ana", "Bo", "Cy", "Di"][i % 6], 30.0 if i % 20 == 19 else 300.0, draw.normal(size=6).round(3).tolist()) for i in range(60)]
    return library.contextual(spark.createDataFrame(rows, ITEMS)).cache()


def test_context_is_of_the_whole_library(lib):
    rows = lib.collect()
    raw = [r.energy_raw for r in rows]
    assert all(math.isclose(r.energy, sum(x < r.energy_raw for x in raw) / len(raw)) for r in rows)
    x = np.array([r.embedding for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose([r.timbre for r in rows], z / np.linalg.norm(z, axis=1, keepdims=True))
    some = library.restricted(lib, lib.where("path < '/m/005'").select("path"))
    assert {r.path: r.energy for r in some.collect()} == {r.path: r.energy for r in rows if r.path < "/m/005"}


def test_nearest(lib):
    rows = {r.path: np.array(r.timbre) for r in lib.collect()}
    got = neighbours.nearest(lib, lib, 3).collect()
    for seed, v in rows.items():
        want = sorted((-(float(v @ w)), p) for p, w in rows.items() if p != seed)[:3]
        assert [r.path for r in sorted((r for r in got if r.seed == seed), key=lambda r: r["rank"])] == [p for _, p in want]


def test_band_join_equals_all_pairs(spark):
    draw = np.random.default_rng(4)
    rows = [(f"{i}", float(b), "8A") for i, b in enumerate([*draw.uniform(50, 250, 150), 0.0, float("nan"), 60.0, 120.0, 240.0])]
    df = spark.createDataFrame(rows, "path string, bpm double, key string")
    got = {(r.from_path, r.to_path) for r in neighbours.mixable_pairs(df, df).collect()}
    want = {(p, q) for p, a, _ in rows for q, b, _ in rows if p != q and setbuilder.tempo_scores(a, np.array([b]))[0] > 0}
    assert got == want


def plain_set(rows, seed, c):
    """One greedy set, by the definition."""
    mix = lambda a, b: float(setbuilder.tempo_scores(a["bpm"], np.array([b["bpm"]]))[0]) * setbuilder.key_compat(a["key"], b["key"]) ** 0.6
    who = lambda r: (r["artist"] or "").strip().lower()
    picks = [seed]
    free = [r for r in rows if r["path"] != seed["path"] and r["duration"] >= 90]
    while len(picks) < c.length:
        last = picks[-1]
        recent = {who(r) for r in picks[-c.artist_gap :]} - {""} if c.artist_gap else set()
        able = [r for r in free if mix(last, r) > 0 and who(r) not in recent]
        if not able:
            if not free:
                return picks, "exhausted"
            return picks, "artist-gap" if any(mix(last, r) > 0 for r in free) else "no-mixable"

        def score(r):
            dot = lambda a, b: float(np.dot(a["timbre"], b["timbre"]))
            most = max([0.0, *(dot(r, p) for p in picks[1:])])
            timbre = min(max(math.tanh(c.w_seed * dot(seed, r) + c.w_prev * dot(last, r) - c.redundancy * most), 0), 1)
            return ((1 - c.w_energy) * timbre + c.w_energy * (1 - abs(r["energy"] - setbuilder.goal(len(picks), c.length, c.curve)))) * mix(last, r)

        best = min(able, key=lambda r: (-round(score(r), 12), r["path"]))
        picks.append(best)
        free.remove(best)
    return picks, "complete"


@pytest.mark.parametrize("config", [SetConfig(length=12), SetConfig(length=8, curve="warmup", artist_gap=0, redundancy=0.0), SetConfig(length=60)])
def test_sets_by_definition(lib, config):
    rows = sorted((r.asDict() for r in lib.collect()), key=lambda r: r["path"])
    seeds = lib.where("path < '/m/012'").select("path")
    got = setbuilder.build(seeds, lib, config).collect()
    for s in rows[:12]:
        mine = sorted((r for r in got if r.seed == s["path"]), key=lambda r: r.position)
        want, stop = plain_set(rows, s, config)
        assert [r.path for r in mine] == [w["path"] for w in want] and mine[-1].stop == stop


def test_sets_by_joins_are_the_same(lib):
    seeds, c = lib.where("path < '/m/004'").select("path"), SetConfig(length=4)
    a = {(r.seed, r.position): r.path for r in setbuilder.build(seeds, lib, c).collect()}
    b = {(r.seed, r.position): r.path for r in setbuilder.build_by_joins(seeds, lib, c).collect()}
    assert a == b


@pytest.mark.parametrize(("where", "config"), [("path < '/m/006'", SetConfig(length=7)), ("path < '/m/020'", SetConfig(length=7, randomness=0.8, seed=4)), ("path IN ('/m/001', '/m/019')", SetConfig(length=3)), ("path IN ('/m/001', '/m/002', '/m/007')", SetConfig(length=4))])
def test_sets_by_joins_end_the_same(lib, where, config):
    some = lib.where(where).withColumn("bpm", F.when(F.col("path") == "/m/004", 90.0).otherwise(F.greatest("bpm", F.lit(124.0))))
    a, b = ({(r.seed, r.position): (r.path, r.stop, None if r.score is None else round(r.score, 9)) for r in f(some.select("path"), some, config).collect()} for f in (setbuilder.build, setbuilder.build_by_joins))
    assert a == b and any(stop not in (None, "complete") for _, stop, _ in a.values())


def test_random_sets_repeat_by_seed(lib):
    seeds = lib.where("path < '/m/003'").select("path")
    one, two, other = (setbuilder.build(seeds, lib, SetConfig(length=10, randomness=1.0, seed=s)).collect() for s in (1, 1, 2))
    assert sorted(map(str, one)) == sorted(map(str, two)) != sorted(map(str, other))


def test_no_transition_leaves_the_gate(lib):
    steps = setbuilder.build(lib.select("path"), lib, SetConfig(length=10))
    m = setbuilder.transition_metrics(setbuilder.transitions(steps)).first()
    assert m.n > 0 and m.out == 0
    curves = setbuilder.curve_metrics(steps, 10).collect()
    assert len(curves) == 60 and all(0 <= r.deviation <= 1 for r in curves)


def test_bridges_by_definition(spark, lib):
    small = lib.where("path < '/m/014'")
    rows = [r for r in small.collect()]
    good = [r for r in rows if r.duration >= 90]
    cost = lambda a, b: -math.log(m) if (m := float(setbuilder.tempo_scores(a.bpm, np.array([b.bpm]))[0]) * setbuilder.key_compat(a.key, b.key) ** 0.6) > 0 else math.inf
    pairs = [(a, b) for a in rows[:3] for b in rows[5:8]]
    got = {(r.start, r.goal): r for r in bridge.bridges(spark.createDataFrame([(a.path, b.path) for a, b in pairs], "start string, goal string"), small, 1, 2).collect()}
    for a, b in pairs:
        rest = [r for r in good if r.path not in (a.path, b.path)]
        best = min((sum(cost(x, y) for x, y in itertools.pairwise((a, *mid, b))) for n in (1, 2) for mid in itertools.permutations(rest, n)), default=math.inf)
        r = got[a.path, b.path]
        assert (r.stop == "no-bridge" and best == math.inf) or math.isclose(r.cost, best, abs_tol=1e-9)
    odd = spark.createDataFrame([("/m/001", "/m/001"), ("/m/001", "/m/019"), ("/m/001", "/m/024")], "start string, goal string")
    assert {r.stop for r in bridge.bridges(odd, lib, 0, 1).collect()} == {"same", "fragment", "no-tempo"}


def test_bridges_whose_cheap_hub_comes_last(spark):
    tracks = [("S", 99.5, "12B"), ("G", 108.5, "3A"), ("h", 100.0, None), *((f"t{k}", 99.5, k) for k in ("1A", "4A", "7A", "10A", "2B", "5B", "8B", "11B"))]
    df = spark.createDataFrame([(*t, 300.0) for t in tracks], "path string, bpm double, key string, duration double")
    at = {t[0]: t for t in tracks}
    cost = lambda a, b: -math.log(m) if (m := float(setbuilder.tempo_scores(at[a][1], np.array([at[b][1]]))[0]) * setbuilder.key_compat(at[a][2], at[b][2]) ** 0.6) > 0 else math.inf
    best = min(sum(cost(x, y) for x, y in itertools.pairwise(("S", *mid, "G"))) for mid in itertools.permutations([t for t in at if t not in "SG"], 4))
    r = bridge.bridges(spark.createDataFrame([("S", "G")], "start string, goal string"), df, 4, 4).first()
    assert r.stop == "found" and r.found[-2] == "h" and len(set(r.found)) == 6 and math.isclose(r.cost, best, abs_tol=1e-9)


def test_frontier_serves_every_rest():
    draw = np.random.default_rng(5)
    for p, rest in ((2, 1), (2, 2), (3, 2)):
        family = [frozenset(draw.choice(7, p, replace=False).tolist()) for _ in range(40)]
        kept = []
        for one in family:
            if bridge.of_use(one, kept, rest):
                kept.append(one)
        assert len(kept) <= math.comb(p + rest, p)
        for r in itertools.combinations(range(7), rest):
            first = lambda sets: next((s for s in sets if not s & set(r)), None)
            assert first(family) == first(kept)


def test_components(spark):
    draw = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_duplicates(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(6, 40))
    rows = [(f"{i}-{j}", 200.0 + i * 20 + j * 0.5, (base[i] + draw.normal(size=40) * 0.01).tolist()) for i in range(6) for j in range(1 + i % 3)]
    pairs = duplicates.pairs(spark.createDataFrame(rows, "path string, duration double, print array<double>"))
    groups = duplicates.groups(pairs).collect()
    assert {(r.path, r.group, r.all_agree) for r in groups} == {(p, f"{p[0]}-0", True) for p, *_ in rows if int(p[0]) % 3}
    q = spark.createDataFrame([(p, 20.0 if p.endswith("1") else 16.0, False, False, False) for p, *_ in rows], "path string, cutoff_khz double, wall boolean, lossless boolean, referenced boolean")
    kept = duplicates.survivors(duplicates.groups(pairs).join(q, "path")).where("keep").collect()
    assert {r.path for r in kept} == {"1-1", "2-1", "4-1", "5-1"}


def test_eligibility_goes_by_order(spark):
    row = lambda i, p, **x: {"crate_id": 1, "item_id": i, "position": p, "title": f"t{i}", "artist": "a", "genre": "House", "file_ok": True, "state": "analysed", "engine_id": i, "is_track": True, "file_key": f"f{i}"} | x
    rows = [
        row(1, 1), row(2, 2, file_key="f1", title="other"), row(3, 3, title="other"), row(4, 4, title="T1 "), row(5, 5, genre="Techno"), row(6, 6, genre=None), row(7, 7, file_ok=False),
        row(8, 8, state="failed"), row(9, 9, is_track=False), row(10, 10, state="queued"), row(11, 11, engine_id=None),
    ]
    schema = "crate_id long, item_id long, position int, title string, artist string, genre string, file_ok boolean, state string, engine_id long, is_track boolean, file_key string"
    e = crates.eligible(spark.createDataFrame(rows, schema))
    got = {r.item_id: (r.reason, r.duplicate_of) for r in e.where("genre_key = 'house'").collect()}
    # 2 is a duplicate by file, so it doesn't register its title, and 3 enters.
    assert got == {1: (None, None), 2: ("duplicate", 1), 3: (None, None), 4: ("duplicate", 1), 5: ("other-genre", None), 6: ("no-genre", None), 7: ("no-file", None), 8: ("failed", None), 9: ("not-a-track", None), 10: ("analysing", None), 11: ("not-analysed", None)}
    for s in crates.eligibility_summary(e).collect():
        assert s.total == s.enter + sum(s[r.replace("-", "_")] for r in crates.REASONS)
    assert crates.can_build(crates.eligibility_summary(e)).first().ok


def test_refresh_of_an_import(spark):
    schema = "item_id long, ref string, position int, bpm double, key string, duration double, genre string, genre_edited boolean, file string, file_ok boolean"
    old = spark.createDataFrame([(1, "a", 1, 120.0, "8A", 200.0, "X", True, "/a", True), (2, "b", 2, 121.0, "9A", 210.0, "Y", False, "/b", False), (3, "gone", 3, 1.0, "1A", 1.0, "Z", False, None, False)], schema)
    new = spark.createDataFrame([("a", 1, None, None, None, "N", None), ("b", 2, 99.0, "1B", 300.0, "N", "/b2"), ("c", 3, 98.0, "2B", 100.0, "N", "/c"), ("c", 4, 97.0, "2B", 100.0, "N", "/c")], "ref string, position int, bpm double, key string, duration double, genre string, file string")
    got = {r.ref: r for r in crates.refresh(old, new, ["ref"]).collect()}
    assert (got["a"].bpm, got["a"].duration, got["a"].genre, got["a"].file) == (None, 200.0, "X", "/a")
    assert (got["b"].bpm, got["b"].genre, got["b"].file) == (99.0, "N", "/b2")
    assert got["gone"].bpm == 1.0 and got["c"].position == 4 and got["c"].bpm == 98.0 and len(got) == 4


def test_cue_merge(spark):
    schema = "path string, kind string, num int, start_ms long, end_ms long"
    known = spark.createDataFrame([("p", "cue", 0, 1000, None), ("p", "loop", None, 5000, 6000)] + [("p", "memory", None, i, None) for i in range(31)], schema)
    new = [("p", 1, "cue", 0, 1000, None), ("p", 2, "cue", 0, 2000, None), ("p", 3, "cue", 1, 3000, None), ("p", 4, "cue", 1, 3500, None), ("p", 5, "memory", None, 7000, None), ("p", 6, "memory", None, 8000, None), ("p", 7, "cue", 2, 999_999, None), ("p", 8, "loop", None, 5000, 6000)]
    df = spark.createDataFrame(new, "path string, seq int, kind string, num int, start_ms long, end_ms long")
    d = spark.createDataFrame([("p", 300.0)], "path string, duration double")
    got = {r.seq: r.outcome for r in cues.merged(known, df, d).collect()}
    assert got == {1: "present", 2: "kept", 3: "added", 4: "kept", 5: "added", 6: "full", 7: "outside", 8: "present"}
    assert {r.outcome for r in cues.merged(known, df, d, overwrite=True).where("seq = 2").collect()} == {"replaces"}


def test_name_orientation(spark):
    files = ["Ana - One", "Ana - Two", "Three - Ana", "Four - Zed (Original Mix)", "Five - Zed (Original Mix)", "Six - Nobody (Original Mix)", "ONYX002 - Bo - Tune", "no divider", "A b - C - D", "BO - Other"]
    got = {r.path: r for r in names.oriented(spark.createDataFrame([(f"/x/{f}.mp3",) for f in files], "path string")).collect()}
    at = lambda f: got[f"/x/{f}.mp3"]
    assert (at("Ana - One").artist, at("Ana - One").title, at("Ana - One").orientation) == ("Ana", "One", "direct")
    assert (at("Four - Zed (Original Mix)").artist, at("Four - Zed (Original Mix)").title) == ("Zed", "Four (original mix)")
    assert at("Six - Nobody (Original Mix)").orientation == "inverted"
    assert (at("ONYX002 - Bo - Tune").artist, at("ONYX002 - Bo - Tune").title) == ("Bo", "Tune") and at("BO - Other").artist == "Bo"
    assert at("no divider").orientation == "undivided" and at("A b - C - D").review


def test_search(spark):
    rows = [(1, i, i, s, t, a) for i, (s, t, a) in enumerate([("v", "Fire Edyom", "Fidelys"), ("s", "Fire Edyom (live)", "Fidelys"), ("v", "Fire Edyom", "Fidelys"), ("s", "Other song", "Nobody"), ("t", "Fire Edyom Fidelys remixed", "Fidelys")])]
    df = search.scored(spark.createDataFrame(rows, "query_id long, rank int, item_id long, source string, title string, artist string"), F.lit("fire edyom fidelys"))
    assert {r.item_id for r in search.relevant(df).collect()} == {0, 1, 2, 4}
    groups = {r.item_id: r.cluster for r in search.grouped(df).collect()}
    assert groups == {0: 0, 1: 0, 3: 1, 4: 0}
    assert [r.item_id for r in search.interleaved(df, ["s", "v"], 4).orderBy("place").collect()] == [1, 0, 3, 2]
    assert [r.item_id for r in search.diverse(df, 3).orderBy("place").collect()] == [0, 1, 4]


def test_paths_are_resolved_or_left_ambiguous(spark):
    files = spark.createDataFrame([("/r/Techno/a.wav",), ("/r/House/a.wav",), ("/r/b.wav",), ("/q/x/c.wav",), ("/p/x/c.wav",)], "path string")
    wanted = spark.createDataFrame([("C:\\Music\\techno\\A.wav",), ("/r/b.wav",), ("/z/B.WAV",), ("/z/a.wav",), ("/z/x/c.wav",), ("/none.wav",), (None,)], "location string")
    got = {r.location: (r.state, r.path, r.step) for r in resolve.resolved(wanted, files).collect()}
    assert got == {"C:\\Music\\techno\\A.wav": ("ok", "/r/Techno/a.wav", "tail"), "/r/b.wav": ("ok", "/r/b.wav", "exact"), "/z/B.WAV": ("ok", "/r/b.wav", "name"), "/z/a.wav": ("ambiguous", None, "name"), "/z/x/c.wav": ("ambiguous", None, "tail"), "/none.wav": ("not-found", None, None)}


def test_evaluation_of_nothing(spark):
    rows = spark.createDataFrame([], "bpm_error_tolerant double, key_exact boolean, key_compatible boolean, unanimous boolean, confidence double")
    m = evaluation.contract_metrics(rows).first()
    assert m.bpm_error_p95 == 0.0 and m.key_exact is None
    v = evaluation.verdicts(spark.createDataFrame([("bpm_error_p95", 0.5), ("key_exact", float("nan"))], "metric string, value double"))
    assert {r.metric: r.ok for r in v.collect()}["key_exact"] is None and evaluation.overall(v).first().verdict == 2
    assert evaluation.confidence_correlation(rows).first().pearson is None


def test_export(spark):
    df = spark.createDataFrame([(1, 0, "/a b.mp3", "A & B", "T\n2", 120.04, "8A", 0.5, 61.9), (1, 1, "/c.mp3", None, None, None, None, None, None)], "set_id long, position int, path string, artist string, title string, bpm double, key string, energy double, duration double")
    t = export.playlists(df).first().text
    assert t == "#EXTM3U\r\n#EXTINF:61,A & B — T 2\r\n#MIX:bpm=120.0 key=8A energy=0.50\r\n/a b.mp3\r\n#EXTINF:-1,c\r\n#MIX:bpm=0.0 key=? energy=0.00\r\n/c.mp3\r\n"
    x = {r.path: r.xml for r in export.xml_tracks(df).collect()}
    assert 'Artist="A &amp; B"' in x["/a b.mp3"] and 'Tonality="Am"' in x["/a b.mp3"] and "AverageBpm" not in x["/c.mp3"]
    a, b = (export.fingerprints(df.withColumn("bpm", F.lit(v)), ["set_id", "position"]).collect() for v in (1.0, 2.0))
    assert all(p.fingerprint != q.fingerprint and len(p.fingerprint) == 32 for p, q in zip(a, b, strict=True))


def test_statistics(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 3.0), (1, 2.0, 9.0), (2, 1.0, 1.0), (3, 1.0, 5.0), (3, 1.0, 6.0)], "g int, a double, b double")
    got = {r.g: r.spearman for r in stats.spearman(df, ["g"], "a", "b").collect()}
    assert math.isclose(got[1], 0.8660254, rel_tol=1e-6) and got[2] is None and got[3] is None
    h = {r.bin: r.n for r in stats.histogram(df, "b", 1.0, 9.0, 4).collect()}
    assert h == {0: 2, 1: 1, 2: 2, 3: 1}


def test_gate_constant():
    assert tempo.GATE == 0.08


def test_sums_before_a_row_match_a_plain_version(spark):
    rows = [(None if i % 5 == 0 else i % 3, (i * 37) % 50 if i % 11 else None, i, i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v int, i int, n int").repartition(6)
    got = {r.i: r.b for r in stats.before(df, ["g"], ["v", "i"], F.col("n"), "b").collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    assert got == {r[2]: sum(x[3] for x in rows if x[0] == r[0] and key(x) < key(r)) for r in rows}
    assert stats.before(df.limit(0), ["g"], ["v", "i"], F.col("n"), "b").count() == 0


def test_the_middle_mark_of_each_pad_is_the_upper_median(spark):
    rows = [(m, f"p{m % 7}", None if m % 4 == 3 else m % 4, (m * 13) % 9 * 1000) for m in range(90)]
    marks = spark.createDataFrame(rows, "mark_id int, path string, num int, start_ms int")
    lengths = spark.createDataFrame([(f"p{i}", 10.0) for i in range(7)], "path string, duration double")
    got = {r.num: (r.n, r.low, r.middle, r.high, r.opening, r.closing) for r in cues.statistics(marks, lengths).collect()}
    for pad in (0, 1, 2, None):
        at = sorted(r[3] / 1000 / 10.0 for r in rows if r[2] == pad)
        assert got[pad] == (len(at), at[0], at[len(at) // 2], at[-1], sum(x < 0.15 for x in at), sum(x > 0.85 for x in at))
