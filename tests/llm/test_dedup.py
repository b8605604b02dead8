from __future__ import annotations

import re
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cadenza.llm import line_dedup, ngram_join, shingles, substring_dedup

ORDER = -(2**63)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_lines(rows, run, least=50):
    """What stays of each (id, text), by the definition. Ids must be distinct, or their texts equal."""
    docs = {(i if i is not None else ORDER): (t or "").split("\n") for i, t in rows}

    def windows(x):
        return [(k, n) for n in range(1, run + 1) for k in range(len(x) - n + 1) if n == run or len(words(" ".join(x[k : k + n]))) >= least]

    first = {}
    for i in sorted(docs):
        for k, n in windows(docs[i]):
            first.setdefault(tuple(docs[i][k : k + n]), (i, k))
    out = {}
    for i, x in docs.items():
        gone = {k + j for k, n in windows(x) if first[tuple(x[k : k + n])] < (i, k) for j in range(n)}
        out[i] = (len(x), len(gone), "\n".join(v for k, v in enumerate(x) if k not in gone))
    return out


def test_lines_by_definition(messy, none):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    want = brute_lines(rows, line_dedup.RUN)
    got = line_dedup.dedup_lines(messy).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.n_removed, r.kept) == want[r.doc_id if r.doc_id is not None else ORDER]
    assert line_dedup.dedup_lines(none).count() == 0
    assert {r.n_removed for r in got if r.doc_id in (2, 3)} == {6}


def removed(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup.dedup_lines(df, **options).collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "d e", "f g h"]), max_size=12), min_size=1, max_size=12))
def test_lines_of_few_kinds(spark, texts):
    texts = ["\n".join(t) for t in texts]
    assert removed(spark, texts, words=4) == brute_lines(list(enumerate(texts)), line_dedup.RUN, 4)


def test_first_place_of_a_line_has_other_neighbours(spark, monkeypatch):
    texts = ["m\nx1\nx2", "p\nm\nq\nr", "s\np\nm\nq\nr\nt", "p\nm\nq", "x0\nm\nx1\nx2", "m\nm\nm\nm"]
    assert removed(spark, texts) == brute_lines(list(enumerate(texts)), line_dedup.RUN)
    # The result rests on the selected fingerprints: without them nothing is found.
    every = line_dedup.selected
    monkeypatch.setattr(line_dedup, "selected", lambda *a: every(*a).where("false"))
    assert all(n == 0 for _, n, _ in removed(spark, texts).values())


def test_fingerprints_are_selected_once(spark):
    text = "\n".join(f"line {i}" for i in range(4000))
    places = [r["at"] for r in line_dedup.selected(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("at").collect()]
    assert len(places) == len(set(places)) and 1500 < len(places) < 2500
    assert max(b - a for a, b in zip(sorted(places), sorted(places)[1:], strict=False)) <= line_dedup.RUN


def test_short_runs_of_many_words(spark):
    long, two, half = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 50), ("b", 49), ("c", 25)))
    texts = [long, long, two, two, f"{half}\n{half}x", f"q\n{half}\n{half}x\nr", f"{half}\nr", f"{long}\n\n{long}", "", ""]
    got = {i: x[1:] for i, x in removed(spark, texts).items()}
    assert got == {0: (0, long), 1: (1, ""), 2: (0, two), 3: (0, two), 4: (0, texts[4]), 5: (2, "q\nr"), 6: (0, texts[6]), 7: (2, ""), 8: (0, ""), 9: (0, "")}


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", 7)], "doc_id long, text string, gone long").selectExpr("*", "1 AS key", "2 AS row", "3 AS of", "4 AS l", "5 AS kept")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "gone", "key", "row", "of", "l", "n_lines", "n_removed", "kept"]
    assert tuple(got.first()) == (1, "a", 7, 1, 2, 3, 4, 1, 0, "a")


def brute_words(rows):
    docs = {(i if i is not None else ORDER): words(t) for i, t in rows}
    first = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - 12):
            first.setdefault(tuple(docs[i][k : k + 13]), i)
    out = {}
    for i, w in docs.items():
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substrings_by_definition(messy, none):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    want = brute_words(rows)
    got = substring_dedup.dedup_substrings(messy).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, bytes(r.kept).decode()) == want[r.doc_id if r.doc_id is not None else ORDER]
    assert substring_dedup.dedup_substrings(none).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b"]), max_size=60), min_size=2, max_size=10))
def test_substrings_of_few_words(spark, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_words(rows)


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links, up = Counter(), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in inverted[x] if j > i}:
            both = len(s & sets[j])
            if 9 * both >= 4 * (len(s) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                up[find(j)] = find(i)
    ids = [i if i is not None else ORDER for i, _ in rows]
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return sorted((ids[k], least[find(k)], links[k]) for k in range(len(rows)))


def near_copies(n):
    base = [f"w{k}" for k in range(200)]
    out = []
    for i in range(n):
        t = list(base)
        t[(i * 7) % 200] = f"x{i}"
        out.append((1000 + i, " ".join(t)))
    return out


def test_near_duplicates_by_definition(spark, messy, none, monkeypatch):
    rows = [(r.doc_id, r.text) for r in messy.collect()] + near_copies(60) + [(5000 + i, f"{' '.join(f'w{k}' for k in range(200))} tail {i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else ORDER, r.class_id if r.class_id is not None else ORDER, r.n_links) for r in got) == brute_classes(rows)
    assert ngram_join.join(none).count() == 0
    # Blocks of a few members give the same result.
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 8)
    small = ngram_join.join(df).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))


def test_one_of_each_class_stays(messy):
    kept = ngram_join.representatives(messy)
    assert kept.columns == messy.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({head if head != ORDER else None for _, head, _ in brute_classes([(r.doc_id, r.text) for r in messy.collect()])})


def test_pruning_keeps_what_may_reach_the_threshold():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.8 * ngram_join.HASHES
    known = shingles.WordHashes()
    a = shingles.shingle_set(shingles.word_hashes(" ".join(f"w{k}" for k in range(400)), known))
    b = shingles.shingle_set(shingles.word_hashes(" ".join(f"w{k}" for k in range(390)), known))
    c = shingles.shingle_set(shingles.word_hashes(" ".join(f"v{k}" for k in range(400)), known))
    m = [ngram_join.minhash(x)[None, :] for x in (a, b, c)]
    assert ngram_join.likely(m[0], m[1])[0] and not ngram_join.likely(m[0], m[2])[0]


def test_representatives_with_any_names(spark, messy):
    named = messy.selectExpr("doc_id", "text", "1 AS _head", "2 AS _head_part", "3 AS _nth", "4 AS head", "5 AS row", "6 AS id", "7 AS part", "8 AS nth", "9 AS worded")
    got = ngram_join.representatives(named)
    assert got.columns == named.columns and got.count() == ngram_join.representatives(messy.select("doc_id", "text")).count()
    assert {tuple(r)[2:] for r in got.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8, 9)}
