from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.llm import bpe, chat, mixing, quality_model, quality_rules, queries, topk, toxicity
from cadenza.llm.common import crc_mod, one_text

RANKS = "byte_bpe_50k.tiktoken"


def expected_ids(text):
    return np.array(bpe.encoder(bpe.ranks_file(RANKS)).encode_ordinary(text or ""), "<u4")


def test_bpe_equals_the_library(spark, messy, none):
    random.seed(3)
    long = ["word it's " * 9000, " " * 80_000 + "x", "a" * 100_000, ("ab cd'll  \n\n " * 3000) + "z" * 5000 + (" foo 123,,'re é日本" * 9000), "".join(random.choice("ab '\n\t1!éll") for _ in range(150_000))]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(long)] + [(100, long[0])], "doc_id long, text string")
    df = messy.select("doc_id", "text", "n_removed").unionByName(extra, allowMissingColumns=True)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df).collect())
    want = Counter()
    for r in df.collect():
        ids = expected_ids(r.text)
        want[(r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert got == want
    ids = Counter((r.doc_id, len(r.ids) // 4, hashlib.sha256(r.ids).hexdigest()) for r in bpe.encode(df).collect())
    assert ids == Counter({k: sum(n for x, n in want.items() if x[:3] == k) for k in {x[:3] for x in want}})
    assert bpe.encode(none).count() == 0 and bpe.round_trip(none).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=300))
def test_bpe_round_trip(text):
    assert bpe.decode(bpe.encode_piece(text, RANKS), RANKS) == text.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode()


def test_chunks_are_stitched_where_boundaries_agree(spark):
    text = "some words, and 12 numbers it's " * 4000
    pieces = bpe.stitched(spark.createDataFrame([(1, "k", text)], "doc_id long, key string, text string")).orderBy("piece").collect()
    assert len(pieces) > 2 and "".join(p.text for p in pieces) == text


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_rule_counts_by_definition(messy, none):
    labels = messy.sparkSession.createDataFrame([(1, 1), (2, 0), (None, 0)], "doc_id long, quality int")
    got = quality_rules.judged(messy, labels).collect()
    assert len(got) == messy.count()
    for r in got:
        assert (r.stats.n_words, r.stats.word_chars, r.stats.n_symbols, r.stats.n_dup_lines, r.stats.n_repeat_words) == brute_counts(r.text)
        assert r.base_failed == (r.stats.n_words < 50 or 100 * r.stats.n_repeat_words > 50 * r.stats.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judged(none, labels).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(found):
    ids = np.array([ord(x) - 97 for x in found], np.int64)
    assert quality_rules.repeated_words(ids) == brute_counts(" ".join(found))[4]


def test_decision_list_finds_the_rule():
    draw = np.random.default_rng(1)
    x = {"a": draw.random(2000), "b": draw.random(2000)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.1) & (x["a"] > 0.3))
    rules = quality_rules.learn(x, bad)
    said = np.zeros(2000, bool)
    for r in rules:
        said |= r.covers(x)
    assert (said == bad).mean() > 0.97 and 1 <= len(rules) <= 8
    assert quality_rules.learn(x, np.zeros(2000, bool)) == []


def test_chat_round_trip(spark):
    odd = ["</turn>\n", "&lt;turn user&gt;", "<turn assistant>x</turn>", "\\### Assistant: </turn> ok", "🙂 é", "", None]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)] + [(None, 0, None, "no id"), (2, None, "user", "b"), (2, None, "user", "a"), (2, 1, "as<is>t", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.turns(df))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(odd)]
    assert got[1].loss_text == "".join(t or "" for i, t in enumerate(odd) if i % 2)
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "a"), ("user", "b"), ("as<is>t", "c")]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "no id")]
    assert chat.formatted(df.where("false")).count() == 0


def test_layouts_by_fingerprint(spark):
    p = spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string")
    assert [(r.turn, r.role, r.text) for r in chat.turns(p).collect()] == [(0, "user", "q"), (1, "assistant", "a")]
    m = spark.sql("SELECT 1L AS conv_id, 'x' AS extra, array(named_struct('from', 'human', 'value', 'q'), named_struct('from', 'gpt', 'value', 'a')) AS conversations")
    assert [(r.role, r.text) for r in chat.turns(m).collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.turns(spark.sql("SELECT 1L AS conv_id, 2 AS other"))
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
        '{"instruction":"do","input":"this","output":"done"}',
        '{"prompt":"q","response":"a"}',
        '{"id":4,"source":"x","messages":[{},{"role":"user","content":"q","weight":1},{"role":"assistant","content":"a"}]}',
        '{"prompt":"q","response":"a","answer":"other"}',
        '{"turn":"3","role":"tool","text":"t"}',
        "not json",
        '{"what":1}',
        "[1]",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    rows = chat.json_turns(df).collect()
    by = {i: [(r.role, r.text) for r in sorted((r for r in rows if r.conv_id == i), key=lambda r: r.turn or 0)] for i in range(len(records))}
    assert by[0] == by[2] == by[4] == [("user", "q"), ("assistant", "a")]
    assert by[1] == [("user", "do\n\nthis"), ("assistant", "done")]
    assert by[3] == [(None, None), ("user", "q"), ("assistant", "a")] and by[5] == [("tool", "t")]
    unknown = chat.json_layouts(df).where("layout IS NULL").groupBy("fingerprint").count().collect()
    assert sum(r["count"] for r in unknown) == 4 and not any(by[i] for i in (6, 7, 8, 9))
    assert chat.json_turns(df.where("false")).count() == 0


def test_the_fingerprint_decides(spark, monkeypatch):
    """The same columns are other turns under another mapping of their fingerprint, and none without."""
    df = spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in chat.turns(df).collect()] == [(1, 0, "user", "q")]
    key = chat.fingerprint(["role", "text", "turn"])
    monkeypatch.setitem(chat.MAPPINGS, key, (("role", "text", "turn"), chat._pair(("role", "system"), ("text", "user"))))
    assert [tuple(r) for r in chat.turns(df).collect()] == [(1, 0, "system", "user"), (1, 1, "user", "q")]
    monkeypatch.delitem(chat.MAPPINGS, key)
    monkeypatch.setattr(chat, "LARGEST", [])
    with pytest.raises(ValueError):
        chat.turns(df)


def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    target, open_ = {}, set(names)
    total = sum(sizes.values())
    while open_:
        level = (total - sum(target.values())) / sum(weight[k] for k in open_)
        over = {k for k in open_ if level * weight[k] > 3 * sizes[k]}
        if not over:
            target |= {k: level * weight[k] for k in open_}
            break
        target |= {k: 3.0 * sizes[k] for k in over}
        open_ -= over
    return target


@pytest.mark.parametrize("bins", [4096, 4])
def test_mix_by_definition(spark, messy, none, bins):
    draw = random.Random(5)
    rows = [(100 + i, "w " * draw.choice([1, 3, 50, 400]), draw.choice(["a", "b", "b", "b", "é", None, "z"])) for i in range(900)] + [(1, "w " * 100_000, "big")]
    df = messy.select("doc_id", "text", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixing.mix(df, bins=bins).collect()
    assert len(got) == df.count()
    size = Counter()
    for r in got:
        size[r.source] += r.size
    want = brute_targets(size)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.size * r.copies <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(none).count() == 0


def test_odds_differ_within_a_source(spark):
    """Of one source, half of its words are taken; longer documents have higher inclusion odds."""
    rows = [(i, "w " * (10 if i % 2 else 160), s) for s in "ab" for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.withColumn("half", F.lit(1.0)), weights=(1, 3)).where("source = 'a'").toPandas()
    rate = got.groupby("size")["copies"].mean()
    assert abs(got["taken"].sum() - got["target"].iloc[0]) <= 80 and got["target"].iloc[0] == got["size"].sum() / 2
    odds = rate / (1 - rate)
    assert 3.2 < odds[160] / odds[10] < 4.8  # the root of 16
    even = mixing.mix(df.withColumn("half", F.lit(1.0)), weights=(1, 3), preference="half").where("source = 'a'").toPandas().groupby("size")["copies"].mean()
    assert abs(even[160] - even[10]) < 0.06


def test_mixed_rows_repeat_as_taken(messy):
    rows = mixing.mixed(messy.selectExpr("*", "1 AS row", "2 AS key", "3 AS turn", "4 AS copies"))
    assert rows.columns == [*messy.columns, "row", "key", "turn", "copies"]
    got = Counter(r.doc_id for r in rows.collect())
    want = Counter()
    for r in mixing.mix(messy).collect():
        want[r.doc_id] += r.copies
    assert got == +want


def brute_top(queries, rows, k):
    """Of (row, id, vector): the best k rows but the query's own; ties to the smaller id, none last."""
    out = []
    for n, i, q in queries:
        ranked = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), j is None, j or 0) for m, j, x in rows if m != n)[:k]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(ranked)]
    return sorted(out, key=repr) if any(x[2] is None for x in out) else sorted(out)


def test_top_k_by_definition(spark):
    draw = np.random.default_rng(2)
    v = draw.normal(size=(400, 8)).round(2)
    v[100:180] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, float("nan")] + [0.0] * 6), (902, [float("inf")] * 8), (903, []), (None, [1.0] * 8), (904, [None] + [1.0] * 7), (905, [1.0, 2.0])]
    rows += [(0, v[7].tolist()), (5, v[5].tolist()), (5, v[5].tolist()), (11, v[100].tolist()), (None, [1.0] * 8), (None, v[3].tolist()), (910, [])] + [(12, v[12].tolist())] * 9  # ids and rows that repeat
    df = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(0)))
    whole = [(n, i, [math.floor(256 * c) for c in x]) for n, (i, x) in enumerate(rows) if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    want = brute_top([x for x in whole if x[1] is not None and x[1] % 5 == 0], whole, 5)
    for options in ({"pivots": 16, "block": 20, "asked": 7}, {}):
        assert sorted(map(repr, map(tuple, topk.top_k(df.where("vec_id % 5 = 0"), df, 5, **options).collect()))) == sorted(map(repr, want))
    few = df.where("vec_id < 3")
    assert topk.top_k(few, few, 5).count() == len(brute_top([x for x in whole if x[1] in (0, 1, 2)], [x for x in whole if x[1] in (0, 1, 2)], 5))
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0 == topk.top_k(df.where("false"), df).count()


def test_only_the_own_row_is_no_candidate(spark):
    rows = [(50, [-1.0, 0.0]), (1, [1.0, 0.0]), (2, []), (None, [-1.0, 0.0]), (50, [-2.0, 0.0])]
    ids = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = Counter(tuple(r) for r in topk.top_k(ids.where("vec_id = 50"), ids).collect())
    one = [(50, 1, 50, 131072), (50, 2, None, 65536), (50, 3, 2, 0), (50, 4, 1, -65536)]
    two = [(50, 1, 50, 131072), (50, 2, None, 131072), (50, 3, 2, 0), (50, 4, 1, -131072)]
    assert got == Counter(one + two)
    twice = topk.integers(spark.createDataFrame([(7, [1.0]), (7, [1.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in topk.top_k(twice, twice).collect()] == [(7, 1, 7, 65536)] * 2
    empty = topk.integers(spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in topk.top_k(empty, empty).collect()) == [(1, 1, 2, 0), (2, 1, 1, 0)]


def test_bounds_prune_clustered_vectors(spark):
    """Forty clusters in 16 dimensions: a query visits a third of the cells, and still finds the same."""
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(40, 16)) * 3
    v = (centres[draw.integers(0, 40, 3000)] + draw.normal(size=(3000, 16)) * 0.1).round(3)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    visited = []
    got = sorted(tuple(r) for r in topk.top_k(df.where("vec_id % 50 = 0"), df, 5, visited=visited).collect())
    whole = [(i, i, [math.floor(256 * c) for c in x]) for i, x in rows]
    assert got == brute_top(whole[::50], whole, 5)
    assert sum(visited[:2]) < 0.5 * visited[2]


def auc(label, score):
    rank = pd.Series(score).rank().to_numpy()
    p, n = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * n)


@pytest.mark.parametrize(("name", "of", "least"), [("op7_toxicity", "toxic", 0.85), ("op8_quality_model", "quality", 0.95)])
def test_held_out_accuracy(spark, name, of, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.5)).all()
    assert auc(held[of].to_numpy(), held["score"].to_numpy()) > least


def test_classifiers_take_anything(spark, messy, none):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    yes = F.lit(True)
    for model in (toxicity, quality_model):
        got = model.classify(messy, labels, yes).collect()
        assert len(got) == messy.count() and all(0 <= r.score <= 1 for r in got)
        assert model.classify(none, labels, yes).count() == 0
        assert model.classify(messy, labels.where("false"), yes).count() == messy.count()


def test_folds(spark):
    import zlib

    got = spark.range(50).select("id", crc_mod(F.col("id"), 5).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_chunks_cover_whole_texts():
    text = "".join(chr(97 + i % 26) for i in range(5000))
    rows = quality_model.chunks(text)
    seen = {bytes(r[i : i + quality_model.WIDTH]) for r in rows for i in range(quality_model.CHUNK - quality_model.WIDTH + 1)}
    raw = text.encode()
    assert {raw[i : i + quality_model.WIDTH] for i in range(len(raw) - quality_model.WIDTH + 1)} <= seen


def test_convolution_by_plain_loops():
    """The pooled responses of a network of random filters against sums over every place of every chunk."""
    draw = np.random.default_rng(3)
    tables = draw.normal(size=(quality_model.WIDTH, 256, quality_model.FILTERS)).astype(np.float32)
    text = "".join(draw.choice(list("abc é\n"), 1300))
    raw = text.encode()
    step = quality_model.CHUNK - quality_model.WIDTH + 1
    starts = [*range(0, len(raw) - quality_model.CHUNK, step), len(raw) - quality_model.CHUNK]
    per_chunk = []
    for s in starts:
        chunk = raw[s : s + quality_model.CHUNK]
        best = [-math.inf] * quality_model.FILTERS
        for at in range(len(chunk) - quality_model.WIDTH + 1):
            for f in range(quality_model.FILTERS):
                best[f] = max(best[f], sum(float(tables[k, chunk[at + k], f]) for k in range(quality_model.WIDTH)))
        per_chunk.append(best)
    p = np.array(per_chunk)
    assert np.allclose(quality_model.document(tables, text), np.concatenate([p.mean(0), p.min(0), p.max(0)]), atol=1e-4)
    net = quality_model.Network(tables, np.zeros(48), np.ones(48), draw.normal(size=48) / 50, 0.1)
    z = sum(a * b for a, b in zip(np.concatenate([p.mean(0), p.min(0), p.max(0)]), net.weights, strict=True)) + 0.1
    assert math.isclose(quality_model.probability(net, text), 1 / (1 + math.exp(-z)), rel_tol=1e-3)


def test_one_row_of_a_labelled_id_is_learned_from(spark):
    """However many rows bear a chosen id, one text of it goes on: that of least hash."""
    rows = [(1, f"text {i} " * 30) for i in range(3_000)] + [(2, "two"), (2, None), (None, "none"), (3, "not chosen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    chosen = spark.createDataFrame([(1, 1), (2, 0)], "id long, label int")
    got = {r.doc_id: (r.text, r.label) for r in one_text(docs, chosen).collect()}
    hashed = docs.where("doc_id = 1").orderBy(F.xxhash64("text")).first().text
    assert got[1] == (hashed, 1) and set(got) == {1, 2} and one_text(docs, chosen).count() == 2
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled(docs, labels, "toxic", F.lit(True), 1).count() == 1
    assert quality_rules.judged(docs, labels, ["doc_id"], sample=1).count() == len(rows)
