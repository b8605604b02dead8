from __future__ import annotations

from collections import Counter

import corpus_pipeline
from cadenza.llm import mixing, ngram_join, quality_rules
from cadenza.llm.common import staged
from tests.llm.test_dedup import brute_classes, brute_lines
from tests.llm.test_text_operators import brute_counts, expected_ids


def test_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    verdict = {r.doc_id: r["rule"] for r in quality_rules.judged(docs, labels, ["doc_id"]).collect()}
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)

    a = staged(one(spark, docs, sf), "t")
    want = {r.doc_id for r in rows if (c := brute_counts(r.text))[0] >= 50 and 100 * c[4] <= 50 * c[0] and verdict[r.doc_id] == 0}
    assert {r.doc_id for r in a.collect()} == want and a.columns == columns

    b = staged(two(spark, a, sf), "t")
    plain = brute_lines([(r.doc_id, r.text) for r in a.collect()], 3)
    assert {r.doc_id: r.text for r in b.collect()} == {i: t for i, (_, n, t) in plain.items() if n == 0 or t.strip()} and b.columns == columns

    c = staged(three(spark, b, sf), "t")
    assert {r.doc_id for r in c.collect()} == {head for _, head, _ in brute_classes([(r.doc_id, r.text) for r in b.collect()])} and c.columns == columns

    d = staged(four(spark, c, sf), "t")
    taken = Counter({r.doc_id: r.copies for r in mixing.mix(c).collect()})
    assert Counter(r.doc_id for r in d.collect()) == +taken and d.columns == columns

    e = five(spark, d, sf).collect()
    texts = {r.doc_id: r.text for r in d.collect()}
    assert len(e) == d.count() and all(r.n_tokens == len(expected_ids(texts[r.doc_id])) for r in e)
    assert ngram_join.THRESHOLD == 0.8


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0
