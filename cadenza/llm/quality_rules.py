"""Quality rules: decision lists learned from labelled statistics by sequential covering.

Each text gets a few statistics. A list of rules, each a conjunction of thresholds that predicts
"bad", is learned from labelled ones: a rule is grown on two thirds of what no rule covers yet, one
threshold at a time, by information gain; it is pruned on the other third, dropping the last
thresholds while that raises (bad - good) / (bad + good) covered; it is kept if it is right often
enough there. The list is applied as one ordered CASE expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import one_text, words

SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_marks")
#: Statistics that rules may test: none that drifts with a clean text's length, as its share of distinct words does.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper_words", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
#: At most so many labelled rows are learned from.
SAMPLE = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    """All of ``tests`` (statistic, at_least, threshold) hold -> bad."""

    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, at_least, limit in self.tests:
            out &= x[name] >= limit if at_least else x[name] < limit
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_least, limit in self.tests:
            out = out & (F.col(name) >= F.lit(limit) if at_least else F.col(name) < F.lit(limit))
        return out


def repeated_words(ids: np.ndarray) -> int:
    """How many words stand in a window of three words that occurs at least twice."""
    if len(ids) < 4:
        return 0
    n = int(ids.max()) + 1
    pairs = np.unique(ids[:-1].astype(np.int64) * n + ids[1:], return_inverse=True)[1]
    windows, counts = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)[1:]
    often = counts[windows] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : len(ids) - 2 + k] |= often
    return int(hit.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of one text."""
    text = text or ""
    found = words(text)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in found), np.int64, len(found))
    seen: set[str] = set()
    n_lines = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    per_word = np.bincount(ids, minlength=len(index)) if found else np.zeros(0, np.int64)
    known = [w.decode("utf-8", "surrogatepass") for w in index]
    chars = int(sum(len(w) * c for w, c in zip(known, per_word.tolist(), strict=True)))
    upper = int(sum(c for w, c in zip(known, per_word.tolist(), strict=True) if len(w) > 1 and w.isupper()))
    marks = text.count("!") + text.count("?")
    return len(found), chars, len(SYMBOLS.findall(text)), dup, repeated_words(ids), n_lines, upper, marks


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([text_counts(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
        rest = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*rest, *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], [*batch.schema.names, *(f"_{c}" for c in COUNTS)])


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with a struct ``stats`` of ``COUNTS`` and ``RATIOS``. Null texts have no words."""
    given = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema), *(f"_{c} bigint" for c in COUNTS)])
    counted = given.mapInArrow(_counts, schema)
    ratio = {k: F.when(F.col(f"_{b}") > 0, F.col(f"_{a}") / F.col(f"_{b}")).otherwise(0.0) for k, (a, b) in RATIOS.items()}
    stats = F.struct(*(F.col(f"_{c}").alias(c) for c in COUNTS), *(v.alias(k) for k, v in ratio.items()))
    return counted.select(*keep, stats.alias("stats"))


def base_failed() -> Column:
    return (F.col("stats.n_words") < MIN_WORDS) | (100 * F.col("stats.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("stats.n_words"))


def grow(x: dict[str, np.ndarray], bad: np.ndarray, max_tests: int = 3, bins: int = 64) -> Rule:
    """A rule for rows ``bad``: greedily the threshold with the most information gain, while it gains any."""
    covered, tests = np.ones(len(bad), bool), []
    while len(tests) < max_tests and covered.any() and not bad[covered].all():
        p0, n0 = bad[covered].sum(), covered.sum()
        best, pick = 1e-9, None
        for name, values in x.items():
            for limit in np.unique(np.quantile(values[covered], np.linspace(0, 1, bins))):
                for at_least in (True, False):
                    hit = covered & (values >= limit if at_least else values < limit)
                    p, n = bad[hit].sum(), hit.sum()
                    if p and (gain := p * (np.log2(p / n) - np.log2(p0 / n0))) > best + 1e-9:
                        best, pick = gain, (name, at_least, float(limit))
        if pick is None:
            break
        tests.append(pick)
        covered &= Rule((pick,)).covers(x)
    return Rule(tuple(tests))


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float]:
    """The rule's start that is best on held-back rows, and its precision there."""

    def worth(r: Rule) -> tuple[float, float]:
        hit = r.covers(x)
        n, p = hit.sum(), bad[hit].sum()
        return ((2 * p - n) / n, p / n) if n else (-1.0, 0.0)

    best = max((Rule(rule.tests[: k + 1]) for k in range(len(rule.tests))), key=lambda r: (worth(r)[0], -len(r.tests)), default=rule)
    return best, worth(best)[1]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.9, max_rules: int = 8) -> list[Rule]:
    """Sequential covering: rules until the next one isn't right often enough, or no bad row is left."""
    rules: list[Rule] = []
    left = np.arange(len(bad))
    while len(rules) < max_rules and bad[left].any():
        tried: list[tuple[float, Rule]] = []
        for turn in range(3):  # each third is held back once
            growing, held = left[left % 3 != turn], left[left % 3 == turn]
            if bad[growing].any() and len(held):
                rule = grow({k: v[growing] for k, v in x.items()}, bad[growing])
                pruned, precision = prune(rule, {k: v[held] for k, v in x.items()}, bad[held])
                tried += [(precision, pruned)] * bool(rule.tests)
        precision, rule = max(tried, key=lambda t: t[0], default=(0.0, Rule(())))
        if precision < min_precision:
            break
        rules.append(rule)
        left = left[~rule.covers({k: v[left] for k, v in x.items()})]
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from the ``sample`` labelled documents of lowest hash (all, if fewer; of an id one), in an order that doesn't depend on partitions."""
    order = (F.xxhash64("doc_id").asc(), F.col("doc_id").asc())
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(*order).limit(sample).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    # At most ``sample`` rows of two numbers: small enough to send to every executor.
    texts = one_text(docs, chosen)
    rows = statistics(texts.select("doc_id", "label", "text"), ["doc_id", "label"]).select("doc_id", "label", *(f"stats.{k}" for k in RATIOS)).toPandas()
    if rows.empty:
        return []
    rows = rows.sort_values(["doc_id", *RATIOS]).sample(frac=1, random_state=7)
    return learn({k: rows[k].to_numpy(float) for k in RATIOS}, rows["label"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """Which rule, from 1 on, rejects a row with columns ``RATIOS``; 0 if none does."""
    out = F
    for i, rule in enumerate(rules):
        out = out.when(rule.column(), i + 1)
    return out.otherwise(0) if rules else F.lit(0)


def judged(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``docs``'s columns ``keep`` (all), with stats, base_failed, rule and kept. One row for each row.

    A null or wordless text fails the base rules. Repeated and unlabelled rows are judged alike. With
    no usable labels the list is empty and the base rules decide alone. Columns of ``docs`` that are
    named like the result's own (stats, base_failed, rule, kept, or _ and a count) are dropped.
    """
    rules = learn_from(docs, labels, sample)
    docs = docs.drop("stats", "base_failed", "rule", "kept", "_s", *(f"_{c}" for c in COUNTS))
    keep = docs.columns if keep is None else keep
    named = statistics(docs, keep).withColumn("base_failed", base_failed())
    flat = named.select("*", F.col("stats").alias("_s"))
    found = verdict([Rule(tuple((f"_s.{n}", a, v) for n, a, v in r.tests)) for r in rules])
    return flat.withColumn("rule", found).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).drop("_s")
