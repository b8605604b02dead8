"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The labelled rows of the learning folds are dealt by a hash of the id into three parts. On the
first a lexicon is learned: word starts and whole words that are much more frequent in toxic
documents, added to a short list of plain insults. The trees learn from the features of the second
part, the isotonic calibration from their scores on the third. Features are rates over the whole
text: lexicon densities, hits near a second-person word, capitals, punctuation and obfuscation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import one_text, staged, words

#: At most so many labelled rows are learned from.
SAMPLE = 20_000
#: Plain insults in four languages; a fixed list.
SEEDS = frozenset(
    "idiot moron stupid loser scum trash clown pathetic worthless disgusting "
    "trottel dummkopf versager abschaum arschloch "
    "crétin abruti imbécile ordure minable "
    "imbécil estúpido basura escoria inútil".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner tu te toi ton ta tes vous votre vos tú ti usted ustedes".split())
#: What letters are often replaced by.
PLAIN = str.maketrans("01345@$7", "oieasast")
PREFIXES = (4, 5, 6, 7)
#: A learned entry is so much likelier (natural logarithm) in toxic documents, and stands in so many.
MIN_LOG_ODDS, MIN_DOCS = 1.5, 3
FEATURES = ("strong", "weak", "seeds", "mean_weight", "strong_count", "near_you", "you", "capitals", "marks", "obfuscated", "max_weight", "strong_kinds")
NEAR = 3


def entries(word: str) -> list[str]:
    return [word[:n] for n in PREFIXES if len(word) > n] + [f"{word}$"]


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """(text, label) -> log odds of entries. The rows are a bounded sample, so is the result."""
    found = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    starts = [F.filter(F.transform("w", lambda w, n=n: F.when(F.length(w) > n, F.substring(w, 1, n))), lambda x: x.isNotNull()) for n in PREFIXES]
    each = rows.select("label", found.alias("w")).select("label", F.explode(F.array_distinct(F.concat(*starts, F.transform("w", lambda w: F.concat(w, F.lit("$")))))).alias("entry"))
    counts = each.groupBy("entry").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("n"))
    total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    odds = F.log((F.col("t") + 0.5) / (total[0] + 1)) - F.log((F.col("n") + 0.5) / (total[1] + 1))
    return {r.entry: r.odds for r in counts.where(F.col("t") >= MIN_DOCS).select("entry", odds.alias("odds")).where(F.col("odds") >= MIN_LOG_ODDS).collect()}


class Words(dict):
    """What is known of a word: weight, seed, second person, capitals, obfuscated, marks. Filled as words come."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, raw: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        text = raw.decode("utf-8", "replace")
        marks = text.count("!") + text.count("?")
        word = text.strip(".,;:!?\"'()[]{}<>|*#$%&-_").lower()
        plain = word.translate(PLAIN)
        plain = re.sub(r"[^\w]|_", "", plain)
        letters = sum(c.isalpha() for c in word)
        hidden = 0 < letters < len(word)
        weight = max((self.lexicon.get(e, 0.0) for e in entries(word)), default=0.0)
        if hidden:
            weight = max(weight, max((self.lexicon.get(e, 0.0) for e in entries(plain)), default=0.0))
        seed = word in SEEDS or plain in SEEDS
        level = min(255, round(16 * max(weight, 4.0 if seed else 0.0)))
        upper = len(word) > 1 and text.upper() == text and letters > 1
        code = level | seed << 8 | (word in SECOND_PERSON) << 9 | upper << 10 | hidden << 11 | min(marks, 15) << 12
        self[raw] = code
        return code


def features(text: str | None, known: Words) -> list[float]:
    """``FEATURES`` of a text; all 0 without words."""
    found = words(text)
    if not found:
        return [0.0] * len(FEATURES)
    code = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
    n, weight = len(code), (code & 255) / 16
    strong, you = weight >= 2, (code >> 9 & 1).astype(bool)
    near = 0.0
    if strong.any() and you.any():
        at, others = np.flatnonzero(strong), np.flatnonzero(you)
        right = np.searchsorted(others, at)
        gap = np.minimum(np.abs(others[np.minimum(right, len(others) - 1)] - at), np.abs(others[np.maximum(right - 1, 0)] - at))
        near = float((gap <= NEAR).mean())
    kinds = len({found[i] for i in np.flatnonzero(strong)})
    rate = lambda x: float(x.sum()) / n
    return [rate(strong), rate(weight >= 1), rate(code >> 8 & 1), rate(weight), math.log1p(float(strong.sum())), near, rate(you), rate(code >> 10 & 1), rate(code >> 12), rate(code >> 11 & 1), float(weight.max()), math.log1p(kinds)]


def with_features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``rows`` with text replaced by x, an array of ``FEATURES``."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)  # learned from a bounded sample
    rest = [c for c in rows.columns if c != "text"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(shared.value)
        for b in batches:
            x = [features(t, known) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(x, pa.list_(pa.float64()))], [*rest, "x"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.drop("text").dtypes), "x array<double>"])
    return rows.select(*rest, "text").mapInArrow(measure, schema)


@dataclass
class Model:
    """What ``score`` needs: lexicon, trees (none: the constant ``rate``), and the calibration's steps."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    steps: tuple[list[float], list[float]]
    rate: float


def learn(rows: DataFrame, trees: int = 24, depth: int = 3) -> Model:
    """A model from (doc_id, text, label), a bounded sample. One class or no rows: the constant rate of label 1."""
    # By id only: rows that share one stay together, and a rerun deals them alike.
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(8))
    rows = staged(rows.withColumn("part", part), "toxic-sample")
    count = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    rate = count.get(1, 0) / max(1, sum(count.values()))
    lexicon = learn_lexicon(rows.where("part < 3"))
    measured = staged(with_features(rows.select("label", "part", "text"), lexicon), "toxic-features").withColumn("features", array_to_vector("x")).withColumn("label", F.col("label").cast("double"))
    kinds = {(r.late, r.label) for r in measured.where("part >= 3").select((F.col("part") >= 6).alias("late"), "label").distinct().collect()}
    if not {(False, 0.0), (False, 1.0), (True, 0.0), (True, 1.0)} <= kinds:
        return Model(lexicon, None, ([], []), rate)
    grown = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(measured.where("part >= 3 AND part < 6").coalesce(4))
    scored = grown.transform(measured.where("part >= 6")).select("label", vector_to_array("probability")[1].alias("raw"))
    steps = IsotonicRegression(featuresCol="raw").fit(scored.coalesce(4))
    # A little towards the middle, so that a pure step isn't certain.
    return Model(lexicon, grown, (list(steps.boundaries), [0.005 + 0.99 * p for p in steps.predictions]), rate)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` without text, with score (0 to 1)."""
    measured = with_features(rows, model.lexicon)
    if model.trees is None:
        return measured.drop("x").withColumn("score", F.lit(model.rate))
    raw = model.trees.transform(measured.withColumn("features", array_to_vector("x"))).withColumn("raw", vector_to_array("probability")[1])
    at, value = (F.array(*map(F.lit, s)) for s in model.steps)
    # Linear between the calibration's boundaries, constant outside, a little of the raw score to keep the order within a step.
    i = F.size(F.filter(at, lambda b: b <= F.col("raw")))
    low, high = F.get(at, i - 1), F.get(at, i)
    between = F.get(value, i - 1) + (F.get(value, i) - F.get(value, i - 1)) * (F.col("raw") - low) / (high - low)
    calibrated = F.coalesce(between, F.get(value, i - 1), F.get(value, F.lit(0)))
    return raw.withColumn("score", 0.999 * calibrated + 0.001 * F.col("raw")).drop("x", "features", "raw", "rawPrediction", "probability", "prediction")


def labelled(docs: DataFrame, labels: DataFrame, of: str, learning, sample: int) -> DataFrame:
    """doc_id, text, label: the ``sample`` labelled documents of lowest hash for which ``learning`` holds; of an id one."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(of).isin(0, 1) & learning).groupBy(F.col("doc_id").alias("id")).agg(F.max(of).cast("long").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    # At most ``sample`` rows of two numbers: small enough to send to every executor.
    return one_text(docs, chosen)


def classify(docs: DataFrame, labels: DataFrame, learning, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, predicted: one row for each row of ``docs``.

    Labels are learned from rows for which the condition ``learning`` on doc_id holds. Null and empty
    texts score as texts without any hit. Rows with equal texts score alike, whatever their other
    columns, which are ignored. An empty table gives an empty result.
    """
    model = learn(labelled(docs, labels, "toxic", learning, sample))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
