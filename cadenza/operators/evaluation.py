"""Evaluation of measurements against a ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import keys, tempo
from cadenza.functions.text import basename
from cadenza.operators.stats import pearson
from cadenza.sources.staging import staged

#: metric, operator, limit of the contract; fixed values.
THRESHOLDS = (
    ("bpm_error_p95", "<=", 1.0),
    ("key_exact", ">=", 85.0),
    ("key_compatible", ">=", 95.0),
    ("out_of_gate", "<=", 0.0),
    ("clashes", "<=", 10.0),
    ("curve_deviation", "<=", 0.22),
    ("curve_spearman", ">=", 0.5),
    ("analysis_seconds", "<=", 10.0),
    ("latency_ms", "<", 200.0),
)


def _keyed(df: DataFrame, location: str) -> DataFrame:
    return df.withColumn("file", F.lower(basename(F.col(location)))).where("file <> ''")


def match_files(measured: DataFrame, truth: DataFrame, measured_path: str, truth_path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest): inner join by file name, of names that stand once on either side; and all other names with why.

    ``rest`` has file and state: ambiguous, only-measured or only-truth.
    """
    a, b = _keyed(measured, measured_path), _keyed(truth, truth_path)
    na, nb = a.groupBy("file").agg(F.count(F.lit(1)).alias("na")), b.groupBy("file").agg(F.count(F.lit(1)).alias("nb"))
    names = na.join(nb, "file", "full_outer")
    state = F.when((F.coalesce("na", F.lit(0)) > 1) | (F.coalesce("nb", F.lit(0)) > 1), "ambiguous").when(F.col("nb").isNull(), "only-measured").when(F.col("na").isNull(), "only-truth").otherwise("matched")
    names = names.select("file", state.alias("state"))
    good = names.where("state = 'matched'").select("file")
    return a.join(good, "file").join(b, "file"), names.where("state <> 'matched'")


def compared(pairs: DataFrame) -> DataFrame:
    """Adds error, tolerant error, class and key verdicts to columns bpm_est, bpm_ref, key_est, key_ref, agreement."""
    est, ref = F.col("bpm_est"), F.col("bpm_ref")
    has = tempo.valid(ref)
    key_has = keys.number(F.col("key_ref")).isNotNull()
    return pairs.withColumns(
        {
            "bpm_error": F.when(has, F.bround(F.abs(est - ref), 2)),
            "bpm_error_tolerant": F.when(has, F.bround(tempo.absolute_error(est, ref), 2)),
            "bpm_class": tempo.error_class(est, ref)["class"],
            "key_exact": F.when(key_has, F.col("key_est") == F.col("key_ref")),
            "key_compatible": F.when(key_has, keys.compat(F.col("key_est"), F.col("key_ref")) >= 0.8),
            "unanimous": keys.unanimous(F.col("agreement")),
        }
    )


def contract_metrics(rows: DataFrame) -> DataFrame:
    """One row: p95 of the tolerant error (0 of nothing), key accuracy over unanimous rows (null of nothing), coverage."""
    judged = F.col("unanimous") & F.col("key_exact").isNotNull()
    share = lambda c: F.try_divide(100.0 * F.count_if(judged & F.col(c)), F.count_if(judged))
    return rows.agg(
        F.coalesce(F.percentile("bpm_error_tolerant", 0.95), F.lit(0.0)).alias("bpm_error_p95"),
        share("key_exact").alias("key_exact"),
        share("key_compatible").alias("key_compatible"),
        F.count_if(judged).alias("n_unanimous"),
        F.count("key_exact").alias("n_with_key"),
        F.count(F.lit(1)).alias("n"),
    )


def by_agreement(rows: DataFrame) -> DataFrame:
    """agreement, n, exact, compatible (percent): most segments first, then most agreement, none last."""
    text = F.coalesce(F.nullif(F.trim("agreement"), F.lit("")), F.lit("none"))
    known = rows.where(F.col("key_exact").isNotNull()).groupBy(text.alias("agreement"))
    out = known.agg(F.count(F.lit(1)).alias("n"), (100.0 * F.avg(F.col("key_exact").cast("int"))).alias("exact"), (100.0 * F.avg(F.col("key_compatible").cast("int"))).alias("compatible"))
    part = lambda i: F.get(F.split("agreement", "/"), F.lit(i)).try_cast("int")
    return out.orderBy(part(1).desc_nulls_last(), part(0).desc_nulls_last())


def class_counts(rows: DataFrame) -> DataFrame:
    """class, n in the classes' own order; classes without rows are hidden, but for exact and genuine."""
    classes = rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(tempo.CLASSES)], "place int, class string")
    counts = rows.groupBy(F.col("bpm_class").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    out = classes.join(counts, "class", "left").select("place", "class", F.coalesce("n", F.lit(0)).alias("n"))
    return out.where("n > 0 OR class IN ('exact', 'genuine')").orderBy("place").select("class", "n")


def calibration(rows: DataFrame, edges: tuple[float, ...] = (-1.01, 0.34, 0.67, 0.99, 1.01)) -> DataFrame:
    """bucket, low, high, n, accuracy: does the confidence tell a key that is right?"""
    known = rows.where(F.col("key_exact").isNotNull())
    bucket = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        bucket = F.when((F.col("confidence") >= low) & (F.col("confidence") < high), i).otherwise(bucket)
    out = known.withColumn("bucket", bucket).where("bucket IS NOT NULL").groupBy("bucket")
    return out.agg(F.count(F.lit(1)).alias("n"), (100.0 * F.avg(F.col("key_exact").cast("int"))).alias("accuracy"))


def confidence_correlation(rows: DataFrame) -> DataFrame:
    """n and pearson of confidence and accuracy; null for fewer than 3 rows or without variance."""
    hit = F.col("key_exact").cast("double")
    out = rows.where(F.col("key_exact").isNotNull()).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("confidence"), hit).alias("pearson"))
    return out.select("n", F.when(F.col("n") >= 3, F.col("pearson")).alias("pearson"))


def verdicts(metrics: DataFrame) -> DataFrame:
    """(metric, value) -> metric, op, bound, value, ok for each threshold; null where it isn't measured."""
    limits = metrics.sparkSession.createDataFrame(list(THRESHOLDS), "metric string, op string, bound double")
    value = F.when(~F.isnan("value"), F.col("value"))
    ok = F.when(F.col("op") == "<=", value <= F.col("bound")).when(F.col("op") == ">=", value >= F.col("bound")).otherwise(value < F.col("bound"))
    return limits.join(metrics, "metric", "left").select("metric", "op", "bound", value.alias("value"), ok.alias("ok"))


def doubt_groups(measured: DataFrame, compared_: DataFrame, name: Column) -> DataFrame:
    """agreement, doubtful, n, n_ref, exact, compatible (percent of those with a reference): all of ``measured`` by agreement, with a reference or not.

    ``name`` is what ``compared_``'s file is called in ``measured``. A group without references has no percentages.
    """
    # Written, so that the comparison and the groups are compiled apart.
    known = staged(compared_.select("file", "key_exact", "key_compatible"), "doubt-compared")
    met = measured.select(name.alias("file"), F.col("agreement").alias("of")).join(known, "file", "left")
    percent = lambda c: F.avg(F.when(F.col("key_exact").isNotNull(), F.when(F.col(c), 100.0).otherwise(0.0)))
    by = met.groupBy(F.coalesce("of", F.lit("none")).alias("agreement"), keys.doubtful(F.col("of")).alias("doubtful"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.count("key_exact").alias("n_ref"), percent("key_exact").alias("exact"), percent("key_compatible").alias("compatible"))


def overall(rows: DataFrame) -> DataFrame:
    """1 if any threshold fails, 2 if any isn't measured, else 0."""
    return rows.agg(F.when(F.bool_or(~F.col("ok")), 1).when(F.count_if(F.col("ok").isNull()) > 0, 2).otherwise(0).alias("verdict"))


def confusion(rows: DataFrame, flag: str, truth: str) -> DataFrame:
    """Counts and rates of a flag against a label; rates of nothing are null, unlabelled rows only counted."""
    f, t = F.col(flag), F.col(truth)
    out = rows.agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & ~t).alias("tn"), F.count_if(~f & t).alias("fn"), F.count_if(t.isNull()).alias("unlabelled"))
    rate = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "accuracy": rate(tp + tn, tp + fp + tn + fn)})
