"""Saved sets: snapshots of steps as they were shown, ratings of their transitions, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.export import fingerprints, guarded

RATINGS = ("ok", "fair", "bad")


def violations(steps: DataFrame) -> DataFrame:
    """set_id, rule for every rule that a set's steps break: positions from 0 without holes, one seed, and that first."""
    by = steps.groupBy("set_id").agg(F.min("position").alias("low"), F.max("position").alias("high"), F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("kinds"), F.count_if(F.col("is_seed")).alias("seeds"), F.min_by("is_seed", "position").alias("first"))
    rules = {"positions": (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("kinds") != F.col("n")), "one-seed": F.col("seeds") != 1, "seed-first": ~F.col("first")}
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return by.select("set_id", F.explode(broken).alias("rule"))


def set_fingerprints(steps: DataFrame) -> DataFrame:
    """set_id, fingerprint: any difference in any step changes it."""
    each = fingerprints(steps, ["set_id", "position"])
    return each.groupBy("set_id").agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.lpad(F.col("position").cast("string"), 9, "0"), "fingerprint"))), "\n").cast("binary"), 256), 1, 32).alias("fingerprint"))


def rated(ratings: DataFrame, changes: DataFrame) -> DataFrame:
    """Ratings (set_id, transition, rating, reason, rated_at) after changes; the latest of a transition counts. A bad one without a reason is an error."""
    needs = (F.col("rating") == "bad") & (F.coalesce(F.trim("reason"), F.lit("")) == "")
    checked = changes.withColumn("rating", F.when(needs, F.raise_error(F.lit("a bad rating needs a reason")).cast("string")).when(F.col("rating").isin(*RATINGS), F.col("rating")).otherwise(F.raise_error(F.concat(F.lit("no rating named "), "rating")).cast("string")))
    latest = W.partitionBy("set_id", "transition").orderBy(F.col("rated_at").desc(), "rating", "reason")
    both = ratings.unionByName(checked)
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def rating_summary(steps: DataFrame, ratings: DataFrame) -> DataFrame:
    """set_id, transitions, ok, fair, bad, unrated."""
    n = steps.groupBy("set_id").agg((F.count(F.lit(1)) - 1).alias("transitions"))
    counts = ratings.groupBy("set_id").agg(*(F.count_if(F.col("rating") == r).alias(r) for r in RATINGS))
    out = n.join(counts, "set_id", "left").select("set_id", "transitions", *(F.coalesce(r, F.lit(0)).alias(r) for r in RATINGS))
    return out.withColumn("unrated", F.col("transitions") - F.col("ok") - F.col("fair") - F.col("bad"))


def listing(steps: DataFrame, library: DataFrame) -> DataFrame:
    """set_id, steps, seed, missing (steps whose item the library no longer has)."""
    known = library.select("path").distinct().withColumn("_here", F.lit(True))
    met = steps.join(known, "path", "left")
    return met.groupBy("set_id").agg(F.count(F.lit(1)).alias("steps"), F.min_by("path", F.struct("position", "path")).alias("seed"), F.count_if(F.col("_here").isNull()).alias("missing"))


def rating_rows(steps: DataFrame, ratings: DataFrame) -> DataFrame:
    """A row for each transition with both items and its rating, safe for spreadsheets."""
    to = steps.select("set_id", (F.col("position") - 1).alias("position"), F.col("path").alias("to_path"))
    hops = steps.select("set_id", "position", F.col("path").alias("from_path")).join(to, ["set_id", "position"])
    r = ratings.select("set_id", (F.col("transition") - 1).alias("position"), "rating", "reason")
    return guarded(hops.join(r, ["set_id", "position"], "left").withColumn("transition", F.col("position") + 1).drop("position"))
