"""Audits of finished sets and signals by windows, and the queue of files to be analysed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.scoring import dot


def artist_repeats(steps: DataFrame, group: str, position: str | list[str], gap: int = 4) -> DataFrame:
    """``steps`` with repeated: whether the artist stands in the ``gap`` rows before it, in order of the column or columns ``position``; nobody's name repeats nothing."""
    before = W.partitionBy(group).orderBy(*([position] if isinstance(position, str) else position)).rowsBetween(-gap, -1)
    artist = F.nullif(F.lower(F.trim("artist")), F.lit(""))
    return steps.withColumn("repeated", F.coalesce(F.array_contains(F.collect_list(artist).over(before), artist), F.lit(False)))


def redundancy(steps: DataFrame, group: str, position: str, vector: str = "timbre") -> DataFrame:
    """group, position, redundancy: the largest similarity to an earlier item of the set, its seed left out; 0 where there is none."""
    a = steps.select(group, position, vector)
    b = steps.select(F.col(group).alias("other"), F.col(position).alias("at"), F.col(vector).alias("v")).withColumn("seed", F.min("at").over(W.partitionBy("other")))
    met = a.join(b, (F.col(group) == F.col("other")) & (F.col("at") < F.col(position)) & (F.col("at") > F.col("seed")), "left")
    return met.groupBy(group, position).agg(F.greatest(F.coalesce(F.max(dot(F.col(vector), F.col("v"))), F.lit(0.0)), F.lit(0.0)).alias("redundancy"))


def max_after(signal: Column, k: int) -> Column:
    """At each frame the largest value of it and the k - 1 frames after it."""
    return F.transform(signal, lambda x, i: F.array_max(F.slice(signal, i + 1, k)))


def line_maxima(signal: Column, phase: Column, period: Column, low: float, high: float, rate: int) -> Column:
    """The largest value in [line + low, line + high] seconds of each grid line whose window lies in the signal."""
    wide = round((high - low) * rate) + 1
    n = F.size(signal)
    lines = F.sequence(F.lit(0), F.floor((n / F.lit(rate) - phase) / period).cast("int"))
    starts = F.filter(F.transform(lines, lambda j: F.bround((phase + period * j + low) * rate).cast("int")), lambda i: (i >= 0) & (i + wide <= n))
    return F.when((period > 0) & (n / F.lit(rate) >= phase), F.transform(starts, lambda i: F.array_max(F.slice(signal, i + 1, wide)))).otherwise(F.array().cast("array<double>"))


def largest(rows: DataFrame, weight: str, share: float, group: list[str]) -> DataFrame:
    """The ``share`` of each group's rows with the largest weight; ties at the edge stay."""
    edge = rows.groupBy(*(F.col(c).alias(f"edge_{c}") for c in group)).agg(F.percentile(weight, 1.0 - share).alias("edge"))
    same = [F.col(c).eqNullSafe(F.col(f"edge_{c}")) for c in group]
    return rows.join(edge, same).where(F.col(weight) >= F.col("edge")).select(*rows.columns)


def queue(items: DataFrame, states: DataFrame) -> DataFrame:
    """path, mtime: every file that some crate waits for, once, unless that version of it was analysed or failed before."""
    return items.where("file_ok").select("path", "mtime").distinct().join(states.select("path", "mtime"), ["path", "mtime"], "left_anti")


def progress(items: DataFrame, states: DataFrame) -> DataFrame:
    """crate_id, total, done, failed, waiting, no_file: a file's state counts in every crate that holds it."""
    met = items.select("crate_id", "path", "mtime", "file_ok").join(states.select("path", "mtime", "state"), ["path", "mtime"], "left")
    on = F.col("file_ok")
    return met.groupBy("crate_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(on & F.coalesce(F.col("state") == "analysed", F.lit(False))).alias("done"), F.count_if(on & F.coalesce(F.col("state") == "failed", F.lit(False))).alias("failed"),
        F.count_if(on & F.col("state").isNull()).alias("waiting"), F.count_if(~on).alias("no_file"),
    )


def last_failures(states: DataFrame, n: int = 5) -> DataFrame:
    """The n latest failures; ties by path."""
    return states.where("state = 'failed'").orderBy(F.col("mtime").desc(), "path").limit(n)
