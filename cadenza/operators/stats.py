"""Ranks, correlation and histograms over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.sources.staging import staged


def before(rows: DataFrame, group: list[str], order: list[str], n: Column, name: str, total: str = "_total") -> DataFrame:
    """Adds ``name``: the sum of ``n`` over the rows that come before in ``order`` within ``group`` (0 for the first); and ``total``, the group's.

    No window runs over a whole group: rows are dealt into ranges of group and order, summed within
    these, and only the ranges' totals, one row for each group in a range, are accumulated. Rows that
    agree in ``group`` and ``order`` are told apart by chance. Nulls are a group, and come first.
    """
    # Written once: the ranges are sampled, so a second run of this shuffle could number values otherwise.
    dealt = rows.withColumn("_n", n.cast("long")).repartitionByRange(*group, *order)
    ranged = staged(dealt.withColumn("_range", F.spark_partition_id()), "value-ranges")
    earlier = (W.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "_range").agg(F.sum("_n").alias("_t"))
    totals = totals.withColumn("_shift", F.coalesce(F.sum("_t").over(W.partitionBy(*group).orderBy("_range").rowsBetween(*earlier)), F.lit(0))).withColumn(total, F.sum("_t").over(W.partitionBy(*group)))
    shift = totals.select(F.col("_range").alias("_of"), "_shift", total, *(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)))
    inside = F.coalesce(F.sum("_n").over(W.partitionBy("_range", *group).orderBy(*order).rowsBetween(*earlier)), F.lit(0))
    same = F.col("_range") == F.col("_of")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return ranged.withColumn("_in", inside).join(shift, same).select(*rows.columns, (F.col("_shift") + F.col("_in")).alias(name), total)


def below_share(df: DataFrame, value: str, name: str = "percentile") -> DataFrame:
    """The share of all rows with a strictly smaller value: the least gets 0, none gets 1. Counted from the distinct values."""
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    share = before(counts, [], ["_v"], F.col("_c"), "_below").select("_v", (F.col("_below") / F.col("_total")).alias(name))
    return df.join(share, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def mean_rank(df: DataFrame, value: str, group: list[str], name: str) -> DataFrame:
    """Adds ranks within a group from 1, ties at their mean; counted from the distinct values. Groups may not be null."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = before(counts, group, [value], F.col("_c"), "_below").select(*group, value, (F.col("_below") + (F.col("_c") + 1) / 2).alias(name))
    return df.join(ranks, [*group, value])


def pearson(a: Column, b: Column) -> Column:
    """An aggregate: the correlation, null for fewer than two rows or without variance in either."""
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    n, sa, sb = F.count(a), F.sum(a), F.sum(b)
    top = F.sum(a * b) - sa * sb / n
    below = (F.sum(a * a) - sa * sa / n) * (F.sum(b * b) - sb * sb / n)
    return F.when((n >= 2) & ~flat & (below > 0), F.greatest(F.least(top / F.sqrt(below), F.lit(1.0)), F.lit(-1.0)))


def spearman(df: DataFrame, group: list[str], a: str, b: str, name: str = "spearman") -> DataFrame:
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, F.col(a).alias("_x"), F.col(b).alias("_y"))
    ranked = mean_rank(mean_rank(known, "_x", group, "_a"), "_y", group, "_b")
    return ranked.groupBy(*group).agg(pearson(F.col("_a"), F.col("_b")).alias(name))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n: equal widths, the last bin closed; values outside are left out; empty bins are 0."""
    place = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
