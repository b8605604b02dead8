"""The library of measured items: context that depends on all of it, and upkeep against a disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.stats import below_share

SHORTEST = 90.0


def is_track(duration: Column) -> Column:
    """Whether an item is long enough; unknown lengths aren't."""
    return F.coalesce((duration >= SHORTEST) & ~F.isnan(duration), F.lit(False))


def dimension_stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """place, mean, spread (population; 1 where it is 0) of each dimension."""
    each = df.select(F.posexplode(vector).alias("place", "x"))
    spread = F.stddev_pop(F.col("x").cast("double"))
    return each.groupBy("place").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.when(spread == 0, 1.0).otherwise(spread).alias("spread"))


def contextual(df: DataFrame) -> DataFrame:
    """Adds energy (the share of the library below energy_raw) and timbre (embedding, standardised by dimension, then of length 1).

    Both depend on the whole library, so filter afterwards, never before. The statistics have one
    row for each dimension and are one array here.
    """
    stats = dimension_stats(df).agg(F.array_sort(F.collect_list(F.struct("place", "mean", "spread"))).alias("stats"))
    met = below_share(df, "energy_raw", "energy").join(F.broadcast(stats))
    z = F.zip_with("embedding", "stats", lambda x, s: (x.cast("double") - s.mean) / s.spread)
    met = met.withColumn("_z", z).withColumn("_norm", F.sqrt(F.aggregate("_z", F.lit(0.0), lambda t, x: t + x * x)))
    timbre = F.when(F.col("_norm") > 0, F.transform("_z", lambda x: x / F.col("_norm"))).otherwise(F.col("_z"))
    return met.withColumn("timbre", timbre).drop("_z", "_norm", "stats")


def standardised(vectors: DataFrame, stats: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds timbre to ``vectors`` by the stored statistics of a library (``dimension_stats``), as ``contextual`` gave it to the library's own items.

    A dimension without spread is divided by 1; a vector without length stays 0. The statistics are one row for each dimension.
    """
    one = stats.agg(F.array_sort(F.collect_list(F.struct("place", "mean", "spread"))).alias("_stats"))
    met = vectors.join(F.broadcast(one))
    z = F.zip_with(vector, "_stats", lambda x, s: (x.cast("double") - s.mean) / F.when(s.spread > 0, s.spread).otherwise(1.0))
    met = met.withColumn("_z", z).withColumn("_norm", F.sqrt(F.aggregate("_z", F.lit(0.0), lambda t, x: t + x * x)))
    return met.withColumn("timbre", F.when(F.col("_norm") > 0, F.transform("_z", lambda x: x / F.col("_norm"))).otherwise(F.col("_z"))).drop("_z", "_norm", "_stats")


def restricted(context: DataFrame, wanted: DataFrame) -> DataFrame:
    """Items of a contextual library by path; the context stays that of all."""
    return context.join(wanted.select("path"), "path", "left_semi")


def unique_paths(df: DataFrame) -> DataFrame:
    """Identical rows of one path collapse; rows of one path that differ are an error."""
    same = df.groupBy("path").agg(F.min(F.struct(*df.columns)).alias("row"), F.max(F.struct(*df.columns)).alias("other"))
    checked = F.when(F.col("row") == F.col("other"), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("rows of one path differ: "), F.col("path"))))
    return same.select(checked.alias("row")).select("row.*")


def reconcile(files: DataFrame, library: DataFrame, root: str) -> DataFrame:
    """path, state: new, updated, unchanged, or deleted (only below ``root``), from mtimes."""
    f = files.select("path", F.col("mtime").alias("disk_mtime"))
    t = library.select("path", F.col("mtime").alias("known_mtime"))
    state = (
        F.when(F.col("known_mtime").isNull(), "new")
        .when(F.col("disk_mtime").isNotNull() & (F.col("disk_mtime") == F.col("known_mtime")), "unchanged")
        .when(F.col("disk_mtime").isNotNull(), "updated")
        .when(F.startswith("path", F.lit(root)), "deleted")
    )
    return f.join(t, "path", "full_outer").select("path", state.alias("state")).where("state IS NOT NULL")


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of the same key."""
    return table.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes.dropDuplicates(key), allowMissingColumns=True)
