"""Sessions that judge measurements by ear: passes put together, candidates, samples, resumed work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import keys
from cadenza.sources.staging import staged

#: Why a matched file isn't a candidate, in the order in which it is asked.
FUNNEL = ("no-reference", "no-agreement", "not-unanimous", "same-key", "no-key", "candidate")


def merged_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of ``first`` (path, ...) with agreement and votes of ``second``'s row of the same path, and outcome.

    The outcome is merged; repeated, if ``second`` has the path several times, as nobody knows which row
    is the file's; or unpaired. Only merged rows have an agreement. Paths are compared without white space at their ends.
    Raises ValueError if no row of ``second`` has an agreement: it is no pass by consensus.
    """
    if second.where(F.trim(F.coalesce("agreement", F.lit(""))) != "").isEmpty():
        raise ValueError("the second pass has no agreement in any row")
    path = F.trim("path")
    pairs = second.groupBy(path.alias("of")).agg(F.count(F.lit(1)).alias("times"), F.any_value("agreement").alias("agreement"), F.any_value("votes").alias("votes"))
    met = first.drop("agreement", "votes").join(pairs, path == F.col("of"), "left")
    once = F.col("times") == 1
    out = F.when(once, "merged").when(F.col("times") > 1, "repeated").otherwise("unpaired")
    return met.select(*(c for c in first.columns if c not in ("agreement", "votes")), F.when(once, F.col("agreement")).alias("agreement"), F.when(once, F.col("votes")).alias("votes"), out.alias("outcome"))


def funnelled(rows: DataFrame) -> DataFrame:
    """``rows`` of compared pairs with stage: why each is left out, or candidate."""
    stage = (
        F.when(F.col("key_exact").isNull(), FUNNEL[0]).when(F.col("unanimous").isNull(), FUNNEL[1]).when(~F.col("unanimous"), FUNNEL[2])
        .when(F.col("key_exact"), FUNNEL[3]).when(keys.classic(F.col("key_est")).isNull(), FUNNEL[4]).otherwise(FUNNEL[5])
    )
    return rows.withColumn("stage", stage)


def mode_error(a: Column, b: Column) -> Column:
    """The same tonic in another mode, by the classic names of two wheel keys; not the relative."""
    x, y = keys.classic(a), keys.classic(b)
    tonic = lambda c: F.regexp_replace(c, "m$", "")
    return F.coalesce((tonic(x) == tonic(y)) & (x.endswith("m") != y.endswith("m")), F.lit(False))


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows, those of least hash of seed and key, in order of key. The order of rows changes nothing."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")), key).limit(n).orderBy(key)


def pending(wanted: DataFrame, done: DataFrame, keys_: list[str]) -> DataFrame:
    """What a session that was cut off has yet to do: rows of ``wanted`` without one of ``done``."""
    return wanted.join(done.select(*keys_).distinct(), keys_, "left_anti")


def resumed(wanted: DataFrame, path: str, keys_: list[str], work) -> DataFrame:
    """All rows that ``work`` gives for ``wanted``, of this run and of runs before it, kept as Parquet in ``path``.

    Each run does what is pending and adds it, so a run that is cut off loses only its own part.
    """
    spark = wanted.sparkSession
    try:
        done = spark.read.parquet(path)
        left = pending(wanted, done, keys_)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        left = wanted
    work(staged(left, "session-pending")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def native_sample(at: Column, rate: int, native: int) -> Column:
    """A sample's number at another rate, rounded, in whole numbers."""
    return F.floor((at * native + rate // 2) / F.lit(rate)).cast("long")


def vote_share(votes: Column) -> Column:
    """The share of the most frequent of an array's values; null of nothing."""
    most = F.array_max(F.transform(F.array_distinct(votes), lambda v: F.size(F.filter(votes, lambda w: w == v))))
    return F.when(F.size(votes) > 0, most / F.size(votes))


def worst(rows: DataFrame, error: str, key: str, n: int) -> DataFrame:
    """The n rows of largest ``error``; ties by key."""
    return rows.where(F.col(error).isNotNull()).orderBy(F.col(error).desc(), key).limit(n)
