"""Older layouts of the library's tables, brought up to date step by step, and what a cache keeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ("rms", "onset_rate", "percussive_ratio")
KINDS = ("cue", "memory", "loop")


def unknown_measures(tracks: DataFrame) -> DataFrame:
    """1: measures may be unknown; negative ones stood for that."""
    return tracks.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in MEASURES if c in tracks.columns})


def one_row_for_each_path(tracks: DataFrame) -> DataFrame:
    """2: paths that differ in case only are one; the row analysed last stays, ties by path."""
    keyed = tracks.withColumn("path_key", F.lower(F.replace("path", F.lit("\\"), F.lit("/"))))
    rest = [c for c in keyed.columns if c != "path_key"]
    last = keyed.groupBy("path_key").agg(F.max_by(F.struct(*rest), F.struct("analysed_at", "path")).alias("row"))
    return last.select("row.*", "path_key")


def votes_of_keys(tracks: DataFrame) -> DataFrame:
    """3: how far the parts of a track agree on its key; unknown for what is there."""
    missing = [c for c in ("agreement", "votes") if c not in tracks.columns]
    return tracks.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else tracks


STEPS: tuple[Callable[[DataFrame], DataFrame], ...] = (unknown_measures, one_row_for_each_path, votes_of_keys)


def migrated(tracks: DataFrame, version: int) -> DataFrame:
    """A tracks table of layout ``version`` (0 is the oldest) in the newest layout. A later version than known is an error."""
    if not 0 <= version <= len(STEPS):
        raise ValueError(f"layout {version} is not known; the newest is {len(STEPS)}")
    for step in STEPS[version:]:
        tracks = step(tracks)
    return tracks


def rebuilt_marks(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks that keep today's rules, ids unchanged, and those that don't, with the rule: a table that is rebuilt loses none unseen."""
    pad, end = F.col("num").isNotNull(), F.col("end_ms").isNotNull()
    rule = (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind")
        .when(pad & ~F.col("num").between(0, 7), "pad-range")
        .when(F.coalesce("start_ms", F.lit(-1)) < 0, "start")
        .when((F.col("kind") == "cue") & ~pad, "cue-without-pad")
        .when((F.col("kind") == "memory") & (pad | end), "memory-with-more")
        .when((F.col("kind") == "loop") != end, "end-and-loop")
        .when(end & (F.col("end_ms") <= F.col("start_ms")), "end-before-start")
    )
    judged = marks.withColumn("rule", rule)
    return judged.where("rule IS NULL").drop("rule"), judged.where("rule IS NOT NULL")


def next_id(marks: DataFrame, counter: int = 0) -> DataFrame:
    """next_id: past all ids that were ever given, also those of deleted marks, which ``counter`` remembers."""
    return marks.agg((F.greatest(F.coalesce(F.max("mark_id"), F.lit(0)), F.lit(counter)) + 1).alias("next_id"))


def cache_kept(entries: DataFrame, cap: int) -> DataFrame:
    """Entries (path, mtime) that stay: all up to ``cap``; beyond, the newest nine tenths of it, ties by path."""
    newest = entries.orderBy(F.col("mtime").desc(), "path").limit(cap * 9 // 10)
    n = entries.agg(F.count(F.lit(1)).alias("_n"))
    all_of_few = entries.join(F.broadcast(n)).where(F.col("_n") <= cap).drop("_n")
    return all_of_few.unionByName(newest.join(F.broadcast(n)).where(F.col("_n") > cap).drop("_n"))
