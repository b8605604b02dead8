"""Cue marks: summaries, order, checks, and merging marks from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.stats import before

PADS, MEMORY_LIMIT, LOOP_LIMIT = 8, 32, 32
IDENTITY = ("path", "kind", "num", "start_ms", "end_ms")


def summary(marks: DataFrame) -> DataFrame:
    """path, marks, pads (sorted), cues, memories, loops."""
    return marks.groupBy("path").agg(
        F.count(F.lit(1)).alias("marks"),
        F.sort_array(F.collect_set("num")).alias("pads"),
        *(F.count_if(F.col("kind") == k).alias(name) for k, name in (("cue", "cues"), ("memory", "memories"), ("loop", "loops"))),
    )


def ordered(marks: DataFrame) -> DataFrame:
    """Adds place: pads first by number, then by time and id."""
    return marks.withColumn("place", F.row_number().over(W.partitionBy("path").orderBy(F.col("num").isNull(), "num", "start_ms", "mark_id")))


def violations(marks: DataFrame, durations: DataFrame) -> DataFrame:
    """mark_id, rule for every rule that a mark breaks."""
    met = marks.join(durations.select("path", (F.col("duration") * 1000).alias("_ms")), "path", "left").withColumn("_shared", F.count(F.lit(1)).over(W.partitionBy("path", "num")) > 1)
    rules = {
        "kind": ~F.col("kind").isin("cue", "memory", "loop"),
        "pad-missing": (F.col("kind") == "cue") & F.col("num").isNull(),
        "pad-range": F.col("num").isNotNull() & ~F.col("num").between(0, PADS - 1),
        "pad-shared": F.col("num").isNotNull() & F.col("_shared"),
        "start": (F.col("start_ms") < 0) | (F.col("start_ms") >= F.col("_ms")),
        "end-missing": (F.col("kind") == "loop") & F.col("end_ms").isNull(),
        "end-needless": (F.col("kind") != "loop") & F.col("end_ms").isNotNull(),
        "end": (F.col("end_ms") <= F.col("start_ms")) | (F.col("end_ms") > F.col("_ms")),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return met.select("mark_id", F.explode(broken).alias("rule"))


def orphans(marks: DataFrame, library: DataFrame) -> DataFrame:
    """path, marks of items that the library no longer has."""
    return marks.join(library.select("path"), "path", "left_anti").groupBy("path").agg(F.count(F.lit(1)).alias("marks"))


def statistics(marks: DataFrame, durations: DataFrame) -> DataFrame:
    """num, n, low, middle (the upper median), high of relative positions, and how many are in the opening and the closing part."""
    met = marks.join(durations.where("duration > 0").select("path", "duration"), "path").withColumn("at", F.col("start_ms") / 1000 / F.col("duration"))
    # The upper median is the value at row n // 2, found from the counts of values: no task gets all marks of a pad.
    counts = met.groupBy("num", "at").agg(F.count(F.lit(1)).alias("_c"))
    half = F.floor(F.col("n") / 2)
    is_middle = (F.col("_below") <= half) & (half < F.col("_below") + F.col("_c"))
    return before(counts, ["num"], ["at"], F.col("_c"), "_below", "n").groupBy("num").agg(
        F.max("n").alias("n"),
        F.min("at").alias("low"),
        F.max(F.when(is_middle, F.col("at"))).alias("middle"),
        F.max("at").alias("high"),
        F.coalesce(F.sum(F.when(F.col("at") < 0.15, F.col("_c"))), F.lit(0)).alias("opening"),
        F.coalesce(F.sum(F.when(F.col("at") > 0.85, F.col("_c"))), F.lit(0)).alias("closing"),
    )


def merged(known: DataFrame, incoming: DataFrame, durations: DataFrame, overwrite: bool = False) -> DataFrame:
    """``incoming`` (path, seq, kind, num, start_ms, end_ms) with what becomes of each mark.

    outcome: outside (of the item's length), present (the same mark is there), kept (its pad is taken),
    replaces (with ``overwrite``), full (the item has as many of this kind as it may), or added.
    Marks come in order of seq: the first of equal ones counts, and a pad is taken by the first.
    """
    met = incoming.join(durations.select("path", (F.col("duration") * 1000).alias("_ms")), "path", "left")
    met = met.withColumn("outcome", F.when((F.col("start_ms") >= F.col("_ms")) | (F.col("end_ms") > F.col("_ms")), "outside"))
    k = known.select(*(F.col(c).alias(f"k_{c}") for c in IDENTITY)).distinct()
    same = (F.col("path") == F.col("k_path")) & (F.col("kind") == F.col("k_kind")) & F.col("num").eqNullSafe(F.col("k_num")) & (F.col("start_ms") == F.col("k_start_ms")) & F.col("end_ms").eqNullSafe(F.col("k_end_ms"))
    inside = F.col("outcome").isNull()
    met = met.join(k, same, "left")
    again = F.row_number().over(W.partitionBy(*IDENTITY, inside).orderBy("seq")) > 1
    met = met.withColumn("_again", again).withColumn("outcome", F.coalesce("outcome", F.when(F.col("k_path").isNotNull() | F.col("_again"), "present")))
    taken = known.where("num IS NOT NULL").select(F.col("path").alias("t_path"), F.col("num").alias("t_num")).distinct()
    met = met.join(taken, (F.col("path") == F.col("t_path")) & (F.col("num") == F.col("t_num")), "left")
    open_ = F.col("outcome").isNull()
    nth = F.row_number().over(W.partitionBy("path", "num", open_).orderBy("seq"))
    occupied = F.col("t_path").isNotNull() | (nth > 1)
    met = met.withColumn("_nth_pad", nth).withColumn("outcome", F.coalesce("outcome", F.when(F.col("num").isNotNull(), F.when(F.col("t_path").isNotNull() | (F.col("_nth_pad") > 1), "replaces" if overwrite else "kept").otherwise("added"))))
    loose = known.where("num IS NULL").groupBy(F.col("path").alias("c_path"), F.col("kind").alias("c_kind")).agg(F.count(F.lit(1)).alias("have"))
    met = met.join(loose, (F.col("path") == F.col("c_path")) & (F.col("kind") == F.col("c_kind")), "left")
    turn = F.row_number().over(W.partitionBy("path", "kind", F.col("outcome").isNull()).orderBy("seq"))
    limit = F.when(F.col("kind") == "loop", LOOP_LIMIT).otherwise(MEMORY_LIMIT)
    met = met.withColumn("_turn", turn).withColumn("outcome", F.coalesce("outcome", F.when(F.coalesce("have", F.lit(0)) + F.col("_turn") > limit, "full").otherwise("added")))
    return met.select(*incoming.columns, "outcome")
