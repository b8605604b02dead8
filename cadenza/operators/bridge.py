"""Cheapest bridges: from one item to another over a given number of others.

A hop costs -ln(mixability); hops beyond the tempo gate don't exist. All pairs of ends are solved
together, hop by hop: the frontier has, for each pair and item, its paths so far, and each round joins
it with the edges. A path is dropped only if, whatever items follow, one of the cheaper paths kept has
none of them; so the result is exact. Items of one tempo and key cost the same everywhere, so of these only as many are
needed as a bridge has items, those of least path; and once a bridge is known, paths that already cost more
are dropped, as no hop costs less than nothing. Of paths over p items, with r more to follow at most, no more
than (p + r choose p) are kept so, which is 10 for each pair and item at up to ``LONGEST`` items.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import keys, tempo
from cadenza.operators.library import is_track
from cadenza.operators.neighbours import mixable_pairs
from cadenza.sources.staging import staged

LONGEST = 6
FRONTIER = "start string, goal string, at string, cost double, path array<string>"


def hop_costs_between(tracks: DataFrame, at: DataFrame, to: DataFrame) -> DataFrame:
    """from_path, to_path, cost of every hop from the ``tracks`` that ``at`` has to those of ``to``."""
    # Few rows with many partners each: dealt by number, as by their size they would all be one task's.
    some = tracks.join(at.select("path").distinct(), "path", "left_semi").repartition(tracks.sparkSession.sparkContext.defaultParallelism * 4, "path")
    pairs = mixable_pairs(some, to)
    return pairs.select("from_path", "to_path", (-F.log("mix")).alias("cost"))


def stand_ins(tracks: DataFrame, n: int) -> DataFrame:
    """The ``n`` tracks of least path of each tempo and key: another one of these could always take the place of any other track of a bridge, at the same cost.

    Paths compare as they do inside a bridge, where a line's end follows.
    """
    least = W.partitionBy("bpm", keys.code(F.col("key"))).orderBy(F.concat("path", F.lit("\n")))
    return tracks.where(tempo.valid(F.col("bpm"))).withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= n).drop("_n")


def affordable(paths: DataFrame, reached: DataFrame | None) -> DataFrame:
    """The ``paths`` that don't cost more than the cheapest bridge of their ends in ``reached``, if there is one; with ``_last``, the cost of the last hop, if it is known."""
    if reached is None:
        return paths
    known = reached.groupBy("start", "goal").agg(F.min("cost").alias("_known"))
    cost = F.col("cost") + F.col("_last") if "_last" in paths.columns else F.col("cost")
    return paths.join(known, ["start", "goal"], "left").where(F.col("_known").isNull() | (cost <= F.col("_known"))).drop("_known")


def of_use(used: frozenset, kept: list[frozenset], rest: int) -> bool:
    """Whether some ``rest`` items, none of them in ``used``, meet each of ``kept``: then only the path over ``used`` can go on by them."""

    def met(left: list[frozenset], n: int) -> bool:
        return not left or (n > 0 and any(met([s for s in left if x not in s], n - 1) for x in left[0]))

    return met([k - used for k in kept], rest)


def pruned(step: DataFrame, between: int, rest: int) -> DataFrame:
    """The paths, over ``between`` items before the last, that some ``rest`` items may need."""
    text = F.array_join("path", "\n")
    if between < 2 or rest == 0:
        # One item is avoided by the next path, so as many are needed as may follow, and one more.
        best = W.partitionBy("start", "goal", "at").orderBy("cost", text)
        return step.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= (rest + 1 if between else 1)).drop("_n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, kept = None, []
        for batch in batches:
            good = []
            for start, goal, at, path in zip(batch["start"], batch["goal"], batch["at"], batch["path"], strict=True):
                if (start, goal, at) != group:
                    group, kept = (start, goal, at), []
                used = frozenset(path[1:-1])
                good.append(of_use(used, kept, rest))
                if good[-1]:
                    kept.append(used)
            yield batch[good]

    dealt = step.select("start", "goal", "at", "cost", "path").repartition("start", "goal", "at")
    return dealt.sortWithinPartitions("start", "goal", "at", "cost", text).mapInPandas(run, FRONTIER)


def bridges(pairs: DataFrame, library: DataFrame, low: int = 3, high: int = 4) -> DataFrame:
    """start, goal, found (path array from start to goal), cost, direct (cost of one hop, null if gated), stop.

    ``pairs`` has start and goal. stop: found, same, fragment, no-tempo, or no-bridge. Between them stand
    ``low`` to ``high`` other tracks, all distinct. Ties go to fewer hops, then the smaller path.
    """
    if not 0 <= low <= high <= LONGEST:
        raise ValueError(f"0 <= low <= high <= {LONGEST}")
    tracks = library.where(is_track(F.col("duration"))).select("path", "bpm", "key")
    # Two more, as both ends may be among them.
    between = staged(stand_ins(tracks, high + 2), "bridge-tracks")
    ends = library.select("path", "bpm", keys.code(F.col("key")).alias("code"), is_track(F.col("duration")).alias("track"))
    a, b = ends.select(*(F.col(c).alias(f"start_{c}") for c in ends.columns)), ends.select(*(F.col(c).alias(f"goal_{c}") for c in ends.columns))
    asked = pairs.select("start", "goal").distinct().join(a, F.col("start") == F.col("start_path")).join(b, F.col("goal") == F.col("goal_path"))
    stop = F.when(~F.col("start_track") | ~F.col("goal_track"), "fragment").when(F.col("start") == F.col("goal"), "same").when(~(F.col("start_bpm") > 0) | ~(F.col("goal_bpm") > 0), "no-tempo")
    direct = tempo.score(F.col("start_bpm"), F.col("goal_bpm")) * F.pow(keys.coded_compat(F.col("start_code"), F.col("goal_code")), F.lit(keys.EXPONENT))
    asked = staged(asked.select("start", "goal", F.when(direct > 0, -F.log(direct)).alias("direct"), stop.alias("stop")), "bridge-pairs")

    state = asked.where("stop IS NULL").select("start", "goal", F.col("start").alias("at"), F.lit(0.0).alias("cost"), F.array("start").alias("path"))
    of_goals = tracks.join(asked.where("stop IS NULL").select(F.col("goal").alias("path")).distinct(), "path", "left_semi")
    # The last hop before a goal: all that can be, worked out from the goals.
    ends_by = staged(mixable_pairs(between, of_goals).select("from_path", "to_path", (-F.log("mix")).alias("cost")), "bridge-ends")
    reached = None
    for hop in range(1, high + 2):
        if hop > low:
            into = ends_by if hop > 1 else hop_costs_between(tracks, state.select(F.col("at").alias("path")), of_goals)
            end = state.join(into, (F.col("at") == F.col("from_path")) & (F.col("goal") == F.col("to_path"))).select("start", "goal", (state["cost"] + into["cost"]).alias("cost"), F.concat("path", F.array("goal")).alias("path"))
            end = staged(end, "bridge-reached")
            reached = end if reached is None else reached.unionByName(end)
        if hop == high + 1:
            break
        if reached is not None:
            state = staged(affordable(state, reached), "bridge-frontier")
        # The last item stands next to a goal.
        able = between if hop < high else between.join(ends_by.select(F.col("from_path").alias("path")).distinct(), "path", "left_semi")
        edges = hop_costs_between(tracks, state.select(F.col("at").alias("path")), able)
        step = state.join(edges, F.col("at") == F.col("from_path")).where(~F.array_contains("path", F.col("to_path")) & (F.col("to_path") != F.col("goal")))
        step = step.select("start", "goal", F.col("to_path").alias("at"), (state["cost"] + edges["cost"]).alias("cost"), F.concat("path", F.array("to_path")).alias("path"))
        if hop == high:
            # With the last hop a path's whole cost is known.
            last = ends_by.select(F.col("from_path").alias("at"), F.col("to_path").alias("goal"), F.col("cost").alias("_last"))
            step = step.join(last, ["at", "goal"])
        step = affordable(step, reached).select("start", "goal", "at", "cost", "path")
        state = staged(pruned(step, hop - 1, high - hop), "bridge-frontier")
    best = W.partitionBy("start", "goal").orderBy("cost", F.size("path"), F.array_join("path", "\n"))
    chosen = reached.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumnRenamed("path", "found")
    out = asked.join(chosen, ["start", "goal"], "left")
    return out.select("start", "goal", "found", "cost", "direct", F.coalesce("stop", F.when(F.col("found").isNull(), "no-bridge"), F.lit("found")).alias("stop"))
