"""How many hops within the tempo gate lead from one item to another, by intervals instead of pairs.

The distinct tempi of the tracks are numbered in order. By each reading of the gate, the tempi that one of
them mixes with are neighbours in that order, so a tempo's partners are three ranges of numbers; and both
ends of a range only grow with the tempo. What an interval of numbers reaches is therefore known from its two ends,
except where the partners of two tempi that follow each other leave others out between them.
Such breaks are wider than the gate itself, so there are few, whatever the library's size; and so are the
intervals that a start has reached. A round is two lookups for each of them, and the
number of rounds is bounded by the span of all tempi over the gate, not by the number of items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import tempo
from cadenza.operators import stats
from cadenza.operators.library import is_track
from cadenza.sources.staging import staged


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b) / np.maximum(a, b)


def gate_ends(bpm: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest number that pass the gate with a tempo by one reading: to the last bit."""

    def settled(guess: np.ndarray, outward: float) -> np.ndarray:
        for _ in range(16):  # the guess misses by a few units in the last place at most
            inside = _apart(bpm, guess * factor) < tempo.GATE
            guess = np.where(inside, guess, np.nextafter(guess, bpm / factor))
        for _ in range(16):
            further = np.nextafter(guess, outward)
            guess = np.where(_apart(bpm, further * factor) < tempo.GATE, further, guess)
        return guess

    return settled(bpm * (1 - tempo.GATE) / factor, 0.0), settled(bpm / (1 - tempo.GATE) / factor, np.inf)


def _ends(bpm: pd.Series) -> pd.Series:
    """array of (reading, low, high) of each tempo."""
    found = [gate_ends(bpm.to_numpy(float), f) for f, _ in tempo.READINGS]
    return pd.Series([[{"reading": i, "low": float(low[k]), "high": float(high[k])} for i, (low, high) in enumerate(found)] for k in range(len(bpm))])


def ranked_tempi(library: DataFrame) -> DataFrame:
    """rank (from 0), bpm, tracks, below (tracks of lesser tempi) of the tracks' distinct tempi. Fragments and unmeasured tempi are left out."""
    tracks = library.where(is_track(F.col("duration")) & tempo.valid(F.col("bpm")))
    tempi = staged(tracks.groupBy("bpm").agg(F.count(F.lit(1)).alias("tracks")), "reach-tempi")
    ranks = stats.before(tempi, [], ["bpm"], F.lit(1), "rank").drop("_total")
    return stats.before(ranks, [], ["bpm"], F.col("tracks"), "below").select("rank", "bpm", "tracks", "below")


def partner_ranges(ranks: DataFrame) -> DataFrame:
    """rank, reading, low, high: the ranks that a tempo mixes with by each reading; none if low > high.

    Counted in one order of all tempi and all ends of gates: an end's rank is how many tempi are below it.
    """
    ends = ranks.select("rank", F.explode(F.pandas_udf(_ends, "array<struct<reading:int,low:double,high:double>>")("bpm")).alias("e")).select("rank", "e.reading", "e.low", "e.high")
    nobody = F.lit(None).cast("long")
    events = ranks.select(F.col("bpm").alias("v"), F.lit(1).alias("kind"), nobody.alias("rank"), F.lit(None).cast("int").alias("reading"))
    for kind, end in ((0, "low"), (2, "high")):  # a tempo that equals an end is inside
        events = events.unionByName(ends.select(F.col(end).alias("v"), F.lit(kind).alias("kind"), "rank", "reading"))
    counted = stats.before(events, [], ["v", "kind"], F.when(F.col("kind") == 1, 1).otherwise(0), "n").where("kind <> 1")
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("n")))
    return counted.groupBy("rank", "reading").agg(at(0).alias("low"), (at(2) - 1).alias("high"))


def breaks(ranges: DataFrame) -> list[tuple[int, int]]:
    """(reading, rank): between this rank's partners and the next one's lie tempi that neither mixes with.

    Each break spans the gate twice on the logarithm of tempo, so their number is bounded by the span of tempi, not by rows.
    """
    after = ranges.select("reading", (F.col("rank") - 1).alias("rank"), F.col("low").alias("next_low"))
    gaps = ranges.join(after, ["reading", "rank"]).where("high + 1 < next_low")
    return sorted((r.reading, r["rank"]) for r in gaps.select("reading", "rank").collect())


def _merged(intervals: DataFrame) -> DataFrame:
    """start, low, high: overlapping and adjacent intervals of a start made one, with how many ranks a start's cover."""
    before = W.partitionBy("start").orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("start").orderBy("low", "high").rowsBetween(W.unboundedPreceding, W.currentRow)
    fresh = F.when(F.max("high").over(before) + 1 >= F.col("low"), 0).otherwise(1)
    runs = intervals.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(upto))
    merged = runs.groupBy("start", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")
    return merged.withColumn("covered", F.sum(F.col("high") - F.col("low") + 1).over(W.partitionBy("start")))


def _step(state: DataFrame, ranges: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """One hop on from all intervals (start, low, high), which stay reached."""
    all_cuts = {i: [r for k, r in cuts if k == i] for i in range(len(tempo.READINGS))}
    pieces = None
    for reading, at in all_cuts.items():
        inside = F.filter(F.array(*map(F.lit, at)).cast("array<bigint>"), lambda r: (r >= F.col("low")) & (r < F.col("high")))
        starts, ends = F.concat(F.array("low"), F.transform(inside, lambda r: r + 1)), F.concat(inside, F.array("high"))
        piece = state.select("start", F.lit(reading).alias("reading"), F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("p")).select("start", "reading", "p.a", "p.b")
        pieces = piece if pieces is None else pieces.unionByName(piece)
    first = ranges.select(F.col("rank").alias("a"), "reading", F.col("low").alias("to_low"))
    last = ranges.select(F.col("rank").alias("b"), "reading", F.col("high").alias("to_high"))
    reached = pieces.join(first, ["a", "reading"]).join(last, ["b", "reading"]).where("to_low <= to_high")
    return _merged(state.select("start", "low", "high").unionByName(reached.select("start", F.col("to_low").alias("low"), F.col("to_high").alias("high"))))


def levels(ranges: DataFrame, starts: DataFrame, goals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables from ranks ``start``: (start, hops, low, high), all ranks within so many hops; and the last of these for each start.

    With ``goals`` (start, goal), a start goes on only as long as a goal of its own isn't reached.
    """
    cuts = breaks(ranges)
    state = starts.select("start", F.col("start").alias("low"), F.col("start").alias("high")).distinct().withColumn("covered", F.lit(0).cast("long"))
    hops, tables, ended = 0, [], []
    while True:
        hops += 1
        was = state.select("start", F.col("covered").alias("was")).distinct()
        moved = staged(_step(state, ranges, cuts).join(was, "start").withColumn("hops", F.lit(hops)), "reach-level")
        tables.append(moved.select("start", "hops", "low", "high"))
        going = moved.where("covered > was")
        if goals is not None:
            reached = moved.join(goals, "start").where("goal BETWEEN low AND high").select("start", "goal").distinct()
            goals = staged(goals.join(reached, ["start", "goal"], "left_anti"), "reach-goals")
            going = going.join(goals.select("start").distinct(), "start", "left_semi")
        state = staged(going.select("start", "low", "high", "covered"), "reach-state")
        ended.append(moved.join(state.select("start").distinct(), "start", "left_anti").select("start", "hops", "low", "high"))
        if state.isEmpty():
            break
    every, last = tables[0], ended[0]
    for a, b in zip(tables[1:], ended[1:], strict=True):
        every, last = every.unionByName(a), last.unionByName(b)
    return every, last


def _reached(starts: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables: (path, start), starts and their ranks; (start, rank, hops), the fewest hops to each rank; (bpm, to, rank), all tracks."""
    ranks = staged(ranked_tempi(library), "reach-ranks")
    ranges = staged(partner_ranges(ranks), "reach-ranges")
    tracks = library.where(is_track(F.col("duration"))).select("bpm", F.col("path").alias("to")).join(ranks.select("bpm", "rank"), "bpm")
    asked = starts.select("path").distinct().join(tracks, F.col("path") == F.col("to")).select("path", F.col("rank").alias("start"))
    every, _ = levels(ranges, asked)
    first = every.select("start", "hops", F.explode(F.sequence("low", "high")).alias("rank")).groupBy("start", "rank").agg(F.min("hops").alias("hops"))
    return asked, first, tracks


def hops_to_all(starts: DataFrame, library: DataFrame) -> DataFrame:
    """start, path, hops: the fewest hops from each item of ``starts`` (path) to every track it can reach, itself left out.

    Tracks between may be any of the library's. A start that is no track of the library, or has no measured tempo, reaches nothing.
    """
    asked, reached, tracks = _reached(starts, library)
    return asked.join(reached, "start").join(tracks, "rank").where("path <> to").select(F.col("path").alias("start"), F.col("to").alias("path"), "hops")


def hops_counted(starts: DataFrame, library: DataFrame) -> DataFrame:
    """start, hops, tracks, first: how many of ``hops_to_all``'s rows a start has at each number of hops, and the least path of these.

    Tracks are counted by tempo before they meet the starts, so no row is made for each start and track. A start, which is left out of
    its own count, is taken off its tempo's; where it is the least path itself, the next one stands in.
    """
    asked, reached, tracks = _reached(starts, library)
    classes = staged(tracks.groupBy("rank").agg(F.count("to").alias("n"), F.min("to").alias("least")), "reach-classes")
    own = staged(asked.select("path").distinct().join(tracks, F.col("path") == F.col("to")).groupBy("path", "rank").agg(F.count(F.lit(1)).alias("own")), "reach-own")
    led = classes.join(own, "rank").where("least = path").select("rank", "least").distinct()
    after = tracks.join(led, "rank").where("to > least").groupBy("rank").agg(F.min("to").alias("next"))
    met = asked.join(reached, "start").join(classes, "rank").join(own, ["path", "rank"], "left").join(after, "rank", "left")
    counted = met.select(F.col("path").alias("start"), "hops", (F.col("n") - F.coalesce("own", F.lit(0))).alias("tracks"), F.when(F.col("least") == F.col("path"), F.col("next")).otherwise(F.col("least")).alias("first"))
    return counted.where("tracks > 0").groupBy("start", "hops").agg(F.sum("tracks").alias("tracks"), F.min("first").alias("first"))


def diagnosed(pairs: DataFrame, library: DataFrame) -> DataFrame:
    """start, goal, hops, from_start, to_goal for pairs of tracks: the fewest hops over tracks, null if there are none.

    For pairs without a way, ``from_start`` is how many other tracks the start reaches and ``to_goal`` from how many
    the goal is reached; null for others. Items that are unknown, fragments or without a tempo give no row.
    """
    ranks = staged(ranked_tempi(library), "reach-ranks")
    ranges = staged(partner_ranges(ranks), "reach-ranges")
    tracks = library.where(is_track(F.col("duration"))).select("path", "bpm").join(ranks.select("bpm", "rank"), "bpm")
    a, b = tracks.select(F.col("path").alias("start"), F.col("rank").alias("a")), tracks.select(F.col("path").alias("goal"), F.col("rank").alias("b"))
    asked = staged(pairs.select("start", "goal").distinct().join(a, "start").join(b, "goal"), "reach-pairs")
    wanted = asked.select(F.col("a").alias("start"), F.col("b").alias("goal")).distinct()
    every, _ = levels(ranges, wanted.select("start").distinct(), wanted)
    met = every.join(wanted, "start").where("goal BETWEEN low AND high").groupBy(F.col("start").alias("a"), F.col("goal").alias("b")).agg(F.min("hops").alias("hops"))
    known = staged(asked.join(met, ["a", "b"], "left"), "reach-known")
    lost = known.where("hops IS NULL")
    _, last = levels(ranges, lost.select(F.col("a").alias("start")).unionByName(lost.select(F.col("b").alias("start"))).distinct())
    # Tracks of an interval: by the sums below its ends. The item itself is one of them.
    low, high = ranks.select(F.col("rank").alias("low"), F.col("below").alias("before")), ranks.select(F.col("rank").alias("high"), (F.col("below") + F.col("tracks")).alias("upto"))
    sizes = staged(last.join(low, "low").join(high, "high").groupBy("start").agg((F.sum(F.col("upto") - F.col("before")) - 1).alias("n")), "reach-sizes")
    n = lambda c: sizes.select(F.col("start").alias(c), F.col("n").alias(f"n_{c}"))
    out = known.join(n("a"), "a", "left").join(n("b"), "b", "left")
    gone = F.col("hops").isNull()
    return out.select("start", "goal", "hops", F.when(gone, F.col("n_a")).alias("from_start"), F.when(gone, F.col("n_b")).alias("to_goal"))
