"""Cheapest bridges over classes of equal tempo and key, with a table of what must still be paid.

Items of one tempo and key have the same hops at the same costs, so a bridge is searched over
classes, each of which may be passed as often as it has members; the members are put in last, each used
once. All pairs are solved together, hop by hop. No edge is stored: a frontier's next classes
come from an equi-join on cells of log tempo, and only of cells that can still pay off. A path goes on only if
its cost and the least that its rest can cost aren't above a bridge that is already known:

- tempo: with r hops left over a folded log distance d, each hop's cost is convex in its distance, so the
  rest costs r times the cost of a hop of d / r at least;
- key: the cheapest way over the wheel in r steps at most, from the table of all keys.

The known bridge comes from a first pass that keeps the best ``BEAM`` paths of a pair in each round. The
second pass is exact. Of the paths to one class a path stays if some rest exists that it can take but none of
the cheaper ones, as they have used up a class.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import keys, tempo
from cadenza.operators import reach
from cadenza.operators.library import is_track
from cadenza.sources.staging import staged

#: Paths of a pair that the first pass keeps in a round.
BEAM = 64
#: Items between the ends at most.
LONGEST = 6
#: Cells of an octave, for the equi-join.
CELLS = 128
#: The gate as a distance of logarithms to base 2.
WIDTH = float(-np.log2(1 - tempo.GATE))
#: Rounding of sums of costs may not hide a path.
SLACK = 1e-9

_STEP = np.array([[-keys.EXPONENT * math.log(keys.COMPAT[keys.RELATIONS[a * 25 + b]]) for b in range(25)] for a in range(25)])


def key_costs(hops: int) -> np.ndarray:
    """The least that keys cost from one to another in 1 to ``hops`` hops; a table of all 25 codes."""
    exact, best = _STEP, _STEP
    for _ in range(hops - 1):
        exact = np.min(_STEP[:, :, None] + exact[None, :, :], axis=1)
        best = np.minimum(best, exact)
    return best


def _hop_bound(distance: Column) -> Column:
    """The least that tempo costs in a hop over a distance of logarithms; infinite from the gate on."""
    share = (1 - F.pow(F.lit(2.0), -F.greatest(distance, F.lit(0.0)))) / tempo.GATE
    return F.when(share < 1, -F.log1p(-share)).otherwise(float("inf"))


def _folded(distance: Column) -> Column:
    turn = F.abs(distance) - F.floor(F.abs(distance))
    return F.least(turn, 1 - turn)


def rest_bound(x: Column, code: Column, goal_x: Column, goal_code: Column, hops: int) -> Column:
    """The least that up to ``hops`` hops can cost from log tempo ``x`` and a key to a goal's."""
    table = F.get(F.array(*(F.lit(float(v)) for v in key_costs(hops).ravel())), code * 25 + goal_code)
    return (hops * _hop_bound(_folded(x - goal_x) / hops) + table) * (1 - SLACK)


def hop_cost(a: Column, a_code: Column, b: Column, b_code: Column) -> Column:
    """-ln(mixability); null beyond the gate."""
    gap = tempo.distance(a, b)
    return F.when(gap < tempo.GATE, -F.log(1 - gap / tempo.GATE) - keys.EXPONENT * F.log(keys.coded_compat(a_code, b_code)))


def classes(tracks: DataFrame, most: int) -> DataFrame:
    """bpm, code, x, cell, members (the ``most`` smallest paths), of tracks with a measured tempo."""
    rows = tracks.where(tempo.valid(F.col("bpm"))).select("path", "bpm", keys.code(F.col("key")).alias("code")).distinct()
    nth = F.row_number().over(W.partitionBy("bpm", "code").orderBy("path"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= most)
    x = F.log2("bpm")
    return few.groupBy("bpm", "code").agg(F.sort_array(F.collect_list("path")).alias("members")).select("bpm", "code", x.alias("x"), F.floor(x * CELLS).alias("cell"), "members")


def _cells(left: int) -> Column:
    """The cells that a frontier's next class may be in, if ``left`` hops follow that one: in the gate and not too dear."""
    x, goal = F.col("x"), F.col("goal_x")
    spans = [F.sequence(F.floor((x + s - WIDTH) * CELLS), F.floor((x + s + WIDTH) * CELLS)) for s in (-1, 0, 1)]

    def least(cell: Column) -> Column:
        low, high = cell / CELLS, (cell + 1) / CELLS
        # From the frontier to the nearest point of the cell, by the nearest reading; and from the cell's points to the goal.
        near = F.least(*(F.greatest(low - x - s, x + s - high, F.lit(0.0)) for s in (-1, 0, 1)))
        rest = F.greatest(_folded((low + high) / 2 - goal) - 0.5 / CELLS, F.lit(0.0))
        return _hop_bound(near) + left * _hop_bound(rest / left)

    return F.filter(F.array_distinct(F.concat(*spans)), lambda c: F.col("cost") + least(c) * (1 - SLACK) <= F.col("limit"))


def needed(used: Counter, kept: list[Counter], room: dict, rest: int) -> bool:
    """Whether up to ``rest`` more classes exist that ``used`` can take, but none of ``kept``: each of these would exceed a class's room."""

    def met(left: list[Counter], more: Counter, n: int) -> bool:
        for other in left:
            if any(other[c] + more[c] > room[c] for c in more):
                continue
            for c in other:
                missing = room[c] - other[c] + 1 - more[c]
                if missing <= n and used[c] + more[c] + missing <= room[c] and met(left, more + Counter({c: missing}), n - missing):
                    return True
            return False
        return True

    return met(kept, Counter(), rest)


FRONTIER = "start string, goal string, bpm double, code int, x double, cost double, used array<string>, rooms array<int>"


def undominated(step: DataFrame, rest: int) -> DataFrame:
    """The paths of each pair and class that some rest of up to ``rest`` classes may need, cheapest first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, kept, room = None, [], {}
        for batch in batches:
            good = []
            for start, goal, bpm, code, used, rooms in zip(*(batch[c] for c in ("start", "goal", "bpm", "code", "used", "rooms")), strict=True):
                if (start, goal, bpm, code) != group:
                    group, kept, room = (start, goal, bpm, code), [], {}
                room.update(zip(used, map(int, rooms), strict=True))
                mine = Counter(used)
                good.append(not kept or needed(mine, kept, room, rest))
                if good[-1]:
                    kept.append(mine)
            yield batch[good]

    dealt = step.select(*(f.split()[0] for f in FRONTIER.split(", "))).repartition("start", "goal", "bpm", "code")
    return dealt.sortWithinPartitions("start", "goal", "bpm", "code", "cost", F.array_join("used", "\n")).mapInPandas(run, FRONTIER)


def _search(asked: DataFrame, nodes: DataFrame, low: int, high: int, beam: int | None) -> DataFrame:
    """start, goal, cost, used: the cheapest path of each pair, as classes in order; ties to fewer, then by their names."""
    ends = asked.select("start", "goal", "goal_bpm", "goal_code", "goal_x", "limit", "taken")
    state = asked.select("start", "goal", F.col("start_bpm").alias("bpm"), F.col("start_code").alias("code"), F.col("start_x").alias("x"), F.lit(0.0).alias("cost"), F.array().cast("array<string>").alias("used"), F.array().cast("array<int>").alias("rooms"))
    name = F.concat_ws("|", F.col("n.bpm").cast("string"), F.col("n.code").cast("string"))
    found = None
    for between in range(high + 1):
        here = state.join(ends, ["start", "goal"])
        if between >= low:
            cost = F.col("cost") + hop_cost(F.col("bpm"), F.col("code"), F.col("goal_bpm"), F.col("goal_code"))
            done = here.select("start", "goal", cost.alias("cost"), "used").where("cost IS NOT NULL AND cost <= limit")
            found = done if found is None else found.unionByName(done)
        if between == high:
            break
        left = high - between  # hops that follow the next class, at most
        tried = here.withColumn("next", F.explode(_cells(left)))
        step = tried.join(nodes.alias("n"), F.col("next") == F.col("n.cell"))
        # Ends aren't members between; what a class has left is its members without them and without its own uses.
        room = F.size(F.array_except("n.members", "taken"))
        uses = F.size(F.filter("used", lambda u: u == name))
        cost = F.col("cost") + hop_cost(tried["bpm"], tried["code"], F.col("n.bpm"), F.col("n.code"))
        step = step.where(uses < room).select(
            "start", "goal", F.col("n.bpm").alias("bpm"), F.col("n.code").alias("code"), F.col("n.x").alias("x"), cost.alias("cost"),
            F.concat("used", F.array(name)).alias("used"), F.concat("rooms", F.array(room)).alias("rooms"), "goal_x", "goal_code", "limit",
        )
        least = F.col("cost") + rest_bound(F.col("x"), F.col("code"), F.col("goal_x"), F.col("goal_code"), left)
        step = step.withColumn("least", least).where((F.col("least") <= F.col("limit")) & (F.col("least") < float("inf")))
        if beam is not None:
            best = W.partitionBy("start", "goal").orderBy("least", F.array_join("used", "\n"))
            step = step.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= beam)
        kept = step.select(*state.columns)
        if beam is None and between:
            kept = undominated(kept, left - 1)
        state = staged(kept, "routes-frontier")
    order = W.partitionBy("start", "goal").orderBy(F.round("cost", 9), F.size("used"), F.array_join("used", "\n"))
    return found.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("start", "goal", "cost", "used")


def routes(pairs: DataFrame, library: DataFrame, low: int = 3, high: int = 4) -> DataFrame:
    """start, goal, found (paths from start to goal), cost, direct (cost of one hop, null beyond the gate), stop, hops, from_start, to_goal.

    ``pairs`` has start and goal. Between them stand ``low`` to ``high`` other tracks, all distinct, at the least cost. stop: found,
    same, fragment, no-tempo, disconnected (with how many tracks each end reaches), or length (``hops``: the
    fewest that would do). An item that the library doesn't have gives no row. Which of several bridges of equal cost is found isn't promised.
    """
    if not 0 <= low <= high <= LONGEST:
        raise ValueError(f"0 <= low <= high <= {LONGEST}")
    ends = library.select("path", "bpm", keys.code(F.col("key")).alias("code"), is_track(F.col("duration")).alias("track"), F.log2("bpm").alias("x"))
    a, b = ends.select(*(F.col(c).alias(f"start_{c}") for c in ends.columns)), ends.select(*(F.col(c).alias(f"goal_{c}") for c in ends.columns))
    asked = pairs.select("start", "goal").distinct().join(a, F.col("start") == F.col("start_path")).join(b, F.col("goal") == F.col("goal_path"))
    measured = tempo.valid(F.col("start_bpm")) & tempo.valid(F.col("goal_bpm"))
    stop = F.when(~F.col("start_track") | ~F.col("goal_track"), "fragment").when(F.col("start") == F.col("goal"), "same").when(~measured, "no-tempo")
    direct = hop_cost(F.col("start_bpm"), F.col("start_code"), F.col("goal_bpm"), F.col("goal_code"))
    asked = staged(asked.withColumn("direct", direct).withColumn("stop", stop).withColumn("taken", F.array("start", "goal")), "routes-pairs")
    near = staged(reach.diagnosed(asked.where("stop IS NULL").select("start", "goal"), library), "routes-reach")
    going = asked.join(near.where(F.col("hops") <= high + 1).select("start", "goal"), ["start", "goal"])
    # Enough members for every visit, and for both ends being among them.
    nodes = staged(classes(library.where(is_track(F.col("duration"))), high + 2), "routes-classes")
    first = _search(going.withColumn("limit", F.lit(float("inf"))), nodes, low, high, BEAM).select("start", "goal", (F.col("cost") + SLACK).alias("limit"))
    first = staged(first, "routes-known")
    bounded = going.join(first, ["start", "goal"], "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    best = staged(_search(bounded, nodes, low, high, None), "routes-best")
    # Members: the k-th visit of a class takes its k-th smallest path that is no end.
    visits = best.select("start", "goal", F.posexplode("used").alias("place", "name"))
    visits = visits.withColumn("k", F.row_number().over(W.partitionBy("start", "goal", "name").orderBy("place")))
    named = nodes.select(F.concat_ws("|", F.col("bpm").cast("string"), F.col("code").cast("string")).alias("name"), "members")
    chosen = visits.join(named, "name").withColumn("path", F.get(F.array_except("members", F.array("start", "goal")), F.col("k") - 1))
    chosen = chosen.groupBy("start", "goal").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("p")).select("start", "goal", F.col("p.path").alias("between"))
    out = asked.join(near, ["start", "goal"], "left").join(best.select("start", "goal", "cost"), ["start", "goal"], "left").join(chosen, ["start", "goal"], "left")
    way = F.when(F.col("cost").isNotNull(), F.concat(F.array("start"), F.coalesce("between", F.array().cast("array<string>")), F.array("goal")))
    why = F.coalesce("stop", F.when(F.col("hops").isNull(), "disconnected").when(F.col("cost").isNull(), "length").otherwise("found"))
    return out.select("start", "goal", way.alias("found"), "cost", "direct", why.alias("stop"), F.when(F.col("stop").isNull(), F.col("hops")).alias("hops"), "from_start", "to_goal")
