"""Registered queries on hops and bridges over the tempo gate, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import reach, routes
from cadenza.plans import surrogate
from cadenza.plans.oracle import BIG, LIBRARY, distance, mix

#: Tempi of two islands that no hop joins, each with octaves of its own inside: the least tempo and the tenths above it, by the item's number modulo 4.
ISLANDS = ((118, 140), (88, 120), (59, 70), (178, 200))


def islands(spark: SparkSession, sf_dir: str, large: bool) -> DataFrame:
    """number, path, bpm, key, duration: the library, or the large one, with tempi of islands, so that not every item can be reached."""
    rows = surrogate.big_library(spark, sf_dir).withColumnRenamed("p_partkey", "number") if large else surrogate.library(spark, sf_dir).withColumnRenamed("vec_id", "number")
    i = F.col("number")
    at = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in ISLANDS)), (i % 4 + 1).cast("int"))
    return rows.select("number", "path", F.when(i % 97 == 0, 0.0).otherwise(at(0) + (i * 7919) % at(1) / 10).alias("bpm"), "key", "duration")


def asked(spark: SparkSession, sf_dir: str, lib: DataFrame) -> DataFrame:
    """A start for each nation, and its region's item as the goal: items of both islands, fragments and items without a tempo among them."""
    nation = surrogate.table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 7).alias("a"), (F.col("n_regionkey") * 31).alias("b"))
    firsts = lib.groupBy((F.col("number") % 200).alias("at")).agg(F.min("path").alias("path"))
    pick = lambda end, name: firsts.select(F.col("at").alias(end), F.col("path").alias(name))
    return nation.join(pick("a", "start"), "a").join(pick("b", "goal"), "b").select("start", "goal")


def tempo_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tracks of the large library lie how many hops from each nation's item."""
    lib = surrogate.big_library(spark, sf_dir).select("path", "bpm", "duration", "p_partkey")
    starts = lib.join(surrogate.table(spark, sf_dir, "nation"), F.col("p_partkey") == F.col("n_nationkey") * 7 + 3).select("path")
    return reach.hops_counted(starts, lib.select("path", "bpm", "duration"))


def bridge_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest hops between items of two islands, or how many tracks each end reaches if there is no way."""
    lib = islands(spark, sf_dir, True)
    return reach.diagnosed(asked(spark, sf_dir, lib), lib)


def long_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest way over three or four others, its cost, or why there is none."""
    lib = islands(spark, sf_dir, False)
    out = routes.routes(asked(spark, sf_dir, lib), lib, 3, 4)
    six = lambda c: F.round(c, 6) + F.lit(0.0)
    return out.select("start", "goal", six("cost").alias("cost"), six("direct").alias("direct"), "stop", "hops", "from_start", "to_goal")


_TRACKS = "tracks AS (SELECT path, bpm, key FROM islands WHERE duration >= 90 AND bpm > 0)"
_LOWS, _WIDTHS = ([x[k] for x in ISLANDS] for k in (0, 1))
_TEMPO = f"CASE WHEN number % 97 = 0 THEN 0::DOUBLE ELSE {_LOWS}[number % 4 + 1] + ((number * 7919) % {_WIDTHS}[number % 4 + 1])::DOUBLE / 10 END"
_LARGE, _SMALL = f"{BIG}, lib AS (SELECT p_partkey AS number, * FROM big)", f"{LIBRARY}, lib AS (SELECT vec_id AS number, * FROM library)"
_ASKED = f"""islands AS (SELECT * REPLACE ({_TEMPO} AS bpm) FROM lib), firsts AS (SELECT number % 200 AS at_, min(path) AS path FROM islands GROUP BY ALL),
    asked AS (SELECT DISTINCT a.path AS start, b.path AS goal FROM nation JOIN firsts a ON a.at_ = n_nationkey * 7 JOIN firsts b ON b.at_ = n_regionkey * 31)"""
_REACH = f"""tempi AS (SELECT bpm, count(*) AS n FROM tracks GROUP BY bpm), near AS (SELECT a.bpm AS a, b.bpm AS b FROM tempi a JOIN tempi b ON {distance("a.bpm", "b.bpm")} < 0.08::DOUBLE)"""
#: Hops by tempo: each level is all that is within so many hops. These tempi span so few octaves that 14 hops reach all that can be reached.
_LEVELS = """levels AS (SELECT bpm AS origin, bpm, 0 AS h FROM origins UNION SELECT origin, near.b, h + 1 FROM levels JOIN near ON near.a = levels.bpm WHERE h < 14),
    hops AS (SELECT origin, bpm, min(h) AS h FROM levels WHERE h > 0 GROUP BY ALL)"""
_DIAGNOSED = f"""{_ASKED}, {_TRACKS}, {_REACH}, origins AS (SELECT DISTINCT t.bpm FROM asked JOIN tracks t ON t.path IN (start, goal)), {_LEVELS},
    sizes AS (SELECT origin, sum(n) - 1 AS n FROM hops JOIN tempi USING (bpm) GROUP BY origin),
    known AS (SELECT start, goal, a.bpm AS a, b.bpm AS b, a.key AS k, b.key AS n, h AS hops FROM asked JOIN tracks a ON a.path = start JOIN tracks b ON b.path = goal
        LEFT JOIN hops ON hops.origin = a.bpm AND hops.bpm = b.bpm),
    diagnosed AS (SELECT start, goal, hops, CASE WHEN hops IS NULL THEN x.n::BIGINT END AS from_start, CASE WHEN hops IS NULL THEN y.n::BIGINT END AS to_goal
        FROM known JOIN sizes x ON x.origin = a JOIN sizes y ON y.origin = b)"""
#: Both halves of a bridge: the best four first (last) items for each second (second last), joined by the hop between. Four, as three other items may be taken.
_HALVES = f"""edges AS (SELECT a.path AS x, b.path AS y, -ln({mix("a.bpm", "a.key", "b.bpm", "b.key")}) AS c FROM tracks a JOIN tracks b ON a.path <> b.path WHERE {distance("a.bpm", "b.bpm")} < 0.08::DOUBLE),
    going AS (SELECT start, goal FROM diagnosed WHERE hops <= 5 AND start <> goal),
    lefts AS (SELECT start, goal, e.x AS p1, e.y AS p2, d.c + e.c AS c FROM going JOIN edges d ON d.x = start JOIN edges e ON e.x = d.y WHERE e.y NOT IN (start, goal) AND e.x <> goal
        QUALIFY row_number() OVER (PARTITION BY start, goal, e.y ORDER BY d.c + e.c, e.x) <= 4),
    rights AS (SELECT start, goal, e.x AS p3, e.y AS p4, d.c + e.c AS c FROM going JOIN edges d ON d.y = goal JOIN edges e ON e.y = d.x WHERE e.x NOT IN (start, goal) AND e.y <> start
        QUALIFY row_number() OVER (PARTITION BY start, goal, e.x ORDER BY d.c + e.c, e.y) <= 4),
    costs AS (
        SELECT l.start, l.goal, min(l.c + e.c + r.c) AS cost FROM lefts l JOIN edges e ON e.x = l.p2 JOIN rights r ON r.start = l.start AND r.goal = l.goal AND r.p3 = e.y
        WHERE l.p1 <> r.p3 AND l.p1 <> r.p4 AND l.p2 <> r.p4 GROUP BY ALL
        UNION ALL
        SELECT l.start, l.goal, min(l.c + r.c) FROM lefts l JOIN rights r ON r.start = l.start AND r.goal = l.goal AND r.p3 = l.p2 WHERE l.p1 <> r.p4 GROUP BY ALL),
    best AS (SELECT start, goal, min(cost) AS cost FROM costs GROUP BY ALL)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"tempo_hops": tempo_hops, "bridge_reasons": bridge_reasons, "long_bridges": long_bridges}
SQL = {
    "tempo_hops": f"""WITH RECURSIVE {BIG}, tracks AS (SELECT path, bpm FROM big WHERE duration >= 90 AND bpm > 0), {_REACH},
        starts AS (SELECT path, bpm FROM big JOIN nation ON p_partkey = n_nationkey * 7 + 3 WHERE duration >= 90 AND bpm > 0), origins AS (SELECT DISTINCT bpm FROM starts), {_LEVELS}
        SELECT s.path AS start, h::INT AS hops, count(*) AS tracks, min(t.path) AS first
        FROM starts s JOIN hops ON origin = s.bpm JOIN tracks t ON t.bpm = hops.bpm WHERE t.path <> s.path GROUP BY ALL""",
    "bridge_reasons": f"WITH RECURSIVE {_LARGE}, {_DIAGNOSED} SELECT start, goal, hops::INT AS hops, from_start, to_goal FROM diagnosed",
    "long_bridges": f"""WITH RECURSIVE {_SMALL}, {_DIAGNOSED}, {_HALVES},
        ends AS (SELECT start, goal, a.bpm AS a, b.bpm AS b, a.key AS k, b.key AS n, CASE WHEN a.duration < 90 OR b.duration < 90 THEN 'fragment' WHEN start = goal THEN 'same' WHEN NOT (a.bpm > 0 AND b.bpm > 0) THEN 'no-tempo' END AS no
            FROM asked JOIN islands a ON a.path = start JOIN islands b ON b.path = goal)
        SELECT start, goal, round(cost, 6) + 0.0::DOUBLE AS cost, CASE WHEN {distance("a", "b")} < 0.08::DOUBLE THEN round(-ln({mix("a", "k", "b", "n")}), 6) + 0.0::DOUBLE END AS direct,
            coalesce(no, CASE WHEN hops IS NULL THEN 'disconnected' WHEN cost IS NULL THEN 'length' ELSE 'found' END) AS stop,
            CASE WHEN no IS NULL THEN hops::INT END AS hops, CASE WHEN no IS NULL THEN from_start END AS from_start, CASE WHEN no IS NULL THEN to_goal END AS to_goal
        FROM ends LEFT JOIN diagnosed USING (start, goal) LEFT JOIN best USING (start, goal)""",
}
