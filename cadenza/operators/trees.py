"""Playlist trees out of collections: folders by path, entries joined to tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.staging import staged

#: Rounds of ``routes``; each doubles the depth that is reached.
ROUNDS = 24


def routes(nodes: DataFrame, between: str = " / ") -> DataFrame:
    """node, route: the names from the root to each node of ``nodes`` (node, parent, name).

    A node without a parent, or whose parent isn't there, is a root. Every round each node takes over
    what its current ancestor has reached, so the rounds are the logarithm of the depth. Raises
    ValueError if a node is its own ancestor.
    """
    there = nodes.select(F.col("node").alias("known"))
    up = nodes.join(there, F.col("parent") == F.col("known"), "left").select("node", F.col("known").alias("up"), F.col("name").alias("route"))
    for _ in range(ROUNDS):
        up = staged(up, "tree-routes")
        if up.where("up IS NOT NULL").isEmpty():
            return up.select("node", "route")
        above = up.select(F.col("node").alias("at"), F.col("up").alias("next"), F.col("route").alias("before"))
        met = up.join(above, F.col("up") == F.col("at"), "left")
        up = met.select("node", F.col("next").alias("up"), F.when(F.col("at").isNull(), F.col("route")).otherwise(F.concat("before", F.lit(between), "route")).alias("route"))
    raise ValueError("a folder lies inside itself")


def entries(listed: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows of ``listed`` (node, place, by_location, key) with track_id of ``tracks`` (track_id, location).

    By number, or by location whatever its case: of several tracks at one location the least number. A
    location that no track has becomes a track of its own, ``loc:`` and the location. Others have null.
    """
    key = F.trim("key")
    ids = tracks.select(F.col("track_id").alias("id")).distinct()
    places = tracks.where("location <> ''").groupBy(F.lower("location").alias("where")).agg(F.min("track_id").alias("at_where"))
    met = listed.join(ids, ~F.col("by_location") & (key == F.col("id")), "left").join(places, F.col("by_location") & (F.lower(key) == F.col("where")), "left")
    own = F.when(F.col("by_location") & (key != ""), F.concat(F.lit("loc:"), key))
    return met.select(*listed.columns, F.coalesce("id", "at_where", own).alias("track_id"))


def summary(found: DataFrame, states: DataFrame) -> DataFrame:
    """node, total, found, ambiguous, missing, unknown of ``entries``' rows; ``states`` has track_id and state of its file."""
    met = found.join(states.select(F.col("track_id").alias("of"), "state"), F.col("track_id") == F.col("of"), "left")
    state = F.coalesce("state", F.lit("missing"))
    count = lambda s: F.count_if(F.col("track_id").isNotNull() & (state == s))
    return met.groupBy("node").agg(F.count("track_id").alias("total"), count("ok").alias("found"), count("ambiguous").alias("ambiguous"), count("missing").alias("missing"), F.count_if(F.col("track_id").isNull()).alias("unknown"))
