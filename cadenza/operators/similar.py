"""Lists of similar tracks: candidates from recent albums of near artists, kept to one family, ranked by key and tempo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.text import genre_family, squeezed
from cadenza.operators.search import similar_score

ALBUMS, TRACKS, FLOOR, CAP = 2, 3, 6, 30


def recent_albums(albums: DataFrame, cutoff: str, n: int = ALBUMS) -> DataFrame:
    """The n newest albums (artist_id, album_id, released as ISO text) of each artist since ``cutoff``; ties go by id."""
    order = W.partitionBy("artist_id").orderBy(F.col("released").desc(), "album_id")
    return albums.where(F.col("released") >= cutoff).withColumn("album_place", F.row_number().over(order)).where(F.col("album_place") <= n)


def candidates(artists: DataFrame, albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """seed_id, rank and the track's columns: the first tracks of each artist's albums (from ``recent_albums``).

    ``artists`` has seed_id, seed_track, artist_id and artist_place; ``tracks`` has album_id, track_id,
    track_place, artist, title, preview. In order of artist, album and track, the first of one
    artist and title counts; the seed itself and tracks without a preview don't.
    """
    first = tracks.where(F.col("track_place") <= TRACKS)
    met = artists.join(albums, "artist_id").join(first, "album_id").where((F.col("track_id") != F.col("seed_track")) & (F.coalesce("preview", F.lit("")) != ""))
    order = ("artist_place", "album_place", "track_place", "track_id")
    same = W.partitionBy("seed_id", F.lower("artist"), squeezed(F.lower("title"))).orderBy(*order)
    once = met.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("seed_id").orderBy(*order)))


def of_family(rows: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Candidates (seed_id, family, genre) of the seed's family or without a genre; all of them, if fewer than ``floor`` are."""
    fits = F.col("genre").isNull() | (genre_family(F.col("genre")) == F.col("family"))
    enough = F.count_if(fits).over(W.partitionBy("seed_id")) >= floor
    judged = rows.withColumn("_fits", fits).withColumn("_narrow", F.coalesce(F.col("family") != "other", F.lit(False)) & enough)
    return judged.where("_fits OR NOT _narrow").drop("_fits", "_narrow")


def similar_lists(rows: DataFrame, total: int, cap: int = CAP) -> DataFrame:
    """Adds score and place: of each seed's first ``cap`` candidates the ``total`` nearest, ties in order of rank.

    ``rows`` has seed_id, rank, seed_bpm, seed_key, bpm, key and recent.
    """
    nth = F.row_number().over(W.partitionBy("seed_id").orderBy("rank"))
    few = rows.withColumn("_n", nth).where(F.col("_n") <= cap).drop("_n")
    few = few.withColumn("score", similar_score(F.col("seed_bpm"), F.col("seed_key"), F.col("bpm"), F.col("key"), F.col("recent")))
    return few.withColumn("place", F.row_number().over(W.partitionBy("seed_id").orderBy("score", "rank"))).where(F.col("place") <= total)


def in_given_order(rows: DataFrame, order: DataFrame, by: str, group: str) -> DataFrame:
    """Adds place: rows that ``order`` (group, by, wanted) names come first, in its order; the rest follow in their own (rank)."""
    named = order.groupBy(group, by).agg(F.min("wanted").alias("_wanted"))
    met = rows.join(named, [group, by], "left")
    place = F.row_number().over(W.partitionBy(group).orderBy(F.col("_wanted").isNull(), "_wanted", "rank"))
    return met.withColumn("place", place).drop("_wanted")
