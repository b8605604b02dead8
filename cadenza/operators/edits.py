"""Edits of crates, for many crates at once. Each gives the whole table back; rows are never changed in place.

Crates have crate_id, name, origin, origin_ref, active; items have crate_id, item_id, position and
their fields, with (crate_id, item_id) as key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.text import cleaned, genre_key

LONGEST_GENRE = 60


def name_identity(source: Column, url: Column, title: Column, artist: Column) -> Column:
    """What makes two items one when neither has a file: where from, address, title, artist, in lower case."""
    return F.lower(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (source, url, title, artist))))


def genre_to_store(genre: Column) -> Column:
    """A genre as it is stored: cleaned, not too long; null if there is none."""
    return F.when(genre_key(genre).isNotNull(), F.trim(F.substring(cleaned(genre), 1, LONGEST_GENRE)))


def copied(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """New crates from chosen items: ``wanted`` has new_crate, crate_id, item_id and place. All of a crate or none of it.

    A crate that asks for an item which isn't there is left out. Positions are 1, 2, ... by place.
    """
    broken = wanted.join(items.select("crate_id", "item_id"), ["crate_id", "item_id"], "left_anti").select("new_crate").distinct()
    whole = wanted.join(broken, "new_crate", "left_anti")
    met = whole.join(items.drop("position"), ["crate_id", "item_id"])
    position = F.row_number().over(W.partitionBy("new_crate").orderBy("place", "item_id"))
    return met.withColumn("position", position).drop("crate_id", "place").withColumnRenamed("new_crate", "crate_id")


def outcomes(items: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` (crate_id, seq, path and name_id) with outcome and item_id: what adding each item to its crate does.

    An item with a file is known by its file, whatever the case of its path. Otherwise one of the same
    identity counts: it is known, or completed if it has no file and the new one has. An equal name with
    another file is another item. Items that come together are held against the stored ones; of those
    with one file, or with one identity and no file, the first is added.
    """
    # Stored and new items stand together by crate, so that what they share is seen without joins: one shuffle for all.
    rest = [c for c in incoming.columns if c not in ("crate_id", "name_id", "path")]
    here = items.select("crate_id", "name_id", "path", F.struct("position", "item_id", F.col("path").isNotNull().alias("filed")).alias("_item"))
    both = here.unionByName(incoming.select("crate_id", "name_id", "path", *rest).withColumn("_new", F.lit(True)), allowMissingColumns=True).repartition("crate_id")
    both = both.withColumn("file_id", F.lower("path"))
    known = lambda c: F.col("crate_id").isNotNull() & F.col(c).isNotNull()
    met = both.withColumn("by_file", F.when(known("file_id"), F.min("_item.item_id").over(W.partitionBy("crate_id", "file_id"))))
    met = met.withColumn("by_name", F.when(known("name_id"), F.min("_item").over(W.partitionBy("crate_id", "name_id")))).where("_new")
    has = F.col("path").isNotNull()
    stored = F.when(F.col("by_file").isNotNull(), F.struct(F.lit("known").alias("outcome"), F.col("by_file").alias("item_id"))).when(
        F.col("by_name").isNotNull() & ~(has & F.col("by_name.filed")), F.struct(F.when(has, "completed").otherwise("known").alias("outcome"), F.col("by_name.item_id").alias("item_id"))
    )
    met = met.withColumn("stored", stored)
    same = F.coalesce("file_id", F.concat(F.lit("|"), F.col("name_id")))
    nth = F.row_number().over(W.partitionBy("crate_id", F.col("stored").isNull(), same).orderBy("seq"))
    outcome = F.coalesce("stored.outcome", F.when(nth == 1, "added").otherwise("known"))
    return met.select(*incoming.columns, outcome.alias("outcome"), F.col("stored.item_id").alias("item_id"))


def added(items: DataFrame, decided: DataFrame, new_id: Column) -> DataFrame:
    """Items after ``outcomes``: completed ones have a file, added ones follow the last position of their crate. ``new_id`` names these."""
    files = decided.where("outcome = 'completed'").groupBy("crate_id", "item_id").agg(F.min_by("path", "seq").alias("_path"))
    kept = items.join(files, ["crate_id", "item_id"], "left").withColumn("path", F.coalesce("path", "_path")).drop("_path")
    last = items.groupBy("crate_id").agg(F.max("position").alias("_last"))
    place = F.coalesce("_last", F.lit(0)) + F.row_number().over(W.partitionBy("crate_id").orderBy("seq"))
    new = decided.where("outcome = 'added'").withColumn("item_id", new_id).join(last, "crate_id", "left").withColumn("position", place)
    return kept.unionByName(new.select(*(c for c in items.columns if c in new.columns)), allowMissingColumns=True)


def downloaded(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items with the files (crate_id, item_id, path, format, grade, seconds) that came for them; a known length stays."""
    new = files.select("crate_id", "item_id", *(F.col(c).alias(f"_{c}") for c in ("path", "format", "grade", "seconds")), F.lit(True).alias("_new"))
    met = items.join(new, ["crate_id", "item_id"], "left")
    take = {c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("path", "format", "grade")}
    take["duration"] = F.when(F.col("_new") & (F.coalesce("duration", F.lit(0)) == 0), F.bround("_seconds").cast("double")).otherwise(F.col("duration"))
    return met.select(*(take[c].alias(c) if c in take else F.col(c) for c in items.columns))


def reordered(items: DataFrame, order: DataFrame) -> DataFrame:
    """Items with the places that ``order`` (crate_id, item_id, place) gives them; the others keep their own."""
    met = items.join(order.select("crate_id", "item_id", "place"), ["crate_id", "item_id"], "left")
    return met.select(*(F.coalesce("place", "position").alias(c) if c == "position" else F.col(c) for c in items.columns))


def genre_filled(items: DataFrame, genres: DataFrame) -> DataFrame:
    """Items without a genre get that of their crate (crate_id, genre) and count as edited by hand."""
    met = items.join(genres.select("crate_id", genre_to_store(F.col("genre")).alias("_genre")), "crate_id", "left")
    none = genre_to_store(F.col("genre")).isNull() & F.col("_genre").isNotNull()
    take = {"genre": F.when(none, F.col("_genre")).otherwise(F.col("genre")), "genre_edited": none | F.col("genre_edited")}
    return met.select(*(take[c].alias(c) if c in take else F.col(c) for c in items.columns))


def activated(crates: DataFrame, crate_id: int) -> DataFrame:
    """Exactly the named crate is active."""
    return crates.withColumn("active", F.col("crate_id") == crate_id)


def imported(crates: DataFrame) -> DataFrame:
    """origin, origin_ref, crate_id: the first crate of each import."""
    return crates.where("origin IS NOT NULL AND origin_ref IS NOT NULL").groupBy("origin", "origin_ref").agg(F.min("crate_id").alias("crate_id"))


def newest(history: DataFrame, n: int) -> DataFrame:
    """The n rows of each kind with the highest ids: what a history page shows."""
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.col("id").desc()))
    return history.withColumn("place", place).where(F.col("place") <= n)
