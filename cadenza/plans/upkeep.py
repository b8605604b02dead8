"""Registered queries on the upkeep of libraries: edits of crates, tags, reviews, exports, similar lists, older layouts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators import edits, migrations, review, similar, tags
from cadenza.plans import surrogate
from cadenza.sources.staging import staged

#: Tasks that sort whole crates: what one holds shrinks with their number, and adaptive execution would put small ones together.
CRATE_PARTS = 400

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, one for each crate and item: of repeated ones the one without a file. They meet by crate, as what follows does, and carry no texts."""
    nth = F.row_number().over(W.partitionBy("crate_id", "item_id").orderBy("file_ok", "bpm_source"))
    return surrogate.crate_lines(spark, sf_dir).repartition("crate_id").withColumn("_n", nth).where("_n = 1").drop("_n")


def ordered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crate items, one for each crate and item."""
    return surrogate.described(ordered_lines(spark, sf_dir))


def _stored(rows: DataFrame) -> DataFrame:
    """Items as they are stored: a path only if the file is there."""
    none = F.lit(None).cast("string")
    length = F.when(F.col("part") % 10 != 0, F.col("duration"))
    return rows.select("crate_id", "item_id", "position", "part", F.when(F.col("file_ok"), F.col("path")).alias("path"), none.alias("format"), none.alias("grade"), length.alias("duration"), "genre", F.lit(False).alias("genre_edited"), _named(F.col("title"), F.col("artist")).alias("name_id"))


def _named(title: Column, artist: Column) -> Column:
    return edits.name_identity(F.lit("store"), F.lit(""), title, artist)


@query
def crate_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New crates from every third item; those that ask for an item which isn't there fail as a whole."""
    items = ordered_items(spark, sf_dir).select("crate_id", "item_id", "position", "path")
    wrong = F.when((F.col("crate_id") % 50 == 0) & (F.col("item_id") % 7 == 0), 1_000_000_000).otherwise(0)
    wanted = items.where("item_id % 3 = 0").select((F.col("crate_id") % 500).alias("new_crate"), "crate_id", (F.col("item_id") + wrong).alias("item_id"), F.col("item_id").alias("place"))
    return edits.copied(items, wanted).select("crate_id", "item_id", F.col("position").cast("long").alias("position"))


@query
def crate_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What adding each crate's items, or the parts after them, does."""
    # Read four times: written once, as numbers.
    stored = _stored(surrogate.described(staged(ordered_lines(spark, sf_dir), "crate-lines")))
    new = stored.select("crate_id", F.col("item_id").alias("seq"), (F.col("part") + F.col("item_id") % 2).alias("n"))
    c = surrogate.item_columns(F.col("n"))
    incoming = new.select("crate_id", "seq", F.when(F.col("n") % 4 != 0, F.upper(c["path"])).alias("path"), _named(c["title"], c["artist"]).alias("name_id"))
    decided = staged(edits.outcomes(stored, incoming).where("outcome <> 'known'").select("crate_id", "seq", "path", "outcome", "item_id"), "crate-outcomes")
    after = edits.added(stored, decided, F.col("seq") + 1_000_000_000)
    return after.select("crate_id", "item_id", F.col("position").cast("long").alias("position"), "path")


@query
def crate_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crates after files came, every fifth item went to the front, and those without a genre got one."""
    stored = _stored(ordered_items(spark, sf_dir))
    missing = stored.where("path IS NULL AND part % 3 = 0")
    files = missing.select("crate_id", "item_id", F.concat(F.lit("/got/"), F.col("part").cast("string"), F.lit(".mp3")).alias("path"), F.lit("mp3").alias("format"), F.lit("A").alias("grade"), (F.col("part") % 200 + 0.5).alias("seconds"))
    order = stored.where("item_id % 5 = 0").select("crate_id", "item_id", F.lit(0).alias("place"))
    genres = stored.where("crate_id % 2 = 0").select("crate_id", F.lit(" Deep \t House").alias("genre")).distinct()
    out = edits.genre_filled(edits.reordered(edits.downloaded(stored, files), order), genres)
    return out.select("crate_id", "item_id", "position", "path", "format", "grade", "duration", "genre", "genre_edited")


@query
def tag_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing or junk in the tags of a file for each part, and who wrote its key."""
    p, i = surrogate.table(spark, sf_dir, "part"), F.col("p_partkey")
    pair = lambda when, k, v: F.when(when, F.struct((F.lit(k) if isinstance(k, str) else k).alias("key"), (F.lit(v) if isinstance(v, str) else v).alias("value")))
    title = F.when(i % 5 == 1, F.concat("p_name", F.lit(" official video"))).when(i % 5 == 2, F.concat("p_brand", F.lit(" - "), "p_name")).otherwise(F.col("p_name"))
    m = i % 7
    entries = F.array(
        pair(i % 4 != 0, F.element_at(F.array(*map(F.lit, ("TPE1", "ARTIST", "©ART"))), (i % 3 + 1).cast("int")), F.col("p_brand")), pair(i % 5 != 0, "TIT2", title), pair(i % 2 != 0, "TCON", "Techno"), pair(i % 3 == 0, "TBPM", "120"),
        pair(m != 0, "TKEY", F.when(m == 4, "Am").when(m == 5, "nothing").otherwise("8A")), pair(m == 2, "TXXX:SERATO_PLAYCOUNT", "1"), pair(m == 3, "COMM::eng", "8A - Energy 7"), pair(m == 6, "COMM::eng", "Cadenza: 8A"),
    )
    path = F.concat(F.lit("/in/"), "p_brand", F.lit(" - "), "p_name", F.when(i % 6 == 0, " (1)").otherwise(""), F.lit(".mp3"))
    files = p.select(path.alias("path"), F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("raw"))
    return tags.audit(tags.diagnosed(files)).select("name", "n", F.round("percent", 6).alias("percent"))


@query
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States and reasons of the large library as new files."""
    i = F.col("p_partkey")
    lib = surrogate.big_library(spark, sf_dir)
    rows = lib.select(F.when(i % 8 == 0, "suspicious").otherwise("ok").alias("flag"), F.when(i % 9 == 0, i).otherwise(0).alias("group"), "artist", F.when(i % 14 == 0, " ").otherwise(F.col("title")).alias("title"), "duration")
    return review.report_counts(review.reviewed(rows))


@query
def doubt_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on keys in doubt, behind what a comment says already, and how the parts voted."""
    i = F.col("p_partkey")
    vote = F.when(i % 8 == 7, "1A").otherwise(F.col("key"))
    votes = F.when(i % 23 == 0, "").otherwise(F.concat_ws("|", vote, vote, F.when(i % 4 == 3, vote).otherwise("2B")))
    lib, note = surrogate.big_library(spark, sf_dir), review.doubt_note(F.col("agreement"), i % 29 != 0)
    return lib.select("path", review.comment_with(F.when(i % 3 == 0, " mine "), note).alias("comment"), review.agreement_group(votes, F.col("key"), F.col("agreement")).alias("votes"))


@query
def applied_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on the large library's items: copied, missing, or left out by state."""
    i = F.col("p_partkey")
    lib = surrogate.big_library(spark, sf_dir)
    decisions = lib.select("path", F.when(i % 10 == 0, "discarded").when(i % 10 == 1, "pending").otherwise("approved").alias("state"))
    copied, left = review.applied(decisions, lib.where(i % 13 != 0))
    return copied.groupBy(F.col("outcome").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(left.select(F.col("state").alias("what"), "n"))


@query
def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crates as collections: entries, items that go in or not, and marks."""
    i = F.col("p_partkey")
    lib = surrogate.big_library(spark, sf_dir).where(i % 5 != 0).select("path", (i % 6 != 0).alias("current"))
    return review.export_totals(review.export_status(ordered_items(spark, sf_dir), lib, surrogate.marks(spark, sf_dir), CRATE_PARTS))


@query
def similar_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's list of similar lines, from recent orders of all its customers."""
    t = lambda n: surrogate.table(spark, sf_dir, n)
    nth = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey"))
    artists = t("customer").select(F.col("c_nationkey").cast("long").alias("seed_id"), (F.col("c_nationkey") * 10).cast("long").alias("seed_track"), F.col("c_custkey").alias("artist_id"), nth.alias("artist_place"))
    albums = t("orders").select(F.col("o_custkey").alias("artist_id"), F.col("o_orderkey").alias("album_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("released"))
    rows = ordered_items(spark, sf_dir)
    i = F.col("part")
    tracks = rows.select(F.col("crate_id").alias("album_id"), F.col("item_id").alias("track_id"), F.col("position").alias("track_place"), F.concat(F.lit("artist "), (i % 40).cast("string")).alias("artist"), F.concat(F.lit("Title  "), (i % 300).cast("string")).alias("title"), F.when(i % 9 != 0, "x").alias("preview"), F.when(i % 4 == 0, "House").when(i % 4 == 1, "Rock").when(i % 4 == 2, "Deep House").alias("genre"), "bpm", "key")
    found = similar.candidates(artists, similar.recent_albums(albums, "1996-06-01"), tracks).withColumn("family", F.lit("electronic"))
    seeds = {"seed_bpm": 100.0 + F.col("seed_id"), "seed_key": F.lit("8A"), "recent": F.col("album_place") == 1}
    out = similar.similar_lists(similar.of_family(found).withColumns(seeds), 25)
    return out.select("seed_id", F.col("place").cast("long").alias("place"), "track_id", F.round("score", 6).alias("score"))


@query
def migrated_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library of the oldest layout, every third path also in capitals, in the newest."""
    i = F.col("p_partkey")
    lib = surrogate.big_library(spark, sf_dir)
    old = lib.select("path", (i % 7 - 1).cast("double").alias("rms"), (i % 11).alias("analysed_at")).unionByName(lib.where(i % 3 == 0).select(F.upper("path").alias("path"), F.lit(5.0).alias("rms"), (i % 13).alias("analysed_at")))
    return migrations.migrated(old, 0).select("path_key", "path", "rms", "analysed_at", "agreement")


@query
def rebuilt_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many marks stay when their table is rebuilt with today's rules, and which rule the others break."""
    kept, lost = migrations.rebuilt_marks(surrogate.marks(spark, sf_dir))
    count = F.count(F.lit(1)).alias("marks")
    return kept.select(F.lit("kept").alias("rule")).groupBy("rule").agg(count).unionByName(lost.groupBy("rule").agg(count))


@query
def cache_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a cache with an entry for each part, what is kept of at most 1,000."""
    i = F.col("p_partkey")
    return migrations.cache_kept(surrogate.big_library(spark, sf_dir).select("path", (i * 37 % 500).alias("mtime")), 1_000)
