"""Tables of the library's shape, made from the benchmark tables by arithmetic that any engine repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(i: Column, width: int = 6) -> Column:
    """A number of at least so many digits; longer ones stay whole."""
    text = i.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def item_columns(i: Column) -> dict[str, Column]:
    """An item's fields from its number."""
    return {
        "path": F.concat(F.lit("/lib/"), padded(i)),
        "bpm": F.when(i % 97 == 0, 0.0).otherwise(60 + ((i * 7919) % 1400) / 10),
        "key": F.when(i % 19 == 0, "?").otherwise(F.concat(((i * 5) % 12 + 1).cast("string"), F.when(i % 2 == 0, "A").otherwise("B"))),
        "duration": (60 + (i * 31) % 400).cast("double"),
        "energy_raw": ((i * 104729) % 10007) / 10007,
        "artist": F.when(i % 31 == 0, None).otherwise(F.concat(F.lit("artist_"), (i % 40).cast("string"))),
        "title": F.concat(F.lit("title "), i.cast("string")),
        "agreement": F.when(i % 23 == 0, None).otherwise(F.concat((i % 4).cast("string"), F.lit("/3"))),
    }


def epoch(ts: Column) -> Column:
    """Seconds of a timestamp without a zone, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", *(c.alias(n) for n, c in item_columns(F.col("vec_id")).items()), F.col("label").alias("genre"), "embedding")


def big_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", *(c.alias(n) for n, c in item_columns(F.col("p_partkey")).items()))


def crate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a line says of its item itself: all else follows from the part (``described``)."""
    source = F.when(F.col("l_returnflag") == "A", "engine").when(F.col("l_returnflag") == "N", "collection").otherwise("web")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("crate_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("part"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("item_id"),
        (F.col("l_linestatus") == "F").alias("file_ok"), source.alias("bpm_source"),
    )


def described(lines: DataFrame) -> DataFrame:
    """Crate items from ``crate_lines``."""
    i = F.col("part")
    item = item_columns(i)
    return lines.select(
        "crate_id", "position", "part", "item_id", *(item[c].alias(c) for c in ("path", "bpm", "key", "duration", "artist", "title")), "file_ok", "bpm_source",
        F.when(i % 11 == 0, None).otherwise(F.concat(F.lit("Genre "), (i % 3).cast("string"))).alias("genre"),
        F.when(i % 13 == 0, "analysing").when(i % 17 == 0, "failed").otherwise("analysed").alias("state"),
        F.when(i % 29 == 0, None).otherwise(i).alias("engine_id"), (item["duration"] >= 90).alias("is_track"), item["path"].alias("file_key"),
    )


def crate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crate for each order, an item for each line."""
    return described(crate_lines(spark, sf_dir))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cue mark for each line; some break rules."""
    l = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "cue").when(F.col("l_returnflag") == "N", "memory").otherwise("loop")
    start = F.floor(F.col("l_extendedprice") * 10).cast("long")
    return l.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("mark_id"), item_columns(F.col("l_partkey"))["path"].alias("path"), kind.alias("kind"),
        F.when(kind == "cue", (F.floor("l_quantity") % 9).cast("int")).alias("num"), start.alias("start_ms"), F.when(kind == "loop", start + F.floor("l_quantity").cast("long") * 100 - 300).alias("end_ms"),
    )


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates and truths by file: every sixth is octave, half, triplet, other, off, right."""
    r = big_library(spark, sf_dir).withColumn("i", F.col("p_partkey"))
    ratio = F.element_at(F.array(*(F.lit(x) for x in (1.0, 2.0, 0.5, 1.5, 1.25, 1.07))), (F.col("i") % 6 + 1).cast("int"))
    return r.select("path", (F.col("bpm") * ratio).alias("bpm_est"), F.when(F.col("i") % 5 == 0, F.concat(((F.col("i") * 7) % 12 + 1).cast("string"), F.lit("A"))).otherwise(F.col("key")).alias("key_est"), "agreement", ((F.col("i") * 37) % 100 / 100).alias("confidence"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truths under other folders and in capitals; two names of each hundred are the same."""
    i = F.col("p_partkey")
    name = F.when(i % 50 == 0, "same.mp3").otherwise(F.upper(F.substring("path", 6, 6)))
    return big_library(spark, sf_dir).select(F.concat(F.lit("D:\\music\\"), name).alias("location"), F.col("bpm").alias("bpm_ref"), F.when(i % 9 == 0, None).otherwise(F.col("key")).alias("key_ref"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name for each part: artist and title, some turned round, some with versions and leftovers."""
    p, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    artist, title = F.concat(F.lit("Band "), F.char(F.lit(65) + i % 20), F.lit("x")), F.concat(F.lit("Song "), i.cast("string"))
    plain = F.when(i % 4 == 0, F.concat(title, F.lit(" - "), artist)).otherwise(F.concat(artist, F.lit(" - "), title))
    name = F.concat(F.when(i % 10 == 3, "ABC123 - ").otherwise(""), plain, F.when(i % 3 == 0, " (Original Mix)").when(i % 7 == 0, " (1)").otherwise(""))
    return p.select("p_partkey", F.concat(F.lit("/in/"), name, F.lit(".mp3")).alias("path"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results for orders: each order asks for its first part's name."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = l.join(p, F.col("l_partkey") == F.col("p_partkey"))
    source = F.element_at(F.array(*map(F.lit, ("store", "stream", "video"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), source.alias("source"))
