"""Readers of what a library is fed from: XML collections, CSV, JSON decisions, directories, plists."""

from __future__ import annotations

import plistlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.keys import wheel
from cadenza.functions.text import natural, number_or

AUDIO = ("mp3", "wav", "flac", "aif", "aiff", "m4a", "ogg", "opus")
TRACK_XML = "_TrackID string, _Name string, _Artist string, _Genre string, _AverageBpm string, _Tonality string, _TotalTime string, _Kind string, _Location string, POSITION_MARK array<struct<_Name string, _Type string, _Start string, _End string, _Num string>>"


def csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as text, a byte order mark ignored."""
    return spark.read.option("header", True).option("sep", separator).option("encoding", "UTF-8").csv(path)


def collection(spark: SparkSession, path: str) -> DataFrame:
    """track_id, artist, title, bpm, key, duration, genre, location, marks of an XML collection."""
    raw = spark.read.format("xml").option("rowTag", "TRACK").schema(TRACK_XML).load(path).where("_Location IS NOT NULL")
    local = F.regexp_replace(F.regexp_replace("_Location", r"^file://(localhost)?", ""), r"^/(?=[A-Za-z]:)", "")
    # A plus stands for itself in these paths, which url_decode would take for a space.
    return raw.select(
        F.col("_TrackID").alias("track_id"), F.col("_Artist").alias("artist"), F.col("_Name").alias("title"), number_or(F.col("_AverageBpm")).alias("bpm"), wheel(F.col("_Tonality")).alias("key"),
        number_or(F.col("_TotalTime")).alias("duration"), F.col("_Genre").alias("genre"), F.try_url_decode(F.replace(local, F.lit("+"), F.lit("%2B"))).alias("location"), F.col("POSITION_MARK").alias("marks"),
    )


def collection_marks(tracks: DataFrame) -> DataFrame:
    """path, seq, kind, num, start_ms, end_ms, name of ``collection``'s marks; those without a usable type, pad or time go."""
    each = tracks.select(F.col("location").alias("path"), F.posexplode("marks").alias("seq", "m"))
    num, start, end = F.col("m._Num").try_cast("int"), F.col("m._Start").try_cast("double"), F.col("m._End").try_cast("double")
    kind = F.when(F.col("m._Type") == "4", "loop").when((F.col("m._Type") == "0") & (num >= 0), "cue").when(F.col("m._Type") == "0", "memory")
    out = each.select("path", "seq", kind.alias("kind"), F.when(num >= 0, num).alias("num"), F.bround(start * 1000).cast("long").alias("start_ms"), F.when(kind == "loop", F.bround(end * 1000).cast("long")).alias("end_ms"), F.col("m._Name").alias("name"))
    return out.where("kind IS NOT NULL AND start_ms >= 0 AND coalesce(num, 0) <= 7 AND (kind <> 'loop' OR end_ms > start_ms)")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON file that is a list, or an object with the list under "decisions"."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.inline("decisions")) if "decisions" in raw.columns else raw


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, mtime of audio files below a folder, without hidden names and downloads in progress."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.where(F.lower(name).rlike(rf"\.({'|'.join(AUDIO)})$") & ~name.rlike(r"^(\.|~\$)") & ~F.lower(name).rlike(r"\.(part|crdownload|tmp)\b"))


def folders(files: DataFrame) -> DataFrame:
    """folder, files in natural order of folders."""
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files")).orderBy(natural(F.col("folder")), "folder")


def plist_locations(blobs: DataFrame) -> DataFrame:
    """location of every track in plist libraries (column content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [t["Location"] for raw in b["content"] for t in plistlib.loads(bytes(raw)).get("Tracks", {}).values() if "Location" in t]
            yield pd.DataFrame({"location": found}, dtype="object")

    return blobs.select("content").mapInPandas(read, "location string").distinct()


def html_fields(pages: DataFrame, fields: dict[str, str]) -> DataFrame:
    """page_id and, for each field, the first group of its pattern in html."""
    return pages.select("page_id", *(F.nullif(F.regexp_extract("html", p, 1), F.lit("")).alias(n) for n, p in fields.items()))
