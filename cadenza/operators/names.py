"""Which side of a file name is the artist, judged over a whole batch of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.text import counting_key, stem, versions, without_version

#: A catalogue number in front: "001 - A - T", "[ABC002] - A - T"; fixed pattern.
CATALOGUE = r"(?i)^\s*[\[\(]?\s*[A-Z]{0,6}\s*\d{2,4}\s*[\]\)]?\s*[-–—]\s+"
SEPARATOR = r"\s+[-–—]\s+"
#: What sources leave in names: pattern, what stands for it and why it goes; fixed values, one after another.
LEFTOVERS = (
    (r"(?i)\s*myfreemp3\.vip\s*", "", "download site"),
    (r"(?i)\s*\(\s*cut\s*\)\s*", " ", "cut"),
    (r"\s*\(\d+\)\s*$", "", "copy number"),
    (r"(?i)\s*\b(official|oficial)\s+(music\s+)?(video|audio)\b\s*", " ", "official video"),
    (r"(?i)\s*\bfree\s*download\b\s*", " ", "free download"),
)


def sides(files: DataFrame) -> DataFrame:
    """path, base, left, right: cut at the first spaced dash after a catalogue number; null sides without one."""
    base = stem(F.col("path"))
    parts = F.split(F.regexp_replace(base, CATALOGUE, ""), SEPARATOR, 2)
    left, right = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    good = (F.length(left) >= 2) & (F.length(right) >= 2)
    return files.select("path", base.alias("base"), F.when(good, left).alias("left"), F.when(good, right).alias("right"), (F.size(F.split(F.regexp_replace(base, CATALOGUE, ""), SEPARATOR)) > 2).alias("several"))


def tidy(text):
    """(cleaned, reasons) of a name without what sources leave in it."""
    out, found = text, []
    for pattern, instead, why in LEFTOVERS:
        found.append(F.when(out.rlike(pattern), F.lit(why)))
        out = F.regexp_replace(out, pattern, instead)
    return F.regexp_replace(F.regexp_replace(out, r"\s{2,}", " "), r"^[ \-–—_]+|[ \-–—_]+$", ""), F.array_compact(F.array(*found))


def oriented(files: DataFrame) -> DataFrame:
    """path, artist, title, orientation (direct, inverted, undivided), review, reasons.

    1. Names are counted on either side. 2. A name that stands more often on the right than its
    partner on the left, and at least twice, is an artist: inverted. 3. A version on the right that
    went with two inversions or more inverts the rest that has it. 4. Spellings of one artist become
    the most frequent (in ties one that isn't all capitals, then the first). Versions go to the title.
    """
    cut = sides(files).withColumns({"left_key": counting_key(F.col("left")), "right_key": counting_key(F.col("right")), "suffix": versions(F.col("right"))})
    rights = cut.where("right_key <> ''").groupBy(F.col("right_key").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    lefts = cut.where("left_key <> ''").groupBy(F.col("left_key").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    counted = (
        cut.join(lefts.select(F.col("name").alias("left_key"), F.col("n").alias("n_left")), "left_key", "left")
        .join(rights.select(F.col("name").alias("right_key"), F.col("n").alias("n_right")), "right_key", "left")
        .withColumns({"n_left": F.coalesce("n_left", F.lit(0)), "n_right": F.coalesce("n_right", F.lit(0))})
    )
    first = counted.withColumn("turned", (F.col("n_right") > F.col("n_left")) & (F.col("n_right") >= 2))
    evidence = first.where("turned AND suffix <> ''").groupBy("suffix").agg(F.count(F.lit(1)).alias("n_suffix"))
    second = first.join(evidence, "suffix", "left").withColumn("turned", F.coalesce(F.col("turned") | (F.col("n_suffix") >= 2), F.lit(False)))
    # A word of four letters that a repeated name on the right has too asks for a look.
    words = rights.where("n >= 2").select(F.explode(F.filter(F.split("name", " "), lambda w: F.length(w) >= 4)).alias("word")).distinct()
    mine = second.where("NOT turned AND right IS NOT NULL").select("path", F.explode(F.filter(F.split("right_key", " "), lambda w: F.length(w) >= 4)).alias("word"))
    alike = mine.join(words, "word", "left_semi").select("path").distinct().withColumn("alike", F.lit(True))
    named = second.join(alike, "path", "left")
    raw_artist = F.when(F.col("turned"), F.col("right")).otherwise(F.col("left"))
    raw_title = F.when(F.col("turned"), F.col("left")).otherwise(F.coalesce("right", "base"))
    version = versions(raw_artist)
    artist, why_a = tidy(without_version(raw_artist))
    title, why_t = tidy(F.when(version != "", F.concat(raw_title, F.lit(" ("), version, F.lit(")"))).otherwise(raw_title))
    state = F.when(F.col("left").isNull(), "undivided").when(F.col("turned"), "inverted").otherwise("direct")
    out = named.select("path", artist.alias("artist"), title.alias("title"), state.alias("orientation"), (F.coalesce("alike", F.lit(False)) | F.col("several")).alias("review"), F.array_distinct(F.concat(F.coalesce(why_a, F.array().cast("array<string>")), why_t)).alias("reasons"))
    key = counting_key(F.col("artist"))
    spelled = out.where("artist <> ''").groupBy(key.alias("_key"), F.col("artist").alias("_spelling")).agg(F.count(F.lit(1)).alias("_n"))
    best = W.partitionBy("_key").orderBy(F.col("_n").desc(), F.upper("_spelling") == F.col("_spelling"), "_spelling")
    chosen = spelled.withColumn("_place", F.row_number().over(best)).where("_place = 1").select("_key", "_spelling")
    return out.join(chosen, key == F.col("_key"), "left").withColumn("artist", F.coalesce("_spelling", "artist")).drop("_key", "_spelling")
