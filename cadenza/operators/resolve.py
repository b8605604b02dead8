"""Finding files by the paths that another machine wrote down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.text import basename
from cadenza.sources.staging import staged


def _tails(path):
    """(length, tail) of every tail of a path that has a folder and a name, in lower case."""
    parts = F.filter(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda p: (p != "") & (p != "."))
    n = F.size(parts)
    sizes = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(sizes, lambda k: F.struct(k.alias("size"), F.array_join(F.slice(parts, n - k + 1, k), "/").alias("tail")))


#: The size of the whole path, which goes before all tails.
WHOLE = 10**6


def _keys(path, with_folders):
    """(size, tail) of all that a path is found by: itself, its tails if it may be, its name."""
    name = F.lower(basename(path))
    tails = F.when(with_folders, _tails(path)).otherwise(F.array().cast("array<struct<size:int,tail:string>>"))
    return F.concat(
        F.array(F.struct(F.lit(WHOLE).alias("size"), path.alias("tail"))), tails, F.when(name == "", F.array().cast("array<struct<size:int,tail:string>>")).otherwise(F.array(F.struct(F.lit(1).alias("size"), name.alias("tail"))))
    )


def resolved(locations: DataFrame, files: DataFrame) -> DataFrame:
    """location, state (ok, ambiguous, not-found), path, step (exact, tail, name): where a written-down path is now.

    In this order: the path itself; the longest tail of folders and name that a file ends in; the name
    alone. Several files at the step that decides are ambiguous: none is picked. Locations and files of one key stand in one window that
    knows its least and greatest file, so no row is made for each pair of them, however common a name is.
    """
    wanted = locations.select("location").where("location IS NOT NULL").distinct()
    have = files.select("path").where("path IS NOT NULL").distinct()
    none = F.lit(None).cast("string")
    asks = wanted.select("location", none.alias("path"), F.inline(_keys(F.col("location"), ~F.contains("location", F.lit("..")))))
    gives = have.select(none.alias("location"), "path", F.inline(_keys(F.col("path"), F.lit(True))))
    alike, own = W.partitionBy("size", "tail"), W.partitionBy("location")
    seen = asks.unionByName(gives).withColumns({"low": F.min("path").over(alike), "high": F.max("path").over(alike)})
    # Every location has a row for its whole path, which stays if nothing is found.
    met = seen.where(F.col("location").isNotNull() & (F.col("low").isNotNull() | (F.col("size") == WHOLE)))
    met = met.select("location", "size", F.col("low").isNotNull().alias("found"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("path"))
    best = F.col("best")
    out = met.withColumn("best", F.max(F.when(F.col("found"), F.col("size"))).over(own)).where(F.col("size") == F.coalesce(best, F.lit(WHOLE)))
    step = F.when(best == WHOLE, "exact").when(best > 1, "tail").when(best == 1, "name")
    return out.select("location", F.when(best.isNull(), "not-found").when(F.col("path").isNotNull(), "ok").otherwise("ambiguous").alias("state"), "path", step.alias("step"))


def caseless(text):
    """Text as it is compared by ``typed``: small letters, sharp s as two, one sigma."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ς", "σ")


#: Letters of a gram, at most. A longer one is rarer: of numbers of six digits, three digits leave many, eight letters few.
GRAM = 8


def _grams(text, sizes):
    """The distinct runs of a text that have a length of the array ``sizes``."""
    n = F.length(text)
    cut = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, k))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(sizes, cut)))


def met(texts: DataFrame, shown: DataFrame) -> DataFrame:
    """text, path: the items of ``shown`` (path, name, label) that have a text's rarest gram, which every item that holds the text has.

    Only runs of lengths that texts ask for are posted, ``GRAM`` at most. Estimates of an explode's size are those of what is exploded, so the joins are told to merge:
    no posting may be sent whole to the driver.
    """
    length = F.least(F.length("text"), F.lit(GRAM))
    # At most GRAM numbers.
    sizes = texts.agg(F.array_sort(F.collect_set(length)).alias("sizes"))
    posted = shown.crossJoin(F.broadcast(sizes)).select("path", F.explode(F.array_union(_grams(F.col("name"), F.col("sizes")), _grams(F.col("label"), F.col("sizes")))).alias("gram"))
    wanted = texts.withColumn("gram", F.explode(_grams(F.col("text"), F.array(length))))
    posted = staged(posted.join(wanted.select("gram").distinct().hint("merge"), "gram", "left_semi"), "grams-posted")
    counts = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("items"))
    found = wanted.join(counts.hint("merge"), "gram", "left")
    rarest = found.groupBy("text").agg(F.min(F.struct(F.coalesce("items", F.lit(0)).alias("items"), "gram")).alias("least")).select("text", F.col("least.gram").alias("gram"))
    return rarest.join(posted.hint("merge"), "gram").select("text", "path")


def typed(asked: DataFrame, library: DataFrame) -> DataFrame:
    """asked, outcome (path, one, several, none), n, path: which item of ``library`` (path, artist, title) a typed text means.

    The whole path decides. Else every item whose file name or label has the text in it counts, whatever the
    case: one is it; several are one row each, and none is picked; a text without any has one row with a null path. A
    text is looked up by its rarest run of eight letters (all of it, if it is shorter), so no text meets items
    that lack these. Null and empty texts mean nothing.
    """
    texts = asked.select("asked").where("asked <> ''").distinct()
    items = library.where(F.col("path").isNotNull()).dropDuplicates(["path"])
    label = F.concat_ws(" — ", "artist", F.coalesce("title", F.lit("")))
    shown = items.select("path", caseless(basename(F.col("path"))).alias("name"), caseless(label).alias("label"))
    whole = texts.join(items.select("path").hint("merge"), F.col("asked") == F.col("path"))
    rest = texts.join(whole.select("asked").hint("merge"), "asked", "left_anti").withColumn("text", caseless(F.col("asked")))
    # The name and the label are told apart, so that no gram runs over from one to the other; they travel with what was met only.
    held = met(rest.select("text").distinct(), shown).join(shown.hint("merge"), "path").where(F.contains("name", F.col("text")) | F.contains("label", F.col("text")))
    means = staged(held.select("text", "path").join(rest.hint("merge"), "text").select("asked", "path"), "typed-means")
    counts = means.groupBy("asked").agg(F.count(F.lit(1)).alias("n"))
    several = means.join(counts.hint("merge"), "asked").select("asked", F.when(F.col("n") == 1, "one").otherwise("several").alias("outcome"), "n", "path")
    one = F.lit(1).cast("long").alias("n")
    none = rest.join(counts.hint("merge"), "asked", "left_anti").select("asked", F.lit("none").alias("outcome"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("path"))
    return whole.select("asked", F.lit("path").alias("outcome"), one, "path").unionByName(several).unionByName(none)
