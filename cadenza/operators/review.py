"""Reviews of new files: what needs a decision and why, counts, and what decisions lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.keys import unanimous
from cadenza.operators.library import is_track

#: Reasons in the order of the review's sections; a file stands in that of its first.
REASONS = ("suspicious", "duplicate", "nameless", "not-a-track")
STATES = ("approved", "discarded", "pending")
#: Names of files that another program still writes: endings, and infixes before an ending; fixed values.
UNFINISHED = r"(?i)\.(part|tmp|crdownload)$|\.(part|tmp|temp|crdownload)\."
HIDDEN = r"^(\.|~\$)"


def nameless(artist: Column, title: Column) -> Column:
    return (F.coalesce(F.trim(artist), F.lit("")) == "") | (F.coalesce(F.trim(title), F.lit("")) == "")


def pending_reasons(flag: Column, group: Column, artist: Column, title: Column, duration: Column) -> Column:
    """All reasons why a file needs a decision: up to four. ``group`` is that of its duplicates; null or 0 is none."""
    found = (flag == "suspicious", F.coalesce(group, F.lit(0)) != 0, nameless(artist, title), ~is_track(duration))
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in zip(REASONS, found, strict=True))), lambda x: x.isNotNull())


def reviewed(files: DataFrame) -> DataFrame:
    """Files (flag, group, artist, title, duration) with reasons, state (approved without a reason, else pending) and section."""
    rows = files.withColumn("reasons", pending_reasons(*(F.col(c) for c in ("flag", "group", "artist", "title", "duration"))))
    return rows.withColumn("state", F.when(F.size("reasons") == 0, "approved").otherwise("pending")).withColumn("section", F.coalesce(F.get("reasons", 0), F.lit("approved")))


def report_counts(rows: DataFrame) -> DataFrame:
    """kind, name, n: files in each state, and files that have each reason; a file counts for each of its reasons."""
    states = rows.groupBy(F.col("state").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("state").alias("kind"), "name", "n")
    each = rows.select(F.explode("reasons").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return states.unionByName(each.select(F.lit("reason").alias("kind"), "name", "n"))


def doubt_note(agreement: Column, known: Column) -> Column:
    """"key g/t" if a key's votes differ, "key ?" without any evidence; null if they agree or nobody noted them (``known`` false)."""
    text = F.coalesce(F.trim(agreement), F.lit(""))
    won, total = (F.regexp_extract(text, r"^(\d+)/(\d+)$", i).try_cast("int") for i in (1, 2))
    note = F.when(won.isNull() | total.isNull() | (won == 0) | (total == 0), F.lit("key ?")).when(won != total, F.concat(F.lit("key "), won.cast("string"), F.lit("/"), total.cast("string")))
    return F.when(known, note)


def comment_with(previous: Column, note: Column) -> Column:
    """A comment with the note behind what was there; empty without a note."""
    before = F.coalesce(F.trim(previous), F.lit(""))
    return F.when(note.isNull(), "").when(before == "", note).otherwise(F.concat(before, F.lit(" | "), note))


def agreement_group(votes: Column, key: Column, agreement: Column) -> Column:
    """Of a measured key: whether all votes are it, are one other, or differ; null if nobody voted."""
    kinds = F.array_distinct(F.filter(F.split(F.coalesce(votes, F.lit("")), r"\|"), lambda v: v != ""))
    return F.when(F.size(kinds) == 0, None).when(~F.coalesce(unanimous(agreement), F.lit(False)), "differ").when((F.size(kinds) == 1) & (F.get(kinds, 0) == key), "same").otherwise("other")


def applied(decisions: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions (path, state) on files that are ready (path): each approved one as copied or missing, and how many of every other state were left out."""
    here = staged.select("path").distinct().withColumn("_here", F.lit(True))
    approved = decisions.where("state = 'approved'").join(here, "path", "left")
    copied = approved.withColumn("outcome", F.when(F.col("_here"), "copied").otherwise("missing")).drop("_here")
    return copied, decisions.where("state <> 'approved'").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def in_the_way(name: Column) -> Column:
    """Whether a found file isn't to be touched: hidden, a lock, or not finished."""
    return name.rlike(HIDDEN) | name.rlike(UNFINISHED)


def export_status(items: DataFrame, library: DataFrame, marks: DataFrame, parts: int | None = None) -> DataFrame:
    """Items (path, file_ok, state) with status, marks and entry: whether each goes into a collection, and as which entry.

    status: no-file, not-analysed, out-of-date or ready. One entry for each file of a group's ready
    items, in the order of their first place; an item that comes twice keeps its entry. Library has
    path and current; marks have path. ``parts`` is the number of tasks that crates are dealt over.
    """
    known = library.select("path", F.col("current").alias("_current"))
    counts = marks.groupBy("path").agg(F.count(F.lit(1)).alias("_marks"))
    met = items.join(known, "path", "left").join(counts, "path", "left")
    status = F.when(~F.coalesce("file_ok", F.lit(False)), "no-file").when((F.coalesce("state", F.lit("")) != "analysed") | F.col("_current").isNull(), "not-analysed").when(~F.col("_current"), "out-of-date").otherwise("ready")
    met = met.withColumn("status", status)
    # All of a crate stands together from here on: entries are numbered by windows.
    met = (met.repartition(parts, "crate_id") if parts else met.repartition("crate_id")).withColumn("_ready", F.col("status") == "ready")
    met = met.withColumn("_first", F.min(F.struct("position", "item_id")).over(W.partitionBy("crate_id", "_ready", "path")))
    met = met.withColumn("_entry", F.dense_rank().over(W.partitionBy("crate_id", "_ready").orderBy("_first", "path")))
    entry = F.when(F.col("_ready") & F.col("path").isNotNull() & F.col("crate_id").isNotNull(), F.col("_entry"))
    return met.select(*items.columns, "status", F.coalesce("_marks", F.lit(0)).alias("marks"), entry.alias("entry"))


def export_totals(rows: DataFrame) -> DataFrame:
    """crate_id, entries, ready, left_out, marks: marks of a file count once."""
    each = rows.groupBy("crate_id", "path", "status").agg(F.count(F.lit(1)).alias("n"), F.max("marks").alias("marks"), F.max("entry").alias("entry"))
    ready = F.col("status") == "ready"
    return each.groupBy("crate_id").agg(F.max("entry").alias("entries"), F.sum(F.when(ready, F.col("n")).otherwise(0)).alias("ready"), F.sum(F.when(ready, 0).otherwise(F.col("n"))).alias("left_out"), F.sum(F.when(ready, F.col("marks")).otherwise(0)).alias("marks"))
