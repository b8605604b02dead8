"""Crates: ordered lists of items, their metrics, who may enter a set, and refreshing an import."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import keys, tempo
from cadenza.functions.text import genre_key

#: Where a tempo comes from, most trusted first.
BPM_SOURCES = ("engine", "collection", "other")
REASONS = ("other-genre", "no-file", "no-genre", "analysing", "failed", "not-analysed", "not-a-track", "duplicate")


def crate_metrics(items: DataFrame) -> DataFrame:
    """crate_id, items, with_file, seconds, peak_key, compatible: one row for each crate, from crate_id, key, duration, file_ok.

    peak_key is the most frequent key number, the least in ties; compatible counts items whose
    number is that or next to it. Items are counted by number first, so a hot crate is 13 rows.
    """
    n = keys.number(F.col("key"))
    by_number = items.groupBy("crate_id", n.alias("number")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("file_ok", F.lit(False))).alias("files"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("seconds")
    )
    has = F.col("number").isNotNull()
    whole = by_number.groupBy("crate_id").agg(
        F.sum("n").alias("items"),
        F.sum("files").alias("with_file"),
        F.sum("seconds").alias("seconds"),
        F.max_by("number", F.when(has, F.struct(F.col("n"), -F.col("number")))).alias("peak_key"),
        F.collect_list(F.when(has, F.struct("number", "n"))).alias("bins"),
    )
    turn = lambda b: F.pmod(b.number - F.col("peak_key"), F.lit(12)).isin(0, 1, 11)
    compatible = F.aggregate("bins", F.lit(0).cast("long"), lambda t, b: t + F.when(turn(b), b.n).otherwise(0))
    return whole.select("crate_id", "items", "with_file", "seconds", "peak_key", compatible.alias("compatible"))


def crate_tempo(items: DataFrame) -> DataFrame:
    """crate_id, source, mean, low, high, n, left_out: tempo over the most trusted source a crate has, from crate_id, bpm, bpm_source.

    Sources are never mixed; what comes from others is only counted. Sums are decimal, so a mean
    doesn't depend on their order.
    """
    rank = F.when(F.col("bpm_source") == "engine", 0).when(F.col("bpm_source") == "collection", 1).otherwise(2)
    known = items.where(tempo.valid(F.col("bpm"))).groupBy("crate_id", rank.alias("rank")).agg(F.sum(F.col("bpm").cast("decimal(20,6)")).alias("total"), F.min("bpm").alias("low"), F.max("bpm").alias("high"), F.count(F.lit(1)).alias("n"))
    best = known.groupBy("crate_id").agg(F.min_by(F.struct("rank", "total", "low", "high", "n"), "rank").alias("b"), F.sum("n").alias("every"))
    name = F.get(F.array(*map(F.lit, BPM_SOURCES)), F.col("b.rank"))
    return best.select("crate_id", name.alias("source"), F.round(F.col("b.total") / F.col("b.n"), 1).cast("double").alias("mean"), F.round("b.low", 1).alias("low"), F.round("b.high", 1).alias("high"), F.col("b.n").alias("n"), (F.col("every") - F.col("b.n")).alias("left_out"))


def base_reason() -> Column:
    """Why an item can't enter any set; null if it could. From file_ok, genre, state, engine_id, is_track."""
    return (
        F.when(~F.coalesce("file_ok", F.lit(False)), "no-file")
        .when(genre_key(F.col("genre")).isNull(), "no-genre")
        .when(F.col("state").isin("analysing", "queued"), "analysing")
        .when(F.col("state") == "failed", "failed")
        .when((F.coalesce("state", F.lit("")) != "analysed") | F.col("engine_id").isNull() | F.col("is_track").isNull(), "not-analysed")
        .when(~F.col("is_track"), "not-a-track")
    )


def eligible(items: DataFrame) -> DataFrame:
    """Adds genre_key, reason and duplicate_of to items: what each one is in the set of every genre of its crate.

    One row for each item and genre in its crate. An item of another genre is just that; then come
    the base reasons; of those left, an item whose file, or whose artist and title, an entered item
    before it has is a duplicate. A duplicate registers nothing, so the order decides; this last step
    runs over the candidates of one crate and genre together, in order of position and item.
    """
    own = items.withColumn("own_genre", genre_key(F.col("genre"))).withColumn("base", base_reason())
    genres = own.where("own_genre IS NOT NULL").select("crate_id", F.col("own_genre").alias("genre_key")).distinct()
    each = own.join(genres, "crate_id").withColumn("first", F.when(F.col("own_genre") != F.col("genre_key"), "other-genre").otherwise(F.col("base")))
    found = _duplicates(each.where("first IS NULL"))
    out = each.join(found, ["crate_id", "genre_key", "item_id"], "left")
    reason = F.coalesce("first", F.when(F.col("duplicate_of").isNotNull(), "duplicate"))
    return out.select(*items.columns, "genre_key", reason.alias("reason"), "duplicate_of")


def _duplicates(rows: DataFrame) -> DataFrame:
    """crate_id, genre_key, item_id, duplicate_of of candidates that have the file, or the artist and title, of an entered one before them."""
    title, artist = F.lower(F.trim(F.coalesce("title", F.lit("")))), F.lower(F.trim(F.coalesce("artist", F.lit(""))))
    file, name = F.nullif(F.col("file_key"), F.lit("")), F.when(title != "", F.concat(artist, F.lit("\n"), title))
    candidates = rows.select("crate_id", "genre_key", "position", "item_id", file.alias("file_id"), name.alias("name_id"))
    # Only items that share an identity with another one need the walk; all others enter.
    repeated = [F.count(c).over(W.partitionBy("crate_id", "genre_key", c)) > 1 for c in ("file_id", "name_id")]
    walk = candidates.withColumn("_again", F.coalesce(F.col("file_id").isNotNull() & repeated[0], F.lit(False)) | F.coalesce(F.col("name_id").isNotNull() & repeated[1], F.lit(False)))
    return walk.where("_again").groupBy("crate_id", "genre_key").applyInPandas(_first_wins, "crate_id bigint, genre_key string, item_id bigint, duplicate_of bigint")


def _first_wins(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["position", "item_id"], kind="stable")
    seen: dict[tuple[str, str], int] = {}
    out = []
    for item, *ids in rows[["item_id", "file_id", "name_id"]].itertuples(index=False):
        known = [(kind, x) for kind, x in zip(("file", "name"), ids, strict=True) if isinstance(x, str)]
        before = next((seen[k] for k in known if k in seen), None)
        if before is None:
            seen.update(dict.fromkeys(known, item))
        else:
            out.append((rows["crate_id"].iloc[0], rows["genre_key"].iloc[0], item, before))
    return pd.DataFrame(out, columns=["crate_id", "genre_key", "item_id", "duplicate_of"])


def eligibility_summary(rows: DataFrame) -> DataFrame:
    """crate_id, genre_key, total, enter and a count for each reason, zeros included; total is the sum of the others."""
    counts = [F.count_if(F.col("reason") == r).alias(r.replace("-", "_")) for r in REASONS]
    return rows.groupBy("crate_id", "genre_key").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reason").isNull()).alias("enter"), *counts)


def eligibility_counts(items: DataFrame) -> DataFrame:
    """``eligibility_summary`` of ``eligible`` items, whose key is (crate_id, item_id), without a row for each item and genre.

    Items of other genres are the crate's less a genre's own; those without a genre stand in every genre of their crate.
    """
    own = items.where("crate_id IS NOT NULL").withColumn("genre_key", genre_key(F.col("genre"))).withColumn("base", base_reason())
    names = [r.replace("-", "_") for r in REASONS]
    counts = [F.count_if(F.col("base") == r).alias(n) for r, n in zip(REASONS, names, strict=True)]
    each = own.groupBy("crate_id", "genre_key").agg(F.count(F.lit(1)).alias("own"), F.count_if(F.col("base").isNull()).alias("enter"), *counts)
    whole, without = W.partitionBy("crate_id"), F.col("genre_key").isNull()
    each = each.withColumns({"_all": F.sum("own").over(whole), "_with": F.sum(F.when(~without, F.col("own"))).over(whole), **{f"_{n}": F.coalesce(F.max(F.when(without, F.col(n))).over(whole), F.lit(0)) for n in names}})
    again = _duplicates(own.where("genre_key IS NOT NULL AND base IS NULL")).groupBy("crate_id", "genre_key").agg(F.count(F.lit(1)).alias("_again"))
    met = each.where(~without).join(again, ["crate_id", "genre_key"], "left").withColumn("_again", F.coalesce("_again", F.lit(0)))
    take = {n: F.col(n) + F.col(f"_{n}") for n in names} | {"other_genre": F.col("_with") - F.col("own"), "duplicate": F.col("_again")}
    return met.select("crate_id", "genre_key", F.col("_all").alias("total"), (F.col("enter") - F.col("_again")).alias("enter"), *(take[n].alias(n) for n in names))


def can_build(summary: DataFrame) -> DataFrame:
    """crate_id, best, ok: a set needs two items of one genre."""
    return summary.groupBy("crate_id").agg(F.max("enter").alias("best")).withColumn("ok", F.col("best") >= 2)


def refresh(existing: DataFrame, incoming: DataFrame, by: list[str]) -> DataFrame:
    """An imported crate after reading its source again; nothing is deleted.

    Items meet by ``by``; the first of each key counts, on either side. Tempo and key are taken over
    even if null, the length only if known, the genre unless it was edited by hand, the file if
    there is one or the old one is gone. New items follow the last position, in their own order.
    """
    first = lambda df: W.partitionBy(*by).orderBy("position", *([c for c in ("item_id",) if c in df.columns]))
    new = incoming.withColumn("_nth", F.row_number().over(first(incoming))).where("_nth = 1").drop("_nth")
    old = existing.withColumn("_nth", F.row_number().over(first(existing)))
    n = new.select(*by, *(F.col(c).alias(f"_{c}") for c in ("bpm", "key", "duration", "genre", "file")), F.lit(True).alias("_new"))
    met = old.join(n, by, "left").withColumn("_new", F.coalesce("_new", F.lit(False)) & (F.col("_nth") == 1))
    take = lambda c, value: F.when(F.col("_new"), value).otherwise(F.col(c)).alias(c)
    changed = {
        "bpm": F.col("_bpm"),
        "key": F.col("_key"),
        "duration": F.coalesce("_duration", "duration"),
        "genre": F.when(F.col("genre_edited"), F.col("genre")).otherwise(F.col("_genre")),
        "file": F.when(F.col("_file").isNotNull() | ~F.coalesce("file_ok", F.lit(False)), F.coalesce("_file", "file")).otherwise(F.col("file")),
    }
    kept = met.select(*(take(c, changed[c]) if c in changed else F.col(c) for c in existing.columns))
    fresh = new.join(existing.select(*by).distinct(), by, "left_anti")
    last = existing.agg(F.coalesce(F.max("position"), F.lit(0)).alias("_last"))
    added = fresh.join(F.broadcast(last)).withColumn("position", F.col("_last") + F.row_number().over(W.orderBy("position"))).drop("_last")
    return kept.unionByName(added.select(*(c for c in existing.columns if c in added.columns)), allowMissingColumns=True)
