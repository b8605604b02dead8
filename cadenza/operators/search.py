"""Search results: relevance, one option for each source, interleaving and grouping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import keys, tempo
from cadenza.functions.text import relevance, tokens

STRONG = 0.6


def worded(candidates: DataFrame) -> DataFrame:
    """Adds tokens to candidates (title, artist)."""
    return candidates.withColumn("tokens", tokens(F.concat_ws(" ", "title", "artist")))


def rated(rows: DataFrame, asked: Column) -> DataFrame:
    """Adds score to rows with tokens, against a query's tokens. These are a column first, as the rule names them many times."""
    return rows.withColumn("_asked", asked).withColumn("score", relevance(F.col("tokens"), F.col("_asked"))).drop("_asked")


def scored(candidates: DataFrame, query: Column) -> DataFrame:
    """Adds tokens and score to candidates (query_id, title, artist)."""
    return rated(worded(candidates), tokens(query))


def relevant(rows: DataFrame) -> DataFrame:
    """If a query's best score is strong, only strong candidates; else all: it names a mood, not a track."""
    best = F.max("score").over(W.partitionBy("query_id"))
    return rows.withColumn("_best", best).where((F.col("_best") < STRONG) | (F.col("score") >= STRONG)).drop("_best")


def diverse(rows: DataFrame, n: int) -> DataFrame:
    """Up to n of each query: the best of each source first, then the rest by rank."""
    each = F.row_number().over(W.partitionBy("query_id", "source").orderBy("rank"))
    order = W.partitionBy("query_id").orderBy((F.col("_nth") > 1), "rank")
    return rows.withColumn("_nth", each).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("_nth")


def by_genre(rows: DataFrame, wanted: Column) -> DataFrame:
    """Rows (genre, title) that go with a genre, and likeness: 1 if one genre's name holds the other's (none is held by any), 0.7 if the title names it."""
    genre, asked = F.lower(F.coalesce("genre", F.lit(""))), F.lower(wanted)
    likeness = F.when(F.contains(genre, asked) | F.contains(asked, genre), 1.0).when(F.contains(F.lower(F.coalesce("title", F.lit(""))), asked), 0.7)
    return rows.withColumn("likeness", likeness).where("likeness IS NOT NULL")


def interleaved(rows: DataFrame, sources: list[str], limit: int) -> DataFrame:
    """The first of each source in this order, then the second of each, up to ``limit``; each source gives at most max(4, limit // 4)."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    nth = F.row_number().over(W.partitionBy("query_id", "source").orderBy("rank"))
    order = W.partitionBy("query_id").orderBy("_nth", "_place")
    met = rows.withColumns({"_nth": nth, "_place": place}).where((F.col("_place") > 0) & (F.col("_nth") <= max(4, limit // 4)))
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("_nth", "_place")


def best_of_sources(rows: DataFrame, priority: list[str]) -> DataFrame:
    """One row for each query and source: verified extended ones first, then verified, then by rank; sources in order."""
    order = W.partitionBy("query_id", "source").orderBy(F.col("extended").desc(), F.col("verified").desc(), "rank")
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").withColumn("priority", F.when(place > 0, place).otherwise(len(priority) + 1))


def grouped(rows: DataFrame) -> DataFrame:
    """query_id, cluster, item_id, score: versions of one track together, one for each source.

    In order of rank, an item joins the first cluster that it shares two tokens and 0.72 of the
    smaller set with. A cluster that has its source already drops it; else the cluster's tokens grow.
    The order decides, so the results of one query are handled together; queries are dealt out.
    """

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, found in zip(batch["query_id"], batch["found"], strict=True):
                clusters: list[tuple[set, set]] = []
                for r in found:
                    mine = set(r["tokens"])
                    for i, (sign, sources) in enumerate(clusters):
                        common = len(mine & sign)
                        if common >= 2 and common / min(len(mine), len(sign)) >= 0.72:
                            if r["source"] not in sources:
                                sources.add(r["source"])
                                sign |= mine
                                out.append((query, i, r["item_id"], r["score"]))
                            break
                    else:
                        clusters.append((mine, {r["source"]}))
                        out.append((query, len(clusters) - 1, r["item_id"], r["score"]))
            yield pd.DataFrame(out, columns=["query_id", "cluster", "item_id", "score"])

    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id", "source", "tokens", "score"))).alias("found"))
    found = lists.mapInPandas(fit, "query_id bigint, cluster int, item_id bigint, score double")
    best = F.max("score").over(W.partitionBy("query_id", "cluster"))
    return found.withColumn("best", best).withColumn("place", F.dense_rank().over(W.partitionBy("query_id").orderBy(F.col("best").desc(), "cluster"))).drop("best")


def deduplicated(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first row of each key in order of rank."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("query_id", *by).orderBy("rank"))).where("_n = 1").drop("_n")


def with_backfill(first: DataFrame, second: DataFrame, n: int) -> DataFrame:
    """n rows of each query: from the second source only what the first leaves open."""
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)))
    order = W.partitionBy("query_id").orderBy("_from", "rank")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("_from")


def similar_score(bpm_a: Column, key_a: Column, bpm_b: Column, key_b: Column, recent: Column) -> Column:
    """Distance for similar-track lists, smaller is nearer."""
    return keys.steps(key_a, key_b) * 1000 + F.least(tempo.octave_gap(bpm_a, bpm_b), F.lit(40.0)) * 10 - F.when(recent, 5).otherwise(0)


def popularity(popular: Column, likes: Column, comments: Column, known_source: Column) -> Column:
    total = 40 * F.coalesce(popular, F.lit(0)) / 100 + 30 * F.least(F.coalesce(likes, F.lit(0)) / 10_000, F.lit(1.0)) + 20 * F.least(F.coalesce(comments, F.lit(0)) / 1_000, F.lit(1.0))
    return F.least(total + F.when(known_source, 10).otherwise(0), F.lit(100.0))
