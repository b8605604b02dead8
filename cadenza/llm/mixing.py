"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's target is its share of all words by weight, but at most ``cap`` times what it has; what
is cut off goes to the others by weight until no target is above its cap. Every document then gets
``floor(target / source_size)`` whole copies. The rest of the target is a sample without
replacement: document i gets the rank

    Q_i = (U_i / (1 - U_i)) / (p_i / (1 - p_i))

with U_i from a hash of its id and size, and p_i its inclusion probability: the odds of the source's
fraction that is left, multiplied by the document's own factor. That is a named column of preferences,
or the root of its size over the source's mean size: cutting text at a document's start and end costs
context, so a mix favours long documents, but not in proportion. A source takes its lowest ranks up to
the size in words that is left. A common factor of a source's odds doesn't change its ranks, so fixing
the size normalises them. It is fixed in words, not in documents, so a source misses its target by half
of one document at most.

No source passes through one task: ranks are counted in bins, and only the bin in which a source's
sample ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import n_words, staged

#: The bins that a source's ranks are counted in.
BINS = 4096
#: Tables with a row for each source are sent to all tasks up to so many rows, a few MB; beyond, they are joined.
SENT = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, n) -> source, source_size, n, weight, target. One row per source, null last.

    Sources in code point order weigh ``weights``, repeated. With sources in order of cap / weight,
    the level of water L_j = (all - caps before j) / (weights from j) holds from the first j on
    whose own cap isn't under it.
    """
    named = sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * cap
    by = W.orderBy((limit / F.col("weight")).asc(), F.col("place").asc())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        named.withColumn("weight", weight.cast("long"))
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.sum("weight").over(after))
        .withColumn("order", F.row_number().over(by))
        .withColumn("level", F.min_by("level", F.when(F.col("level") * F.col("weight") <= limit, F.col("order"))).over(every))
        .select("source", "source_size", "n", "weight", F.least(F.col("level") * F.col("weight"), limit.cast("double")).alias("target"))
    )


def by_source(df: DataFrame, name: str) -> DataFrame:
    """A table of one row for each source at most, to be joined: sent to all tasks if its count allows."""
    small = staged(df, name)
    return F.broadcast(small) if small.count() <= SENT else small


def uniform(seed: str, doc_id: Column, size: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash of id and size; the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), size.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: str = "mix",
    preference: str | None = None,
    bins: int = BINS,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of ``docs``.

    Null texts and texts without words have size 0 and take nothing. A null source is one source.
    Rows with the same id and size share their U; ties go by id (null first), then size, so equal rows are
    interchangeable. Other columns of ``docs`` are ignored. An empty table gives an empty result.
    ``preference``: a column of positive factors of the inclusion odds, instead of those by size.
    """
    factor = F.col(preference).cast("double") if preference else F.lit(None).cast("double")
    sized = staged(docs.select("doc_id", "source", n_words("text").alias("size"), factor.alias("factor")), "mix-sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, cap)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = (
        sources.withColumn("whole", F.floor(share))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))
    )
    # Joined by sending it, a hot source's rows stay where they are.
    s = by_source(sources.select(F.col("source").alias("of"), "source_size", "n", "target", "whole", "rest", "p"), "mix-sources")
    u = uniform(seed, F.col("doc_id"), F.col("size"))
    own = F.sqrt(F.greatest("size", F.lit(1)).cast("double") * F.col("n") / F.greatest("source_size", F.lit(1)))
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")) * F.coalesce("factor", own))
    ranked = (
        sized.join(s, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("q", F.when(F.col("p") > 0, q))
        .withColumn("bin", F.least(F.floor(F.col("q") / (F.col("q") + 1) * bins), F.lit(bins - 1)))
    )
    upto = W.partitionBy("of").orderBy("bin")
    ends = (
        ranked.where("q IS NOT NULL")
        .groupBy("of", "bin")
        .agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        .withColumn("end", F.sum("words").over(upto))
        .withColumn("begin", F.col("end") - F.col("words"))
        .where("begin <= rest AND rest < end")
        .select(F.col("of").alias("at"), F.col("bin").alias("last_bin"), "begin")
    )
    # A source whose bins never pass what is left has no last bin; all of its ranks are under it.
    placed = ranked.join(by_source(ends, "mix-ends"), F.col("of").eqNullSafe(F.col("at")), "left")
    inside = F.col("bin") == F.col("last_bin")
    order = W.partitionBy("of").orderBy("q", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    keep = ["doc_id", "source", "size", "source_size", "target", "whole"]
    sure = placed.where(~F.coalesce(inside, F.lit(False))).select(
        *keep, F.when(F.col("q").isNotNull() & (F.col("last_bin").isNull() | (F.col("bin") < F.col("last_bin"))), 1).otherwise(0).alias("extra")
    )
    close = (
        placed.where(inside)
        .withColumn("upto", F.col("begin") + F.sum("size").over(order))
        .select(*keep, F.when(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"), 1).otherwise(0).alias("extra"))
    )
    copies = F.col("whole") + F.col("extra")
    return sure.unionByName(close).select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it. Rows that it takes 0 times go.

    Rows that agree in id, source and size may exchange their numbers of copies; among these the
    copies are dealt by row number, so each number is used once.
    """
    taken = mix(docs, **options).where("copies > 0")
    dealt = taken.groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    dealt = dealt.select(F.struct("doc_id", "source", "size").alias("of"), "copies")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct("doc_id", "source", n_words("text").alias("size")).alias("key"))
    rows = rows.withColumn("turn", F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("row"))))
    match = F.col("key.doc_id").eqNullSafe(F.col("of.doc_id")) & F.col("key.source").eqNullSafe(F.col("of.source")) & (F.col("key.size") == F.col("of.size"))
    out = rows.join(dealt, match).withColumn("times", F.get("copies", F.col("turn") - 1))
    return out.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
