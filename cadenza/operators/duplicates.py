"""Duplicate recordings: pairs by length and fingerprint, groups, and which copy stays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import signal
from cadenza.operators.components import connected
from cadenza.sources.staging import staged

#: Correlation of fingerprints from which two recordings are one.
SAME = 0.90
SECONDS, SHARE = 2.0, 0.02
#: Numbers in the prints of a block, about, and prints that are multiplied at once.
BLOCK, AT_ONCE = 500_000, 512
#: The same of blocks of prints on one grid; grids, by steps of length, that are sent to the tasks.
PRINT_BLOCK, CLASSES = 8_000_000, 50_000


def lengths_agree(a: Column, b: Column) -> Column:
    return (a > 0) & (b > 0) & (F.abs(a - b) <= F.greatest(F.lit(SECONDS), F.least(a, b) * SHARE))


def similarity(a: Column, b: Column) -> Column:
    """Pearson's correlation of two arrays; 0 for other shapes or without variance."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v.cast("double"))
    products = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    sa, sb = total(a), total(b)
    below = (products(a, a) - sa * sa / n) * (products(b, b) - sb * sb / n)
    return F.when((n != F.size(b)) | (n == 0), 0.0).when(below > 1e-18, (products(a, b) - sa * sb / n) / F.sqrt(below)).otherwise(0.0)


def unit(print_: Column) -> Column:
    """A print without its mean and of length 1, so that the product of two is their correlation; null without variance. Worked out once for each recording."""
    # As the element of an array a value is worked out once; named directly, once for each element that a lambda sees.
    once = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v)
    centred = once(F.transform(print_, lambda v: v.cast("double")), lambda x: once(total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean)))
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v)
    return once(centred, lambda x: once(square(x), lambda n: F.when(n > 1e-18, F.transform(x, lambda v: v / F.sqrt(n)))))


def product(a: Column, b: Column) -> Column:
    """The correlation of two ``unit`` prints; 0 for other shapes or none."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)).otherwise(0.0)


def length_step() -> Column:
    """A length's place on a scale of steps no narrower than the tolerance."""
    step = F.when(F.col("duration") <= SECONDS / SHARE, F.floor(F.col("duration") / SECONDS)).otherwise(
        F.lit(int(SECONDS / SHARE / SECONDS)) + F.floor(F.log(F.col("duration") / (SECONDS / SHARE)) / F.log(F.lit(1 + SHARE)))
    )
    return step.cast("long")


def near_lengths(rows: DataFrame, *carried: str) -> DataFrame:
    """a, b (paths, a < b), a_seconds, b_seconds and a_*, b_* of other columns, for pairs whose lengths agree.

    Lengths stand on a scale of steps no narrower than the tolerance, so a partner is in the same or a
    neighbouring step; each row on the left is repeated three times and joined by equality.
    """
    rows = rows.where(F.col("duration") > 0).withColumn("step", length_step())
    side = lambda x: [F.col("path").alias(x), F.col("duration").alias(f"{x}_seconds"), *(F.col(c).alias(f"{x}_{c}") for c in carried)]
    left = rows.select(*side("a"), F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)).alias("near"))
    met = left.join(rows.select(*side("b"), "step"), (F.col("near") == F.col("step")) & (F.col("a") < F.col("b")))
    return met.where(lengths_agree(F.col("a_seconds"), F.col("b_seconds"))).drop("near", "step")


def _correlated(least: float):
    """Two blocks of paths, lengths and unit prints -> a, b, similarity of the pairs that agree and correlate, by products of matrices."""

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"a": [], "b": [], "similarity": []}).astype({"a": str, "b": str, "similarity": float})]
        same = lambda df: df.groupby(df["print"].map(len), sort=False)
        others = {n: rows for n, rows in same(right)} if len(left) and len(right) else {}
        for n, rows in same(left) if others else ():
            if n not in others:
                continue
            paths, seconds, prints = others[n]["path"].to_numpy(), others[n]["duration"].to_numpy(float), np.stack(others[n]["print"].to_numpy())
            for at in range(0, len(rows), AT_ONCE):
                part = rows.iloc[at : at + AT_ONCE]
                own = part["duration"].to_numpy(float)
                value = np.stack(part["print"].to_numpy()) @ prints.T
                i, j = np.nonzero(value >= least)
                agree = np.abs(own[i] - seconds[j]) <= np.maximum(SECONDS, np.minimum(own[i], seconds[j]) * SHARE)
                i, j = i[agree], j[agree]
                p, q = part["path"].to_numpy()[i], paths[j]
                # Blocks of one step meet themselves, or each other twice.
                once = (p < q) if left["step"].iloc[0] == right["step"].iloc[0] else (p != q)
                p, q, i, j = p[once], q[once], i[once], j[once]
                found.append(pd.DataFrame({"a": np.where(p < q, p, q), "b": np.where(p < q, q, p), "similarity": value[i, j]}))
        return pd.concat(found, ignore_index=True)

    return met


def pairs(df: DataFrame, least: float = SAME) -> DataFrame:
    """a, b, similarity with a < b: recordings (path, duration, print) whose lengths agree and prints correlate.

    Lengths stand on the steps of ``near_lengths``. Each step is dealt into blocks of bounded size by a hash; a task multiplies
    the prints of a block with those of a block of the same or the next step, and only pairs that are found leave it.
    """
    if least <= 0:  # prints of other shapes count as 0
        rows = df.select("path", "duration", unit(F.col("print")).alias("print"))
        met = near_lengths(rows.where(F.col("print").isNotNull()), "print")
        return met.select("a", "b", product(F.col("a_print"), F.col("b_print")).alias("similarity")).where(F.col("similarity") >= least)
    rows = staged(df.where("path IS NOT NULL AND duration > 0").select("path", "duration", unit(F.col("print")).alias("print"), length_step().alias("step")).where("print IS NOT NULL"), "duplicate-units")
    # One row for each step: the scale has few.
    blocks = staged(rows.groupBy("step").agg(F.ceil(F.sum(F.size("print")) / BLOCK).cast("int").alias("blocks")), "duplicate-blocks")
    of = lambda shift, name: blocks.select((F.col("step") - shift).alias("step"), F.col("blocks").alias(name))
    each = rows.join(F.broadcast(blocks), "step").withColumn("own", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int")).drop("blocks")
    # Named anew, so that the rows can be held against themselves.
    shown = [F.col(c).alias(c) for c in ("path", "duration", "print", "step")]
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    found = None
    for shift in (0, 1):
        left = each.join(F.broadcast(of(shift, "n")), "step").select(*shown, F.col("step").alias("at"), F.col("own").alias("i"), other("n").alias("j"))
        right = each.join(F.broadcast(of(-shift, "n")), "step").select(*shown, (F.col("step") - shift).alias("at"), other("n").alias("i"), F.col("own").alias("j"))
        met = left.groupBy("at", "i", "j").cogroup(right.groupBy("at", "i", "j")).applyInPandas(_correlated(least), "a string, b string, similarity double")
        found = met if found is None else found.unionByName(met)
    return found


def _placed(least: float):
    """Two blocks of paths, lengths and unit prints on one grid -> a, b, similarity, regridded of the pairs that agree and correlate."""

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"a": [], "b": [], "similarity": [], "regridded": []}).astype({"a": str, "b": str, "similarity": float, "regridded": bool})]
        if len(left) and len(right):
            paths, seconds, prints = right["path"].to_numpy(), right["duration"].to_numpy(float), np.stack(right["print"].to_numpy()).T
            for at in range(0, len(left), AT_ONCE):
                part = left.iloc[at : at + AT_ONCE]
                own, again, regridded = part["duration"].to_numpy(float), part["again"].to_numpy(bool), part["regridded"].to_numpy(bool)
                value = np.stack(part["print"].to_numpy()) @ prints
                i, j = np.nonzero(value >= least)
                p, q = part["path"].to_numpy()[i], paths[j]
                # Own prints of one step meet twice, of two steps once; a recording is printed again for shorter ones.
                wanted = np.where(again[i], own[i] > seconds[j], np.where(part["step"].to_numpy()[i] == part["at"].to_numpy()[i], p < q, p != q)).astype(bool)
                wanted &= np.abs(own[i] - seconds[j]) <= np.maximum(SECONDS, np.minimum(own[i], seconds[j]) * SHARE)
                p, q, i, j = p[wanted], q[wanted], i[wanted], j[wanted]
                found.append(pd.DataFrame({"a": np.where(p < q, p, q), "b": np.where(p < q, q, p), "similarity": value[i, j], "regridded": regridded[i]}))
        return pd.concat(found, ignore_index=True)

    return met


def regridded_pairs(audio: DataFrame, rate: float, least: float = SAME, low: float = signal.PRINT_LOW, high: float = signal.PRINT_HIGH) -> DataFrame:
    """a, b, similarity, regridded with a < b: recordings (path, duration, pcm) of one sound, also where their prints look at other places.

    A length decides where a print looks (``signal.print_grid``), so a copy that is a little longer may look elsewhere and
    have nothing in common. For such a pair the longer recording is printed once more on the shorter one's grid. If that
    fails, the prints are compared as they are. Unreadable recordings have no print and are in no pair.

    Which grids are asked of a recording is known from the lengths, of which there are few grids in a step of ``near_lengths``. So it is printed
    on all of them at once, and samples are in no shuffle. Prints meet by step and grid, in blocks of bounded size, and only pairs that are found leave a task.
    """
    grid = signal.print_grid(F.col("duration"))
    sized = audio.where(grid.isNotNull() & (F.col("duration") > 0))
    classes = sized.select(length_step().alias("step"), "duration", grid.alias("grid")).groupBy("step", "grid").agg(F.min("duration").alias("low"), F.max("duration").alias("high"))
    near = classes.select(F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("_of"), F.struct("grid", "low", "high").alias("c"))
    near = staged(near.groupBy("_of").agg(F.collect_list("c").alias("near"), F.count(F.lit(1)).alias("n")), "duplicate-grids")
    # A row for each step, and short recordings have grids of their own: sent to the tasks if they are few.
    few = near.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= CLASSES
    rows = sized.withColumn("step", length_step()).withColumn("grid", grid)
    rows = rows.join(F.broadcast(near) if few else near, F.col("step") == F.col("_of"))
    agrees = lambda c: (c.low < F.col("duration")) & lengths_agree(F.col("duration"), F.least(F.col("duration"), c.high)) & ~c.grid.eqNullSafe(F.col("grid"))
    rows = rows.withColumn("grids", F.concat(F.array("grid"), F.array_distinct(F.transform(F.filter("near", agrees), lambda c: c.grid))))
    rows = rows.select("path", "duration", "step", "grids", signal.grid_prints(rate, low, high)(F.col("pcm"), F.col("grids")).alias("prints"))
    rows = rows.where("path IS NOT NULL AND prints[0] IS NOT NULL").withColumn("first", F.get("prints", F.lit(0)))
    each = rows.select("path", "duration", "step", "first", F.posexplode(F.arrays_zip("grids", "prints")).alias("k", "g"))
    again = F.col("k") > 0
    on = F.concat_ws("/", *(F.col(f"g.grids.{c}").cast("string") for c in ("start", "step", "length", "n")))
    each = each.select("path", "duration", "step", again.alias("again"), (again & F.col("g.prints").isNotNull()).alias("regridded"), on.alias("on"), unit(F.coalesce("g.prints", "first")).alias("print"))
    each = staged(each.where("print IS NOT NULL"), "duplicate-prints")
    steps = F.when(F.col("again"), F.array(F.col("step") - 1, F.col("step"))).otherwise(F.array(F.col("step"), F.col("step") + 1))
    # Named anew, so that the rows can be held against themselves.
    shown = [F.col(c).alias(c) for c in ("path", "duration", "print", "step", "again", "regridded", "on")]
    left = each.select(*shown, F.explode(steps).alias("at"))
    right = each.where("NOT again").select(*shown, F.col("step").alias("at"))
    blocks = lambda df, name: df.groupBy("at", "on").agg(F.ceil(F.sum(F.size("print")) / PRINT_BLOCK).cast("int").alias(name))
    cells = staged(blocks(left, "n").join(blocks(right, "m"), ["at", "on"]), "duplicate-cells")
    dealt = lambda n: F.pmod(F.xxhash64("path"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys_ = ["at", "on", "i", "j"]
    left = left.join(cells, ["at", "on"]).withColumn("i", dealt("n")).withColumn("j", other("m")).drop("n", "m")
    right = right.join(cells, ["at", "on"]).withColumn("j", dealt("m")).withColumn("i", other("n")).drop("n", "m")
    return left.groupBy(*keys_).cogroup(right.groupBy(*keys_)).applyInPandas(_placed(least), "a string, b string, similarity double, regridded boolean")


def groups(found: DataFrame) -> DataFrame:
    """path, group (its least path), members, least_similarity: connected pairs, with their groups' size and weakest pair."""
    found = staged(found, "duplicate-found")
    member = connected(found.select("a", "b")).select(F.col("node").alias("path"), F.col("component").alias("group"))
    weakest = found.join(member, F.col("a") == F.col("path")).groupBy("group").agg(F.min("similarity").alias("least_similarity"), F.count(F.lit(1)).alias("pairs"))
    size = member.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    return member.join(size, "group").join(weakest, "group").withColumn("all_agree", F.col("pairs") == F.col("members") * (F.col("members") - 1) / 2)


def survivors(rows: DataFrame) -> DataFrame:
    """Adds keep and reason to rows (group, path, cutoff_khz, wall, lossless, referenced).

    The best quality stays: cutoff to one decimal, no wall, lossless; among equals one that another
    library refers to, then the smaller path.
    """
    quality = [F.bround("cutoff_khz", 1).desc_nulls_last(), F.col("wall").asc_nulls_last(), F.col("lossless").desc_nulls_last()]
    by = W.partitionBy("group").orderBy(*quality, F.col("referenced").desc_nulls_last(), "path")
    whole = W.partitionBy("group")
    rows = rows.withColumn("place", F.row_number().over(by))
    rows = rows.withColumns({c: F.max(F.when(F.col("place") == 1, F.col(x))).over(whole) for c, x in (("best_cutoff", "cutoff_khz"), ("best_wall", "wall"), ("best_lossless", "lossless"))})
    reason = (
        F.when(F.col("place") == 1, F.when(F.col("referenced"), "best, and referenced").otherwise("best"))
        .when(F.col("best_cutoff") - F.coalesce("cutoff_khz", F.lit(0.0)) > 0.05, "lower cutoff")
        .when(F.col("wall") & ~F.col("best_wall"), "codec wall")
        .when(~F.col("lossless") & F.col("best_lossless"), "lossy copy")
        .otherwise("equal copy")
    )
    warning = (F.col("place") > 1) & F.coalesce("referenced", F.lit(False))
    return rows.withColumns({"keep": F.col("place") == 1, "reason": reason, "discarded_reference": warning}).drop("place", "best_cutoff", "best_wall", "best_lossless")
