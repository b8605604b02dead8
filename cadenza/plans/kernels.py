"""Registered queries on autocorrelations, phases, grids, bands and prints, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import grids, signal
from cadenza.operators import duplicates
from cadenza.plans import surrogate
from cadenza.plans.oracle import BIG

#: Frames a second of an embedding that stands for an envelope: 64 frames are 6.4 seconds.
RATE = 10
#: Tasks of queries that make much of each vector.
PARTS = 96
#: Sounds that a task draws at once: each is thousands of times its vector.
DRAWN = 32


def six(c):
    return F.round(c, 6) + F.lit(0.0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("y"))


def dealt_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over many tasks: rows are few bytes, but much work."""
    return vectors(spark, sf_dir).repartition(PARTS, "vec_id")


def metric_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an autocorrelation: support of a lag's comb, and the tempo or three halves of it."""
    i = F.col("vec_id")
    rows = vectors(spark, sf_dir).withColumn("lag", 3.0 + i % 13 + 0.25 * (i % 4)).withColumn("bpm", 38.0 + i % 120)
    support, faster = grids.comb(F.col("y"), F.col("lag")), grids.comb(F.col("y"), F.col("lag") / F.lit(1.5))
    return rows.select("vec_id", six(support).alias("support"), six(faster).alias("faster"), grids.metric_level(F.col("y"), F.col("lag"), F.col("bpm")).alias("bpm"))


def phase_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an envelope: where a grid of its tempo gathers the rises, and how much a beat."""
    rows = vectors(spark, sf_dir).withColumn("period", 60 / (90.0 + F.col("vec_id") % 60))
    steps = F.transform("y", lambda x, k: F.struct((k / RATE).alias("t"), F.when(k == 0, 0.0).otherwise(x - F.get("y", k - 1)).alias("w")))
    risen = rows.withColumn("beats", F.size("y") / RATE / F.col("period")).select("vec_id", "period", "beats", F.inline(steps)).where("w > 0")
    curves = grids.phase_curves(risen, "vec_id", RATE).withColumn("shown", F.round("level", 9))
    best = curves.groupBy("vec_id").agg(F.min(F.struct((-F.col("shown")).alias("n"), "bin", "phase")).alias("best"), F.count(F.lit(1)).alias("bins"))
    return best.select("vec_id", F.col("best.bin").alias("bin"), six(F.col("best.phase")).alias("phase"), six(-F.col("best.n")).alias("level"), "bins")


def beat_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bands of each vector, normalised, and the grid and bar of a track that has them four times over."""
    i = F.col("vec_id")
    rows = dealt_vectors(spark, sf_dir)
    # A pulse on the vector's tempo, so that many have a grid, over the vector's own values.
    frames = F.sequence(F.lit(0), F.lit(1199))
    period = 60 / (100.0 + i % 40)
    pulse = lambda k: F.when(F.pmod(k / 100.0, period) < 0.04, 1.0).otherwise(0.0)
    band = lambda share, turn: F.transform(frames, lambda k: pulse(k) * share + 0.05 * F.abs(F.get("y", ((k / 5).cast("int") + turn) % 64)))
    rows = rows.select("vec_id", grids.normalised(F.array(band(0.9, 0), band(0.7, 20), band(0.1, 40))).levels.alias("q"))
    scaled = lambda k: F.transform(F.get("q", F.lit(k)), lambda x: x / 255.0)
    got = rows.withColumn("g", grids.grid_documents(100)(scaled(0), scaled(1), scaled(2), 100.0 + i % 40))
    return got.select("vec_id", "g.*")


def band_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's thirds as three bands, normalised to bytes, and a range of them reduced to five points."""
    third = lambda k, scale: F.transform(F.slice("y", k * 21 + 1, 21), lambda x: F.abs(x) * scale)
    rows = vectors(spark, sf_dir).withColumn("b", grids.normalised(F.array(third(0, 1.0), third(1, 0.1), third(2, 0.001))))
    begin = (F.col("vec_id") % 10) / 10.0
    cut = grids.ranged(F.col("b.levels"), begin, begin + 0.2 + (F.col("vec_id") % 14) / 10.0, 5, RATE)
    text = lambda bands: F.array_join(F.transform(bands, lambda band: F.array_join(band.cast("array<string>"), ",")), ";")
    return rows.select("vec_id", text(F.col("b.levels")).alias("levels"), *(six(F.get("b.references", F.lit(k))).alias(f"reference{k}") for k in range(3)), six(cut.begin).alias("begin"), six(cut.end).alias("end"), text(cut.points).alias("points"))


def print_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a print of each of the large library's items looks."""
    rows = surrogate.big_library(spark, sf_dir).withColumn("seconds", F.col("duration") - 40 + (F.col("p_partkey") % 7) / 4.0).withColumn("g", signal.print_grid(F.col("seconds")))
    windows = signal.print_windows(F.col("g"))
    return rows.select("path", "g.start", "g.step", "g.length", "g.n", F.element_at(windows, -1).offset.alias("last"))


def _sounds(rate: int):
    """Vectors and lengths -> samples, few at once: products of a vector's values at two speeds; unknown values stay unknown."""

    def drawn(values: np.ndarray | None, length: float) -> np.ndarray:
        y, k = np.full(64, np.nan), np.arange(int(length * rate))
        known = np.asarray([] if values is None else values, float)[:64]
        y[: len(known)] = known
        return y[(k * 7 + k // 900) % 64] * y[k // 1300 % 64]

    def sounds(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, seconds in batches:
            for at in range(0, len(vectors), DRAWN):
                part = slice(at, at + DRAWN)
                yield pd.Series([drawn(v, n) for v, n in zip(vectors.iloc[part], seconds.iloc[part], strict=True)], dtype=object)

    return sounds


def regridded_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector drawn out to a sound, and a copy with a longer tail: whether both are found to be one."""
    rate, i = 208, F.col("vec_id")
    rows = dealt_vectors(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    seconds = 71.8 + (i % 30) * 4.0 + F.col("copy") * (0.3 + (i % 3) * 0.4)
    rows = rows.withColumn("duration", seconds).withColumn("pcm", F.pandas_udf(_sounds(rate), "array<double>")("y", "duration")).select(F.concat_ws("-", i.cast("string"), F.col("copy").cast("string")).alias("path"), "duration", "pcm")
    found = duplicates.regridded_pairs(rows, rate, low=2.0, high=100.0)
    return found.select("a", "b", six("similarity").alias("similarity"), "regridded")


_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS y FROM embeddings)"


def _comb(lag: str) -> str:
    parts = [f"CASE WHEN round_even({lag} * {m}, 0) < len(y) THEN greatest(y[round_even({lag} * {m}, 0)::INT + 1], 0::DOUBLE) ELSE 0::DOUBLE END" for m in range(1, 5)]
    return f"({' + '.join(parts)})"


_FLOOR = f"{10 ** (grids.FLOOR_DB / 20)!r}::DOUBLE"
_TEXT = "array_to_string(list_transform({}, lambda band: array_to_string(band, ',')), ';')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (metric_levels, phase_peaks, beat_grids, band_levels, print_places, regridded_copies)
}
SQL = {
    "metric_levels": f"""WITH {_V}, l AS (SELECT *, 3::DOUBLE + vec_id % 13 + 0.25::DOUBLE * (vec_id % 4) AS lag, 38::DOUBLE + vec_id % 120 AS b FROM v),
        c AS (SELECT vec_id, b, {_comb("lag")} AS s, {_comb("lag / 1.5::DOUBLE")} AS f FROM l)
        SELECT vec_id, round(s, 6) + 0.0::DOUBLE AS support, round(f, 6) + 0.0::DOUBLE AS faster,
            CASE WHEN b * 1.5::DOUBLE BETWEEN 60 AND 210 AND f > s AND f > s * 1.03::DOUBLE THEN b * 1.5::DOUBLE ELSE b END AS bpm FROM c""",
    "phase_peaks": f"""WITH {_V}, p AS (SELECT *, 60::DOUBLE / (90 + vec_id % 60)::DOUBLE AS period FROM v), s AS (SELECT vec_id, period, y, unnest(range(1, len(y))) AS k FROM p),
        r AS (SELECT vec_id, period, len(y)::DOUBLE / {RATE} / period AS beats, k::DOUBLE / {RATE} AS t, y[k + 1] - y[k] AS w, round(period / 0.001::DOUBLE)::INT AS bins FROM s),
        g AS (SELECT *, period / bins AS width, (t - floor(t / period) * period) / (period / bins) AS place FROM r WHERE w > 0),
        h AS (SELECT vec_id, period, bins, width, beats, greatest(round(1::DOUBLE / ({RATE}::DOUBLE * width)), 1)::INT AS half, floor(place)::INT AS at_, w * (1 - (place - floor(place))) AS h FROM g
            UNION ALL SELECT vec_id, period, bins, width, beats, greatest(round(1::DOUBLE / ({RATE}::DOUBLE * width)), 1)::INT, floor(place)::INT + 1, w * (place - floor(place)) FROM g),
        m AS (SELECT vec_id, bins, width, beats, half, at_ % bins AS at_, sum(h) AS h FROM h GROUP BY ALL), k AS (SELECT *, unnest(range(1 - half, half)) AS k FROM m),
        c AS (SELECT vec_id, width, ((at_ + k) % bins + bins) % bins AS bin, sum(h * (1 - abs(k)::DOUBLE / half) / greatest(beats, 1::DOUBLE)) AS level FROM k GROUP BY ALL),
        b AS (SELECT vec_id, min((-round(level, 9), bin)) AS best, count(*) AS bins, any_value(width) AS width FROM c GROUP BY vec_id)
        SELECT vec_id, best[2]::INT AS bin, round(best[2] * width, 6) + 0.0::DOUBLE AS phase, round(-best[1], 6) + 0.0::DOUBLE AS level, bins FROM b""",
    "band_levels": f"""WITH {_V}, t AS (SELECT vec_id, [list_transform(y[1:21], lambda x: abs(x)), list_transform(y[22:42], lambda x: abs(x) * 0.1::DOUBLE), list_transform(y[43:63], lambda x: abs(x) * 0.001::DOUBLE)] AS bands FROM v),
        p AS (SELECT *, list_transform(bands, lambda b: coalesce(list_aggregate(list_filter(b, lambda x: x > {_FLOOR}), 'quantile_cont', 0.99), 0::DOUBLE)) AS peaks FROM t),
        r AS (SELECT *, list_transform(peaks, lambda x: greatest(x, list_max(peaks) * {10 ** (-grids.RANGE_DB / 20)!r}::DOUBLE, {_FLOOR})) AS refs FROM p),
        q AS (SELECT *, list_transform(bands, lambda b, i: list_transform(b, lambda x: round_even(least(x / refs[i], 1::DOUBLE) * 255, 0)::INT)) AS levels, vec_id % 10 / 10::DOUBLE AS start FROM r),
        w AS (SELECT *, start + 0.2::DOUBLE + vec_id % 14 / 10::DOUBLE AS stop FROM q),
        f AS (SELECT *, least(greatest(0, floor(start * {RATE} + 1e-9::DOUBLE)), 20)::INT AS k0 FROM w), e AS (SELECT *, least(greatest(k0 + 1, ceil(stop * {RATE} - 1e-9::DOUBLE)), 21)::INT AS k1 FROM f),
        o AS (SELECT *, list_transform(levels, lambda b: CASE WHEN k1 - k0 <= 5 THEN b[k0 + 1:k1] ELSE list_transform(range(5), lambda i: list_max(b[k0 + i * (k1 - k0) // 5 + 1:k0 + (i + 1) * (k1 - k0) // 5])) END) AS cut FROM e)
        SELECT vec_id, {_TEXT.format("levels")} AS levels, round(refs[1], 6) + 0.0::DOUBLE AS reference0, round(refs[2], 6) + 0.0::DOUBLE AS reference1, round(refs[3], 6) + 0.0::DOUBLE AS reference2,
            round(k0 / {RATE}::DOUBLE, 6) AS begin, round(k1 / {RATE}::DOUBLE, 6) AS "end", {_TEXT.format("cut")} AS points FROM o""",
    "print_places": f"""WITH {BIG}, s AS (SELECT path, duration - 40 + p_partkey % 7 / 4::DOUBLE AS seconds FROM big), r AS (SELECT *, CASE WHEN seconds > 100 THEN 30::DOUBLE ELSE 0::DOUBLE END AS skip FROM s),
        g AS (SELECT path, seconds - skip AS rest, skip, greatest(2.5::DOUBLE, floor((seconds - skip) / 24 / 0.5::DOUBLE) * 0.5::DOUBLE) AS step FROM r)
        SELECT path, CASE WHEN rest > 0 THEN skip END AS start, CASE WHEN rest > 0 THEN CASE WHEN rest < 60 THEN 0::DOUBLE ELSE step END END AS step,
            CASE WHEN rest > 0 THEN CASE WHEN rest < 60 THEN rest ELSE 2.5::DOUBLE END END AS length, CASE WHEN rest > 0 THEN CASE WHEN rest < 60 THEN 1 ELSE 24 END END AS n,
            CASE WHEN rest > 0 THEN CASE WHEN rest < 60 THEN skip ELSE skip + 23 * step END END AS last FROM g""",
}
