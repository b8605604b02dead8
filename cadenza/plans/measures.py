"""Registered queries on signals and single values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import signal, values
from cadenza.plans import surrogate


def signal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key from the first twelve values of each embedding, taken as chroma, and features of all of them."""
    e = surrogate.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("y"))
    key = signal.detected_key(F.transform(F.slice("y", 1, 12), F.abs))
    rows = e.select("vec_id", key.alias("k"), signal.rms(F.col("y")).alias("rms"), F.get(signal.largest_by_bin(F.col("y"), 8), 2).alias("peak"), F.aggregate(signal.rises(F.col("y")), F.lit(0.0), lambda t, x: t + x).alias("rise"))
    return rows.select("vec_id", F.col("k.key").alias("key"), F.col("k.confidence").alias("confidence"), *(F.round(c, 6).alias(c) for c in ("rms", "peak", "rise")))


def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large library's values as they are shown."""
    c, i = F.col, F.col("p_partkey")
    lib = surrogate.big_library(spark, sf_dir)
    address = F.concat(F.lit("file://localhost/C:/a%20b+c/"), i.cast("string"), F.lit(".mp3"))
    return lib.select(
        "path", values.milliseconds(c("bpm") / 8).alias("ms"), values.seconds_shown(i * 250).alias("seconds"), values.percent_shown(i % 200 / 200).alias("percent"),
        values.mark_colour(F.when(i % 3 == 0, "memory").when(i % 3 == 1, "loop").otherwise("cue"), (i % 8).cast("int")).alias("colour"), values.step_line(i % 100, c("bpm"), c("key"), i % 200 / 200, c("title")).alias("line"),
        values.title_alone(F.concat(F.coalesce("artist", F.lit("x")), F.lit(" - "), "title"), F.coalesce("artist", F.lit(""))).alias("alone"), values.local_path(address).alias("local"),
        values.relative_path(F.concat(F.when(i % 4 == 0, "../").when(i % 4 == 1, "a\\./").otherwise("b//"), "title")).alias("relative"),
    )


QUERIES = {"signal_features": signal_features, "shown_values": shown_values}
