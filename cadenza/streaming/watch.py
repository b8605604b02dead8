"""Watching a folder: observations stream in, and a registry says what is ready to be processed.

A file is ready when two observations in a row agree in size and time, and it is new, changed, or its
last failure may be tried again. The registry is a Parquet table in versions, one for each batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.operators.stats import before
from cadenza.sources.staging import staged

TRANSIENT = ("timeout", "io", "system")
BASE_SECONDS, ATTEMPTS = 120, 3
BATCH = 8
REGISTRY = "path string, size bigint, mtime timestamp, state string, attempts int, next_attempt timestamp"
#: Files of a cycle at most. State "alone": a batch of the file failed, and it is to be tried by itself.
PER_CYCLE = 40


def stable(observations: DataFrame) -> DataFrame:
    """The last observation (path, size, mtime, observed_at) of each path whose one before agrees with it."""
    by = W.partitionBy("path").orderBy("observed_at", "mtime", "size")
    seen = observations.withColumns({"_size": F.lag("size").over(by), "_mtime": F.lag("mtime").over(by), "_last": F.lead("observed_at").over(by).isNull()})
    return seen.where((F.col("_last")) & (F.col("size") > 0) & (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))).drop("_size", "_mtime", "_last")


def next_attempt(kind: Column, attempts: Column, now: Column) -> Column:
    """When to try again after the n-th failure with the same content; null for never."""
    wait = F.make_dt_interval(secs=(F.lit(BASE_SECONDS) * F.pow(F.lit(2.0), attempts - 1)).cast("decimal(18,6)"))
    return F.when(kind.isin(*TRANSIENT) & (attempts < ATTEMPTS), now + wait)


def pending(ready: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """Ready files that the registry doesn't have, has with other content, has as a failure that is due, or to be tried alone."""
    known = registry.select("path", *(F.col(c).alias(f"_{c}") for c in ("size", "mtime", "state", "next_attempt")))
    met = ready.join(known, "path", "left")
    changed = (F.col("size") != F.col("_size")) | (F.col("mtime") != F.col("_mtime"))
    due = (F.col("_state") == "alone") | ((F.col("_state") == "failed") & (F.col("_next_attempt") <= now))
    return met.where(F.col("_state").isNull() | changed | F.coalesce(due, F.lit(False))).select(*ready.columns)


def batched(files: DataFrame, limit: int = BATCH) -> DataFrame:
    """Adds batch: files of one name never share one; within these rounds, ``limit`` in order of path."""
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    round_ = F.row_number().over(W.partitionBy(name).orderBy("path")) - 1
    placed = before(files.withColumn("_round", round_), ["_round"], ["path"], F.lit(1), "_before")
    return placed.select(*files.columns, F.concat_ws("-", "_round", F.floor(F.col("_before") / limit)).alias("batch"))


def recorded(registry: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The registry after results (path, size, mtime, failure: its kind or null)."""
    old = registry.select("path", *(F.col(c).alias(f"_{c}") for c in ("size", "mtime", "attempts")))
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    attempts = F.when(F.col("failure").isNotNull(), F.when(same, F.coalesce("_attempts", F.lit(0))).otherwise(0) + 1).otherwise(0)
    new = results.join(old, "path", "left").withColumn("attempts", attempts.cast("int"))
    new = new.select("path", "size", "mtime", F.when(F.col("failure").isNull(), "done").otherwise("failed").alias("state"), "attempts", next_attempt(F.col("failure"), F.col("attempts"), now).alias("next_attempt"))
    return registry.join(new.select("path"), "path", "left_anti").select(*new.columns).unionByName(new)


def planned(files: DataFrame, registry: DataFrame, per_cycle: int = PER_CYCLE, limit: int = BATCH) -> DataFrame:
    """Adds alone and batch to the first ``per_cycle`` of ``files`` (pending ones): those that are to be tried alone come first, each its own batch."""
    single = registry.where("state = 'alone'").select(F.col("path").alias("_single"))
    met = files.join(single, F.col("path") == F.col("_single"), "left").withColumn("alone", F.col("_single").isNotNull()).drop("_single")
    first = staged(met.orderBy(F.col("alone").desc(), "path").limit(per_cycle), "watch-planned")
    own = first.where("alone").withColumn("batch", F.concat(F.lit("alone-"), "path"))
    return own.unionByName(batched(first.where("NOT alone"), limit))


def settled(registry: DataFrame, tried: DataFrame, outcomes: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """The registry after a cycle: ``tried`` (path, size, mtime, batch), ``outcomes`` (batch, failure: its kind or null), ``rows`` (path, failure) of finished batches.

    A failed batch of several files says nothing of any of them: they are to be tried alone, without an attempt counted. A
    failed batch of one file is that file's failure, and so is a finished batch that has no row of a file (kind "pipeline").
    A batch without an outcome was cut off, and leaves no trace.
    """
    sizes = tried.groupBy("batch").agg(F.count(F.lit(1)).alias("_files"))
    known = tried.select("path", "size", "mtime", "batch").join(outcomes.select("batch", F.col("failure").alias("_batch")), "batch").join(sizes, "batch")
    known = known.join(rows.select("path", F.col("failure").alias("_row"), F.lit(True).alias("_there")), "path", "left")
    shared = F.col("_batch").isNotNull() & (F.col("_files") > 1)
    own = known.where(~shared).withColumn("failure", F.when(F.col("_batch").isNotNull(), F.col("_batch")).when(F.col("_there").isNull(), "pipeline").otherwise(F.col("_row")))
    waiting = known.where(shared)
    # A file's attempts with the same content are kept.
    old = registry.select("path", *(F.col(c).alias(f"_{c}") for c in ("size", "mtime", "attempts")))
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    alone = waiting.join(old, "path", "left").select("path", "size", "mtime", F.lit("alone").alias("state"), F.when(same, F.coalesce("_attempts", F.lit(0))).otherwise(0).cast("int").alias("attempts"), F.lit(None).cast("timestamp").alias("next_attempt"))
    after = recorded(registry, own.select("path", "size", "mtime", "failure"), now)
    return after.join(waiting.select("path"), "path", "left_anti").unionByName(alone)


def status(registry: DataFrame, now: Column) -> DataFrame:
    """state, files, due of the registry."""
    return registry.groupBy("state").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("next_attempt") <= now).alias("due"))


def latest(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame:
    """The registry's last complete version, of those numbered below ``below``; empty if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [f.getPath() for f in fs.listStatus(hadoop) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if fs.exists(hadoop) else []
    number = lambda p: int(p.getName().split("=")[1])
    versions = sorted((p for p in done if below is None or number(p) < below), key=number)
    return spark.read.schema(REGISTRY).parquet(versions[-1].toString()) if versions else spark.createDataFrame([], REGISTRY)


def watch(observations: DataFrame, registry: str, process: Callable[[DataFrame], DataFrame], checkpoint: str, now: Callable[[], Column] = F.current_timestamp) -> StreamingQuery:
    """Runs ``process`` (files -> path, failure) over what each batch of a stream of observations makes ready.

    A batch that is run again after a crash writes the same version of the registry again.
    """

    def cycle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest(spark, registry, number)
        ready = pending(stable(batch), before, now())
        results = ready.join(process(ready), "path").select("path", "size", "mtime", "failure")
        recorded(before, results, now()).write.mode("overwrite").parquet(f"{registry}/version={number}")

    return observations.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_batches(
    observations: DataFrame,
    registry: str,
    process: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    checkpoint: str,
    now: Callable[[], Column] = F.current_timestamp,
    per_cycle: int = PER_CYCLE,
    limit: int = BATCH,
) -> StreamingQuery:
    """Like ``watch``, in batches of files: ``process`` gives (batch, failure) of the batches of ``planned`` and (path, failure) of their files.

    One bad file fails its batch once; then the batch's files come back one by one, ahead of others, so all but the bad one get
    done. A cycle reads the versions before its own number only, so one that is run again after a crash does the same again.
    """

    def cycle(batch: DataFrame, number: int) -> None:
        before = latest(batch.sparkSession, registry, number)
        plan = staged(planned(pending(stable(batch), before, now()), before, per_cycle, limit), "watch-batches")
        outcomes, rows = process(plan)
        settled(before, plan, outcomes, rows, now()).write.mode("overwrite").parquet(f"{registry}/version={number}")

    return observations.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """window_start, event_type, events, total: a count of a stream by time and kind, late rows up to ``late``; an addition of our own."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "events", "total")
