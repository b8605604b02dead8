"""The library's registered queries, over tables made from the benchmark's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import keys, quality, tempo, text
from cadenza.functions.scoring import SetConfig, energy_target, reason
from cadenza.operators import bridge, crates, cues, duplicates, evaluation, export, identity, library, names, neighbours, resolve, saved, search, setbuilder, stats
from cadenza.plans import intake, kernels, measures, sessions, surrogate, upkeep, ways
from cadenza.sources import readers
from cadenza.sources.staging import staged
from cadenza.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = upkeep.QUERIES | measures.QUERIES | sessions.QUERIES | ways.QUERIES | kernels.QUERIES | intake.QUERIES


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def six(c: Column | str) -> Column:
    """Rounded, so that the order of additions doesn't show; no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_with_reasons(spark, sf_dir)


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.contextual(surrogate.library(spark, sf_dir))


@query
def nearest_with_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's ten nearest tracks by timbre (fragments can't be answers), and how they would mix."""
    lib = staged(context(spark, sf_dir), "library-context")
    near = neighbours.nearest(lib, lib.where(library.is_track(F.col("duration"))), 10)
    # Keys are parsed once for each item, not for each pair: the pairs' expressions stay small enough to be compiled.
    coded = staged(lib.select("path", "bpm", keys.code(F.col("key")).alias("code"), "energy"), "library-keys")
    a = coded.select(F.col("path").alias("seed"), F.col("bpm").alias("from_bpm"), F.col("code").alias("from_code"))
    b = coded.select("path", F.col("bpm").alias("to_bpm"), F.col("code").alias("to_code"), F.col("energy"))
    met = near.join(a, "seed").join(b, "path")
    m = tempo.score(F.col("from_bpm"), F.col("to_bpm")) * F.pow(keys.coded_compat(F.col("from_code"), F.col("to_code")), F.lit(keys.EXPONENT))
    return met.select("seed", "rank", "path", six("similarity").alias("similarity"), six("energy").alias("energy"), six(m).alias("mix"), keys.coded_relation(F.col("from_code"), F.col("to_code")).alias("relation"))


@query
def mixable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of the library within the gate, explained."""
    lib = surrogate.library(spark, sf_dir).select("path", "bpm", "key")
    return neighbours.mixable_explained(lib, six)


@query
def mixable_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items of the large library each one mixes with, and how well."""
    lib = surrogate.big_library(spark, sf_dir).select("path", "bpm", "key")
    return neighbours.mixable_degree(lib).select("from_path", "partners", six("best").alias("best"), six("mean").alias("mean"))


@query
def library_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large library with its energy percentile and display fields."""
    lib = stats.below_share(surrogate.big_library(spark, sf_dir), "energy_raw", "energy")
    c = F.col
    return lib.select("path", six("energy").alias("energy"), library.is_track(c("duration")).alias("track"), tempo.shown(c("bpm")).alias("shown_bpm"), text.label(c("artist"), c("title"), c("path")).alias("label"), text.clock(c("duration")).alias("clock"), keys.doubtful(c("agreement")).alias("doubtful"), text.opaque_id(c("path")).alias("id"))


@query
def key_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of keys that the library has."""
    k = surrogate.big_library(spark, sf_dir).select("key").distinct()
    a, b = k.withColumnRenamed("key", "a"), k.withColumnRenamed("key", "b")
    p = a.join(b)
    return p.select("a", "b", keys.relation(F.col("a"), F.col("b")).alias("relation"), keys.compat(F.col("a"), F.col("b")).alias("compat"), six(keys.factor(F.col("a"), F.col("b"))).alias("factor"), keys.steps(F.col("a"), F.col("b")).alias("steps"), keys.classic(F.col("a")).alias("classic"))


@query
def energy_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energy that each curve asks for at every place of the crates, taken as sets of so many items."""
    sets = surrogate.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("length"))
    n = sets.groupBy("length").agg(F.count(F.lit(1)).alias("sets")).withColumn("position", F.explode(F.sequence(F.lit(0), F.col("length") - 1)))
    return n.select("length", "position", "sets", *(six(energy_target(F.col("position"), F.col("length"), c)).alias(c) for c in ("peak", "warmup", "flat")))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _ = evaluation.match_files(surrogate.measured(spark, sf_dir), surrogate.truth(spark, sf_dir), "path", "location")
    return evaluation.compared(pairs)


@query
def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements against their truth, file by file."""
    return _compared(spark, sf_dir).select("file", "bpm_error", "bpm_error_tolerant", "bpm_class", "key_exact", "key_compatible", "unanimous")


@query
def evaluation_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names on one side only, or ambiguous."""
    return evaluation.match_files(surrogate.measured(spark, sf_dir), surrogate.truth(spark, sf_dir), "path", "location")[1]


@query
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: the contract's metrics."""
    m = evaluation.contract_metrics(_compared(spark, sf_dir))
    return m.select(six("bpm_error_p95").alias("bpm_error_p95"), six("key_exact").alias("key_exact"), six("key_compatible").alias("key_compatible"), "n_unanimous", "n_with_key", "n")


@query
def accuracy_by_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return evaluation.by_agreement(_compared(spark, sf_dir)).select("agreement", "n", six("exact").alias("exact"), six("compatible").alias("compatible"))


@query
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return evaluation.class_counts(_compared(spark, sf_dir))


@query
def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by confidence, and their correlation."""
    rows = _compared(spark, sf_dir)
    return evaluation.calibration(rows).select("bucket", "n", six("accuracy").alias("accuracy")).join(evaluation.confidence_correlation(rows).select(six("pearson").alias("pearson")))


@query
def threshold_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every threshold against what was measured."""
    m = evaluation.contract_metrics(_compared(spark, sf_dir))
    values = m.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("bpm_error_p95", "key_exact", "key_compatible")))))
    return evaluation.verdicts(values).select("metric", "op", "bound", six("value").alias("value"), "ok")


@query
def overall_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all thresholds that ``threshold_verdicts`` judges."""
    return evaluation.overall(threshold_verdicts(spark, sf_dir))


@query
def quality_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: a flag on short texts against the labels."""
    d, l = surrogate.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), surrogate.table(spark, sf_dir, "labels")
    rows = d.join(l, "doc_id", "left").select((F.col("n_chars") < 600).alias("flag"), (F.col("quality") == 0).alias("bad"))
    m = evaluation.confusion(rows, "flag", "bad")
    return m.select("tp", "fp", "tn", "fn", "unlabelled", six("precision").alias("precision"), six("recall").alias("recall"), six("accuracy").alias("accuracy"))


@query
def quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and grades, one line of the order table as one file."""
    l = surrogate.table(spark, sf_dir, "lineitem")
    rate = F.floor(F.col("l_quantity") * 8).cast("int")
    khz, wall = F.col("l_extendedprice") % 12000 / 1000 + 10, F.col("l_discount") * 400
    rows = l.select("l_orderkey", "l_linenumber", "l_partkey", rate.alias("rate"), khz.alias("khz"), wall.alias("wall"), (F.col("l_returnflag") == "A").alias("lossless"))
    c = F.col
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", quality.expected_cutoff(c("rate")).alias("expected"), quality.supported_rate(c("khz")).alias("supported"), quality.flag(c("khz"), c("wall"), c("rate"), c("lossless")).alias("flag"), quality.grade(F.when(c("lossless"), None).otherwise(c("rate")), c("khz") * 1000, c("wall") >= 25, F.when(c("lossless") & (c("l_linenumber") == 1), "FLAC")).alias("grade"))


@query
def crate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, S40."""
    return crates.crate_metrics(surrogate.crate_items(spark, sf_dir))


@query
def crate_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, M10."""
    return crates.crate_tempo(surrogate.crate_items(spark, sf_dir))


@query
def crate_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who enters a set of each genre of each crate, as counts."""
    s = staged(crates.eligibility_counts(upkeep.ordered_items(spark, sf_dir)), "crate-eligibility")
    return s.join(crates.can_build(s).select("crate_id", "ok"), "crate_id")


@query
def crate_shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and families by genre."""
    i = surrogate.crate_items(spark, sf_dir)
    return i.groupBy(text.genre_key(F.col("genre")).alias("genre")).agg(F.count(F.lit(1)).alias("items"), F.min(text.genre_family(F.col("genre"))).alias("family"))


@query
def genre_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does tempo rise with energy in a genre?"""
    lib = surrogate.library(spark, sf_dir).where(tempo.valid(F.col("bpm")))
    return stats.spearman(lib, ["genre"], "bpm", "energy_raw").select("genre", six("spearman").alias("spearman"))


@query
def tempo_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return stats.histogram(surrogate.big_library(spark, sf_dir), "bpm", 60.0, 200.0, 12)


@query
def mark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks by item."""
    s = cues.summary(surrogate.marks(spark, sf_dir))
    return s.select("path", "marks", F.array_join(F.col("pads").cast("array<string>"), ",").alias("pads"), "cues", "memories", "loops")


@query
def mark_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many marks break each rule."""
    v = cues.violations(surrogate.marks(spark, sf_dir), surrogate.big_library(spark, sf_dir))
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("marks"))


@query
def mark_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A30, M9."""
    s = cues.statistics(surrogate.marks(spark, sf_dir), surrogate.big_library(spark, sf_dir))
    return s.select("num", "n", six("low").alias("low"), six("middle").alias("middle"), six("high").alias("high"), "opening", "closing")


@query
def mark_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of items that the small library doesn't have."""
    return cues.orphans(surrogate.marks(spark, sf_dir), surrogate.library(spark, sf_dir))


@query
def mark_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the marks of orders with an odd number when they are merged into the others'."""
    m = surrogate.marks(spark, sf_dir).withColumn("odd", F.floor(F.col("mark_id") / 100) % 2 == 1)
    known, new = m.where("NOT odd").drop("odd"), m.where("odd").withColumn("seq", F.col("mark_id")).select("path", "seq", "kind", "num", "start_ms", "end_ms")
    out = cues.merged(known, new, surrogate.big_library(spark, sf_dir))
    return out.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("marks"))


@query
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with agreeing lengths and correlated prints."""
    lib = surrogate.library(spark, sf_dir).select("path", "duration", F.col("embedding").alias("print"))
    return duplicates.pairs(lib, 0.3).select("a", "b", six("similarity").alias("similarity"))


@query
def duplicate_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected pairs, and which copy stays."""
    lib = surrogate.library(spark, sf_dir)
    groups = duplicates.groups(duplicates.pairs(lib.select("path", "duration", F.col("embedding").alias("print")), 0.3))
    q = lib.select("path", (F.col("vec_id") % 80 / 10 + 14).alias("cutoff_khz"), (F.col("vec_id") % 3 == 0).alias("wall"), (F.col("vec_id") % 5 == 0).alias("lossless"), (F.col("vec_id") % 7 == 0).alias("referenced"))
    return duplicates.survivors(groups.join(q, "path")).select("path", "group", "members", six("least_similarity").alias("least_similarity"), "all_agree", "keep")


@query
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where written-down paths are now, by path, tail or name."""
    p, i = surrogate.table(spark, sf_dir, "part"), F.col("p_partkey")
    number = surrogate.padded(i, 5)
    files = p.select(F.concat(F.lit("/new/"), F.col("p_type"), F.lit("/"), F.col("p_brand"), F.lit("/t"), F.when(i % 10 == 0, "same").otherwise(number), F.lit(".mp3")).alias("path"))
    wanted = p.select(F.when(i % 3 == 0, F.concat(F.lit("C:\\old\\"), F.col("p_type"), F.lit("\\"), F.col("p_brand"), F.lit("\\t"), number, F.lit(".mp3"))).when(i % 3 == 1, F.concat(F.lit("/x/t"), number, F.lit(".mp3"))).otherwise(F.concat(F.lit("/y/"), F.col("p_brand"), F.lit("/tsame.mp3"))).alias("location"))
    return resolve.resolved(wanted, files)


@query
def name_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist and title of every file name."""
    return names.oriented(surrogate.file_names(spark, sf_dir)).select("path", "artist", "title", "orientation", "review")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in order, with tokens and their relevance to the order's least part name."""
    c = surrogate.candidates(spark, sf_dir)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("line", "supplier", "item_id", "source"))
    # Tokens come after the shuffle that ranks, so they are in none; a query's are those of its least text, so no text is taken apart twice.
    ranked = search.worded(c.withColumn("rank", rank))
    asked = F.min(F.struct(F.concat_ws(" ", "title", "artist").alias("text"), "tokens")).over(W.partitionBy("query_id"))
    return search.rated(ranked.withColumn("least", asked), F.col("least.tokens")).drop("least")


@query
def search_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each search's results."""
    return search.relevant(_results(spark, sf_dir)).select("query_id", "rank", "item_id", six("score").alias("score"))


@query
def search_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W14, T9."""
    return search.interleaved(_results(spark, sf_dir), ["video", "store", "stream"], 6).select("query_id", "place", "source", "item_id")


@query
def search_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13."""
    return search.diverse(_results(spark, sf_dir), 4).select("query_id", "place", "source", "item_id")


@query
def search_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of one track together."""
    return search.grouped(_results(spark, sf_dir)).select("query_id", "cluster", "item_id", "place")


@query
def similar_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large library's score against the item before it, by number."""
    lib = surrogate.big_library(spark, sf_dir)
    b = lib.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("bpm").alias("b"), F.col("key").alias("k"))
    met = lib.join(b, "p_partkey")
    return met.select("path", six(search.similar_score(F.col("bpm"), F.col("key"), F.col("b"), F.col("k"), F.col("p_partkey") % 2 == 0)).alias("score"))


@query
def popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A38, T4."""
    c = surrogate.table(spark, sf_dir, "orders")
    return c.select("o_orderkey", six(search.popularity(F.col("o_custkey") % 100, F.floor(F.col("o_totalprice") / 20), F.col("o_orderkey") % 1500, F.col("o_orderstatus") == "F")).alias("score"))


@query
def greedy_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of 20 from every item of the library."""
    lib = context(spark, sf_dir)
    out = setbuilder.build(lib.select("path"), lib, SetConfig())
    return out.select("seed", "position", "path", six("score").alias("score"), "stop")


@query
def set_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of all sets; none may be out of the gate."""
    lib = context(spark, sf_dir)
    m = setbuilder.transition_metrics(setbuilder.transitions(setbuilder.build(lib.select("path"), lib, SetConfig())))
    return m.select("n", "out", "clashes", six("out_percent").alias("out_percent"), six("clash_percent").alias("clash_percent"))


@query
def set_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each set follows its curve."""
    lib = context(spark, sf_dir)
    c = setbuilder.curve_metrics(setbuilder.build(lib.select("path"), lib, SetConfig()), 20)
    return c.select("seed", six("deviation").alias("deviation"), six("rising").alias("rising"))


@query
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest way from one item to another for each nation, over one or two others."""
    lib, n = surrogate.library(spark, sf_dir), F.col("n_nationkey")
    path = lambda i: F.concat(F.lit("/lib/"), surrogate.padded(i))
    pairs = surrogate.table(spark, sf_dir, "nation").select(path(n * 3 + 1).alias("start"), path(n * 7 + 120).alias("goal"))
    out = bridge.bridges(pairs, lib, 1, 2)
    return out.select("start", "goal", F.array_join("found", " ").alias("found"), six("cost").alias("cost"), six("direct").alias("direct"), "stop")


@query
def set_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extended M3U of each crate, as a digest."""
    i = surrogate.crate_items(spark, sf_dir).withColumn("energy", F.lit(0.5))
    p = export.playlists(i, "crate_id")
    return p.select("crate_id", F.length("text").cast("long").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query
def xml_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection elements."""
    return export.xml_tracks(surrogate.big_library(spark, sf_dir))


@query
def reconciled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on disk against the library."""
    lib, i = surrogate.big_library(spark, sf_dir), F.col("p_partkey")
    known = lib.where(i % 5 != 0).select("path", F.lit(1.0).alias("mtime"))
    disk = lib.where(i % 7 != 0).select("path", F.when(i % 3 == 0, 2.0).otherwise(1.0).alias("mtime"))
    return library.reconcile(disk, known, "/lib/")


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = surrogate.table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("/watch/"), (F.col("user_id") % 50).cast("string"), F.lit("/"), F.col("event_type"), F.lit(".wav")).alias("path"), F.floor(F.col("value") / 40).cast("long").alias("size"), F.timestamp_seconds(F.floor(surrogate.epoch(F.col("ts")) / 864000) * 864000).alias("mtime"), F.col("ts").alias("observed_at"))


@query
def stable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose last two observations agree."""
    return watch.stable(_observations(spark, sf_dir)).select("path", "size", F.unix_seconds("mtime").alias("mtime"))


@query
def pending_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready files that aren't processed yet, in batches without a name twice."""
    ready, now = watch.stable(_observations(spark, sf_dir)), F.timestamp_seconds(F.lit(1_706_000_000))
    done = ready.select("path", "size", "mtime").withColumn("failure", F.when(F.length("path") % 3 == 0, "io").when(F.length("path") % 3 == 1, "format")).where("size % 2 = 0")
    registry = watch.recorded(spark.createDataFrame([], watch.REGISTRY), done, F.timestamp_seconds(F.lit(1_705_999_000)))
    return watch.batched(watch.pending(ready, registry, now)).select("path", "batch")


@query
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition of our own: counts of events by hour and kind, as the stream would give them."""
    w = watch.windowed_counts(surrogate.table(spark, sf_dir, "events"))
    return w.select(surrogate.epoch(F.col("window_start")).alias("window_start"), "event_type", "events", six("total").alias("total"))


@query
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, language and first heading of every page."""
    return readers.html_fields(surrogate.table(spark, sf_dir, "pages"), {"lang": r'<html lang="([a-z]+)"', "title": r"<title>([^<]*)</title>", "heading": r"<h1>([^<]*)</h1>"})


@query
def step_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line on the step from each item of the large library to the next, and the pitch it needs."""
    lib = surrogate.big_library(spark, sf_dir)
    b = lib.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("bpm").alias("b"), F.col("key").alias("k")).where("b > 0")
    met = lib.where("bpm > 0").join(b, "p_partkey")
    c = F.col
    return met.select("path", F.regexp_replace(reason(c("bpm"), c("key"), c("b"), c("k")), r"^[^%]*% BPM", "").alias("reason"), six(tempo.pitch(c("bpm"), c("b"))).alias("pitch"), six(tempo.distance(c("bpm"), c("b"))).alias("distance"))


def _saved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as saved sets, and ratings of most of their transitions."""
    i = surrogate.crate_items(spark, sf_dir)
    place = F.row_number().over(W.partitionBy("crate_id").orderBy("position", "part", "file_ok", "bpm_source")) - 1
    steps = i.select(F.col("crate_id").alias("set_id"), place.alias("position"), "path", "bpm", "key")
    l = surrogate.table(spark, sf_dir, "lineitem")
    rating = F.when(F.col("l_returnflag") == "A", "ok").when(F.col("l_returnflag") == "N", "fair").otherwise("bad")
    ratings = l.where("l_linenumber % 2 = 1").groupBy(F.col("l_orderkey").alias("set_id"), F.lit(1).alias("transition")).agg(F.min(rating).alias("rating"))
    return steps, ratings


@query
def set_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many transitions of each saved set are rated, and how."""
    steps, ratings = _saved(spark, sf_dir)
    return saved.rating_summary(steps, ratings)


@query
def set_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved sets with what their library has lost."""
    steps, _ = _saved(spark, sf_dir)
    return saved.listing(steps, surrogate.big_library(spark, sf_dir).where("duration >= 90"))


@query
def identity_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which other part could be the same recording as each part, by name, version, guests and length."""
    p, i = surrogate.table(spark, sf_dir, "part"), F.col("p_partkey")
    title = F.concat("p_name", F.when(i % 4 == 0, " (Extended Mix)").when(i % 4 == 1, " (Radio Edit)").otherwise(""), F.when(i % 7 == 0, F.concat(F.lit(" (feat. "), "p_type", F.lit(")"))).otherwise(""))
    rows = identity.identified(p.select(i.alias("id"), F.col("p_brand").alias("artist"), title.alias("title"), (F.lit(200.0) + i % 50).alias("seconds")))
    return identity.matched(rows)
