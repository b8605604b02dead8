"""Queries on playlist trees, listening sessions, lists from elsewhere, audits and rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import keys, rules
from cadenza.operators import audits, evaluation, export, identity, library, search, sessions, station, trees
from cadenza.plans import surrogate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each part; below a third of its number, the first three are roots."""
    i = F.col("p_partkey")
    return surrogate.table(spark, sf_dir, "part").select(i.alias("node"), F.when(i > 3, F.floor(i / 3)).alias("parent"), F.concat(F.lit("N"), i.cast("string")).alias("name"))


@query
def playlist_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's route from its root."""
    return trees.routes(_nodes(spark, sf_dir))


@query
def playlist_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the entries of each play list lead to; a line's part is its list, its supplier and order its entry."""
    l, i = surrogate.table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    tracks = surrogate.big_library(spark, sf_dir).where("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("string").alias("track_id"), F.col("path").alias("location"))
    number = i % 2000
    key = F.when(i % 3 == 0, F.upper(surrogate.item_columns(number)["path"])).when(i % 3 == 1, number.cast("string")).otherwise("")
    listed = l.select(F.col("l_partkey").alias("node"), F.col("l_linenumber").alias("place"), (i % 3 == 0).alias("by_location"), key.alias("key"))
    states = tracks.select("track_id", F.when(F.col("track_id").cast("int") % 7 == 0, "ambiguous").otherwise("ok").alias("state"))
    return trees.summary(trees.entries(listed, tracks), states)


@query
def merged_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over the same files; the second lacks some and has some twice."""
    lib, i = surrogate.big_library(spark, sf_dir), F.col("p_partkey")
    second = lib.where(i % 10 != 0).withColumn("n", F.explode(F.sequence(F.lit(1), F.when(i % 9 == 0, 2).otherwise(1))))
    return sessions.merged_agreement(lib.select("path", "key"), second.select("path", "agreement", F.lit("8A").alias("votes"))).select("path", "key", "agreement", "outcome")


def _funnelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = surrogate.measured(spark, sf_dir).withColumnRenamed("path", "measured_path")
    pairs, _ = evaluation.match_files(measured, surrogate.truth(spark, sf_dir), "measured_path", "location")
    return sessions.funnelled(evaluation.compared(pairs))


@query
def selection_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many matched files stay at each step, and how many names weren't matched, as they are ambiguous or have no truth."""
    measured = surrogate.measured(spark, sf_dir).withColumnRenamed("path", "measured_path")
    _, rest = evaluation.match_files(measured, surrogate.truth(spark, sf_dir), "measured_path", "location")
    stage = F.when(F.col("state") == "ambiguous", "ambiguous").when(F.col("state") == "only-measured", "without-truth")
    left = rest.select(stage.alias("stage")).where("stage IS NOT NULL")
    return _funnelled(spark, sf_dir).select("stage").unionByName(left).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query
def doubt_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measured files by agreement, whether their key is in doubt, and how right they are where there is a reference."""
    measured, truth = surrogate.measured(spark, sf_dir), surrogate.truth(spark, sf_dir)
    pairs, _ = evaluation.match_files(measured.withColumnRenamed("path", "measured_path"), truth, "measured_path", "location")
    out = evaluation.doubt_groups(measured, evaluation.compared(pairs), F.lower(F.regexp_extract("path", r"([^/]*)$", 1)))
    return out.select("agreement", "doubtful", "n", "n_ref", F.round("exact", 6).alias("exact"), F.round("compatible", 6).alias("compatible"))


@query
def stored_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, A1: each vector by the library's stored statistics, as the library itself has it."""
    lib = surrogate.library(spark, sf_dir)
    rows = library.standardised(lib.select("path", "embedding"), library.dimension_stats(lib))
    six = lambda c: F.round(c, 6) + F.lit(0.0)
    return rows.select("path", *(six(F.get("timbre", F.lit(i))).alias(f"v{i}") for i in (0, 31, 63)))


@query
def long_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether a part's upload says that it is the long edition of the part's song: plain, radio edits and remixes against four labels."""
    p, i = surrogate.table(spark, sf_dir, "part"), F.col("p_partkey")
    pick = lambda k, *texts: F.element_at(F.array(*map(F.lit, texts)), (k + 1).cast("int"))
    wanted = F.concat(F.lit("Song "), i.cast("string"), pick(i % 3, "", " (Radio Edit)", " (Omnya Remix)"))
    found = F.concat(F.lit("Song "), i.cast("string"), pick(F.floor(i / 3) % 4, " (Extended Mix)", " (Omnya Remix Extended)", " (Original Mix)", ""))
    rows = p.select(i.alias("part"), F.col("p_brand").alias("w_artist"), wanted.alias("w_title"), F.when(i % 7 == 0, "Someone Else").otherwise(F.col("p_brand")).alias("c_artist"), found.alias("c_title"))
    return identity.extended_of(identity.identified(identity.identified(rows, "w_"), "c_")).select("part", "w_title", "c_title", "extended")


@query
def genre_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many lines go with a genre that their order asks for, by genre or by title."""
    asked = F.element_at(F.array(*map(F.lit, ("genre 1", "GENRE", "title 1", "jazz"))), (F.col("crate_id") % 4 + 1).cast("int"))
    rows = surrogate.crate_items(spark, sf_dir).withColumn("asked", asked)
    return search.by_genre(rows, F.col("asked")).groupBy("asked", "likeness").agg(F.count(F.lit(1)).alias("n"))


@query
def listening_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 40 candidates, drawn by a hash, and whether their keys differ by mode only."""
    found = _funnelled(spark, sf_dir).where("stage = 'candidate'")
    return sessions.sampled(found, "measured_path", 40, 7).select("measured_path", "key_est", "key_ref", sessions.mode_error(F.col("key_est"), F.col("key_ref")).alias("mode_error"))


@query
def mode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of keys in use that share a tonic but not a mode."""
    k = surrogate.big_library(spark, sf_dir).select("key").distinct()
    pairs = k.join(F.broadcast(k.withColumnRenamed("key", "other")), F.col("key") != F.col("other"))  # 25 keys
    return pairs.where(sessions.mode_error(F.col("key"), F.col("other"))).select("key", "other", keys.classic(F.col("key")).alias("name"))


@query
def pending_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session of two passes over a sample has yet to do."""
    lib = surrogate.big_library(spark, sf_dir)
    wanted = sessions.sampled(lib, "path", 500, 11).select("path", "p_partkey", F.explode(F.array(F.lit("with-votes"), F.lit("without-votes"))).alias("label"))
    done = wanted.where("(p_partkey + length(label)) % 3 = 0").select("path", "label")
    return sessions.pending(wanted, done.unionByName(done), ["path", "label"]).select("label", "path")


@query
def vote_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the most frequent key among each order's lines, and its text."""
    l = surrogate.table(spark, sf_dir, "lineitem")
    votes = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.concat((F.col("l_suppkey") % 3 + 1).cast("string"), F.lit("A")))).alias("votes"))
    share = sessions.vote_share(F.col("votes"))
    text = rules.agreement_text(F.round(share * F.size("votes")).cast("int"), F.col("votes"))
    return votes.select("l_orderkey", F.round(share, 6).alias("share"), text.agreement.alias("agreement"), text.votes.alias("votes"))


@query
def worst_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty files of largest tempo error."""
    found = _funnelled(spark, sf_dir).withColumn("error", F.round("bpm_error_tolerant", 2))
    return sessions.worst(found, "error", "measured_path", 20).select("measured_path", "error")


@query
def station_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a service read, without the seed and without repeats, in order."""
    l, i = surrogate.table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    stream = F.struct((i % 7 == 0).alias("snipped"), F.struct(F.when(i % 4 == 0, "hls").otherwise("progressive").alias("protocol")).alias("format"))
    record = F.to_json(F.struct(
        F.when(i % 11 == 0, "playlist").otherwise("track").alias("kind"), i.alias("id"), F.when(i % 13 == 0, " ").otherwise(F.concat(F.lit(" title "), i.cast("string"))).alias("title"),
        F.when(i % 5 == 0, "BLOCK").when(i % 6 == 0, "SNIP").alias("policy"), (i * 100).alias("duration"), F.struct(F.array(stream).alias("transcodings")).alias("media"),
    ))
    rows = l.select(F.col("l_orderkey").alias("station"), (F.col("l_linenumber") * 1_000_000 + i).alias("place"), (F.col("l_orderkey") % 200).cast("string").alias("seed"), record.alias("record"))
    return station.others(station.tracks(rows), "station", "track_id", "place", "seed").select("station", "place", "track_id", "title", "duration", "playable", "preview")


@query
def station_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order for mixing for each fifth of the library's genres as if it were a station; every seventh item isn't analysed."""
    lib = surrogate.library(spark, sf_dir)
    items = lib.select((F.col("vec_id") % 40).alias("station"), F.col("vec_id").alias("position"), F.col("path").alias("track_id"), F.when(F.col("vec_id") % 7 != 0, F.col("bpm")).alias("bpm"), "key", F.col("energy_raw").alias("energy"), "artist", "duration", F.col("embedding").alias("timbre"))
    return station.mixing_order(items)


@query
def candidate_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pools in one, the first one that has a part gives it."""
    p, i = surrogate.table(spark, sf_dir, "part"), F.col("p_partkey")
    pools = [p.where(i % n == 0).select(i.alias("track_id"), F.lit(name).alias("source")) for n, name in ((5, "near"), (3, "genre"), (2, "tempo"))]
    return station.pooled(*pools)


@query
def reference_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which of two collections each path stands."""
    lib = surrogate.big_library(spark, sf_dir)
    return station.labelled(lib.where("p_partkey % 2 = 0"), lib.where("p_partkey % 3 = 0").select(F.upper("path").alias("path")), ("A", "B"))


@query
def artist_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a crate whose artist stood in the four before, by place and part: ``place`` is one number of both, which doesn't order parts from 1,000,000 on."""
    items = surrogate.crate_items(spark, sf_dir).withColumn("place", F.col("position") * 1_000_000 + F.col("part"))
    return audits.artist_repeats(items, "crate_id", ["position", "part"]).select("crate_id", "place", "repeated")


@query
def set_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in runs of ten as sets; the largest similarity to one before."""
    lib = surrogate.library(spark, sf_dir)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    steps = lib.select(F.floor(F.col("vec_id") / 10).alias("set_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double") / norm).alias("timbre"))
    return audits.redundancy(steps, "set_id", "vec_id").select("set_id", "vec_id", F.round("redundancy", 6).alias("redundancy"))


@query
def signal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as signals of 10 frames a second."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = surrogate.table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    after, line = audits.max_after(F.col("x"), 4), audits.line_maxima(F.col("x"), F.lit(0.2), F.lit(0.5), -0.1, 0.2, 10)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda t, v: t + v), 6)
    return rows.select("vec_id", total(after).alias("after"), F.size(line).alias("lines"), total(line).alias("line_sum"))


@query
def largest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest fifth of each supplier's lines, with ties."""
    l = surrogate.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("weight"))
    return audits.largest(l, "weight", 0.2, ["l_suppkey"])


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = surrogate.crate_items(spark, sf_dir).withColumn("mtime", F.col("part") % 4)
    lib, i = surrogate.big_library(spark, sf_dir), F.col("p_partkey")
    states = lib.where(i % 3 != 0).select("path", (i % 4 + F.when(i % 10 == 1, 1).otherwise(0)).alias("mtime"), F.when(i % 3 == 1, "analysed").otherwise("failed").alias("state"))
    return items, states


@query
def job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that a crate waits for, once."""
    return audits.queue(*_jobs(spark, sf_dir))


@query
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the files of each crate are."""
    return audits.progress(*_jobs(spark, sf_dir))


@query
def last_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest failures."""
    return audits.last_failures(_jobs(spark, sf_dir)[1]).select("path", "mtime")


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.crate_items(spark, sf_dir).withColumn("grade", F.element_at(F.array(*map(F.lit, "ABCDF")), (F.col("part") % 5 + 1).cast("int")))


@query
def crate_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: what each crate's play list includes, leaves out and warns of."""
    out = export.receipts(_graded(spark, sf_dir))
    return out.select("crate_id", "included", "excluded", F.array_join("low", "|").alias("low"), "seconds")


@query
def collection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each crate as a collection with marks and a play list, as a digest."""
    out = export.collections(surrogate.crate_items(spark, sf_dir), surrogate.marks(spark, sf_dir))
    return out.select("crate_id", F.length("xml").alias("chars"), F.sha2(F.col("xml").cast("binary"), 256).alias("sha"))


@query
def row_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break which rule."""
    i = F.col("p_partkey")
    agreement = F.when(i % 6 == 0, None).when(i % 6 == 1, "4/3").when(i % 6 == 2, "abc").otherwise("2/3")
    votes = F.when(i % 12 == 0, None).when(i % 6 == 5, "8A|3B").otherwise("8A|3B|9A")
    rating, reason = F.element_at(F.array(*map(F.lit, ("ok", "fair", "bad", "Bad"))), (i % 4 + 1).cast("int")), F.when(i % 8 == 2, " \n").when(i % 8 == 6, "harsh")
    found = surrogate.table(spark, sf_dir, "part").select(F.explode(F.array(F.struct(F.lit("agreement").alias("rule"), rules.agreement_fault(agreement, votes).alias("fault")), F.struct(F.lit("rating").alias("rule"), rules.rating_fault(rating, reason).alias("fault")))).alias("x"))
    return found.groupBy("x.rule", "x.fault").agg(F.count(F.lit(1)).alias("n"))


@query
def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts, states and texts of single rows."""
    i = F.col("p_partkey")
    path = F.concat(F.when(i % 3 == 0, "D:\\music\\").when(i % 3 == 1, "/lib//a/").otherwise("/library/../lib/"), i.cast("string"), F.when(i % 5 == 0, "/").otherwise(""))
    rows = surrogate.table(spark, sf_dir, "part").select(i, path.alias("path"), (10_000 + i % 12_000).alias("hz"))
    return rows.select(
        "p_partkey", rules.spectral_verdict(F.col("hz"), i % 2 == 0).alias("verdict"), rules.confined(F.col("path"), ("/lib", "D:/music")).alias("confined"), rules.posix_restored(F.col("path")).alias("restored"),
        rules.file_state(F.when(i % 9 == 0, " ").otherwise(F.col("path")), i % 4).alias("state"), rules.clean_name(F.when(i % 8 == 0, " \t").otherwise(F.concat(F.lit("a\tb "), i.cast("string")))).alias("name"),
        rules.curve_text((i % 100) / 64, i % 20).alias("curve"),
    )
