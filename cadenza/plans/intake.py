"""Registered queries on what comes in: playlist trees out of XML, typed names, byte ranges, batches tried alone; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import frames
from cadenza.operators import resolve, titles, trees
from cadenza.plans import surrogate
from cadenza.plans.oracle import BIG
from cadenza.sources import playlist_xml
from cadenza.sources.staging import staged
from cadenza.streaming import watch

#: Tasks that events are dealt over.
PARTS = 96


def xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection for each supplier: a folder for its nation in one for its region, and a playlist of the parts of its lines.

    Suppliers by number: every seventh is cut off, every eleventh has a document type, every thirteenth another encoding, every seventeenth is empty.
    """
    s, n, r = (surrogate.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    lines = surrogate.table(spark, sf_dir, "lineitem")
    i = F.col("s_suppkey")
    # By number and, for even suppliers, by location.
    key = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("file://localhost/C:/a%20b/"), F.col("l_partkey"), F.lit(".mp3"))).otherwise(F.col("l_partkey").cast("string"))
    entry = F.struct("l_orderkey", "l_linenumber", F.concat(F.lit('<TRACK Key="'), key, F.lit('"/>')).alias("x"))
    entries = lines.groupBy("l_suppkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e.x), "").alias("entries"))
    met = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(entries, i == F.col("l_suppkey"))
    folder = lambda name, inner: F.concat(F.lit('<NODE Type="0" Name="'), name, F.lit('">'), inner, F.lit("</NODE>"))
    playlist = F.concat(F.lit('<NODE Name=" List &amp; '), i, F.lit(' " Type="1" KeyType="'), (1 - i % 2), F.lit('">'), "entries", F.lit("</NODE>"))
    odd = F.lit('<NODE Type="7" Name="odd"><NODE Type="1" Name="inside"/></NODE><NODE Type="1" Name=""/>')
    tree = folder(F.lit("ROOT"), F.concat(folder(F.col("r_name"), folder(F.col("n_name"), F.concat(odd, playlist)))))
    whole = F.concat(F.when(i % 11 == 0, "<!DOCTYPE x>").otherwise(""), F.lit('<DJ_PLAYLISTS Version="1.0.0"><COLLECTION Entries="1"><TRACK TrackID="1" Name="x"/></COLLECTION><PLAYLISTS>'), tree, F.lit("</PLAYLISTS></DJ_PLAYLISTS>"))
    text = F.when(i % 17 == 0, "  \n").when(i % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 9)).otherwise(whole)
    content = F.when(i % 13 == 0, F.encode(text, "UTF-16")).otherwise(text.cast("binary"))
    return met.select(F.concat(F.lit("c"), i, F.lit(".xml")).alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))


def xml_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The playlists of collection files by their folders, with their entries by number and by location; or why a file is refused."""
    rows = staged(playlist_xml.parsed(xml_files(spark, sf_dir)), "xml-rows")
    nodes = playlist_xml.nodes(rows)
    listed = playlist_xml.listed(rows).groupBy("node").agg(F.count(F.lit(1)).alias("entries"), F.max_by("key", "place").alias("last"))
    lists = nodes.where("kind = 'playlist'").join(trees.routes(nodes.select("node", "parent", "name")), "node").join(listed, "node", "left")
    found = lists.select(F.regexp_extract("node", "^(.*)#", 1).alias("path"), "route", F.coalesce("entries", F.lit(0)).cast("long").alias("entries"), "last", F.lit(None).cast("string").alias("reason"))
    gone = playlist_xml.refused(rows).select("path", F.lit(None).cast("string").alias("route"), F.lit(0).cast("long").alias("entries"), F.lit(None).cast("string").alias("last"), "reason")
    return found.unionByName(gone)


def typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as orders' customers would type them, and which items of the large library they mean."""
    o = surrogate.table(spark, sf_dir, "orders")
    c = F.col("o_custkey")
    text = (
        F.when(c % 5 == 0, F.concat(F.lit("/lib/"), surrogate.padded(c)))
        .when(c % 5 == 1, F.concat(F.lit("TITLE "), c.cast("string")))
        .when(c % 5 == 2, F.concat(F.lit("Artist_"), (c % 40).cast("string"), F.lit(" — Title "), (c % 1000).cast("string")))
        .when(c % 5 == 3, F.concat(F.lit("e "), (c % 30).cast("string")))
        .otherwise(F.concat(F.lit("nobody "), c.cast("string")))
    )
    return resolve.typed(o.select(text.alias("asked")), surrogate.big_library(spark, sf_dir).select("path", "artist", "title"))


def title_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of the parts' songs in six layouts: each reading, the song that it finds, and how many texts a catalogue is asked."""
    p, i = surrogate.table(spark, sf_dir, "part"), F.col("p_partkey")
    songs = p.select(i.alias("song"), F.concat(F.lit("Band "), F.char(F.lit(65) + i % 20), F.lit("x")).alias("who"), F.concat(F.lit("Song "), (i + 100_000).cast("string")).alias("what"))  # a number that is no year
    who, what, layout = F.col("who"), F.col("what"), F.col("song") % 6
    title = (
        F.when(layout == 0, F.concat(who, F.lit(" - "), what, F.lit(" (Official Video)")))
        .when(layout == 1, F.concat(what, F.lit(" - "), who))
        .when(layout == 2, F.concat(who, F.lit("「"), what, F.lit("」")))
        .when(layout == 3, F.concat(who, F.lit(" | "), what, F.lit(" [Drumcode]")))
        .when(layout == 4, F.concat(F.lit("07. "), what))
        .otherwise(F.concat(who, F.lit(" - "), what, F.lit(" // CLIP")))
    )
    uploader = F.when(layout == 1, F.concat(who, F.lit(" - Topic"))).when(layout == 4, F.concat(who, F.lit("VEVO"))).otherwise("some channel")
    read = titles.readings(songs.select("song", title.alias("title"), uploader.alias("uploader")))
    each = read.select("song", F.posexplode("readings").alias("place", "r")).select("song", "place", "r.how", titles.artist_text(F.col("r.artist")).alias("artist"), "r.title")
    asks = F.size(titles.search_texts(F.col("artist"), F.lower("title"), F.lit(None).cast("string"), titles.other_titles(F.col("title"))))
    known = songs.select(F.col("song").alias("found"), "who", "what")
    return each.withColumn("asks", asks).join(known, (F.col("artist") == F.col("who")) & (F.col("title") == F.col("what")), "left").select("song", "place", "how", "artist", "title", "found", "asks")


def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bytes of the large library's files hold their middle."""
    rows = surrogate.big_library(spark, sf_dir).withColumn("size", F.when(F.col("p_partkey") % 41 == 0, None).otherwise(F.col("p_partkey") * 7919 % 9_000_000 + 1_000))
    return rows.withColumn("r", frames.middle_range(F.col("duration"), F.col("size"))).select("path", "r.first", "r.last", "r.start", "r.length")


def first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the frames of streams begin that are made for each event: bytes of no frame, single headers, then frames of several rates."""
    # A stream is hundreds of times as large as the row that it is made of, so the rows of a small file are dealt out.
    e = surrogate.table(spark, sf_dir, "events").select("event_id").repartition(PARTS, "event_id")
    i = F.col("event_id")
    zeros = lambda n: F.repeat(F.lit("00"), n)
    frame = lambda header, n: F.concat(F.lit(header), zeros(F.lit(n - 4)))
    junk = F.concat(zeros((i % 90).cast("int")), F.when(i % 4 == 0, frame("FFFB9000", 300)).otherwise(""))
    chain = F.when(i % 5 == 0, F.concat(frame("FFFB9000", 417), frame("FFFB9000", 417))).otherwise(F.concat(frame("FFFB9200", 418), frame("FFFB5400", 192), frame("FFFAE800", 1440)))
    return e.select("event_id", frames.first_frames(F.unhex(F.concat(junk, chain))).alias("at"))


def single_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle in which the batches that hold a bad file fail, and what the next cycle tries, first of all the files of these."""
    i = F.col("p_partkey")
    at = lambda s: F.timestamp_seconds(F.lit(1_706_000_000 + s))
    files = surrogate.big_library(spark, sf_dir).select("path", (i % 1000 + 1).cast("long").alias("size"), F.timestamp_seconds(F.lit(1_700_000_000) + i).alias("mtime"))
    bad = F.pmod(F.substring("path", -3, 3).cast("int"), F.lit(37)) == 0
    registry, cycle = spark.createDataFrame([], watch.REGISTRY), None
    for number in range(2):
        cycle = watch.planned(watch.pending(files, registry, at(number * 60)), registry, per_cycle=200)
        outcomes = cycle.groupBy("batch").agg(F.bool_or(bad).alias("_bad")).select("batch", F.when(F.col("_bad"), "io").alias("failure"))
        registry = watch.settled(registry, cycle, outcomes, cycle.select("path", F.lit(None).cast("string").alias("failure")), at(number * 60))
    return registry.join(cycle.select("path", "alone"), "path", "left").select("path", "state", "attempts", F.coalesce("alone", F.lit(False)).alias("alone"), F.unix_seconds("next_attempt").alias("next_attempt"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (xml_trees, typed_names, title_readings, byte_ranges, first_frames, single_retries)}
SQL = {
    "xml_trees": """WITH l AS (SELECT l_suppkey, count(*) AS entries, arg_max(l_partkey, (l_orderkey, l_linenumber, l_partkey::VARCHAR)) AS last FROM lineitem GROUP BY ALL),
        s AS (SELECT s_suppkey AS i, 'c' || s_suppkey || '.xml' AS path, r_name || ' / ' || n_name AS folder, entries, CASE WHEN s_suppkey % 2 = 0 THEN 'C:/a b/' || last || '.mp3' ELSE last::VARCHAR END AS last,
            CASE WHEN s_suppkey % 13 = 0 THEN 'encoding' WHEN s_suppkey % 17 = 0 THEN 'empty' WHEN s_suppkey % 11 = 0 THEN 'doctype' WHEN s_suppkey % 7 = 0 THEN 'broken' END AS reason
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN l ON l_suppkey = s_suppkey)
        SELECT path, folder || ' / List & ' || i AS route, entries, last, NULL::VARCHAR AS reason FROM s WHERE reason IS NULL
        UNION ALL SELECT path, folder || ' / Playlist', 0, NULL, NULL FROM s WHERE reason IS NULL UNION ALL SELECT path, NULL, 0, NULL, reason FROM s WHERE reason IS NOT NULL""",
    "typed_names": f"""WITH {BIG}, t AS (SELECT DISTINCT CASE o_custkey % 5 WHEN 0 THEN '/lib/' || printf('%06d', o_custkey) WHEN 1 THEN 'TITLE ' || o_custkey WHEN 2 THEN 'Artist_' || (o_custkey % 40) || ' — Title ' || (o_custkey % 1000)
            WHEN 3 THEN 'e ' || (o_custkey % 30) ELSE 'nobody ' || o_custkey END AS asked FROM orders),
        w AS (SELECT asked, path FROM t JOIN big ON asked = path),
        m AS (SELECT asked, path FROM (SELECT * FROM t ANTI JOIN w USING (asked)) JOIN big ON contains(lower(substr(path, 6)), lower(asked)) OR contains(lower(CASE WHEN artist IS NULL THEN title ELSE artist || ' — ' || title END), lower(asked))),
        n AS (SELECT asked, count(*) AS n FROM m GROUP BY asked)
        SELECT asked, 'path' AS outcome, 1 AS n, path FROM w UNION ALL SELECT asked, CASE WHEN n = 1 THEN 'one' ELSE 'several' END, n, path FROM m JOIN n USING (asked)
        UNION ALL SELECT asked, 'none', 0, NULL FROM t ANTI JOIN w USING (asked) ANTI JOIN n USING (asked)""",
    "title_readings": """WITH s AS (SELECT p_partkey AS song, 'Band ' || chr((65 + p_partkey % 20)::INT) || 'x' AS who, 'Song ' || (p_partkey + 100000) AS what FROM part)
        SELECT song, 0 AS place, ['sides', 'turned', 'quoted', 'bars', 'uploader', 'sides'][song % 6 + 1] AS how, who AS artist, what AS title, song AS found, 2 AS asks FROM s
        UNION ALL SELECT song, 1, 'swapped', what, who, NULL, 2 FROM s WHERE song % 6 IN (0, 5)""",
    "byte_ranges": f"""WITH {BIG}, s AS (SELECT path, duration, CASE WHEN p_partkey % 41 <> 0 THEN p_partkey * 7919 % 9000000 + 1000 END AS size FROM big), r AS (SELECT *, size / duration AS rate, greatest(0::DOUBLE, duration / 2 - 70) AS start FROM s),
        f AS (SELECT *, floor(start * rate)::BIGINT AS first, size > 0 AND duration > 150 AS cut FROM r)
        SELECT path, CASE WHEN cut THEN first END AS first, CASE WHEN cut THEN least(size - 1, floor(first + 140::DOUBLE * rate)::BIGINT) END AS last, CASE WHEN cut THEN start END AS start, CASE WHEN cut THEN 140::DOUBLE END AS length FROM f""",
    "single_retries": f"""WITH {BIG}, r AS (SELECT path, row_number() OVER (ORDER BY path) AS r, right(path, 3)::INT % 37 = 0 AS bad FROM big),
        a AS (SELECT *, (r - 1) // 8 AS batch, bool_or(bad) OVER (PARTITION BY (r - 1) // 8) AS failed FROM r WHERE r <= 200),
        n AS (SELECT count(*) FILTER (failed) AS n FROM a),
        b AS (SELECT path, bad, row_number() OVER (ORDER BY path) AS k, n FROM r, n WHERE r > 200 QUALIFY k <= 200 - n), c AS (SELECT *, bool_or(bad) OVER (PARTITION BY (k - 1) // 8) AS failed FROM b)
        SELECT path, CASE WHEN failed AND bad THEN 'failed' ELSE 'done' END AS state, CASE WHEN failed AND bad THEN 1 ELSE 0 END AS attempts, failed AS alone, CASE WHEN failed AND bad THEN 1706000180 END AS next_attempt FROM a
        UNION ALL SELECT path, CASE WHEN failed THEN 'alone' ELSE 'done' END, 0, false, NULL FROM c""",
    "first_frames": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id % 90 + CASE WHEN event_id % 4 = 0 THEN 300 ELSE 0 END END AS at FROM events""",
}
