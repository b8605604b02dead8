"""Playlist trees out of XML collections, which are checked before anything is parsed.

A collection is one file, so one row and one value of a task; its size is checked before its content is read. A parse
gives rows, not a tree: nodes with their parents (``trees.routes`` finds the paths) and entries with their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.values import local_path

#: Bytes of a file at most.
LARGEST = 150 * 1024 * 1024
#: Names of what has none; the outermost folder's own name, which is no part of a path.
FOLDER, PLAYLIST, ROOT = "Folder", "Playlist", "ROOT"
PARSED = "path string, kind string, number int, parent int, place int, name string, by_location boolean, key string"
SCHEMA = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]]) for f in PARSED.split(", ")])
#: Rows after which a worker hands on what it has.
AT_ONCE = 10_000


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content (null for files over ``LARGEST``, which are never read) of XML files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    small = raw.where(F.col("length") <= LARGEST).select("path", "length", "content")
    large = raw.where(F.col("length") > LARGEST).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def refusal(content: Column, length: Column) -> Column:
    """Why a file is not parsed at all: empty, too-large, encoding, doctype; null if nothing is wrong so far."""
    head = F.hex(F.substring(content, 1, 2))
    # As Latin-1 each byte is a character, so markup of ASCII letters is found in any text.
    text = F.decode(content, "ISO-8859-1")
    nul = F.contains(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), F.lit("\x00"))
    return (
        F.when(F.coalesce(length, F.lit(0)) > LARGEST, "too-large")
        .when(content.isNull() | ~text.rlike(r"[^\x09-\x0D\x20]"), "empty")
        .when(head.isin("FFFE", "FEFF") | nul, "encoding")
        .when(F.contains(text, F.lit("<!DOCTYPE")) | F.contains(text, F.lit("<!ENTITY")), "doctype")
    )


def _parsed(content: bytes) -> list[tuple]:
    """Rows of one collection: kind (folder, playlist, entry), number, parent, place, name, by_location, key. A broken file is one refused row."""
    rows: list[tuple] = []
    open_nodes: list[tuple[int | None, str]] = []  # number (null for the root) and kind of the open nodes
    depth, outside, is_collection, entries = 0, 0, [False, False], {}

    def start(tag: str, found: dict) -> None:
        nonlocal depth, outside
        depth += 1
        is_collection[0] |= depth == 1 and tag == "DJ_PLAYLISTS"
        is_collection[1] |= depth == 2 and tag == "COLLECTION"
        if outside or (depth == 2 and tag != "PLAYLISTS") or (depth > 2 and tag not in ("NODE", "TRACK")):
            outside += 1
            return
        if depth < 3:
            return
        above, kind = open_nodes[-1] if open_nodes else (None, "top")
        if tag == "TRACK" and kind == "playlist":
            place = entries[above] = entries.get(above, -1) + 1
            rows.append(("entry", None, above, place, None, rows[above][5], found.get("Key", "")))
        elif tag == "NODE" and kind in ("top", "folder") and found.get("Type") in ("0", "1"):
            name = found.get("Name", "").strip()
            if found["Type"] == "0" and name == ROOT and above is None:
                open_nodes.append((None, "folder"))
                return
            rows.append(("folder" if found["Type"] == "0" else "playlist", len(rows), above, len(rows), name or (FOLDER if found["Type"] == "0" else PLAYLIST), found.get("KeyType") == "1", None))
            open_nodes.append((len(rows) - 1, rows[-1][0]))
        else:
            outside += 1

    def end(tag: str) -> None:
        nonlocal depth, outside
        depth -= 1
        if outside:
            outside -= 1
        elif depth >= 2 and tag == "NODE":
            open_nodes.pop()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(content, True)
    except expat.ExpatError:
        return [("refused", None, None, None, "broken", None, None)]
    return rows if all(is_collection) else [("refused", None, None, None, "no-collection", None, None)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``parsed``'s rows of batches (path, content, why): contents leave a batch one at a time, and rows go on ``AT_ONCE`` at a time, a file's together."""
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
    for batch in batches:
        out: list[tuple] = []
        for path, content, why in zip(*(batch.column(c) for c in ("path", "content", "why")), strict=True):
            rows = [("refused", None, None, None, why.as_py(), None, None)] if why.is_valid else _parsed(content.as_py())
            name = path.as_py()
            out.extend((name, *r) for r in rows)
            if len(out) >= AT_ONCE:
                yield pack(out)
                out = []
        if out:
            yield pack(out)


def parsed(blobs: DataFrame) -> DataFrame:
    """The rows of files (path, length, content): folder and playlist (number, parent, place, name), entry (parent, place, by_location, key), refused (name: why).

    A file that is refused gives that one row, and its content goes to no worker; one without playlists none. Numbers count within a file, in its order.
    A worker holds one Arrow batch of contents (64 MB by Spark's default, or one file if that is larger), not a partition's.
    """
    checked = blobs.select("path", "content", refusal(F.col("content"), F.col("length")).alias("why"))
    return checked.select("path", F.when(F.col("why").isNull(), F.col("content")).alias("content"), "why").mapInArrow(_rows, PARSED)


def _node(path: Column, number: Column) -> Column:
    return F.concat(path, F.lit("#"), number.cast("string"))


def nodes(rows: DataFrame) -> DataFrame:
    """node, parent, name, kind, place of ``parsed``'s folders and playlists, for ``trees.routes``."""
    kept = rows.where(F.col("kind").isin("folder", "playlist"))
    return kept.select(_node(F.col("path"), F.col("number")).alias("node"), _node(F.col("path"), F.col("parent")).alias("parent"), "name", "kind", "place")


def listed(rows: DataFrame) -> DataFrame:
    """node, place, by_location, key of ``parsed``'s entries, for ``trees.entries``; locations as local paths."""
    entries = rows.where("kind = 'entry'")
    key = F.when(F.col("by_location"), local_path(F.col("key"))).otherwise(F.trim("key"))
    return entries.select(_node(F.col("path"), F.col("parent")).alias("node"), "place", "by_location", key.alias("key"))


def refused(rows: DataFrame) -> DataFrame:
    """path, reason of files that weren't read."""
    return rows.where("kind = 'refused'").select("path", F.col("name").alias("reason"))
