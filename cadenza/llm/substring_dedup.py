"""Substring dedup by De Bruijn compaction.

A window of 13 words is an edge of the De Bruijn graph of the corpus, from its first 12 words to
its last 12. A document is a walk. Words are removed where an edge of the walk also starts in a
document with a smaller id. Edges outnumber what can be shuffled, so walks are compacted first:

1. Each edge has a minimizer, the 5-gram of least hash in it (the leftmost in ties). Consecutive
   edges with one and the same minimizer make a path, 5 edges on average, with a hash of its
   contents. Equal edges have equal minimizers, so everything about an edge is known where the
   paths of its minimizer meet: this is one shuffle of paths, keyed by minimizer.
2. There, minimizers of one document go. Equal paths are one nonbranching path: its first document
   keeps it, in all others the whole path is a repeat, whatever else may hold its edges.
3. Only where a repeated minimizer has several different paths does the graph branch. Each of these
   paths' first occurrence is looked up at its source coordinates, and its edges are compared one by
   one.
4. Each document's repeated spans are merged from these coordinates and cut out of its words.

In each batch the second and further copies of a path, by ascending id, are repeats for certain; they
are dealt out evenly instead of by minimizer, so a passage that very many documents share reaches a
task once for each batch, not once for each document. Texts cross a shuffle compressed.

Hashes have 64 bits and are compared within one minimizer's group only, itself known by 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import staged, words
from cadenza.llm.shingles import U64, WordHashes, mixed, odd, windows, word_hashes

EDGE, MINIMIZER = 13, 5
SPAN = EDGE - MINIMIZER + 1
#: Documents whose paths are gathered at once.
GATHER = 2_000
#: Where an id is null: before all others.
NO_ID = -(2**63)
#: Coordinates hold 16 bits of a hash of the text above the word's place, to tell texts with one id apart.
PLACE_BITS = 40


def edges(h: np.ndarray) -> np.ndarray:
    return windows(h, EDGE, 13)


def paths(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, number of edges, minimizer and content hash of each path of a walk of word hashes."""
    n = len(h) - EDGE + 1
    if n < 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U64, U64))
    grams = windows(h, MINIMIZER, 5)
    least = grams[:n].copy()
    for i in range(1, SPAN):
        np.minimum(least, grams[i : i + n], out=least)
    place = np.empty(n, np.int64)
    at = np.arange(n)
    for i in reversed(range(SPAN)):
        np.copyto(place, at + i, where=grams[i : i + n] == least)
    starts = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
    sizes = np.diff(np.append(starts, n))
    within = at - np.repeat(starts, sizes)
    content = np.add.reduceat(edges(h) * odd(SPAN, 29)[within], starts)
    return starts, sizes, grams[place[starts]], mixed(content + sizes.astype(U64))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, part, text -> a row for each path: key, content, id, at (part and start), n, sure (a repeat for certain)."""
    known = WordHashes()
    for b in (x.slice(i, GATHER) for x in batches for i in range(0, x.num_rows, GATHER)):
        ids, parts = b.column("id").to_numpy(), b.column("part").to_numpy()
        texts = b.column("text")
        found: list[tuple[np.ndarray, ...]] = []
        for row in np.argsort(ids, kind="stable"):
            start, n, key, content = paths(word_hashes(texts[row].as_py(), known))
            found.append((np.full(len(start), ids[row]), start + (int(parts[row]) << PLACE_BITS), n, key, content))
        if not found:
            continue
        owner, at, n, key, content = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((np.arange(len(key)), content, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        first = owner[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else owner
        sure = np.zeros(len(order), bool)
        sure[order] = owner[order] > first
        key = np.where(sure, mixed(at.astype(U64) ^ (owner.astype(U64) << U64(20))), key)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(owner), pa.array(at), pa.array(n.astype(np.int32)), pa.array(sure)], ["key", "content", "id", "at", "n", "sure"]
        )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        packed = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("id"), b.column("part"), pa.array(packed, pa.binary())], ["doc_id", "id", "part", "packed"])


def _branch_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """packed, spans (at, n, key) -> a row for each edge of the spans: key, edge, id, at."""
    known, open_ = WordHashes(), zstandard.ZstdDecompressor()
    for b in batches:
        out: list[tuple[np.ndarray, ...]] = []
        for packed, spans, owner, part in zip(b.column("packed").to_pylist(), b.column("spans"), b.column("id").to_pylist(), b.column("part").to_pylist(), strict=True):
            e = edges(word_hashes(open_.decompress(packed).decode("utf-8", "surrogatepass"), known))
            at, n, key = (spans.values.field(i).to_numpy() for i in range(3))
            n = n.astype(np.int64)
            base = np.int64(part << PLACE_BITS)
            each = np.repeat(at - base, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(key, n), e[each].view(np.int64), np.full(len(each), owner), each + base))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["key", "edge", "id", "at"])


def removed_words(n_words: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which words are under an edge of the spans (starts of edges, numbers of edges)."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + sizes + EDGE - 1, -1)
    return np.cumsum(step[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """packed, spans -> n_words, n_removed, kept (the words that stay, joined by single spaces)."""
    open_ = zstandard.ZstdDecompressor()
    for b in batches:
        total, gone, kept = [], [], []
        for packed, spans, part in zip(b.column("packed").to_pylist(), b.column("spans"), b.column("part").to_pylist(), strict=True):
            found = open_.decompress(packed).split()
            total.append(len(found))
            if not spans.is_valid:
                gone.append(0)
            else:
                hit = removed_words(len(found), spans.values.field(0).to_numpy() - (part << PLACE_BITS), spans.values.field(1).to_numpy().astype(np.int64))
                found = [found[i] for i in np.flatnonzero(~hit)]
                gone.append(int(hit.sum()))
            kept.append(b" ".join(found))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def _keyed(docs: DataFrame) -> DataFrame:
    part = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2**16)).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), part.alias("part"), "text")


def _part() -> Column:
    return F.shiftright("at", PLACE_BITS).cast("int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """id, part, at, n: spans of edges that also start in a document with a smaller id."""
    keyed = _keyed(docs)
    walked = keyed.select("id", "part", "text").mapInArrow(_walk, "key bigint, content bigint, id bigint, at bigint, n int, sure boolean")
    meet, same = W.partitionBy("key"), W.partitionBy("key", "content")
    met = walked.withColumns({"first": F.min("id").over(same)}).withColumns(
        {"low": F.min("id").over(meet), "high": F.max("id").over(meet), "least": F.min("content").over(meet), "most": F.max("content").over(meet)}
    )
    repeat = F.col("sure") | (F.col("id") > F.col("first"))
    branch = ~F.col("sure") & (F.col("id") == F.col("first")) & (F.col("low") < F.col("high")) & (F.col("least") < F.col("most"))
    known = staged(met.where(repeat | branch).select("id", "at", "n", F.when(~repeat, F.col("key")).alias("key")), "substring-paths")

    wanted = known.where("key IS NOT NULL").groupBy("id", _part().alias("part")).agg(F.collect_list(F.struct("at", "n", "key")).alias("spans"))
    sources = _packed(keyed).join(wanted.withColumnsRenamed({"id": "of", "part": "of_part"}), (F.col("id") == F.col("of")) & (F.col("part") == F.col("of_part")))
    single = sources.select("id", "part", "packed", "spans").mapInArrow(_branch_edges, "key bigint, edge bigint, id bigint, at bigint")
    again = single.withColumn("first", F.min("id").over(W.partitionBy("key", "edge"))).where(F.col("id") > F.col("first"))
    spans = known.where("key IS NULL").select("id", "at", "n").unionByName(again.select("id", "at", F.lit(1).alias("n")))
    return spans.select("id", _part().alias("part"), "at", "n")


def _packed(keyed: DataFrame) -> DataFrame:
    return keyed.mapInArrow(_pack, "doc_id bigint, id bigint, part int, packed binary")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (UTF-8 of the kept words, joined by single spaces): one row for each row of ``docs``.

    Null and empty texts have no words; texts of fewer than 13 lose none. A null id comes before all
    others. Rows with equal ids never remove each other's words; equal rows get equal results. Other
    columns are ignored. An empty table gives an empty result.
    """
    spans = repeated_spans(docs).groupBy("id", "part").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    met = _packed(_keyed(docs)).join(spans.withColumnsRenamed({"id": "of", "part": "of_part"}), (F.col("id") == F.col("of")) & (F.col("part") == F.col("of_part")), "left")
    return met.select("doc_id", "part", "packed", "spans").mapInArrow(_cut, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")
