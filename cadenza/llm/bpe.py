"""Byte-level BPE by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. Each chunk is pre-tokenised on its own,
in parallel. The first boundaries of a chunk may be wrong, as it may start inside a pre-token; but
a pre-token depends only on the text from its start on, so from the first boundary that two
neighbouring chunks share, all boundaries are right. There the chunks are stitched, and the pieces
between are encoded, again in parallel. If two neighbours have no common boundary (a pre-token is
longer than the overlap), the rest of the text from the earlier one on is one piece. Decoding
concatenates the raw bytes of the ids.

Shorter texts are one piece. Their rows never leave their partition.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Code points of a chunk, and of what it shares with the next.
CHUNK, OVERLAP = 32_768, 2_048
#: Boundaries this near to a chunk's end may depend on what comes after it.
MARGIN = 8
#: Texts that are handled at once in a task.
AT_ONCE = 1_000
PIECES = "doc_id bigint, key string, piece bigint, ids binary"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """The tiktoken encoding of a ranks file: the kernel that merges bytes of one pre-token."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def vocabulary(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids one after another, and each id's start and length there."""
    with open(ranks_path, "rb") as file:
        by_id = {int(b): base64.b64decode(a) for a, b in map(bytes.split, file)}
    lengths = np.zeros(max(by_id) + 1, np.int64)
    lengths[list(by_id)] = [len(x) for x in by_id.values()]
    starts = np.cumsum(lengths) - lengths
    return np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8), starts, lengths


def ranks_file(ranks: str) -> str:
    """A name of the public tokenizers, or a path, as a path on this machine."""
    import public_tokenizers

    return ranks if "/" in ranks else public_tokenizers.path(ranks)


def encode_piece(text: str, ranks: str) -> np.ndarray:
    return encoder(ranks_file(ranks)).encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


def decode(ids: np.ndarray, ranks: str) -> bytes:
    """The bytes of ids, concatenated."""
    buffer, starts, lengths = vocabulary(ranks_file(ranks))
    n = lengths[ids]
    ends = np.cumsum(n)
    if not len(ids):
        return b""
    return buffer[np.repeat(starts[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE))


def _pieces(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    """doc_id, key, piece, text -> doc_id, key, piece, ids as little-endian 32-bit integers."""
    for batch in few(batches):
        ids = [encode_piece(t or "", ranks).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("piece"), pa.array(ids, pa.binary())], ["doc_id", "key", "piece", "ids"])


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each chunk its boundaries, in the text's positions, near its start and near its end."""
    import public_tokenizers
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    for batch in batches:
        heads, tails = [], []
        for text, start in zip(batch.column("text").to_pylist(), batch.column("start").to_pylist(), strict=True):
            at = np.array([m.start() for m in pattern.finditer(text)], np.int64)
            heads.append(start + at[at <= OVERLAP - MARGIN])
            tails.append(start + at[(at >= CHUNK) & (at <= len(text) - MARGIN)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*batch.schema.names, "heads", "tails"])


def stitched(long: DataFrame) -> DataFrame:
    """(doc_id, key, text) of texts longer than a chunk -> doc_id, key, piece, text: pieces between sure boundaries.

    Chunk c covers [c * CHUNK, (c + 1) * CHUNK + OVERLAP). It gives the text from its first to its
    next neighbour's first common boundary.
    """
    chunks = long.withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("int"))))
    chunks = chunks.select("doc_id", "key", "c", (F.col("c") * CHUNK).cast("long").alias("start"), F.substring(F.col("text"), F.col("c") * CHUNK + 1, F.lit(CHUNK + OVERLAP)).alias("text"))
    spread = chunks.repartition("key", "c")
    scanned = spread.mapInArrow(_boundaries, "doc_id bigint, key string, c int, start bigint, text string, heads array<bigint>, tails array<bigint>")
    by = W.partitionBy("key").orderBy("c")
    common = F.array_min(F.array_intersect("heads", F.lag("tails").over(by)))
    met = scanned.withColumn("sync", F.when(F.col("c") == 0, F.lit(0).cast("long")).otherwise(common))
    # A chunk without a common boundary, and all after it (nothing vouches for theirs), join the piece before.
    upto = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    met = met.withColumn("sync", F.when(F.count(F.when(F.col("sync").isNull(), 1)).over(upto) == 0, F.col("sync")))
    met = met.withColumn("piece", F.count("sync").over(upto)).withColumn("next_sync", F.lead("sync").over(by)).withColumn("last", F.lead("c").over(by).isNull())
    own_end = F.when(F.col("last"), F.length("text")).when(F.col("next_sync").isNull(), CHUNK).otherwise(F.col("next_sync") - F.col("start"))
    own_start = F.when(F.col("sync").isNull(), 0).otherwise(F.col("sync") - F.col("start"))
    own = met.select("doc_id", "key", "piece", "c", F.substring(F.col("text"), (own_start + 1).cast("int"), (own_end - own_start).cast("int")).alias("text"))
    joined = own.groupBy("key", "piece").agg(F.first("doc_id").alias("doc_id"), F.array_join(F.sort_array(F.collect_list(F.struct("c", "text"))).text, "").alias("text"))
    return joined.select("doc_id", "key", "piece", "text")


def _split(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of texts of one chunk (doc_id, key, piece, text), and of longer ones (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > CHUNK + OVERLAP
    short = rows.where(~is_long).select("doc_id", F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("piece"), "text")
    return short, rows.where(is_long)


def _encode_long(long: DataFrame, ranks: str) -> DataFrame:
    # Rows that agree in id and text are encoded once and counted; a hash of the text tells rows of one id apart.
    long = long.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(F.col("text").cast("binary"), 256)))
    once = long.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    encoded = stitched(once.select("doc_id", "key", "text")).mapInArrow(lambda b: _pieces(b, ranks), PIECES)
    times = once.select(F.col("key").alias("of"), "times")
    whole = encoded.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    whole = whole.join(times, F.col("key") == F.col("of")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return whole.select("doc_id", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x.ids)).alias("ids"))


def encode(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit): one row for each row of ``docs``.

    Null and empty texts have no ids. Rows with the same id, or a null id, stay separate rows. Other
    columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    short, long = _split(docs)
    return short.mapInArrow(lambda b: _pieces(b, ranks), PIECES).select("doc_id", "ids").unionByName(_encode_long(long, ranks))


def _digests(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    for batch in few(batches):
        raw = batch.column("ids").to_pylist()
        ids = [np.frombuffer(x, "<u4") for x in raw]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                pa.array([hashlib.sha256(decode(x, ranks)).hexdigest() for x in ids], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def round_trip(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the decoded bytes): ``encode``'s rows, decoded again.

    Texts of one chunk are encoded and decoded in one pass, so a task has one Python worker.
    """
    short, long = _split(docs)
    done = short.mapInArrow(lambda b: _digests(_pieces(b, ranks), ranks), DIGESTS)
    return done.unionByName(_encode_long(long, ranks).mapInArrow(lambda b: _digests(b, ranks), DIGESTS))


def decoded(encoded: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, bytes: the decoded texts as UTF-8."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode(np.frombuffer(x, "<u4"), ranks) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id bigint, bytes binary")
