"""Alignment of two tokenizers' tokens by a cogroup of postings.

Both tokenizers encode a text; their tokens cover the same bytes. Sorted together, the ends of both cut the
text into segments, and each segment is the overlap of one token of A with one of B: a link. Ends
that both have cut it into groups.

The count of a pair of ids is how many documents hold it linked, so each document's multiplicities of
pairs are its postings. They are packed by A's id for each batch of documents, and written. Then they are
shuffled by A's id: sorted, so that Spark may spill, a task reads an id's partial counts first, works
out counts and the highest one, and then streams the id's postings and emits each document's
contributions, summed by document in the task, and then over tasks.

An id that many postings have is dealt to several tasks, by batches; each of them gets the id's counts (at
most as many as B has ids), summed before they are copied. How many postings an id has is a table
of at most as many rows as A has ids, so sending it to all tasks is bounded.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import staged

#: Bytes of texts that are tokenised and linked at once; one text may be longer.
AT_ONCE = 2_000_000
#: Bytes of texts given to a tokenizer in one call.
CALL = 250_000
#: Postings in a row at most, and in one task for one id, about.
ROW, SHARE = 512, 2_000_000
#: Documents whose sums a task holds before it emits them.
HELD = 500_000

DOCUMENT = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
POSTING = "base bigint, a int, bs array<int>, ns array<int>, docs array<int>, times array<int>"


def path_of(name: str) -> str:
    """A name of the public tokenizers, or a path, as a path on this machine."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


@lru_cache(maxsize=2)
def byte_tokens(name: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file: its letters stand for bytes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    with open(path_of(name), encoding="utf-8") as file:
        data = json.load(file)
    entries = {i: bytes(map(letters.__getitem__, t)) for t, i in data["model"]["vocab"].items() if all(c in letters for c in t)}
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


@lru_cache(maxsize=2)
def piece_tokens(name: str) -> list[bytes]:
    """The bytes of each id of a piece model: U+2581 is a space, <0xHH> a byte."""
    model = piece_model(name)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


@lru_cache(maxsize=2)
def piece_model(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_of(name))


@lru_cache(maxsize=2)
def byte_model(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path_of(name))
    model.encode_special_tokens = True
    return model


#: Texts of these characters only (ASCII, Latin-1 and its extensions) are cut alike by both libraries' classes of letters, digits and spaces.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\u024f]*")


@lru_cache(maxsize=2)
def fast_model(name: str):
    """The same vocabulary in a faster library, for plain texts; None if its merges aren't in the order of its ids, or it isn't cut by the usual pattern.

    Merging by rank and merging by id are the same then.
    """
    import public_tokenizers
    import tiktoken

    with open(path_of(name), encoding="utf-8") as file:
        data = json.load(file)
    vocabulary, cut = data["model"]["vocab"], data["pre_tokenizer"] or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    in_order = all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and data["normalizer"] is None
    if not (in_order and usual):
        return None
    ranks = {t: i for i, t in enumerate(byte_tokens(name)[: 256 + len(merges)])}
    return tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_ids(texts: list[str], name: str) -> list[np.ndarray]:
    """A's ids of texts with their space."""
    fast = fast_model(name)
    plain = [fast is not None and PLAIN.fullmatch(t) is not None for t in texts]
    rest = iter(byte_model(name).encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
    return [fast.encode_to_numpy(t, disallowed_special=()).astype(np.int32) if p else np.array(next(rest).ids, np.int32) for t, p in zip(texts, plain, strict=True)]


class Bytes:
    """The bytes of all ids one after another, with each id's start and length there."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.buffer[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=4)
def bytes_of(kind: str, name: str) -> Bytes:
    return Bytes(byte_tokens(name) if kind == "a" else piece_tokens(name))


@lru_cache(maxsize=1)
def decimals(n: int) -> Bytes:
    """The decimal texts of 0 to n - 1, each with one more byte, for a separator."""
    return Bytes([b"%d," % i for i in range(n)])


def encoded(texts: list[str], sizes: list[int], a_name: str, b_name: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The ids of both tokenizers for each text, given them without its space, in calls of bounded size."""
    b = piece_model(b_name)
    left, right, i = [], [], 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + sizes[j] <= CALL):
            n += sizes[j]
            j += 1
        left += byte_ids([f" {t}" for t in texts[i:j]], a_name)
        right += [np.array(e, np.int32) for e in b.encode(texts[i:j], num_threads=1)]
        i = j
    return left, right


def group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``a1,a2|b1;...`` of all groups in order, and where each group's text and separator end.

    ``group_a`` and ``group_b`` ascend: the group of each token. Every group has tokens of both.
    """
    n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
    per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    before_a, before_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + before_b[group_a]] = a
    order[np.arange(len(b)) + (before_a + per_a)[group_b]] = b
    table = decimals(1 << 16)
    out = table.joined(order)
    ends = np.cumsum(table.length[order])
    last_a, last = np.cumsum(per_a + per_b) - per_b - 1, np.cumsum(per_a + per_b) - 1
    out[ends[last_a] - 1] = ord("|")
    out[ends[last] - 1] = ord(";")
    return out, ends[last]


def linked(texts: list[str], a_name: str, b_name: str) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts: n_a, n_b, n_groups, n_links (an array of 4 columns), the groups' digests; and distinct (a, b, text, times), sorted.

    A text without tokens, or whose tokens of either side don't give its bytes, has zeros and no digest.
    """
    raw = [f" {t}".encode("utf-8", "surrogatepass") for t in texts]
    full = np.array([bool(t) for t in texts])
    given = [t for t in texts if t]
    bytes_a, bytes_b = bytes_of("a", a_name), bytes_of("b", b_name)
    left, right = encoded(given, [len(r) for r, f in zip(raw, full, strict=True) if f], a_name, b_name)
    # Texts whose tokens' lengths don't add up fall out first, then those whose bytes differ.
    place = np.flatnonzero(full)
    sizes = np.array([len(raw[i]) for i in place], np.int64)
    fits = np.array([bytes_a.length[x].sum() == n and bytes_b.length[y].sum() == n for x, y, n in zip(left, right, sizes, strict=True)], bool)
    for _ in range(2):
        kept = np.flatnonzero(fits)
        a = np.concatenate([left[i] for i in kept]) if len(kept) else np.zeros(0, np.int32)
        b = np.concatenate([right[i] for i in kept]) if len(kept) else np.zeros(0, np.int32)
        ends = np.cumsum(sizes[kept])
        want = np.frombuffer(b"".join(raw[place[i]] for i in kept), np.uint8)
        wrong = np.flatnonzero((bytes_a.joined(a) != want) | (bytes_b.joined(b) != want))
        if not len(wrong):
            break
        fits[kept[np.unique(np.searchsorted(ends, wrong, "right"))]] = False
    end_a, end_b = np.cumsum(bytes_a.length[a]), np.cumsum(bytes_b.length[b])
    # A mark for each byte that ends a token: bit 1 of A, bit 2 of B.
    marks = np.zeros(len(want) + 1, np.uint8)
    marks[end_a] |= 1
    marks[end_b] |= 2
    cuts = np.flatnonzero(marks)  # ends of segments
    both = np.flatnonzero(marks == 3)  # ends of groups
    is_a, is_b = (marks[cuts] & 1).astype(np.int64), marks[cuts] >> 1
    token_a, token_b = np.cumsum(is_a) - is_a, np.cumsum(is_b.astype(np.int64)) - is_b
    counts = np.zeros((len(texts), 4), np.int64)
    digests = [""] * len(texts)
    at = place[kept]
    for column, found in enumerate((end_a, end_b, both, cuts)):
        counts[at, column] = np.diff(np.searchsorted(found, ends, "right"), prepend=0)
    if len(at):
        text, group_ends = group_texts(a, b, np.searchsorted(both, end_a), np.searchsorted(both, end_b))
        stops = group_ends[np.cumsum(counts[at, 2]) - 1]
        view, start = memoryview(text), 0
        for i, stop in zip(at, stops, strict=True):
            digests[i] = hashlib.sha256(view[start : stop - 1]).hexdigest()
            start = stop
    # Distinct links of each text, sorted by A's id, B's id and text.
    doc = at[np.searchsorted(ends, cuts)] if len(at) else np.zeros(0, np.int64)
    n_b = len(bytes_b.length)
    key = ((a[token_a].astype(np.int64) * n_b + b[token_b]) << 24 | doc) if len(at) else np.zeros(0, np.int64)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(first, append=len(key))
    key = key[first]
    pair = key >> 24
    return counts, digests, pair // n_b, pair % n_b, key & ((1 << 24) - 1), times


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    """Values cut into lists at ``cuts`` (from 0 to their number)."""
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))


def packed(base: int, a: np.ndarray, b: np.ndarray, doc: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Sorted postings as rows of one A id and at most ROW postings: its B ids, how many postings each has, their documents and times."""
    n = len(a)
    new_a = np.concatenate([[True], a[1:] != a[:-1]]) if n else np.zeros(0, bool)
    since = np.arange(n) - np.maximum.accumulate(np.where(new_a, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    new_row = new_a | (since % ROW == 0)
    new_b = new_row | (np.concatenate([[True], b[1:] != b[:-1]]) if n else new_row)
    rows, starts = np.flatnonzero(new_row), np.flatnonzero(new_b)
    cuts = np.append(rows, n)
    cuts_b = np.searchsorted(starts, cuts)
    names = ["base", "a", "bs", "ns", "docs", "times"]
    columns = [
        pa.array(np.full(len(rows), base, np.int64)),
        pa.array(a[rows].astype(np.int32)),
        _lists(b[starts], cuts_b),
        _lists(np.diff(starts, append=n), cuts_b),
        _lists(doc, cuts),
        _lists(times, cuts),
    ]
    return pa.RecordBatch.from_arrays(columns, names)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of rows in runs of bounded size in bytes."""
    sizes = np.array([len(t) if t else 0 for t in batch.column("text").to_pylist()])
    start = 0
    while start < len(sizes):
        stop = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), AT_ONCE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _postings(batches: Iterator[pa.RecordBatch], a_name: str, b_name: str) -> Iterator[pa.RecordBatch]:
    """row, doc_id, text -> one row for each document (doc) and for each packed run of postings (post)."""
    kinds = pa.schema([("doc", _struct(DOCUMENT)), ("post", _struct(POSTING))])
    for batch in batches:
        for part in _slices(batch):
            texts = [t or "" for t in part.column("text").to_pylist()]
            counts, digests, a, b, doc, times = linked(texts, a_name, b_name)
            row = part.column("row").to_numpy()
            fields = [part.column("row"), part.column("doc_id"), *(pa.array(counts[:, i]) for i in range(4)), pa.array(digests, pa.string())]
            documents = pa.StructArray.from_arrays(fields, fields=list(kinds.field("doc").type))
            yield pa.RecordBatch.from_arrays([documents, pa.nulls(len(row), kinds.field("post").type)], schema=kinds)
            # The rows of a batch are neighbours in one partition: a posting tells its document by the distance from the first.
            rows = packed(int(row[0]), a, b, (row - row[0])[doc], times)
            for i in range(0, rows.num_rows, 10_000):
                some = rows.slice(i, 10_000)
                yield pa.RecordBatch.from_arrays([pa.nulls(some.num_rows, kinds.field("doc").type), pa.StructArray.from_arrays(some.columns, fields=list(kinds.field("post").type))], schema=kinds)


def _struct(fields: str) -> pa.DataType:
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.struct([(name, types[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


def _summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """base, row, best, total of parts, summed by row. A batch's rows are neighbours, so the order of rows is that of batches."""
    base, row = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    order = np.argsort(row, kind="stable")
    base, row = base[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return base[first], row[first], *(np.add.reduceat(np.concatenate([h[i] for h in held])[order], first) for i in (2, 3))


def _document_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """base, docs, best, total, sorted by base -> row, best, total: one row for each document."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bases = batch.column("base").to_numpy()
        docs, best, total = (batch.column(c) for c in ("docs", "best", "total"))
        base = np.repeat(bases, np.diff(docs.offsets.to_numpy()))
        parts = _summed([*held, (base, base + docs.flatten().to_numpy(), best.flatten().to_numpy(), total.flatten().to_numpy())])
        # Only the last batch of documents may go on.
        done = parts[0] != bases[-1]
        held = [tuple(x[~done] for x in parts)]
        yield pa.RecordBatch.from_arrays([pa.array(x[done]) for x in parts[1:]], ["row", "best", "total"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0][1:]], ["row", "best", "total"])


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, kind, b): an id's counts (kind 0), then its postings (kind 1) -> base, docs, best, total: sums for a batch's documents."""
    key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, ...]] = []
    waiting = 0

    def out() -> Iterator[pa.RecordBatch]:
        base, row, best, total = _summed(held)
        first = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
        for i in range(0, len(first), 500):
            few = np.append(first[i : i + 500], len(base) if i + 500 >= len(first) else first[i + 500])
            a, z, cuts = few[0], few[-1], pa.array(few - few[0], pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, x) for x in (pa.array((row - base)[a:z], pa.int32()), pa.array(best[a:z]), pa.array(total[a:z]))]
            yield pa.RecordBatch.from_arrays([pa.array(base[few[:-1]]), *lists], ["base", "docs", "best", "total"])

    for batch in batches:
        kind = batch.column("kind").to_numpy()
        ids = batch.column("a").to_numpy().astype(np.int64)
        is_count = kind == 0
        key = np.concatenate([key, ids[is_count] << 32 | batch.column("b").to_numpy()[is_count]])
        count = np.concatenate([count, batch.column("n").to_numpy()[is_count]])
        # The same id's counts may come again, for another share of it in this task.
        key, where = np.unique(key, return_index=True)
        count = count[where]
        if len(key) and not is_count.all():
            of = key >> 32
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            highest = np.repeat(np.maximum.reduceat(count, starts), np.diff(starts, append=len(of)))
            posts = batch.filter(pa.array(~is_count))
            bs, ns, docs, times = (posts.column(c) for c in ("bs", "ns", "docs", "times"))
            a = np.repeat(posts.column("a").to_numpy().astype(np.int64), np.diff(bs.offsets.to_numpy()))
            at = np.repeat(np.searchsorted(key, a << 32 | bs.flatten().to_numpy()), ns.flatten().to_numpy())
            base = np.repeat(posts.column("base").to_numpy(), np.diff(docs.offsets.to_numpy()))
            m = times.flatten().to_numpy().astype(np.int64)
            held.append((base, base + docs.flatten().to_numpy(), np.where(count[at] == highest[at], m, 0), m * count[at]))
            waiting += len(m)
            if waiting > 4 * HELD:
                held = [_summed(held)]
                waiting = len(held[0][0])
                if waiting > HELD:
                    yield from out()
                    held, waiting = [], 0
        # Only the last id may go on in the next batch.
        if len(ids):
            last = key >> 32 == ids[-1]
            key, count = key[last], count[last]
    if held:
        yield from out()


def aligned(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", share: int = SHARE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of ``docs``.

    ``a`` is a byte-level vocabulary, ``b`` a piece model. Texts null or empty, or whose tokens of either side don't
    give their bytes, have zeros and an empty digest. Rows of one id, or of none, are documents of their own.
    Other columns are ignored. An empty table gives an empty result. ``share``: postings of an id
    that one task takes, about.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = staged(rows.mapInArrow(lambda x: _postings(x, a, b), f"doc struct<{DOCUMENT.replace(' ', ':').replace(',:', ',')}>, post struct<{POSTING.replace(' ', ':').replace(',:', ',')}>"), "alignment-postings")
    posts = both.where("post IS NOT NULL").select("post.*")
    # At most one row for each id of A.
    shares = staged(posts.groupBy("a").agg(F.sum(F.size("docs")).alias("m")).select("a", F.ceil(F.col("m") / share).cast("int").alias("shares")), "alignment-shares")
    near = F.broadcast(shares.where("shares > 1"))
    counts = posts.select("a", F.explode(F.arrays_zip("bs", "ns")).alias("x")).groupBy("a", F.col("x.bs").alias("b")).agg(F.sum("x.ns").cast("long").alias("n"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))
    nothing = [F.lit(0).cast("long").alias("base"), *(F.lit(None).cast("array<int>").alias(c) for c in ("bs", "ns", "docs", "times"))]
    first = counts.join(near, "a", "left").select("a", copies.alias("salt"), F.lit(0).alias("kind"), "b", "n", *nothing)
    salt = F.pmod(F.xxhash64("base"), F.coalesce("shares", F.lit(1))).cast("int")
    then = posts.join(near, "a", "left").select(
        "a", salt.alias("salt"), F.lit(1).alias("kind"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("n"), "base", "bs", "ns", "docs", "times"
    )
    streams = first.unionByName(then).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "b")
    # One row for each task and batch of documents, dealt by batches: a document's sums meet in one task.
    given = streams.mapInArrow(_contributions, "base bigint, docs array<int>, best array<bigint>, total array<bigint>")
    sums = given.repartition("base").sortWithinPartitions("base").mapInArrow(_document_sums, "row bigint, best bigint, total bigint")
    documents = both.where("doc IS NOT NULL").select("doc.*")
    return documents.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("total", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256"
    )
