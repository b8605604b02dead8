"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are linked if the Jaccard similarity of their sets of word 5-grams is 0.8 or more.

1. Documents with one and the same set are copies; one of each is joined, the others are counted.
2. A set's 96 MinHash values make 24 bands of 4. Sets that agree in a band meet in its bucket; at a
   similarity of 0.8 a pair misses all buckets with a chance of 3e-6. Buckets of one are dropped.
3. In a bucket, MinHash values are compared 16 at a time. A pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold, given the matches so far and a uniform
   prior, falls below ``TOLERANCE``. What is left joins documents to candidate groups: a task
   reports only edges that join two parts, never all pairs.
4. Within a candidate group all pairs are verified exactly, from the sets, in blocks. Each block
   gives its documents' numbers of links and the edges that join its parts.
5. The components of the verified edges are the classes.

Buckets and groups of any size are dealt into pairs of blocks, each small enough for a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import staged
from cadenza.llm.shingles import U64, WordHashes, odd, shingle_set, word_hashes
from cadenza.operators.components import connected

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP = 24, 4, 16
HASHES = BANDS * ROWS
TOLERANCE = 1e-6
#: Members of a bucket's block; members and shingles of a group's block, about.
BUCKET_BLOCK, GROUP_BLOCK, GROUP_SHINGLES = 1024, 256, 2_000_000
#: Cells up to this size are compared pair by pair in one go, larger ones by search.
SMALL = 24


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits: of each permutation the least value, cut."""
    a = (odd(HASHES, 11) >> U64(32)).astype(np.uint32) | np.uint32(1)
    b = (odd(HASHES, 12) >> U64(32)).astype(np.uint32)
    x = (shingles >> U64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048, None] * a[None, :] + b[None, :]
        np.minimum(least, part.min(0), out=least)
    v = least * np.uint32(0x9E3779B1)
    return (v >> np.uint32(16)).astype("<u2")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for b in batches:
        digests, sizes, signatures = [], [], []
        for text in b.column("text").to_pylist():
            s = shingle_set(word_hashes(text, known), SHINGLE)
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sizes.append(len(s))
            signatures.append(minhash(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())], ["doc_id", "part", "node", "n", "sig"])


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After STEP, 2 STEP, ... values: with fewer matches a pair is dropped.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while (below := below + math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append(m)
    return tuple(out)


def likely(left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of rows of two signature matrices are left after incremental comparison."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for i, least in enumerate(least_matches(threshold, TOLERANCE)):
        at = slice(i * STEP, (i + 1) * STEP)
        matches[alive] += (left[alive, at] == right[alive, at]).sum(1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


class Parts:
    """A union-find over nodes as they come."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all pairs within consecutive groups."""
    left, right = [], []
    for g in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(g, 1)
        at = starts[sizes == g][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def search(sig: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges that join a cell's rows as all its likely pairs would: from each row reached, only rows not yet reached are compared."""
    edges, pool = [], np.arange(len(sig))
    while len(pool):
        queue, pool = [int(pool[0])], pool[1:]
        while queue and len(pool):
            at = queue.pop()
            hit = likely(np.broadcast_to(sig[at], (len(pool), HASHES)), sig[pool], threshold)
            edges += [(at, int(x)) for x in pool[hit]]
            queue += pool[hit].tolist()
            pool = pool[~hit]
    return edges


def cells(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Sorted batches as tables of whole groups, with the groups' starts and sizes."""
    held: list[pa.RecordBatch] = []

    def changes(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, t.num_rows - 1), bool)
        for k in key:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        return np.flatnonzero(change) + 1

    def grouped(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        starts = np.append(0, changes(t))
        return t, starts, np.diff(np.append(starts, t.num_rows))

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        if len(cut := changes(t)):
            yield grouped(t.slice(0, int(cut[-1])))
            held = t.slice(int(cut[-1])).combine_chunks().to_batches()
    if held:
        yield grouped(pa.Table.from_batches(held))


def _candidates(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts()
        for t, starts, sizes in cells(batches, ["bucket", "i", "j"]):
            nodes = t.column("node").to_pylist()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
            small = sizes <= SMALL
            left, right = within(starts[small], sizes[small])
            edges: list[tuple[int, int]] = []
            for at in range(0, len(left), 65_536):
                a, b = left[at : at + 65_536], right[at : at + 65_536]
                hit = likely(sig[a], sig[b], threshold)
                edges += zip(a[hit].tolist(), b[hit].tolist(), strict=True)
            for s, n in zip(starts[~small], sizes[~small], strict=True):
                edges += [(s + a, s + b) for a, b in search(sig[s : s + n], threshold)]
            new = [(nodes[a], nodes[b]) for a, b in edges if parts.join(nodes[a], nodes[b])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in new], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


def dealt(rows: DataFrame, group: str, node: str, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks (i <= j) of its group that its own block is in, with i and j."""
    own = rows.withColumn("nb", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64(F.lit("block"), node), F.col("nb")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return other.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("nb", "other")


def candidate_groups(texts: DataFrame, threshold: float) -> DataFrame:
    """(node, sig) -> node, component: documents that likely pairs connect."""
    bands = texts.select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sig")
    bands = bands.select(F.xxhash64("band", F.substring(F.col("sig"), F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("bucket"), "node")
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").withColumnRenamed("bucket", "of")
    met = bands.join(shared, F.col("bucket") == F.col("of")).select("bucket", "members", "node")
    signed = met.join(texts.select(F.col("node").alias("own_node"), "sig"), F.col("node") == F.col("own_node")).drop("own_node")
    cell = dealt(signed, "bucket", "node", F.ceil(F.col("members") / BUCKET_BLOCK)).select("bucket", "i", "j", "node", "sig")
    cell = cell.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return connected(cell.mapInArrow(_candidates(threshold), "a binary, b binary"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces text by its shingle set; keeps rows whose set is their node's, as an id may have several texts."""
    known = WordHashes()
    for b in batches:
        sets = [shingle_set(word_hashes(t, known), SHINGLE).tobytes() for t in b.column("text").to_pylist()]
        right = [xxhash.xxh3_128_digest(s) == n for s, n in zip(sets, b.column("node").to_pylist(), strict=True)]
        names = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"]).filter(pa.array(right))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections, from products of 0/1 matrices over shingles that two sets share."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    often = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[often] = np.arange(len(often))
    column, keep = place[column], place[column] >= 0
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n))
    for first in range(0, len(often), 4096):
        at = slice(*np.searchsorted(column, (first, first + 4096)))
        m = np.zeros((n, 4096), np.float32)
        m[owner[at], column[at] - first] = 1
        out += m @ m.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return np.rint(out).astype(np.int64)


def _verified(threshold: float):
    million = round(threshold * 10**6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, sizes in cells(batches, ["component", "i", "j"]):
            nodes, own, copies = (t.column(c).to_pylist() for c in ("node", "own", "copies"))
            i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
            raw = t.column("shingles").to_pylist()
            out: list[tuple] = []
            for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                sets = [np.frombuffer(x, U64) for x in raw[s : s + n]]
                both = intersections(sets) if n > 1 else np.zeros((1, 1), np.int64)
                size = np.array([len(x) for x in sets])
                linked = both * 10**6 >= million * (size[:, None] + size[None, :] - both)
                np.fill_diagonal(linked, False)
                if i[s] != j[s]:  # pairs within a block are another cell's
                    side = np.array(own[s : s + n])
                    linked &= side[:, None] != side[None, :]
                links = linked @ np.array(copies[s : s + n], np.int64)
                out += [(nodes[s + k], None, int(links[k])) for k in np.flatnonzero(links)]
                parts = Parts()
                for a, b in zip(*np.nonzero(np.triu(linked)), strict=True):
                    if parts.join(int(a), int(b)):
                        out.append((nodes[s + a], nodes[s + b], 0))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["a", "b", "links"])

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, part, class_id, n_links, is_head: one row for each row of ``docs``.

    class_id is the least id in the document's class, and is_head marks that document; n_links counts the other documents that it is
    linked to, copies included. A text of one to four words has one shingle of all its words; null
    texts and texts without words have no links, and their own id as class. Null ids come first;
    rows with one id and several texts are several documents; equal rows are copies. ``part`` is a
    hash of the text. Other columns are ignored. An empty table gives an empty result.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("part"), "text")
    signed = staged(keyed.mapInArrow(_signatures, "doc_id bigint, part bigint, node binary, n bigint, sig binary"), "ngram-signatures")
    least = F.min(F.struct("doc_id", "part"))
    texts = staged(signed.where("node IS NOT NULL").groupBy("node").agg(least.alias("of"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "ngram-texts")
    groups = staged(candidate_groups(texts.select("node", "sig"), threshold), "ngram-groups")

    sizes = texts.select("node", "of", "copies", "n").withColumnRenamed("node", "own_node")
    members = groups.join(sizes, F.col("node") == F.col("own_node")).drop("own_node")
    totals = members.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).withColumnRenamed("component", "total_of")
    blocks = F.ceil(F.greatest(F.col("members") / GROUP_BLOCK, F.col("shingles") / GROUP_SHINGLES))
    members = members.join(totals, F.col("component") == F.col("total_of")).select("component", "node", "copies", "of", blocks.cast("int").alias("blocks"))
    plain = keyed.withColumnRenamed("doc_id", "id").withColumnRenamed("part", "id_part")
    found = members.join(plain, F.col("of.doc_id").eqNullSafe(F.col("id")) & (F.col("of.part") == F.col("id_part"))).select("component", "node", "copies", "blocks", "text")
    sets = found.mapInArrow(_sets, "component binary, node binary, copies bigint, blocks int, shingles binary").dropDuplicates(["component", "node"])
    cell = dealt(sets, "component", "node", F.col("blocks")).select("component", "i", "j", "own", "node", "copies", "shingles")
    cell = cell.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    verified = staged(cell.mapInArrow(_verified(threshold), "a binary, b binary, links bigint"), "ngram-verified")

    classes = connected(verified.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "class_node")
    links = verified.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    known = texts.select("node", "of", "copies").join(classes, F.col("node") == F.col("class_node"), "left").join(links, F.col("node") == F.col("a"), "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    heads = known.groupBy("component").agg(F.min("of").alias("head")).withColumnRenamed("component", "head_of")
    known = known.join(heads, F.col("component") == F.col("head_of")).select(F.col("node").alias("known"), "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "part", "node").join(known, F.col("node") == F.col("known"), "left")
    own = F.struct("doc_id", "part")
    head = F.when(F.col("node").isNull(), own).otherwise(F.col("head"))
    return out.select("doc_id", "part", head.doc_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (head == own).alias("is_head"))


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class: one of each class.

    Texts without words are classes of their own; equal rows of these all stay. Columns may have any names.
    """
    heads = join(docs, threshold).where("is_head").select(F.col("doc_id").alias("head"), F.col("part").alias("head_part")).distinct()
    text = F.coalesce("text", F.lit(""))
    # Rows travel as one value, so their names meet no others.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("part"), text.rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    kept = rows.join(heads, F.col("id").eqNullSafe(F.col("head")) & (F.col("part") == F.col("head_part")))
    kept = kept.withColumn("nth", F.row_number().over(W.partitionBy("head", "head_part").orderBy(F.lit(1))))
    return kept.where((F.col("nth") == 1) | ~F.col("worded")).select("row.*")
