"""A Merkle manifest of a table by coordinate lookup proofs. DataFrame functions only.

Each row is a leaf; each group's leaves, in order, fold ``FAN`` at a time into the group's root, and the
groups' roots likewise into the table's. Digests are lowercase hex where they are hashed, and 32 bytes where they are stored.

Places: rows are dealt by ranges of (group, id, leaf) and numbered inside a range; the ranges' counts of each
group, summed, give each leaf its index and each group its size, so that no group is in one task.

Nodes: ``DEEP`` levels at a time, from runs of ``FAN ** DEEP`` consecutive nodes; written tables hold the nodes
of all levels by coordinate (tree, power of ``FAN``, place). Tree -1 folds the groups' roots.

Proofs: index and size alone say which siblings a leaf needs. Each leaf explodes their coordinates, which
are joined to the nodes, put in order, concatenated and folded. A node near a root is needed by all
leaves below it; so a coordinate's key has the leaf's block, and a node is copied to each block below its
run. A key is needed by ``BLOCK`` leaves at most, at any size, and the copies are few: about
``FAN`` a block and level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import staged

#: Children of a node; levels that one pass folds.
FAN, DEEP = 3, 3
#: Leaves that need one copy of a node at most.
BLOCK = FAN**8
#: All powers of FAN that a place can reach.
POWERS = [FAN**k for k in range(39)]
#: Added to the levels from a group's root on.
UPPER = len(POWERS)
#: Tables of one row for each range and group are sent to all tasks up to so many rows, a few MB; beyond, they are joined.
SENT = 20_000


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of a row's values, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def numbered(leaves: DataFrame) -> DataFrame:
    """(group, id, leaf, ...) -> the same with tree (the group's number, from 0), n (its leaves), idx (from 0), g (among all leaves).

    Groups ascend by UTF-8 bytes, null first; leaves by id, null first, then by digest. Equal rows are interchangeable.
    """
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), *(F.col(c) for c in leaves.columns if c not in ("group", "id"))]
    # The row ids of a sorted partition count up in its order; their upper part is the partition's number.
    dealt = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    dealt = staged(dealt.withColumn("range", F.shiftright("row", 33)), "merkle-dealt")
    parts = staged(dealt.groupBy("range", "group").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first")), "merkle-ranges")
    earlier = W.partitionBy("group").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    # Sums over ranges: one row for each, as many as the shuffle has partitions.
    upto = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    begins = F.when(F.col("before") == 0, 1).otherwise(0)
    ranges = parts.groupBy("range").agg(F.sum(begins).alias("begun"), F.sum("rows").alias("rows"), F.min("first").alias("row0"))
    ranges = ranges.select("range", F.coalesce(F.sum("begun").over(upto), F.lit(0)).alias("tree0"), (F.coalesce(F.sum("rows").over(upto), F.lit(0)) - F.col("row0")).alias("g0"))
    nth = F.row_number().over(W.partitionBy("range").orderBy(F.col("group").asc_nulls_first())) - 1
    sizes = parts.groupBy(F.col("group").alias("of")).agg(F.sum("rows").alias("n"))
    trees = parts.where("before = 0").withColumn("nth", nth).join(ranges, "range").select("group", (F.col("tree0") + F.col("nth")).alias("tree"))
    trees = trees.join(sizes, F.col("group").eqNullSafe(F.col("of"))).select("of", "tree", "n")
    placed = parts.join(trees, F.col("group").eqNullSafe(F.col("of"))).join(ranges, "range")
    placed = staged(placed.select(F.col("range").alias("at"), "of", "tree", "n", (F.col("before") - F.col("first")).alias("shift"), "g0"), "merkle-places")
    near = F.broadcast(placed) if placed.count() <= SENT else placed.hint("merge")
    out = dealt.join(near, (F.col("range") == F.col("at")) & F.col("group").eqNullSafe(F.col("of")))
    return out.select(*leaves.columns, "tree", "n", (F.col("row") + F.col("shift")).alias("idx"), (F.col("row") + F.col("g0")).alias("g"))


def _upper(level: Column) -> Column:
    """An array of hex digests, one level up."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(level) / FAN).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * FAN + 1, FAN), "").cast("binary"), 256))


def folded_up(base: DataFrame) -> DataFrame:
    """(tree, n, start, pos, digest) -> nodes (tree, n, start, power, pos, digest) of all levels. A tree of one node is its own root."""
    longest = base.agg(F.max("n")).first()[0] or 0
    names = ["tree", "n", "start", "power", "pos", "digest"]
    done = [base.withColumn("power", F.lit(1).cast("long")).select(*names)]
    power = 1
    while power < longest:
        # Trees whose root is reached go no further.
        runs = done[-1].where((F.col("power") == power) & (F.col("power") < F.col("n"))).groupBy("tree", "n", "start", F.floor(F.col("pos") / FAN**DEEP).alias("run"))
        found = runs.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "digest"))), lambda x: hexed(x.digest)).alias("l0"))
        for k in range(1, DEEP + 1):
            found = found.withColumn(f"l{k}", _upper(F.col(f"l{k - 1}")))

        def level(k: int, power: int = power) -> Column:
            place = F.col("run") * FAN ** (DEEP - k)
            return F.transform(f"l{k}", lambda d, i: F.struct(F.lit(power * FAN**k).cast("long").alias("power"), (place + i).alias("pos"), F.unhex(d).alias("digest")))

        above = found.select("tree", "n", "start", F.inline(F.concat(*(level(k) for k in range(1, DEEP + 1))))).select(*names)
        # A level exists if the one below it has several nodes.
        done.append(staged(above.where(F.col("power") < F.col("n") * FAN), "merkle-nodes"))
        power *= FAN**DEEP
    return reduce(DataFrame.unionByName, done)


def is_root() -> Column:
    return F.col("power") >= F.col("n")


def _powers(n: str) -> str:
    """The powers of the levels that have several nodes, in a tree of ``n`` leaves, as SQL text."""
    return f"filter(array({', '.join(f'{p}L' for p in POWERS)}), p -> p < {n})"


def _siblings(tree: str, pos: str, n: str, upper: int) -> str:
    """The coordinates of the siblings of ``pos``'s nodes, level by level, as SQL text."""
    first = f"({pos} div p div {FAN}) * {FAN}"
    run = f"filter(sequence(0, {FAN - 1}), o -> o <> ({pos} div p) % {FAN} AND {first} + o <= ({n} - 1) div p)"
    return f"flatten(transform({_powers(n)}, (p, k) -> transform({run}, o -> named_struct('tree', {tree}, 'power', p, 'pos', {first} + o, 'level', k + {upper}))))"


def proofs(leaves: DataFrame, nodes: DataFrame, n_trees: int) -> DataFrame:
    """tree, idx, subroot, siblings (array of level, place, digest, in order) for each leaf (tree, n, idx, g).

    ``nodes`` of all trees: tree, n, start, power, pos, digest, and for the groups' tree the leaves ``lo`` to ``hi`` below each one's run.
    """
    root = "named_struct('tree', tree, 'power', element_at(filter(array({}), p -> p >= n), 1), 'pos', 0L, 'level', -1)".format(", ".join(f"{p}L" for p in POWERS))
    wanted = F.concat(F.array(F.expr(root)), F.expr(_siblings("tree", "idx", "n", 0)), F.expr(_siblings("-1L", "tree", f"{n_trees}L", UPPER)))
    needs = leaves.select(F.col("tree").alias("of"), "idx", F.floor(F.col("g") / BLOCK).alias("block"), F.inline(wanted))
    blocks = F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))
    copies = nodes.select("tree", "power", "pos", "digest", F.explode(blocks).alias("block"))
    # Spark sizes an exploded table as it was before, so either side may look small enough to be sent to all tasks: never.
    met = needs.hint("merge").join(copies, ["tree", "power", "pos", "block"])
    every = F.sort_array(F.collect_list(F.struct("level", (F.col("pos") % FAN).cast("int").alias("place"), "digest")))
    by_leaf = met.groupBy(F.col("of").alias("tree"), "idx").agg(every.alias("found"))
    return by_leaf.select("tree", "idx", F.get("found", F.lit(0)).digest.alias("subroot"), F.slice("found", 2, 2 * len(POWERS) * FAN).alias("siblings"))


def folded(leaf: str, n_trees: int) -> Column:
    """The table's root, as hex, from a leaf's digest (hex) and the siblings of its row (tree, n, idx, siblings)."""
    steps = f"concat(transform({_powers('n')}, (p, k) -> struct(k AS level, (idx div p) % {FAN} AS own)), transform({_powers(f'{n_trees}L')}, (p, k) -> struct(k + {UPPER} AS level, (tree div p) % {FAN} AS own)))"
    at = "map_from_entries(transform(siblings, x -> struct(x.level * {0} + x.place AS at, lower(hex(x.digest)) AS digest)))".format(FAN)
    parts = ", ".join(f"CASE WHEN s.own = {o} THEN acc ELSE coalesce(try_element_at({at}, s.level * {FAN} + {o}), '') END" for o in range(FAN))
    return F.expr(f"aggregate({steps}, {leaf}, (acc, s) -> sha2(CAST(concat({parts}) AS BINARY), 256))")


def manifest(df: DataFrame, group: str, id: str, leaf: Column, **carried: Column) -> tuple[DataFrame, int]:
    """id, group, the ``carried`` columns, leaf, tree, n, idx, subroot, root (digests in hex), siblings; and the number of groups.

    One row for each row of ``df``. Null groups are one group, the first; null ids come first; rows of one
    id go by their digests, and equal rows take places of their own. ``folded`` checks a row against its
    proof. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    leaves = staged(df.select(F.col(f"`{group}`").alias("group"), F.col(f"`{id}`").alias("id"), leaf.alias("leaf"), *(c.alias(k) for k, c in carried.items())), "merkle-leaves")
    placed = staged(numbered(leaves), "merkle-placed")
    start = F.col("g") - F.col("idx")
    low = folded_up(placed.select("tree", "n", start.alias("start"), F.col("idx").alias("pos"), F.col("leaf").alias("digest")))
    trees = staged(low.where(is_root()).select("tree", "n", "start", "digest"), "merkle-trees")
    n_trees = trees.count()
    top = folded_up(trees.select(F.lit(-1).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.lit(0).cast("long").alias("start"), F.col("tree").alias("pos"), "digest"))
    tops = top.where(is_root()).select("digest").collect()
    # Leaves below a node's run: by arithmetic in a group, by the groups' own leaves above them.
    run, width = F.floor(F.col("pos") / FAN), F.col("power") * FAN
    last = F.least((run + 1) * width, F.col("n")) - 1
    below = low.withColumn("lo", F.col("start") + F.when(is_root(), 0).otherwise(run * width)).withColumn("hi", F.col("start") + F.when(is_root(), F.col("n") - 1).otherwise(last))
    a, b = (trees.select(F.col("tree").alias(f"{x}_tree"), F.col("start").alias(f"{x}_start"), F.col("n").alias(f"{x}_n")) for x in "ab")
    above = top.where(~is_root()).withColumn("first", run * width).withColumn("last", last)
    above = above.join(a, F.col("first") == F.col("a_tree")).join(b, F.col("last") == F.col("b_tree"))
    above = above.withColumn("lo", F.col("a_start")).withColumn("hi", F.col("b_start") + F.col("b_n") - 1)
    names = ["tree", "power", "pos", "digest", "lo", "hi"]
    proved = proofs(placed, below.select(*names).unionByName(above.select(*names)), n_trees)
    out = placed.hint("merge").join(proved, ["tree", "idx"]).withColumn("root", F.lit(hexed_bytes(tops)))
    return out.select("id", "group", *carried, hexed(F.col("leaf")).alias("leaf"), "tree", "n", "idx", hexed(F.col("subroot")).alias("subroot"), "root", "siblings"), n_trees


def hexed_bytes(rows: list) -> str | None:
    """The one digest of a table of at most one row."""
    return bytes(rows[0][0]).hex() if rows else None


def proof_digest() -> Column:
    """The digest of a row's siblings, from its own level to the table's root."""
    return F.sha2(F.array_join(F.transform("siblings", lambda x: hexed(x.digest)), "").cast("binary"), 256)
