"""Exact top-k search by inner product: a Voronoi kNN join.

Pivots split the data into cells, each row in the cell of its nearest pivot. A summary of each cell
(rows, largest distance from the pivot, range along the pivot's direction u, largest part across it)
bounds the score that any of its rows can have with a query, by the smaller of

    q . x = q . p + q . (x - p)          <= q . p + |q| * radius
    q . x = (q . u)(x . u) + across      <= max over the range of (q . u) t + |q across u| * |x across u|

A query is first solved in the cell with the highest bound; the k-th score found there is a lower
bound of its final k-th score. It then goes only to cells whose bound reaches this, and is solved
there locally. Pivots grow with the square root of the rows. A cell's rows, and the queries sent to it,
are dealt into blocks by a hash, and a task solves a pair of blocks, so neither one very common vector
nor a cell that most queries reach fills a task. Vectors are integers; scores are exact as long as they
fit in 53 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import staged

#: Pivots are rows of lowest hash: a quarter of the root of the number of rows, within these bounds.
PIVOTS, MOST_PIVOTS = 64, 4_096
#: Rows, and queries, of a block, about.
BLOCK, ASKED = 8_192, 4_096
#: Distances or scores that a task works out at once.
AT_ONCE = 2_000_000


def integers(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as a double. Rows with a null vector, or a component
    that is null or not finite, take no part; empty vectors and null ids do."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("embedding").isNotNull()
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(good & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """A matrix; short vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of vectors as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if width and len(column) and (pa.compute.list_value_length(column).to_numpy() == width).all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return padded([np.asarray(v) for v in column.to_pylist()], width)


def best(own: np.ndarray, q: np.ndarray, mark: np.ndarray, order: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of x and score of the k best rows of x for each query, but rows that have its own mark; ties by ``order``."""
    x, mark = x[order], mark[order]
    rows, found, scores = [], [], []
    step = max(1, AT_ONCE // max(1, len(x)))
    for at in range(0, len(q), step):
        every = q[at : at + step] @ x.T
        every[own[at : at + step, None] == mark[None, :]] = -np.inf
        for i, row in enumerate(every):
            # All rows as good as the k-th best, so that ties are settled by id.
            floor = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            at_least = np.flatnonzero((row >= floor) & (row > -np.inf))
            top = at_least[np.argsort(-row[at_least], kind="stable")][:k]
            rows.append(np.full(len(top), at + i))
            found.append(order[top])
            scores.append(row[top])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores).astype(np.int64)


def top_k(queries: DataFrame, data: DataFrame, k: int = 5, pivots: int | None = None, block: int = BLOCK, asked: int = ASKED, visited: list[int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of ``data`` (vec_id, v) for each row of ``queries``, which are rows of ``data``.

    All other rows if there are fewer than k. Ids may repeat and may be null (last in ties): every row of ``data`` is a
    candidate of its own, but for the query's own row, which is one row of its id and vector; and every row of ``queries`` is
    a query of its own; results of one id share a query_id then. Scores are of v as it is; vectors of several lengths are
    compared as if short ones ended in zeros. Empty tables give an empty result. ``visited`` gets the numbers of
    visits of queries to cells, of both passes, and what visits of all cells would be.
    """
    spark = data.sparkSession
    # No query can return more than k of a row's equals, besides its own row, which is the first of them.
    counted = data.groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k + 1)).alias("times"))
    data = staged(counted.select(F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"), "vec_id", "v"), "topk-rows")
    queries = staged(queries.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times")).withColumn("of", F.xxhash64("vec_id", "v")), "topk-queries")
    size = data.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(size[1], queries.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0])
    if not size[0]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    # The pivots and the summaries of cells are bounded: MOST_PIVOTS of each.
    n_pivots = pivots or min(max(PIVOTS, isqrt(size[0]) // 4), MOST_PIVOTS)
    chosen = data.where("nth = 1").select("vec_id", "v").orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(n_pivots).toPandas()
    centres = np.unique(padded(list(chosen["v"]), width), axis=0)
    squares = (centres**2).sum(1)
    lengths = np.sqrt(squares)
    directions = centres / np.where(lengths > 0, lengths, 1)[:, None]
    step = max(1, AT_ONCE // len(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, step) for x in batches for i in range(0, x.num_rows, step)):
            x = matrix(b.column("v"), width)
            far = np.maximum((x**2).sum(1)[:, None] + squares[None, :] - 2 * x @ centres.T, 0)
            cell = far.argmin(1)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64())) if width else b.column("v")
            along = (x * directions[cell]).sum(1)
            across = np.sqrt(np.maximum((x**2).sum(1) - along**2, 0))
            columns = [vectors, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(far[np.arange(len(x)), cell])), pa.array(along), pa.array(across)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("nth"), b.column("mark"), *columns], ["vec_id", "nth", "mark", "v", "cell", "far", "along", "across"])

    # The first of a row's equals bears the mark of the query that it is; the others bear none.
    mark = F.when(F.col("nth") == 1, F.xxhash64("vec_id", "v")).alias("mark")
    marked = data.select("vec_id", "nth", mark, "v").mapInArrow(assign, "vec_id bigint, nth bigint, mark bigint, v array<double>, cell int, far double, along double, across double")
    celled = staged(marked, "topk-cells")
    summary = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("across")).orderBy("cell").toPandas()
    cells, sizes, radii, lows, highs, sides_ = (summary[c].to_numpy() for c in ("cell", "n", "radius", "low", "high", "across"))
    longest = np.sqrt(np.maximum(lows**2, highs**2) + sides_**2)
    blocks = np.maximum(1, -(-sizes // block)).astype(int)

    def sent(b: pa.RecordBatch, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the batch and cells that they go to. Bounds are raised a little, for rounding."""
        x = matrix(b.column("v"), width)
        size = np.sqrt((x**2).sum(1))[:, None]
        around = x @ centres[cells].T + size * radii[None, :]
        along = x @ directions[cells].T
        ranged = np.maximum(along * lows[None, :], along * highs[None, :]) + np.sqrt(np.maximum(size**2 - along**2, 0)) * sides_[None, :]
        limit = np.minimum(around, ranged) + 1e-7 * size * longest[None, :] + 1e-3
        own = np.zeros(limit.shape, bool)
        own[np.arange(len(x)), limit.argmax(1)] = True
        if not first:
            least = b.column("least").to_numpy(zero_copy_only=False).astype(float)
            own = ~own & (limit >= np.where(np.isnan(least), -np.inf, least)[:, None])
        return np.nonzero(own)

    def solved(asking: DataFrame, first: bool) -> DataFrame:
        """What the queries find in the cells that they go to."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(cells), np.int64)
            for b in (x.slice(i, step) for x in batches for i in range(0, x.num_rows, step)):
                total += np.bincount(sent(b, first)[1], minlength=len(cells))
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total)], ["cell", "n"])

        visits = asking.mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        of_cell = dict(zip(visits["cell"], visits["n"], strict=True))
        if visited is not None:
            visited.append(int(visits["n"].sum()))
        sides = np.maximum(1, [-(-int(of_cell.get(c, 0)) // asked) for c in cells]).astype(int)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x.slice(i, step) for x in batches for i in range(0, x.num_rows, step)):
                row, col = sent(b, first)
                side = b.column("of").to_numpy()[row] % sides[col]
                times = blocks[col]
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                take, col, side = pa.array(np.repeat(row, times)), np.repeat(col, times), np.repeat(side, times)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(take) for c in ("vec_id", "of", "v")), pa.array(cells[col].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(side.astype(np.int32))], ["vec_id", "of", "v", "cell", "block", "side"]
                )

        # One row for each cell, so it is sent to all tasks.
        split = F.broadcast(spark.createDataFrame([(int(c), int(n), int(m)) for c, n, m in zip(cells, blocks, sides, strict=True)], "at int, blocks int, sides int"))
        dealt = celled.join(split, F.col("cell") == F.col("at")).withColumn("block", F.pmod(F.xxhash64("vec_id", "nth", "v"), F.col("blocks")).cast("int"))
        dealt = dealt.select("vec_id", "mark", "v", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"))

        def local(asked_: pa.Table, rows: pa.Table) -> pa.Table:
            if asked_.num_rows and rows.num_rows:
                ids, mark = rows.column("vec_id").combine_chunks(), rows.column("mark").combine_chunks()
                order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
                # Rows without a mark are told from those with any by a mark that no query in the task has.
                of = asked_.column("of").combine_chunks().to_numpy()
                free = int(np.setdiff1d(np.arange(len(of) + 1), of)[0])
                row, at, score = best(of, matrix(asked_.column("v"), width), mark.fill_null(free).to_numpy(zero_copy_only=False), order, matrix(rows.column("v"), width), k)
                take = pa.array(row, pa.int64())
                return pa.table({"query_id": asked_.column("vec_id").take(take), "of": asked_.column("of").take(take), "vec_id": ids.take(pa.array(at, pa.int64())), "score": score})
            none = pa.array([], pa.int64())
            return pa.table({"query_id": none, "of": none, "vec_id": none, "score": none})

        routed = asking.mapInArrow(route, "vec_id bigint, of bigint, v array<double>, cell int, block int, side int")
        keys = ("cell", "block", "side")
        return routed.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(local, "query_id bigint, of bigint, vec_id bigint, score bigint")

    each = ("query_id", "of")
    by = W.partitionBy(*each).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    home = staged(solved(queries.select("vec_id", "of", "v"), True), "topk-home")
    kth = home.withColumn("rank", F.row_number().over(by)).where(F.col("rank") == k).select(F.col("query_id").alias("kth_id"), F.col("of").alias("kth_of"), F.col("score").cast("double").alias("least"))
    bounded = staged(queries.join(kth, F.col("vec_id").eqNullSafe(F.col("kth_id")) & (F.col("of") == F.col("kth_of")), "left").select("vec_id", "of", "v", "least"), "topk-bounded")
    rest = solved(bounded, False)
    if visited is not None:
        visited.append(queries.count() * len(cells))
    found = home.unionByName(rest).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    # A query row that occurs several times has as many results.
    more = queries.where("times > 1").select(F.col("vec_id").alias("more_id"), F.col("of").alias("more_of"), "times")
    found = found.join(more, F.col("query_id").eqNullSafe(F.col("more_id")) & (F.col("of") == F.col("more_of")), "left")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long")))))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
