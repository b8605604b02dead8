"""Connected components of a graph in Spark, by alternating large and small stars.

Every round links each node to the least node of its neighbourhood; after a number of rounds that
grows with the logarithm of the graph, each component is a star around its least node. A node with
very many neighbours is only ever a key of a minimum, which is combined before the shuffle, and of a
join: the ``SENT`` nodes of most neighbours are sent to all tasks, so that their edges stay where they
are. Any other node has less than one in ``SENT`` of all ends of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.staging import staged

#: Nodes of at least so many neighbours may be sent, and so many of these at most: a few MB.
HOT, SENT = 256, 20_000


def _least_beside(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (a, b) with the least node m that ``least`` (of, m, n) has for a; n is a's number of neighbours."""
    hot = staged(least.where(F.col("n") >= HOT).orderBy(F.col("n").desc(), "of").limit(SENT).select(F.col("of").alias("hot"), F.col("m").alias("hot_m")), "components-hot")
    met = edges.join(F.broadcast(hot), F.col("a") == F.col("hot"), "left")
    cool = met.where("hot IS NULL").select("a", "b").join(least, F.col("a") == F.col("of")).select("a", "b", "m")
    return met.where("hot IS NOT NULL").select("a", "b", F.col("hot_m").alias("m")).unionByName(cool)


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours get the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("a", "of")
    return _least_beside(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get the least of these. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("a", "of")
    near = _least_beside(edges, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) -> node, component: its least node. Nodes without an edge to another are absent.

    ``a`` and ``b`` are of any one type with an order; null ends, loops and repeated edges are ignored.
    """
    turned = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = staged(turned, "components")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        now = staged(_small(staged(_large(now), "components-large")), "components")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
