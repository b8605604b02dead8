"""Line dedup by winnowing over line hashes. DataFrame functions only.

A run of lines is repeated if its lines stand, one after another, at an earlier place: in a document
with a smaller id, or further up in the same one. It counts from ``run`` lines on, or, where lines are
whole paragraphs, from ``words`` words on. Later repeated runs are deleted. To find them:

1. Each line is hashed to 128 bits. In every window of ``run`` lines, and in every shorter window that
   has ``words`` words, the line of least hash (the leftmost, in ties) is selected; a line that several
   windows select is one fingerprint. Two equal windows select the same line: winnowing's guarantee.
2. Fingerprints are grouped by the selected line. Those that stand at one place only go; every later
   place is joined to the first. A line that very many documents share is grouped in ``SALTS`` parts
   first, so no task gets all its places.
3. From each such place the match with the first is extended both ways, line by line, as far as a window
   that selected it can reach. Longer runs have a fingerprint in every ``run`` lines, so these overlap.
4. The first place of a line may have other neighbours than an earlier place further on. Windows that
   selected a place and aren't inside its match are grouped by their lines, and joined to their first.
5. The lines of both kinds of matches are deleted.

All lines count, empty ones too, as they stand.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import n_words, staged

#: A repeated run is deleted from so many lines on, or from so many words on.
RUN, WORDS = 3, 50
#: The parts in which the places of one line are grouped, a power of 2.
SALTS = 64


def lines(text: str | Column) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n")


def _key() -> list[Column]:
    """What tells documents apart: id, and a hash of the text for ids that occur twice."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("part")]


def _sum(columns: list[Column]) -> Column:
    return reduce(add, columns)


def selected(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """doc_id, part, at, near: the fingerprints of each document, each once.

    ``near`` has the line at ``at`` and ``run - 1`` lines on either side, each as its hash (a, b) and
    its number of words k; null where the text ends.
    """
    line = F.transform(lines("text"), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), n_words(x).cast("int").alias("k")))
    hashed = docs.select(*_key(), line.alias("h"))
    hashed = hashed.select("doc_id", "part", "h", F.col("h.a").alias("a"), F.col("h.k").alias("k"))

    def minima(n: int) -> Column:
        starts = F.when(F.size("a") >= n, F.sequence(F.lit(0), F.size("a") - n)).otherwise(F.array().cast("array<int>"))
        if n < run:
            starts = F.filter(starts, lambda i: _sum([F.get("k", i + j) for j in range(n)]) >= words)
        return F.transform(starts, lambda i: (i + F.array_position(F.slice("a", i + 1, n), F.array_min(F.slice("a", i + 1, n))) - 1).cast("int"))

    places = F.array_distinct(F.concat(*map(minima, range(1, run + 1))))
    near = F.transform(places, lambda at: F.struct(at.alias("at"), F.array(*(F.get("h", at + j) for j in range(1 - run, run))).alias("near")))
    return hashed.select("doc_id", "part", F.explode(near).alias("f")).select("doc_id", "part", "f.at", "f.near")


def met(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (with ``place``, a struct that starts with doc_id and part) whose ``key`` stands at several places, with the first of these."""
    # ``key`` and the salt can't be null, so no filter sets the two sides apart: they read one exchange.
    salted = rows.withColumn("salt", F.xxhash64("place.doc_id", "place.part").bitwiseAND(SALTS - 1)).repartition(key, "salt")
    each = W.partitionBy("key")
    firsts = salted.groupBy(F.col(key).alias("key"), F.col("salt").alias("of")).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    firsts = firsts.withColumns({"first": F.min("first").over(each), "last": F.max("last").over(each)}).where("first <> last").select("key", "of", "first")
    return salted.join(firsts, (F.col(key) == F.col("key")) & (F.col("salt") == F.col("of"))).select("place", key, "first")


def repeats(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """doc_id, part, start, n: runs (of n lines) that stand at an earlier place too; they may overlap."""
    place = F.struct("doc_id", "part", "at", "near").alias("place")
    prints = selected(docs, run, words).select(place, F.coalesce(F.element_at("near", run).a, F.lit(0)).alias("print"))
    later = staged(met(prints, "print").where("place > first"), "lines-later").select("place.*", F.col("first.near").alias("there"))

    def same(j: int) -> Column:
        return F.coalesce(F.get("near", F.lit(j)) == F.get("there", F.lit(j)), F.lit(False))

    def reach(step: int) -> Column:
        """How many lines in a row agree, from the fingerprint on."""
        out = F.lit(0)
        for j in reversed(range(1, run)):
            out = F.when(same(run - 1 + step * j), out + 1).otherwise(0)
        return out

    later = later.withColumns({"left": F.when(same(run - 1), reach(-1)).otherwise(-1), "right": F.when(same(run - 1), reach(1)).otherwise(-1)})
    # Both sides have the fingerprint; a match of another line with its hash has no lines.
    n = F.greatest(F.col("left") + F.col("right") + 1, F.lit(0))
    in_all = F.aggregate(F.slice("near", F.lit(run) - F.greatest("left", F.lit(0)), n), F.lit(0), lambda t, x: t + x.k)
    extended = later.where((n >= run) | (in_all >= words)).select("doc_id", "part", (F.col("at") - F.col("left")).alias("start"), n.alias("n"))

    def window(first: int, size: int) -> Column:
        """The window's struct if it selected the fingerprint and isn't in the match; else null."""
        own = [F.get("near", F.lit(run - 1 + first + i)) for i in range(size)]
        least = F.lit(True)
        for i, x in enumerate(own):
            if first + i:
                least &= (own[-first].a < x.a) if i < -first else (own[-first].a <= x.a)
        whole = reduce(lambda p, q: p & q, [x.isNotNull() for x in own])
        counts = F.lit(True) if size == run else _sum([x.k for x in own]) >= words
        outside = (F.col("left") < -first) | (F.col("right") < first + size - 1)
        return F.when(whole & least & counts & outside, F.struct((F.col("at") + first).alias("at"), F.lit(size).alias("n"), F.array(*own).alias("window")))

    open_ = F.array_compact(F.array(*(window(first, size) for size in range(1, run + 1) for first in range(1 - size, 1))))
    rest = later.select("doc_id", "part", F.explode(open_).alias("w")).select(F.struct("doc_id", "part", "w.at", "w.n").alias("place"), "w.window")
    again = met(rest, "window").where("place > first").select("place.doc_id", "place.part", F.col("place.at").alias("start"), "place.n")
    return extended.unionByName(again)


def dedup_lines(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``docs`` with n_lines, n_removed and kept (its text without later repeated runs of lines).

    Null and empty texts have one empty line. Null ids come first. Rows that agree in id and text are
    one document and get the same result; of rows with one id and several texts, that of lower hash is
    the earlier. Columns of ``docs`` with the names of results are dropped, all others stay, whatever
    their names. An empty table gives an empty result.
    """
    gone = repeats(docs, run, words).groupBy("doc_id", "part").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    gone = gone.select(F.struct("doc_id", "part").alias("of"), "runs")
    rows = docs.select(F.struct(*_key()).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed", "kept"))).alias("row"))
    same = F.col("key.doc_id").eqNullSafe(F.col("of.doc_id")) & (F.col("key.part") == F.col("of.part"))
    # Texts are shuffled once and not sorted: the hash side has only the places of runs.
    cut = rows.join(gone.hint("shuffle_hash"), same, "left").select("row", lines("row.text").alias("l"), F.flatten(F.transform("runs", lambda r: F.sequence(r.start, r.start + r.n - 1))).alias("gone"))
    left = F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("l") - 1), "gone"))
    whole = F.struct(F.size("l").alias("n"), F.size("l").alias("left"), F.coalesce("row.text", F.lit("")).alias("kept"))
    some = F.transform(F.array(left), lambda at: F.struct(F.size("l").alias("n"), F.size(at).alias("left"), F.array_join(F.transform(at, lambda i: F.get("l", i)), "\n").alias("kept")))
    # A generator is worked out once, however many later columns and filters use its result.
    made = cut.select("row", F.inline(F.when(F.col("gone").isNull(), F.array(whole)).otherwise(some)))
    return made.select("row.*", F.col("n").cast("long").alias("n_lines"), (F.col("n") - F.col("left")).cast("long").alias("n_removed"), "kept")
