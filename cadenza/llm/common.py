"""What the text operators share: the word rule, folds, table access and lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.staging import staged

__all__ = ["WORD", "crc_mod", "n_words", "one_text", "staged", "table", "words"]

#: A word is a run of anything but ASCII white space. ``bytes.split()`` cuts UTF-8 in the same places.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def n_words(text: str | Column) -> Column:
    """How many words a text column has; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def one_text(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text, label: one row of ``docs`` for each id of ``chosen`` (id, label), that of least hash of its text, however many rows bear it.

    ``chosen`` is sent to all tasks, so its rows are bounded by whoever gives it. Tasks keep one text of an id before anything is shuffled.
    """
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    least = F.min_by("text", F.xxhash64(F.coalesce("text", F.lit(""))))
    return met.groupBy("doc_id", "label").agg(least.alias("text")).select("doc_id", "text", "label")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """The fold of a document: crc32 of its id's decimal text, modulo ``n``."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)).cast("int")
