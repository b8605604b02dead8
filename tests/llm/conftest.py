from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

PASSAGE = "\n".join(f"line {i} of a passage that several documents share word for word" for i in range(6))


@pytest.fixture(scope="session")
def messy(spark: SparkSession) -> DataFrame:
    """Nulls, empty and long texts, repeated rows, ties, a hot source, other columns with clashing names."""
    rows = [
        (1, f"a start of its own\n{PASSAGE}\nand an end", "s"),
        (2, f"another start\n{PASSAGE}", "s"),
        (3, PASSAGE, "s"),
        (3, PASSAGE, "s"),
        (4, PASSAGE.replace("line 3", "row 3"), "s"),
        (5, None, "s"),
        (6, "", None),
        (7, " \t\n ", "t"),
        (8, "one two three", "t"),
        (9, "one two three", "t"),
        (None, "a text whose document has no id at all but some words", "s"),
        (10, " ".join(f"w{i % 977}é" for i in range(40_000)), "s"),
        (11, "it's   odd spacing, 日本語 🙂 and\x0bsigns\r\n" * 40, "u"),
        (12, "x" * 50_000 + " " * 5_000 + "y", "u"),
        (13, f"{PASSAGE}\n{PASSAGE}", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.selectExpr("*", "'en' AS lang", "CAST(length(text) AS BIGINT) AS n_chars", "1 AS stats", "2 AS part", "3 AS n_removed", "4 AS kept", "5 AS score")


@pytest.fixture(scope="session")
def none(messy: DataFrame) -> DataFrame:
    return messy.where("false")
