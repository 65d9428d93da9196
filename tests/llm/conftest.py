import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import DOCS, row  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, clashing extra columns."""
    words = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [row(1, None), row(2, ""), row(3, " \n\t"), row(4, "One two three four five six"),
            row(5, "one two three four five six"), row(5, "one two three four five six"), row(6, words),
            row(7, words + " tail"), row(None, "One two three four five six"), row(8, "solo", None, None),
            row(9, "été 北京 ñandú"), row(10, "12345 67 !!!")]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS score", "'x' AS h", "2 AS n", "true AS kept", "0 AS target", "'k' AS key")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
