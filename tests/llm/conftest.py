import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASHING = ["row", "size", "turn", "key", "nth", "rep", "words", "component", "language", "mark", "due", "gid", "version", "begin", "passes", "block", "slot",
            "torn_row", "torn_key", "torn_head", "torn_id", "torn_rows", "torn_k1", "torn_k2", "torn_n_words", "own_id", "own_key", "a.b"]


def odd_rows():
    """Repeated rows, ties, nulls in every column, empty and blank texts, code points beyond the BMP, a very long text."""
    base = " ".join(f"wort{i % 37}" for i in range(60))
    rows = [
        (1, base, "de", "s"),
        (1, base, "de", "s"),
        (2, base + " ende", "de", "t"),
        (3, None, None, None),
        (4, "", "en", "s"),
        (5, " \n\t ", "en", None),
        (6, "😀 é ß \x1f \u00a0 x", None, "u"),
        (7, "drei worte nur", "de", "s"),
        (8, "Drei  Worte\nnur", "de", "t"),
        (9, "the and of to in a is that " * 12_000, "en", "s"),
        (10, "the cat sat on the mat and the dog ran.\nA second line! A third?", "en", None),
        (None, "no id but some words here", "en", "s"),
        (11, "%%% ### $$$ 123", None, "u"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)}).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
