"""Documents with nulls, empty and very long texts, repeated rows and extra columns."""

import os
import sys

# the workers import the package by its path
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

LONG = ("word another third fourth. " * 40_000) + "end"

ROWS = [(1, "The quick brown fox jumps over the lazy dog and runs away from here", "en", 5),
        (2, "THE QUICK brown fox jumps over the lazy dog and runs away from here", "en", 6),
        (3, None, "en", 1), (4, "", None, 2), (5, " \n\t ", "de", 3), (6, "?!... 123", "de", 4),
        (7, LONG, "en", 7), (8, "one", "fr", 8), (9, "ünï ñandú straße ëé", "es", 9),
        (9, "ünï ñandú straße ëé", "es", 9), (None, "no id here but some words to read", None, 1), (None, None, None, None),
        (10, "null\x00byte and tab\tand ▁ mark", "en", 2)]


def documents(spark, rows=None):
    """Extra columns are named like the operators' own helper and result columns."""
    df = spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string, lang string, n long")
    return df.selectExpr("*", "'x' as key", "1 as score", "2 as w", "3 as th", "array(1) as words", "4 as shard", "5 as held_out", "6 as pos")
