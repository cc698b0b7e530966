"""Small page tables with every awkward case."""

from __future__ import annotations

import random

PAGES = "path string, text string, region string"


def pages(spark, rows, extra="main"):
    """A page table with a column that operators must ignore."""
    return spark.createDataFrame([(p, t, extra) for p, t in rows], PAGES)


def by_path(df):
    return {r["path"]: r for r in df.collect()}


def prose(seed: int, words: int, size: int = 400) -> str:
    made = random.Random(seed)
    return " ".join(f"w{made.randrange(size)}" for _ in range(words))


AWKWARD = [("/a", None), ("/b", ""), ("/c", "   \n\t "), (None, "Alone with no path"), (None, None), ("/d", "One two"), ("/d", "One two"), ("/long", "word " * 60_000)]
