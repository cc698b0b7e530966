"""Page texts of stored captures, the input of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_texts(snapshots: DataFrame) -> DataFrame:
    """`side, path, text` of captured pages: the texts of their content nodes in captured order, a line each.

    `snapshots` is what `scan_snapshots` or `scan_snapshot_json` returns. Nodes without text are left out; a page without
    content, or with null content, has an empty text. One row per captured page, repeated ones too.
    """
    lines = F.filter(F.transform("content", lambda node: node["text"]), lambda text: text.isNotNull())
    return snapshots.select("side", "path", F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("text"))
