"""Bounded reach over the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.session import cut_lineage


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, followed: DataFrame | None = None) -> DataFrame:
    """Pages within `max_depth` hops of a seed, with the fewest hops to each.

    `edges(src, dst)`, `seeds(path)`. Links are followed only from pages in `followed`
    (captured, not aliases) when that is given. Each hop reads only the newest pages and is
    written to the checkpoint folder, so a lost executor never replays the whole walk.
    """
    edges = edges.select("src", "dst").distinct()
    if followed is not None:
        edges = edges.join(followed.select(F.col("path").alias("src")).distinct(), "src", "left_semi")
    visited = cut_lineage(seeds.select("path").distinct().withColumn("hops", F.lit(0)))
    fresh = visited
    for hop in range(1, max_depth + 1):
        reached = (
            fresh.select(F.col("path").alias("src"))
            .join(edges, "src")
            .select(F.col("dst").alias("path"))
            .distinct()
            .join(visited, "path", "left_anti")
        )
        fresh = cut_lineage(reached.withColumn("hops", F.lit(hop)))
        visited = visited.unionByName(fresh)
    return visited
