"""Running aggregates over one long ordered group, split so that no task holds the group.

A plain window partitioned by the group puts the whole group into one task. Here each
group is cut into chunks of positions, every chunk is scanned on its own, and only one
total per chunk is scanned across the group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.session import cut_lineage

CHUNK = 1 << 16
# How a table that is read more than once is stored; where none is given, with `cut_lineage`.
Store = Callable[[DataFrame], DataFrame]


def running(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    value: Column,
    out: str,
    how: str = "max",
    reverse: bool = False,
    inclusive: bool = True,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add `out`: max, min or sum of `value` over the rows of the group up to this one.

    `pos` is a non-negative whole number, ideally dense within the group. `reverse` scans
    from the highest position down; `inclusive=False` leaves the row itself out.
    """
    by = list(by)
    agg = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    order = F.col(pos).desc() if reverse else F.col(pos).asc()
    base = df.withColumns({"_chunk": F.floor(F.col(pos) / F.lit(chunk)).cast("bigint"), "_value": value})

    in_chunk = Window.partitionBy(*by, "_chunk").orderBy(order)
    in_chunk = in_chunk.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = base.withColumn("_run", agg("_value").over(in_chunk)).drop("_value")

    # One row per chunk; only chunks with others before them carry anything, and without such the join falls away.
    totals = base.groupBy(*by, "_chunk").agg(agg("_value").alias("_total"))
    chunk_order = F.col("_chunk").desc() if reverse else F.col("_chunk").asc()
    across = Window.partitionBy(*by).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn("_carry", agg("_total").over(across)).where(F.col("_carry").isNotNull()).drop("_total")
    )
    joined = inner.join(carry, [*by, "_chunk"], "left")
    if how == "sum":
        combined = F.coalesce(F.col("_run"), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    else:
        combined = (F.greatest if how == "max" else F.least)(F.col("_run"), F.col("_carry"))
    return joined.withColumn(out, combined).drop("_chunk", "_run", "_carry")


def around(df: DataFrame, by: Sequence[str], pos: str, value: Column, before: str, after: str, chunk: int = CHUNK) -> DataFrame:
    """Add `before`, the greatest value of earlier rows of the group, and `after`, the least of later ones, to stored rows.

    One sort per chunk serves both, and one row per chunk carries both across chunks, where there are several.
    """
    by = list(by)
    base = df.withColumns({"_chunk": F.floor(F.col(pos) / F.lit(chunk)).cast("bigint"), "_value": value})
    place = Window.partitionBy(*by, "_chunk").orderBy(pos)
    inner = base.withColumns(
        {
            "_low": F.max("_value").over(place.rowsBetween(Window.unboundedPreceding, -1)),
            "_high": F.min("_value").over(place.rowsBetween(1, Window.unboundedFollowing)),
        }
    )
    if short(df, pos, chunk):
        return inner.withColumnsRenamed({"_low": before, "_high": after}).drop("_chunk", "_value")
    totals = base.groupBy(*by, "_chunk").agg(F.max("_value").alias("_most"), F.min("_value").alias("_least"))
    across = Window.partitionBy(*by).orderBy("_chunk")
    carry = totals.select(
        *by, "_chunk", F.max("_most").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"),
        F.min("_least").over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_above"),
    ).where(F.col("_below").isNotNull() | F.col("_above").isNotNull())
    joined = inner.join(carry, [*by, "_chunk"], "left")
    found = joined.withColumns({before: F.greatest("_low", "_below"), after: F.least("_high", "_above")})
    return found.drop("_chunk", "_value", "_low", "_high", "_below", "_above")


def occurrence(df: DataFrame, by: Sequence[str], pos: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """Add `out`: how many earlier rows of the group there are, counted from 0."""
    df = running(df, by, pos, F.lit(1).cast("bigint"), out, how="sum", inclusive=False, chunk=chunk)
    return df.withColumn(out, F.col(out).cast("bigint"))


def short(df: DataFrame, pos: str, chunk: int = CHUNK) -> bool:
    """Whether no position reaches a second chunk, so that one pass over chunks is all. For stored rows: it reads `pos` alone."""
    return df.where(F.col(pos) >= chunk).isEmpty()


def chunk_occurrence(df: DataFrame, by: Sequence[str], pos: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """`occurrence` within chunks, and `_chunk`. Stored, it goes on to `carried_occurrence`: so rows that are costly to make, and wide, are made, shuffled and stored once."""
    parts = df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(chunk)).cast("bigint"))
    place = Window.partitionBy(*by, "_chunk").orderBy(pos)
    return parts.withColumn(out, (F.row_number().over(place) - 1).cast("bigint"))


def carried_occurrence(
    stored: DataFrame, by: Sequence[str], pos: str, out: str, chunk: int = CHUNK, store: Store | None = None
) -> DataFrame:
    """Add to the counts of `chunk_occurrence` those of earlier chunks, where there are any."""
    if short(stored, pos, chunk):
        return stored.drop("_chunk")
    across = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = stored.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n")).withColumn("_carry", F.sum("_n").over(across))
    joined = stored.join(carry.where(F.col("_carry").isNotNull()).drop("_n"), [*by, "_chunk"], "left")
    return (store or cut_lineage)(joined.withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))).drop("_chunk", "_carry"))


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add `out`: the place of each row in its group by the columns `order`, from 0, for columns of any orderable type.

    Rows are sorted by range over all groups and stored, so a big group spreads over many tasks; only one count per
    group and task is summed up across a group. Rows equal in all of it are numbered in any order.
    """
    by = list(by)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*by, *order, "_tie").sortWithinPartitions(*by, *order, "_tie").drop("_tie")
    placed = cut_lineage(ranged.withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    counts = placed.groupBy(*by, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0)) - F.col("_first")).drop("_first", "_n")
    same = reduce(lambda x, y: x & y, [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*by, "_part")])
    joined = placed.alias("p").join(counts.alias("c"), same)
    return joined.select(*[F.col(f"p.{c}").alias(c) for c in df.columns], (F.col("p._row") + F.col("c._before")).alias(out))


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group, the first by `order`, with map-side combine instead of a window."""
    by = list(by)
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(
        F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_row")
    )
    return picked.select(*by, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)
