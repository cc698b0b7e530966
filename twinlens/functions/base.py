"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`.

    Without it a value used ten times is written ten times into the generated code, and a
    few levels of that outgrow the size a compiled method may have.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity, as the stored results do."""
    scale = 10.0**digits
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def number_text(value: Column) -> Column:
    """Shortest text of a number: no trailing zeros, no trailing point."""
    return let(
        value,
        lambda v: F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(
            F.regexp_replace(v.cast("decimal(28,6)").cast("string"), r"\.?0+$", "")
        ),
    )
