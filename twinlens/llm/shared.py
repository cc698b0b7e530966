"""What several operators need: typed schemas, stored intermediate tables, sizes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.session import cut_lineage, shuffles_end_with_their_action  # noqa: F401


def keep(df: DataFrame) -> DataFrame:
    """Store a result that later steps read more than once, in the folder all executors share."""
    return cut_lineage(df)


def key_type(df: DataFrame, name: str = "path") -> T.DataType:
    return df.schema[name].dataType


def schema(*fields: tuple[str, T.DataType | str]) -> T.StructType:
    """A nullable schema from names and type names."""
    named = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "byte": T.ByteType()}
    return T.StructType([T.StructField(n, named[t] if isinstance(t, str) else t) for n, t in fields])


@contextmanager
def few_rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """While open, batches sent to Python hold so few rows; for actions over rows that are large by design."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def page_texts(pages: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that further columns of any name cannot clash."""
    return pages.select("path", "text", *more)


def text_bytes(pages: DataFrame) -> int:
    """Bytes of text, over all pages."""
    return pages.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def blocks_for(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession
