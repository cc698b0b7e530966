"""Settings as tables: device profiles and severities, joined by their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE_DDL = "viewport string, label string, width int, height int, device_scale_factor double, is_mobile boolean, has_touch boolean"
# The screens a run may name.
DEVICES = (
    ("mobile-sm", "Small phone (360x740)", 360, 740, 3.0, True, True),
    ("mobile-md", "Medium phone / iPhone 15-16 class (393x852)", 393, 852, 3.0, True, True),
    ("mobile-lg", "Large phone / iPhone 17 class (402x874)", 402, 874, 3.0, True, True),
    ("mobile-xl", "Phone Max / Pro Max class (440x956)", 440, 956, 3.0, True, True),
    ("tablet", "Tablet portrait (768x1024)", 768, 1024, 2.0, True, True),
    ("tablet-landscape", "Tablet landscape (1024x768)", 1024, 768, 2.0, True, True),
    ("desktop", "Desktop (1440x900)", 1440, 900, 1.0, False, False),
    ("desktop-xl", "Large desktop (1920x1080)", 1920, 1080, 1.0, False, False),
)


def device_profiles(spark: SparkSession, custom: DataFrame | None = None) -> DataFrame:
    """One row per viewport id. `custom`, of the same columns, adds profiles and takes the place of built-in ones.

    Of custom profiles that share an id the one with the greatest row stays.
    """
    known = spark.createDataFrame(DEVICES, PROFILE_DDL)
    if custom is None:
        return known
    names = known.columns[1:]
    own = custom.groupBy("viewport").agg(F.max(F.struct(*names)).alias("p")).select("viewport", *[F.col(f"p.{c}").alias(c) for c in names])
    return known.join(own, "viewport", "left_anti").unionByName(own)


def resolve_viewports(named: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add the profile of each row's `viewport`; an id that no profile has ends the job instead of skipping a screen."""
    found = named.join(profiles.withColumn("_known", F.lit(True)), "viewport", "left")
    complaint = F.raise_error(F.concat(F.lit("no such viewport: "), F.coalesce("viewport", F.lit("null")))).cast("int")
    # The width carries the check, so it is made whatever else a reader drops.
    return found.withColumn("width", F.when(F.col("_known"), F.col("width")).otherwise(complaint)).drop("_known")


def with_severities(findings: DataFrame, severities: DataFrame) -> DataFrame:
    """Findings with the severity a project has set for their category, or else the one they have.

    `severities(category, severity)` is a table of the project; of rows that share a category the most serious one
    counts.
    """
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    own = severities.groupBy("category").agg(F.min_by("severity", rank).alias("_own"))
    joined = findings.join(own, "category", "left").withColumn("severity", F.coalesce("_own", "severity"))
    return joined.select(*findings.columns)
