"""Run-over-run comparison of stored findings, and the noise floor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.operators.findings import at_or_above, ranking, severity_rank
from twinlens.operators.scan import number_rows
from twinlens.session import cut_lineage

BUCKETS = ("added", "fixed", "changed", "unchanged")


def canonical_json(col: Column) -> Column:
    """JSON text that does not depend on key order or spacing; NULL stays NULL.

    VARIANT keeps object keys sorted, so a round trip through it is the canonical form.
    """
    return F.coalesce(F.to_json(F.try_parse_json(col)), col)


_STATE = ("severity", "category", "path", "label", "viewport", "expected_json", "actual_json", "magnitude")


def _paired(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """Both sides by `on`, which holds nulls like any other value; each side keeps its rows."""
    b, a = before.alias("b"), after.alias("a")
    same = reduce(lambda x, y: x & y, [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in on])
    joined = b.join(a, same, "full_outer")
    return joined.select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in on], F.col("b.state").alias("previous"), F.col("a.state").alias("current"))


def _repeated_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs of findings whose id repeats: equal ones first, then the n-th that is left against the n-th."""
    kind = ["id", "severity", "expected", "actual"]
    order = ["path", "label", "viewport", "category", "magnitude"]

    def numbered(df: DataFrame, by: list[str], more: list[str]) -> DataFrame:
        flat = df.select(
            "id", F.col("state.severity").alias("severity"), canonical_json(F.col("state.expected_json")).alias("expected"),
            canonical_json(F.col("state.actual_json")).alias("actual"), severity_rank(F.col("state.severity")).alias("rank"),
            *[F.col(f"state.{c}").alias(c) for c in order], "state",
        )
        return number_rows(flat, by, [*more, *order], "nth")

    alike = cut_lineage(_paired(numbered(before, kind, []), numbered(after, kind, []), [*kind, "nth"]))
    both = F.col("previous").isNotNull() & F.col("current").isNotNull()
    left = alike.where(~both)
    rest = lambda name: numbered(left.where(F.col(name).isNotNull()).select("id", F.col(name).alias("state")), ["id"], ["rank", "expected", "actual"])
    others = _paired(rest("previous"), rest("current"), ["id", "nth"])
    return alike.where(both).select("id", "previous", "current").unionByName(others.select("id", "previous", "current"))


def diff_runs(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Full outer pairing on id: bucket, escalation flag and both sides' state.

    Every finding is in one row. An id that occurs once on each side, as most do, is one join. Of an id that repeats,
    findings of equal severity and values pair first, the others by their place in report order; what one side has more
    is fixed or added.
    """
    state = F.struct(*_STATE).alias("state")
    # Read several times below, and findings may be the end of long plans.
    before, after = cut_lineage(baseline.select("id", state)), cut_lineage(current.select("id", state))
    counted = before.select("id", F.lit(0).alias("side")).unionByName(after.select("id", F.lit(1).alias("side"))).groupBy("id", "side").count()
    repeated = cut_lineage(counted.where("count > 1").select("id").distinct())
    if repeated.isEmpty():
        joined = before.withColumnRenamed("state", "previous").join(after.withColumnRenamed("state", "current"), "id", "full_outer")
    else:
        once = [df.join(repeated, "id", "left_anti") for df in (before, after)]
        more = [df.join(repeated, "id", "left_semi") for df in (before, after)]
        joined = _paired(*once, ["id"]).unionByName(_repeated_pairs(*more))
    same = lambda name: canonical_json(F.col(f"previous.{name}")).eqNullSafe(
        canonical_json(F.col(f"current.{name}"))
    )
    moved = (F.col("previous.severity") != F.col("current.severity")) | ~same("expected_json") | ~same("actual_json")
    bucket = (
        F.when(F.col("previous").isNull(), F.lit("added"))
        .when(F.col("current").isNull(), F.lit("fixed"))
        .when(moved, F.lit("changed"))
        .otherwise(F.lit("unchanged"))
    )
    worse = severity_rank(F.col("current.severity")) < severity_rank(F.col("previous.severity"))
    return joined.withColumns(
        {"bucket": bucket, "escalated": F.coalesce((bucket == "changed") & worse, F.lit(False))}
    )


def shown_state() -> Column:
    return F.coalesce(F.col("current"), F.col("previous"))


def bucket_counts(diff: DataFrame) -> DataFrame:
    return (
        diff.withColumn("severity", shown_state()["severity"])
        .groupBy("bucket", "severity")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def run_totals(findings: DataFrame) -> DataFrame:
    """Counts by severity of each stored run."""
    return findings.groupBy("run_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")],
        F.count(F.lit(1)).alias("total"),
    )


def top_rows(diff: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of each bucket in report order; with `rows`, its first ones, their rank, and how many more there are.

    The cut stands right after the rank, so each task sends only its own first rows. Without a cut there is no rank,
    and the sort is spread over all tasks.
    """
    flat = diff.select(
        "id", "bucket", *[shown_state()[c].alias(c) for c in ("severity", "category", "path", "label", "magnitude")]
    )
    if rows is None:
        return flat.orderBy("bucket", *ranking()).drop("magnitude")
    order = Window.partitionBy("bucket").orderBy(*ranking())
    shown = flat.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
    totals = diff.groupBy("bucket").agg(F.count(F.lit(1)).alias("bucket_size"))
    more = F.greatest(F.col("bucket_size") - rows, F.lit(0))
    return shown.join(totals, "bucket").withColumn("more", more).drop("bucket_size", "magnitude")


def comparability_checks() -> Column:
    """Reasons why a run (`c_` columns) and its baseline (`b_` columns) do not measure the same thing."""
    return F.array_compact(
        F.array(
            F.when(
                F.col("b_source_base_url") != F.col("c_source_base_url"),
                F.lit("the runs crawled different source sites"),
            ),
            F.when(
                F.col("b_target_base_url") != F.col("c_target_base_url"),
                F.lit("the runs compared different target sites"),
            ),
            F.when(
                F.array_sort("b_viewports") != F.array_sort("c_viewports"), F.lit("the runs used different viewports")
            ),
        )
    )


def _sides(runs: DataFrame, side: str) -> DataFrame:
    return runs.select(
        *[F.col(c).alias(f"{side}_{c}") for c in ("run_id", "source_base_url", "target_base_url", "viewports")]
    )


def _one_run(runs: DataFrame) -> DataFrame:
    single = F.when(F.count(F.lit(1)) <= 1, F.lit(True)).otherwise(F.raise_error("one run is compared with one run").cast("boolean"))
    return runs.agg(*[F.any_value(c).alias(c) for c in runs.columns], single.alias("_single")).where("_single").drop("_single")


def comparability_warnings(baseline_run: DataFrame, current_run: DataFrame) -> DataFrame:
    """One row per reason; an input of more than one run is an error."""
    both = _one_run(_sides(baseline_run, "b")).crossJoin(_one_run(_sides(current_run, "c")))  # aggregates of one row
    return both.select(F.explode(comparability_checks()).alias("warning"))


def warnings_by_run(runs: DataFrame, previous: DataFrame) -> DataFrame:
    """Number of reasons for each stored run against the run before it."""
    joined = (
        previous.where(F.col("baseline_id").isNotNull())
        .join(_sides(runs, "c"), F.col("run_id") == F.col("c_run_id"))
        .join(_sides(runs, "b"), F.col("baseline_id") == F.col("b_run_id"))
    )
    return joined.select("run_id", F.size(comparability_checks()).alias("warnings"))


def regression_gate(diff: DataFrame, floor: str = "info") -> DataFrame:
    """One row: new findings at or above the floor and the exit code."""
    new = diff.where(F.col("bucket") == "added").select("current.severity")
    counted = at_or_above(new, floor).agg(F.count(F.lit(1)).alias("new_findings"))
    return counted.withColumn("exit_code", F.when(F.col("new_findings") > 0, 1).otherwise(0))


def noise_floor(self_comparison: DataFrame) -> DataFrame:
    """Ids a site produces against itself, in report order: what to suppress."""
    return self_comparison.orderBy(*ranking()).select("id")
