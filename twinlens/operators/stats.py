"""Aggregates: parity statistics, finding counts, page roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.operators.findings import CATEGORIES, REGIONS, SEVERITIES, reachable



def percent(part: Column, total: Column) -> Column:
    """Share in percent with one decimal; 100 when there is nothing to compare."""
    share = F.floor(part.cast("double") / total * 1000.0 + F.lit(0.5)) / 10.0
    return F.when(total == 0, F.lit(100.0)).otherwise(share)


def content_stats(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Node counts over content pairs (`source`, `target`, `identical`); per page or for the run."""
    s, t = F.col("source").isNotNull(), F.col("target").isNotNull()
    both = s & t
    out = pairs.groupBy(*by).agg(
        F.count_if(s).alias("source_nodes"),
        F.count_if(t).alias("target_nodes"),
        F.count_if(both).alias("matched_nodes"),
        F.count_if(both & ~F.col("identical")).alias("drifted_nodes"),
        F.count_if(s & ~t).alias("missing_nodes"),
        F.count_if(t & ~s).alias("added_nodes"),
    )
    same = F.col("matched_nodes") - F.col("drifted_nodes")
    return out.withColumn("content_parity", percent(same, F.col("source_nodes")))


def reordered_nodes(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Matched pairs that share one source identity: zero wherever identities are unique."""
    matched = pairs.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    identity = F.concat(F.col("source.key"), F.lit("#"), F.col("source.ordinal").cast("string"))
    # Two steps keep the distinct count spread over identities instead of one page.
    per_identity = matched.groupBy(*by, identity.alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    return per_identity.groupBy(*by).agg((F.sum("_n") - F.count(F.lit(1))).alias("reordered_nodes"))


def image_stats(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Image counts; parity over the run subtracts both kinds of drift, per page it counts clean pairs."""
    s, t = F.col("source").isNotNull(), F.col("target").isNotNull()
    both = s & t
    alt, size = both & F.col("alt_drift"), both & F.col("size_drift")
    out = pairs.groupBy(*by).agg(
        F.count_if(s).alias("source_images"),
        F.count_if(t).alias("target_images"),
        F.count_if(both).alias("matched_images"),
        F.count_if(s & ~t).alias("missing_images"),
        F.count_if(t & ~s).alias("added_images"),
        F.count_if(alt).alias("alt_drifts"),
        F.count_if(size).alias("size_drifts"),
        F.count_if(both & ~F.col("alt_drift") & ~F.col("size_drift")).alias("_clean"),
    )
    run = F.col("matched_images") - F.col("alt_drifts") - F.col("size_drifts")
    good = F.col("_clean") if by else run
    return out.withColumn("image_parity", percent(good, F.col("source_images"))).drop("_clean")


def price_stats(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    s, t = F.col("source").isNotNull(), F.col("target").isNotNull()
    both = s & t
    out = pairs.groupBy(*by).agg(
        F.count_if(s).alias("source_prices"),
        F.count_if(t).alias("target_prices"),
        F.count_if(both).alias("matched_prices"),
        F.count_if(both & F.col("value_drift")).alias("value_drifts"),
        F.count_if(both & F.col("currency_drift")).alias("currency_drifts"),
        F.count_if(both & F.col("format_drift")).alias("format_drifts"),
        F.count_if(s & ~t).alias("missing_prices"),
        F.count_if(t & ~s).alias("added_prices"),
    )
    same = F.col("matched_prices") - F.col("value_drifts")
    good = same if by else same - F.col("currency_drifts")
    return out.withColumn("price_parity", percent(good, F.col("source_prices")))


def css_stats(per_viewport: DataFrame) -> DataFrame:
    """Per-viewport rows plus the grand total (viewport NULL) in one pass."""
    out = per_viewport.rollup("viewport").agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
            for c in ("compared_nodes", "compared_properties", "property_drifts", "layout_drifts", "visibility_drifts")
        ]
    )
    good = F.col("compared_properties") - F.col("property_drifts")
    return out.withColumn("style_parity", percent(good, F.col("compared_properties")))


def top_properties(drifts: DataFrame, property_col: str = "property", rows: int | None = None) -> DataFrame:
    """Drifting properties over the whole run, most frequent first, exact."""
    counted = drifts.groupBy(F.col(property_col).alias("property")).agg(F.count(F.lit(1)).alias("count"))
    ordered = counted.orderBy(F.col("count").desc(), F.col("property").asc())
    return ordered if rows is None else ordered.limit(rows)


def _dimension(df: DataFrame, rows: Sequence[tuple[str, str]]) -> DataFrame:
    values = F.array(*[F.struct(F.lit(a).alias("dimension"), F.lit(b).alias("value")) for a, b in rows])
    return df.sparkSession.range(1).select(F.inline(values))


def finding_counts(findings: DataFrame) -> DataFrame:
    """Counts by severity, category and region in one pass; severities and regions keep zero rows."""
    region = F.coalesce(F.col("region"), F.lit("none"))
    counted = (
        reachable(findings)
        .select("severity", "category", region.alias("region"))
        .groupingSets([["severity"], ["category"], ["region"]], "severity", "category", "region")
        .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("g"))
    )
    which = F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "category").otherwise("region")
    flat = counted.select(
        which.alias("dimension"), F.coalesce("severity", "category", "region").alias("value"), "count"
    )
    fixed = [("severity", s) for s in SEVERITIES] + [("region", r) for r in (*REGIONS, "none")]
    zero = _dimension(findings, fixed).withColumn("count", F.lit(0).cast("bigint"))
    return flat.unionByName(zero).groupBy("dimension", "value").agg(F.sum("count").alias("count"))


def page_rollup(pairs: DataFrame, findings: DataFrame, orphans: DataFrame | None = None) -> DataFrame:
    """Per compared page: counts by severity, total, clean and slow flags."""
    if orphans is not None:
        pairs = pairs.join(orphans.select("path").distinct(), "path", "left_anti")
    counted = (
        reachable(findings)
        .groupBy("path")
        .pivot("severity", list(SEVERITIES))
        .agg(F.count(F.lit(1)))
    )
    joined = pairs.join(counted, "path", "left")
    zero = {s: F.coalesce(F.col(s), F.lit(0)).cast("bigint") for s in SEVERITIES}
    out = joined.select(
        "path",
        "source_url",
        "target_url",
        "slow_capture",
        *[zero[s].alias(f"{s}s") for s in SEVERITIES],
    )
    total = F.col("errors") + F.col("warnings") + F.col("infos")
    return out.withColumn("total_findings", total).withColumn("clean", F.col("total_findings") == 0)


def page_category_counts(findings: DataFrame) -> DataFrame:
    return reachable(findings).groupBy("path", "category").agg(F.count(F.lit(1)).alias("count"))


def clean_rate(pages: DataFrame) -> DataFrame:
    out = pages.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("clean")).alias("clean"),
        F.count_if(~F.col("clean")).alias("with_findings"),
    )
    return out.withColumn("clean_rate", percent(F.col("clean"), F.col("total")))


def top_pages(pages: DataFrame, rows: int | None = None) -> DataFrame:
    """Pages with findings, the ones to start with first."""
    order = [F.col(c).desc() for c in ("errors", "warnings", "total_findings")]
    ordered = pages.where(~F.col("clean")).orderBy(*order, F.col("path").asc())
    return ordered if rows is None else ordered.limit(rows)


def count_by_severity(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rank = F.min(F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2))
    return findings.groupBy(*by).agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES],
        F.count(F.lit(1)).alias("total"),
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (rank + 1).cast("int")).alias("worst"),
    )


def suites(findings: DataFrame) -> DataFrame:
    """Test-suite view: one suite per category, orphan pages skipped, info passing."""
    orphan = F.coalesce(F.col("orphan_page"), F.lit(False))
    return findings.groupBy("category").agg(
        F.count(F.lit(1)).alias("tests"),
        F.count_if((F.col("severity") != "info") & ~orphan).alias("failures"),
        F.count_if(orphan).alias("skipped"),
    )


def run_statistics(
    coverage: DataFrame, content: DataFrame, images: DataFrame, prices: DataFrame, css: DataFrame, links: DataFrame,
    counts: DataFrame, pages: DataFrame,
) -> DataFrame:
    """One row for a run: every statistic as a struct. All inputs are one-row or few-row aggregates."""
    pack = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    by = counts.agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "dimension", "value"), "count")))
        ).alias("findings")
    )
    total = pack(css.where(F.col("viewport").isNull()).drop("viewport"), "css")
    out = pack(coverage, "coverage")
    for part in (pack(content, "content"), pack(images, "images"), pack(prices, "prices"), total,
                 pack(links, "links"), by, pack(clean_rate(pages), "pages")):
        out = out.crossJoin(part)
    return out


CATEGORY_NAMES = tuple(CATEGORIES)
