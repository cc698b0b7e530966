"""The findings table: identity, severity, suppression, ranking and the gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every category with its default severity and its fix-first rank.
CATEGORIES: dict[str, tuple[str, int]] = {
    "page.missing-on-target": ("error", 2),
    "page.extra-on-target": ("warning", 3),
    "page.status-mismatch": ("error", 2),
    "page.redirected": ("warning", 5),
    "page.alias": ("info", 5),
    "content.drift": ("error", 2),
    "content.value-drift": ("error", 0),
    "content.missing": ("error", 2),
    "content.added": ("warning", 2),
    "content.order-changed": ("info", 5),
    "meta.drift": ("warning", 5),
    "image.missing": ("error", 2),
    "image.added": ("warning", 3),
    "image.alt-drift": ("warning", 5),
    "image.size-drift": ("info", 5),
    "price.value-drift": ("error", 0),
    "price.currency-drift": ("error", 0),
    "price.format-drift": ("info", 5),
    "price.missing": ("error", 1),
    "price.added": ("warning", 1),
    "css.property-drift": ("warning", 8),
    "css.layout-drift": ("warning", 8),
    "css.visibility-drift": ("error", 8),
    "css.responsive-visibility-drift": ("error", 8),
    "css.horizontal-overflow": ("warning", 8),
    "link.broken": ("error", 3),
    "link.path-mismatch": ("error", 3),
    "link.redirect-chain": ("info", 5),
    "link.mixed-content": ("warning", 5),
}
SEVERITIES = ("error", "warning", "info")
REGIONS = ("header", "nav", "main", "footer", "aside", "other")
SLICES = {"css": "css.", "links": "link.", "coverage": "page."}

BOX = "struct<x:double,y:double,width:double,height:double>"
CHANGES = "array<struct<class:string,removed:array<string>,added:array<string>>>"
COLUMNS: dict[str, str] = {
    "id": "string",
    "category": "string",
    "severity": "string",
    "path": "string",
    "label": "string",
    "confidence": "double",
    "source_url": "string",
    "target_url": "string",
    "viewport": "string",
    "region": "string",
    "node_kind": "string",
    "subject": "string",
    "facet": "string",
    "expected_json": "string",
    "actual_json": "string",
    "magnitude": "double",
    "low_confidence": "boolean",
    "orphan_page": "boolean",
    "selector_hint": "string",
    "target_selector_hint": "string",
    "source_box": BOX,
    "target_box": BOX,
    "value_changes": CHANGES,
    "details_json": "string",
}


def json_text(value: Column) -> Column:
    """JSON text of a string column; NULL stays NULL."""
    boxed = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(boxed, F.lit(2), F.length(boxed) - 2))


def finding_id(
    category: Column,
    path: Column,
    viewport: Column | None = None,
    region: Column | None = None,
    node_kind: Column | None = None,
    subject: Column | None = None,
    facet: Column | None = None,
) -> Column:
    """SHA-1 of what and where, never of the compared values. Reports may show 12 digits; joins take all."""
    rest = [F.lit("") if c is None else F.coalesce(c, F.lit("")) for c in (viewport, region, node_kind, subject, facet)]
    return F.sha1(F.concat_ws("|", category, path, *rest))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def _literal_map(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def severity_for(category: Column, overrides: Mapping[str, str] | None = None) -> Column:
    table = {k: v[0] for k, v in CATEGORIES.items()} | dict(overrides or {})
    return F.element_at(_literal_map(table), category)


def category_priority(category: Column) -> Column:
    return F.coalesce(
        F.element_at(_literal_map({k: v[1] for k, v in CATEGORIES.items()}), category),
        F.when(category.startswith("css."), F.lit(8)).otherwise(F.lit(5)),
    )


def build(
    df: DataFrame,
    category: str | Column,
    overrides: Mapping[str, str] | None = None,
    **fields: Column,
) -> DataFrame:
    """Project rows onto the findings schema; `fields` gives the columns that apply."""
    cat = F.lit(category) if isinstance(category, str) else category
    known = {
        "category": cat,
        "severity": severity_for(cat, overrides),
        "confidence": F.lit(1.0),
        "orphan_page": F.lit(False),
    } | fields
    identity = {k: known.get(k) for k in ("viewport", "region", "node_kind", "subject", "facet")}
    known["id"] = finding_id(cat, known["path"], **identity)
    return df.select(
        *[known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in COLUMNS.items()]
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def apply_suppression(
    findings: DataFrame, ignore_ids: Sequence[str] | DataFrame = (), downgrade: Sequence[str] = ()
) -> DataFrame:
    """Drop accepted findings by id; demote noisy categories to info without hiding them."""
    if isinstance(ignore_ids, DataFrame):
        findings = findings.join(ignore_ids.select("id").distinct(), "id", "left_anti")
    elif ignore_ids:
        findings = findings.where(~F.col("id").isin(*ignore_ids))
    if downgrade:
        demoted = F.when(F.col("category").isin(*downgrade), F.lit("info")).otherwise(F.col("severity"))
        findings = findings.withColumn("severity", demoted)
    return findings


def ranking() -> list[Column]:
    """Sort order of a report: most serious, first to fix, biggest, then by name."""
    return [
        severity_rank(F.col("severity")).asc(),
        category_priority(F.col("category")).asc(),
        F.coalesce(F.col("magnitude"), F.lit(1.0)).desc(),
        F.col("path").asc(),
        F.col("category").asc(),
        F.col("id").asc(),
    ]


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*ranking())


def tag_orphans(findings: DataFrame, orphans: DataFrame) -> DataFrame:
    """Mark findings on pages nothing links to; statistics and gate leave them out."""
    marked = orphans.select("path").distinct().withColumn("_orphan", F.lit(True))
    joined = findings.join(marked, "path", "left")
    return joined.withColumn("orphan_page", F.coalesce(F.col("_orphan"), F.lit(False))).select(*findings.columns)


def reachable(findings: DataFrame) -> DataFrame:
    return findings.where(~F.coalesce(F.col("orphan_page"), F.lit(False)))


def at_or_above(findings: DataFrame, severity: str) -> DataFrame:
    """Findings at least as serious as `severity`."""
    return findings.where(severity_rank(F.col("severity")) <= SEVERITIES.index(severity))


def gate(findings: DataFrame, max_errors: int = 0, max_warnings: int | None = None) -> DataFrame:
    """One row: counts and the exit code of a run over its budget."""
    counts = reachable(findings).agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    over = F.col("errors") > max_errors
    if max_warnings is not None:
        over = over | (F.col("warnings") > max_warnings)
    return counts.withColumn("exit_code", F.when(over, 1).otherwise(0))
