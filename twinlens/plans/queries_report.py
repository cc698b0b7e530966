"""Queries over stored findings: identity, ranking, statistics, report views, run-over-run diff."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.functions.values import CLASS_ORDER
from twinlens.operators import dimensions, findings, report, rundiff, stats
from twinlens.plans import second_engine as sql
from twinlens.plans.derive import VIEWPORTS, Tables
from twinlens.plans.registry import query
from twinlens.sources.snapshots import previous_runs

_PRIORITY = "CASE category " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in findings.CATEGORIES.items()) + " END"
_DEFAULT = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in findings.CATEGORIES.items()) + " END"
_ORDER = f"{sql.SEV}, {_PRIORITY}, coalesce(magnitude, 1.0) DESC, path, category, id"
_OK = "NOT orphan_page"


def _counts(prefix: str = "") -> str:
    return ", ".join(f"count(*) FILTER ({prefix}severity = '{s}') AS {s}s" for s in findings.SEVERITIES)


@query("finding_identity", "I1", "SELECT event_id, id FROM fid", "fid")
def finding_identity(t: Tables):
    return t.findings().select("event_id", "id")


@query(
    "finding_build", "I2",
    "SELECT category, severity, count(*) AS n, sum(confidence) AS confidence FROM fid GROUP BY 1, 2", "fid",
)
def finding_build(t: Tables):
    rows = t.findings()
    built = findings.build(
        rows, F.col("category"), severity=F.col("severity"), path=F.col("path"), label=F.col("label"),
        confidence=F.col("confidence"), subject=F.col("subject"),
    )
    return built.groupBy("category", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence")
    )


@query(
    "finding_severity", "I3",
    f"SELECT event_id, CASE WHEN category = 'meta.drift' THEN 'error' ELSE {_DEFAULT} END AS severity FROM fid", "fid",
)
def finding_severity(t: Tables):
    return t.findings().select(
        "event_id", findings.severity_for(F.col("category"), {"meta.drift": "error"}).alias("severity")
    )


@query(
    "finding_suppression", "I4",
    "SELECT event_id, CASE WHEN category IN ('css.property-drift', 'page.alias') THEN 'info' ELSE severity END AS severity "
    "FROM fid WHERE id NOT IN (SELECT id FROM fid_base WHERE severity = 'info')", "fid fid_base",
)
def finding_suppression(t: Tables):
    accepted = t.findings("baseline").where(F.col("severity") == "info")
    kept = findings.apply_suppression(t.findings(), accepted, ("css.property-drift", "page.alias"))
    return kept.select("event_id", "severity")


@query(
    "finding_ranking", "I5 K14",
    f"SELECT category, severity, path, id FROM fid ORDER BY {_ORDER}", "fid",
)
def finding_ranking(t: Tables):
    return report.worst_findings(t.findings()).select("category", "severity", "path", "id")


@query(
    "finding_orphans", "I6",
    "SELECT event_id, path IN (SELECT DISTINCT '/u/' || user_id FROM events WHERE event_type = 'error' AND value < 2) AS orphan "
    "FROM fid", "fid",
)
def finding_orphans(t: Tables):
    lone = t.events.where((F.col("event_type") == "error") & (F.col("value") < 2)).select(
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path")
    )
    tagged = findings.tag_orphans(t.findings(), lone)
    return tagged.select("event_id", F.col("orphan_page").alias("orphan"))


@query("finding_at_or_above", "I7", "SELECT event_id FROM fid WHERE severity IN ('error', 'warning')", "fid")
def finding_at_or_above(t: Tables):
    return findings.at_or_above(t.findings(), "warning").select("event_id")


@query(
    "finding_gate", "I8",
    f"SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, "
    f"CASE WHEN count(*) FILTER (severity = 'error') > 1000000000 OR count(*) FILTER (severity = 'warning') > 10 THEN 1 ELSE 0 END "
    f"AS exit_code FROM fid WHERE {_OK}", "fid",
)
def finding_gate(t: Tables):
    return findings.gate(t.findings(), 1_000_000_000, 10)


_DIMS = " UNION ALL ".join(
    [f"SELECT 'severity' AS dimension, '{s}' AS value" for s in findings.SEVERITIES]
    + [f"SELECT 'region', '{r}'" for r in (*findings.REGIONS, "none")]
)


@query(
    "stats_finding_counts", "J7",
    f"WITH d AS ({_DIMS}), c AS (SELECT 'severity' AS dimension, severity AS value FROM fid WHERE {_OK} UNION ALL SELECT "
    f"'category', category FROM fid WHERE {_OK} UNION ALL SELECT 'region', coalesce(region, 'none') FROM fid WHERE {_OK}), "
    "g AS (SELECT dimension, value, count(*) AS n FROM c GROUP BY 1, 2) SELECT coalesce(d.dimension, g.dimension) AS dimension, "
    "coalesce(d.value, g.value) AS value, coalesce(n, 0)::BIGINT AS count FROM d FULL JOIN g ON d.dimension = g.dimension AND d.value = g.value",
    "fid",
)
def stats_finding_counts(t: Tables):
    return stats.finding_counts(t.findings())


def _pairs(t: Tables):
    """Every user's page as a compared pair."""
    path = F.concat(F.lit("/u/"), F.col("user_id").cast("string"))
    return t.events.groupBy(path.alias("path")).agg(
        F.lit("https://legacy.example").alias("source_url"), F.lit("https://new.example").alias("target_url"),
        F.bool_or(F.col("event_id") % 97 == 5).alias("slow_capture"),
    )


_PAIRS = "pp AS (SELECT '/u/' || user_id AS path, bool_or(event_id % 97 = 5) AS slow_capture FROM events GROUP BY 1)"
_ROLL = (
    f"WITH {_PAIRS}, roll AS (SELECT pp.path, pp.slow_capture, coalesce(f.errors, 0) AS errors, coalesce(f.warnings, 0) AS warnings, "
    "coalesce(f.infos, 0) AS infos, coalesce(f.errors + f.warnings + f.infos, 0) AS total_findings FROM pp LEFT JOIN (SELECT path, "
    f"{_counts()} FROM fid WHERE {_OK} GROUP BY 1) f ON f.path = pp.path) "
)


@query(
    "stats_page_rollup", "J8",
    _ROLL + "SELECT *, total_findings = 0 AS clean FROM roll", "fid",
)
def stats_page_rollup(t: Tables):
    return stats.page_rollup(_pairs(t), t.findings()).drop("source_url", "target_url")


@query(
    "stats_page_categories", "J8",
    f"SELECT path, category, count(*) AS count FROM fid WHERE {_OK} GROUP BY 1, 2", "fid",
)
def stats_page_categories(t: Tables):
    return stats.page_category_counts(t.findings())


@query(
    "stats_clean_rate", "J9 J1",
    _ROLL + f"SELECT count(*) AS total, count(*) FILTER (total_findings = 0) AS clean, count(*) FILTER (total_findings > 0) AS "
    f"with_findings, {sql.pct('count(*) FILTER (total_findings = 0)', 'count(*)')} AS clean_rate FROM roll", "fid",
)
def stats_clean_rate(t: Tables):
    return stats.clean_rate(stats.page_rollup(_pairs(t), t.findings()))


@query(
    "stats_top_pages", "K13",
    _ROLL + "SELECT path, errors, warnings, total_findings FROM roll WHERE total_findings > 0 ORDER BY errors DESC, warnings DESC, "
    "total_findings DESC, path", "fid",
)
def stats_top_pages(t: Tables):
    pages = stats.page_rollup(_pairs(t), t.findings())
    return stats.top_pages(pages).select("path", "errors", "warnings", "total_findings")


@query(
    "stats_severity_counts", "J11",
    f"SELECT category, {_counts()}, count(*) AS total, CASE min({sql.SEV}) WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' "
    "END AS worst FROM fid GROUP BY 1", "fid",
)
def stats_severity_counts(t: Tables):
    return stats.count_by_severity(t.findings(), ["category"])


@query(
    "stats_suites", "J12",
    "SELECT category, count(*) AS tests, count(*) FILTER (severity <> 'info' AND NOT orphan_page) AS failures, "
    "count(*) FILTER (orphan_page) AS skipped FROM fid GROUP BY 1", "fid",
)
def stats_suites(t: Tables):
    return stats.suites(t.findings())


@query(
    "report_pages", "K1",
    f"WITH {_PAIRS}, c AS (SELECT path, {_counts()}, count(*) FILTER (viewport IS NULL) AS shared, count(viewport) AS by_viewport, "
    "count(*) AS total FROM fid GROUP BY 1) SELECT coalesce(pp.path, c.path) AS path, coalesce(errors, 0) AS errors, "
    "coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos, coalesce(shared, 0) AS shared, coalesce(by_viewport, 0) AS "
    "by_viewport, coalesce(total, 0) AS total, pp.path IS NOT NULL AS compared FROM pp FULL JOIN c ON pp.path = c.path", "fid",
)
def report_pages(t: Tables):
    return report.page_reports(t.findings(), _pairs(t))


@query(
    "report_devices", "K2",
    f"SELECT viewport, {_counts()}, count(*) AS total, count(DISTINCT path) AS pages_affected FROM fid WHERE viewport IS NOT NULL "
    "GROUP BY 1", "fid",
)
def report_devices(t: Tables):
    return report.device_reports(t.findings())


@query(
    "report_device_pages", "K2",
    "SELECT viewport, path, count(*) AS count FROM fid WHERE viewport IS NOT NULL GROUP BY 1, 2", "fid",
)
def report_device_pages(t: Tables):
    return report.device_pages(t.findings())


_MATRIX = (
    "SELECT path, count(*) FILTER (viewport IS NULL) AS shared, "
    + ", ".join(f"count(*) FILTER (viewport = '{v}') AS {v.replace('-', '_')}" for v in VIEWPORTS)
    + f", count(*) AS total, CASE min({sql.SEV}) WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS worst FROM fid GROUP BY 1"
)


@query("report_matrix", "K3", _MATRIX, "fid")
def report_matrix(t: Tables):
    return report.matrix(t.findings(), list(VIEWPORTS)).drop("errors", "warnings", "infos")


@query(
    "report_matrix_summary", "K3",
    _MATRIX + f" ORDER BY count(*) FILTER (severity = 'error') DESC, count(*) FILTER (severity = 'warning') DESC, count(*) DESC, path", "fid",
)
def report_matrix_summary(t: Tables):
    return report.summary_matrix(t.findings(), list(VIEWPORTS))


@query(
    "report_slices", "K4",
    "SELECT CASE WHEN category LIKE 'css.%' THEN 'css' WHEN category LIKE 'link.%' THEN 'links' WHEN category LIKE 'page.%' THEN "
    "'coverage' ELSE 'content' END AS slice, count(*) AS n, count(*) FILTER (orphan_page) AS orphans FROM fid GROUP BY 1", "fid",
)
def report_slices(t: Tables):
    return t.findings().groupBy(report.category_slice().alias("slice")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("orphan_page").alias("orphans")
    )


@query("report_categories", "K5", "SELECT category, count(*) AS count FROM fid GROUP BY 1", "fid")
def report_categories(t: Tables):
    return report.counts_by_category(t.findings())


@query(
    "report_subjects", "K6",
    f"SELECT path, CASE WHEN starts_with(g, '~') THEN '' ELSE g END AS subject, CASE min({sql.SEV}) WHEN 0 THEN 'error' WHEN 1 THEN "
    "'warning' ELSE 'info' END AS worst, count(*) AS size FROM (SELECT *, coalesce(subject, '~' || id) AS g FROM fid WHERE viewport IS NULL) x "
    "GROUP BY path, g", "fid",
)
def report_subjects(t: Tables):
    return report.group_by_subject(t.findings())


_CLASS_ORDER = "CASE c " + " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(CLASS_ORDER)) + " END"


@query(
    "report_changed_values", "K7",
    f"SELECT event_id, c AS class, ({_CLASS_ORDER})::BIGINT AS class_order FROM (SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN "
    "['amount', 'modal'] WHEN 1 THEN ['number'] ELSE ['date', 'duration', 'negation'] END) AS c FROM fid WHERE category = 'content.value-drift') x",
    "fid",
)
def report_changed_values(t: Tables):
    entry = lambda c: F.struct(
        F.lit(c).alias("class"), F.array(F.lit("1")).alias("removed"), F.array(F.lit("2")).alias("added")
    )
    n = F.col("event_id") % 3
    changes = F.when(n == 0, F.array(entry("amount"), entry("modal"))).when(n == 1, F.array(entry("number"))).otherwise(
        F.array(entry("date"), entry("duration"), entry("negation"))
    )
    rows = t.findings().withColumn("value_changes", changes).withColumn("id", F.col("event_id"))
    return report.changed_values(rows).select(F.col("id").alias("event_id"), "class", "class_order")


@query(
    "report_region_shares", "K8",
    f"WITH d AS (SELECT unnest(['header', 'nav', 'main', 'footer', 'aside', 'other', 'page-level']) AS region), c AS (SELECT "
    f"coalesce(region, 'page-level') AS region, count(*) AS n FROM fid WHERE {_OK} GROUP BY 1) SELECT d.region, coalesce(n, 0)::BIGINT AS "
    "count, CASE WHEN coalesce(n, 0) = 0 THEN 0.0::DOUBLE ELSE floor(n::DOUBLE / (SELECT sum(n) FROM c)::DOUBLE * 1000 + 0.5) / 10 END AS share "
    "FROM d LEFT JOIN c ON c.region = d.region", "fid",
)
def report_region_shares(t: Tables):
    return report.region_shares(t.findings())


_SB, _TB = "(sw > 0 AND sh > 0)", "(tw > 0 AND th > 0)"
_SHIFT = (
    f"CASE WHEN {_SB} AND {_TB} THEN greatest(abs(sx - tx), abs(sy - ty), abs(sw - tw), abs(sh - th)) ELSE 'infinity'::DOUBLE END"
)
_VISIBLE = ", ".join(f"'{c}'" for c in report.VISIBLE)
_MARK = (
    f"category IN ({_VISIBLE}) AND (category <> 'css.property-drift' OR facet IN ('color', 'box-shadow')) AND ({_SB} OR {_TB}) AND "
    f"greatest(CASE WHEN {_SB} THEN sw * sh ELSE 0 END, CASE WHEN {_TB} THEN tw * th ELSE 0 END) >= 80 AND "
    f"(category <> 'css.layout-drift' OR {_SHIFT} >= 8)"
)
_COALESCED = (
    "f AS (SELECT * REPLACE (coalesce(sw, 0) AS sw, coalesce(sh, 0) AS sh, coalesce(tw, 0) AS tw, coalesce(th, 0) AS th) FROM fid)"
)


@query("report_visual_filter", "K9", f"WITH {_COALESCED} SELECT event_id FROM f WHERE {_MARK}", "fid")
def report_visual_filter(t: Tables):
    return t.findings().where(report.is_visual_mark()).select("event_id")


@query(
    "report_visual_marks", "K10",
    f"WITH {_COALESCED}, v AS (SELECT *, coalesce(viewport, 'desktop') AS map_viewport FROM f WHERE {_MARK}), g AS (SELECT path, "
    "map_viewport, count(*) AS map_size FROM v GROUP BY 1, 2 ORDER BY map_size DESC, path, map_viewport), r AS (SELECT v.path, "
    f"v.map_viewport, map_size, severity, id, row_number() OVER (PARTITION BY v.path, v.map_viewport ORDER BY {sql.SEV}, id) AS n "
    "FROM v JOIN g ON g.path = v.path AND g.map_viewport = v.map_viewport) SELECT path, map_viewport, map_size, severity, id, n FROM r", "fid",
)
def report_visual_marks(t: Tables):
    marks = report.visual_marks(t.findings())
    return marks.select("path", "map_viewport", "map_size", "severity", "id", F.col("n").cast("bigint").alias("n"))


@query(
    "report_box_shift", "K11",
    f"WITH {_COALESCED} SELECT event_id, least({_SHIFT}, 1e9) AS shift FROM f", "fid",
)
def report_box_shift(t: Tables):
    s, b = report.usable_box(F.col("source_box")), report.usable_box(F.col("target_box"))
    return t.findings().select("event_id", F.least(report.box_shift(s, b), F.lit(1e9)).alias("shift"))


@query(
    "report_evidence", "K12",
    f"WITH {_COALESCED}, s AS (SELECT *, {_SB} OR {_TB} AS placed FROM f WHERE severity IN ('error', 'warning')), c AS (SELECT id, "
    f"severity, 'crop' AS evidence FROM s WHERE placed ORDER BY {sql.SEV}, id) SELECT * FROM c UNION ALL SELECT id, severity, "
    "'page' FROM s WHERE NOT placed AND category IN ('page.missing-on-target', 'page.extra-on-target')", "fid",
)
def report_evidence(t: Tables):
    return report.evidence(t.findings(), "warning").select("id", "severity", "evidence")


@query(
    "report_crops", "K12",
    f"WITH {_COALESCED}, r AS (SELECT event_id, greatest(0, floor((sx - 12) * 2)) AS l, greatest(0, floor((sy - 12) * 2)) AS t, "
    "least(600, ceil((sx + sw + 12) * 2)) AS r, least(900, ceil((sy + sh + 12) * 2)) AS b FROM f WHERE sx IS NOT NULL) SELECT event_id, "
    "CASE WHEN r - l >= 1 AND b - t >= 1 THEN l::BIGINT || ',' || t::BIGINT || ',' || (r - l)::BIGINT || ',' || (b - t)::BIGINT END AS crop FROM r",
    "fid",
)
def report_crops(t: Tables):
    box = F.col("source_box")
    crop = report.crop_rectangle(box, F.lit(2), F.lit(600), F.lit(900))
    text = F.concat_ws(",", *[crop[c].cast("bigint").cast("string") for c in ("left", "top", "width", "height")])
    return t.findings().where(box.isNotNull()).select("event_id", F.when(crop.isNotNull(), text).alias("crop"))


@query(
    "report_explanations", "K15",
    "SELECT event_id, CASE WHEN node_kind IS NOT NULL THEN node_kind || ' · ' ELSE '' END || '“' || substr(expected_json, 2, "
    "length(expected_json) - 2) || '”' AS element, CASE WHEN region IS NOT NULL OR node_kind IS NOT NULL THEN "
    "(floor(confidence * 100 + 0.5))::BIGINT || '% text similarity' || coalesce(' · region ' || region, '') || coalesce(' · ' || node_kind || "
    "' family', '') || CASE WHEN low_confidence THEN ' · weak pairing' ELSE '' END END AS matched_by FROM fid", "fid",
)
def report_explanations(t: Tables):
    rows = t.findings().withColumn("id", F.col("event_id"))
    return report.explanations(rows).select(F.col("id").alias("event_id"), "element", "matched_by")


@query(
    "report_deep_links", "K16",
    "SELECT event_id, CASE WHEN source_url LIKE '%#%' OR length(v) < 8 THEN source_url ELSE source_url || '#:~:text=' || "
    "replace(replace(replace(url_encode(v), '%21', '!'), '%28', '('), '%29', ')') END AS link FROM (SELECT *, substr(expected_json, 2, "
    "length(expected_json) - 2) AS v FROM fid) x", "fid",
)
def report_deep_links(t: Tables):
    text = F.expr("substring(expected_json, 2, length(expected_json) - 2)")
    return t.findings().select("event_id", report.deep_link(F.col("source_url"), text).alias("link"))


@query(
    "report_orphans", "K17",
    "WITH o AS (SELECT DISTINCT '/u/' || user_id AS path FROM events WHERE user_id % 20 = 3 OR value < 1) SELECT o.path, count(f.id) AS "
    "findings, count(f.id) FILTER (f.severity = 'error') AS errors FROM o LEFT JOIN fid f ON f.path = o.path GROUP BY 1", "fid",
)
def report_orphans(t: Tables):
    lone = t.events.where((F.col("user_id") % 20 == 3) | (F.col("value") < 1)).select(
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path")
    )
    return report.orphan_table(lone, t.findings())


# --- run over run -----------------------------------------------------------------------

# Findings of one id, severity and values pair first, the n-th with the n-th; of what is left of an id the n-th with the n-th.
_MORE = ", ".join(f"{c} NULLS FIRST" for c in ("path", "label", "viewport", "category", "magnitude"))
_KINDS = "{n}k AS (SELECT *, row_number() OVER (PARTITION BY id, severity, expected_json, actual_json ORDER BY " + _MORE + ") AS nth FROM {t})"
_LEFT = (
    "{n}r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY " + sql.SEV + ", expected_json NULLS FIRST, actual_json NULLS FIRST, " + _MORE
    + ") AS m FROM {n}k x WHERE NOT EXISTS (FROM {o}k y WHERE x.id = y.id AND x.severity = y.severity AND x.nth = y.nth AND "
    "x.expected_json IS NOT DISTINCT FROM y.expected_json AND x.actual_json IS NOT DISTINCT FROM y.actual_json))"
)
_WORSE = "CASE {} WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
_DIFF = (
    "WITH " + _KINDS.format(n="b", t="fid_base") + ", " + _KINDS.format(n="c", t="fid") + ", " + _LEFT.format(n="b", o="c") + ", " + _LEFT.format(n="c", o="b")
    + ", diff AS (SELECT c.id, 'unchanged' AS bucket, c.severity, c.category, c.path, c.magnitude, false AS escalated FROM ck c JOIN bk b ON b.id = c.id AND "
    "b.severity = c.severity AND b.nth = c.nth AND b.expected_json IS NOT DISTINCT FROM c.expected_json AND b.actual_json IS NOT DISTINCT FROM c.actual_json "
    "UNION ALL SELECT coalesce(b.id, c.id), CASE WHEN b.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'fixed' ELSE 'changed' END, "
    "coalesce(c.severity, b.severity), coalesce(c.category, b.category), coalesce(c.path, b.path), CASE WHEN c.id IS NULL THEN b.magnitude ELSE c.magnitude END, "
    f"coalesce({_WORSE.format('c.severity')} < {_WORSE.format('b.severity')} AND b.id IS NOT NULL AND c.id IS NOT NULL, false) FROM br b FULL JOIN cr c ON b.id = c.id AND b.m = c.m) "
)


def _diff(t: Tables):
    return rundiff.diff_runs(t.findings("baseline"), t.findings("current"))


@query("diff_runs", "L1 L2", _DIFF + "SELECT id, bucket, escalated FROM diff", "fid fid_base")
def diff_runs(t: Tables):
    return _diff(t).select("id", "bucket", "escalated")


_RUN = "SELECT *, array_to_string(list_sort(string_split(views, ',')), ',') AS v FROM runs"


@query(
    "diff_warnings", "L3",
    "WITH p AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS base FROM runs), r AS (" + _RUN + ") SELECT p.run_id, "
    "(a.source_base_url <> b.source_base_url)::INT + (a.target_base_url <> b.target_base_url)::INT + (a.v <> b.v)::INT AS warnings "
    "FROM p JOIN r a ON a.run_id = p.run_id JOIN r b ON b.run_id = p.base", "runs",
)
def diff_warnings(t: Tables):
    runs = t.derived("runs").withColumn("viewports", F.split("views", ","))
    return rundiff.warnings_by_run(runs, previous_runs(runs))


@query(
    "diff_counts", "L4",
    _DIFF + "SELECT bucket, severity, count(*) AS count FROM diff GROUP BY 1, 2", "fid fid_base",
)
def diff_counts(t: Tables):
    return rundiff.bucket_counts(_diff(t))


@query(
    "diff_run_totals", "L4",
    f"SELECT run_id, {_counts()}, count(*) AS total FROM (SELECT run_id, severity FROM fid UNION ALL SELECT run_id, severity FROM fid_base) x "
    "GROUP BY 1", "fid fid_base",
)
def diff_run_totals(t: Tables):
    return rundiff.run_totals(t.findings("baseline").unionByName(t.findings("current")))


@query(
    "diff_top_rows", "L5",
    _DIFF.rstrip() + f", r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {_ORDER}) AS n, count(*) OVER (PARTITION BY bucket) AS size "
    "FROM diff) SELECT bucket, id, n, greatest(size - 20, 0)::BIGINT AS more FROM r WHERE n <= 20", "fid fid_base",
)
def diff_top_rows(t: Tables):
    return rundiff.top_rows(_diff(t), 20).select("bucket", "id", F.col("n").cast("bigint").alias("n"), "more")


@query(
    "diff_gate", "L6",
    _DIFF + "SELECT count(*) AS new_findings, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_code FROM diff WHERE bucket = 'added' AND "
    "severity IN ('error', 'warning')", "fid fid_base",
)
def diff_gate(t: Tables):
    return rundiff.regression_gate(_diff(t), "warning")


@query(
    "diff_self", "L1",
    "SELECT 'unchanged' AS bucket, count(*) AS count FROM fid", "fid",
)
def diff_self(t: Tables):
    same = rundiff.diff_runs(t.findings(), t.findings())
    return same.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"))


@query(
    "noise_floor", "L7",
    f"SELECT id FROM fid ORDER BY {_ORDER}", "fid",
)
def noise_floor(t: Tables):
    """Ids to accept, from the findings of a self-comparison standing in for one."""
    return rundiff.noise_floor(t.findings())


# --- settings as tables -----------------------------------------------------------------

_PROFILES = "(VALUES " + ", ".join(f"('{v}', {w}, {h})" for v, _, w, h, *_ in dimensions.DEVICES) + ", ('wall', 3840, 2160)) p(viewport, width, height)"

_OWN_PROFILES = _PROFILES.replace("('tablet', 768, 1024)", "('tablet', 800, 1280)")


@query(
    "config_viewports", "L3",
    "WITH r AS (SELECT run_id, unnest(CASE WHEN views = 'desktop' THEN ['desktop', 'wall'] ELSE string_split(views, ',') END) AS viewport FROM runs) "
    f"SELECT run_id, viewport, width, height FROM r JOIN {_OWN_PROFILES} USING (viewport)", "runs",
)
def config_viewports(t: Tables):
    """Screens of every stored run; the project adds a wall and has a larger tablet."""
    named = F.split(F.when(F.col("views") == "desktop", F.lit("desktop,wall")).otherwise(F.col("views")), ",")
    own = t.spark.createDataFrame([("wall", "Wall", 3840, 2160, 1.0, False, False), ("tablet", "Tablet", 800, 1280, 2.0, True, True)], dimensions.PROFILE_DDL)
    rows = t.derived("runs").select("run_id", F.explode(named).alias("viewport"))
    return dimensions.resolve_viewports(rows, dimensions.device_profiles(t.spark, own)).select("run_id", "viewport", "width", "height")


@query(
    "config_severities", "I3",
    "SELECT event_id, CASE category WHEN 'meta.drift' THEN 'error' WHEN 'page.alias' THEN 'warning' ELSE severity END AS severity FROM fid", "fid",
)
def config_severities(t: Tables):
    own = t.spark.createDataFrame([("meta.drift", "info"), ("meta.drift", "error"), ("page.alias", "warning")], "category string, severity string")
    return dimensions.with_severities(t.findings(), own).select("event_id", "severity")
