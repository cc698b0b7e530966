"""Queries over two captured sides: coverage, links, alignment, content, assets, styles."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.operators import align, assets, content, coverage, links, stats, styles
from twinlens.plans import second_engine as sql
from twinlens.plans.derive import STYLE_COLUMNS, Tables
from twinlens.plans.queries_columns import COMPARED_SQL, changes_sql
from twinlens.plans.registry import query
from twinlens.session import cut_lineage

_ID = sql.finding_id
_EMPTY = "''"


def _orphans(t: Tables):
    return coverage.orphan_pages(t.index("source"), t.links, ["https://legacy.example/"])


# --- coverage ---------------------------------------------------------------------------

_COVER = " UNION ALL ".join(
    [
        f"SELECT 'page.missing-on-target' AS category, 'error' AS severity, path, path AS subject, "
        f"{_ID(chr(39) + 'page.missing-on-target' + chr(39), 'path', _EMPTY, _EMPTY, _EMPTY, 'path')} AS id FROM m WHERE target_status IS NULL",
        f"SELECT 'page.status-mismatch', 'error', path, 'target-status', "
        f"{_ID(chr(39) + 'page.status-mismatch' + chr(39), 'path', _EMPTY, _EMPTY, _EMPTY, chr(39) + 'target-status' + chr(39))} "
        "FROM m WHERE target_status NOT BETWEEN 200 AND 299",
        f"SELECT 'page.redirected', 'warning', path, 'redirect', "
        f"{_ID(chr(39) + 'page.redirected' + chr(39), 'path', _EMPTY, _EMPTY, _EMPTY, chr(39) + 'redirect' + chr(39))} "
        "FROM m WHERE target_status BETWEEN 200 AND 299 AND target_hops > 0 AND hops = 0",
        f"SELECT 'page.status-mismatch', 'warning', path, 'source-status', "
        f"{_ID(chr(39) + 'page.status-mismatch' + chr(39), 'path', _EMPTY, _EMPTY, _EMPTY, chr(39) + 'source-status' + chr(39))} "
        "FROM page_rows WHERE side = 'source' AND status NOT BETWEEN 200 AND 299",
        f"SELECT 'page.extra-on-target', 'warning', path, 'extra', "
        f"{_ID(chr(39) + 'page.extra-on-target' + chr(39), 'path', _EMPTY, _EMPTY, _EMPTY, chr(39) + 'extra' + chr(39))} "
        "FROM page_rows WHERE side = 'target' AND status BETWEEN 200 AND 299 AND path NOT IN (SELECT path FROM m)",
        f"SELECT 'page.alias', 'info', m.path, a.alias, "
        f"{_ID(chr(39) + 'page.alias' + chr(39), 'm.path', _EMPTY, _EMPTY, _EMPTY, 'a.alias')} FROM m JOIN aliases a ON a.path = m.path",
    ]
)


@query("coverage_findings", "E2 E3 E4 E5 E6 E7 I1 I2 I3", _COVER, "m aliases")
def coverage_findings(t: Tables):
    found = coverage.coverage_findings(t.index("source"), t.index("target"))
    return found.select("category", "severity", "path", "subject", "id")


@query(
    "coverage_index", "E1 D14",
    "SELECT side, path, url, status, hops::INT AS redirects, depth, slow_capture FROM page_rows", "page_rows",
)
def coverage_index(t: Tables):
    errors = F.when(F.col("slow_capture"), F.array(F.lit("readiness timed out"))).otherwise(F.array(F.lit("other readiness")))
    rows = t.page_rows.withColumns({"final_url": F.col("url"), "errors": errors})
    return coverage.page_index(rows).select(
        "side", "path", "url", "status", F.size("redirect_chain").alias("redirects"), "depth", "slow_capture"
    )


@query(
    "coverage_pairs", "E2",
    "SELECT path, target_path, url AS source_url, target_url, slow_capture OR target_slow AS slow_capture FROM m "
    "WHERE target_status BETWEEN 200 AND 299", "m",
)
def coverage_pairs(t: Tables):
    return coverage.page_pairs(t.index("source"), t.index("target"))


@query(
    "coverage_stats", "E8 J1",
    "WITH c AS (SELECT count(*) FILTER (target_status BETWEEN 200 AND 299) AS matched_pages, count(*) FILTER (target_status IS NULL) AS "
    "missing_on_target, count(*) FILTER (target_status NOT BETWEEN 200 AND 299) AS status_mismatches, count(*) FILTER (o.path IS NULL AND "
    "target_status BETWEEN 200 AND 299) AS coverage_matched, count(*) FILTER (o.path IS NULL) AS coverage_total FROM m LEFT JOIN orphans o "
    "ON o.path = m.path) SELECT c.*, (SELECT count(*) FROM page_rows WHERE side = 'source') AS source_pages, (SELECT count(*) FROM "
    "page_rows WHERE side = 'target') AS target_pages, (SELECT count(*) FROM aliases a JOIN m ON m.path = a.path) AS alias_pages, (SELECT "
    "count(*) FROM page_rows WHERE side = 'target' AND status BETWEEN 200 AND 299 AND path NOT IN (SELECT path FROM m)) AS extra_on_target, "
    f"{sql.pct('coverage_matched', 'coverage_total')} AS page_coverage FROM c", "m aliases orphans",
)
def coverage_stats(t: Tables):
    return coverage.coverage_stats(t.index("source"), t.index("target"), _orphans(t))


@query("coverage_orphans", "E9", "SELECT path FROM orphans", "orphans")
def coverage_orphans(t: Tables):
    return _orphans(t)


@query(
    "coverage_linked_paths", "E9",
    "SELECT count(DISTINCT link_path) AS linked FROM links WHERE side = 'source' AND kind = 'internal'", "links",
)
def coverage_linked_paths(t: Tables):
    return coverage.linked_paths(t.links).agg(F.count(F.lit(1)).alias("linked"))


# --- links ------------------------------------------------------------------------------

_LINKS = "SELECT side, path, page_url, pos, href, resolved, kind, link_path, visible, region FROM links"


@query("link_occurrences", "H1 B22", _LINKS, "links")
def link_occurrences(t: Tables):
    return t.links.select(
        "side", "path", "page_url", F.col("pos").cast("bigint").alias("pos"), "href", "resolved", "kind", "link_path",
        "visible", "region",
    )


_ROUTES = (
    "routes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link_path ORDER BY slug, pos) AS k FROM links WHERE side = "
    "'source' AND visible AND link_path IS NOT NULL) x WHERE k = 1)"
)
_LOST = (
    "SELECT path, link_path AS subject, " + _ID("'link.path-mismatch'", "path", "''", "''", "''", "link_path")
    + " AS id FROM routes WHERE link_path NOT IN (SELECT path FROM page_rows WHERE side = 'target') AND link_path NOT IN (SELECT link_path "
    "FROM links WHERE side = 'target' AND link_path IS NOT NULL)"
)


@query("link_path_parity", "H2", f"WITH {_ROUTES} {_LOST}", "links page_rows")
def link_path_parity(t: Tables):
    return links.path_mismatches(t.links, t.index("target")).select("path", "subject", "id")


@query(
    "link_mixed_content", "H3",
    "SELECT path, resolved AS subject, side FROM links WHERE resolved LIKE 'http://%' AND page_url LIKE 'https://%'", "links",
)
def link_mixed_content(t: Tables):
    found = links.mixed_content(t.links)
    return found.select("path", "subject", F.get_json_object("details_json", "$.side").alias("side"))


_CHECK = (
    "tocheck AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resolved ORDER BY cls, side, slug, pos) AS k FROM (SELECT *, "
    "CASE kind WHEN 'internal' THEN 0 ELSE 1 END AS cls FROM links l WHERE resolved IS NOT NULL AND (kind = 'external' OR (link_path IS NOT "
    "NULL AND NOT EXISTS (SELECT 1 FROM page_rows p WHERE p.side = l.side AND p.path = l.link_path)))) x) y WHERE k = 1)"
)


def _to_check(t: Tables):
    return links.links_to_check(t.links, t.index("source").withColumn("side", F.lit("source")).unionByName(
        t.index("target").withColumn("side", F.lit("target"))
    ))


@query("link_to_check", "H4", f"WITH {_CHECK} SELECT resolved, side, path, kind FROM tocheck", "links page_rows")
def link_to_check(t: Tables):
    return _to_check(t).select("resolved", "side", "path", "kind")


_CHECKED = (
    _CHECK + ", checked AS (SELECT *, CASE length(resolved) % 7 WHEN 0 THEN 'broken' WHEN 1 THEN 'error' WHEN 3 THEN 'redirected' ELSE 'ok' "
    "END AS link_status FROM tocheck)"
)


@query("link_status", "H5", f"WITH {_CHECKED} SELECT resolved, link_status FROM checked", "links page_rows")
def link_status(t: Tables):
    rows = _to_check(t)
    return links.checked_links(rows, t.probes(rows)).select("resolved", "link_status")


@query(
    "link_broken", "H6",
    f"WITH {_CHECKED} SELECT CASE link_status WHEN 'redirected' THEN 'link.redirect-chain' ELSE 'link.broken' END AS category, path, "
    "resolved AS subject, CASE link_status WHEN 'error' THEN 'No answer from link ' || resolved || ' (timeout)' WHEN 'broken' THEN 'Link answered 404: ' "
    "|| resolved ELSE 'Link hops 1 time(s): ' || resolved END AS label FROM checked WHERE link_status <> 'ok'", "links page_rows",
)
def link_broken(t: Tables):
    rows = _to_check(t)
    found = links.checked_findings(links.checked_links(rows, t.probes(rows)))
    return found.select("category", "path", "subject", "label")


_CAUGHT = (
    "SELECT l.side, l.path, l.link_path AS subject, 'Link answered ' || p.status || ': ' || l.link_path AS label FROM links l JOIN page_rows p "
    "ON p.side = l.side AND p.path = l.link_path WHERE p.status >= 400"
)


def _both_index(t: Tables):
    return t.page_rows.drop("page_id")


@query("link_broken_from_capture", "H7", _CAUGHT, "links page_rows")
def link_broken_from_capture(t: Tables):
    found = links.broken_from_capture(t.links, _both_index(t))
    return found.select(F.get_json_object("details_json", "$.side").alias("side"), "path", "subject", "label")


@query(
    "link_stats", "H8",
    f"WITH {_ROUTES}, {_CHECKED}, lost AS ({_LOST}), caught AS ({_CAUGHT}), n AS (SELECT (SELECT count(*) FROM links) AS total_links, "
    "(SELECT count(*) FROM links WHERE kind = 'internal') AS internal_links, (SELECT count(*) FROM links WHERE kind = 'external') AS "
    "external_links, (SELECT count(*) FROM checked) AS checked_links, (SELECT count(*) FROM checked WHERE link_status IN ('broken', 'error')) + "
    "(SELECT count(*) FROM caught) AS broken_links, (SELECT count(*) FROM checked WHERE link_status = 'redirected') AS redirected_links, "
    "(SELECT count(*) FROM links WHERE resolved LIKE 'http://%' AND page_url LIKE 'https://%') AS mixed_content_links, (SELECT count(*) FROM lost) "
    f"AS path_mismatches, (SELECT count(*) FROM routes) AS r) SELECT * EXCLUDE (r), {sql.pct('(r - path_mismatches)', 'r')} AS link_parity FROM n",
    "links page_rows",
)
def link_stats(t: Tables):
    rows = _to_check(t)
    probes = t.probes(rows)
    index = _both_index(t)
    source, target = index.where(F.col("side") == "source"), index.where(F.col("side") == "target")
    found = links.link_findings(t.links, source, target, probes)
    return links.link_stats(t.links, links.checked_links(rows, probes), found)


@query(
    "link_destinations", "H9",
    "SELECT DISTINCT side, path, resolved FROM links WHERE resolved IS NOT NULL", "links",
)
def link_destinations(t: Tables):
    return links.destinations(t.links)


# --- alignment and content --------------------------------------------------------------

_KEYED = (
    "k AS (SELECT *, CASE WHEN kind IN ('paragraph','listItem','tableCell') THEN 'text' ELSE kind END || ':' || key AS akey FROM nodes), "
    "anchors AS (SELECT path, region, akey, min(pos) FILTER (side = 'source') AS spos, min(pos) FILTER (side = 'target') AS tpos FROM k "
    "GROUP BY 1, 2, 3 HAVING count(*) FILTER (side = 'source') = 1 AND count(*) FILTER (side = 'target') = 1)"
)


def _items(t: Tables):
    nodes = t.nodes.withColumn("_key", F.concat_ws(":", content.kind_family(F.col("kind")), "key"))
    side = lambda s: nodes.where(F.col("side") == s)
    return align.sequence(side("source"), side("target"), ["path", "region"], "_key")


@query("align_anchors", "F2", f"WITH {_KEYED} SELECT path, region, spos, tpos FROM anchors", "nodes")
def align_anchors(t: Tables):
    return align.anchor_candidates(_items(t), ["path", "region"]).select("path", "region", "spos", "tpos")


@query(
    "align_free_anchors", "F3 F6",
    f"WITH {_KEYED}, w AS (SELECT *, max(tpos) OVER (PARTITION BY path, region ORDER BY spos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) "
    "AS b, min(tpos) OVER (PARTITION BY path, region ORDER BY spos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM anchors) "
    "SELECT path, region, spos, tpos, coalesce(b, -1) < tpos AND tpos < coalesce(a, 1000000000) AS fixed FROM w", "nodes",
)
def align_free_anchors(t: Tables):
    """Anchors that need no search because none crosses them; the source has no crossing ones here."""
    by = ["path", "region"]
    candidates = cut_lineage(align.anchor_candidates(_items(t), by))
    kept = align.non_crossing(candidates, by).select(*by, "spos", F.lit(True).alias("_kept"))
    joined = candidates.join(kept, [*by, "spos"], "left")
    return joined.select(*by, "spos", "tpos", F.coalesce("_kept", F.lit(False)).alias("fixed"))


@query(
    "align_rank_pairs", "F5",
    f"WITH {_KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY side, path, region, akey ORDER BY pos) AS nth FROM k) SELECT path, region, "
    "min(pos) FILTER (side = 'source') AS spos, min(pos) FILTER (side = 'target') AS tpos FROM r GROUP BY path, region, akey, nth", "nodes",
)
def align_rank_pairs(t: Tables):
    """The pairing of an oversized gap, applied to whole groups."""
    whole = _items(t).withColumn("gap", F.lit(-1).cast("bigint"))
    return align.pair_by_rank(whole, ["path", "region"]).select("path", "region", "spos", "tpos")


def _sides(t: Tables):
    nodes = t.nodes
    return nodes.where(F.col("side") == "source"), nodes.where(F.col("side") == "target")


def _content_pairs(t: Tables):
    """One alignment feeds all that reads pairs of nodes; it is stored once per folder of data."""
    if "content_pairs" not in t.__dict__:
        t.__dict__["content_pairs"] = content.content_pairs(*_sides(t), parts=t.page_parts)
    host = lambda h: F.concat(F.lit(h), "path")
    pairs = t.__dict__["content_pairs"]
    return pairs.withColumns({"source_url": host("https://legacy.example"), "target_url": host("https://new.example")})


@query("content_align", "F1 F4 G1")
def content_align(t: Tables):
    return _content_pairs(t).select(
        "path", "region", F.col("source.key").alias("source_key"), F.col("target.key").alias("target_key"), "confidence",
        "identical",
    )


@query("content_findings", "G1 G2 G3")
def content_findings(t: Tables):
    found = content.content_findings(_content_pairs(t))
    return found.select("id", "category", "severity", "path", "region", "subject", "facet", "confidence", "label")


@query("content_reordered", "G6", "SELECT 0 AS reordered", "nodes")
def content_reordered(t: Tables):
    out = stats.reordered_nodes(_content_pairs(t), ["path", "region"])
    return out.agg(F.coalesce(F.sum("reordered_nodes"), F.lit(0)).cast("int").alias("reordered"))


_BY_POS = (
    "p AS (SELECT coalesce(s.path, d.path) AS path, coalesce(s.pos, d.pos) AS pos, s.text AS a, d.text AS b, s.kind AS ka, d.kind AS kb, "
    "s.region AS ra, d.region AS rb, s.key || '#' || s.ordinal AS sa, d.key || '#' || d.ordinal AS sb FROM (SELECT * FROM nodes WHERE side = "
    "'source') s FULL JOIN (SELECT * FROM nodes WHERE side = 'target') d ON s.path = d.path AND s.pos = d.pos)"
)
_FAM = lambda c: f"CASE WHEN {c} IN ('paragraph','listItem','tableCell') THEN 'text' ELSE {c} END"
_SAME = f"(a = b AND {_FAM('ka')} = {_FAM('kb')})"


def _placed_pairs(t: Tables):
    """Pairs by equal position: the pair-level operators on input another engine can rebuild."""
    s, d = _sides(t)
    node = F.struct(*content.NODE_COLUMNS)
    pairs = s.select("path", "pos", node.alias("source")).join(d.select("path", "pos", node.alias("target")), ["path", "pos"], "full_outer")
    urls = {c: F.lit(None).cast("string") for c in ("source_url", "target_url")}
    region = F.coalesce("source.region", "target.region")
    return pairs.withColumns(urls | {"region": region, "confidence": F.lit(1.0), "identical": content.identical()})


@query(
    "content_one_sided", "G2",
    f"WITH {_BY_POS} SELECT 'content.missing' AS category, path, ra AS region, sa AS subject, 'The target lacks ' || CASE ka WHEN 'heading' THEN "
    f"'h1 ' ELSE ka || ' ' END || '\"' || {sql.truncate('a', 60)} || '\"' AS label FROM p WHERE b IS NULL UNION ALL SELECT 'content.added', path, rb, "
    f"sb, 'The target adds ' || CASE kb WHEN 'heading' THEN 'h1 ' ELSE kb || ' ' END || '\"' || {sql.truncate('b', 60)} || '\"' FROM p WHERE a IS NULL",
    "nodes",
)
def content_one_sided(t: Tables):
    return content.one_sided_findings(_placed_pairs(t)).select("category", "path", "region", "subject", "label")


@query(
    "content_drift", "G3 G5 C33",
    f"WITH {_BY_POS}, src AS (SELECT path, pos, ra, ka, sa, a, b FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND NOT {_SAME}), "
    + changes_sql("src", "path, sa, a, b")
    + " SELECT CASE WHEN len(changes) > 0 THEN 'content.value-drift' ELSE 'content.drift' END AS category, path, sa AS subject, CASE WHEN "
    "len(changes) > 0 THEN array_to_string(list_transform(changes, lambda c: regexp_extract(c, '^[a-z]+')), '+') END AS facet, 'Wording moved: \"' || "
    f"{sql.truncate('a', 60)} || '\" -> \"' || {sql.truncate('b', 60)} || '\"' || CASE WHEN len(changes) > 0 THEN ' (' || "
    "array_to_string(changes, '; ') || ')' ELSE '' END AS label FROM chg", "nodes",
)
def content_drift(t: Tables):
    found = content.drift_findings(content.with_drift(_placed_pairs(t)))
    return found.select("category", "path", "subject", "facet", "label")


@query(
    "content_identity", "G4",
    f"WITH {_BY_POS} SELECT path, pos, {_SAME} AS same FROM p WHERE a IS NOT NULL AND b IS NOT NULL", "nodes",
)
def content_identity(t: Tables):
    both = _placed_pairs(t).where(F.col("source").isNotNull() & F.col("target").isNotNull())
    return both.select("path", "pos", F.col("identical").alias("same"))


_NODE_SIM = "CASE WHEN fa <> fb THEN 0.0::DOUBLE WHEN ka <> kb THEN 0.98::DOUBLE * d ELSE d END"


@query(
    "content_similarity", "F7",
    f"WITH {_BY_POS}, g AS (SELECT *, {_FAM('ka')} AS fa, {_FAM('kb')} AS fb, {sql.grams('a')} AS a_g, {sql.grams('b')} AS b_g FROM p WHERE a IS "
    f"NOT NULL AND b IS NOT NULL), h AS (SELECT *, {sql.dice('a', 'b')} AS d FROM g) SELECT path, pos, round({_NODE_SIM}, 6) AS similarity FROM h",
    "nodes",
)
def content_similarity(t: Tables):
    both = _placed_pairs(t).where(F.col("source").isNotNull() & F.col("target").isNotNull())
    return both.select("path", "pos", F.round(content.node_similarity(), 6).alias("similarity"))


@query(
    "content_stats", "J2",
    f"WITH {_BY_POS}, c AS (SELECT count(a) AS source_nodes, count(b) AS target_nodes, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS "
    f"matched_nodes, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND NOT {_SAME}) AS drifted_nodes, count(*) FILTER (b IS NULL) AS "
    f"missing_nodes, count(*) FILTER (a IS NULL) AS added_nodes FROM p) SELECT *, {sql.pct('(matched_nodes - drifted_nodes)', 'source_nodes')} AS "
    "content_parity FROM c", "nodes",
)
def content_stats(t: Tables):
    return stats.content_stats(_placed_pairs(t))


@query(
    "content_hash", "B20",
    "WITH l AS (SELECT side, path, pos // 1000 AS run, pos, sha1(region || ':' || CASE WHEN kind IN ('paragraph','listItem','tableCell') THEN "
    "'text' ELSE kind END || ':' || text) AS d FROM nodes), r AS (SELECT side, path, run, sha1(string_agg(d, chr(10) ORDER BY pos)) AS d FROM l "
    "GROUP BY 1, 2, 3) SELECT side, path, sha1(string_agg(d, chr(10) ORDER BY run)) AS content_hash FROM r GROUP BY 1, 2", "nodes",
)
def content_hash(t: Tables):
    return content.content_hash(t.nodes)


@query(
    "content_nodes", "B18 B19 C1 C2",
    "SELECT side, path, pos, region, kind, key, ordinal FROM nodes", "nodes",
)
def content_nodes(t: Tables):
    return t.nodes.select("side", "path", "pos", "region", "kind", "key", "ordinal")


_META = (
    "mp AS (SELECT doc_id, coalesce(split_part(text, chr(10), 1), '') AS title, lang, source FROM documents)"
)


@query(
    "content_meta_drift", "G7",
    f"WITH {_META}, f AS (SELECT '/doc/' || doc_id AS path, unnest([{{'f': 'title', 'a': trim(title), 'b': trim(CASE WHEN doc_id % 7 = 1 THEN title "
    "|| ' | Shop' ELSE title END)}, {'f': 'description', 'a': trim(source), 'b': trim(CASE WHEN doc_id % 5 = 2 THEN '' ELSE source END)}, "
    "{'f': 'lang', 'a': lang, 'b': CASE WHEN doc_id % 9 = 3 THEN upper(lang) ELSE lang END}]) AS x FROM mp) SELECT path, x.f AS facet, CASE WHEN "
    "x.b = '' THEN x.f || ' left empty by the target' ELSE x.f || ' differs' END AS label FROM f WHERE x.a <> x.b",
)
def content_meta_drift(t: Tables):
    n = F.col("doc_id")
    title = F.substring_index("text", "\n", 1)
    meta = lambda a, b, c: F.struct(
        a.alias("title"), b.alias("description"), F.lit("x").alias("og_title"), F.lit(None).cast("string").alias("og_description"),
        c.alias("lang"),
    )
    pages = t.documents.select(
        F.concat(F.lit("/doc/"), n.cast("string")).alias("path"),
        F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("target_url"),
        meta(title, F.col("source"), F.col("lang")).alias("source_meta"),
        meta(
            F.when(n % 7 == 1, F.concat(title, F.lit(" | Shop"))).otherwise(title),
            F.when(n % 5 == 2, F.lit("")).otherwise(F.col("source")),
            F.when(n % 9 == 3, F.upper("lang")).otherwise(F.col("lang")),
        ).alias("target_meta"),
    )
    return content.meta_drift(pages).select("path", "facet", "label")


# --- images and prices ------------------------------------------------------------------

_IMG = "im AS (SELECT * FROM asset_rows WHERE visible), ip AS (SELECT s.path, s.region, s.asset_key AS k, d.asset_key AS dk, s.alt AS a, d.alt AS b, s.natural_width AS sw, d.natural_width AS dw, s.natural_height AS sh, d.natural_height AS dh FROM (SELECT * FROM im WHERE side = 'source') s FULL JOIN (SELECT * FROM im WHERE side = 'target') d ON s.path = d.path AND s.region = d.region AND s.asset_key = d.asset_key)"


@query(
    "image_exact_pairs", "G8",
    f"WITH {_IMG} SELECT path, k AS asset_key, a <> b AS alt_drift, abs(dw - sw)::DOUBLE / sw > 0.02 OR abs(dh - sh)::DOUBLE / sh > 0.02 AS "
    "size_drift FROM ip WHERE k IS NOT NULL AND dk IS NOT NULL", "asset_rows",
)
def image_exact_pairs(t: Tables):
    pairs = _image_pairs(t).where(F.col("source.asset_key") == F.col("target.asset_key"))
    return pairs.select("path", F.col("source.asset_key").alias("asset_key"), "alt_drift", "size_drift")


def _image_pairs(t: Tables):
    side = lambda s: t.images.where(F.col("side") == s)
    host = lambda h: F.concat(F.lit(h), "path")
    pairs = assets.image_pairs(side("source"), side("target"))
    return pairs.withColumns({"source_url": host("https://legacy.example"), "target_url": host("https://new.example")})


@query("image_findings", "G8 G9 G17 F1")
def image_findings(t: Tables):
    return assets.image_findings(_image_pairs(t)).select("id", "category", "path", "region", "subject", "label")


@query("image_stats", "J3")
def image_stats(t: Tables):
    return stats.image_stats(_image_pairs(t))


def _placed(t: Tables, name: str, columns):
    rows = getattr(t, name)
    side = lambda s, n: rows.where(F.col("side") == s).select("path", "pos", F.struct(*columns).alias(n))
    return side("source", "source").join(side("target", "target"), ["path", "pos"])


@query(
    "image_similarity", "F8",
    "SELECT s.path, s.pos, CASE WHEN s.region <> d.region THEN 0.0 WHEN s.asset_key = d.asset_key THEN 1.0 WHEN s.alt <> '' AND s.alt = d.alt THEN "
    "0.8 ELSE 0.0 END::DOUBLE AS similarity FROM asset_rows s JOIN asset_rows d ON s.side = 'source' AND d.side = 'target' AND s.path = d.path AND "
    "s.pos = d.pos", "asset_rows",
)
def image_similarity(t: Tables):
    pairs = _placed(t, "images", assets.IMAGE_COLUMNS)
    return pairs.select("path", "pos", assets.image_similarity().alias("similarity"))


@query(
    "image_size_drift", "G9",
    "SELECT s.path, s.pos, s.natural_width <> 0 AND (abs(d.natural_width - s.natural_width)::DOUBLE / s.natural_width > 0.02 OR "
    "abs(d.natural_height - s.natural_height)::DOUBLE / s.natural_height > 0.02) AS drifts FROM asset_rows s JOIN asset_rows d ON s.side = "
    "'source' AND d.side = 'target' AND s.path = d.path AND s.pos = d.pos", "asset_rows",
)
def image_size_drift(t: Tables):
    return _placed(t, "images", assets.IMAGE_COLUMNS).select("path", "pos", assets.size_drifts().alias("drifts"))


def _price_pairs(t: Tables):
    side = lambda s: t.prices.where(F.col("side") == s)
    host = lambda h: F.concat(F.lit(h), "path")
    pairs = assets.price_pairs(side("source"), side("target"))
    return pairs.withColumns({"source_url": host("https://legacy.example"), "target_url": host("https://new.example")})


@query("price_findings", "G10 G11 F1")
def price_findings(t: Tables):
    return assets.price_findings(_price_pairs(t)).select("id", "category", "path", "subject", "expected_json", "actual_json")


@query("price_stats", "J4")
def price_stats(t: Tables):
    return stats.price_stats(_price_pairs(t))


_PP = (
    f"v AS (SELECT side, path, pos, raw, region, context, CASE WHEN raw LIKE 'EUR%' THEN 'EUR' ELSE 'USD' END AS currency, (CAST(round("
    "p_retailprice * 100) AS BIGINT) + CASE WHEN p_partkey % 17 = 2 AND side = 'target' THEN 10000 ELSE 0 END) / 100.0::DOUBLE AS amount FROM prices q "
    "JOIN part ON q.context = p_name || ' ' || p_brand || ' no ' || p_partkey), w AS (SELECT s.path, s.pos, s.raw AS ra, d.raw AS rb, s.amount AS "
    "aa, d.amount AS ab, s.currency AS ca, d.currency AS cb, s.context AS xa, d.context AS xb FROM v s JOIN v d ON s.side = 'source' AND d.side = "
    "'target' AND s.path = d.path AND s.pos = d.pos)"
)


@query(
    "price_drift_flags", "G10",
    f"WITH {_PP} SELECT path, pos, abs(aa - ab) > 0.001 AS value_drift, ca <> cb AS currency_drift, abs(aa - ab) <= 0.001 AND ra <> rb AS "
    "format_drift FROM w", "prices",
)
def price_drift_flags(t: Tables):
    pairs = assets.with_price_drift(_placed(t, "prices", assets.PRICE_COLUMNS))
    return pairs.select("path", "pos", "value_drift", "currency_drift", "format_drift")


@query(
    "price_similarity", "F9",
    f"WITH {_PP}, o AS (SELECT w.path, w.pos, w.aa, w.ca, w.xa, z.ab, z.cb, z.xb FROM w JOIN w z ON z.path = w.path AND z.pos = (w.pos + 1) % 8), g AS (SELECT *, "
    f"{sql.grams('xa')} AS xa_g, {sql.grams('xb')} AS xb_g FROM o), h AS (SELECT *, {sql.dice('xa', 'xb')} AS d FROM g) SELECT path, xa, xb, "
    "round(CASE WHEN d >= 0.6 THEN 0.6 + d * 0.4 WHEN abs(aa - ab) <= 0.001 AND ca = cb THEN 0.55 ELSE d * 0.5 END::DOUBLE, 6) AS similarity FROM h",
    "prices",
)
def price_similarity(t: Tables):
    pairs = _placed(t, "prices", assets.PRICE_COLUMNS)
    # Each price meets its neighbour on the page, so that texts and amounts differ.
    neighbour = pairs.select("path", ((F.col("pos") + 7) % 8).alias("pos"), "target")
    return pairs.drop("target").join(neighbour, ["path", "pos"]).select(
        "path", F.col("source.context").alias("xa"), F.col("target.context").alias("xb"),
        F.round(assets.price_similarity(), 6).alias("similarity"),
    )


@query(
    "price_subject", "G11",
    f"WITH {_PP} SELECT path, pos, xa AS subject FROM w", "prices",
)
def price_subject(t: Tables):
    return _placed(t, "prices", assets.PRICE_COLUMNS).select("path", "pos", assets.price_subject("source").alias("subject"))


# --- styles -----------------------------------------------------------------------------

_ST = (
    "sp AS (SELECT s.path, s.viewport, s.key, s.pos, s.visible AS sv, d.visible AS dv, s.x AS sx, d.x AS dx, s.width AS sw, d.width AS dw, s.height "
    "AS sh, d.height AS dh, " + ", ".join(f"s.{c} AS s_{c}, d.{c} AS d_{c}" for c in STYLE_COLUMNS.values())
    + " FROM styles s JOIN styles d ON s.side = 'source' AND d.side = 'target' AND s.path = d.path AND s.viewport = d.viewport AND s.key = d.key)"
)


def _styled(t: Tables):
    """Style rows of both sides by node, stored once per folder of data."""
    if "styled" not in t.__dict__:
        t.__dict__["styled"] = cut_lineage(styles.styled_pairs(t.style_pairs, t.styles, t.captures))
    return t.__dict__["styled"]


@query(
    "style_lookup", "E10 E11 E12",
    f"WITH {_ST} SELECT path, viewport, key, sv AS source_visible, dv AS target_visible, sx AS source_x, dx AS target_x FROM sp", "styles",
)
def style_lookup(t: Tables):
    return _styled(t).select(
        "path", "viewport", F.col("source.key").alias("key"), F.col("source_style.visible").alias("source_visible"),
        F.col("target_style.visible").alias("target_visible"), F.col("source_style.box.x").alias("source_x"),
        F.col("target_style.box.x").alias("target_x"),
    )


@query(
    "style_geometry", "E10 G17",
    "SELECT s.path, s.key, s.x AS source_x, d.x AS target_x FROM styles s JOIN styles d ON s.side = 'source' AND d.side = 'target' AND s.viewport = "
    "'desktop' AND d.viewport = 'desktop' AND s.path = d.path AND s.key = d.key", "styles",
)
def style_geometry(t: Tables):
    boxed = styles.attach_boxes(t.style_pairs, styles.geometry_index(t.styles, "desktop"))
    return boxed.select(
        "path", F.col("source.key").alias("key"), F.col("source_box.x").alias("source_x"), F.col("target_box.x").alias("target_x")
    )


_LEN = (
    "sd AS (SELECT path, viewport, key, p.property, TRY_CAST(replace(p.a, 'px', '') AS DOUBLE) AS a, TRY_CAST(replace(p.b, 'px', '') AS DOUBLE) AS b, p.a "
    "AS ta, p.b AS tb FROM (SELECT path, viewport, key, unnest([{'property': 'font-size', 'a': s_css_font_size, 'b': d_css_font_size}, {'property': "
    "'margin-top', 'a': s_css_margin_top, 'b': d_css_margin_top}]) AS p FROM sp WHERE sv AND dv) x), sc AS (SELECT *, floor((b - a) * 100 + 0.5) / 100 "
    "AS delta FROM sd), sm AS (SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(abs(delta) / 4, CASE WHEN a <> 0 THEN abs(delta / a) / 0.15 ELSE 0 END) END AS magnitude FROM sc WHERE a IS "
    "NULL OR abs(delta) > 1)"
)


@query(
    "style_length_drift", "G12 G13",
    f"WITH {_ST}, {_LEN} SELECT path, viewport, key, property, CASE WHEN magnitude < 1 THEN 'info' ELSE 'warning' END AS severity, "
    "floor(magnitude * 100 + 0.5) / 100 AS magnitude FROM sm", "styles",
)
def style_length_drift(t: Tables):
    rows = styles.property_comparisons(_styled(t), changed_only=True).where(F.col("property").isin("font-size", "margin-top"))
    found = styles.property_findings(rows)
    key = F.regexp_extract("subject", r"\|(.*)#0$", 1)
    return found.select("path", "viewport", key.alias("key"), F.col("facet").alias("property"), "severity", "magnitude")


_JSON = lambda c: f"CASE WHEN {c} IS NULL THEN NULL ELSE to_json({c}) END"


@query(
    "style_property_findings", "G12 G13 C23 C25",
    f"{COMPARED_SQL} SELECT sha1(concat_ws('|', 'css.property-drift', path, viewport, 'main', 'paragraph', 'main|' || key || '#0', property)) AS id, "
    "CASE WHEN kind = 'font-fallback' OR magnitude < 1 THEN 'info' ELSE 'warning' END AS severity, path, viewport, property AS facet, "
    f"{_JSON('va')} AS expected_json, {_JSON('vb')} AS actual_json, floor(magnitude * 100 + 0.5) / 100 AS magnitude FROM cmp WHERE kind <> 'equal'",
    "styles",
)
def style_property_findings(t: Tables):
    found = styles.property_findings(styles.property_comparisons(_styled(t), changed_only=True))
    return found.select("id", "severity", "path", "viewport", "facet", "expected_json", "actual_json", "magnitude")


_LAY = (
    "sl AS (SELECT path, viewport, key, floor((dx - sx) * 100 + 0.5) / 100 AS mx, floor((dw - sw) * 100 + 0.5) / 100 AS mw, floor((dh - sh) * 100 + "
    "0.5) / 100 AS mh, greatest(2.0::DOUBLE, CASE viewport WHEN 'desktop' THEN 1440 WHEN 'tablet' THEN 768 WHEN 'mobile-md' THEN 390 ELSE 360 END * "
    "0.01::DOUBLE) AS tol FROM sp WHERE sv AND dv), sq AS (SELECT *, greatest(abs(mx), abs(mw), abs(mh)) / (tol * 2) AS magnitude FROM sl WHERE "
    "abs(mx) > tol OR abs(mw) > tol OR abs(mh) > tol)"
)


@query(
    "style_layout_drift", "G14",
    f"WITH {_ST}, {_LAY} SELECT path, viewport, key, CASE WHEN abs(mw) > tol OR abs(mh) > tol THEN 'size' ELSE 'position' END AS facet, CASE WHEN "
    "magnitude < 1 THEN 'info' ELSE 'warning' END AS severity, floor(magnitude * 100 + 0.5) / 100 AS magnitude FROM sq", "styles",
)
def style_layout_drift(t: Tables):
    found = styles.layout_findings(styles.layout_comparisons(_styled(t)))
    key = F.regexp_extract("subject", r"\|(.*)#0$", 1)
    return found.select("path", "viewport", key.alias("key"), "facet", "severity", "magnitude")


@query(
    "style_overflow", "G15 B17",
    "SELECT s.path, s.viewport FROM captures s JOIN captures d ON s.side = 'source' AND d.side = 'target' AND s.path = d.path AND s.viewport = "
    "d.viewport WHERE d.document_width > d.width + 1 AND NOT s.document_width > s.width + 1", "captures",
)
def style_overflow(t: Tables):
    return styles.overflow_rows(styles.common_viewports(t.captures)).select("path", "viewport")


@query(
    "style_visibility", "G16",
    f"WITH {_ST}, g AS (SELECT path, key, count(*) AS seen, count(*) FILTER (sv <> dv) AS bad, string_agg(viewport, ',' ORDER BY viewport) FILTER "
    "(sv = dv) AS agrees FROM sp GROUP BY 1, 2 HAVING count(*) FILTER (sv <> dv) > 0) SELECT 'css.visibility-drift' AS category, path, key, NULL AS "
    "viewport, NULL AS agrees FROM g WHERE seen = bad UNION ALL SELECT 'css.responsive-visibility-drift', sp.path, sp.key, viewport, agrees FROM sp JOIN "
    "g ON g.path = sp.path AND g.key = sp.key WHERE seen > bad AND sv <> dv", "styles",
)
def style_visibility(t: Tables):
    found = styles.visibility_findings(styles.visibility(_styled(t)))
    agrees = F.array_join(F.from_json(F.get_json_object("details_json", "$.agreesAt"), "array<string>"), ",")
    key = F.regexp_extract("subject", r"\|(.*)#0$", 1)
    return found.select("category", "path", key.alias("key"), "viewport", agrees.alias("agrees"))


_STATS_SQL = (
    f"{COMPARED_SQL}, {_ST}, {_LAY}, nn AS (SELECT viewport, count(*) FILTER (sv AND dv) AS compared_nodes, count(*) FILTER (sv <> dv) AS "
    "visibility_drifts FROM sp GROUP BY ROLLUP (viewport)), pp AS (SELECT viewport, count(*) AS compared_properties, count(*) FILTER (kind <> 'equal') "
    "AS property_drifts FROM cmp GROUP BY ROLLUP (viewport)), ll AS (SELECT viewport, count(*) AS layout_drifts FROM sq GROUP BY ROLLUP (viewport)), "
    "stats AS (SELECT nn.viewport, compared_nodes, coalesce(compared_properties, 0) AS compared_properties, coalesce(property_drifts, 0) AS "
    f"property_drifts, coalesce(layout_drifts, 0) AS layout_drifts, visibility_drifts, {sql.pct('(compared_properties - property_drifts)', 'compared_properties')} "
    "AS style_parity FROM nn LEFT JOIN pp ON pp.viewport IS NOT DISTINCT FROM nn.viewport LEFT JOIN ll ON ll.viewport IS NOT DISTINCT FROM nn.viewport) "
)


@query(
    "style_stats", "J5",
    _STATS_SQL + "SELECT * FROM stats", "styles",
)
def style_stats(t: Tables):
    styled = _styled(t)
    return stats.css_stats(styles.viewport_stats(styled, styles.property_comparisons(styled)))


@query("style_parity", "J5", _STATS_SQL + "SELECT viewport, style_parity FROM stats", "styles")
def style_parity(t: Tables):
    styled = _styled(t)
    return stats.css_stats(styles.viewport_stats(styled, styles.property_comparisons(styled))).select("viewport", "style_parity")


@query(
    "style_top_properties", "J6",
    f"{COMPARED_SQL} SELECT property, count(*) AS count FROM cmp WHERE kind <> 'equal' GROUP BY 1 ORDER BY 2 DESC, 1", "styles",
)
def style_top_properties(t: Tables):
    return stats.top_properties(styles.property_comparisons(_styled(t), changed_only=True).where(~F.col("equal")))


@query("run_compare", "J10")
def run_compare(t: Tables):
    """The whole comparison of the derived sides: every finding family, suppressed and tagged."""
    from twinlens.plans.compare import compare_tables, from_derived

    result = compare_tables(from_derived(t))
    return result.findings.select("id", "category", "severity", "path", "viewport", "region", "subject", "orphan_page")


@query("run_statistics", "J10 K18")
def run_statistics(t: Tables):
    from twinlens.operators.report import summary_table
    from twinlens.plans.compare import compare_tables, from_derived

    return summary_table(compare_tables(from_derived(t)).stats)


