"""Queries over sources, stores, page intake, the link graph, extraction and the stream."""

from __future__ import annotations


from pyspark.sql import functions as F

from twinlens.config import IntakeRules, TrapLimits
from twinlens.functions.images import with_asset_key
from twinlens.functions.prices import parse_price, scan_currency
from twinlens.operators import assets, graph, intake
from twinlens.operators.content import node_attrs
from twinlens.operators.rundiff import diff_runs
from twinlens.operators.scan import occurrence
from twinlens.operators.stats import finding_counts
from twinlens.plans import second_engine as sql
from twinlens.plans.derive import PORTABLE, Tables
from twinlens.plans.queries_report import _DIFF
from twinlens.plans.registry import query
from twinlens.session import cut_lineage, scratch_path
from twinlens.sources import html, sitedocs
from twinlens.sources import snapshots as store
from twinlens.streaming import intake as streaming


def scratch(t: Tables, name: str) -> str:
    """A fresh place in the folder the cluster shares for checkpoints."""
    return scratch_path(t.spark, name)


# --- stores -----------------------------------------------------------------------------


def _snapshots(t: Tables):
    """The linked page set in the stored snapshot form."""
    rows = t.page_rows
    hop = "array<struct<url:string,status:int>>"
    return rows.select(
        F.lit(1).alias("schemaVersion"), "side", F.col("url").alias("requestedUrl"), F.col("url").alias("finalUrl"), "path",
        "depth", "status", F.col("redirect_chain").cast(hop).alias("redirectChain"), "aliases",
        F.sha1("path").alias("contentHash"), F.col("path").alias("title"),
        F.when(F.col("slow_capture"), F.array(F.lit("readiness"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )


_INDEX_SQL = "SELECT side, path, url, status, hops::INT AS redirects, slow_capture FROM page_rows"


def _index_view(snapshots):
    index = store.index_of(snapshots)
    return index.select("side", "path", "url", "status", F.size("redirect_chain").alias("redirects"), "slow_capture")


@query("store_json_scan", "A1", _INDEX_SQL, "page_rows")
def store_json_scan(t: Tables):
    """Written as gzipped JSON, a file per page, and read back by the scan."""
    out = scratch(t, "snapshots-json")
    store.write_snapshot_json(_snapshots(t), out)
    return _index_view(store.scan_snapshot_json(t.spark, out))


@query("store_parquet_round_trip", "A3", _INDEX_SQL, "page_rows")
def store_parquet_round_trip(t: Tables):
    out = scratch(t, "snapshots")
    store.write_snapshots(_snapshots(t).withColumn("run_id", F.lit("r1")), out, "overwrite")
    return _index_view(store.scan_snapshots(t.spark, out, "r1"))


@query(
    "store_lookup", "A2",
    "SELECT p.side, p.path, p.status FROM page_rows p WHERE p.side = 'target' AND p.path = (SELECT min(key) FROM canon)", "page_rows",
)
def store_lookup(t: Tables):
    wanted = t.canon.agg(F.min("key")).scalar()
    return store.lookup(_snapshots(t), "target", wanted).select("side", "path", "status")


@query("store_paths", "A4", "SELECT path FROM page_rows WHERE side = 'source' ORDER BY path", "page_rows")
def store_paths(t: Tables):
    return store.list_paths(_snapshots(t), "source")


def _runs(t: Tables):
    return t.derived("runs")


@query("store_runs", "A5", "SELECT run_id FROM runs WHERE started_at IS NOT NULL ORDER BY run_id", "runs")
def store_runs(t: Tables):
    return store.list_runs(_runs(t)).select("run_id")


@query("store_latest_run", "A5", "SELECT max(run_id) AS run_id FROM runs WHERE started_at IS NOT NULL", "runs")
def store_latest_run(t: Tables):
    return store.latest_run(_runs(t))


@query("store_compatible_runs", "A6", "SELECT run_id FROM runs WHERE schema_version = 1", "runs")
def store_compatible_runs(t: Tables):
    return store.compatible_runs(_runs(t)).select("run_id")


@query(
    "store_baselines", "A7", "SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS baseline_id FROM runs", "runs",
)
def store_baselines(t: Tables):
    return store.previous_runs(_runs(t))


@query(
    "store_retention", "A8",
    "SELECT run_id, count(*) AS n FROM (SELECT run_id FROM fid UNION ALL SELECT run_id FROM fid_base) x WHERE run_id >= 'c' GROUP BY 1",
    "fid fid_base",
)
def store_retention(t: Tables):
    rows = t.findings("baseline").unionByName(t.findings("current"))
    runs = rows.select("run_id").distinct()
    return store.retained(rows, runs, "c").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "store_format_bytes", "A9",
    "SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN CASE WHEN k >= 10 THEN floor(k + 0.5)::BIGINT::VARCHAR ELSE "
    "printf('%.1f', floor(k * 10 + 0.5) / 10) END || ' KB' ELSE CASE WHEN k / 1024 >= 10 THEN floor(k / 1024 + 0.5)::BIGINT::VARCHAR ELSE "
    "printf('%.1f', floor(k / 1024 * 10 + 0.5) / 10) END || ' MB' END AS size FROM (SELECT doc_id, n_chars * 37 AS b, n_chars * 37 / 1024.0::DOUBLE "
    "AS k FROM documents) d",
)
def store_format_bytes(t: Tables):
    return t.documents.select("doc_id", store.format_bytes(F.col("n_chars") * 37).alias("size"))


@query("store_sizes", "A9")
def store_sizes(t: Tables):
    out = scratch(t, "sized")
    rows = t.findings("baseline").unionByName(t.findings("current"))
    rows.write.partitionBy("run_id").parquet(out)
    return store.stored_bytes(t.spark, out).select("run_id", (F.col("bytes") > 0).alias("stored"))


@query("store_slugs", "A10", f"SELECT key AS path, {sql.slug('key')} AS slug FROM first_pages", "first_pages")
def store_slugs(t: Tables):
    return t.derived("first_pages").select(F.col("key").alias("path"), store.path_slug(F.col("key")).alias("slug"))


@query(
    "store_report_sinks", "A14 A15",
    " UNION ALL ".join(
        f"SELECT '{part}' AS part, id, category, severity, path FROM fid WHERE category LIKE '{like}'"
        for part, like in (("findings", "%"), ("css", "css.%"), ("links", "link.%"), ("coverage", "page.%"))
    ), "fid",
)
def store_report_sinks(t: Tables):
    out = scratch(t, "report")
    found = t.findings().drop("event_id")
    store.write_report(found, finding_counts(found), out)
    spark, schema = t.spark, found.schema
    one = lambda df, name: df.select(F.lit(name).alias("part"), "id", "category", "severity", "path")
    parts = one(store.scan_findings(spark, f"{out}/findings", "current"), "findings")
    for name in ("css", "links", "coverage"):
        parts = parts.unionByName(one(spark.read.schema(schema).json(f"{out}/{name}"), name))
    return parts


@query(
    "store_diff_sink", "A16",
    _DIFF + "SELECT 'current' AS run_id, id, bucket FROM diff", "fid fid_base",
)
def store_diff_sink(t: Tables):
    out = scratch(t, "diff")
    store.write_diff(diff_runs(t.findings("baseline"), t.findings("current")), out, "current")
    return t.spark.read.schema("id string, bucket string, run_id string").json(out).select("run_id", "id", "bucket")


# --- site documents ---------------------------------------------------------------------


@query("sitemap_urls", "A11", "SELECT host, url FROM page_hosts", "page_hosts")
def sitemap_urls(t: Tables):
    return sitedocs.sitemap_urls(t.derived("sitedocs")).select("host", F.col("loc").alias("url"))


@query(
    "sitemap_expand", "A12 A11",
    "WITH r AS (SELECT host, min(page_id) AS page_id FROM page_hosts GROUP BY 1) SELECT p.host, p.url FROM page_hosts p JOIN r ON r.host = p.host AND "
    "r.page_id = p.page_id", "page_hosts",
)
def sitemap_expand(t: Tables):
    docs = cut_lineage(t.derived("sitedocs"))
    visited = sitedocs.expand_sitemaps(docs, sitedocs.robots_sitemaps(docs))
    return sitedocs.sitemap_seeds(docs, visited)


@query(
    "robots_rules", "A13",
    "SELECT DISTINCT host, unnest(['disallow', 'allow', 'crawl-delay']) AS kind, unnest(['/de/', '/de/*5', '3']) AS pattern FROM page_hosts",
    "page_hosts",
)
def robots_rules(t: Tables):
    return sitedocs.robots_rules(t.derived("sitedocs"), "Parity").select("host", "kind", "pattern")


@query("robots_delay", "A13", "SELECT DISTINCT host, 1500::BIGINT AS crawl_delay_ms FROM page_hosts", "page_hosts")
def robots_delay(t: Tables):
    return sitedocs.crawl_delay(sitedocs.robots_rules(t.derived("sitedocs")))


@query(
    "robots_allowed", "D8",
    "SELECT page_id, CASE WHEN greatest(CASE WHEN starts_with(p, '/fr/') THEN 4 ELSE -1 END, CASE WHEN regexp_matches(p, '^/.*\\.html$') THEN 8 ELSE -1 "
    "END) = -1 THEN true ELSE CASE WHEN starts_with(p, '/fr/8') THEN 5 ELSE -1 END >= greatest(CASE WHEN starts_with(p, '/fr/') THEN 4 ELSE -1 END, "
    "CASE WHEN regexp_matches(p, '^/.*\\.html$') THEN 8 ELSE -1 END) END AS allowed FROM (SELECT page_id, regexp_extract(url, "
    "'^https?://[^/]+(/[^?#]*)', 1) AS p FROM pages) x",
)
def robots_allowed(t: Tables):
    pages = t.pages.select(
        "page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"),
    )
    return intake.robots_allowed(pages, sitedocs.robots_rules(t.derived("sitedocs"))).select("page_id", "allowed")


# --- intake -----------------------------------------------------------------------------

_RULES = IntakeRules(
    base_url="https://www.cheap-pills.example.com/",
    additional_origins=tuple(
        f"{s}://{h}" for s in ("http", "https")
        for h in ("blog.tionsh.example.net", "blog.ththan.example.net", "thther.example.org", "m.ththth.example.net")
    ),
    exclude=("/3",), ignore_paths=(r"^/the",), include=(r"^/[a-z]", r"%"), max_depth=2,
    traps=TrapLimits(segments=12, params=1, repeats=3, url_length=60),
)
_ORIGINS = ", ".join(f"'{o.rstrip('/')}'" for o in (_RULES.base_url, *_RULES.additional_origins))
_PATH = sql.norm_path(sql.raw_path("url"))
_CLASSIFIED = (
    f"c AS (SELECT *, {_PATH} AS p, regexp_extract(url, '^https?://[^/?#]+') || {sql.canon_key('url')} AS href FROM offers), k AS (SELECT *, CASE WHEN "
    f"regexp_extract(url, '^https?://[^/?#]+') NOT IN ({_ORIGINS}) THEN 'off-origin' WHEN length(url) > 60 OR length(url) - length(replace(url, '=', "
    "'')) > 1 THEN 'trap' WHEN contains(p, '/3') THEN 'excluded' WHEN regexp_matches(p, '^/the') THEN 'ignored-path' WHEN NOT (regexp_matches(p, "
    "'^/[a-z]') OR contains(p, '%')) THEN 'not-included' END AS reject FROM c)"
)


def _classified(t: Tables):
    return intake.classify_offers(t.offers, _RULES)


@query(
    "intake_origin", "D1", f"SELECT seq, regexp_extract(url, '^https?://[^/?#]+') IN ({_ORIGINS}) AS allowed FROM offers", "offers",
)
def intake_origin(t: Tables):
    return intake.with_url_parts(t.offers).select("seq", intake.origin_allowed(_RULES).alias("allowed"))


@query(
    "intake_traps", "D2",
    "SELECT page_id, CASE WHEN length(u) > 70 THEN 'url-length' WHEN contains(u, '&') THEN 'query-params' WHEN page_id % 3 = 0 THEN 'repeated-segment' "
    "END AS reason FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+') || CASE WHEN page_id % 3 = 0 THEN '/a/b/a/c/a' ELSE '/a/b/a' END || "
    "regexp_extract(regexp_replace(url, '#.*$', ''), '\\?.*$') || CASE WHEN page_id % 5 = 0 THEN '" + "x" * 40 + "' ELSE '' END AS u FROM pages) p",
)
def intake_traps(t: Tables):
    n = F.col("page_id")
    u = F.concat(
        F.regexp_extract("url", "^https?://[^/]+", 0),
        F.when(n % 3 == 0, F.lit("/a/b/a/c/a")).otherwise(F.lit("/a/b/a")),
        F.regexp_extract(F.regexp_replace("url", "#.*$", ""), r"\?.*$", 0),
        F.when(n % 5 == 0, F.lit("x" * 40)).otherwise(F.lit("")),
    )
    # A URL that trips two limits at once reports the one that is tested first.
    rows = t.pages.select("page_id", u.alias("u"))
    limits = TrapLimits(params=1, url_length=70)
    return intake.with_url_parts(rows, "u").select("page_id", intake.trap_reason(F.col("u"), limits).alias("reason"))


@query("intake_reasons", "D3 D5", f"WITH {_CLASSIFIED} SELECT seq, reject FROM k", "offers")
def intake_reasons(t: Tables):
    return _classified(t).select("seq", "reject")


_DECIDED = (
    _CLASSIFIED + ", b AS (SELECT *, CASE WHEN reject IS NULL THEN min(CASE WHEN reject IS NULL THEN depth END) OVER (PARTITION BY href, reject IS NULL "
    "ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS best FROM k), d AS (SELECT *, CASE WHEN reject IS NOT NULL THEN reject WHEN "
    "best <= depth THEN 'duplicate' WHEN depth > 2 THEN 'depth-exceeded' WHEN best <= 2 THEN 'promoted' WHEN best IS NOT NULL AND min(CASE WHEN reject IS "
    "NULL THEN depth END) OVER (PARTITION BY href, reject IS NULL ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 THEN 'promoted' "
    "ELSE 'accepted' END AS decision FROM b)"
)


def _decided(t: Tables):
    return intake.decide_offers(_classified(t), _RULES.max_depth)


@query("intake_decisions", "D4 D5 D6", f"WITH {_DECIDED} SELECT seq, decision FROM d", "offers")
def intake_decisions(t: Tables):
    return _decided(t).select("seq", "decision")


@query(
    "intake_best_depth", "D6",
    "SELECT seq, min(depth) OVER (PARTITION BY h ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM (SELECT *, "
    "regexp_extract(url, '^https?://[^/]+') AS h FROM offers) o", "offers",
)
def intake_best_depth(t: Tables):
    """Over hosts instead of URLs, so that single groups are long."""
    rows = t.offers.withColumn("c_href", F.regexp_extract("url", "^https?://[^/]+", 0))
    return intake.best_depth_before(rows).select("seq", "best_before")


@query(
    "intake_capped", "D7",
    f"WITH {_DECIDED} SELECT href, min(seq) AS seq, min(depth) AS depth FROM d WHERE decision IN ('accepted', 'promoted') GROUP BY 1 ORDER BY 2 LIMIT 25",
    "offers",
)
def intake_capped(t: Tables):
    pages = intake.capped_pages(intake.accepted_pages(_decided(t)), 25)
    return pages.select(F.col("c_href").alias("href"), "seq", "depth")


@query("intake_reject_counts", "D12", f"WITH {_DECIDED} SELECT decision AS reason, count(*) AS count FROM d GROUP BY 1", "offers")
def intake_reject_counts(t: Tables):
    return intake.reject_counts(_decided(t)).select("reason", "count")


def _captures(t: Tables):
    """Pages as captures: each asks for its URL and lands on its canonical key; content is its language and size."""
    final = F.concat(F.lit("https://one.example"), F.col("key"))
    href = F.when(F.col("page_id") % 3 == 0, final).otherwise(F.col("url"))
    return t.canon.select(
        F.lit("source").alias("side"), F.col("page_id").alias("seq"), href.alias("href"), final.alias("final_href"),
        F.substring("key", 1, 5).alias("content_hash"),
    )


_CAP = (
    "cap AS (SELECT page_id AS seq, CASE WHEN page_id % 3 = 0 THEN 'https://one.example' || key ELSE url END AS href, 'https://one.example' || key AS "
    "final_href, substr(key, 1, 5) AS content_hash FROM canon)"
)


@query(
    "intake_redirect_aliases", "D9",
    f"WITH {_CAP} SELECT seq, CASE WHEN EXISTS (SELECT 1 FROM cap e WHERE e.seq < c.seq AND (e.href = c.final_href OR (e.final_href = c.final_href AND "
    "e.href <> e.final_href))) THEN 'alias' ELSE 'claims' END AS outcome FROM cap c WHERE href <> final_href", "canon",
)
def intake_redirect_aliases(t: Tables):
    return intake.redirect_aliases(_captures(t)).select("seq", "outcome")


_ALIAS = (
    f"{_CAP}, al AS (SELECT * FROM (SELECT seq, href AS alias, first_value(href) OVER (PARTITION BY content_hash ORDER BY seq) AS alias_of FROM cap) x "
    "WHERE alias <> alias_of)"
)


@query("intake_content_aliases", "D10", f"WITH {_ALIAS} SELECT seq, alias, alias_of FROM al", "canon")
def intake_content_aliases(t: Tables):
    return intake.content_aliases(_captures(t)).select("seq", "alias", "alias_of")


@query(
    "intake_alias_lists", "D11",
    f"WITH {_ALIAS} SELECT alias_of, alias, count(*) OVER (PARTITION BY alias_of) AS aliases FROM al", "canon",
)
def intake_alias_lists(t: Tables):
    return intake.alias_lists(intake.content_aliases(_captures(t))).select("alias_of", "alias", "aliases")


def _attempts(t: Tables):
    errors = F.when(
        F.col("n_errors") > 0, F.transform(F.sequence(F.lit(1), F.col("n_errors").cast("int")), lambda i: F.lit("readiness wait"))
    ).otherwise(F.array().cast("array<string>"))
    return t.derived("attempts").withColumn("errors", errors)


@query(
    "intake_best_attempt", "D13",
    "SELECT path, attempt FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n_errors > 0, CASE WHEN n_errors > 0 THEN n_errors ELSE 0 END, "
    "CASE WHEN n_errors > 0 THEN -content_size ELSE 0 END, attempt) AS k FROM attempts) x WHERE k = 1", "attempts",
)
def intake_best_attempt(t: Tables):
    return intake.best_attempt(_attempts(t)).select("path", "attempt")


@query(
    "intake_crawl_stats", "D12 D14",
    f"WITH {_DECIDED}, g AS (SELECT count(*) AS captured, count(*) FILTER (status NOT BETWEEN 200 AND 299) AS failed, count(*) FILTER (n_errors > 0) AS "
    "slow, count(*) FILTER (attempt > 1) AS retried, max(depth) AS max_depth FROM attempts) SELECT g.*, (SELECT count(*) FROM d WHERE decision = "
    "'duplicate') AS duplicates FROM g", "offers attempts",
)
def intake_crawl_stats(t: Tables):
    return intake.crawl_stats(_attempts(t), _decided(t)).drop("side")


_SLOW = (r"^/fr/8", r"\.html$", r"^/en/")


@query(
    "intake_first_rule", "D15",
    "SELECT page_id, CASE WHEN regexp_matches(key, '^/fr/8') THEN 0 WHEN regexp_matches(key, '\\.html$') THEN 1 WHEN regexp_matches(key, '^/en/') THEN 2 "
    "END AS rule FROM canon", "canon",
)
def intake_first_rule(t: Tables):
    return t.canon.select("page_id", intake.first_rule(F.col("key"), _SLOW).alias("rule"))


@query(
    "graph_reach", "D16",
    f"WITH RECURSIVE page_edges AS ({PORTABLE['page_edges'][1]}), w(path, hops) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 7 UNION SELECT e.dst, w.hops + 1 FROM w JOIN page_edges e ON e.src = "
    "w.path JOIN part p ON p.p_partkey = e.src WHERE w.hops < 3 AND p.p_size <> 5) SELECT path, min(hops) AS hops FROM w GROUP BY 1",
)
def graph_reach(t: Tables):
    seeds = t.part.where(F.col("p_size") == 7).select(F.col("p_partkey").alias("path"))
    followed = t.part.where(F.col("p_size") != 5).select(F.col("p_partkey").alias("path"))
    return graph.reach(t.derived("page_edges"), seeds, 3, followed)


# --- extraction -------------------------------------------------------------------------


# Start tags of each page in order, and the text from each to the next one. Fixed pages: tags nest as the generator writes them.
_TAGS = (
    "tags AS (SELECT page_id, path, unnest(range(len(t)))::INT AS pos, unnest(t) AS open, unnest(s) AS seg FROM (SELECT p.page_id, c.key || '#' || p.page_id AS path, "
    "regexp_extract_all(html, '<[a-z][^>]*>') AS t, string_split_regex(html, '<[a-z][^>]*>')[2:] AS s FROM pages p JOIN canon c ON c.page_id = p.page_id) x), "
    "named AS (SELECT page_id, path, pos, open, regexp_extract(open, '<([a-z0-9]+)', 1) AS tag, replace(replace(replace(replace(replace(replace(replace(regexp_replace(seg, '</[a-z0-9]+>|<!--.*?-->', '', 'g'), "
    "'&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;', '&') AS seg FROM tags), "
    "kept AS (SELECT *, CASE WHEN tag IN ('nav', 'ul', 'li', 'a') THEN 'nav' WHEN tag = 'footer' THEN 'footer' ELSE 'other' END AS region, "
    "lead(tag) OVER w AS next_tag, lead(seg) OVER w AS next_seg, lead(seg, 2) OVER w AS third_seg FROM named WINDOW w AS (PARTITION BY page_id ORDER BY pos))"
)
_HREF = "replace(regexp_extract(open, 'href=\"([^\"]*)\"', 1), '&amp;', '&')"


@query(
    "extract_elements", "B14",
    f"WITH {_TAGS} SELECT path, pos, tag FROM kept WHERE tag NOT IN ('style', 'script', 'div')", "canon",
)
def extract_elements(t: Tables):
    return t.annotated.select("path", "pos", "tag")


@query(
    "extract_nodes", "B1 B2 B3 B4 B12 B15 B16 B21",
    f"WITH {_TAGS} SELECT path, pos + CASE tag WHEN 'a' THEN 2147483648 WHEN 'footer' THEN 1073741824 ELSE 0 END AS pos, region, CASE tag WHEN 'h1' THEN 'heading' WHEN 'a' "
    "THEN 'link' ELSE 'paragraph' END AS kind, CASE WHEN tag = 'p' AND next_tag = 'b' THEN seg || next_seg || chr(10) || third_seg WHEN tag = 'a' THEN trim(seg) ELSE seg END AS text, "
    "CASE tag WHEN 'a' THEN 'ul > li > a' WHEN 'footer' THEN 'footer' ELSE 'article > ' || tag END AS selector_hint, TRUE AS visible, "
    f"CASE tag WHEN 'h1' THEN '{{\"level\":1}}' WHEN 'a' THEN '{{\"href\":' || to_json({_HREF}) || '}}' ELSE '{{}}' END AS attrs FROM kept WHERE tag IN ('h1', 'p', 'a', 'footer')", "canon",
)
def extract_nodes(t: Tables):
    rows = html.raw_nodes(t.annotated, html.page_texts(t.elements))
    return rows.select(
        "path", "pos", "region", "kind", "text", "selector_hint", "visible",
        F.to_json(node_attrs(F.col("kind"))).alias("attrs"),
    )


_GRID = (
    "'<html><body><table><tfoot><tr><td>' || p_size || '</td></tr></tfoot><tbody><tr><td>' || p_brand || '</td><th><span>' || p_type || '</span></th></tr><tr><td>lone' "
    "|| p_partkey || '</td></tr></tbody><thead><tr><th>head</th></tr></thead></table><ul><li>one<ul><li>in</li></ul></li></ul><td>no table</td></body></html>'"
)


@query(
    "extract_cells", "B1 B21",
    "SELECT p_partkey::VARCHAR AS path, kind, row, col, depth, text FROM part, LATERAL (VALUES ('tableCell', 3, 0, NULL, p_size::VARCHAR), ('tableCell', 1, 0, NULL, p_brand), "
    "('tableCell', 1, 1, NULL, p_type), ('tableCell', 2, 0, NULL, 'lone' || p_partkey), ('tableCell', 0, 0, NULL, 'head'), ('listItem', NULL, NULL, 1, 'one' || chr(10) || chr(10) || 'in'), "
    "('tableCell', -1, 2, NULL, 'no table')) v(kind, row, col, depth, text)",
)
def extract_cells(t: Tables):
    """Parts as small tables: the row of a cell counts heads before bodies before feet."""
    pages = t.part.select(F.lit("source").alias("side"), F.col("p_partkey").cast("string").alias("path"), F.expr(_GRID).alias("html"))
    raw = cut_lineage(html.elements(pages))
    rows = html.raw_nodes(cut_lineage(html.kept(html.annotate(raw))), html.page_texts(raw))
    return rows.where(F.col("kind").isin("tableCell", "listItem")).select("path", "kind", "row", "col", "depth", F.trim("text").alias("text"))


@query(
    "extract_headings", "B1",
    f"WITH {_TAGS} SELECT path, {sql.squeeze('seg')} AS text FROM kept WHERE tag = 'h1'", "canon",
)
def extract_headings(t: Tables):
    rows = html.raw_nodes(t.annotated, html.page_texts(t.elements)).where((F.col("kind") == "heading"))
    return rows.select("path", F.trim(F.regexp_replace("text", r"[\s\x{a0}]+", " ")).alias("text"))


@query(
    "extract_links", "B3 B22",
    f"WITH {_TAGS} SELECT path, {_HREF} AS href, count(*) AS n FROM kept WHERE tag = 'a' GROUP BY 1, 2", "canon",
)
def extract_links(t: Tables):
    anchors = t.annotated.where((F.col("tag") == "a") & F.map_contains_key("attrs", "href"))
    return anchors.groupBy("path", F.col("attrs")["href"].alias("href")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "extract_link_records", "B22",
    f"WITH {_TAGS} SELECT path, {_HREF} AS href, 'internal' AS kind, region, TRUE AS visible, trim(regexp_replace(min_by(seg, pos), '\\s+', ' ', 'g')) AS text, min(pos) AS pos "
    "FROM kept WHERE tag = 'a' GROUP BY path, href, region", "canon",
)
def extract_link_records(t: Tables):
    urls = t.page_html.select("side", "path", F.concat(F.lit("https://legacy.example"), "path").alias("page_url"))
    found = html.link_records(t.annotated, html.page_texts(t.elements), urls, ["https://legacy.example"])
    return found.select("path", "href", "kind", "region", "visible", F.trim("text").alias("text"), "pos")


@query("extract_images", "B4 B23")
def extract_images(t: Tables):
    """Images and background images; this crawl shows few, so every link also stands in as one."""
    df = t.annotated
    link = F.col("tag") == "a"
    src = F.concat(F.lit("/img"), F.col("attrs")["href"], F.lit(".0a1b2c3d.png"))
    shown = df.withColumns(
        {
            "attrs": F.when(link, F.create_map(F.lit("src"), src, F.lit("alt"), html.own_text())).otherwise(F.col("attrs")),
            "tag": F.when(link, F.lit("img")).otherwise(F.col("tag")),
        }
    )
    return with_asset_key(html.image_rows(shown), "src").select("path", "pos", "src", "asset_key", "region", "is_background")


_HEAD = (
    "'<link rel=\"canonical\" href=\"' || url || '\"><meta name=\"description\" content=\" About ' || page_id || '\"><meta name=\"description\" content=\"second\">' || "
    "CASE WHEN page_id % 3 = 0 THEN '<meta name=\"robots\" content=\"noindex\">' ELSE '' END || '<meta property=\"og:title\" content=\"T' || page_id % 10 || '\">' || "
    "'<meta property=\"og:description\" content=\"D\"><meta property=\"og:image\" content=\"/i/' || page_id || '.png\"></head>'"
)


@query(
    "extract_meta", "B11",
    f"SELECT c.key || '#' || p.page_id AS path, replace({sql.squeeze('regexp_extract(html, $$(?s)<title>(.*?)</title>$$, 1)')}, '&amp;', '&') AS title, "
    "regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, 'About ' || p.page_id AS description, replace(p.url, '&amp;', '&') AS canonical, CASE WHEN p.page_id % 3 = 0 THEN 'noindex' END AS robots, "
    "'T' || p.page_id % 10 AS og_title, 'D' AS og_description, '/i/' || p.page_id || '.png' AS og_image FROM pages p JOIN canon c ON c.page_id = p.page_id",
    "canon",
)
def extract_meta(t: Tables):
    """Pages with a written head: of two descriptions the first one counts."""
    full = t.page_html.join(t.pages.select("page_id", "url"), "page_id").withColumn("html", F.replace("html", F.lit("</head>"), F.expr(_HEAD)))
    raw = cut_lineage(html.elements(full))
    return html.page_meta(raw, html.page_texts(raw)).drop("side")


@query(
    "extract_regions", "B12",
    f"WITH {_TAGS} SELECT path, pos, region FROM kept WHERE tag NOT IN ('style', 'script', 'div')", "canon",
)
def extract_regions(t: Tables):
    return t.annotated.select("path", "pos", "region")


_NAMES = (
    "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'sc-' WHEN 1 THEN 'site' WHEN 2 THEN 'Top' ELSE '' END || CASE p_partkey % 7 WHEN 0 THEN 'header' "
    "WHEN 1 THEN 'Footer-content' WHEN 2 THEN 'main' WHEN 3 THEN 'domain' WHEN 4 THEN 'sidebar_x' WHEN 5 THEN 'nav' ELSE p_name END AS class, CASE WHEN "
    "p_size % 5 = 0 THEN 'Menu' ELSE '' END AS id FROM part"
)


@query(
    "extract_region_hints", "B13",
    f"SELECT p_partkey, CASE WHEN k = '' THEN NULL " + " ".join(
        f"WHEN regexp_matches(k, '{pattern}') THEN '{region}'" for region, pattern in html.REGION_HINTS
    ) + f" END AS region FROM (SELECT p_partkey, trim(regexp_replace(lower(class || ' ' || id), '[^a-z0-9]+', ' ', 'g')) AS k FROM ({_NAMES}) n) x",
)
def extract_region_hints(t: Tables):
    t.part.createOrReplaceTempView("part")
    rows = t.spark.sql(_NAMES)
    return rows.select("p_partkey", html.region_from_identity(F.col("class"), F.col("id")).alias("region"))


_SHOP_PAGE = (
    "'<html><body><div class=\"card\" itemscope><h2>' || p_name || '</h2><span itemprop=\"price\" content=\"' || cents || '\"></span><meta "
    "itemprop=\"priceCurrency\" content=\"EUR\"><b class=\"cost\">$' || cents || '</b></div><script type=\"application/ld+json\">{\"@graph\": [{\"@type\": "
    "\"Offer\", \"name\": \"' || p_name || '\", \"offers\": {\"@type\": \"Sub\", \"lowPrice\": ' || cents || ', \"priceCurrency\": \"GBP\"}}]}"
    "</script></body></html>'"
)


def _shop_html(t: Tables):
    """Parts as small shop pages with prices in every place a page may hold one."""
    cents = F.format_string("%d.%02d", F.floor(F.col("p_retailprice")).cast("bigint"), F.lit(25))
    df = t.part.select("p_partkey", "p_name", cents.alias("cents"))
    return df.select(
        F.lit("source").alias("side"), F.col("p_partkey").cast("string").alias("path"), F.expr(_SHOP_PAGE).alias("html")
    )


_CENTS = "(floor(p_retailprice)::BIGINT || '.25')"


@query(
    "extract_prices", "B5 B6 B7 B8 B9 B10 B24",
    f"SELECT p_partkey::VARCHAR AS path, s AS source, {_CENTS} AS amount_text, c AS currency FROM part, (VALUES ('jsonld', 'GBP'), ('microdata', 'EUR'), "
    "('selector', 'USD')) v(s, c)",
)
def extract_prices(t: Tables):
    raw = cut_lineage(html.elements(_shop_html(t)))
    df, texts = cut_lineage(html.kept(html.annotate(raw))), html.page_texts(raw)
    found = html.json_ld_prices(raw).unionByName(html.marked_prices(df, texts, (".cost",))).unionByName(html.text_prices(df, texts))
    distinct = assets.dedupe_candidates(found)
    parsed = distinct.withColumn("_p", parse_price(F.col("raw"), F.col("hint"))).where(F.col("_p").isNotNull())
    records = parsed.withColumns({"amount": F.col("_p.amount"), "currency": F.col("_p.currency")}).drop("_p", "hint")
    best = assets.dedupe_prices(records)
    return best.select("path", "source", F.format_string("%.2f", "amount").alias("amount_text"), "currency")


@query(
    "extract_text_prices", "B8",
    "SELECT doc_id, list_transform(regexp_extract_all(t, '\\$\\s?\\d[\\d.,\\s]*|\\d[\\d.,\\s]*\\s?\\$'), lambda m: trim(regexp_replace(m, '[\\n\\t\\r]+', "
    "' ', 'g')))[1] AS first, len(regexp_extract_all(t, '\\$\\s?\\d[\\d.,\\s]*|\\d[\\d.,\\s]*\\s?\\$'))::BIGINT AS n FROM (SELECT doc_id, "
    "regexp_replace(text, '[£€¥A-Z]', '', 'g') || ' only $' || doc_id || '.50 or 7 $ now' AS t FROM documents) d",
)
def extract_text_prices(t: Tables):
    text = F.concat(
        F.regexp_replace("text", "[£€¥A-Z]", ""), F.lit(" only $"), F.col("doc_id").cast("string"), F.lit(".50 or 7 $ now")
    )
    hits = t.documents.select("doc_id", scan_currency(text).alias("hits"))
    first = F.regexp_replace(F.get("hits", F.lit(0)), r"[\n\t\r]+", " ")
    return hits.select("doc_id", first.alias("first"), F.size("hits").cast("bigint").alias("n"))


@query(
    "extract_price_candidates", "B10",
    "SELECT raw, context, source, min(pos)::INT AS pos FROM (SELECT event_type AS raw, props AS context, 'text' AS source, event_id AS pos FROM events) x "
    "GROUP BY 1, 2, 3",
)
def extract_price_candidates(t: Tables):
    raw = t.events.select(
        F.lit("source").alias("side"), F.lit("/p").alias("path"), F.col("event_type").alias("raw"),
        F.col("props").alias("context"), F.lit("text").alias("source"), F.col("event_id").cast("int").alias("pos"),
    )
    return assets.dedupe_candidates(raw).select("raw", "context", "source", "pos")


@query(
    "extract_price_records", "B24",
    "WITH x AS (SELECT (value::INT)::DOUBLE AS amount, props AS context, CASE event_id % 4 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'microdata' WHEN 2 THEN "
    "'selector' ELSE 'text' END AS source, event_id % 4 AS r, event_id AS pos FROM (SELECT *, floor(value) AS v FROM events) e), y AS (SELECT *, "
    "min(pos) OVER (PARTITION BY amount, context) AS first, row_number() OVER (PARTITION BY amount, context ORDER BY r, pos) AS k FROM (SELECT * REPLACE "
    "(amount AS amount) FROM x) z) SELECT amount, context, source, first::INT AS pos FROM y WHERE k = 1".replace("(value::INT)::DOUBLE", "v::DOUBLE"),
)
def extract_price_records(t: Tables):
    place = F.element_at(
        F.array(*[F.lit(s) for s in ("jsonld", "microdata", "selector", "text")]), (F.col("event_id") % 4 + 1).cast("int")
    )
    rows = t.events.select(
        F.lit("source").alias("side"), F.lit("/p").alias("path"), F.floor("value").cast("double").alias("amount"),
        F.lit(None).cast("string").alias("currency"), F.col("props").alias("context"), place.alias("source"),
        F.col("event_id").cast("int").alias("pos"),
    )
    return assets.dedupe_prices(rows).select("amount", "context", "source", "pos")


@query(
    "extract_ordinals", "B19",
    "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS ordinal FROM events",
)
def extract_ordinals(t: Tables):
    """Five groups hold every row: the numbering runs in chunks of a thousand positions."""
    return occurrence(t.events, ["event_type"], "event_id", "ordinal", chunk=1000).select("event_id", "ordinal")


# --- stream -----------------------------------------------------------------------------


@query("stream_offers", "N1", f"WITH {_DECIDED} SELECT seq, decision FROM d WHERE reject IS NULL", "offers")
def stream_offers(t: Tables):
    """Admitted offers replayed as a stream; the verdicts equal the batch ones."""
    admitted = _classified(t).where(F.col("reject").isNull()).select("side", "c_href", "seq", "depth")
    place = scratch(t, "offers")
    admitted.write.parquet(place)
    stream = t.spark.readStream.schema(admitted.schema).parquet(place)
    out, check = scratch(t, "decided"), scratch(t, "decided-state")
    return streaming.decide_stream(stream, _RULES.max_depth, out, check).select("seq", "decision")


@query(
    "stream_content_aliases", "N1",
    "SELECT page_id AS seq, url AS href, first_value(url) OVER (PARTITION BY sha1(html) ORDER BY page_id) AS f, CASE WHEN url <> first_value(url) OVER "
    "(PARTITION BY sha1(html) ORDER BY page_id) THEN first_value(url) OVER (PARTITION BY sha1(html) ORDER BY page_id) END AS alias_of FROM pages",
)
def stream_content_aliases(t: Tables):
    stream = streaming.pages_as_captures(t.spark, t.dir, t.pages.schema)
    rows = streaming.capture_stream(stream, scratch(t, "aliases"), scratch(t, "aliases-state"))
    return rows.select("seq", "href", F.coalesce("alias_of", "href").alias("f"), "alias_of")


@query(
    "stream_redirects", "N1",
    f"WITH {_ALIAS} SELECT c.seq, c.href, CASE WHEN c.href = c.final_href THEN NULL WHEN EXISTS (SELECT 1 FROM cap e WHERE e.seq < c.seq AND (e.href = c.final_href "
    "OR (e.final_href = c.final_href AND e.href <> e.final_href))) THEN 'alias' ELSE 'claims' END AS outcome, alias_of FROM cap c LEFT JOIN al ON al.seq = c.seq", "canon",
)
def stream_redirects(t: Tables):
    """Captures that arrive in four batches: redirect and content aliases equal those of the whole table."""
    captures, place = _captures(t), scratch(t, "captures")
    ends = captures.agg(F.percentile_approx("seq", [0.25, 0.5, 0.75]).alias("e")).first()["e"]
    for low, high in zip([None, *ends], [*ends, None]):
        # A file a batch, read by age.
        after = F.lit(True) if low is None else F.col("seq") > low
        captures.where(after & (F.lit(True) if high is None else F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(place)
    stream = t.spark.readStream.schema(captures.schema).option("maxFilesPerTrigger", 1).parquet(place)
    return streaming.capture_stream(stream, scratch(t, "redirects"), scratch(t, "redirects-state")).select("seq", "href", "outcome", "alias_of")
