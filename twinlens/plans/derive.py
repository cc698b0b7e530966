"""Two-sided inputs derived from the given tables.

The given tables hold one site, so the second side, styles, prices, probes and stored runs
are derived from them, row by row and over every row. Remainders of ids plant differences;
nothing is filtered to make a check cheaper. Each derivation is one SQL text that Spark
and a second engine read alike, so both start from the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.functions.images import with_asset_key
from twinlens.functions.prices import parse_price
from twinlens.functions.urls import canonicalize
from twinlens.operators.content import assemble_nodes
from twinlens.operators.findings import CATEGORIES, COLUMNS, finding_id
from twinlens.operators.styles import overflows
from twinlens.session import cut_lineage, dealt, parts_of, spread, spread_thin
from twinlens.sources.html import annotate, elements, kept, resolve_links
from twinlens.sources.snapshots import path_slug

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TEXT_TABLES = ("documents", "pages", "conversations")
# A narrow table that many rows are derived from: pages, images, prices, and styles at every viewport.
GROWN = ("part",)
VIEWPORTS = {"desktop": 1440, "tablet": 768, "mobile-md": 390, "mobile-sm": 360}


def _case(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


_NAME = "replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS STRING)"
_SHOP = "'/shop/' || CAST(CAST(floor(p_partkey / 8.0) AS BIGINT) AS STRING)"
_CENTS = "CAST(round(p_retailprice * 100) AS BIGINT)"
_HOST = "'https://' || CASE WHEN page_id % 2 = 0 THEN 'www' ELSE 'm' END || '.legacy.example'"


def _money(cents: str, thousands: str, point: str) -> str:
    whole = f"CAST(floor({cents} / 100.0) AS BIGINT)"
    head = f"CAST(CAST(floor({whole} / 1000.0) AS BIGINT) AS STRING) || '{thousands}'"
    return (
        f"CASE WHEN {whole} >= 1000 THEN {head} || lpad(CAST({whole} % 1000 AS STRING), 3, '0') "
        f"ELSE CAST({whole} AS STRING) END || '{point}' || lpad(CAST({cents} % 100 AS STRING), 2, '0')"
    )


def _image(side: str) -> str:
    if side == "source":
        src = f"'https://cdn.legacy.example/-/media/root/' || {_NAME} || '.jpg?h=400&w=800'"
        alt, width, keep = "p_name", "100 + p_size * 10", "p_partkey % 11 <> 3"
    else:
        name = f"CASE WHEN p_partkey % 19 = 7 THEN 'new-' ELSE '' END || {_NAME}"
        src = (
            f"CASE p_partkey % 3 WHEN 0 THEN 'https://www.new.example/_next/image?url=%2Fimg%2F' || {name} "
            f"|| '.a1b2c3d4e5.webp&w=828' WHEN 1 THEN 'https://res.new.example/upload/w_300,c_fill/' || {name} "
            f"|| '.png' ELSE '/assets/' || {name} || '.WEBP' END"
        )
        alt = "CASE WHEN p_partkey % 23 = 4 THEN p_name || ' photo' ELSE p_name END"
        width = "CASE WHEN p_partkey % 29 = 3 THEN 2 ELSE 1 END * (100 + p_size * 10)"
        keep = "p_partkey % 11 <> 5"
    where = "" if side == "source" else " WHERE p_partkey % 13 <> 5"
    return (
        f"SELECT '{side}' AS side, {_SHOP} AS path, CAST(p_partkey % 8 AS INT) AS pos, {src} AS src, {alt} AS alt, "
        f"CAST({width} AS INT) AS natural_width, CAST(50 + p_size * 5 AS INT) AS natural_height, "
        "CASE WHEN p_partkey % 8 < 1 THEN 'header' ELSE 'main' END AS region, "
        f"{keep} AS visible FROM part{where}"
    )


def _price(side: str) -> str:
    context = "p_name || ' ' || p_brand || ' no ' || CAST(p_partkey AS STRING)"
    if side == "source":
        raw, where = f"'$' || {_money(_CENTS, ',', '.')}", ""
    else:
        cents = f"({_CENTS} + CASE WHEN p_partkey % 17 = 2 THEN 10000 ELSE 0 END)"
        raw = (
            f"CASE WHEN p_partkey % 31 = 6 THEN 'EUR ' ELSE 'USD ' END || CASE p_partkey % 2 WHEN 0 THEN "
            f"{_money(cents, '.', ',')} ELSE {_money(cents, ' ', ',')} END"
        )
        where = " WHERE p_partkey % 37 <> 11"
    return (
        f"SELECT '{side}' AS side, {_SHOP} AS path, CAST(p_partkey % 8 AS INT) AS pos, {raw} AS raw, "
        "CASE WHEN p_partkey % 5 = 0 THEN 'jsonld' WHEN p_partkey % 5 = 1 THEN 'microdata' ELSE 'text' END AS source, "
        f"'main' AS region, {context} AS context, CAST(NULL AS STRING) AS hint FROM part{where}"
    )


# The style columns below become one property map per node.
STYLE_PROPERTIES = {
    "color": ("'rgb(26, 29, ' || CAST(p_size % 50 AS STRING) || ')'",
              "CASE WHEN p_partkey % 7 = 0 THEN '#1a1d21' WHEN p_partkey % 7 = 1 THEN 'rgb(200, 29, 33)' "
              "ELSE 'rgba(26, 29, ' || CAST(p_size % 50 AS STRING) || ', 1)' END"),
    "font-size": ("CAST(10 + p_size % 30 AS STRING) || 'px'",
                  "CAST(10 + p_size % 30 + CASE WHEN p_partkey % 9 = 2 THEN 4 ELSE 0 END AS STRING) || '.2px'"),
    "font-family": ("'\"Helvetica Neue\", Arial'",
                    "CASE WHEN p_partkey % 5 = 0 THEN 'Helvetica Neue, sans-serif' WHEN p_partkey % 5 = 1 "
                    "THEN 'Georgia, serif' ELSE 'helvetica neue , Arial' END"),
    "margin-top": ("CASE WHEN p_partkey % 4 = 0 THEN 'auto' ELSE CAST(p_size AS STRING) || 'px' END",
                   "CAST(p_size + p_partkey % 6 AS STRING) || 'px'"),
    "display": ("'block'", "CASE WHEN p_partkey % 8 = 3 THEN 'FLEX' ELSE ' block ' END"),
    "box-shadow": ("'0 1px 2px #000000'",
                   "CASE WHEN p_partkey % 10 = 4 THEN '0 3px 2px rgb(0, 0, 0)' WHEN p_partkey % 10 = 5 "
                   "THEN '0 1px 2px #ff0000' ELSE '0  1px 2px rgb(0,0,0)' END"),
}
STYLE_COLUMNS = {p: "css_" + p.replace("-", "_") for p in STYLE_PROPERTIES}
_STYLE_KEY = "sha1('text:' || p_name || ' ' || CAST(p_partkey AS STRING))"


def _style(side: str, viewport: str) -> str:
    at = list(VIEWPORTS).index(viewport)
    i = 0 if side == "source" else 1
    props = ", ".join(f"{STYLE_PROPERTIES[p][i]} AS {c}" for p, c in STYLE_COLUMNS.items())
    shift = "0" if side == "source" else f"CASE WHEN p_partkey % 12 = 1 THEN {at + 1} * 20 ELSE 1 END"
    hidden = {
        "source": f"p_partkey % 41 = 3 AND {at} > 1",
        "target": f"p_partkey % 43 = 4 OR (p_partkey % 47 = 5 AND {at} = 3)",
    }[side]
    return (
        f"SELECT '{side}' AS side, {_SHOP} AS path, '{viewport}' AS viewport, CAST(p_partkey % 8 AS INT) AS pos, "
        f"'main' AS region, {_STYLE_KEY} AS key, CAST(0 AS BIGINT) AS ordinal, {props}, "
        f"CAST(p_size + {shift} AS DOUBLE) AS x, CAST(p_size * 3 AS DOUBLE) AS y, "
        f"CAST(100 + p_size + 2 * ({shift}) AS DOUBLE) AS width, CAST(20 + p_size % 9 AS DOUBLE) AS height, "
        f"NOT ({hidden}) AS visible FROM part"
    )


def _capture(side: str, viewport: str, width: int) -> str:
    extra = "0" if side == "source" else f"CASE WHEN CAST(floor(p_partkey / 8.0) AS BIGINT) % 9 = 2 THEN 40 ELSE 1 END"
    return (
        f"SELECT DISTINCT '{side}' AS side, {_SHOP} AS path, '{viewport}' AS viewport, {width} AS width, "
        f"{width} + {extra} AS document_width FROM part"
    )


_CATEGORY_CASE = _case("event_id % 29", list(CATEGORIES))
_SEVERITY_CASE = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in CATEGORIES.items()) + " END"
_VIEW_CASE = _case("event_id % 4", list(VIEWPORTS))
_REGION_CASE = _case("event_id % 7", ["header", "nav", "main", "footer", "aside", "other"])
_PROP_CASE = _case("event_id % 5", ["color", "font-size", "box-shadow", "cursor", "margin-top"])


def _findings(run: str) -> str:
    """A stored run's findings, one per event of the table."""
    drop = {"baseline": 1, "current": 2}[run]
    severity = "base_severity"
    actual = "'\"' || event_type || '-' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || '\"'"
    if run == "current":
        severity = (
            "CASE WHEN event_id % 10 = 3 THEN CASE base_severity WHEN 'error' THEN 'warning' ELSE 'error' END "
            "ELSE base_severity END"
        )
        actual = f"CASE WHEN event_id % 10 = 4 THEN '\"moved\"' ELSE {actual} END"
    box = lambda dx: (
        f"CAST(event_id % 300 + {dx} AS DOUBLE)", "CAST(event_id % 500 AS DOUBLE)",
        "CAST(event_id % 40 AS DOUBLE)", "CAST(event_id % 25 + 1 AS DOUBLE)",
    )
    boxed = ", ".join(
        [f"CASE WHEN event_id % 3 <> 0 THEN {v} END AS s{n}" for n, v in zip("xywh", box("0"), strict=True)]
        + [f"CASE WHEN event_id % 4 <> 0 THEN {v} END AS t{n}" for n, v in zip("xywh", box("event_id % 11"), strict=True)]
    )
    return f"""
SELECT '{run}' AS run_id, event_id, category, {severity} AS severity,
  '/u/' || CAST(user_id AS STRING) AS path, event_type || ' at ' || CAST(user_id AS STRING) AS label,
  CAST(CASE WHEN event_id % 6 = 5 THEN 0.75 ELSE 1 END AS DOUBLE) AS confidence,
  'https://legacy.example/u/' || CAST(user_id AS STRING) || CASE WHEN event_id % 8 = 7 THEN '#a' ELSE '' END AS source_url,
  'https://new.example/u/' || CAST(user_id AS STRING) AS target_url,
  CASE WHEN category LIKE 'css.%' AND category <> 'css.visibility-drift' THEN {_VIEW_CASE} END AS viewport,
  {_REGION_CASE} AS region,
  CASE event_id % 3 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' END AS node_kind,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'el-' || CAST(event_id % 50 AS STRING) END AS subject,
  CASE WHEN category = 'css.property-drift' THEN {_PROP_CASE} END AS facet,
  '"' || event_type || ' seen (' || CAST(event_id % 100 AS STRING) || ')!"' AS expected_json,
  {actual} AS actual_json,
  CASE WHEN category LIKE 'css.%' THEN CAST(event_id % 13 AS DOUBLE) / 4 END AS magnitude,
  event_id % 6 = 5 AS low_confidence, user_id % 20 = 3 AS orphan_page, {boxed}
FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN 'info' ELSE {_SEVERITY_CASE} END AS base_severity
      FROM (SELECT *, {_CATEGORY_CASE} AS category FROM events) c) e
WHERE event_id % 10 <> {drop}"""


def _page(side: str) -> str:
    """Page index rows keyed by `key`, the canonical key of `canon`."""
    if side == "source":
        return (
            "SELECT 'source' AS side, key AS path, 'https://legacy.example' || key AS url, "
            "CAST(CASE WHEN page_id % 31 = 5 THEN 500 ELSE 200 END AS INT) AS status, "
            "CASE WHEN page_id % 26 = 0 THEN 1 ELSE 0 END AS hops, CAST(page_id % 4 AS INT) AS depth, "
            "page_id % 7 = 2 AS slow_capture, page_id FROM first_pages"
        )
    return (
        "SELECT 'target' AS side, key AS path, 'https://new.example' || key AS url, "
        "CAST(CASE WHEN page_id % 29 = 0 THEN 404 ELSE 200 END AS INT) AS status, "
        "CASE WHEN page_id % 13 = 0 THEN 2 ELSE 0 END AS hops, CAST(page_id % 4 AS INT) AS depth, "
        "page_id % 9 = 4 AS slow_capture, page_id FROM first_pages WHERE page_id % 17 <> 0 "
        "UNION ALL SELECT 'target', '/new' || key, 'https://new.example/new' || key, CAST(200 AS INT), 0, "
        "CAST(1 AS INT), page_id % 9 = 4, page_id FROM first_pages WHERE page_id % 41 = 3"
    )


_FEE = "CASE WHEN (doc_id + pos) % 17 = 7 THEN "
# Lines of documents are ordered nodes of pages: `lines(doc_id, pos, line)` differs per engine.
_KIND = (
    "CASE WHEN pos = 0 THEN 'heading' WHEN pos % 5 = 1 THEN 'listItem' WHEN pos % 5 = 2 THEN 'tableCell' "
    "ELSE 'paragraph' END"
)
_REGION = "CASE WHEN pos = 0 THEN 'header' WHEN pos % 9 = 8 THEN 'aside' ELSE 'main' END"

PORTABLE: dict[str, tuple[tuple[str, ...], str]] = {
    "images": ((), " UNION ALL ".join(_image(s) for s in ("source", "target"))),
    "prices": ((), " UNION ALL ".join(_price(s) for s in ("source", "target"))),
    "styles": ((), " UNION ALL ".join(_style(s, v) for s in ("source", "target") for v in VIEWPORTS)),
    "captures": ((), " UNION ALL ".join(_capture(s, v, w) for s in ("source", "target") for v, w in VIEWPORTS.items())),
    "findings_baseline": ((), _findings("baseline")),
    "findings_current": ((), _findings("current")),
    "first_pages": (("canon",), "SELECT key, min(page_id) AS page_id FROM canon GROUP BY key"),
    "page_rows": (("first_pages",), _page("source") + " UNION ALL " + _page("target")),
    "aliases": (
        ("canon", "first_pages"),
        "SELECT c.key AS path, c.url AS alias, c.page_id FROM canon c JOIN first_pages f ON c.key = f.key "
        "WHERE c.page_id <> f.page_id",
    ),
    "raw_nodes": (
        ("lines",),
        "SELECT 'source' AS side, '/doc/' || CAST(doc_id AS STRING) AS path, pos * 2 AS pos, "
        f"{_REGION} AS region, {_KIND} AS kind, "
        f"{_FEE}line || ' You must pay $45.00 within 14 days, not later.' ELSE line END AS text FROM lines "
        "UNION ALL SELECT 'target', '/doc/' || CAST(doc_id AS STRING), pos * 2, "
        f"{_REGION}, CASE WHEN pos % 5 = 1 THEN 'paragraph' ELSE {_KIND} END, "
        f"{_FEE}line || ' You should pay $49.99 within 30 days.' "
        "WHEN (doc_id + pos) % 13 = 5 THEN replace(line, 'the ', 'that ') || ' Indeed.' ELSE line END "
        "FROM lines WHERE (doc_id + pos) % 11 <> 3 "
        "UNION ALL SELECT 'target', '/doc/' || CAST(doc_id AS STRING), pos * 2 + 1, 'main', 'paragraph', "
        "'Inserted note ' || CAST(pos AS STRING) FROM lines WHERE (doc_id + pos) % 19 = 6",
    ),
    "runs": (
        (),
        "SELECT run_id, started_at, source_base_url, target_base_url, views, schema_version FROM ("
        "SELECT substring(CAST(o_orderdate AS STRING), 1, 10) || 'T00-00-00-000' AS run_id, "
        "CASE WHEN min(o_custkey) % 11 = 0 THEN NULL ELSE min(o_orderdate) END AS started_at, "
        "CASE WHEN min(o_custkey) % 3 = 0 THEN 'https://old.example' ELSE 'https://legacy.example' END AS source_base_url, "
        "CASE WHEN min(o_custkey) % 4 = 0 THEN 'https://stage.example' ELSE 'https://new.example' END AS target_base_url, "
        "CASE WHEN min(o_custkey) % 5 = 0 THEN 'desktop' ELSE 'mobile-sm,desktop' END AS views, "
        "CAST(CASE WHEN min(o_custkey) % 13 = 0 THEN 0 ELSE 1 END AS INT) AS schema_version "
        "FROM orders GROUP BY substring(CAST(o_orderdate AS STRING), 1, 10)) r",
    ),
    "attempts": (
        (),
        "SELECT 'source' AS side, '/u/' || CAST(user_id AS STRING) AS path, event_id AS attempt, "
        "CASE WHEN user_id % 3 = 0 THEN 1 + event_id % 4 ELSE event_id % 5 END AS n_errors, "
        "CAST(floor(value * 100) AS BIGINT) AS content_size, "
        "CAST(CASE WHEN event_id % 23 = 0 THEN 500 ELSE 200 END AS INT) AS status, CAST(user_id % 3 AS INT) AS depth "
        "FROM events",
    ),
    "page_edges": (
        (),
        "SELECT p_partkey AS src, (p_partkey * 2 + p_size) % (SELECT count(*) FROM part) AS dst FROM part "
        "UNION ALL SELECT p_partkey, (p_partkey * 3 + 1) % (SELECT count(*) FROM part) FROM part",
    ),
    "sitedocs": (
        (),
        "SELECT host, 'https://' || host || '/sitemap-' || CAST(page_id AS STRING) || '.xml' AS doc_url, "
        "'sitemap' AS kind, '<?xml version=\"1.0\"?><sm:urlset xmlns:sm=\"x\"><sm:url><sm:loc> ' || replace(url, '&', '&amp;') "
        "|| ' </sm:loc></sm:url><sm:url><sm:loc>not a url</sm:loc></sm:url></sm:urlset><!-- ' || host || ' -->' AS body, "
        "page_id FROM page_hosts "
        "UNION ALL SELECT host, 'https://' || host || '/index-' || CAST(page_id AS STRING) || '.xml', 'sitemap', "
        "'<sitemapindex><sitemap><loc>https://' || host || '/sitemap-' || CAST(page_id AS STRING) || "
        "'.xml</loc></sitemap></sitemapindex>', page_id FROM page_hosts "
        "UNION ALL SELECT host, 'https://' || host || '/robots.txt', 'robots', "
        "'User-agent: *' || chr(10) || 'Disallow: /fr/ # french' || chr(10) || 'Allow: /fr/8' || chr(10) || "
        "'Disallow: /*.html$' || chr(10) || 'Crawl-delay: 1.5' || chr(10) || 'Sitemap: https://' || host || '/index-' || "
        "CAST(min(page_id) AS STRING) || '.xml' || chr(10) || 'User-agent: parity' || chr(10) || 'Disallow: /de/' || "
        "chr(13) || chr(10) || 'Allow: /de/*5' || chr(10) || 'Crawl-delay: 3', min(page_id) FROM page_hosts GROUP BY host",
    ),
}
PORTABLE["sitedocs"] = (("page_hosts",), PORTABLE["sitedocs"][1])


def with_tables(name: str, special: dict[str, tuple[tuple[str, ...], str]]) -> list[tuple[str, str]]:
    """The derivation of `name` and everything it needs, in order of use."""
    known = PORTABLE | special
    out: list[tuple[str, str]] = []

    def visit(n: str) -> None:
        if n in known and n not in [x for x, _ in out]:
            needs, sql = known[n]
            for need in needs:
                visit(need)
            out.append((n, sql))

    visit(name)
    return out


class Tables:
    """The given tables and what is derived from them, for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self._loaded: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._loaded:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            self._loaded[name] = spread(df) if name in TEXT_TABLES else spread_thin(df) if name in GROWN else df
        return self._loaded[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        raise AttributeError(name)

    def derived(self, name: str) -> DataFrame:
        """Run a shared derivation; its inputs are registered under their own names first."""
        special = {"canon": lambda: self.canon, "lines": self._lines, "page_hosts": self._page_hosts}
        text = []
        for part, sql in with_tables(name, {k: ((), "") for k in special}):
            if part in special:
                special[part]().createOrReplaceTempView(part)
            else:
                text.append(f"{part} AS ({sql})")
        whole = f"WITH {', '.join(text)} SELECT * FROM {name}"
        for table in set(re.findall(r"\b(?:FROM|JOIN) (\w+)", whole)) & set(BASE):
            self.base(table).createOrReplaceTempView(table)
        return self.spark.sql(whole)

    @cached_property
    def canon(self) -> DataFrame:
        """Canonical key of every page. Captured tables carry it, so it is computed once here too."""
        keyed = canonicalize(self.pages, "url")
        return cut_lineage(keyed.select("page_id", "url", F.col("c_key").alias("key")))

    @cached_property
    def page_parts(self) -> int:
        """In how many parts nodes, and what is made of them, are stored by page."""
        return parts_of(self.documents)

    def _lines(self) -> DataFrame:
        # Dealt by the page its lines go to, a document is shuffled once, and its nodes are not. The condition holds always;
        # conditions on ids are not pushed past it, so the readers of the lines share one shuffle.
        page = F.concat(F.lit("/doc/"), F.col("doc_id").cast("string"))
        documents = self.documents.repartition(self.page_parts, page).where(F.monotonically_increasing_id() >= 0)
        return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
            "doc_id", F.col("pos").cast("bigint").alias("pos"), "line"
        )

    def _page_hosts(self) -> DataFrame:
        return self.pages.select("page_id", "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))

    @cached_property
    def page_rows(self) -> DataFrame:
        """Page index of both sides: redirect chains and alias lists built from the derived rows."""
        rows = self.derived("page_rows")
        hop = F.struct(F.concat("url", F.lit("?hop")).alias("url"), F.lit(301).alias("status"))
        chain = F.when(F.col("hops") > 0, F.array_repeat(hop, F.col("hops"))).otherwise(
            F.array().cast("array<struct<url:string,status:int>>")
        )
        aliases = self.derived("aliases").groupBy("path").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
        out = rows.join(aliases, "path", "left").select(
            "side", "path", "url", "status", chain.alias("redirect_chain"),
            F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "depth", "slow_capture", "page_id",
        )
        return cut_lineage(out)

    def index(self, side: str) -> DataFrame:
        return self.page_rows.where(F.col("side") == side).drop("side", "page_id")

    @cached_property
    def styles(self) -> DataFrame:
        """Style rows with the property map and box of the snapshot form."""
        rows = self.derived("styles")
        props = F.create_map(*[x for p, c in STYLE_COLUMNS.items() for x in (F.lit(p), F.col(c))])
        return rows.select(
            "side", "path", "viewport", "pos", "region", "key", "ordinal", props.alias("props"),
            F.struct("x", "y", "width", "height").alias("box"), "visible",
        ).transform(cut_lineage)

    @cached_property
    def captures(self) -> DataFrame:
        rows = self.derived("captures")
        return rows.withColumn("has_horizontal_overflow", overflows(F.col("document_width"), F.col("width")))

    @staticmethod
    def shop_key() -> Column:
        return F.sha1(F.concat(F.lit("text:"), "p_name", F.lit(" "), F.col("p_partkey").cast("string")))

    @cached_property
    def style_pairs(self) -> DataFrame:
        """Content pairs of the styled nodes: every part is one node on both sides."""
        node = F.struct(
            self.shop_key().alias("key"),
            F.lit(0).cast("bigint").alias("ordinal"), F.lit("paragraph").alias("kind"), F.col("p_name").alias("text"),
            F.lit(None).cast("string").alias("alt"), F.lit(None).cast("string").alias("selector_hint"),
        )
        path = F.concat(F.lit("/shop/"), F.floor(F.col("p_partkey") / 8).cast("bigint").cast("string"))
        return self.part.select(
            path.alias("path"), F.lit("main").alias("region"), node.alias("source"), node.alias("target"),
            F.lit(1.0).alias("confidence"), F.concat(F.lit("https://legacy.example"), path).alias("source_url"),
            F.concat(F.lit("https://new.example"), path).alias("target_url"),
        )

    @cached_property
    def images(self) -> DataFrame:
        box = F.lit(None).cast("struct<x:double,y:double,width:double,height:double>")
        return cut_lineage(with_asset_key(self.derived("images").withColumn("box", box), "src"))

    @cached_property
    def prices(self) -> DataFrame:
        box = F.lit(None).cast("struct<x:double,y:double,width:double,height:double>")
        parsed = self.derived("prices").withColumn("_p", parse_price(F.col("raw"), F.col("hint")))
        return cut_lineage(
            parsed.where(F.col("_p").isNotNull()).select(
                "side", "path", "pos", F.col("_p.amount").alias("amount"), F.col("_p.currency").alias("currency"),
                "raw", "source", "region", "context", box.alias("box"),
            )
        )

    @cached_property
    def nodes(self) -> DataFrame:
        raw = self.derived("raw_nodes")
        blank = {c: F.lit(None).cast("string") for c in ("href", "link_path", "src", "alt", "selector_hint")}
        level = F.when(F.col("kind") == "heading", F.lit(1)).cast("int")
        return assemble_nodes(raw.withColumns(blank | {"level": level}), parts=self.page_parts)

    def findings(self, run: str = "current") -> DataFrame:
        """A stored run's findings on the full schema."""
        rows = self.derived(f"findings_{run}")
        identity = [F.col(c) for c in ("category", "path", "viewport", "region", "node_kind", "subject", "facet")]
        rows = rows.withColumns(
            {
                "id": finding_id(*identity),
                "source_box": F.when(
                    F.col("sx").isNotNull(),
                    F.struct(*[F.col(f"s{a}").alias(b) for a, b in zip("xywh", ("x", "y", "width", "height"), strict=True)]),
                ),
                "target_box": F.when(
                    F.col("tx").isNotNull(),
                    F.struct(*[F.col(f"t{a}").alias(b) for a, b in zip("xywh", ("x", "y", "width", "height"), strict=True)]),
                ),
            }
        )
        present = set(rows.columns)
        return rows.select(
            "run_id", "event_id",
            *[(F.col(c) if c in present else F.lit(None)).cast(k).alias(c) for c, k in COLUMNS.items()],
        )

    @cached_property
    def links(self) -> DataFrame:
        """Link occurrences: every href of every page, plus page-to-page links, on both sides.

        Target pages lose some links and keep the rest.
        """
        pages = self.derived("first_pages").join(self.pages.select("page_id", "html"), "page_id")
        hrefs = pages.select(
            "page_id", "key", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href")
        )
        keys = self.derived("first_pages").select(F.col("page_id").alias("dst"), F.col("key").alias("dst_key"))
        hops = pages.select(
            "page_id", "key",
            F.posexplode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 3 + 2, F.floor(F.col("page_id") / 3))).alias("pos", "dst"),
        ).join(keys, "dst")
        hops = hops.select("page_id", "key", (F.col("pos") + 1000).alias("pos"), F.col("dst_key").alias("href"))
        outside = pages.select(
            "page_id", "key", F.lit(2000).alias("pos"),
            F.concat(F.lit("http://partner.example/"), (F.col("page_id") % 50).cast("string")).alias("href"),
        )
        rows = hrefs.unionByName(hops).unionByName(outside)
        both = rows.withColumn("side", F.lit("source")).unionByName(
            rows.where((F.col("page_id") + F.col("pos")) % 6 != 2).withColumn("side", F.lit("target"))
        )
        host = F.when(F.col("side") == "source", F.lit("https://legacy.example")).otherwise(F.lit("https://new.example"))
        both = both.select(
            "side", F.col("key").alias("path"), F.concat(host, "key").alias("page_url"), path_slug(F.col("key")).alias("slug"),
            "pos", "href", F.concat(F.lit("to "), "href").alias("text"),
            F.when(F.col("pos") < 1000, F.lit("nav")).otherwise(F.lit("main")).alias("region"),
            ((F.col("page_id") + F.col("pos")) % 5 != 4).alias("visible"),
        )
        return cut_lineage(resolve_links(both, ["https://legacy.example", "https://new.example"]))

    def probes(self, to_check: DataFrame) -> DataFrame:
        """Probe results of destinations, by the length of their URL: broken, failed, redirected or fine."""
        n = F.length("resolved") % 7
        status = F.when(n == 0, 404).when(n == 1, 0).when(n == 2, 405).otherwise(200)
        head = to_check.select(
            F.col("resolved").alias("url"), F.lit("HEAD").alias("method"), status.alias("status"),
            F.when(n == 3, 1).otherwise(0).alias("redirect_count"),
            F.when(n == 3, F.concat("resolved", F.lit("/final"))).alias("final_url"),
            F.when(n == 1, F.lit("timeout")).alias("reason"),
        )
        got = to_check.where(n == 2).select(
            F.col("resolved").alias("url"), F.lit("GET").alias("method"), F.lit(200).alias("status"),
            F.lit(0).alias("redirect_count"), F.lit(None).cast("string").alias("final_url"),
            F.lit(None).cast("string").alias("reason"),
        )
        return head.unionByName(got)

    @cached_property
    def offers(self) -> DataFrame:
        """Offered URLs by arrival: every page's own URL, then every link it holds."""
        own = self.pages.select(
            F.lit("source").alias("side"), (F.col("page_id") * 1000).alias("seq"), "url",
            (F.col("page_id") % 4).cast("int").alias("depth"),
        )
        links = self.pages.select(
            "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href")
        )
        base = F.regexp_extract("url", "^https?://[^/]+", 0)
        found = links.select(
            F.lit("source").alias("side"), (F.col("page_id") * 1000 + F.col("pos") + 1).alias("seq"),
            F.concat(base, "href").alias("url"), (F.col("page_id") % 4 + 1).cast("int").alias("depth"),
        )
        return own.unionByName(found)

    @cached_property
    def page_html(self) -> DataFrame:
        """Every row of the pages, repeats of a key too: the path names the key and the page."""
        path = F.concat("key", F.lit("#"), F.col("page_id").cast("string"))
        return self.canon.select("page_id", "key").join(self.pages.select("page_id", "html"), "page_id").select(F.lit("source").alias("side"), path.alias("path"), "page_id", "html")

    @cached_property
    def elements(self) -> DataFrame:
        """Element rows of the pages: parsed once, read by every extraction rule."""
        return cut_lineage(elements(self.page_html))

    @cached_property
    def annotated(self) -> DataFrame:
        """Elements that are not ignored, with their regions and what stands around them."""
        return cut_lineage(kept(annotate(dealt(self.elements, ["side", "path"]), (".ad",))))
