"""Queries over column transforms: text, URLs, prices, images, style values, comparable facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlens.config import PathMap, Rewrite, UrlRules
from twinlens.functions import cssvals, prices, text, urls, values
from twinlens.functions.csstables import COLOR_PROPERTIES, GROUPS, LENGTH_PROPERTIES, compared_properties
from twinlens.plans import second_engine as sql
from twinlens.plans.derive import STYLE_COLUMNS, Tables
from twinlens.plans.registry import query

_TYPED = "'“' || replace(replace(text, ', ', ' — '), '. ', '. ’') || '”'"


@query(
    "text_normalize", "C1",
    f"SELECT doc_id, {sql.normalize(_TYPED)} AS normalized FROM documents",
)
def text_normalize(t: Tables):
    typed = F.concat(
        F.lit("“"), F.replace(F.replace("text", F.lit(", "), F.lit(" — ")), F.lit(". "), F.lit(". ’")), F.lit("”")
    )
    return t.documents.select("doc_id", text.normalize_text(typed).alias("normalized"))


@query("text_key", "C2", "SELECT doc_id, sha1('text:' || text) AS key FROM documents")
def text_key(t: Tables):
    return t.documents.select("doc_id", text.node_key(F.lit("text"), F.col("text")).alias("key"))


@query(
    "text_family", "C3",
    "SELECT side, CASE WHEN kind IN ('paragraph', 'listItem', 'tableCell') THEN 'text' ELSE kind END AS family, "
    "count(*) AS n FROM raw_nodes GROUP BY 1, 2",
    "raw_nodes",
)
def text_family(t: Tables):
    return t.derived("raw_nodes").groupBy("side", text.kind_family(F.col("kind")).alias("family")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "text_similarity", "C4",
    f"WITH g AS (SELECT conv_id, turn, text, {sql.grams('text')} AS grams FROM conversations) "
    "SELECT conv_id, turn, round(CASE WHEN a = b THEN 1.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0::DOUBLE "
    "ELSE 2.0::DOUBLE * len(list_intersect(ag, bg)) / (len(ag) + len(bg)) END, 6) AS similarity FROM ("
    "SELECT x.conv_id, x.turn, x.text AS a, y.text AS b, x.grams AS ag, y.grams AS bg FROM g x JOIN g y "
    "ON x.conv_id = y.conv_id AND y.turn = x.turn + 1) p",
)
def text_similarity(t: Tables):
    # The next turn is found by an equality join on the turn number: no window over a conversation.
    c = t.conversations.select("conv_id", "turn", F.col("text").alias("a"))
    nxt = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    score = F.round(text.trigram_similarity(F.col("a"), F.col("b")), 6)
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", score.alias("similarity"))


@query("text_truncate", "C5", f"SELECT doc_id, {sql.truncate('text', 60)} AS short FROM documents")
def text_truncate(t: Tables):
    return t.documents.select("doc_id", text.truncate(F.col("text"), 60).alias("short"))


@query(
    "url_canonical", "C6",
    f"SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS origin, {sql.norm_path(sql.raw_path('url'))} AS path, "
    f"{sql.norm_query('url')} AS search, {sql.fragment('url')} AS hash, {sql.canon_key('url')} AS key, "
    f"regexp_extract(url, '^https?://[^/?#]+') || {sql.canon_key('url')} AS href FROM pages",
)
def url_canonical(t: Tables):
    names = ("origin", "path", "search", "hash", "key", "href")
    return urls.canonicalize(t.pages, "url").select("page_id", *[F.col(f"c_{n}").alias(n) for n in names])


@query(
    "url_path", "C7",
    "SELECT page_id, " + sql.norm_path(sql.raw_path("u")) + " AS stripped, "
    "lower(regexp_replace(" + sql.raw_path("u") + ", '/+', '/', 'g')) AS kept FROM (SELECT page_id, "
    "replace(regexp_replace(url, '[?#].*$', ''), '/en/', '//EN//Ünder/') || CASE WHEN page_id % 3 = 0 THEN '/index.HTML' "
    "ELSE '' END AS u FROM pages) p",
)
def url_path(t: Tables):
    bare = F.replace(F.regexp_replace("url", "[?#].*$", ""), F.lit("/en/"), F.lit("//EN//Ünder/"))
    u = F.concat(bare, F.when(F.col("page_id") % 3 == 0, F.lit("/index.HTML")).otherwise(F.lit("")))
    df = urls.canonicalize(t.pages.select("page_id", u.alias("u")), "u", prefix="a")
    keep = UrlRules(trailing_slash="keep", index_files=())
    df = urls.canonicalize(df, "u", keep, prefix="b")
    return df.select("page_id", F.col("a_path").alias("stripped"), F.col("b_path").alias("kept"))


@query(
    "url_query", "C8",
    f"SELECT page_id, {sql.norm_query('u')} AS search FROM (SELECT page_id, "
    "u || CASE WHEN u LIKE '%?%' THEN '&' ELSE '?' END || 'b=2&gclid=9&A=%20z+y&b=1&UTM_Campaign=q&trk=1&c' AS u FROM "
    "(SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages) q) p",
)
def url_query(t: Tables):
    u = F.regexp_replace("url", "#.*$", "")
    joined = F.concat(
        u, F.when(u.contains("?"), F.lit("&")).otherwise(F.lit("?")),
        F.lit("b=2&gclid=9&A=%20z+y&b=1&UTM_Campaign=q&trk=1&c"),
    )
    df = urls.canonicalize(t.pages.select("page_id", joined.alias("u")), "u")
    return df.select("page_id", F.col("c_search").alias("search"))


@query(
    "url_fragment", "C9",
    "SELECT page_id, f, regexp_matches(f, '^#[/!]') AS auto, f <> '' AS always, false AS never FROM (SELECT page_id, "
    "CASE WHEN page_id % 3 = 0 THEN '#/route' WHEN page_id % 3 = 1 THEN '#!bang' ELSE regexp_extract(url, '#.*$') END AS f "
    "FROM pages) p",
)
def url_fragment(t: Tables):
    n = F.col("page_id") % 3
    f = F.when(n == 0, F.lit("#/route")).when(n == 1, F.lit("#!bang")).otherwise(F.regexp_extract("url", "#.*$", 0))
    df = t.pages.select("page_id", f.alias("f"))
    return df.select("page_id", "f", *[urls.keep_fragment(F.col("f"), m).alias(m) for m in ("auto", "always", "never")])


_HREF = (
    "CASE (page_id + pos) % 9 WHEN 0 THEN 'mailto:a@b.c' WHEN 1 THEN '#top' WHEN 2 THEN '#/route' WHEN 3 THEN 'javascript:x()' "
    "WHEN 4 THEN '//cdn.example' || href WHEN 5 THEN 'tel:123' WHEN 6 THEN '?q=1' WHEN 7 THEN 'next' || href ELSE href END"
)
_RESOLVED = (
    "CASE WHEN h = '#top' OR regexp_matches(h, '^(mailto|tel|javascript):') THEN NULL WHEN h LIKE '#%' THEN "
    "regexp_replace(url, '#.*$', '') || h WHEN h LIKE '//%' THEN regexp_extract(url, '^https?:') || h WHEN h LIKE '/%' THEN "
    "regexp_extract(url, '^https?://[^/]+') || h WHEN h LIKE '?%' THEN regexp_replace(url, '[?#].*$', '') || h ELSE "
    "regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || h END"
)


def _hrefs(t: Tables):
    rows = t.pages.select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href")
    )
    return rows.select("page_id", "url", "pos", F.expr(_HREF).alias("h"))


@query(
    "url_resolve", "C10",
    f"SELECT page_id, pos, h, {_RESOLVED} AS resolved FROM (SELECT p.page_id, p.url, pos, {_HREF.replace('page_id', 'p.page_id')} "
    "AS h FROM hrefs r JOIN pages p ON p.page_id = r.page_id) x",
    "hrefs",
)
def url_resolve(t: Tables):
    return _hrefs(t).select("page_id", "pos", "h", urls.resolve_href(F.col("h"), F.col("url")).alias("resolved"))


@query(
    "url_classify", "C11",
    "SELECT page_id, pos, CASE WHEN h = '#top' THEN 'anchor' WHEN h LIKE '#%' THEN 'internal' WHEN h LIKE 'mailto:%' THEN "
    "'mailto' WHEN h LIKE 'tel:%' THEN 'tel' WHEN h LIKE 'javascript:%' THEN 'unsupported' WHEN h LIKE '//%' THEN 'external' "
    f"ELSE 'internal' END AS kind FROM (SELECT p.page_id, pos, {_HREF.replace('page_id', 'p.page_id')} AS h FROM hrefs r "
    "JOIN pages p ON p.page_id = r.page_id) x",
    "hrefs",
)
def url_classify(t: Tables):
    same = urls.url_origin(urls.resolve_href(F.col("h"), F.col("url"))) == urls.url_origin(F.col("url"))
    return _hrefs(t).select("page_id", "pos", urls.classify_href(F.col("h"), F.col("url"), same).alias("kind"))


_MAP = PathMap(
    overrides={"/en/853": "/home", "/fr/825?page=2&ref=x": "/accueil"},
    rewrites=(Rewrite(r"^/de/(\d+)", "/german/$1"), Rewrite(r"/(\d)(\d)", "/$2-$1"), Rewrite(r"\d", "n", True)),
)


@query(
    "url_map_path", "C12",
    "SELECT page_id, target, target <> key AS remapped FROM (SELECT page_id, key, CASE WHEN key = '/en/853' THEN '/home' "
    "WHEN key = '/fr/825?page=2&ref=x' THEN '/accueil' WHEN regexp_matches(key, '^/de/(\\d+)') THEN "
    "regexp_replace(key, '^/de/(\\d+)', '/german/\\1') WHEN regexp_matches(key, '/(\\d)(\\d)') THEN "
    "regexp_replace(key, '/(\\d)(\\d)', '/\\2-\\1') WHEN regexp_matches(key, '\\d') THEN regexp_replace(key, '\\d', 'n', 'g') "
    "ELSE key END AS target FROM canon) x",
    "canon",
)
def url_map_path(t: Tables):
    df = urls.canonicalize(t.pages, "url").withColumn("target", urls.map_path(F.col("c_key"), _MAP))
    return df.select("page_id", "target", (F.col("target") != F.col("c_key")).alias("remapped"))


@query(
    "url_origin", "C13",
    "SELECT page_id, lower(regexp_extract(url, '^https?://[^/]+')) || CASE WHEN page_id % 3 = 2 THEN ':8080' ELSE '' END "
    "AS origin FROM pages",
)
def url_origin(t: Tables):
    port = F.expr(
        "CASE WHEN page_id % 3 = 0 THEN ':80' WHEN page_id % 3 = 1 THEN ':443' ELSE ':8080' END"
    )
    host = F.regexp_extract("url", "^(https?)://([^/]+)", 2)
    scheme = F.regexp_extract("url", "^(https?)://", 1)
    own = F.when(F.col("page_id") % 3 == 2, port).when(scheme == "http", F.lit(":80")).otherwise(F.lit(":443"))
    u = F.concat(F.upper(scheme), F.lit("://"), host, own, F.lit("/x"))
    return t.pages.select("page_id", urls.url_origin(u).alias("origin"))


_RAW_CENTS = "(CAST(round(p_retailprice * 100) AS BIGINT) + CASE WHEN p_partkey % 17 = 2 AND side = 'target' THEN 10000 ELSE 0 END)"
_PRICE_JOIN = (
    "FROM prices q JOIN part ON q.context = p_name || ' ' || p_brand || ' no ' || p_partkey"
)


@query(
    "price_amount", "C14",
    f"SELECT side, context, raw, {_RAW_CENTS} / 100.0::DOUBLE AS amount {_PRICE_JOIN}",
    "prices",
)
def price_amount(t: Tables):
    return t.derived("prices").select("side", "context", "raw", prices.parse_amount(F.col("raw")).alias("amount"))


@query(
    "price_currency", "C15",
    "SELECT side, context, CASE WHEN raw LIKE 'EUR%' THEN 'EUR' ELSE 'USD' END AS found, CASE WHEN pos % 3 = 0 THEN 'GBP' "
    "WHEN pos % 3 = 1 THEN 'BRL' WHEN raw LIKE 'EUR%' THEN 'EUR' ELSE 'USD' END AS hinted FROM prices",
    "prices",
)
def price_currency(t: Tables):
    n = F.col("pos") % 3
    hint = F.when(n == 0, F.lit(" gbp ")).when(n == 1, F.lit("R$")).otherwise(F.lit("?"))
    raw = F.col("raw")
    return t.derived("prices").select(
        "side", "context", prices.detect_currency(raw).alias("found"), prices.detect_currency(raw, hint).alias("hinted")
    )


@query(
    "price_parse", "C16",
    f"SELECT side, context, {_RAW_CENTS} / 100.0::DOUBLE AS amount, CASE WHEN raw LIKE 'EUR%' THEN 'EUR' ELSE 'USD' END AS "
    f"currency, raw {_PRICE_JOIN}",
    "prices",
)
def price_parse(t: Tables):
    return t.derived("prices").select("side", "context", prices.parse_price(F.col("raw")).alias("p")).select(
        "side", "context", "p.*"
    )


@query("image_asset_key", "C17", "SELECT side, path, pos, src, asset_key FROM asset_rows", "asset_rows")
def image_asset_key(t: Tables):
    return t.images.select("side", "path", "pos", "src", "asset_key")


def _style_values(t: Tables):
    rows = t.derived("styles")
    pairs = F.array(*[F.struct(F.lit(p).alias("property"), F.col(c).alias("value")) for p, c in STYLE_COLUMNS.items()])
    return rows.select("side", "path", "viewport", "pos", F.inline(pairs))


_UNPIVOT = " UNION ALL ".join(
    f"SELECT side, path, viewport, pos, key, visible, '{p}' AS property, {c} AS value FROM styles" for p, c in STYLE_COLUMNS.items()
)
_PX = "TRY_CAST(regexp_extract(trim(value), '^(-?\\d*\\.?\\d+)px$', 1) AS DOUBLE)"


@query(
    "css_px", "C18",
    f"WITH v AS ({_UNPIVOT}) SELECT side, path, viewport, pos, property, {_PX} AS px FROM v",
    "styles",
)
def css_px(t: Tables):
    return _style_values(t).select(
        "side", "path", "viewport", "pos", "property", cssvals.parse_px(F.col("value")).alias("px")
    )


def _hex_sql(v: str) -> str:
    pair = lambda i: f"('0x' || substr({v}, {i}, 2))::BIGINT::VARCHAR"
    return f"'rgba(' || {pair(2)} || ', ' || {pair(4)} || ', ' || {pair(6)} || ', 1)'"


def _color_sql(v: str) -> str:
    part = lambda i: f"regexp_extract({v}, '(\\d+),\\s*(\\d+),\\s*(\\d+)', {i})"
    return (
        f"CASE WHEN {v} LIKE '#%' THEN {_hex_sql(v)} WHEN {v} LIKE 'rgb%' THEN 'rgba(' || {part(1)} || ', ' || {part(2)} "
        f"|| ', ' || {part(3)} || ', 1)' ELSE lower({v}) END"
    )


@query(
    "css_color", "C19",
    f"SELECT side, path, viewport, pos, {_color_sql('css_color')} AS color FROM styles",
    "styles",
)
def css_color(t: Tables):
    return t.derived("styles").select(
        "side", "path", "viewport", "pos", cssvals.normalize_color(F.col("css_color")).alias("color")
    )


_FONT_SQL = (
    "array_to_string(list_filter(list_transform(string_split(css_font_family, ','), lambda f: "
    "lower(regexp_replace(trim(f), '^[\"'']|[\"'']$', '', 'g'))), lambda f: f <> ''), ', ')"
)


@query(
    "css_font", "C20",
    f"SELECT side, path, viewport, pos, {_FONT_SQL} AS stack, trim(string_split({_FONT_SQL}, ',')[1]) AS first FROM styles",
    "styles",
)
def css_font(t: Tables):
    c = F.col("css_font_family")
    return t.derived("styles").select(
        "side", "path", "viewport", "pos", cssvals.normalize_font(c).alias("stack"), cssvals.primary_font(c).alias("first")
    )


_SHADOW_COLOR = "regexp_extract(css_box_shadow, '#[0-9a-f]{3,8}|rgba?\\([^)]*\\)')"


@query(
    "css_compound", "C21",
    f"SELECT side, path, viewport, pos, replace(css_box_shadow, {_SHADOW_COLOR}, '*') AS skeleton, {_SHADOW_COLOR} AS colors, "
    f"regexp_replace(trim(replace(css_box_shadow, {_SHADOW_COLOR}, {_color_sql(_SHADOW_COLOR)})), '\\s+', ' ', 'g') AS normalized "
    "FROM styles",
    "styles",
)
def css_compound(t: Tables):
    c = F.col("css_box_shadow")
    return t.derived("styles").select(
        "side", "path", "viewport", "pos",
        F.regexp_replace(cssvals.color_skeleton(c), "\\x00", "*").alias("skeleton"),
        F.array_join(cssvals.embedded_colors(c), "|").alias("colors"),
        cssvals.normalize_compound(cssvals.normalize_embedded(c)).alias("normalized"),
    )


def _num_sql(v: str) -> str:
    """A length with at most two decimals as its shortest text."""
    rounded = f"(floor({v} * 100 + 0.5) / 100)"
    return f"regexp_replace({rounded}::VARCHAR, '\\.0$', '')"


_NORMAL_SQL = (
    f"CASE property WHEN 'color' THEN {_color_sql('value')} WHEN 'font-family' THEN {_FONT_SQL.replace('css_font_family', 'value')} "
    f"WHEN 'box-shadow' THEN regexp_replace(trim(replace(value, {_SHADOW_COLOR.replace('css_box_shadow', 'value')}, "
    f"{_color_sql(_SHADOW_COLOR.replace('css_box_shadow', 'value'))})), '\\s+', ' ', 'g') "
    f"ELSE CASE WHEN property IN ('font-size', 'margin-top') AND {_PX} IS NOT NULL THEN {_num_sql(_PX)} || 'px' "
    "ELSE lower(trim(value)) END END"
)


@query(
    "css_normalize", "C22",
    f"WITH v AS ({_UNPIVOT}) SELECT side, path, viewport, pos, property, {_NORMAL_SQL} AS normalized FROM v",
    "styles",
)
def css_normalize(t: Tables):
    return _style_values(t).select(
        "side", "path", "viewport", "pos", "property",
        cssvals.normalize_css(F.col("property"), F.col("value")).alias("normalized"),
    )


def _part_colors(t: Tables):
    n, c = (lambda k: (F.col("p_partkey") * k % 256).cast("string")), F.concat
    rgba = lambda a, b, d: c(F.lit("rgba("), n(a), F.lit(", "), n(b), F.lit(", "), n(d), F.lit(", 1)"))
    return t.part.select("p_partkey", rgba(7, 11, 13).alias("a"), rgba(17, 5, 3).alias("b"))


def _lab_sql(r: str, g: str, b: str) -> str:
    """Lab of three channel expressions as a struct literal, CIE formulas written out."""
    lin = lambda c: f"(CASE WHEN {c} / 255.0 > 0.04045 THEN pow(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END)"
    x = f"(0.4360747 * {lin(r)} + 0.3850649 * {lin(g)} + 0.1430804 * {lin(b)}) / 0.9642200"
    y = f"(0.2225045 * {lin(r)} + 0.7168786 * {lin(g)} + 0.0606169 * {lin(b)}) / 1.0"
    z = f"(0.0139322 * {lin(r)} + 0.0971045 * {lin(g)} + 0.7141733 * {lin(b)}) / 0.8252100"
    f = lambda v: f"(CASE WHEN {v} > 216.0 / 24389 THEN cbrt({v}) ELSE (24389.0 / 27 * ({v}) + 16) / 116 END)"
    return f"{{'l': 116 * {f(y)} - 16, 'a': 500 * ({f(x)} - {f(y)}), 'b': 200 * ({f(y)} - {f(z)})}}"


_P = "p_partkey"
# From a table `lab` with the Lab structs p and q to `z`, which has the parts of their distance.
_DELTA_STEPS = (
    "g AS (SELECT *, pow((sqrt(p.a * p.a + p.b * p.b) + sqrt(q.a * q.a + q.b * q.b)) / 2, 7) AS m7 FROM lab), "
    "c AS (SELECT *, p.a * (1.5 - 0.5 * sqrt(m7 / (m7 + pow(25.0, 7)))) AS a1, q.a * (1.5 - 0.5 * sqrt(m7 / (m7 + pow(25.0, 7)))) AS a2 FROM g), "
    "h AS (SELECT *, sqrt(a1 * a1 + p.b * p.b) AS c1, sqrt(a2 * a2 + q.b * q.b) AS c2, "
    "CASE WHEN atan2(p.b, a1) < 0 THEN degrees(atan2(p.b, a1)) + 360 ELSE degrees(atan2(p.b, a1)) END AS h1, "
    "CASE WHEN atan2(q.b, a2) < 0 THEN degrees(atan2(q.b, a2)) + 360 ELSE degrees(atan2(q.b, a2)) END AS h2 FROM c), "
    "d AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 "
    "ELSE h2 - h1 END AS dh FROM h), "
    "e AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN h1 + dh / 2 < 0 THEN h1 + dh / 2 + 360 WHEN h1 + dh / 2 >= 360 "
    "THEN h1 + dh / 2 - 360 ELSE h1 + dh / 2 END AS mh, (p.l + q.l) / 2 AS ml, (c1 + c2) / 2 AS mc FROM d), "
    "w AS (SELECT *, 1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) "
    "- 0.20 * cos(radians(4 * mh - 63)) AS t FROM e), "
    "z AS (SELECT *, (q.l - p.l) / (1 + 0.015 * pow(ml - 50, 2) / sqrt(20 + pow(ml - 50, 2))) AS dl, "
    "(c2 - c1) / (1 + 0.045 * mc) AS dc, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * mc * t) AS dhh, "
    "-2 * sqrt(pow(mc, 7) / (pow(mc, 7) + pow(25.0, 7))) * sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) AS rt FROM w) "
)
_DELTA = "round(least(sqrt(greatest(dl * dl + dc * dc + dhh * dhh + rt * dc * dhh, 0)) / 100, 1), 3)"
_DELTA_SQL = (
    "WITH lab AS (SELECT p_partkey, "
    + _lab_sql(f"({_P} * 7 % 256)", f"({_P} * 11 % 256)", f"({_P} * 13 % 256)") + " AS p, "
    + _lab_sql(f"({_P} * 17 % 256)", f"({_P} * 5 % 256)", f"({_P} * 3 % 256)") + f" AS q FROM part), {_DELTA_STEPS} "
    f"SELECT p_partkey, {_DELTA} AS delta_e FROM z"
)


@query("css_color_distance", "C23", _DELTA_SQL)
def css_color_distance(t: Tables):
    return _part_colors(t).select("p_partkey", cssvals.color_distance(F.col("a"), F.col("b")).alias("delta_e"))


_PAIR_SQL = (
    f"WITH v AS ({_UNPIVOT}), n AS (SELECT *, {_NORMAL_SQL} AS nv FROM v), p AS (SELECT s.path, s.viewport, s.pos, s.property, "
    "s.nv AS a, x.nv AS b, s.value AS sv, x.value AS tv FROM n s JOIN n x ON s.side = 'source' AND x.side = 'target' AND s.path = x.path "
    "AND s.viewport = x.viewport AND s.pos = x.pos AND s.property = x.property) "
)
_PX_OF = lambda c: f"TRY_CAST(regexp_extract({c}, '^(-?\\d*\\.?\\d+)px$', 1) AS DOUBLE)"
_DPX = f"floor(({_PX_OF('b')} - {_PX_OF('a')}) * 100 + 0.5) / 100"


def _css_pairs(t: Tables):
    rows = _style_values(t)
    key = ["path", "viewport", "pos", "property"]
    s = rows.where(F.col("side") == "source").select(*key, F.col("value").alias("source_value"))
    return s.join(rows.where(F.col("side") == "target").select(*key, F.col("value").alias("target_value")), key)


@query(
    "css_compare", "C24",
    _PAIR_SQL + "SELECT path, viewport, pos, property, CASE WHEN a = b THEN 'equal' WHEN property = 'font-family' THEN "
    "CASE WHEN string_split(a, ',')[1] = string_split(b, ',')[1] THEN 'font-fallback' ELSE 'value' END "
    f"WHEN {_DPX} IS NOT NULL THEN CASE WHEN abs({_DPX}) <= 1 THEN 'equal' ELSE 'length' END ELSE 'value' END AS kind, "
    f"CASE WHEN a <> b THEN {_DPX} END AS delta_px FROM p WHERE property NOT IN ('color', 'box-shadow')",
    "styles",
)
def css_compare(t: Tables):
    # Colour-valued properties are in css_compare_colors: their grades need the distance function.
    rows = _css_pairs(t).where(~F.col("property").isin("color", "box-shadow"))
    return cssvals.compare_css(rows).select("path", "viewport", "pos", "property", "kind", "delta_px")


_COLOR_PATTERN = "rgba\\((\\d+), (\\d+), (\\d+), [\\d.]+\\)"
_CHANNEL = lambda c, i: f"coalesce(TRY_CAST(regexp_extract({c}, '{_COLOR_PATTERN}', {i}) AS DOUBLE), 0)"
_LESS_COLOR = lambda c: f"regexp_replace({c}, '{_COLOR_PATTERN}', '', 'g')"
# A shadow of the data holds one colour at most.
_COLORS_SQL = (
    _PAIR_SQL.rstrip() + ", lab AS (SELECT path, viewport, pos, property, a AS va, b AS vb, "
    + _lab_sql(*[_CHANNEL("a", i) for i in (1, 2, 3)]) + " AS p, " + _lab_sql(*[_CHANNEL("b", i) for i in (1, 2, 3)]) + " AS q, "
    f"a <> b AND regexp_matches(a, '{_COLOR_PATTERN}') AND regexp_matches(b, '{_COLOR_PATTERN}') AND {_LESS_COLOR('a')} = {_LESS_COLOR('b')} AS comparable "
    f"FROM p WHERE property IN ('color', 'box-shadow')), {_DELTA_STEPS}, r AS (SELECT *, CASE WHEN comparable THEN {_DELTA} END AS delta_e FROM z) "
    "SELECT path, viewport, pos, property, CASE WHEN va = vb THEN 'equal' WHEN delta_e IS NOT NULL THEN CASE WHEN delta_e <= 0.01 THEN 'equal' ELSE "
    "'color' END ELSE 'value' END AS kind, delta_e FROM r"
)


# Every property of a pair of styled nodes: `cmp` has what the comparison of values says.
COMPARED_SQL = (
    _PAIR_SQL.rstrip() + ", lab AS (SELECT path, viewport, pos, property, a AS va, b AS vb, "
    f"{_PX_OF('a')} AS apx, CASE WHEN a <> b AND property <> 'font-family' THEN {_DPX} END AS dpx, "
    + _lab_sql(*[_CHANNEL("a", i) for i in (1, 2, 3)]) + " AS p, " + _lab_sql(*[_CHANNEL("b", i) for i in (1, 2, 3)]) + " AS q, "
    f"a <> b AND property IN ('color', 'box-shadow') AND regexp_matches(a, '{_COLOR_PATTERN}') AND regexp_matches(b, '{_COLOR_PATTERN}') AND "
    f"{_LESS_COLOR('a')} = {_LESS_COLOR('b')} AS comparable FROM p), {_DELTA_STEPS}, "
    f"r AS (SELECT *, CASE WHEN comparable THEN {_DELTA} END AS delta_e FROM z), "
    "k AS (SELECT *, CASE WHEN va = vb THEN 'equal' WHEN property = 'font-family' THEN CASE WHEN string_split(va, ',')[1] = string_split(vb, ',')[1] "
    "THEN 'font-fallback' ELSE 'value' END WHEN delta_e IS NOT NULL THEN CASE WHEN delta_e <= 0.01 THEN 'equal' ELSE 'color' END WHEN dpx IS NOT NULL "
    "THEN CASE WHEN abs(dpx) <= 1 THEN 'equal' ELSE 'length' END ELSE 'value' END AS kind FROM r), "
    "cmp AS (SELECT k.*, x.key, CASE WHEN delta_e IS NOT NULL THEN delta_e / 0.03 WHEN dpx IS NOT NULL THEN greatest(abs(dpx) / 4, CASE WHEN apx <> 0 "
    "THEN abs(dpx / apx) / 0.15 ELSE 0 END) END AS magnitude FROM k JOIN styles x ON x.side = 'source' AND x.path = k.path AND x.viewport = k.viewport "
    "AND x.pos = k.pos AND x.visible JOIN styles y ON y.side = 'target' AND y.path = k.path AND y.viewport = k.viewport AND y.pos = k.pos AND y.visible)"
)


@query("css_compare_colors", "C24 C25", _COLORS_SQL, "styles")
def css_compare_colors(t: Tables):
    rows = _css_pairs(t).where(F.col("property").isin("color", "box-shadow"))
    return cssvals.compare_css(rows).select("path", "viewport", "pos", "property", "kind", "delta_e")


@query(
    "css_geometry_tolerance", "C26",
    "SELECT DISTINCT viewport, greatest(2.0::DOUBLE, width * 0.01::DOUBLE) AS tolerance FROM captures",
    "captures",
)
def css_geometry_tolerance(t: Tables):
    tolerance = cssvals.geometry_tolerance(F.col("width"), 2.0, 0.01)
    return t.derived("captures").select("viewport", tolerance.alias("tolerance")).distinct()


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


_GROUP_ROWS = [(p, g) for g, members in GROUPS.items() for p in members]


@query(
    "css_property_groups", "C27",
    f"WITH dim(property, grp) AS (VALUES {_values(_GROUP_ROWS)}), v AS ({_UNPIVOT}) SELECT v.property, dim.grp AS property_group, "
    "count(*) AS n FROM v JOIN dim ON dim.property = v.property WHERE v.property NOT IN ('font-family') GROUP BY 1, 2",
    "styles",
)
def css_property_groups(t: Tables):
    allowed = compared_properties(("Font-Family",))
    rows = _style_values(t).where(F.col("property").isin(*allowed))
    return rows.groupBy("property", cssvals.group_of(F.col("property")).alias("property_group")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "css_property_flags", "C28",
    f"WITH v AS ({_UNPIVOT}) SELECT property, property IN ({', '.join(repr(p) for p in LENGTH_PROPERTIES)}) AS is_length, "
    f"property IN ({', '.join(repr(p) for p in COLOR_PROPERTIES)}) AS is_color, count(*) AS n FROM v GROUP BY 1, 2, 3",
    "styles",
)
def css_property_flags(t: Tables):
    p = F.col("property")
    return _style_values(t).groupBy(
        "property", cssvals.is_length_property(p).alias("is_length"), cssvals.is_color_property(p).alias("is_color")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- comparable facts -------------------------------------------------------------------

_S = r"[\s\x{a0}]"
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
# The same fixed patterns in the second engine's syntax, where a word boundary is ASCII.
SQL_PATTERNS = {
    "amount": rf"(?:[$£€]{_S}?-?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?{_S}?(?:aud|usd|gbp|eur|dollars?|cents?|pence)\b)",
    "date": rf"\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}{_S}+(?:{_MONTHS})(?:{_S}+\d{{4}})?|(?:{_MONTHS}){_S}+\d{{1,2}}(?:,?{_S}+\d{{4}})?)\b",
    "duration": rf"\b\d[\d,]*(?:\.\d+)?{_S}?(?:business{_S}+)?(?:day|week|fortnight|month|year|hour|minute)s?\b",
    "contact": rf"(?:\b[\w.+-]+@[\w-]+\.[\w.]+\b|\b\d(?:[\d()-]|{_S}){{7,}}\d\b)",
    "number": r"\b\d[\d,]*(?:\.\d+)?(?:%|\b)",
    "negation": r"\b(?:not|no|never|cannot|can''t|won''t|non-[a-z]+|without|ineligible|excluding|unavailable)\b",
}
SQL_MODAL = r"\b(?:may|might|must|shall|should|can|could|will|would|required|optional)\b"


def facts_ctes(source: str, column: str, tag: str) -> str:
    """CTE chain `<tag>` with one sorted list per class of `column`, keeping the columns of `source`."""
    out = [f"{tag}_start AS (SELECT *, lower({column}) AS low, [{{'s': 0, 'e': 0}}] AS claimed FROM {source})"]
    at = f"{tag}_start"
    for name, p in SQL_PATTERNS.items():
        out.append(
            f"{tag}_{name}_1 AS (SELECT *, regexp_extract_all(low, '{p}') AS hits, list_transform(string_split_regex(low, '{p}'), "
            f"lambda g: length(g)) AS gaps FROM {at})"
        )
        out.append(
            f"{tag}_{name}_2 AS (SELECT *, list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{'s': list_sum(gaps[1:i])::BIGINT + "
            "coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)::BIGINT, 'v': hits[i]}), "
            "lambda m: len(list_filter(claimed, lambda c: c.s < m.s + length(m.v) AND m.s < c.e)) = 0) AS free "
            f"FROM {tag}_{name}_1)"
        )
        out.append(
            f"{tag}_{name} AS (SELECT * EXCLUDE (hits, gaps, free, claimed), list_sort(list_transform(free, lambda m: "
            f"trim(regexp_replace(m.v, '{_S}+', ' ', 'g')))) AS {tag}_{name}_v, list_concat(claimed, list_transform(free, "
            f"lambda m: {{'s': m.s, 'e': m.s + length(m.v)}})) AS claimed FROM {tag}_{name}_2)"
        )
        at = f"{tag}_{name}"
    out.append(
        f"{tag} AS (SELECT * EXCLUDE (low, claimed), list_sort(regexp_extract_all(low, '{SQL_MODAL}')) AS {tag}_modal_v FROM {at})"
    )
    return ", ".join(out)


_FACTS = (
    "text || CASE WHEN doc_id % 3 = 0 THEN ' Pay $1,200.50 or 30 usd by 12/05/2024 or 5 March 2024 within 30 business days. "
    "Call 555 123 4567 or mail me@x.org. 10% not optional, non-refundable, you can''t.' ELSE ' 3 weeks, 7 dollars, may 12, 2024' END"
)


@query(
    "value_extract", "C29",
    f"WITH src AS (SELECT doc_id, {_FACTS} AS body FROM documents), " + facts_ctes("src", "body", "v")
    + " SELECT doc_id, " + ", ".join(f"array_to_string(v_{c}_v, '|') AS {c}" for c in SQL_PATTERNS) + " FROM v",
)
def value_extract(t: Tables):
    df = t.documents.select("doc_id", F.expr(_FACTS.replace("''", "\\'")).alias("body"))
    df = df.select("doc_id", values.critical_values(F.col("body")).alias("v"))
    return df.select("doc_id", *[F.array_join(f"v.{c}", "|").alias(c) for c in values.PATTERNS])


@query(
    "value_modals", "C30",
    f"SELECT doc_id, array_to_string(list_sort(regexp_extract_all(lower({_FACTS}), '{SQL_MODAL}')), '|') AS modals FROM documents",
)
def value_modals(t: Tables):
    df = t.documents.select("doc_id", F.expr(_FACTS.replace("''", "\\'")).alias("body"))
    return df.select("doc_id", F.array_join(values.extract_modals(F.col("body")), "|").alias("modals"))


_MODAL_PAIR = (
    "SELECT conv_id, turn, 'You must sign. ' || text AS a, CASE turn % 3 WHEN 0 THEN 'You should sign. ' || text "
    "WHEN 1 THEN 'Sign.' || substring(text, 1, CAST(floor(length(text) / 2.0) AS INT)) ELSE 'You must sign. ' || text END AS b FROM conversations"
)


@query(
    "value_modal_changed", "C31",
    f"WITH p AS ({_MODAL_PAIR}), m AS (SELECT *, list_sort(regexp_extract_all(lower(a), '{SQL_MODAL}')) AS ma, "
    f"list_sort(regexp_extract_all(lower(b), '{SQL_MODAL}')) AS mb, "
    f"trim(regexp_replace(regexp_replace(lower(a), '{SQL_MODAL}', ' ', 'g'), '{_S}+', ' ', 'g')) AS x, "
    f"trim(regexp_replace(regexp_replace(lower(b), '{SQL_MODAL}', ' ', 'g'), '{_S}+', ' ', 'g')) AS y FROM p), "
    f"g AS (SELECT *, {sql.grams('x')} AS x_g, {sql.grams('y')} AS y_g FROM m) "
    f"SELECT conv_id, turn, ma <> mb AND {sql.dice('x', 'y')} >= 0.85 AS changed FROM g",
)
def value_modal_changed(t: Tables):
    t.conversations.createOrReplaceTempView("conversations")
    pairs = t.spark.sql(_MODAL_PAIR)
    return pairs.select("conv_id", "turn", values.modal_changed(F.col("a"), F.col("b")).alias("changed"))


@query(
    "value_multiset_minus", "C32",
    "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9]+') AS a, regexp_extract_all(lower(substr(text, 1, "
    "length(text) // 2)), '[0-9]+') AS b FROM documents), ca AS (SELECT doc_id, v, count(*) AS n FROM (SELECT doc_id, unnest(a) AS v "
    "FROM w) x GROUP BY 1, 2), cb AS (SELECT doc_id, v, count(*) AS n FROM (SELECT doc_id, unnest(b) AS v FROM w) x GROUP BY 1, 2) "
    "SELECT w.doc_id, coalesce(d.left_over, 0)::BIGINT AS left_over, coalesce(d.kinds, 0)::BIGINT AS kinds FROM w LEFT JOIN ("
    "SELECT ca.doc_id, sum(greatest(ca.n - coalesce(cb.n, 0), 0)) AS left_over, count(*) FILTER (ca.n > coalesce(cb.n, 0)) AS kinds "
    "FROM ca LEFT JOIN cb ON ca.doc_id = cb.doc_id AND ca.v = cb.v GROUP BY 1) d ON d.doc_id = w.doc_id",
)
def value_multiset_minus(t: Tables):
    words = lambda c: F.array_sort(F.regexp_extract_all(F.lower(c), F.lit("[0-9]+"), F.lit(0)))
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    df = t.documents.select("doc_id", words(F.col("text")).alias("a"), words(half).alias("b"))
    rest = df.withColumn("rest", values.multiset_minus(F.col("a"), F.col("b")))
    return rest.select(
        "doc_id", F.size("rest").cast("bigint").alias("left_over"),
        F.size(F.array_distinct("rest")).cast("bigint").alias("kinds"),
    )


_EDIT = (
    "SELECT doc_id, text || ' You must pay $45.00 within 14 days of 2024-01-05, not later. Call 555 123 4567.' AS a, text || CASE "
    "doc_id % 4 WHEN 0 THEN ' You should pay $45.00 within 14 days of 2024-01-05, not later. Call 555 123 4567.' WHEN 1 THEN "
    "' You must pay $49.99 within 30 days of 2024-01-05. Call 555 123 4567.' WHEN 2 THEN ' You must pay $45.00 within 14 days of "
    "2024-02-05, not later. Call 555 123 4568 now 7.' ELSE ' You must pay $45.00 within 14 days of 2024-01-05, not later; call "
    "555 123 4567!' END AS b FROM documents"
)


def _change_sql(c: str) -> str:
    minus = lambda x, y: (
        f"list_transform(list_filter(range(1, len({x}) + 1), lambda i: len(list_filter({x}[1:i], lambda v: v = {x}[i])) > "
        f"len(list_filter({y}, lambda v: v = {x}[i]))), lambda i: {x}[i])"
    )
    shown = lambda x: f"CASE WHEN len({x}) > 0 THEN array_to_string({x}, ', ') ELSE '(none)' END"
    a, b = f"a_{c}_v", f"b_{c}_v"
    return f"'{c}: ' || {shown(minus(a, b))} || ' → ' || {shown(minus(b, a))}"


def changes_sql(source: str, keys: str) -> str:
    """CTEs ending in `chg`: `keys` of `source` and the list of described changes of its columns a and b."""
    strip = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '{SQL_MODAL}', ' ', 'g'), '{_S}+', ' ', 'g'))"
    entries = ", ".join(
        f"CASE WHEN a_{c}_v <> b_{c}_v" + (f" AND {sql.dice('x', 'y')} >= 0.85" if c == "modal" else "")
        + f" THEN {_change_sql(c)} END"
        for c in values.CLASSES
    )
    return (
        facts_ctes(source, "a", "a") + ", " + facts_ctes("a", "b", "b")
        + f", chg0 AS (SELECT *, {strip('a')} AS x, {strip('b')} AS y FROM b), "
        f"chg1 AS (SELECT *, {sql.grams('x')} AS x_g, {sql.grams('y')} AS y_g FROM chg0), "
        f"chg AS (SELECT {keys}, list_filter([{entries}], lambda e: e IS NOT NULL) AS changes FROM chg1)"
    )


@query(
    "value_changes", "C33 C34",
    f"WITH src AS ({_EDIT}), {changes_sql('src', 'doc_id')} SELECT doc_id, array_to_string(changes, '; ') AS described, "
    "len(changes)::BIGINT AS classes FROM chg",
)
def value_changes(t: Tables):
    t.documents.createOrReplaceTempView("documents")
    df = t.spark.sql(_EDIT).select("doc_id", values.value_changes(F.col("a"), F.col("b")).alias("c"))
    return df.select(
        "doc_id", F.array_join(F.transform("c", values.describe_change), "; ").alias("described"),
        F.size("c").cast("bigint").alias("classes"),
    )
