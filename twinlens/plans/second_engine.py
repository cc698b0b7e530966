"""SQL fragments in the second engine's dialect, written apart from the Spark functions."""

from __future__ import annotations

SPACE = r"[\t\n\x{0b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TRACKING = (
    "'gclid','gbraid','wbraid','dclid','fbclid','msclkid','yclid','twclid','ttclid','igshid','mc_cid','mc_eid','_ga',"
    "'_gl','_hsenc','_hsmi','vero_id','oly_enc_id','oly_anon_id','mkt_tok','trk','trkCampaign'"
)


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def normalize(x: str) -> str:
    out = f"regexp_replace({x}, '{SPACE}+', ' ', 'g')"
    out = f"translate({out}, '“”‘’′″‐–—−', '\"\"''''''\"----')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def raw_path(u: str) -> str:
    bare = f"regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1)"
    runs = f"regexp_extract_all(CASE WHEN {bare} = '' THEN '/' ELSE {bare} END, '[^ -~]+|[ -~]+')"
    return (
        f"array_to_string(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '[^ -~]') THEN url_encode(r) "
        "ELSE r END), '')"
    )


def norm_path(p: str) -> str:
    out = f"lower(regexp_replace({p}, '/+', '/', 'g'))"
    out = f"regexp_replace({out}, '/(index\\.html|index\\.htm|default\\.aspx)$', '/')"
    return f"coalesce(nullif(regexp_replace({out}, '/+$', ''), ''), '/')"


def norm_query(u: str) -> str:
    pairs = f"list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda p: p <> '')"
    dec = lambda x: f"url_decode(replace({x}, '+', ' '))"
    split = (
        f"list_transform({pairs}, lambda p: {{'n': {dec('regexp_extract(p, $$^([^=]*)$$, 1)')}, "
        f"'v': {dec('regexp_extract(p, $$=(.*)$$, 1)')}}})"
    )
    kept = f"list_sort(list_filter({split}, lambda p: p.n NOT IN ({TRACKING}) AND NOT starts_with(lower(p.n), 'utm_')))"
    enc = lambda x: f"replace(replace(url_encode({x}), '%20', '+'), '~', '%7E')"
    text = f"array_to_string(list_transform({kept}, lambda p: {enc('p.n')} || '=' || {enc('p.v')}), '&')"
    return f"CASE WHEN {text} = '' THEN '' ELSE '?' || {text} END"


def fragment(u: str) -> str:
    f = f"regexp_extract({u}, '#.*$')"
    return f"CASE WHEN regexp_matches({f}, '^#[/!]') THEN {f} ELSE '' END"


def canon_key(u: str) -> str:
    return f"{norm_path(raw_path(u))} || {norm_query(u)} || {fragment(u)}"


def chars(x: str) -> str:
    return f"string_split('  ' || lower({x}) || '  ', '')"


def grams(x: str) -> str:
    c = chars(x)
    return f"list_distinct(list_transform(list_zip({c}, {c}[2:], {c}[3:]), lambda z: z[1] || z[2] || z[3]))"


def dice(a: str, b: str) -> str:
    """Trigram similarity of two columns that hold precomputed trigram lists `<a>_g` and `<b>_g`."""
    return (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE "
        f"2.0::DOUBLE * len(list_intersect({a}_g, {b}_g)) / (len({a}_g) + len({b}_g)) END"
    )


def truncate(x: str, n: int) -> str:
    return (
        f"CASE WHEN length({x}) <= {n} THEN {x} ELSE "
        f"rtrim(regexp_replace(substr({x}, 1, {n}), '[\\t\\n\\x{{0b}}\\f\\r ]+[^\\t\\n\\x{{0b}}\\f\\r ]*$', ''), ' ') || '...' END"
    )


def pct(part: str, total: str) -> str:
    return f"CASE WHEN {total} = 0 THEN 100.0::DOUBLE ELSE floor({part}::DOUBLE / {total} * 1000 + 0.5) / 10 END"


def slug(p: str) -> str:
    bare = f"regexp_replace(regexp_replace({p}, '^/', ''), '[^a-zA-Z0-9]+', '-', 'g')"
    head = f"lower(substr(regexp_replace({bare}, '^-+|-+$', '', 'g'), 1, 60))"
    return f"CASE WHEN {head} = '' THEN 'root' ELSE {head} END || '-' || substr(sha1({p}), 1, 8)"


def finding_id(category: str, path: str, *rest: str) -> str:
    """`rest`: viewport, region, node kind, subject, facet; empty text where absent."""
    parts = [*rest, *["''"] * (5 - len(rest))]
    joined = " || '|' || ".join([category, path, *[f"coalesce({p}, '')" for p in parts]])
    return f"sha1({joined})"


SEV = "CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"

SPECIAL: dict[str, tuple[tuple[str, ...], str]] = {
    "canon": ((), f"SELECT page_id, url, {canon_key('url')} AS key FROM pages"),
    "lines": (
        (),
        "SELECT doc_id, (u.i - 1)::BIGINT AS pos, l[u.i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l "
        "FROM documents) d, unnest(range(1, len(l) + 1)) AS u(i)",
    ),
    "page_hosts": ((), "SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages"),
    "hrefs": (
        (),
        "SELECT page_id, (u.i - 1)::BIGINT AS pos, h[u.i] AS href FROM (SELECT page_id, "
        "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages) d, unnest(range(1, len(h) + 1)) AS u(i)",
    ),
    "offers": (
        ("hrefs",),
        "SELECT page_id * 1000 AS seq, url, (page_id % 4)::INT AS depth FROM pages UNION ALL "
        "SELECT h.page_id * 1000 + h.pos + 1, regexp_extract(p.url, '^https?://[^/]+') || h.href, (h.page_id % 4 + 1)::INT "
        "FROM hrefs h JOIN pages p ON p.page_id = h.page_id",
    ),
    "node_rows": (
        ("raw_nodes",),
        "SELECT side, path, pos, region, kind, t AS text, sha1(CASE WHEN kind IN ('paragraph','listItem','tableCell') "
        "THEN 'text' ELSE kind END || ':' || t) AS key FROM (SELECT *, "
        f"{normalize('text')} AS t FROM raw_nodes) n WHERE t <> ''",
    ),
    "nodes": (
        ("node_rows",),
        "SELECT *, row_number() OVER (PARTITION BY side, path, region, key ORDER BY pos) - 1 AS ordinal FROM node_rows",
    ),
    "links": (
        ("first_pages", "hrefs"),
        "SELECT side, path, 'https://' || CASE side WHEN 'source' THEN 'legacy' ELSE 'new' END || '.example' || path AS page_url, "
        f"{slug('path')} AS slug, pos, href, 'to ' || href AS text, CASE WHEN pos < 1000 THEN 'nav' ELSE 'main' END AS region, "
        "(page_id + pos) % 5 <> 4 AS visible, CASE WHEN href LIKE 'http://partner%' THEN 'external' ELSE 'internal' END AS kind, "
        "CASE WHEN href LIKE 'http%' THEN href ELSE 'https://' || CASE side WHEN 'source' THEN 'legacy' ELSE 'new' END "
        f"|| '.example' || {raw_path(chr(39) + 'http://x' + chr(39) + ' || href')} || regexp_extract(href, '[?#].*$') END AS resolved, "
        f"CASE WHEN href NOT LIKE 'http%' THEN {canon_key(chr(39) + 'http://x' + chr(39) + ' || href')} END AS link_path "
        "FROM (SELECT s.side, f.page_id, f.key AS path, r.pos, r.href FROM first_pages f JOIN ("
        "SELECT page_id, pos, href FROM hrefs UNION ALL "
        "SELECT a.page_id, 1000 + u.j, b.key FROM first_pages a CROSS JOIN (SELECT unnest([0, 1, 2]) AS j) u "
        "JOIN first_pages b ON b.page_id = CASE u.j WHEN 0 THEN a.page_id * 2 + 1 WHEN 1 THEN a.page_id * 3 + 2 "
        "ELSE a.page_id // 3 END UNION ALL "
        "SELECT page_id, 2000, 'http://partner.example/' || (page_id % 50) FROM first_pages) r ON r.page_id = f.page_id "
        "CROSS JOIN (SELECT unnest(['source', 'target']) AS side) s "
        "WHERE s.side = 'source' OR (f.page_id + r.pos) % 6 <> 2) x",
    ),
    "idx": (
        ("page_rows",),
        "SELECT * FROM page_rows",
    ),
    "m": (
        ("page_rows",),
        "SELECT s.*, t.path AS target_path, t.url AS target_url, t.status AS target_status, t.hops AS target_hops, "
        "t.slow_capture AS target_slow FROM (SELECT * FROM page_rows WHERE side = 'source' AND status BETWEEN 200 AND 299) s "
        "LEFT JOIN (SELECT * FROM page_rows WHERE side = 'target') t ON t.path = s.path",
    ),
    "orphans": (
        ("page_rows", "links"),
        "SELECT DISTINCT path FROM page_rows WHERE side = 'source' AND path <> '/' AND path NOT IN (SELECT link_path FROM links "
        "WHERE side = 'source' AND kind = 'internal' AND link_path IS NOT NULL)",
    ),
    "fid": (
        ("findings_current",),
        "SELECT *, " + finding_id("category", "path", "viewport", "region", "node_kind", "subject", "facet")
        + " AS id FROM findings_current",
    ),
    "fid_base": (
        ("findings_baseline",),
        "SELECT *, " + finding_id("category", "path", "viewport", "region", "node_kind", "subject", "facet")
        + " AS id FROM findings_baseline",
    ),
    "asset_rows": (
        ("images",),
        # Undo the three source forms by name: the stem is the last path piece of the real asset.
        "SELECT *, lower(regexp_replace(regexp_replace(regexp_extract(url_decode(coalesce(nullif(regexp_extract(src, "
        "'[?&]url=([^&]*)', 1), ''), src)), '([^/?]+)(\\?[^/]*)?$', 1), '(?i)\\.(jpg|png|webp)$', ''), "
        "'[._-][0-9a-f]{8,40}$', '')) AS asset_key FROM images",
    ),
}
